"""Queries over merged spans against their SQL, on texts in which values stand in running prose."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmask import queries as core
from quillmask.operators.addresses import addresses
from quillmask.operators.split_contacts import find_split

TEXTS = [
    "Of onhant st, to it eaanen, of 64.245.247.29 the thrend.",
    "And tire, ed hely st, anti 4111 1111 1111 1111 hashly the.",
    "For atwh st, the thou, at +1 (412) 555-2426 ouly to.",
    "Of thndes st, anan on, token = 608866bb6ce402061353d365de9418d6b055c734 the.",
    "Thedha st, orha ereaor, and ssaakd.27@mail8.example.com ha the.",
    "Lorem ana.43@mail5.example.com zu. In ered bo.72@mail2.example.com.\nMe ha.",
    "plain words here",
]
NAMES = ["detections_by_label"]


def test_digits_of_other_values_make_no_address_of_prose(spark):
    lines = ["Larkspur Court, Mill Lane, Norvale, Tel: +91 20 4505 3237", "12 mill lane, elmwood, norvale, host 10.0.12.7", "9 Mill Lane, Elmwood, Norvale"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS[:5] + lines)], "k int, t string")
    rows = df.select("k", F.explode(addresses(F.col("t"))).alias("x")).collect()
    assert sorted((r.k, r.x.text, r.x.source) for r in rows) == [(5 + k, t, "address:line-heuristic") for k, t in enumerate(lines)]


def test_split_contacts_end_with_their_sentence():
    for text in ("ana.43@mail5.example.com zu. In ered", "ana@acme.com.au zu.\nMe ha", "ana@acme.com. In the end", "see www.acme.com. In the end"):
        assert find_split(text) == []
    cases = {"ana@ acme.com zu. In it": "ana@ acme.com", "ana@acme.co .in now": "ana@acme.co .in", "www.coindesk. Com": "www.coindesk. Com", "bo@acme.co m. In": "bo@acme.co m"}
    for text, value in cases.items():
        assert [text[a:b] for a, b, *_ in find_split(text)] == [value]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("prose")
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_over_prose(spark, sf, name):
    df, duck = core.QUERIES[name](spark, sf), duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    theirs = duck.sql(core.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(theirs.columns)
    expected = sorted(repr([r[theirs.columns.index(n)] for n in names]) for r in theirs.fetchall())
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == expected and expected
