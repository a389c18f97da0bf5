"""Detectors against Python's re, and their precision."""

import re

import pytest
from pyspark.sql import functions as F

from quillmask import udtf
from quillmask.functions import spans as S
from quillmask.operators import detectors
from quillmask.operators.addresses import addresses
from quillmask.operators.split_contacts import find_split
from quillmask.policy import Policy, register_label


def spans_of(spark, text, section="", policy=None):
    df = spark.createDataFrame([(text, section)], "text string, section string")
    row = df.select(S.merge(detectors.detect(F.col("text"), F.col("section"), policy)).alias("s")).first()
    return [(x.label, x.text) for x in row.s]


def test_native_offsets_equal_finditer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for d in (detectors.DETECTORS[0], detectors.DETECTORS[7], detectors.DETECTORS[9], detectors.DETECTORS[4]):
        hits = docs.select("doc_id", F.explode(S.find(F.col("text"), d.pattern)).alias("h")).select("doc_id", "h.*").collect()
        ours = sorted((r.doc_id, r.start, r.end, r.text) for r in hits)
        pattern = re.compile(udtf.python_pattern(d.pattern))
        theirs = sorted((k, m.start(), m.end(), m[0]) for k, t in texts.items() for m in pattern.finditer(t))
        assert ours == theirs


@pytest.mark.parametrize(
    "text",
    ["", "   ", "Invoice 774120 for order 200003456", "The board met on March 4, 2021.", "card 4111 1111 1111 1112", "12345678"],
)
def test_nothing_to_find(spark, text):
    assert spans_of(spark, text) == []


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(detectors.detect(F.col("text")).alias("s")).first().s in ([], None)


def test_header_word_din_not_substring(spark):
    assert spans_of(spark, "12345678", "Name | DIN") == [("NATIONAL_ID", "12345678")]
    assert spans_of(spark, "12345678", "Name | Holding") == []


def test_labels_prune_the_plan(spark):
    df = spark.createDataFrame([("a@b.example.org 10.0.0.1",)], "text string")
    only = df.select(detectors.detect(F.col("text"), None, Policy(labels=("IP_ADDRESS",))).alias("s"))
    assert [x.label for x in only.first().s] == ["IP_ADDRESS"]
    assert "@" not in only._jdf.queryExecution().optimizedPlan().toString()


def test_all_dates(spark):
    text = "The board met on March 4, 2021."
    assert spans_of(spark, text, policy=Policy(redact_all_dates=True)) == [("DOB", "March 4, 2021")]


def test_accents_at_a_boundary(spark):
    assert spans_of(spark, "éana@example.org") == [("EMAIL", "ana@example.org")] or spans_of(spark, "éana@example.org") == []
    assert spans_of(spark, "É10.0.0.1") == []


def test_own_detector_and_label(spark):
    register_label("BADGE", 65)
    own = lambda text, section: S.label(S.find(text, r"\bB-\d{4}\b"), "BADGE", "own:badge", 1.0, detectors.ORD_OWN)
    detectors.register_detector(own)
    try:
        assert ("BADGE", "B-1234") in spans_of(spark, "badge B-1234 lost")
    finally:
        detectors._own.clear()


def test_address_growth_and_limits(spark):
    cases = [
        ("Gat No. 11/3, Village Birchdale, near the old mill", ""),
        ("5 Hill Road, Sector 4, Elmwood", "Name | Address"),
        ("TKT-100294 was closed", ""),
        ("", ""),
        ("The firm, having its Registered Office at 11/3, Village Birchdale, , Norvale – 411 999, Maharashtra , India. It moved.", ""),
        ("he paid, who are many, Eastmere, Norvale PIN: 411999; Goa, Elsewhere", ""),
        ("Address: 22 Tamarind Street, Westbrook, IL 62999, USA and more", ""),
        ("  9 Mill Lane, near Sector 4, Elmwood  \nplain words here", ""),
        (", ".join(f"Part {chr(65 + k)}" for k in range(12)) + " – 411 999", ""),
        ("x" * 3000 + ", Eastmere, Norvale – 411 999", ""),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, s string")
    rows = df.select("k", "t", F.explode(addresses(F.col("t"), F.col("s"))).alias("x")).collect()
    assert all(r.t[r.x.start : r.x.end] == r.x.text for r in rows)
    got = {}
    for r in sorted(rows, key=lambda r: (r.k, r.x.start, r.x.source)):
        got.setdefault(r.k, []).append((r.x.text, r.x.source.removeprefix("address:")))
    assert got == {
        0: [(cases[0][0], "line-heuristic"), (cases[0][0], "opener")],
        1: [(cases[1][0], "column"), (cases[1][0], "line-heuristic")],
        4: [("11/3, Village Birchdale, , Norvale – 411 999, Maharashtra ", "postal-anchor")],
        5: [("Eastmere, Norvale PIN: 411999; Goa", "postal-anchor")],
        6: [("22 Tamarind Street, Westbrook, IL 62999", "postal-anchor")],
        7: [("9 Mill Lane, near Sector 4, Elmwood", "line-heuristic")],
        8: [(", ".join(f"Part {chr(65 + k)}" for k in range(3, 12)) + " – 411 999", "postal-anchor")],
        9: [("Eastmere, Norvale – 411 999", "postal-anchor")],
    }


def test_split_contacts_need_a_gap_and_a_domain():
    assert [(x[2], "ana@ acme.co m"[x[0] : x[1]]) for x in find_split("ana@ acme.co m")] == [("EMAIL", "ana@ acme.co m")]
    for text in ("visit the site. Company said", "ana@acme.example.org", "www.acme.example.org"):
        assert find_split(text) == []


def test_split_contacts_end_at_their_domain():
    cases = {"see www.acme testing.com/a?b=1, or": "www.acme testing.com/a?b=1", "WEBSITE www.acmetesting. community now": "www.acmetesting. com", "bo@acme.co .in.": "bo@acme.co .in"}
    for text, value in cases.items():
        assert [text[a:b] for a, b, *_ in find_split(text)] == [value]


def test_udtf_agrees_with_the_columns(spark):
    udtf.register(spark)
    text = "Mail ana@acme.example.org, card 4111 1111 1111 1111, host 10.0.0.7, call +91 98765 43210"
    df = spark.createDataFrame([(text,)], "text string")
    df.createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT s.* FROM some_texts, LATERAL pii_spans(text) s").collect()
    native = df.select(F.explode(detectors.structured(F.col("text"), F.lit(""))).alias("s")).select("s.*").collect()
    key = lambda r: (r.start, r.end, r.label, r.text, r.source)
    assert sorted(map(key, rows)) == sorted(map(key, native))
