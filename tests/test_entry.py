"""The driver's contract: entry, queries, and their SQL on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillmask import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


def same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = sorted(repr([_norm(r[n]) for n in names]) for r in df.collect())
    theirs = sorted(repr([_norm(r[relation.columns.index(n)]) for n in names]) for r in relation.fetchall())
    assert ours == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "redacted"] and df.count() == 200


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query(spark, duck, name):
    same(core.QUERIES[name](spark, SF), duck.sql(core.ORACLE[name]))
