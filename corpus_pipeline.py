"""A corpus pipeline of the llm operators. Each stage takes the documents that the one
before it kept, written as Parquet and read again, and works on all of them; all but the
last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm import bpe, common, line_dedup, mixing, quality_rules, simhash

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: The mix's Newton solution and the vocabulary's merges are not expressible in SQL.
ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and lines over the limit go from the others."""
    return _with_length(quality_rules.keep_good(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents have go from every text."""
    return _with_length(line_dedup.deduped(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its ids, their number, and the text decoded back from them. Further
    columns that are called ids or n_tokens give way."""
    out = bpe.encoded(docs, VOCABULARY, decode=True)
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens")]
    return out.select(*rest, F.col("decoded").alias("text"), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("mix_sources", mix), ("bpe_round_trip", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with common.passing(spark, lambda: docs):
            docs = common.settle(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}")
        if before is not None:
            common.forget(before)
        before = docs
