"""JSON inputs and the artefacts of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "block_id long, section string, text string"
GOLD = "block_id long, entities array<array<string>>"
TERMS = "map<string,map<string,array<string>>>"
CSV_COLUMNS = ["block", "part", "label", "original", "replacement", "find_in_output", "detector", "score"]


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file with a fixed schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def extra_terms(path: str) -> dict[str, str]:
    """{literal: kind} of the operator's own names; a small file that becomes part of the policy."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def reidentification_terms(spark: SparkSession, path: str) -> DataFrame:
    """(severity, anchor, term) of a {severity: {anchor: [term]}} file; keys that begin with an
    underscore, and what is no object, are commentary."""
    return terms_of(spark.read.text(path, wholetext=True))


def terms_of(raw: DataFrame) -> DataFrame:
    """(severity, anchor, term) of JSON texts `value`."""
    kinds = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("severity", "rest")).where(~F.col("severity").startswith("_"))
    anchors = kinds.select("severity", F.explode(F.from_json("rest", "map<string,array<string>>")).alias("anchor", "terms"))
    return anchors.select("severity", "anchor", F.explode("terms").alias("term"))


def mapping_json(mapping: DataFrame) -> DataFrame:
    """(doc_id, json): label -> original -> replacement, keys in order."""
    per_label = mapping.groupBy("doc_id", "label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("original", "replacement")))).alias("m"))
    whole = per_label.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.to_json("m").alias("m"))))).alias("m"))
    quoted = F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e.key, F.lit('":'), e.value))
    return whole.select("doc_id", F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")).alias("json"))


def detections_csv(audit: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The audit's eight columns as strings: text detections, then pictures."""
    rows = audit.select("doc_id", *[F.col(c).cast("string").alias(c) for c in CSV_COLUMNS])
    if decisions is None:
        return rows
    label = F.when(F.col("label") == "", F.lit("IMAGE_CLEAN")).otherwise(F.col("label"))
    pictures = decisions.select(
        "doc_id", F.col("name").alias("block"), F.lit("media").alias("part"), label.alias("label"), F.col("summary").alias("original"),
        F.col("action").alias("replacement"), F.lit("").alias("find_in_output"), F.concat(F.lit("image:"), "reason").alias("detector"), F.lit("1.00").alias("score"),
    )
    return rows.unionByName(pictures)


def write_artefacts(tables: dict[str, DataFrame], folder: str, decisions: DataFrame | None = None) -> None:
    """Mapping, detections, report and redacted blocks under a folder."""
    mapping_json(tables["mapping"]).write.mode("overwrite").json(f"{folder}/mapping")
    detections_csv(tables["audit"], decisions).write.mode("overwrite").option("header", True).csv(f"{folder}/detections")
    tables["report"].write.mode("overwrite").json(f"{folder}/report")
    tables["redacted"].select("doc_id", "block_id", "part", "section", F.col("redacted").alias("text")).write.mode("overwrite").parquet(f"{folder}/redacted")


def existing(spark: SparkSession, registry: dict[str, str]) -> dict[str, str]:
    """The entries of a {name: path} registry whose path exists."""

    def there(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    return {name: path for name, path in registry.items() if there(path)}


def metrics_json(totals: DataFrame, per_label: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row `json`: overall scores, token accuracy and scores per label. totals and per_label have
    tp, fp, fn, precision, recall, f1 (per_label: and label); tokens has correct and total."""
    names = ["tp", "fp", "fn", "precision", "recall", "f1"]
    overall = totals.select(F.struct(*names).alias("overall"))
    accuracy = tokens.agg(F.round(F.sum("correct") / F.sum("total"), 4).alias("token_accuracy"))
    kinds = per_label.where("label IS NOT NULL").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct(*names))))).alias("per_type"))
    return overall.crossJoin(accuracy).crossJoin(kinds).select(F.to_json(F.struct("overall", "token_accuracy", "per_type")).alias("json"))  # single rows
