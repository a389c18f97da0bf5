"""python -m quillmask.cli --input FILES -o FOLDER: redact Word documents."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import images as pictures
from .operators import links as link_ops
from .plans.engine import Engine, release
from .policy import ALL_LABELS, Policy
from .sources import docx, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True, help="a .docx file, a folder or a pattern")
    p.add_argument("-o", "--output", required=True, help="folder for the redacted documents")
    p.add_argument("--mapping", help="folder for original -> replacement, as JSON")
    p.add_argument("--detections", help="folder for the audit, as CSV")
    p.add_argument("--types", help="labels to redact, separated by commas")
    p.add_argument("--mode", choices=("fake", "tag"), default="fake")
    p.add_argument("--locale", default="en_US")
    p.add_argument("--seed", type=int, default=Policy.seed)
    p.add_argument("--redact-institutions", action="store_true")
    p.add_argument("--redact-all-dates", action="store_true")
    p.add_argument("--model", help="module:function of a tagger, an iterator over Series of texts")
    p.add_argument("--no-ner", action="store_true")
    p.add_argument("--extra-terms", help="JSON file {literal: PERSON or ORG}")
    p.add_argument("--keep-metadata", action="store_true")
    p.add_argument("--keep-locations", action="store_true")
    p.add_argument("--no-ocr", action="store_true", help="leave pictures alone")
    p.add_argument("--keep-images", action="store_true")
    p.add_argument("--redact-all-images", action="store_true")
    p.add_argument("--keep-unclassified-images", action="store_true")
    p.add_argument("--quiet", action="store_true")
    return p


def policy_of(a: argparse.Namespace) -> Policy:
    tagger = None
    if a.model and not a.no_ner:
        import importlib

        module, _, name = a.model.partition(":")
        tagger = getattr(importlib.import_module(module), name or "tag")
    labels = tuple(x.strip().upper() for x in a.types.split(",") if x.strip()) if a.types else ALL_LABELS
    return Policy(
        labels=labels, mode=a.mode, locale=a.locale, seed=a.seed, redact_institutions=a.redact_institutions, redact_all_dates=a.redact_all_dates,
        tagger=tagger, extra_terms=files.extra_terms(a.extra_terms) if a.extra_terms else {}, scrub_metadata=not a.keep_metadata,
        disable_images=a.no_ocr, keep_images=a.keep_images, redact_all_images=a.redact_all_images,
        keep_unclassified_images=a.keep_unclassified_images, redact_locations=not a.keep_locations,
    )


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Redact the documents that the arguments name; returns the report of all of them."""
    policy = policy_of(a)
    engine, rows = Engine(policy), docx.files(spark, a.input)
    tables = engine.run(docx.blocks(rows).drop("pieces"), docx.table_rows(rows))
    lexicon, decisions = tables["lexicon"], None
    if not policy.disable_images:
        evidence = pictures.analyse(docx.images(rows))
        decided = pictures.decide(evidence, policy, lexicon=lexicon)
        size = evidence.select("doc_id", "name", F.col("name").alias("seed"), "evidence.format", "evidence.width", "evidence.height")
        decisions = decided.join(size, ["doc_id", "name"])
    text_edits = tables["redacted"].select("doc_id", "block_id", F.when(F.col("redacted") != F.col("text"), _whole_or_spans()).alias("edits")).where("edits IS NOT NULL")
    out = docx.rewritten(
        rows,
        text_edits,
        link_ops.rewrite_links(docx.links(rows), lexicon, policy),
        link_ops.redact_fields(docx.fields(rows), lexicon, policy).where(F.size("spans") > 0),
        decisions,
        policy.scrub_metadata,
    )
    written = docx.save(out, a.output).count()
    if a.mapping:
        files.mapping_json(tables["mapping"]).write.mode("overwrite").json(a.mapping)
    if a.detections:
        files.detections_csv(tables["audit"], decisions).write.mode("overwrite").option("header", True).csv(a.detections)
    total = tables["report"].agg(F.sum("blocks").alias("blocks"), F.sum("blocks_changed").alias("changed"), F.sum("detections").alias("detections")).first()
    release(tables)
    refused = [r.doc_id for r in docx.refused(docx.found(spark, a.input), None).collect()]
    return {"documents": written, "refused": sorted(refused), **total.asDict()}


def _whole_or_spans():
    """The edits of a block; a block that a name over its end changed is replaced whole."""
    from .functions.spans import splice

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("redacted").alias("replacement")))
    return F.when(splice(F.col("text"), F.col("edits")) == F.col("redacted"), F.col("edits")).otherwise(whole)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillmask").getOrCreate()
    report = run(spark, a)
    if not a.quiet:
        print(json.dumps(report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
