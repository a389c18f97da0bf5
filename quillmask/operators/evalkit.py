"""Evaluation: sampling, matching against a gold standard, leaks, re-identification."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import literal_pattern

# Headings that open a section, and how many blocks of each are sampled.
STRATA = {
    "front_matter": r"(?i)^(red herring prospectus|definitions and abbreviations)",
    "general_information": r"(?iU)^general information\b",
    "management": r"(?i)^(our management|our promoters|promoter group)",
    "business": r"(?i)^(our business|history and certain corporate matters|industry overview)",
    "financial": r"(?i)^(financial|restated|other financial information|capital structure)",
    "offer_procedure": r"(?i)^(offer procedure|offer structure|terms of the offer|general information document)",
    "legal_risk": r"(?i)^(risk factors|outstanding litigation|government and other approvals)",
}
QUOTAS = {"front_matter": 25, "general_information": 25, "management": 30, "business": 20, "financial": 15, "offer_procedure": 20, "legal_risk": 15}
MIN_LEAK = 5


def carry_section(blocks: DataFrame, strata: dict[str, str] = STRATA, first: str = "front_matter") -> DataFrame:
    """blocks with `stratum`: the last heading at or before a block."""
    line = F.btrim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    heading = F.when(F.lit(False), F.lit(""))
    for name, pattern in strata.items():
        heading = heading.when(line.rlike(pattern), F.lit(name))
    heading = F.when((F.length(line) > 3) & (F.length(line) < 120), heading)
    so_far = Window.partitionBy("doc_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("stratum", F.coalesce(F.last(heading, ignorenulls=True).over(so_far), F.lit(first)))


def stratified_sample(rows: DataFrame, stratum: str, quota: Column, key: str, text: str = "text", seed: int = 7, shortest: int = 40, longest: int = 600) -> DataFrame:
    """At most `quota` rows of each stratum, of a length in bounds, in the order of a hash."""
    fit = rows.where(F.length(F.btrim(F.col(text))).between(shortest, longest))
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key))
    return fit.withColumn("rank", rank).where(F.col("rank") <= quota).drop("rank")


def gold_spans(text: str, entities: list[list[str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, label, text) of annotated literals, each at its first free place."""
    taken: list[tuple[int, int]] = []
    out = []
    for label, literal in entities:
        places = (m.span() for m in re.finditer(literal_pattern(literal), text))
        free = next((p for p in places if all(p[1] <= a or b <= p[0] for a, b in taken)), None)
        if free is None:
            raise ValueError(f"the annotation {literal!r} isn't in its block")
        taken.append(free)
        out.append((*free, label, text[slice(*free)]))
    return out


def matched(predicted: Column, gold: Column, typed: bool = True, exact: bool = False) -> Column:
    """How many predicted spans pair off with gold ones: in order, each takes the first free."""

    def hit(p: Column, g: Column) -> Column:
        where = (p.start == g.start) & (p.end == g.end) if exact else S.overlaps(p, g)
        return where & (p.label == g.label) if typed else where

    def step(used: Column, p: Column) -> Column:
        free = F.filter(F.transform(gold, lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda x: hit(p, x.g) & ~F.array_contains(used, x.i))
        return F.when(F.size(free) > 0, F.concat(used, F.array(F.get(free, F.lit(0)).i))).otherwise(used)

    return F.size(F.aggregate(predicted, F.array().cast("array<int>"), step))


def counts(rows: DataFrame, typed: bool = True, exact: bool = False) -> DataFrame:
    """rows (predicted, gold) with tp, fp, fn."""
    out = rows.withColumn("tp", matched(F.col("predicted"), F.col("gold"), typed, exact))
    return out.withColumn("fp", F.size("predicted") - F.col("tp")).withColumn("fn", F.size("gold") - F.col("tp"))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1; 1 where there is nothing to find, 0 where both are 0."""
    precision = F.when(tp + fp > 0, tp / F.nullif(tp + fp, F.lit(0))).otherwise(F.lit(1.0))
    recall = F.when(tp + fn > 0, tp / F.nullif(tp + fn, F.lit(0))).otherwise(F.lit(1.0))
    both = precision + recall
    f1 = F.when(both > 0, 2 * precision * recall / F.nullif(both, F.lit(0.0))).otherwise(F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def by_label(rows: DataFrame) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of rows (predicted, gold); label null is the total."""
    labels = rows.select("predicted", "gold", F.explode(F.array_distinct(F.concat(F.transform("predicted", lambda s: s.label), F.transform("gold", lambda s: s.label)))).alias("label"))
    own = lambda c: F.filter(c, lambda s: s.label == F.col("label"))
    each = counts(labels.withColumn("predicted", own("predicted")).withColumn("gold", own("gold")))
    total = each.rollup("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return total.select("label", "tp", "fp", "fn", *[F.round(v, 4).alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def token_accuracy(rows: DataFrame) -> DataFrame:
    """rows (text, predicted, gold) with `correct` and `total` tokens by redacted or not. Only the
    numbers of the tokens that spans touch are listed, so a text of any length takes linear time."""
    text = F.col("text")
    count = lambda x: F.regexp_count(x, F.lit(r"(?U)\S+"))

    def touched(s: Column) -> Column:
        inside = (s.start > 0) & text.substr(s.start, F.lit(2)).rlike(r"(?U)^\S\S")
        first = count(text.substr(F.lit(1), s.start)) + F.when(inside, 0).otherwise(1)
        last = count(text.substr(F.lit(1), s.end))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    tokens = lambda spans: F.array_distinct(F.flatten(F.transform(spans, touched)))
    out = rows.withColumn("total", count(text)).withColumn("__p", tokens(F.col("predicted"))).withColumn("__g", tokens(F.col("gold")))
    wrong = F.size(F.array_except("__p", "__g")) + F.size(F.array_except("__g", "__p"))
    return out.withColumn("correct", F.col("total") - wrong).drop("__p", "__g")


def unmatched(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Spans of the array `left` that overlap none of `right`: misses (gold, predicted) or
    spurious ones (predicted, gold)."""
    alone = F.filter(left, lambda a: ~F.exists(right, lambda b: S.overlaps(a, b)))
    return rows.select("doc_id", F.explode(alone).alias("s")).select("doc_id", "s.label", "s.start", "s.end", F.substring("s.text", 1, 90).alias("text"))


def document_text(blocks: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, body): the blocks of a document in order."""
    lines = F.array_sort(F.collect_list(F.struct("block_id", text)))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x[text]), "\n").alias("body"))


def leaks(mapping: DataFrame, redacted: DataFrame, text: str = "redacted") -> DataFrame:
    """(doc_id, label, original, occurrences) of replaced values that are still in a document's
    output. Values meet their own document's blocks only: an equi-join on doc_id, and the
    literal is searched with its blanks as any white space, inside each block."""
    values = mapping.where(F.length("original") >= MIN_LEAK).select("doc_id", "label", "original")
    quoted = F.regexp_replace("original", r"([\\\.\[\]\{\}\(\)\*\+\-\?\^\$\|\/&#~])", r"\\$1")
    pattern = F.regexp_replace(quoted, " ", r"\\s+")
    both = values.withColumn("pattern", F.concat(F.lit("(?U)"), pattern)).join(redacted.select("doc_id", F.col(text).alias("out")), "doc_id")
    # a cheap test first: the value's first word must be there at all
    maybe = both.where(F.col("out").contains(F.split("original", " ")[0]))
    hits = maybe.withColumn("n", F.regexp_count("out", F.col("pattern")))
    return hits.where("n > 0").groupBy("doc_id", "label", "original").agg(F.sum("n").alias("occurrences"))


def leak_summary(mapping: DataFrame, found: DataFrame) -> DataFrame:
    """One row: values_checked, values_still_present, residual_rate."""
    checked = mapping.where(F.length("original") >= MIN_LEAK).agg(F.count("*").alias("values_checked"))
    both = checked.crossJoin(found.agg(F.count("*").alias("values_still_present")))  # two single rows
    rate = F.when(F.col("values_checked") > 0, F.round(F.col("values_still_present") / F.col("values_checked"), 4)).otherwise(F.lit(0.0))
    return both.withColumn("residual_rate", rate)


def squash(text: Column) -> Column:
    """Letters and digits alone, for text that recognition may have spaced otherwise."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def image_leaks(mapping: DataFrame, recovered: DataFrame) -> DataFrame:
    """(doc_id, name, label, original): replaced values found in the text recovered from output
    pictures (doc_id, name, text)."""
    values = mapping.withColumn("squashed", squash(F.col("original"))).where(F.length("squashed") >= MIN_LEAK)
    both = values.join(recovered.select("doc_id", "name", squash(F.col("text")).alias("out")), "doc_id")
    return both.where(F.col("out").contains(F.col("squashed"))).select("doc_id", "name", "label", "original")


def reidentification(terms: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(severity, anchor, term, hits) with subtotals (rollup) of whole-word, case-insensitive
    counts. terms (severity, anchor, term) is a hand-made list."""
    listed = terms.select("severity", "anchor", "term").distinct().orderBy("severity", "anchor", "term").collect()
    if not listed:
        return terms.select("severity", "anchor", "term", F.lit(0).cast("long").alias("hits")).limit(0)
    # one pass over the texts counts every term
    counted = texts.agg(*[F.sum(F.regexp_count(text, F.lit(rf"(?iU)\b{literal_pattern(r.term)}\b"))).alias(f"n{k}") for k, r in enumerate(listed)])
    rows = [F.struct(*[F.lit(r[c]).alias(c) for c in ("severity", "anchor", "term")], F.coalesce(f"n{k}", F.lit(0)).alias("hits")) for k, r in enumerate(listed)]
    each = counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return each.rollup("severity", "anchor", "term").agg(F.sum("hits").alias("hits"))


def blocking(report: DataFrame) -> DataFrame:
    """One row: how many critical and high anchors survive."""
    one = report.where(F.col("term").isNotNull() & F.col("severity").isin("CRITICAL", "HIGH"))
    return one.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("blocking"))


def samples(audit: DataFrame, per_label: int = 4, cut: int = 70) -> DataFrame:
    """The first detections of each label and document."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("block", "start"))
    out = audit.withColumn("rank", rank).where(F.col("rank") <= per_label)
    return out.select("doc_id", "label", "rank", *[F.substring(c, 1, cut).alias(c) for c in ("original", "replacement")])


def preview(blocks: DataFrame, n: int = 40, cut: int = 600) -> DataFrame:
    """The first n blocks of each document that aren't blank, cut, with their total number."""
    full = blocks.where(F.btrim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")
    per = Window.partitionBy("doc_id")
    ranked = full.withColumn("rank", F.row_number().over(per.orderBy("block_id"))).withColumn("total", F.count("*").over(per))
    return ranked.where(F.col("rank") <= n).select("doc_id", "rank", F.substring("text", 1, cut).alias("text"), "total", (F.col("total") > n).alias("truncated"))


def before_after(before: DataFrame, after: DataFrame, n: int = 8) -> DataFrame:
    """Pictures (doc_id, name, content) paired by name, at most n a document."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))
    first = before.withColumn("rank", rank).where(F.col("rank") <= n)
    return first.join(after.withColumnRenamed("content", "after"), ["doc_id", "name"], "left").drop("rank").withColumnRenamed("content", "before")
