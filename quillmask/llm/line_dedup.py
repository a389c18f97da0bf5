"""Line dedup over levelled sorted runs of line hashes.

The state is an LSM tree: every batch of documents counts its distinct line keys, drops
by a merge anti-join the keys that one of the runs already shows at the threshold, and
adds the rest as a new run on level 0. When a level holds `fanout` runs they are
compacted: their counts are added up into one run on the next level. Runs are tables
bucketed and sorted by the hash, in the shared folder, so merges and anti-joins read
them in order without shuffling them again. A key's count is the sum over the runs.

Lines of keys at the threshold are then dropped everywhere. Counts are combined before
the shuffle, and the set of frequent keys is broadcast only if it was counted and is
small; else the join is a sort-merge join, whose skewed partitions AQE splits.

Defined cases: a null or empty text is one empty line; every row is a document of its
own; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 4


@dataclass
class LineRuns:
    """Counts of line keys as runs (h1, h2, n) on levels; level 0 is the newest."""

    spark: SparkSession
    buckets: int
    min_docs: int = MIN_DOCS
    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=lambda: [[]])

    def _write(self, counts: DataFrame) -> DataFrame:
        return C.settle_bucketed(counts.select("h1", "h2", "n"), "line_run", self.buckets, "h1")

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (h1, h2, n)."""
        for run in (r for level in self.levels for r in level):
            full = run.where(F.col("n") >= self.min_docs).select("h1", "h2")
            counts = counts.join(full.hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(counts))
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._sum(level)))
                self.levels[k] = []
                C.free_shuffles(self.spark)

    @staticmethod
    def _sum(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """The keys in at least min_docs documents."""
        runs = [r for level in self.levels for r in level]
        return self._sum(runs).where(F.col("n") >= self.min_docs).select("h1", "h2")


def _key_counts(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    lines = F.split(F.coalesce(docs[text], F.lit("")), "\n", -1)
    keys = F.array_distinct(F.transform(lines, C.line_key))
    return (
        docs.select(F.explode(F.filter(keys, lambda k: F.length(k) >= min_chars)).alias("k"))
        .select(*C.key_hash(F.col("k")))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"))
    )


def build_runs(
    docs: DataFrame, text: str = "text", by: Column | None = None, batches: int = BATCHES, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> LineRuns:
    """Feed docs to fresh runs in `batches` batches of whole documents, dealt by a hash of `by`."""
    C.bounded_memory(docs.sparkSession)
    spark = docs.sparkSession
    runs = LineRuns(spark, C.parallel_width(spark), min_docs)
    deal = F.pmod(F.xxhash64(by if by is not None else docs[text]), F.lit(batches))
    for b in range(batches):
        runs.add(_key_counts(docs.where(deal == b), text, min_chars))
    return runs


def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the lines of frequent keys: struct `row` (docs without the text),
    `kept` (the lines that stay, joined), n_lines, n_dropped."""
    f = C.checked_broadcast(frequent).withColumn("hot", F.lit(True))
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"),
        F.split(F.coalesce(docs[text], F.lit("")), "\n", -1).alias("ls"),
    )
    lines = base.select("rid", "row", F.posexplode("ls").alias("pos", "line")).withColumn("row", F.when(F.col("pos") == 0, F.col("row")))
    keyed = lines.withColumn("k", C.line_key(F.col("line")))
    enough = F.length("k") >= min_chars
    keyed = keyed.select("rid", "row", "pos", "line", *[F.when(enough, h).alias(n) for h, n in zip(C.key_hash(F.col("k")), ("h1", "h2"))])
    marked = keyed.join(f, ["h1", "h2"], "left").select("rid", "row", "pos", F.when(F.col("hot").isNull(), F.col("line")).alias("line"))
    return (
        marked.groupBy("rid")
        .agg(
            F.first("row", ignorenulls=True).alias("row"),
            F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))).alias("left"),
            F.count("*").alias("n_lines"),
        )
        .select(
            "row",
            F.array_join(F.transform("left", lambda x: x.line), "\n").alias("kept"),
            "n_lines",
            (F.col("n_lines") - F.size("left")).alias("n_dropped"),
        )
    )


def dedup(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """Drop, from every document, the lines whose key is in at least min_docs documents."""
    runs = build_runs(docs, text, None, batches, min_docs, min_chars)
    frequent = C.settle(runs.frequent(), "frequent-lines")
    C.free_shuffles(docs.sparkSession)
    return drop_lines(docs, frequent, text, min_chars)


def deduped(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """docs with the kept lines as their text."""
    out = dedup(docs, text, **limits)
    return out.select(*[(F.col("kept") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
