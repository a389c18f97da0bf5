"""What the operators of this folder share: scratch tables in the cluster's shared
folder, checked broadcasts, and the text conventions of the contracts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java character class.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"

#: A side of a join is broadcast only after it was measured: at most so many rows, and so many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

#: Bytes of rows that go to a Python worker at once, at most.
ARROW_BYTES = 8 << 20

_own_dir: str | None = None
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where that is unset and
    everything runs on this machine (tests) a folder of our own is made."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="quillmask-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(jpath)
    return path


@contextmanager
def passing(spark: SparkSession, keep: Callable[[], DataFrame | None] = lambda: None):
    """Scratch made inside is deleted at the end, but for the settled table that keep() names."""
    _scopes.append([])
    try:
        yield
    finally:
        kept = getattr(keep(), "_settled_at", None)
        for path in _scopes.pop():
            if path != kept:
                discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, and a lost
    executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled._settled_at = path
    return settled


def forget(*settled: DataFrame) -> None:
    """Delete the files of settled tables that nothing will read again."""
    for df in settled:
        discard(df.sparkSession, df._settled_at)


def settle_bucketed(df: DataFrame, tag: str, buckets: int, key: str) -> DataFrame:
    """Like settle(), hashed into buckets by `key`, so that later joins and groupings
    on it need no exchange of this side."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("compression", "zstd")
        .option("path", scratch(spark, tag))
        .saveAsTable(name)
    )
    df = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files and the plan stay, no catalog fills up
    return df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that are over."""
    gc.collect()
    spark._jvm.System.gc()


def numbered(df: DataFrame, tag: str) -> DataFrame:
    """(rid, doc): the rows of df as structs, each with a number, settled. A number that a scan gives
    holds for that scan alone (how files are dealt to tasks depends on the cores connected), so
    whoever joins by it must read number and row from here."""
    row = F.struct(*[df[c] for c in df.columns]).alias("doc")
    return settle(df.select(F.monotonically_increasing_id().alias("rid"), row), tag)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether `df` (already settled) has at most so many rows and bytes."""
    text = [F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    n, *texts = df.limit(rows + 1).agg(F.count(F.lit(1)), *text).first()
    return n <= rows and 8 * n * len(df.columns) + sum(texts) <= size


def checked_broadcast(df: DataFrame) -> DataFrame:
    """`df` (already settled) with a broadcast hint if it fits."""
    return F.broadcast(df) if fits(df) else df


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The maximal runs without ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WS_CHARS)))


def key_hash(key: Column) -> list[Column]:
    """128 bits of a string as two longs from differently seeded hashes."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7919), key).alias("h2")]


def parallel_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_memory(spark: SparkSession) -> None:
    """Settings of this session that keep memory outside the heap bounded: Parquet is read without
    vectored reads, which hold whole column chunks in buffers of their threads, and Arrow batches
    have at most ARROW_BYTES, however long the texts are."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not re.fullmatch(r"\d+b?", now) or int(now.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
