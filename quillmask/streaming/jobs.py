"""Structured Streaming: documents that arrive are redacted batch by batch, and the progress of
jobs is kept as state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.engine import Engine, release
from ..sources import docx

TTL_MS = 15 * 60 * 1000
STAGES = ("read", "learn", "detect", "images", "write", "verify")
JOB = "job_id string, stage string, fraction double, events int, status string"
_STATE = "stage string, fraction double, events int"


def redact_stream(blocks: DataFrame, engine: Engine, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start redacting a stream of blocks. A micro-batch holds whole documents (a file, or rows that
    arrive together); each gets its own lexicon. Results go to Parquet under `out`, a folder a
    batch, so a batch that is run again overwrites what it wrote before."""

    def one(batch: DataFrame, batch_id: int) -> None:
        tables = engine.run(batch)
        tables["redacted"].select("doc_id", "block_id", F.col("redacted").alias("text")).write.mode("overwrite").parquet(f"{out}/redacted/batch={batch_id}")
        tables["audit"].write.mode("overwrite").parquet(f"{out}/audit/batch={batch_id}")
        release(tables)

    return blocks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _landed(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("doc_id"), "content")


def landing(spark: SparkSession, path: str, max_bytes: int | None = docx.MAX_BYTES) -> DataFrame:
    """Blocks of the Word files that land in a folder, at most 25 MB each; refusals() has the others."""
    return docx.blocks(docx.valid(_landed(spark, path), max_bytes))


def refusals(spark: SparkSession, path: str, max_bytes: int | None = docx.MAX_BYTES) -> DataFrame:
    """(doc_id, reason) of the files that landing() doesn't take."""
    return docx.refused(_landed(spark, path), max_bytes)


def job_states(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """Progress of jobs from events (job_id, stage, fraction, ts): a row whenever a job moves on, and
    one of status 'expired' when nothing was heard of it for the time to live of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            stage, fraction, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], stage, fraction, n, "expired")], columns=["job_id", "stage", "fraction", "events", "status"])
            return
        stage, fraction, n = state.get if state.exists else (STAGES[0], 0.0, 0)
        latest = 0
        for pdf in batches:
            for row in pdf.sort_values("ts").itertuples():
                ahead = STAGES.index(row.stage) >= STAGES.index(stage) if row.stage in STAGES else True
                stage, fraction = (row.stage, float(row.fraction)) if ahead else (stage, fraction)
                n, latest = n + 1, max(latest, int(row.ts.timestamp() * 1000))
        state.update((stage, fraction, n))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_ms)
        status = "failed" if stage == "error" else "done" if stage == "done" else "running"
        yield pd.DataFrame([(key[0], stage, fraction, n, status)], columns=["job_id", "stage", "fraction", "events", "status"])

    marked = events.withWatermark("ts", "1 minute")
    return marked.groupBy("job_id").applyInPandasWithState(step, JOB, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def detections_per_window(audit: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of detections (label, ts) in tumbling windows of ingest time."""
    return audit.withWatermark("ts", late).groupBy(F.window("ts", every), "label").agg(F.count("*").alias("n"))
