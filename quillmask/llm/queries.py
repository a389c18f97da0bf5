"""The thin contract queries of this folder's operators, and SQL for those that have one."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import bpe, line_dedup, mixing, quality_model, quality_rules, simhash, suffix_dedup, token_files, topk, warc

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _sha(text):
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query("op2_mix_sources")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(C.documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


@query(
    "op4_line_dedup",
    """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.rid, k.line, k.pos, h.key IS NOT NULL AS gone FROM k LEFT JOIN hot h ON k.key = h.key)
SELECT d.doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d JOIN m ON d.rid = m.rid GROUP BY d.rid, d.doc_id""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(C.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), _sha(F.col("kept")).alias("kept_sha256"))


@query(
    "op10_quality_rules",
    r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
dupwin AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM dupwin) GROUP BY rid),
l AS (SELECT rid, host, translate(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
             len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n FROM (SELECT rid, host, unnest(ls) AS x FROM w)),
hot AS (SELECT host, key FROM (SELECT l.host, l.key, d.text FROM l JOIN d ON l.rid = d.rid) GROUP BY host, key HAVING count(DISTINCT text) >= 10),
hit AS (SELECT l.rid, sum(l.n) AS n FROM l JOIN hot ON l.key = hot.key AND l.host IS NOT DISTINCT FROM hot.host GROUP BY l.rid),
s AS (SELECT w.rid, w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(hit.n, 0) AS BIGINT) AS n_frequent
      FROM w LEFT JOIN rep ON w.rid = rep.rid LEFT JOIN hit ON w.rid = hit.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_frequent) >= 30 * n_words) AS kept
FROM s""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality_rules.verdicts(C.documents(spark, sf_dir).select("doc_id", "source", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent")
    return v.select("row.doc_id", *[F.col(n).cast("long").alias(n) for n in names], "base_failed", "kept")


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(C.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(C.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _digests(batches):
    for b in batches:
        ids = b.column("ids")
        values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        lists = [values[x:y].tolist() for x, y in zip(ends[:-1], ends[1:])]
        cols = [
            pa.array([r["doc_id"] for r in b.column("row").to_pylist()], pa.int64()),
            pa.array([len(x) for x in lists], pa.int64()),
            pa.array([digest(",".join(map(str, x))) for x in lists]),
            pa.array([digest(t.as_py()) for t in b.column("decoded")]),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@query("op6_bpe_round_trip")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encoded(docs, BYTE_BPE, decode=True, then=_digests, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.scratch(spark, "token-files")
    manifest = token_files.write_shards(C.documents(spark, sf_dir), folder, WORD_BPE, END_ID)
    return token_files.read_shards(manifest).withColumnRenamed("key", "doc_id")


@query(
    "op5_warc_bundles",
    """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT rid, page_id, CAST(octet_length(b) AS BIGINT) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM h
      WINDOW w AS (PARTITION BY d, n >= 100 ORDER BY page_id NULLS LAST, rid))
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND k > 1 THEN first END AS refers_to FROM r""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), C.scratch(spark, "warc"))
    return warc.read(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op7_exact_top_k",
    """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, b.rid AS brid,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
      FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, brid) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def _held_out(key):
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


@query("op9_quality_model")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    scored = quality_model.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _held_out(F.col("key")))
    return scored.select(
        "row.doc_id", _held_out(F.col("row.doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
