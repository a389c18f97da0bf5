"""SimHash near-dedup by deletion-variant signatures.

A fingerprint's 64 bits are cut into two segments, fewer than the usual three for two
differing bits, because the index allows one differing bit in a segment: of two segments
that together differ in at most two bits, one differs in at most one. The upper segment is
indexed under its 32 variants with one bit left out, and both are indexed as they are.
Where each segment differs in one bit, the upper one's variants are equal; where all the
difference is in one segment, the other one is equal as it is, so the lower one needs no
variants. Equal keys are joined and verified on the whole fingerprints.

Only distinct fingerprints are indexed, so a group of copies costs one. A bucket of two
gives its pair from min and max of one grouped aggregation, without gathering it. Fuller
buckets, of which a large corpus has many by chance, are split by further bits: members
that differ in the variant's bit differ in at most one of the lower segment and agree on
one of its halves; members of one whole segment agree on one of the other's thirds. They
are bucketed again by those. What is still in buckets of more than two then shares 42 bits
or more and is truly crowded, as the near copies of one text are: these few fingerprints
are listed under themselves and their 64 variants with one bit turned, since two of them
differ in at most two bits if and only if they share such a variant, and each list is
linked to its least member. So every link is found whatever the size of the buckets, and
no bucket is gathered or paired up.

Defined cases: a text without words (null included) has fingerprint zero and is linked
like any other; every row is a document of its own, equal ids included; a null id never
names a component unless all its ids are null; very long texts are hashed in one task,
their hashes counted in blocks; further columns, whatever their names, are kept in `row`;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

WORDS = 3
SEED = 42
#: Hashes turned into bits at once.
BLOCK = 1 << 16

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def shingle_hashes(text: bytes, n_words: int = WORDS) -> list[int]:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    words = text.translate(_LOWER).split()  # bytes.split() is at [\x20\x09-\x0D]+
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n_words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate(([0], ends[:-1]))[: len(words) - n_words + 1]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(begins.tolist(), (ends[n_words - 1 :] - 1).tolist())]


def fingerprint(text: bytes, n_words: int = WORDS) -> int:
    hashes = shingle_hashes(text, n_words)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        block = np.array(hashes[k : k + BLOCK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(n_words: int):
    def run(batches):
        for b in batches:
            texts = b.column(1)
            out = np.fromiter((fingerprint(t.as_py() or b"", n_words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["row", "fp"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", n_words: int = WORDS) -> DataFrame:
    """Struct `row` (docs without the text) and `fp`, the fingerprint as a signed long."""
    C.bounded_memory(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), F.encode(docs[text], "UTF-8").alias("body"))
    schema = rows.select("row", F.lit(0).cast("long").alias("fp")).schema
    return rows.mapInArrow(_fingerprints(n_words), schema)


#: Kinds of keys: 0 to 31 are variants of the upper segment, then both segments as they are.
UPPER, LOWER = 32, 33
LOW32 = (1 << 32) - 1


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the segments of fp that it is found by, under their kind."""
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW32))
    keys = [upper.bitwiseAND(F.lit(LOW32 - (1 << b))).bitwiseOR(F.lit(b << 32)) for b in range(32)]
    keys += [upper.bitwiseOR(F.lit(UPPER << 32)), lower.bitwiseOR(F.lit(LOWER << 32))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _ends(rows: DataFrame, *keys: str) -> DataFrame:
    """The least and largest fingerprint of each bucket that has several, and how many it has."""
    return rows.groupBy(*keys).agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1")


def _parts(rows: DataFrame) -> DataFrame:
    """(key, part, fp): members of full buckets by halves or thirds of what `key` doesn't show."""

    def cut(segment, *pieces):
        return F.array(*[segment.bitwiseAND(F.lit(((1 << n) - 1) << at)).bitwiseOR(F.lit(k << 32)) for k, (at, n) in enumerate(pieces)])

    kind, upper, lower = F.shiftrightunsigned("key", 32), F.shiftrightunsigned("fp", 32), F.col("fp")
    thirds = ((0, 11), (11, 11), (22, 10))
    parts = F.when(kind < UPPER, cut(lower, (0, 16), (16, 16))).when(kind == UPPER, cut(lower, *thirds)).otherwise(cut(upper, *thirds))
    return rows.select("key", F.explode(parts).alias("part"), "fp")


def _stars(fps: DataFrame) -> DataFrame:
    """Edges from the least of the fingerprints that share a variant with at most one bit turned."""
    turned = [F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)]
    rows = fps.select("fp", F.explode(F.array(F.col("fp"), *turned)).alias("m"))
    shared = rows.groupBy("m").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("m", "a")
    return rows.join(shared, "m").where("fp != a").select("a", F.col("fp").alias("b"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, with the same components as all
    pairs at two or fewer differing bits."""
    spark = fps.sparkSession
    # a fingerprint becomes many rows: spread the few there are first, so that no task makes most of them
    width = C.parallel_width(spark)
    near = (F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    rows = _variants(fps.repartition(width, "fp"))
    buckets = C.settle(_ends(rows, "key"), "simhash-buckets")
    C.free_shuffles(spark)
    full = C.checked_broadcast(buckets.where("n > 2").select("key"))
    inside = C.settle(rows.join(full, "key", "left_semi"), "simhash-inside")
    parts = _parts(inside)
    split = C.settle(_ends(parts, "key", "part"), "simhash-split")
    C.free_shuffles(spark)
    still = C.checked_broadcast(split.where("n > 2").select("key", "part"))
    crowded = C.settle(parts.join(still, ["key", "part"], "left_semi").select("fp").distinct(), "simhash-crowded")
    pairs = buckets.where(near).select("a", "b").unionByName(split.where(near).select("a", "b"))
    return pairs.unionByName(_stars(crowded.repartition(width, "fp"))).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n_words: int = WORDS) -> DataFrame:
    """Struct `row` (docs without the text), fp, root, which tells components apart whatever
    their ids, and component_id: the least `key` of the rows that links reach."""
    prints = C.settle(fingerprints(docs, text, n_words), "simhash-prints")
    C.free_shuffles(docs.sparkSession)
    # a fingerprint's least id; ids may be null, so rows are counted too
    distinct = C.settle(prints.groupBy("fp").agg(F.min(F.col("row").getField(key)).alias("least")), "simhash-distinct")
    edges = C.settle(links(distinct.select("fp")), "simhash-links")
    C.free_shuffles(docs.sparkSession)
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints.join(names, "fp").select("row", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", n_words: int = WORDS) -> DataFrame:
    """docs with one document of each component: the one of least `key` (null comes last), of
    equal ones any, the others go."""
    rows = C.numbered(docs, "simhash-rows")
    parts = rows.select("rid", F.col("doc").getField(key).alias("key"), F.col("doc").getField(text).alias("body"))
    marked = near_duplicates(parts, "body", "key", n_words)
    first = F.min(F.struct(F.col("row.key").isNull(), F.col("row.key"), F.col("row.rid")))
    # the least of a component by id, without gathering it: combined before the shuffle
    best = marked.groupBy("root").agg(first.alias("x")).select(F.col("x.rid").alias("keep"))
    return rows.join(best, F.col("rid") == F.col("keep"), "left_semi").select("doc.*")
