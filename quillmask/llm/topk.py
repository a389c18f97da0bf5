"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Components become integers floor(SCALE * x). Candidates are packed into blocks, each an
inverted index: a posting list for every component, with the rows and weights that aren't
zero. Queries are sparse rows, dealt into blocks by a hash. Every block of queries meets
every block of candidates: for one component after the other, the weights that queries
have there are scattered over the component's postings into dense score arrays, the best
k of the block are selected by partition, and the blocks' winners are merged: by a task for
the blocks that it reads, so it gives at most k rows a query, then by a ranked window.

Candidates stay where they are. Blocks of queries are broadcast in turn, as many at a time
as fit BROADCAST_BYTES, and a turn's queries meet all candidates, so its result is final
and is written. Blocks are cut by the vectors' length, so a pair of blocks is a bounded
piece of work of its own.

Defined cases: vectors that are null or hold null, NaN or infinite components, and rows
without an id, take no part; vectors of different lengths are compared over the
components that both have; an empty vector scores 0; rows of equal id are separate rows,
and a query leaves out its own row only; further columns are ignored; scores beyond 63 bits
are not supported; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SCALE = 64
K = 20
#: Rows of a block of candidates and of queries, at most, and entries that a block may have.
BLOCK = 1024
QUERY_BLOCK = 4096
ENTRIES = 1 << 21
#: Queries that are scored at once against a block: their scores and a term's products lie in the cache.
ROWS = 256
#: Blocks whose winners a task holds before it merges them.
HELD = 8


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, rid, q): the vectors that take part, as integers."""
    x = vectors[vector]
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.select(vectors[key].cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), x.cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    return rows.select("id", "rid", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q"))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers, as few bytes each as they need."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _pack(size: int, by_component: bool):
    """Rows (block, id, rid, q) to packed blocks of at most `size` rows of the same `block`: lists of
    the entries that aren't zero, one a component (of rows) or one a row (of components)."""

    def packed(block, rows):
        ids = np.concatenate([r[0] for r in rows])
        rids = np.concatenate([r[1] for r in rows])
        dim = max(r[2].shape[1] for r in rows)
        m = np.concatenate([np.pad(r[2], ((0, 0), (0, dim - r[2].shape[1]))) for r in rows])
        order = np.lexsort((rids, ids))  # ties go to the smaller id, which then comes first
        m = m[order].T if by_component else m[order]
        of, at = np.nonzero(m)
        heads = np.searchsorted(of, np.arange(len(m) + 1))
        weights = _narrow(m[of, at])
        cols = [pa.array([x], pa.int32()) for x in (block, dim, weights.dtype.itemsize)]
        cols += [pa.array([x.tobytes()], pa.binary()) for x in (ids[order], rids[order], heads.astype(np.int32), at.astype(np.int32), weights)]
        return pa.RecordBatch.from_arrays(cols, ["block", *NAMES])

    def run(batches):
        open_: dict[int, list] = {}
        count: dict[int, int] = {}
        for b in batches:
            block, ids, rids = (b.column(k).to_numpy() for k in range(3))
            lists = b.column(3)
            lens = np.diff(lists.offsets.to_numpy())
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            dim = int(lens.max(initial=0))
            m = np.zeros((b.num_rows, dim), np.int64)
            if dim:
                m[np.arange(dim) < lens[:, None]] = values[ends[0] : ends[-1]]
            for k in np.unique(block):
                at = np.flatnonzero(block == k)
                while len(at):
                    have = count.get(k, 0)
                    now, at = at[: size - have], at[size - have :]
                    open_.setdefault(k, []).append((ids[now], rids[now], m[now]))
                    count[k] = have + len(now)
                    if count[k] >= size:
                        yield packed(k, open_.pop(k))
                        count.pop(k)
        for k, rows in open_.items():
            yield packed(k, rows)

    return run


NAMES = ("dim", "width", "ids", "rids", "heads", "at", "weights")
PACKED = "block int, dim int, width int, ids binary, rids binary, heads binary, at binary, weights binary"


class Block:
    """A packed block: list t of entries is (at, weights)[heads[t]:heads[t + 1]]."""

    def __init__(self, dim: int, width: int, ids: bytes, rids: bytes, heads: bytes, at: bytes, weights: bytes):
        self.dim = dim
        self.ids, self.rids = np.frombuffer(ids, np.int64), np.frombuffer(rids, np.int64)
        self.heads, self.at = np.frombuffer(heads, np.int32), np.frombuffer(at, np.int32)
        self.weights = np.frombuffer(weights, f"<i{width}")
        self.top = int(np.abs(self.weights.astype(np.int64)).max(initial=0))

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """Rows lo:hi of a block by rows, as columns of a dense array."""
        hi = min(hi, len(self.ids))
        out = np.zeros((self.dim, hi - lo), np.int64)
        a, b = self.heads[lo], self.heads[hi]
        out[self.at[a:b], np.repeat(np.arange(hi - lo), np.diff(self.heads[lo : hi + 1]))] = self.weights[a:b]
        return out


def accumulate(queries: np.ndarray, candidates: Block) -> np.ndarray:
    """Scores (candidates, queries) of queries, the columns of an array, one component after the
    other: the weights that queries have there are scattered over its postings, if any has one. A
    list of all rows is taken as a slice."""
    dim, n = min(len(queries), candidates.dim), len(candidates.ids)
    kind = np.int32 if float(np.abs(queries).max(initial=0)) * candidates.top * max(1, dim) < 2**31 else np.int64
    queries = queries.astype(kind)
    scores = np.zeros((n, queries.shape[1]), kind)
    spare = np.empty_like(scores)
    for t in range(dim):
        a, b = candidates.heads[t], candidates.heads[t + 1]
        if a == b or not queries[t].any():
            continue
        weights = candidates.weights[a:b].astype(kind)
        postings = candidates.at[a:b] if b - a < n else slice(None)
        scores[postings] += np.multiply.outer(weights, queries[t], out=spare[: b - a])
    return scores


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, ties to the smaller column; the
    columns own (-1: none) don't count."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) < 1 << 46:
        key = scores.astype(np.int64) * (1 << 16) - np.arange(n)
    else:
        key = np.argsort(np.lexsort((-np.arange(n)[None, :].repeat(len(scores), 0), scores), axis=1), axis=1)
    low = np.iinfo(np.int64).min
    rows = np.flatnonzero(own >= 0)
    key[rows, own[rows]] = low
    best = np.argpartition(key, n - min(k, n), axis=1)[:, n - min(k, n) :]
    row = np.repeat(np.arange(len(scores)), best.shape[1])
    column = best.ravel()
    keep = key[row, column] != low
    return row[keep], column[keep]


class Winners:
    """The best k of each query of a block, merged from the winners of many candidate blocks."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, k: int):
        self.ids, self.rids, self.k = ids, rids, k
        self.parts: list[tuple[np.ndarray, ...]] = []  # query row, score, id, rid

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        if len(self.parts) > HELD * -(-len(self.ids) // ROWS):
            self.merge()

    def merge(self) -> None:
        row, score, ids, rids = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((rids, ids, -score, row))
        row = row[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate((first, [len(row)]))))
        best = order[rank < self.k]
        self.parts = [tuple(np.concatenate(c)[best] for c in zip(*self.parts))]

    def batch(self) -> pa.RecordBatch:
        self.merge()
        row, score, ids, rids = self.parts[0]
        cols = (self.ids[row], self.rids[row], ids, rids, score)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["query_id", "query_rid", "vec_id", "vec_rid", "score"])


def _score(k: int):
    """Rows (packed candidates, packed queries) to the best k candidates of each query."""

    def run(batches):
        width = len(NAMES)
        held: dict[tuple[int, int], Winners] = {}  # by what tells a block of queries: its first row and its length
        for b in batches:
            for i in range(b.num_rows):
                c, q = (Block(*(b.column(j)[i].as_py() for j in range(s, s + width))) for s in (0, width))
                winners = held.setdefault((int(q.rids[0]), len(q.rids)), Winners(q.ids, q.rids, k))
                by_rid = np.argsort(c.rids)
                for lo in range(0, len(q.ids), ROWS):
                    rids = q.rids[lo : lo + ROWS]
                    at = np.minimum(np.searchsorted(c.rids, rids, sorter=by_rid), len(by_rid) - 1)
                    own = np.where(c.rids[by_rid[at]] == rids, by_rid[at], -1)
                    scores = np.ascontiguousarray(accumulate(q.rows(lo, lo + ROWS), c).T)
                    row, column = select(scores, own, k)
                    winners.add(lo + row, scores[row, column].astype(np.int64), c.ids[column], c.rids[column])
        for winners in held.values():
            yield winners.batch()

    return run


def top_k(vectors: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors for which the condition
    `queries` on the column `id` holds, its k best other rows."""
    spark = vectors.sparkSession
    C.bounded_memory(spark)
    rows = C.settle(quantised(vectors, key, vector, scale), "topk-vectors")
    asked = rows.where(queries)
    longest, n_asked = rows.agg(F.max(F.size("q")), F.count_if(queries)).first()
    room = max(ROWS, ENTRIES // max(1, longest or 0))
    block = min(QUERY_BLOCK, room)
    n_blocks = max(1, -(-n_asked // block))
    deal = F.pmod(F.xxhash64("rid"), F.lit(n_blocks)).cast("int").alias("block")
    dealt = asked.select(deal, "id", "rid", "q").repartition(min(n_blocks, C.parallel_width(spark)), "block")
    query_blocks = C.settle(dealt.mapInArrow(_pack(2 * block, False), PACKED), "topk-queries")
    whole = rows.select(F.lit(0).alias("block"), "id", "rid", "q").mapInArrow(_pack(min(BLOCK, room), True), PACKED).drop("block")
    # a block's bytes: 16 a row, 4 a head, at most 12 an entry
    per_turn = max(1, C.BROADCAST_BYTES // (2 * (16 * block + 12 * block * max(1, longest or 0))))
    if n_blocks > per_turn:
        whole = C.settle(whole, "topk-candidates")
    right = query_blocks.select("block", *[F.col(c).alias("q_" + c) for c in NAMES])
    order = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "vec_rid")

    def turn(lo: int, hi: int) -> DataFrame:
        grid = whole.withColumn("block", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        pairs = grid.join(F.broadcast(right.where(F.col("block").between(lo, hi - 1))), "block")
        found = pairs.select(*NAMES, *["q_" + c for c in NAMES]).mapInArrow(_score(k), "query_id long, query_rid long, vec_id long, vec_rid long, score long")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if n_blocks <= per_turn:
        return turn(0, n_blocks)
    turns = [C.settle(turn(lo, min(lo + per_turn, n_blocks)), "topk-turn") for lo in range(0, n_blocks, per_turn)]
    return spark.read.schema(turns[0].schema).parquet(*[t._settled_at for t in turns])
