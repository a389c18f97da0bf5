"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Two suffixes share a repeated window if they agree through WINDOW bytes, so suffixes need
an order only to that depth: passes refine groups of suffixes by longer and longer
digits, a group of one drops out, and what is equal through the last digit is repeated.
Four things keep the passes small enough for a corpus:

* A window belongs to the suffix at its minimiser, the least of its K-byte hashes. Equal
  windows have their minimisers at the same place, so it is enough to sort suffixes at
  minimisers (about 1.5 % of all), each with the run of windows that belong to it.
* First pass: the digit is the K bytes at the minimiser. Suffixes alone in their group
  are done. Of those that agree on the whole run (all bytes of its windows), all windows
  are repeated. Only a group with different runs goes on, one suffix of each run.
* Second pass: a run is cut at multiples of STEP into blocks of windows; the digit is the
  bytes common to all windows of the block. Again equal blocks and lonely ones are done.
* Third pass: the digit is the whole window.

Groups are counted by aggregations that combine before the shuffle; none is gathered in
a task, none is paired up. Digits are compared by 128 bits of two polynomial hashes. The
texts are settled once, bucketed by row, and are not shuffled again by any pass; all
tables lie in the shared folder.

Defined cases: a null text is empty; texts shorter than a window stay whole; every row is
a document of its own, equal ids included; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 200
K = 64
STEP = 8
#: Bytes that are hashed at once; bounds the memory of a task.
SLICE = 1 << 18
#: Bits of a packed minimiser that hold its place in the slice.
PLACE = 20
U = np.uint64


@cache
def _tables(seed: int, n: int):
    """Random values of the 256 bytes, powers of an odd base and of its inverse."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    base = int(rng.integers(0, 1 << 62)) * 4 + 5
    inverse = pow(base, -1, 1 << 64)

    def powers(b: int) -> np.ndarray:
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    return values, powers(base), powers(inverse)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Hasher:
    """Hashes of any substrings of a buffer, from prefix sums."""

    def __init__(self, buffer: np.ndarray, seed: int):
        n = len(buffer) + 1
        room = 1 << max(16, int(n).bit_length())
        values, up, down = _tables(seed, room)
        self.down = down
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values[buffer] * up[: n - 1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def all_of(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + U(k))


def runs_of(buffer: np.ndarray, offsets: np.ndarray):
    """Minimisers of a buffer of texts (texts i at offsets[i]:offsets[i + 1]): text,
    first window, number of windows, place of the minimiser, all but the text as places
    in the buffer; and a hasher."""
    first = Hasher(buffer, 1)
    n = len(buffer) - WINDOW + 1
    if n <= 0:
        return None
    packed = (first.all_of(K) & ~U((1 << PLACE) - 1)) | np.arange(len(buffer) - K + 1, dtype=np.uint64)
    span, reach = WINDOW - K + 1, 1
    low = packed
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: n], low[span - reach : span - reach + n])
    place = (low[:n] & U((1 << PLACE) - 1)).astype(np.int64)
    lens = np.diff(offsets)
    inside = np.zeros(len(buffer) + 1, np.int32)
    long = lens >= WINDOW
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, (offsets[1:] - WINDOW + 1)[long], -1)
    valid = np.cumsum(inside[:n]) > 0
    change = np.flatnonzero((place[1:] != place[:-1]) | (valid[1:] != valid[:-1])) + 1
    begin = np.concatenate(([0], change))
    end = np.concatenate((change, [n]))
    ok = valid[begin]
    begin, end = begin[ok], end[ok]
    text = np.searchsorted(offsets, begin, side="right") - 1
    return text, begin, end - begin, place[begin], first


def _slices(column, back: int = 0, ahead: int = WINDOW - 1):
    """A column of binary texts as buffers of about SLICE bytes. Longer texts come in pieces:
    a piece answers for window starts lo:hi and has `back` and `ahead` more bytes.
    Yields text, lo, hi, origin (of the piece in its text), buffer, offsets (of the pieces)."""

    def pieces():
        for i in range(len(column)):
            t = column[i].as_py() or b""
            for lo in range(0, max(1, len(t)), SLICE):
                hi, origin = lo + SLICE, max(0, lo - back)
                yield i, lo, hi, origin, t[origin : hi + ahead] if len(t) > SLICE else t

    def joined(group):
        offsets = np.zeros(len(group) + 1, np.int64)
        np.cumsum([len(g[4]) for g in group], out=offsets[1:])
        heads = np.array([g[:4] for g in group], np.int64).T
        return *heads, np.frombuffer(b"".join(g[4] for g in group), np.uint8), offsets

    group, size = [], 0
    for p in pieces():
        if group and size + len(p[4]) > SLICE:
            yield joined(group)
            group, size = [], 0
        group.append(p)
        size += len(p[4])
    if group:
        yield joined(group)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x)


def _minimisers(batches):
    """(rid, body) -> ROWS of the first pass: hashes of the K bytes and of the whole run."""
    for b in batches:
        rids = b.column(0).to_numpy()
        for item, _, _, origin, buffer, offsets in _slices(b.column(1)):
            found = runs_of(buffer, offsets)
            if found is None or not len(found[0]):
                continue
            piece, begin, n, place, h1 = found
            shift = origin[piece] - offsets[piece]
            run = _mix(Hasher(buffer, 2).of(begin, begin + n + WINDOW - 1) + (place - begin).astype(np.uint64))
            yield _rows(h1.of(place, place + K), run, rids[item[piece]], begin + shift, n, place + shift, np.zeros(len(n), np.int64))


def _rows(digit, run, rid, start, n, place, done) -> pa.RecordBatch:
    cols = [_signed(digit), _signed(run), pa.array(rid), *[pa.array(x.astype(np.int32)) for x in (start, n, place)], pa.array(done.astype(np.int8))]
    return pa.RecordBatch.from_arrays(cols, ["digit", "run", "rid", "start", "n", "place", "done"])


def _concat_ranges(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ..."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _open(batches):
    """Rows (rid, body, wanted) to buffers with the wanted suffixes as arrays: rid, first window,
    windows, place (both in the buffer), done, buffer, shift (from the buffer to the text)."""
    for b in batches:
        rids = b.column(0).to_numpy()
        wanted = b.column(2)
        for item, lo, hi, origin, buffer, offsets in _slices(b.column(1), 2 * WINDOW, 3 * WINDOW):
            rows = []
            for k, i in enumerate(item.tolist()):
                rows += [(k, w["start"], w["n"], w["place"], w["done"]) for w in wanted[i].as_py() if lo[k] <= w["start"] < hi[k]]
            if rows:
                a = np.array(rows, np.int64)
                shift = origin[a[:, 0]] - offsets[a[:, 0]]
                yield rids[item[a[:, 0]]], a[:, 1] - shift, a[:, 2], a[:, 3] - shift, a[:, 4], buffer, shift


def _blocks(batches):
    """Second pass: the wanted runs in blocks of windows at the same distances from the minimiser."""
    for rid, begin, n, place, done, buffer, shift in _open(batches):
        h1, h2 = Hasher(buffer, 1), Hasher(buffer, 2)
        far, near = place - begin, place - begin - n + 1  # of the first and the last window
        count = far // STEP - near // STEP + 1
        src = np.repeat(np.arange(len(rid)), count)
        block = near[src] // STEP + _concat_ranges(count)
        hi = np.minimum(far[src], block * STEP + STEP - 1)
        lo = np.maximum(near[src], block * STEP)
        core = place[src] - block * STEP
        digit = _mix(h1.of(core, core + WINDOW - STEP + 1) + block.astype(np.uint64))
        start = place[src] - hi
        run = _mix(h2.of(start, start + hi - lo + WINDOW) + (hi * 1024 + lo).astype(np.uint64))
        yield _rows(digit, run, rid[src], start + shift[src], hi - lo + 1, (place + shift)[src], done[src])


def _windows(batches):
    """Third pass: every window of the wanted blocks."""
    for rid, begin, n, place, done, buffer, shift in _open(batches):
        src = np.repeat(np.arange(len(rid)), n)
        start = begin[src] + _concat_ranges(n)
        digit, run = (Hasher(buffer, seed).of(start, start + WINDOW) for seed in (1, 2))
        yield _rows(digit, run, rid[src], start + shift[src], np.ones(len(src), np.int64), (place + shift)[src], done[src])


ROWS = "digit long, run long, rid long, start int, n int, place int, done byte"


def _refine(rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """One pass over suffixes (digit, run, rid, start, n, place, done). done: their windows
    are known to be repeated, they are here as partners of others. Returns the windows
    found repeated (rid, start, n), and one suffix of each run in groups with several
    runs, for the next pass."""
    spark = rows.sparkSession
    run = C.settle(
        rows.groupBy("digit", "run").agg(
            F.count("*").alias("times"), F.max("done").alias("done"), F.min(F.struct("rid", "start", "n", "place")).alias("one")
        ),
        tag + "-runs",
    )
    C.free_shuffles(spark)
    same = run.where("times > 1").select("digit", "run")  # in two places, be they done or not
    found = C.settle(rows.where("done = 0").join(same, ["digit", "run"], "left_semi").select("rid", "start", "n"), tag + "-found")
    C.free_shuffles(spark)
    groups = run.groupBy("digit").agg(F.count("*").alias("m")).where("m > 1").select("digit")
    done = F.when(F.col("times") > 1, F.lit(1)).otherwise(F.col("done")).cast("byte").alias("done")
    wanted = C.settle(run.join(groups, "digit", "left_semi").select("one.*", done), tag + "-wanted")
    C.forget(rows, run)
    C.free_shuffles(spark)
    return found, wanted


def _with_wanted(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, body, wanted) for the bodies with wanted suffixes."""
    w = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "place", "done")).alias("wanted"))
    return bodies.join(w, "rid").select("rid", "body", "wanted")


def _merged(spans) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows (start, n) cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["start"] + s["n"] + WINDOW - 1) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches):
    """(row, body, spans) -> (row, n_bytes, n_removed, n_spans, kept)."""
    for b in batches:
        figures, kept = [], []
        for i in range(b.num_rows):
            data, spans, at, left = b.column(1)[i].as_py() or b"", _merged(b.column(2)[i].as_py()), 0, []
            for x, y in spans:
                left.append(data[at:x])
                at = y
            kept.append(b"".join([*left, data[at:]]))
            figures.append((len(data), len(data) - len(kept[-1]), len(spans)))
        cols = [pa.array(c, pa.int64()) for c in (zip(*figures) if figures else ((), (), ()))]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Struct `row` (docs without the text), n_bytes, n_removed, n_spans, kept (binary): every
    text without the bytes covered by a WINDOW-byte string that also starts anywhere else."""
    spark = docs.sparkSession
    C.bounded_memory(spark)
    others = F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row")
    body = F.encode(F.coalesce(docs[text], F.lit("")), "UTF-8").alias("body")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), others, body)
    bodies = C.settle_bucketed(rows, "suffix_bodies", C.parallel_width(spark), "rid")
    C.free_shuffles(spark)
    plain = bodies.select("rid", "body")
    found, wanted = _refine(C.settle(plain.mapInArrow(_minimisers, ROWS), "suffix-minimisers"), "suffix-1")
    found2, wanted2 = _refine(C.settle(_with_wanted(plain, wanted).mapInArrow(_blocks, ROWS), "suffix-blocks"), "suffix-2")
    found3, _ = _refine(C.settle(_with_wanted(plain, wanted2).mapInArrow(_windows, ROWS), "suffix-windows"), "suffix-3")
    spans = found.unionByName(found2).unionByName(found3).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    cut = bodies.join(spans, "rid", "left").select("row", "body", "spans")
    schema = cut.select("row", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.col("body").alias("kept")).schema
    return cut.mapInArrow(_cut, schema)
