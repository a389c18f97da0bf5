"""Token ids in binary shards with a minimal perfect hash index.

Documents are dealt by ranges of their key (and of their text's hash, where a key is hot),
so shards in order hold them in ascending key order; a task closes a shard at SHARD bytes
and goes on with the next. A shard is the raw ids (little-endian, two bytes each where the
vocabulary allows, else four), a directory (keys, which of them are null, ends of the
documents' ids) and an index: a minimal perfect hash of the distinct keys in levels of bit
maps, whose slots store a fingerprint of the key and where its ids lie. A bit map is in
cells of CELL bytes, each with the number of bits set before it, so a keyed read looks at
one cell a level, one slot, and the ids themselves, whatever the size of the shard; a key
that the shard hasn't is refused by its fingerprint. Whole shards are read in pieces.

A writer streams ids to a file of a fresh name and reports it; only reported files are in
the manifest, so a lost executor or a repeated task leaves no trace in the result.

Defined cases: null texts are empty, and an empty text still has the end id; a very long
text is in one shard, which may then be larger than SHARD; documents of equal key lie next
to each other (the keyed read gives the first), those of null key come first and are in no
index; further columns, whatever their names, are ignored; an empty table gives no shards
and an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .storage import open_file, write_file

MAGIC = b"QMIDS002"
#: A shard is closed at so many bytes of ids, or so many documents; it is read back in pieces of PIECE bytes.
SHARD = 256 << 20
SHARD_DOCS = 1 << 20
PIECE = 8 << 20
#: Bytes of a cell of a bit map, 8 of which are the count of bits set before it.
CELL = 64
BITS = 8 * (CELL - 8)
#: Slots of a level's bit map for each key that is left.
GAMMA = 2
#: Chunks that an encoder remembers from one batch to the next (some 300 MB), none longer than SHORT.
CACHE = 1_500_000
SHORT = 64
# magic, id width, levels, documents, ids, places of the directory, of the table of levels and of the slots
TAIL = struct.Struct("<8sIIQQQQQ")
LEVEL = struct.Struct("<QQ")  # bits of a level, place of its cells
SLOT = np.dtype([("print", "<u4"), ("n", "<u4"), ("at", "<u8")])
U = np.uint64


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) + U((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1. Level by level, keys that are alone at their bit
    stay there; the others go on to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bit maps, as bytes of 0 and 1
        before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x, dtype=np.int64) - x + b for x, b in zip(levels, before)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = -(-len(keys) * GAMMA // 8) * 8
            at = (_hash(keys, len(levels) + 1) % U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[at]]
        return cls(levels)

    def cells(self) -> list[bytes]:
        """The bit map of each level in cells."""
        out = []
        for bits, ranks in zip(self.levels, self.ranks):
            padded = np.zeros(-(-len(bits) // BITS) * BITS, np.uint8)
            padded[: len(bits)] = bits
            cells = np.empty((len(padded) // BITS, CELL), np.uint8)
            cells[:, 8:] = np.packbits(padded.reshape(-1, BITS), axis=1)
            cells[:, :8] = ranks[::BITS].astype("<u8").view(np.uint8).reshape(-1, 8)
            out.append(cells.tobytes())
        return out

    @classmethod
    def of_cells(cls, levels: list[tuple[int, bytes]]) -> PerfectHash:
        bits = [np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, CELL)[:, 8:], axis=1).ravel()[:n] for n, raw in levels]
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any slot, or -1, for keys that it wasn't built from."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_hash(keys[left], k + 1) % U(len(bits))).astype(np.int64)
            here = bits[at] == 1
            out[left[here]] = ranks[at[here]]
            left = left[~here]
        return out


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0) >> U(32)).astype(np.uint32)


class Encoder:
    """Ids of texts by the tokenizers library, with the end id, as bytes.

    The vocabulary drops white space, so a text's chunks between it are encoded alone, and
    a chunk met before needs no second look; nor does one that is a known word and a stop.
    That holds for the normaliser and split that are checked first, and chunks of printable ASCII and Latin-1 letters, which lower-case and
    compose alike everywhere; a text with any other chunk, with separators that only some
    take for white space, or that may hold a special token, goes to the library as a whole, and
    so do all texts of any other vocabulary."""

    OTHER = re.compile(r"[^!-~\xdf-\xff]")
    WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    # The vocabulary's normaliser and split that let chunks be encoded alone.
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MARK = chr(0xE000)  # stands between chunks; its first byte is in no chunk

    def __init__(self, path: str, end_id: int, width: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype(f"<u{width}")
        self.end = np.array([end_id], self.dtype).tobytes()
        spec = json.loads(self.library.to_str())
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.chunked = (spec["normalizer"] or {}).get("normalizers") == self.NORMALIZER and split.get("pattern") == {"Regex": self.SPLIT} and bool(split.get("invert"))
        self.mark = self._ids([self.MARK])[0] if self.chunked else []
        self.chunks: dict[str, bytes | None] = {}
        self.passing: list[str] = []  # longer chunks, which are forgotten after their batch

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Have the library encode chunks, many at a time."""
        for k in range(0, len(chunks), 2048):
            part = chunks[k : k + 2048]
            ids = np.array(self._ids([f" {self.MARK} ".join([*part, ""])])[0], np.int64)
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) != len(part):
                raise ValueError("the vocabulary doesn't keep the mark between chunks apart")
            begins = np.concatenate(([0], at[:-1] + len(self.mark)))
            raw, w = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            self.chunks.update((c, raw[x * w : y * w]) for c, x, y in zip(part, begins.tolist(), at.tolist()))

    def learn(self, chunks: set[str]) -> None:
        """Put chunks into the cache; those that can't be encoded alone as None."""
        known = self.chunks
        stopped = {c for c in chunks if c[-1] in ".," and c[-2:-1].isalpha()}
        alone = {c for cs in (chunks - stopped, (c[:-1] for c in stopped), ".,") for c in cs if c not in known}
        other = {c for c in alone if self.OTHER.search(c)}
        known.update(dict.fromkeys(other))
        self._learn(list(alone - other))
        known.update((c, known[c[:-1]] and known[c[:-1]] + known[c[-1]]) for c in stopped)
        self.passing = [c for cs in (chunks, alone) for c in cs if len(c) > SHORT]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.chunked:
            return [np.array(ids, self.dtype).tobytes() + self.end for ids in self._ids([t or "" for t in texts])]
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and any(x in t for x in self.WHOLE)]
        known, open_ = self.chunks, []
        for c in self.passing:
            known.pop(c, None)
        self.passing = []
        if len(known) > CACHE:
            known.clear()
        for i, t in enumerate(texts):
            chunks = (t or "").lower().split()
            found = list(map(known.get, chunks))
            gaps = [k for k, v in enumerate(found) if v is None]
            if gaps:
                open_.append((i, found, [(k, chunks[k]) for k in gaps]))
            else:
                out[i] = b"".join(found) + self.end
        self.learn({c for _, _, gaps in open_ for _, c in gaps if c not in known})
        for i, found, gaps in open_:
            for k, c in gaps:
                found[k] = known[c]
            if None in found:
                whole.append(i)
            else:
                out[i] = b"".join(found) + self.end
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = np.array(ids, self.dtype).tobytes() + self.end
        return out


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int, width: int) -> Encoder:
    return Encoder(path, end_id, width)


def id_width(path: str, end_id: int) -> int:
    """Bytes that the vocabulary's ids need: two or four."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = [end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]
    return 2 if max(ids) < 1 << 16 else 4


def _tail(keys: list, lens: list[int], width: int) -> bytes:
    """Directory, index and tail of a shard."""
    valid = np.array([k is not None for k in keys], np.uint8)
    key = np.array([0 if k is None else k for k in keys], np.int64)
    n = np.array(lens, np.int64)
    ends = np.cumsum(n)
    first = np.flatnonzero(valid.astype(bool) & np.concatenate(([True], (key[1:] != key[:-1]) | (valid[:-1] == 0))))
    index = PerfectHash.build(key[first])
    slots = np.zeros(len(first), SLOT)
    at = index.slots(key[first])
    slots["print"][at], slots["n"][at], slots["at"][at] = _prints(key[first]), n[first], ends[first] - n[first]
    directory = int(n.sum()) * width
    parts = [key.tobytes() + valid.tobytes() + ends.astype("<u8").tobytes(), *index.cells()]
    places = directory + np.cumsum([0, *map(len, parts)])
    levels = b"".join(LEVEL.pack(len(bits), place) for bits, place in zip(index.levels, places[1:].tolist()))
    table = int(places[-1])
    tail = TAIL.pack(MAGIC, width, len(index.levels), len(keys), int(n.sum()), directory, table, table + len(levels))
    return b"".join([*parts, levels, slots.tobytes(), tail])


def _write(folder: str, path: str, end_id: int, width: int):
    def run(batches):
        e, part, n_shards = encoder(path, end_id, width), TaskContext.get().partitionId(), 0

        def documents():
            for b in batches:
                for k in range(0, b.num_rows, 1000):
                    yield from zip(b.column(0).slice(k, 1000).to_pylist(), e.encode(b.column(1).slice(k, 1000).to_pylist()))

        left = documents()
        head = next(left, None)
        while head is not None:  # no file for an empty partition
            keys, lens = [], []

            def chunks():
                nonlocal head
                size = 0
                while head is not None and (not keys or (size + len(head[1]) <= SHARD and len(keys) < SHARD_DOCS)):
                    key, ids = head
                    keys.append(key)
                    lens.append(len(ids) // width)
                    size += len(ids)
                    yield ids
                    head = next(left, None)
                yield _tail(keys, lens, width)

            uri, _ = write_file(folder, f"part-{part:06d}-{n_shards:06d}", chunks())
            values = ((part, pa.int32()), (n_shards, pa.int32()), (uri, pa.string()), (len(keys), pa.int64()), (sum(lens), pa.int64()), (keys[0], pa.int64()), (keys[-1], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["part", "turn", "uri", "n_docs", "n_ids", "first_key", "last_key"])
            n_shards += 1

    return run


MANIFEST = "part int, turn int, uri string, n_docs long, n_ids long, first_key long, last_key long"


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", width: int | None = None) -> DataFrame:
    """Write the ids of all texts under folder; returns the manifest (part, turn, uri, n_docs, n_ids,
    first_key, last_key, base: ids of all shards before)."""
    C.bounded_memory(docs.sparkSession)
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("body"), F.xxhash64(docs[text]).alias("spread"))
    # rows of one key go to several tasks by the hash of their text
    by = (F.col("key").asc_nulls_first(), F.col("spread").asc())
    ordered = rows.repartitionByRange(C.parallel_width(docs.sparkSession), *by).sortWithinPartitions(*by, "body").select("key", "body")
    shards = C.settle(ordered.mapInArrow(_write(folder, path, end_id, width or id_width(path, end_id)), MANIFEST), "id-manifest")
    before = Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def lookup(manifest: DataFrame, key: int) -> np.ndarray | None:
    """The ids of the first document of a key, by the manifest and the shard's index."""
    held = manifest.where((F.col("last_key") >= key) & (F.coalesce("first_key", F.lit(-(1 << 63))) <= key))
    for uri in (r.uri for r in held.orderBy("base").select("uri").toLocalIterator()):
        ids = Shard(uri).get(key)
        if ids is not None:
            return ids
    return None


class Shard:
    """A shard of ids, read by key or whole."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        size = self.file.size()
        magic, self.width, n_levels, self.n_docs, self.n_ids, self.directory, table, self.slots_at = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} holds no token ids")
        self.dtype = np.dtype(f"<u{self.width}")
        self.levels = list(LEVEL.iter_unpack(self._read(table, LEVEL.size * n_levels)))
        self.n_slots = (size - TAIL.size - self.slots_at) // SLOT.itemsize

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, whether they are set, and the ends of their ids."""
        raw, n = self._read(self.directory, 17 * self.n_docs), self.n_docs
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n) == 1, np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is here, where its ids begin, and how many they are; for many keys, so
        the whole index is read."""
        index = PerfectHash.of_cells([(n, self._read(at, -(-n // BITS) * CELL)) for n, at in self.levels])
        slots = np.frombuffer(self._read(self.slots_at, self.n_slots * SLOT.itemsize), SLOT)
        slot = index.slots(keys)
        known = np.flatnonzero(slot >= 0)
        here, s = np.zeros(len(keys), bool), slots[slot]
        here[known] = s["print"][known] == _prints(keys[known])
        return here, s["at"].astype(np.int64), s["n"].astype(np.int64)

    def ids(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self._read(at * self.width, n * self.width), self.dtype)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document of this key: a cell a level, a slot and the ids are read."""
        one = np.array([key], np.int64)
        for k, (n_bits, place) in enumerate(self.levels):
            cell, bit = divmod(int(_hash(one, k + 1)[0] % U(n_bits)), BITS)
            raw = self._read(place + CELL * cell, CELL)
            upto = int.from_bytes(raw[8:], "big") >> (BITS - 1 - bit)  # the bits through this one
            if upto & 1:
                slot = int.from_bytes(raw[:8], "little") + (upto >> 1).bit_count()
                s = np.frombuffer(self._read(self.slots_at + slot * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
                return self.ids(int(s["at"]), int(s["n"])) if s["print"] == _prints(one)[0] else None
        return None


def _read_batches(batches):
    """Manifest rows (uri, base) -> (key, start, n_tokens, crc)."""
    for b in batches:
        for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = Shard(uri)
            key, valid, ends = s.keys()
            at = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            n = ends - at
            # every first document of a key is found through the index
            first = np.flatnonzero(valid & np.concatenate(([True], (key[1:] != key[:-1]) | ~valid[:-1])))
            if len(first):
                here, found, length = s.find(key[first])
                if not here.all():
                    raise ValueError(f"the index of {uri} misses keys")
                at[first], n[first] = found, length
            lo = 0
            while lo < len(key):
                hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + PIECE // s.width, side="right")))
                x, y = at[lo:hi], n[lo:hi]
                ids = s.ids(int(x[0]), int(x[-1] + y[-1] - x[0])).astype("<u4")
                crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip((x - x[0]).tolist(), y.tolist())]
                cols = [pa.array(key[lo:hi], mask=~valid[lo:hi]), pa.array(x + base), pa.array(y), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "start", "n_tokens", "ids_crc32"])
                lo = hi


def read_shards(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files."""
    dealt = manifest.select("uri", "base").repartition(C.parallel_width(manifest.sparkSession))
    return dealt.mapInArrow(_read_batches, "key long, start long, n_tokens long, ids_crc32 long")
