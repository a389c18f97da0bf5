"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut by the vocabulary's split pattern; the distinct words that a worker hasn't
met yet are merged together: their symbols lie in one flat array, a round looks every
adjacent pair up by binary search over the sorted pair keys, takes in each word its
lowest rank and merges all places of that pair at once, and words without a pair leave.
Decoding gathers the bytes of all ids of a text in one step.

A worker remembers at most CACHE words, texts are worked on one by one, and nothing is
shuffled, so memory is bounded by the longest text and any lost task is just run again.

Defined cases: null and empty texts have no ids; special tokens in a text are encoded as
such, as the vocabulary file says; bytes that are no UTF-8 after decoding become U+FFFD;
other columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words that a worker remembers (some 200 MB of them), none longer than SHORT bytes.
CACHE = 800_000
SHORT = 64
#: Code points of texts whose new words are merged together.
GROUP = 4 << 20
#: Longer words are merged one by one with a heap: a round a rank would be slow there.
LONG = 400
SHIFT = 20
NONE = np.iinfo(np.int64).max

# Unicode's white space as ranges, and the split pattern of the byte-level vocabulary.
SPACES = ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_S = "".join(f"{chr(a)}-{chr(b)}" for a, b in SPACES)
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1
    characters for themselves, the other bytes in turn from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or spec["normalizer"]:
            raise ValueError("this vocabulary needs more than byte-level BPE")
        tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << SHIFT | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.words: dict[str, bytes] = {}
        self.passing: list[str] = []  # longer words, which are forgotten before the next ones are learnt
        self.split = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (as bytes of 32-bit numbers), by merge rounds over all of them."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        best = np.empty(len(words), np.int64)
        while len(sym):
            rank = np.full(len(sym), NONE)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.ranks_of(sym[inside], sym[inside + 1])
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best[word[begins]] = np.minimum.reduceat(rank, begins)
            lowest = best[word]
            at = np.flatnonzero((rank == lowest) & (rank != NONE))
            if not len(at):
                done.append((word, sym))
                break
            # of places that overlap (a pair of equal symbols), every other one from the left
            first = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(first, at, 0))
            at = at[(at - run) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            over = lowest == NONE
            if over.any():
                done.append((word[over], sym[over]))
                keep &= ~over
            sym, word = sym[keep], word[keep]
        word, sym = (np.concatenate([d[k] for d in done]) if done else np.empty(0, np.int64) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        raw = sym[order].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [raw[x:y] for x, y in zip([0, *ends[:-1]], ends)] if len(words) else []

    def merge_long(self, word: bytes) -> list[int]:
        """One long word, with a heap of pairs over a linked list."""
        sym = self.of_byte[np.frombuffer(word, np.uint8)]
        ranks = self.ranks_of(sym[:-1], sym[1:])
        at = np.flatnonzero(ranks != NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist(), sym[at].tolist(), sym[at + 1].tolist()))
        heapify(heap)
        ids, n = sym.tolist(), len(sym)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank_of = {}

        def push(i: int, j: int) -> None:
            pair = (ids[i], ids[j])
            if pair not in rank_of:
                rank_of[pair] = int(self.ranks_of(np.array(pair[:1]), np.array(pair[1:]))[0])
            if rank_of[pair] != NONE:
                heappush(heap, (rank_of[pair], i, *pair))

        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]

    def learn(self, new: set[str], split) -> None:
        """Put the ids of new words into the cache; a full cache first forgets all that split
        (words of texts, in parts) doesn't need."""
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = {w for ps in split for ws in ps[::2] for w in ws}
        new = list(new)
        raw = [w.encode("utf-8", "replace") for w in new]
        self.passing = [w for w, r in zip(new, raw) if len(r) > SHORT]
        short = [k for k, r in enumerate(raw) if len(r) <= LONG]
        for k, ids in zip(short, self.merge([raw[k] for k in short])):
            self.words[new[k]] = ids
        for w, r in zip(new, raw):
            if len(r) > LONG:
                self.words[w] = np.array(self.merge_long(r), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Every text is split once; the new words of all are merged together."""
        parts = [self.specials.split(t) if self.specials is not None and self.specials.search(t) else [t] for t in texts]
        split = [[p if k % 2 else self.split(p) for k, p in enumerate(ps)] for ps in parts]
        known = self.words
        for w in self.passing:
            known.pop(w, None)
        self.learn({w for ps in split for ws in ps[::2] for w in filterfalse(known.__contains__, ws)}, split)
        special = {t: np.array([i], np.int32).tobytes() for t, i in self.special.items()}
        joined = (b"".join([special[p] if k % 2 else b"".join([known[w] for w in p]) for k, p in enumerate(ps)]) for ps in split)
        return [np.frombuffer(x, np.int32) for x in joined]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids that the vocabulary hasn't are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        lens = self.lengths[ids]
        ends = np.cumsum(lens)
        place = np.arange(int(lens.sum())) + np.repeat(self.starts[ids] - (ends - lens), lens)
        return self.bytes[place].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _groups(texts: list[str]):
    """Slices of about GROUP code points."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= GROUP or k + 1 == len(texts):
            yield at, texts[at : k + 1]
            at, size = k + 1, 0


def _encode_batches(path: str, decode: bool):
    def run(batches):
        v = vocabulary(path)
        for b in batches:
            for at, texts in _groups([t.as_py() or "" for t in b.column(1)]):
                ids = v.encode_all(texts)
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                cols = [b.column(0).slice(at, len(ids)), lists] + ([pa.array([v.decode(x) for x in ids], pa.string())] if decode else [])
                yield pa.RecordBatch.from_arrays(cols, ["row", "ids", "decoded"][: len(cols)])

    return run


def encoded(docs: DataFrame, path: str, text: str = "text", decode: bool = False, then=None, schema=None) -> DataFrame:
    """Struct `row` (docs without the text), `ids`, and with decode the text `decoded` back
    from the ids. then: a function from these record batches to others (of `schema`),
    which runs in the same Python worker, for callers that need less than the ids."""
    C.bounded_memory(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), docs[text].alias("body"))
    full = rows.select("row", F.lit(None).cast("array<int>").alias("ids"), *([F.col("body").alias("decoded")] if decode else [])).schema
    run = _encode_batches(path, decode)
    return rows.mapInArrow(run if then is None else lambda batches: then(run(batches)), full if schema is None else schema)
