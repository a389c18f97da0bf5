"""Span algebra on array columns: find, merge, edit.

A span is a struct (start, end, label, text, source, score, ord): code points of its block,
end exclusive; ord is the order of emission, the last tie-break of merging. All of it is
built-in higher-order functions, so it stays in the JVM and in one projection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import priorities

SPAN = "struct<start:int,end:int,label:string,text:string,source:string,score:double,ord:int>"
SPANS = f"array<{SPAN}>"
HIT = "struct<start:int,end:int,text:string>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


#: Matches of a part, where they are many.
PART = 64


def find(text: Column, pattern: str, group: int = 0, many: bool = False) -> Column:
    """All matches of pattern as array<struct<start,end,text>>, like a left-to-right search.

    Spark has no such function; the pieces between the matches (split) and the matches
    (extract_all) are added up to offsets. A group must end where the match ends. many: for
    patterns that match all over a text, in parts, so that cost grows with their number."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(f"array<{HIT}>")

    def fold(parts: Column, begin: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            end = (acc.at + F.length(p.gap) + F.length(p.whole)).cast("int")
            hit = F.struct((end - F.length(p.inner)).cast("int").alias("start"), end.alias("end"), p.inner.alias("text"))
            return F.struct(end.alias("at"), F.concat(acc.out, F.array(hit)).alias("out"))

        return F.aggregate(parts, F.struct(begin.cast("int").alias("at"), empty.alias("out")), step, lambda acc: acc.out)

    def by_parts(ps: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / PART).cast("int")), lambda k: F.slice(ps, k * PART + 1, PART))
        size = lambda qs: F.aggregate(qs, F.lit(0), lambda n, q: n + F.length(q.gap) + F.length(q.whole))
        sums = lambda cs: F.aggregate(
            F.transform(cs, size), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
        )
        return let(cut, lambda cs: let(sums(cs), lambda at: F.flatten(F.transform(cs, lambda c, k: fold(c, F.get(at, k))))))

    parts = F.filter(
        F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), inner.alias("inner")), lambda p: p), lambda p: p.whole.isNotNull()
    )
    hits = let(parts, by_parts) if many else fold(parts, F.lit(0))
    return F.when(text.rlike(pattern), hits).otherwise(empty)


def label(hits: Column, label_: str, source: str, score: float, ord_: int) -> Column:
    """Hits as spans."""
    return F.transform(
        hits,
        lambda h: F.struct(
            h.start.alias("start"),
            h.end.alias("end"),
            F.lit(label_).alias("label"),
            h.text.alias("text"),
            F.lit(source).alias("source"),
            F.lit(float(score)).alias("score"),
            F.lit(ord_).alias("ord"),
        ),
    )


def overlaps(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def priority(label_: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in priorities().items() for x in kv])
    return F.coalesce(F.element_at(table, label_), F.lit(0))


def merge(spans: Column) -> Column:
    """The spans that stay: longest first, then by priority of the label, score, start and
    order of emission; whatever overlaps one that stays goes. By start."""
    none = F.array().cast(SPANS)

    def rank(s: Column) -> Column:
        keys = ((s.start - s.end).alias("a"), (-priority(s.label)).alias("b"), (-s.score).alias("c"), s.start.alias("d"), s.ord.alias("e"))
        return F.struct(*keys, s.alias("s"))

    def step(kept: Column, r: Column) -> Column:
        return F.when(F.exists(kept, lambda k: overlaps(k, r.s)), kept).otherwise(F.concat(kept, F.array(r.s)))

    def kept_of(all_: Column) -> Column:
        return F.when(F.size(all_) < 2, all_).otherwise(F.array_sort(F.aggregate(F.array_sort(F.transform(all_, rank)), none, step)))

    return let(spans, kept_of)


def splice(text: Column, edits: Column) -> Column:
    """text with edits array<struct<start,end,replacement>>, sorted and not overlapping, made."""

    def build(es: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, e: Column) -> Column:
            gap = F.substring(text, acc.at + 1, e.start - acc.at)
            return F.struct(e.end.cast("int").alias("at"), F.concat(acc.out, gap, e.replacement).alias("out"))

        return F.aggregate(es, begin, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))

    return F.when(F.size(edits) == 0, text).otherwise(build(edits))


def piece_after(text: str, at: int, edits: list[tuple[int, int, str]], owners: dict[int, int], index: int) -> str:
    """A piece that begins at `at` of its block, with edits (ascending) made: what replaces a span
    goes into the piece that owns it, the first editable one that it touches (owners), and
    every piece loses what spans cover."""
    out, place = [], 0
    for k, (start, end, new) in enumerate(edits):
        lo, hi = max(0, start - at), min(len(text), end - at)
        if lo < hi:
            out += [text[place:lo], new if owners.get(k) == index else ""]
            place = hi
    return "".join([*out, text[place:]])


def owners_of(pieces: list[tuple[str, bool]], edits: list[tuple[int, int, str]]) -> dict[int, int]:
    """Edit to the first editable piece that it touches."""
    out, at = {}, 0
    for i, (text, editable) in enumerate(pieces):
        for k, (start, end, _) in enumerate(edits if editable else ()):
            if start < at + len(text) and at < end:
                out.setdefault(k, i)
        at += len(text)
    return out


def written(pieces: list[tuple[str, bool]], edits: list[tuple[int, int, str]]) -> list[str]:
    """The texts of pieces (text, editable) of a block with edits made; pieces that aren't editable
    stay."""
    edits, out, at = sorted(edits), [], 0
    owners = owners_of(pieces, edits)
    for i, (text, editable) in enumerate(pieces):
        out.append(piece_after(text, at, edits, owners, i) if editable else text)
        at += len(text)
    return out


def _written_batch(pieces: pd.Series, edits: pd.Series) -> pd.Series:
    def one(ps, es):
        if ps is None:
            return None
        texts = written([(p["text"], p["editable"]) for p in ps], [(e["start"], e["end"], e["replacement"]) for e in (() if es is None else es)])
        return [{"text": t, "editable": p["editable"]} for t, p in zip(texts, ps)]

    return pd.Series([one(*r) for r in zip(pieces, edits)])


def write_back(pieces: Column, edits: Column) -> Column:
    """pieces array<struct<text,editable>> of a block with edits made, as written() does."""
    return F.pandas_udf(_written_batch, "array<struct<text:string,editable:boolean>>")(pieces, edits)
