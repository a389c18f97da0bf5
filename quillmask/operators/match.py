"""Pass 2: the lexicon of a document found in all of its blocks.

A document's aliases and places are gathered to one array (bounded by its lexicon, not by
its text) and joined to its blocks. Only blocks that hold the first word of a name are sent
to an Arrow UDF, with the names; the others travel as null, and so do their names. The UDF is one left-to-right scan with the longest name first."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import py_clean
from ..policy import Policy
from .detectors import ORD_LEXICON, ORD_NER, ORD_PLACE
from .learn import accepts

JOIN_LIMIT = 400

# Given names, honorifics, and a postal code after a place.
_GIVEN = r"(?:[A-Z][a-z'’\-]{1,20}|[A-Z]\.)"
_HONORIFIC = r"(?i:mr|mrs|ms|dr|shri|smt|prof|justice)\.?"
_CODE = r"\s*[–—-]?\s*\d{3}\s?\d{3}(?!\d)"
GIVEN_NAMES = 3


def _any(names, blank: str = r"\s+") -> str:
    """Any of the names, the longest first."""
    return "|".join(blank.join(map(re.escape, n.split())) for n in sorted(names, key=len, reverse=True))


@lru_cache(maxsize=256)
def _scanner(names: tuple[str, ...], kind: str) -> re.Pattern | None:
    """A pattern for names of a kind, with what belongs to them: a person's name takes in up to
    GIVEN_NAMES given names and initials before it, but no honorific right before it; a place takes
    in its postal code, and its own blanks may be missing. Acronyms are matched in capitals alone."""
    if not names:
        return None
    if kind == "ACRONYM":
        return re.compile(rf"(?<![\w@.])(?P<name>{_any([n.upper() for n in names])})(?!\w)")
    blank = r"\s*" if kind == "PLACE" else r"\s+"
    name = rf"(?<![\w@.])(?P<name>(?i:{_any(names, blank)}))(?!\w)"
    if kind == "PERSON":
        last = rf"(?!{_HONORIFIC}\s){_GIVEN}\s+"
        return re.compile(rf"(?:(?<!\w)(?:{_GIVEN}\s+){{0,{GIVEN_NAMES - 1}}}{last})?{name}")
    return re.compile(name + (rf"(?:{_CODE})?" if kind == "PLACE" else ""))


def _hits(text: str, names: tuple[str, ...], kind: str):
    """Matches of names that don't stand in lower case."""
    pattern = _scanner(names, kind)
    return [m for m in pattern.finditer(text) if not m["name"].islower()] if pattern else []


def alias_spans(text: str, aliases: dict[str, str]) -> list[tuple[int, int, str, str, float]]:
    """(start, end, kind, source, score) of aliases (lower case -> kind) in a text."""
    by_kind: dict[str, list[str]] = {}
    for name, kind in aliases.items():
        by_kind.setdefault(kind, []).append(name)
    out = [(m.start(), m.end(), kind, "gazetteer", 0.95) for kind, names in by_kind.items() for m in _hits(text, tuple(names), kind)]
    for kind, names in by_kind.items():
        short = tuple(n for n in names if 3 <= len(n) <= 4)
        out += [(m.start(), m.end(), kind, "gazetteer:acronym", 0.95) for m in _hits(text, short, "ACRONYM")]
    return out


def place_spans(text: str, places: tuple[str, ...]) -> list[tuple[int, int, str, str, float]]:
    return [(m.start(), m.end(), "LOCATION", "gazetteer:place", 0.9) for m in _hits(text, places, "PLACE")]


def per_document(lexicon: DataFrame) -> DataFrame:
    """(lex_doc, aliases, places, people, orgs, firsts): a row a document; firsts is a pattern of the
    first words of all names."""
    alias = F.col("kind").startswith("ALIAS:")
    listed = lexicon.groupBy(F.col("doc_id").alias("lex_doc")).agg(
        F.array_sort(F.collect_list(F.when(alias, F.struct("alias", F.substring("kind", 7, 10).alias("kind"))))).alias("aliases"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "PLACE", F.col("name")))).alias("places"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "PERSON", F.col("key")))).alias("people"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "ORG", F.col("key")))).alias("orgs"),
    )
    first = lambda name: F.concat(F.lit("\\Q"), F.substring_index(name, " ", 1), F.lit("\\E"))
    words = F.array_distinct(F.concat(F.transform("aliases", lambda a: first(a["alias"])), F.transform("places", first)))
    return listed.withColumn("firsts", F.when(F.size(words) > 0, F.concat(F.lit("(?iu)"), F.array_join(words, "|"))))


def _match_batches(policy: Policy, tagged: bool):
    def row(text, aliases, places, people, orgs, marks, common, tagged_places):
        if not text or not text.strip():
            return []
        table = {a["alias"]: a["kind"] for a in ([] if aliases is None else aliases) if policy.wants(a["kind"])}
        names = () if places is None or not policy.wants("LOCATION") else tuple(p for p in places if len(p) >= 3)
        spans = [(*s, ORD_LEXICON) for s in alias_spans(text, table)] + [(*s, ORD_PLACE) for s in place_spans(text, names)]
        if tagged and marks is not None:
            sets = (set() if x is None else set(x) for x in (people, orgs))
            words = {w: 1 << 30 for w in ([] if common is None else common)}
            known, seen = set(table), set() if tagged_places is None else set(tagged_places)
            p, o = sets
            for m in marks:
                if m["label"] in ("PERSON", "ORG") and policy.wants(m["label"]) and accepts(p, o, known, seen, words, m["text"], m["label"], policy):
                    spans.append((m["start"], m["end"], m["label"], f"ner:{m['label']}", 0.6, ORD_NER))
        return [
            {"start": a, "end": b, "label": k, "text": text[a:b], "source": source, "score": score, "ord": o} for a, b, k, source, score, o in spans
        ]

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([row(*r) for r in zip(*columns)])

    return run


def matches(text: Column, policy: Policy | None = None, tagged: bool = False) -> Column:
    """Lexicon spans of blocks joined with per_document()."""
    none = F.lit(None).cast("array<struct<start:int,end:int,label:string,text:string>>")
    some = F.rlike(text, F.col("firsts"))
    if tagged:  # what the tagger found is judged by the whole lexicon
        some = F.coalesce(some, F.lit(False)) | (F.coalesce(F.size("tagged"), F.lit(0)) > 0)
    columns = [F.when(some, text), F.when(some, F.col("aliases")), F.when(some, F.col("places"))]
    columns += [F.col(c) if tagged else F.lit(None).cast("array<string>") for c in ("people", "orgs")]
    columns += [F.col("tagged") if tagged else none]
    columns += [F.col(c) if tagged else F.lit(None).cast("array<string>") for c in ("common", "tagged_places")]
    return F.pandas_udf(_match_batches(policy or Policy(), tagged), S.SPANS)(*columns)


def across_blocks(blocks: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(doc_id, block_id, next_id, span, head): names that run over the end of a block into the
    next, found on both texts joined by a blank. blocks are joined with per_document();
    head is how long the first block is."""
    following = Window.partitionBy("doc_id").orderBy("block_id")
    pairs = blocks.withColumn("next_id", F.lead("block_id").over(following)).withColumn("next_text", F.lead("text").over(following))
    short = F.length("text") + F.length("next_text") <= JOIN_LIMIT
    pairs = pairs.where((F.btrim("text") != "") & (F.btrim("next_text") != "") & short & (F.size("aliases") > 0))
    pairs = pairs.withColumn("both", F.concat_ws(" ", "text", "next_text")).withColumn("head", F.length("text"))
    hits = pairs.withColumn("spans", matches(F.col("both"), policy=policy))
    straddling = F.filter("spans", lambda s: (s.label != "LOCATION") & (s.start < F.col("head")) & (s.end > F.col("head")))
    return hits.select("doc_id", "block_id", "next_id", "head", F.explode(F.slice(straddling, 1, 1)).alias("span"))
