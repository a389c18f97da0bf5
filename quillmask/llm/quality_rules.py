"""Quality rules: base statistics of each text and cross-document line frequency.

Lines are normalised and hashed, the distinct documents of each line are counted per
host, lines above the limit are removed, and a document that is depleted by that is
rejected, as is one that fails the base rules. Documents of one host with equal texts
are one document here: a text is no boilerplate for having been copied as a whole, which
is for the deduplication operators. Lines of every length and hosts of every size count.

Only DataFrame functions run. The texts are read once: statistics and line hashes are
settled in the shared folder (a few per cent of the input), and line counts, the
frequent lines and the hits are worked out from those. Counts are combined before the
shuffle, so a line, text or host that holds a third of all rows costs one row a task.

Defined cases: a null text has no words and fails the base rules; a null host is a host
of its own; every row gets a verdict of its own, equal ids or texts included; lines
without words are never frequent; a very long text is one row in one task; an empty table
gives an empty result; further columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: 100 * n_repeat_words above this share of the words fails.
MAX_REPEAT_PCT = 30
#: A line is over the limit in a host if at least so many of its distinct documents have it.
MIN_DOCS = 10
#: A document is depleted if less than this percentage of its words is left.
MIN_LEFT_PCT = 30


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of `window` words found twice or more."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, x: F.struct(
            (a.n + x + window - F.greatest(a.end, x)).cast("int").alias("n"), (x + window).cast("int").alias("end")
        )
        return F.aggregate(starts, zero, step, lambda a: a.n)

    def heavy(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, i - 1).h == x.h)) | F.coalesce(F.get(s, i + 1).h == x.h, F.lit(False)),
        )
        return C.let(pairs, lambda s: covered(F.array_sort(F.transform(twice(s), lambda x: x.i))))

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(heavy(hashes))

    def windows(hs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hs) - (window - 1)), lambda i: F.xxhash64(F.slice(hs, i, window)))

    enough = F.size(words) > window  # one window alone can't be repeated
    return F.when(
        enough, C.let(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: C.let(windows(hs), of_hashes))
    ).otherwise(F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _statistics(text: Column) -> Column:
    lines = F.filter(_lines(text), lambda x: F.length(F.btrim(x, F.lit(C.WS_CHARS))) > 0)

    def rows(ls: Column) -> Column:
        return F.transform(ls, lambda x: F.struct(*C.key_hash(C.line_key(x)), F.size(C.words_of(x)).alias("w")))

    of_lines = C.let(lines, lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"), rows(ls).alias("lines")))
    of_words = C.let(
        C.words_of(text),
        lambda ws: F.struct(F.size(ws).alias("n_words"), repeated_words(ws).alias("n_repeat_words")),
    )
    return F.struct(
        of_words.alias("of_words"),
        of_lines.alias("of_lines"),
        F.length(F.translate(text, C.WS_CHARS, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(7919), text).alias("t2"),
    )


LONGS = ("n_words", "n_repeat_words", "word_chars", "n_symbols", "n_dup_lines")


def _settled_statistics(docs: DataFrame, text: str, host: str) -> DataFrame:
    C.bounded_memory(docs.sparkSession)
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"),
        F.coalesce(docs[text], F.lit("")).alias("body"),
        (F.coalesce(F.concat(F.lit("="), docs[host].cast("string")), F.lit(""))).alias("host"),
    )
    s = base.select("row", "host", _statistics(F.col("body")).alias("s"))
    at = {"n_words": "of_words.", "n_repeat_words": "of_words.", "n_dup_lines": "of_lines."}
    return C.settle(
        s.select(
            "row",
            "host",
            F.monotonically_increasing_id().alias("rid"),
            *[F.col(f"s.{at.get(c, '')}{c}").cast("long").alias(c) for c in LONGS],
            F.col("s.of_lines.lines").alias("lines"),
            "s.t1",
            "s.t2",
        ),
        "quality-stats",
    )


def _hits(stats: DataFrame, min_docs: int) -> DataFrame:
    """(hit_rid, n_hit, hit_keys): words in frequent lines, and these lines' keys."""
    distinct = stats.groupBy("host", "t1", "t2").agg(F.min("rid").alias("one_rid")).select("one_rid")
    keys = F.array_distinct(F.transform("lines", lambda r: F.struct(r.h1.alias("h1"), r.h2.alias("h2"))))
    one_each = stats.select("rid", "host", keys.alias("keys")).join(distinct, F.col("rid") == F.col("one_rid"), "left_semi")
    frequent = C.settle(
        one_each.select("host", F.explode("keys").alias("k"))
        .groupBy(F.col("host").alias("line_host"), "k.h1", "k.h2")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
        .drop("n_docs"),
        "quality-lines",
    )
    lines = stats.select("rid", "host", F.explode("lines").alias("r")).select("rid", "host", "r.h1", "r.h2", "r.w")
    f = C.checked_broadcast(frequent)
    return (
        lines.join(f, (lines.h1 == f.h1) & (lines.h2 == f.h2) & (lines.host == f.line_host))
        .groupBy(F.col("rid").alias("hit_rid"))
        .agg(F.sum("w").alias("n_hit"), F.collect_set(F.struct(lines.h1, lines.h2)).alias("hit_keys"))
    )


def _judged(docs: DataFrame, text: str, host: str, min_docs: int, min_left_pct: int) -> DataFrame:
    stats = _settled_statistics(docs, text, host)
    n, out = F.col("n_words"), F.coalesce("n_hit", F.lit(0))
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PCT)
    kept = (~failed & ((n - out) * 100 >= n * min_left_pct)).alias("kept")
    judged = stats.drop("lines").join(_hits(stats, min_docs), F.col("rid") == F.col("hit_rid"), "left")
    return judged.select("row", "rid", *LONGS, out.alias("n_frequent"), failed.alias("base_failed"), kept, "hit_keys")


def verdicts(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_left_pct: int = MIN_LEFT_PCT) -> DataFrame:
    """The rows of docs as struct `row` (without the text), with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_frequent (words in frequent lines), base_failed, kept."""
    return _judged(docs, text, host, min_docs, min_left_pct).drop("hit_keys")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_left_pct: int = MIN_LEFT_PCT) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns and without the lines over the limit."""
    rows = C.numbered(docs, "quality-rows")
    parts = rows.select("rid", F.col("doc").getField(text).alias("text"), F.col("doc").getField(host).alias("host"))
    good = _judged(parts, "text", "host", min_docs, min_left_pct).where("kept").select(F.col("row.rid").alias("good"), "hit_keys")
    kept = rows.join(good, F.col("rid") == F.col("good"))
    body, hit = F.col("doc").getField(text), F.col("hit_keys")
    left = F.filter(_lines(body), lambda x: ~F.array_contains(hit, F.struct(*C.key_hash(C.line_key(x)))))
    cut = F.when(hit.isNull(), body).otherwise(F.array_join(left, "\n"))
    return kept.select(*[(cut if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])
