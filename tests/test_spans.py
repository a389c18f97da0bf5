"""Span algebra against plain Python on random cases."""

import random

from pyspark.sql import functions as F

from quillmask.functions import checks, text
from quillmask.functions import spans as S
from quillmask.policy import TEXT_PRIORITY
from quillmask.udtf import _luhn

LABELS = list(TEXT_PRIORITY)


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], -TEXT_PRIORITY[s[2]], -s[5], s[0], s[6])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[0])


def test_merge(spark):
    rng, cases = random.Random(11), []
    for k in range(300):
        spans = []
        for ord_ in range(rng.randint(0, 9)):
            a = rng.randint(0, 30)
            spans.append((a, a + rng.randint(1, 12), rng.choice(LABELS), "", "", rng.choice([0.6, 0.9, 1.0]), ord_))
        cases.append((k, spans))
    df = spark.createDataFrame(cases, f"id int, spans {S.SPANS}")
    got = {r.id: [tuple(x) for x in r.m] for r in df.select("id", S.merge(F.col("spans")).alias("m")).collect()}
    assert got == {k: greedy(s) if len(s) > 1 else s for k, s in cases}


def test_splice_and_find_round_trip(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab1é😀 ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("h", S.find(F.col("t"), r"(?U)\d+|é+"))
    edits = F.transform("h", lambda h: F.struct(h.start.alias("start"), h.end.alias("end"), F.concat(F.lit("<"), h.text, F.lit(">")).alias("replacement")))
    for r in df.select("t", "h", S.splice(F.col("t"), edits).alias("s")).collect():
        out, at = "", 0
        for h in r.h:
            assert r.t[h.start : h.end] == h.text
            out, at = out + r.t[at : h.start] + "<" + h.text + ">", h.end
        assert r.s == out + r.t[at:]


def test_write_back_keeps_the_text_of_splice(spark):
    rng, cases = random.Random(13), []
    for k in range(200):
        pieces = [("".join(rng.choice("xyz") for _ in range(rng.randint(0, 6))), True) for _ in range(rng.randint(1, 5))]
        whole, at, edits = sum(len(p[0]) for p in pieces), 0, []
        while at < whole and rng.random() < 0.7:
            a = rng.randint(at, whole - 1)
            b = rng.randint(a + 1, whole)
            edits.append((a, b, f"[{len(edits)}]"))
            at = b
        cases.append((k, pieces, "".join(p[0] for p in pieces), edits))
    df = spark.createDataFrame(cases, "id int, pieces array<struct<text:string,editable:boolean>>, t string, edits array<struct<start:int,end:int,replacement:string>>")
    out = df.select(S.splice(F.col("t"), F.col("edits")).alias("a"), F.array_join(F.transform(S.write_back(F.col("pieces"), F.col("edits")), lambda p: p.text), "").alias("b"))
    assert all(r.a == r.b for r in out.collect())


def test_luhn_digit(spark):
    rng = random.Random(14)
    bodies = ["".join(rng.choice("0123456789") for _ in range(rng.randint(1, 19))) for _ in range(200)]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert all(_luhn(r.b + str(r.d)) for r in df.select("b", checks.luhn_digit(F.col("b")).alias("d")).collect())


def test_normal_forms_agree_with_python(spark):
    cases = [" Mr.  Ana’s  Shop, ", "A\tB\nC", "–x–", "", "É É;", "a.b", "|x| - "]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for r in df.select("t", text.normalise(F.col("t")).alias("n"), text.clean(F.col("t")).alias("c")).collect():
        assert r.n == text.py_normalise(r.t) and r.c == text.py_clean(r.t)


def test_any_of_is_the_alternation():
    import re

    words = ["st", "street", "state of", "road", "rd", "s.", "Ltd", "Ltd.", "& Sons"]
    shared, plain = re.compile(rf"(?:{text.any_of(words)})$"), set(words)
    for w in words + ["s", "stre", "streets", "Ltd..", "state", "& Son", "roa"]:
        assert bool(shared.match(w)) == (w in plain)
