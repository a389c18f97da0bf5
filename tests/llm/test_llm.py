"""The training-data operators against brute force, SQL and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillmask.llm import bpe, common, components, line_dedup, mixing, quality_model, quality_rules, queries, simhash, suffix_dedup, token_files, topk, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = r"[^\x20\x09-\x0D]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"word{k % 700}" for k in range(9000))
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \n\t \n", None, None, 3),
    (4, "Same line\nother Line\nsame line ", "en", "a", 1),
    (4, "Same line\nother Line\nsame line ", "en", "a", 1),  # the same row again
    (5, LONG, "en", "b", 1),
    (6, LONG + " tail", "en", "b", 1),
    (None, "a row without an id but with some words in it", "en", None, 1),
    (8, "x" * 3000, "en", "\U0001f600", 1),
    (9, "é\x00 日本 <|endoftext|> ＡＢ", "xx", "é", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and clashing columns."""
    df = spark.createDataFrame(ODD, DOCS)
    extra = {c: F.lit(c) for c in ("rid", "row", "body", "key", "size", "fp", "line", "kept", "h1", "digit", "ids", "x", "score", "host", "copies", "target", "component_id")}
    return common.settle(df.withColumns(extra), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return common.settle(spark.createDataFrame([], DOCS), "empty")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# -- 1 ---------------------------------------------------------------------------------------------
def cut(texts, window=suffix_dedup.WINDOW):
    """What is left of byte strings, with figures, by comparing all windows."""
    count = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        covered = np.cumsum(gone[: len(b)]) > 0
        n_spans = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        left = bytes(c for c, g in zip(b, covered) if not g)
        out.append((len(b), int(covered.sum()), n_spans, sha(left)))
    return out


def test_op1_against_all_windows(spark):
    docs = table("documents")
    expected = dict(zip([d["doc_id"] for d in docs], cut([(d["text"] or "").encode() for d in docs])))
    assert {r[0]: tuple(r)[1:] for r in queries.op1(spark, SF).collect()} == expected


def test_op1_planted_cases(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 1500)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = noise(900), noise(260)
    texts = [a, a, a[:450] + "!" + a[451:], noise(50) + b + noise(700) + b + noise(50), "ab" * 400, "z" * 200, "z" * 199, "z" * 201, b[:200], noise(5000) + a[100:299], "é" * 150, None, ""]
    texts += [noise(3000) + a[200:600] + noise(2000), noise(1490) + b + noise(1490)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = suffix_dedup.remove_repeats(common.settle(df, "planted")).collect()
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in out}
    assert got == dict(enumerate(cut([(t or "").encode() for t in texts])))


def test_op1_odd_rows(odd, empty):
    got = Counter((r.row.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect())
    expected = Counter((d[0], *f[:2]) for d, f in zip(ODD, cut([(d[1] or "").encode() for d in ODD])))
    assert got == expected
    assert suffix_dedup.remove_repeats(empty).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------
def water_fill(sizes, weights, cap=3):
    """Targets by handing the excess out again until none is above."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def mix_facts(rows):
    by = defaultdict(lambda: [0, 0, None, 0])
    for r in rows:
        s = by[r["source"]]
        s[0] += r["size"]
        s[1] += r["size"] * r["copies"]
        s[2] = r["target"]
        s[3] = max(s[3], r["copies"])
    return by


def test_op2_targets_and_totals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    words = {d["doc_id"]: len(re.findall(WS, d["text"] or "")) for d in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    assert {r["doc_id"]: r["size"] for r in rows} == words
    by = mix_facts(rows)
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in by else [])
    expected = water_fill([by[s][0] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))])
    for s, t in zip(names, expected):
        size, taken, target, copies = by[s]
        assert target == pytest.approx(t, rel=1e-9) and copies <= 3 and abs(taken - target) <= 0.01 * target + 20
    again = {(r.rid, r.copies) for r in mixing.mix(docs.repartition(1).sortWithinPartitions("doc_id")).select(F.col("doc_id").alias("rid"), "copies").collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


def test_op2_rates_against_a_solver_of_the_dual(spark):
    """lambda of min(3, exp(lambda * size / mean)) by plain bisection on all documents."""
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b", "b", "b", "c", None]), int(rng.paretovariate(0.7)) % 20000 + 1) for k in range(3000)] + [(k, "z", 1) for k in range(500)]
    sized = common.settle(spark.createDataFrame(rows, "rid long, source string, size long"), "sizes")
    goal = common.settle(mixing.targets(sized), "goal")
    lam = {r.source: r.lam for r in mixing.solve(sized.groupBy("source", "size").agg(F.count("*").alias("n")), goal).collect()}
    for g in goal.collect():
        z = np.array([s for _, h, s in rows if h == g.source], float)
        took = lambda x: np.minimum(3, np.exp(np.minimum(x * z / z.mean(), 50))) @ z
        if g.target >= 3 * z.sum() * (1 - 1e-12):
            assert g.source not in lam
            continue
        low, high = -1e6, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if took(mid) > g.target else (mid, high)
        assert took(lam[g.source]) == pytest.approx(g.target, rel=1e-8, abs=2e-3) and lam[g.source] == pytest.approx(low, rel=1e-4, abs=1e-6)
    with pytest.raises(RuntimeError):
        mixing.solve(sized.groupBy("source", "size").agg(F.count("*").alias("n")), goal, max_steps=1)


def test_op2_capped_sources(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(10, "a"), (1000, "b"), (990, "b"), (3, None), (0, "c"), (7, "\U0001f600"), (5, "é")])]
    docs = common.settle(spark.createDataFrame(rows, "doc_id long, text string, source string"), "mix")
    by = mix_facts(r.asDict() for r in mixing.mix(docs).collect())
    order = ["a", "b", "c", "é", "\U0001f600", None]
    expected = water_fill([by[s][0] for s in order], [1, 2, 3, 1, 2, 3])
    assert [by[s][2] for s in order] == pytest.approx(expected)
    assert by["a"][1] == 30 and by[None][1] == 9 and by["c"][1] == 0


def test_op2_hot_class_is_spread(spark):
    """Copies of one long class go to different documents, evenly."""
    docs = common.settle(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2900, "a").otherwise("b").alias("source")), "hot")
    rows = mixing.mix(docs).collect()
    by = mix_facts(r.asDict() for r in rows)
    assert all(abs(t - g) <= 3 for _, t, g, _ in by.values())
    assert all(max(c) - min(c) <= 1 for c in ([r.copies for r in rows if r.source == s] for s in "ab"))


def test_op2_odd_rows(odd, empty):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# -- 3 ---------------------------------------------------------------------------------------------
def test_op3_against_the_library(spark):
    t, at, expected = Tokenizer.from_file(queries.WORD_BPE), 0, {}
    for d in sorted(table("documents"), key=lambda d: d["doc_id"]):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        expected[d["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r[0]: tuple(r)[1:] for r in queries.op3(spark, SF).collect()} == expected


PIECES = ["a", "B", "É", "ß", "ÿ", "Ÿ", "'s", "don't", "1", "½", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "×", "!", ".", ",", "|", "<|endoftext|>", "<|", "日本", "é", "Σ", "İ", "the.", "\x00", " ", "", "K"]


def test_op3_chunks_equal_whole_texts():
    e, t, rng = token_files.encoder(queries.WORD_BPE, 2, 2), Tokenizer.from_file(queries.WORD_BPE), random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_op3_keyed_access(spark, odd, empty, monkeypatch):
    folder = common.scratch(spark, "ids")
    manifest = token_files.write_shards(odd, folder, queries.WORD_BPE, 2)
    rows = token_files.read_shards(manifest).orderBy("start").collect()
    assert [r.key for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 8, 9]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    t = Tokenizer.from_file(queries.WORD_BPE)
    shards = [token_files.Shard(m.uri) for m in manifest.collect()]
    for key, text in {5: LONG, 4: ODD[3][1], 1: ""}.items():
        assert token_files.lookup(manifest, key).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
    assert all(s.get(k) is None for s in shards for k in range(10_000, 10_400)) and token_files.lookup(manifest, 7) is None
    assert token_files.read_shards(token_files.write_shards(empty, common.scratch(spark, "ids"), queries.WORD_BPE, 2)).count() == 0


def written(spark, monkeypatch, keys, texts, width=2, path=queries.WORD_BPE):
    """Shards of one task, written here."""
    import pyarrow as pa

    class Context:
        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(token_files.TaskContext, "get", lambda: Context)
    b = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts)], ["key", "body"])
    return [r for x in token_files._write(common.scratch(spark, "ids"), path, 2, width)([b]) for r in x.to_pylist()]


def test_op3_shards_close_and_are_read_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "SHARD", 300)
    monkeypatch.setattr(token_files, "PIECE", 64)
    texts = [" ".join(["word"] * (k % 37)) for k in range(200)] + [LONG]
    shards = written(spark, monkeypatch, list(range(201)), texts)
    assert len(shards) > 10 and [s["turn"] for s in shards] == list(range(len(shards)))
    assert all(s["n_ids"] * 2 <= 300 or s["n_docs"] == 1 for s in shards)
    base = np.cumsum([0, *[s["n_ids"] for s in shards]])[:-1]
    m = pa.RecordBatch.from_arrays([pa.array([s["uri"] for s in shards]), pa.array(base)], ["uri", "base"])
    t, at = Tokenizer.from_file(queries.WORD_BPE), 0
    rows = [r for x in token_files._read_batches([m]) for r in x.to_pylist()]
    for k, (r, text) in enumerate(zip(rows, texts, strict=True)):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op3_a_keyed_read_reads_little(spark, monkeypatch):
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 60_000)).tolist()
    (m,) = written(spark, monkeypatch, keys, [f"w{k % 7}" for k in range(len(keys))])
    s = token_files.Shard(m["uri"])
    reads, plain = [], s._read
    s._read = lambda at, n: reads.append(n) or plain(at, n)
    for k in keys[::997]:
        reads.clear()
        assert s.get(k) is not None and sum(reads) < 2000
    assert s.get(5) is None and s.find(np.array(keys))[0].all()


def test_op3_wide_and_other_vocabularies(spark, monkeypatch, tmp_path):
    import json

    spec = json.load(open(queries.BYTE_BPE))
    top = max(spec["model"]["vocab"].values()) + 1
    spec["added_tokens"][0]["id"] = top
    (tmp_path / "v.json").write_text(json.dumps(spec))
    assert token_files.id_width(queries.WORD_BPE, 2) == 2 and token_files.id_width(queries.WORD_BPE, 70_000) == 4
    texts = ["", "Some  Text\n<|endoftext|> Ünd more", LONG]
    (m,) = written(spark, monkeypatch, [1, 2, 3], texts, 4, str(tmp_path / "v.json"))
    s, t = token_files.Shard(m["uri"]), Tokenizer.from_file(str(tmp_path / "v.json"))
    for k, text in zip((1, 2, 3), texts):
        assert s.get(k).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2] and s.width == 4


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    slots = token_files.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


# -- 4 and 10: SQL -------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = c.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(theirs.columns)
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == sorted(repr([r[theirs.columns.index(n)] for n in names]) for r in theirs.fetchall())


def test_op4_runs_merge_by_levels(spark):
    runs = line_dedup.LineRuns(spark, 4, min_docs=3, fanout=2)
    for _ in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, 2, 3)], "h1 long, h2 long, n long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r.h1 for r in runs.frequent().collect()} == {1, 2}
    # a key at the threshold is dropped from later batches, so its count stays
    assert {r.h1: r.n for level in runs.levels for run in level for r in run.collect() if r.h1 == 2} == {2: 3}


def test_op4_odd_rows(odd, empty):
    out = line_dedup.dedup(odd, min_docs=2).collect()
    got = Counter((r.row.doc_id, r.kept, r.n_lines, r.n_dropped) for r in out)
    assert got[(4, "", 3, 3)] == 2 and got[(1, "", 1, 0)] == 1 and got[(3, " \n\t \n", 3, 0)] == 1
    assert line_dedup.deduped(odd, min_docs=2).columns == odd.columns
    assert line_dedup.dedup(empty).count() == 0
    sorted_join = line_dedup.drop_lines(odd, line_dedup.build_runs(odd, min_docs=2).frequent())
    assert sorted_join.count() == len(ODD)


def test_op10_odd_rows(odd, empty):
    got = {r.row.doc_id: r for r in quality_rules.verdicts(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[4].n_dup_lines == 0 and got[8].n_words == 1 and got[5].n_repeat_words == 9000
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.verdicts(empty).count() == 0


def test_op10_repeated_windows(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(300)]

    def brute(words):
        seen, covered = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
        for i in range(len(words) - 7):
            if seen[tuple(words[i : i + 8])] > 1:
                covered.update(range(i, i + 8))
        return len(covered)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(quality_rules.repeated_words(common.words_of(F.col("t")))).collect()]
    assert got == [brute(t.split()) for t in texts]


def test_op10_boilerplate_goes_and_copies_stay(spark):
    rng = random.Random(1)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    menu = "\n".join(f"Menu entry {k} of this site here" for k in range(4))
    copied = own(60)
    rows = [(k, f"{menu}\n{own(3)}", "host") for k in range(20)] + [(k, f"{menu}\n{own(40)}", "host") for k in range(20, 40)]
    rows += [(k, copied, "host") for k in range(40, 60)] + [(k, f"{menu} \n{own(40)}", None) for k in range(60, 69)]
    docs = common.settle(spark.createDataFrame(rows, "doc_id long, text string, source string"), "menu")
    kept = {r.doc_id: r.text for r in quality_rules.keep_good(docs).collect()}
    assert set(kept) == set(range(20, 69))
    for k, t, h in rows[20:]:
        assert kept[k] == (t.split("\n")[-1] if k < 40 else t)


def test_op10_lines_of_every_length_and_host(spark, tmp_path):
    rng = random.Random(2)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    notice, other = own(35), own(60)
    texts = [f"{notice}\n{own(2)}" for _ in range(12)] + [f"{notice}\n{own(40)}"] * 3 + [f"{other}\n{own(50)}" for _ in range(12)] + [own(40) for _ in range(400)]
    rows = [(k, t, "hot") for k, t in enumerate(texts)] + [(1000 + k, f"{notice}\n{own(1)}", "cold") for k in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, str(tmp_path)).collect()}
    lines = Counter((h, x) for h, t in {(h, t) for _, t, h in rows} for x in set(t.split("\n")))
    for k, t, h in rows:
        n = sum(len(x.split()) for x in t.split("\n") if lines[h, x] >= 10)
        assert got[k].n_frequent == n and got[k].kept == (100 * (len(t.split()) - n) >= 30 * len(t.split()))
    assert {k for k in got if not got[k].kept} == set(range(12))


# -- 5 ---------------------------------------------------------------------------------------------
def test_op5_archives(spark):
    pages = [(1, "http://a/", "x" * 150), (2, None, "x" * 150), (3, "http://c/\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 60), (0, "u", "é" * 60), (6, "u", "é" * 60), (None, "u", "x" * 150)]
    df = common.settle(spark.createDataFrame(pages, "page_id long, url string, html string"), "pages")
    records = warc.write(df, common.scratch(spark, "warc"))
    got = warc.read(records).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter({(1, "response", None): 1, (2, "revisit", 1): 1, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (0, "response", None): 1, (6, "revisit", 0): 2, (None, "revisit", 1): 1})
    for r in got:
        html = next(h or "" for i, _, h in pages if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), sha(html))
        assert r.record_type == "revisit" or bytes(r.payload) == html.encode()
    fields, block = warc.lookup(records, 1)
    assert fields["WARC-Type"] == "response" and block.endswith(b"x" * 150)
    assert warc.lookup(records, 77) is None


def test_op5_bundles_are_plain_zstandard(spark, monkeypatch):
    import zstandard

    monkeypatch.setattr(warc, "FRAME", 500)
    monkeypatch.setattr(warc, "FRAMES", 3)
    batch = [(k, "u", f"page {k} ".encode() * 20, sha(f"page {k} " * 20), None, False) for k in range(40)]
    import pyarrow as pa

    class Context:
        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(warc.TaskContext, "get", lambda: Context)
    folder = common.scratch(spark, "bundles")
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*batch)], ["page_id", "url", "payload", "digest", "refers_to", "revisit"])
    places = [r for out in warc._write(folder)([b]) for r in out.to_pylist()]
    assert len({p["bundle"] for p in places}) > 1
    for p in places:
        fields, block = warc.Bundle(p["bundle"]).record(p["frame"], p["frame_offset"])
        assert fields["WARC-Record-ID"] == f"<urn:page:{p['page_id']}>" and block.endswith(batch[p["page_id"]][2])
    raw = warc.open_file(places[0]["bundle"]).read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == sum(p["bundle"] == places[0]["bundle"] for p in places)


def test_op5_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages, common.scratch(spark, "warc"))).count() == 0


# -- 6 ---------------------------------------------------------------------------------------------
def test_op6_against_the_library(spark):
    t = Tokenizer.from_file(queries.BYTE_BPE)
    expected = {}
    for d in table("documents"):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        expected[d["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r)[1:] for r in queries.op6(spark, SF).collect()} == expected


def test_op6_hard_texts():
    v, t, rng = bpe.vocabulary(queries.BYTE_BPE), Tokenizer.from_file(queries.BYTE_BPE), random.Random(8)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefghij") for _ in range(8000)), "a" * 399, "a" * 400, "ñ" * 250]
    for text, ids in zip(texts, v.encode_all(texts)):
        expected = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected and v.decode(ids) == t.decode(expected, skip_special_tokens=False)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert v.decode(np.array(ids)) == t.decode(ids, skip_special_tokens=False)


def test_op6_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    v, t = bpe.Vocabulary(queries.BYTE_BPE), Tokenizer.from_file(queries.BYTE_BPE)
    for d in table("documents")[:40]:
        assert v.encode(d["text"]).tolist() == t.encode(d["text"], add_special_tokens=False).ids


def test_op6_odd_rows(odd, empty):
    out = {r.row.doc_id: r for r in bpe.encoded(odd, queries.BYTE_BPE, decode=True).collect()}
    assert out[1].ids == [] and out[1].decoded == "" and out[9].decoded == ODD[-1][1] and 50256 in out[9].ids
    assert bpe.encoded(empty, queries.BYTE_BPE).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------
def test_op7_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [(0, [1.0, -0.5]), (0, [1.0, -0.5]), (20, [0.01, 2.0, 3.0]), (1, []), (2, None), (3, [nan, 1.0]), (4, [inf]), (5, [None, 1.0]), (None, [9.0, 9.0]), (6, [0.0, 0.0]), (7, [1.0, -0.5]), (40, [])]
    df = common.settle(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("id", "rid", "q", "x", "block", "score", "rank", "dim")}), "vec")
    rows = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = Counter()
    for a, (i, v) in enumerate(rows):
        if i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(rows) if b != a)[:3]
            expected.update((i, k + 1, j, -s) for k, (s, j) in enumerate(scored))
    got = Counter(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, k=3).collect())
    assert got == expected
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def block(m, by_component=True):
    """The rows of an array as a packed block, with row numbers as ids."""
    import pyarrow as pa

    n = np.arange(len(m))
    b = pa.RecordBatch.from_arrays([pa.array(n * 0, pa.int32()), pa.array(n), pa.array(n), pa.array(list(map(list, m)), pa.list_(pa.int64()))], ["block", "id", "rid", "q"])
    (out,) = [r for x in topk._pack(len(m), by_component)([b]) for r in x.to_pylist()]
    return topk.Block(*(out[c] for c in topk.NAMES))


@pytest.mark.parametrize("room", (1 << 25, 1))
def test_op7_blocks_and_scatter(spark, monkeypatch, room):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(common, "BROADCAST_BYTES", room)  # 1: every block of queries has a turn of its own
    rng = np.random.default_rng(2)
    x = np.where(rng.random((300, 12)) < 0.1, rng.normal(size=(300, 12)), 0.0)
    df = common.settle(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec")
    q = np.floor(64 * x).astype(np.int64)
    assert (topk.accumulate(q[:7].T, block(q)) == q @ q[:7].T).all()
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for i in range(0, 300, 20):
        s = q @ q[i]
        assert got[i] == [(int(j), int(s[j])) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:20]]


def test_op7_large_scores():
    big = np.array([[1 << 40, 1], [1 << 40, 0]], np.int64)
    scores = topk.accumulate(big.T, block(np.array([[1 << 20, 5], [1 << 20, 5], [-(1 << 20), 1]], np.int64))).T
    row, column = topk.select(scores, np.array([0, -1]), 2)
    assert sorted(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (1, 0), (1, 1)]


# -- 8 ---------------------------------------------------------------------------------------------
def groups(prints, ids):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for i, k in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


def plain_print(text):
    words = re.findall(WS, (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op8_against_all_pairs(spark):
    docs = table("documents")
    prints = [plain_print(d["text"]) for d in docs]
    roots = groups(prints, [d["doc_id"] for d in docs])
    expected = {d["doc_id"]: (f"{p:016x}", r) for d, p, r in zip(docs, prints, roots)}
    assert {r[0]: tuple(r)[1:] for r in queries.op8(spark, SF).collect()} == expected


def test_op8_crowded_buckets(spark):
    """Chains, stars and a dense ball of fingerprints, far more than two to a bucket."""
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1, 1 << 63}
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(32), rng.randint(0, 4))) for _ in range(300)}
    x = rng.getrandbits(64)
    for _ in range(60):
        prints.add(x)
        x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    prints |= {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(common.settle(spark.createDataFrame([(s,) for s in signed], "fp long"), "fps"))
    pairs = {(r.a, r.b) for r in edges.collect()}
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in pairs)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    expected = groups(prints, signed)
    merged = defaultdict(set)
    for s, g in zip(signed, expected):
        merged[g].add(s)
    for members in merged.values():
        assert len({roots.get(s, s) for s in members}) == 1
    assert len({roots.get(s, s) for s in signed}) == len(merged)


def test_op8_odd_rows(odd, empty):
    got = Counter((r.row.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect())
    prints = [plain_print(d[1]) for d in ODD]
    expected = Counter((d[0], p - (1 << 64) if p >> 63 else p, g) for d, p, g in zip(ODD, prints, groups(prints, [d[0] for d in ODD])))
    assert got == expected
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(groups(prints, [d[0] for d in ODD])))
    assert simhash.one_of_each(empty).count() == 0


def test_op8_null_and_equal_ids_keep_different_texts(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, t) for t in texts[:3]] + [(7, t) for t in texts[3:]] + [(None, texts[0]), (7, texts[3]), (8, texts[4])]
    docs = common.settle(spark.createDataFrame(rows, "doc_id long, text string"), "equal-ids")
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()]
    assert Counter(kept) == Counter([(None, t) for t in texts[:3]] + [(7, t) for t in texts[3:]])


def test_components_of_a_long_chain(spark):
    n = 500
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)], "a long, b long")
    out = components.components(edges).collect()
    assert {r.node for r in out} == set(range(n)) and {r.root for r in out} == {0}


# -- 9 ---------------------------------------------------------------------------------------------
def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = queries.op9(spark, sf).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= 0.97


def test_op9_learns_from_training_rows_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = queries._held_out
    turned = labels.withColumn("quality", F.when(held(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.row.doc_id: round(r.score, 9) for r in quality_model.score(docs, x, held(F.col("key"))).collect()} for x in (labels, turned))
    assert a == b


def test_op9_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 0), (4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    out = quality_model.score(odd, labels, F.lit(False)).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert all(abs(r.score - 0.5) < 1e-3 for r in quality_model.score(odd, none, F.lit(False)).collect())
    assert all(r.score > 0.99 for r in quality_model.score(odd, labels.where("quality = 1"), F.lit(False)).collect())
    assert quality_model.score(empty, labels, F.lit(False)).count() == 0


def test_isotonic_pools():
    at, to = quality_model.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 2, 1, 4]), np.array([1.0, 2, 2, 4]))
    assert to.tolist() == [0.0, 0.75, 1.0] and at.tolist() == [1.0, 2.5, 4.0]


# -- row identity -------------------------------------------------------------------------------------
ROW_OPERATORS = {
    "mixed": lambda d: mixing.mixed(d),
    "keep_good": lambda d: quality_rules.keep_good(d),
    "one_of_each": lambda d: simhash.one_of_each(d),
    "marked": lambda d: warc.marked(d, key="doc_id", url="source", html="text").drop("payload"),
    "deduped": lambda d: line_dedup.deduped(d),
    "remove_repeats": lambda d: suffix_dedup.remove_repeats(d).select("row.doc_id", "n_removed", F.sha2("kept", 256)),
}


@pytest.mark.parametrize("name", sorted(ROW_OPERATORS))
def test_rows_survive_another_split_of_the_files(spark, tmp_path, name):
    """How files are dealt to tasks depends on the cores connected. Between call and action they change."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3, "doc_id").write.parquet(f"{tmp_path}/d")
    run = lambda: ROW_OPERATORS[name](spark.read.parquet(f"{tmp_path}/d"))
    key = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(key, "7")
        first = Counter(map(repr, run().collect()))
        again = run()
        spark.conf.set(key, "1")
        assert Counter(map(repr, again.collect())) == first and first
    finally:
        spark.conf.unset(key)


# -- pipeline ---------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    """Every stage against brute force on what its predecessor kept."""
    docs = common.documents(spark, SF)
    columns, frames = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(common.settle(stage(spark, frames[-1], SF), name))
        assert k + 1 == len(corpus_pipeline.STAGES) or frames[-1].columns == columns
    start, good, lines, single, mix, out = ([r.asDict() for r in f.collect()] for f in frames)
    bad = {r.row.doc_id for r in quality_rules.verdicts(docs).where("NOT kept").collect()}
    assert {d["doc_id"] for d in good} == {d["doc_id"] for d in start} - bad and 0 < len(good) < len(start)
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOW)
    hosts = Counter((h, k) for h, t in {(d["source"], d["text"] or "") for d in start} for k in {key(x) for x in t.split("\n")} if k)
    whole = {d["doc_id"]: (d["text"], d["source"]) for d in start}
    for d in good:
        text, host = whole[d["doc_id"]]
        assert d["text"] == "\n".join(x for x in text.split("\n") if hosts[host, key(x)] < quality_rules.MIN_DOCS)
    seen = Counter(k for d in good for k in {key(x) for x in d["text"].split("\n")} if k)
    left = {d["doc_id"]: "\n".join(x for x in d["text"].split("\n") if seen[key(x)] < line_dedup.MIN_DOCS) for d in good}
    assert {d["doc_id"]: d["text"] for d in lines} == left and all(d["n_chars"] == len(d["text"]) for d in lines)
    prints = [plain_print(d["text"]) for d in lines]
    assert {d["doc_id"] for d in single} == set(groups(prints, [d["doc_id"] for d in lines]))
    copies = {r.doc_id: r.copies for r in mixing.mix(frames[3]).collect()}
    assert Counter(d["doc_id"] for d in mix) == Counter({k: n for k, n in copies.items() if n})
    t = Tokenizer.from_file(queries.BYTE_BPE)
    texts = {d["doc_id"]: d["text"] for d in mix}
    assert Counter(d["doc_id"] for d in out) == Counter(d["doc_id"] for d in mix)
    for d in out:
        assert d["text"] == texts[d["doc_id"]] and d["ids"] == t.encode(d["text"], add_special_tokens=False).ids and d["n_tokens"] == len(d["ids"])


def test_pipeline_odd_rows(spark, odd, empty):
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = common.settle(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_pipeline_runs(spark):
    df = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids", "n_tokens"} <= set(df.columns) and df.count() > 0
    assert public_tokenizers.path("byte_bpe_50k.json") == corpus_pipeline.VOCABULARY
