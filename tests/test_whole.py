"""Queries over all rows, with all detectors, against brute force on small tables."""

import random
import re
from collections import Counter

from quillmask import queries as core


def documents(spark, folder, *texts, lang="en"):
    rows = [(k, t, lang if k % 2 else "de", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_token_accuracy_of_long_texts(spark, tmp_path):
    rng = random.Random(5)
    bits = ["plain", "ana@acme.org", "(ana@acme.org),x", "+91 98765 43210", "212-555-0147", "10.0.12.7", "é\U0001f600", "4111 1111 1111 1111", "\u00a0", "\n"]
    texts = ["", " ", None, *[" ".join(rng.choice(bits) for _ in range(n)) for n in (3, 40, 150, 2500, 6000)]]
    sf = documents(spark, tmp_path, *texts)
    got = {r.doc_id: (r.correct, r.total) for r in core.QUERIES["token_accuracy"](spark, sf).collect()}
    expected = {}
    for r in core._judged(spark, sf).where("text IS NOT NULL").collect():
        tokens = [m.span() for m in re.finditer(r"\S+", r.text)]
        hit = lambda spans, t: any(s.start < t[1] and t[0] < s.end for s in spans)
        marks = [0] * (len(r.text) + 1)
        for bit, spans in ((1, r.predicted), (2, r.gold)):
            for s in spans:
                for k in range(s.start, s.end):
                    marks[k] |= bit
        seen = [{b for k in range(*t) for b in (1, 2) if marks[k] & b} for t in tokens]
        if tokens:
            expected[r.doc_id] = (sum((1 in x) == (2 in x) for x in seen), len(tokens))
            assert len(tokens) > 500 or [hit(r.predicted, t) for t in tokens] == [1 in x for x in seen]
    assert got == expected and any(c < n for c, n in got.values()) and max(len(t or "") for t in texts) > 40_000


def test_words_and_terms_of_all_documents(spark, tmp_path):
    texts = ["die license license", "the license’s café café café naïve", "License: élan vital ana@license.org http://the.example", None, "wort wort wort and the élan"]
    sf = documents(spark, tmp_path, *texts)
    plain = [re.sub(r"\S+@\S+|https?://\S+|www\.\S+", " ", t or "") for t in texts]
    words = Counter((k, w) for k, t in enumerate(plain) for w in re.findall(r"\b[a-z][a-z'\-]{2,}\b", t))
    assert {(r.doc_id, r.word): r.n for r in core.QUERIES["vocab_counts"](spark, sf).collect()} == words
    assert {tuple(r) for r in core.QUERIES["common_words"](spark, sf).collect()} == {(w, 1, n) for (_, w), n in words.items() if n >= 3}
    hits = {t: sum(len(re.findall(rf"\b{t}\b", x or "", re.I)) for x in texts) for t in ("the", "and the", "sh", "zzz zzz", "license")}
    assert {r.term: r.hits for r in core.QUERIES["reid_audit"](spark, sf).collect() if r.term} == hits and hits["license"] == 5


VALUES = {
    "EMAIL": "ana@acme.org", "URL": "https://acme.org/x", "PHONE": "+91 98765 43210", "CREDIT_CARD": "4111 1111 1111 1111", "IP_ADDRESS": "10.0.12.7",
    "SSN": "123-45-6789", "DOB": "14 March 1988",
}
LINES = ["Mail {EMAIL} now", "see {URL} there", "call {PHONE} now", "card {CREDIT_CARD} ok", "host {IP_ADDRESS} up", "SSN {SSN} here", "Date of birth: {DOB}."]


def test_mapping_and_audit_have_every_label(spark, tmp_path):
    text = "\n".join(LINES).format(**VALUES)
    sf = documents(spark, tmp_path, text, "nothing here", text + "\n" + text)
    mapping = core.QUERIES["mapping_table"](spark, sf).collect()
    assert {(r.doc_id, r.label, r.original) for r in mapping} == {(k, label, v) for k in (0, 2) for label, v in VALUES.items()}
    new = {(r.doc_id, r.label): r.replacement for r in mapping}
    assert all(v and v != VALUES[label] for (_, label), v in new.items()) and len(mapping) == len(new)
    places = [(k, label, m.start(), v) for k, t in ((0, text), (2, text + "\n" + text)) for label, v in VALUES.items() for m in re.finditer(re.escape(v), t)]
    audit = core.QUERIES["detection_audit"](spark, sf).collect()
    assert sorted((r.doc_id, r.label, r.start, r.original) for r in audit) == sorted(places)
    assert all(r.find_in_output == new[r.doc_id, r.label][:60] for r in audit)


def test_nothing_that_a_detector_knows_stays(spark, tmp_path):
    text = "\n".join(LINES).format(**VALUES)
    sf = documents(spark, tmp_path, text, "nothing here", text)
    run = lambda name: core.QUERIES[name](spark, sf).collect()
    tagged = "\n".join(LINES).format(**{k: f"[{k}_1]" for k in VALUES})
    assert {r.doc_id: r.redacted for r in run("redact_tag")} == {0: tagged, 1: "nothing here", 2: tagged}
    assert {(r.doc_id, r.tag) for r in run("tag_numbers")} == {(k, f"[{v}_1]") for k in (0, 2) for v in VALUES}
    assert {(r.doc_id, r.label, r.value) for r in run("detect_all_merged")} == {(k, label, v) for k in (0, 2) for label, v in VALUES.items()}
    assert {(r.label, r.n, r.n_docs) for r in run("detections_by_label")} == {(v, 2, 2) for v in VALUES}
    fake = {r.doc_id: r.redacted for r in run("redact_fake")}
    assert fake[1] == "nothing here" and not any(v in fake[k] for k in (0, 2) for v in VALUES.values())
    assert run("leak_check_whole_run") == []
