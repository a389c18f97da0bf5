"""Learning, matching, surrogates, and whole runs."""

import re

import pytest
from pyspark.sql import functions as F

from quillmask import queries
from quillmask.functions import lexicons as L
from quillmask.operators import evalkit, learn, surrogates
from quillmask.operators.match import alias_spans, place_spans
from quillmask.plans.engine import Engine, as_blocks
from quillmask.policy import Policy
from quillmask.udtf import _luhn

BLOCKS = "doc_id string, block_id int, part string, section string, text string"


def blocks(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, k, "body", "", t) for k, t in enumerate(texts)], BLOCKS)


def decided(spark, found, words=None, policy=None):
    """The lexicon of candidates (kind, name, source, n, place, short) as {kind: {key: name}} and rows."""
    names = spark.createDataFrame([("d", k, n, s, c, p, short) for k, n, s, c, p, short in found], "doc_id string, kind string, name string, source string, n long, place long, short string")
    counts = spark.createDataFrame([("d", w, n) for w, n in (words or {}).items()], "doc_id string, word string, n long")
    rows = learn.decide(names, counts, policy).collect()
    out = {}
    for r in rows:
        out.setdefault(r.kind, {})[r.alias if r.kind.startswith("ALIAS") else r.key] = r.key if r.kind.startswith("ALIAS") else r.reason or r.name
    return out


def lexicon(spark, texts, words=None, policy=None):
    return decided(spark, [(k, n, s, 1, i, short) for i, t in enumerate(texts) for k, n, s, short in learn.candidates(t)], words, policy)


def test_person_and_company_grammar():
    assert learn.is_person("Rupa K. Sample") and not learn.is_person("Offer Price") and not learn.is_person("Acme Limited") and not learn.is_person("Ana")
    assert learn.is_company("Acme Trading Limited") and not learn.is_company("Companies Act") and not learn.is_company("Reserve Bank of India")
    assert learn.is_company("Reserve Bank of India", institutions_too=True)


def test_prose_words_reject_names(spark):
    x = lexicon(spark, ["Mr. Plain Committee is our chair."], {"committee": 5})
    assert "PERSON" not in x and list(x["REJECTED:PERSON"].values()) == ["contains a word the document uses in prose"]


def test_trailing_common_words_are_trimmed(spark):
    x = lexicon(spark, ["contact person: Anand Soni Website"], {"website": 4})
    assert list(x["PERSON"]) == ["anand soni"]


def test_company_after_a_connective(spark):
    x = lexicon(spark, ["Rashi Patil of Sunrise Textiles Private Limited signed."])
    assert list(x["ORG"]) == ["sunrise textiles private limited"]


def test_names_that_become_one(spark):
    """A trimmed name joins the entity that has it already; noise in front of a company goes."""
    found = [("PERSON", "Anand Soni Website", "title", 2, 0, ""), ("PERSON", "Anand Soni", "being", 1, 5, ""), ("PERSON", "Website Portal ABC", "title", 1, 1, "")]
    found += [("ORG", "Registered Office of our Company KSH Trading Limited", "legal-suffix", 1, 2, ""), ("ORG", "Bank of Baroda Limited", "legal-suffix", 1, 3, "BoB Bank")]
    x = decided(spark, found, {"website": 4})
    assert x["PERSON"] == {"anand soni": "Anand Soni"}
    assert set(x["ORG"]) == {"ksh trading limited", "bank of baroda limited"} or set(x["ORG"]) == {"ksh trading limited", "baroda limited"}
    assert x["ALIAS:PERSON"]["a. soni"] == "anand soni"


def test_places(spark):
    bad = ["the Cap Price", "Designated RTA", "India", "N.A", "USD", "Kenya", "Deccan Big Old Hill", "Mill 4"]
    found = [("PLACE", p, "address", 1, k, "") for k, p in enumerate(bad)]
    assert "PLACE" not in decided(spark, found)
    good = [("PLACE", "our Supa Facility", "address", 1, 0, ""), ("PLACE", "Supa", "address", 1, 1, ""), ("PLACE", "Rupa Kamal Sample", "address", 1, 2, ""), ("PLACE", "Refund Bank", "address", 1, 3, "")]
    x = decided(spark, good, {"refund": 1})
    assert x["PLACE"] == {"supa": "Supa"} and list(x["PERSON"]) == ["rupa kamal sample"]


def test_taggers_are_doubted(spark):
    found = [("NER_PLACE", "Ana Town", "ner", 1, 0, ""), ("PLACE", "Ana Town", "ner", 1, 0, ""), ("PERSON", "Ana Town", "ner", 1, 1, ""), ("ORG", "Blue Thing", "ner", 2, 2, ""), ("ORG", "Acme XYZ", "ner", 5, 3, ""), ("ORG", "Zenvale Works", "ner", 3, 4, "")]
    x = decided(spark, found)
    assert set(x["REJECTED:PERSON"].values()) == {"place name"} and set(x["REJECTED:ORG"].values()) == {"unconfirmed NER company", "acronym pair, not a company name"}
    assert list(x["ORG"]) == ["zenvale works"] and x["PLACE"] == {"ana town": "Ana Town"}


def test_manual_terms_are_never_rejected(spark):
    x = decided(spark, [("PERSON", "Zed", "manual", 1, 0, ""), ("ORG", "acme", "manual", 1, 0, "")], {"zed": 9})
    assert "zed" in x["PERSON"] and "acme" in x["ORG"] and x["ALIAS:PERSON"]["zed"] == "zed" and x["ALIAS:ORG"]["acme"] == "acme"


def test_surname_shared_by_two_has_one_owner(spark):
    x = lexicon(spark, ["Mr. Arun Hegdewal is our chair.", "Ms. Mira Hegdewal is our auditor of the trust."])
    assert x["ALIAS:PERSON"]["hegdewal"] == "arun hegdewal"


def test_places_of_an_address():
    assert learn._places_of("Gat No. 11/3, Village Birchdale, Chakan Taluka, Norvale – 411 999, near Old Mill 4") == ["Norvale", "Birchdale", "Chakan", "Norvale"]
    assert learn._company("as Foo Ltd") == "Foo Ltd" and learn._company("all lower") == ""


def test_gate_for_taggers():
    gate = lambda text, kind, words=None: learn.accepts(set(), set(), {"known"}, {"supa"}, words or {}, text, kind, Policy())
    assert gate("Known", "ORG") and gate("Rupa Sample", "PERSON") and not gate("Supa", "PERSON") and not gate("Rupa ABC", "PERSON")
    assert not gate("Rupa Sample", "PERSON", {"sample": 3}) and gate("Acme Limited", "ORG") and not gate("Acme", "ORG") and not gate("SEBI", "ORG")


def test_alias_matching_rules():
    table = {"zenvale": "ORG", "bo lux": "PERSON", "ksh": "ORG"}
    text = "ZENVALE, zenvale, xZenvale, Zenvale@x, BoLux and Mr. Ana B. Bo Lux; KSH ksh"
    got = [(text[a:b], k) for a, b, k, _, _ in alias_spans(text, table)]
    assert sorted(got) == sorted([("ZENVALE", "ORG"), ("Zenvale", "ORG"), ("Ana B. Bo Lux", "PERSON"), ("KSH", "ORG"), ("KSH", "ORG")])
    text = "Mr Bo Lux, A B. C. Dee Bo Lux, Smt. Ana Bo Lux"
    assert [text[a:b] for a, b, *_ in alias_spans(text, {"bo lux": "PERSON"})] == ["Bo Lux", "B. C. Dee Bo Lux", "Ana Bo Lux"]


def test_places_take_their_code():
    text = "in Supa – 411 045 and supa"
    assert [text[a:b] for a, b, *_ in place_spans(text, ("Supa",))] == ["Supa – 411 045"]


def test_surrogate_properties(spark):
    values = ["4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    one, two = (df.select("v", surrogates.card(F.col("v"), 7).alias("r")).collect() for _ in range(2))
    assert one == two
    for r in one:
        assert _luhn(re.sub(r"\D", "", r.r)) and re.sub(r"\d", "0", r.r) == re.sub(r"\d", "0", r.v) and r.r[0] == "4"
    p = spark.createDataFrame([("+91 (20) 4505-3237",), ("415-555-0132",)], "v string").select("v", surrogates.phone(F.col("v"), 7).alias("r")).collect()
    assert all(re.sub(r"\d", "0", r.r) == re.sub(r"\d", "0", r.v) for r in p) and p[0].r.startswith("+91")
    s = spark.createDataFrame([("AB12-cdÉ",)], "v string").select(surrogates.shape(F.col("v"), 7).alias("r")).first().r
    assert re.fullmatch(r"[A-Z]{2}\d{2}-[a-z]{2}[A-Z]", s)
    assert spark.range(1).select(surrogates.ssn(F.lit("123-45-6789"), 7)).first()[0][:3] not in ("000", "666")


def test_seed_changes_values(spark):
    a, b = (spark.range(1).select(surrogates.phone(F.lit("415-555-0132"), s)).first()[0] for s in (1, 2))
    assert a != b


def test_dob_keeps_its_format(spark):
    df = spark.createDataFrame([("06/05/1988",), ("6-5-88",), ("14 March 1988",), ("March 4, 1990",)], "v string")
    got = [r[0] for r in df.select(surrogates.dob(F.col("v"), 7)).collect()]
    for value, shape in zip(got, (r"\d\d/\d\d/\d{4}", r"\d\d-\d\d-\d{4}", r"\d\d [A-Z]\w+ \d{4}", r"[A-Z]\w+ \d{1,2}, \d{4}")):
        assert re.fullmatch(shape, value)


def test_companies_and_places_never_share_a_surrogate(spark):
    rows = [("d", "ORG", f"acme{k} limited", f"Acme{k} Limited", None, 1, ["x"], None) for k in range(400)]
    rows += [("d", "PLACE", f"town{k}", f"Town{k}", None, 1, ["x"], None) for k in range(300)]
    lex = spark.createDataFrame(rows, learn.LEXICON)
    assert surrogates.org_names(lex, 1).select("core").distinct().count() == 400
    assert surrogates.place_names(lex, 1).select("fake").distinct().count() == 300


def test_invented_regions_are_no_states():
    assert not {r.lower() for r in L.REGIONS} & L.STATES


def test_run_is_consistent_and_leaves_nothing(spark):
    text = queries._STORY + ["Write to arjun.testwalla@zenvale.com or see https://www.zenvale.com/u/testwalla?x=1", "Paid with 4111 1111 1111 1111."]
    one, two = (Engine().run(blocks(spark, *text).repartition(n, "block_id")) for n in (1, 3))
    out = [{r.block_id: r.redacted for r in x["redacted"].collect()} for x in (one, two)]
    assert out[0] == out[1]
    assert evalkit.leaks(one["mapping"], one["redacted"]).count() == 0
    whole = "\n".join(out[0].values())
    assert not re.search(r"(?i)testwalla|zenvale|4111 1111|\bLux\b", whole)
    m = {(r.label, r.original): r.replacement for r in one["mapping"].collect()}
    surname = m["PERSON", "Arjun Testwalla"].split()[-1]
    assert m["PERSON", "TESTWALLA"] == surname.upper() and surname.lower() in m["EMAIL", "arjun.testwalla@zenvale.com"]
    assert m["EMAIL", "arjun.testwalla@zenvale.com"].endswith(".example.com") and f"/u/{surname.lower()}" in m["URL", "https://www.zenvale.com/u/testwalla?x=1"]
    report = one["report"].first()
    assert report.detections == one["audit"].count() and report.by_type[0].n >= report.by_type[-1].n


def test_documents_are_isolated(spark):
    a = blocks(spark, "Mr. Arjun Testwalla is our treasurer.", doc="a")
    b = blocks(spark, "Payment by Testwalla.", doc="b")
    both = a.unionByName(b)
    assert Engine().run(both)["audit"].where("doc_id = 'b'").count() == 0
    shared = Engine().run(both.withColumn("corpus", F.lit("all")).withColumn("block_id", F.when(F.col("doc_id") == "b", 1).otherwise(0)), scope="corpus")
    assert shared["audit"].count() == 2


def test_tagger_plugs_in(spark):
    def tagger(batches):
        import pandas as pd

        for texts in batches:
            yield pd.Series([[{"start": 0, "end": 10, "label": "PERSON", "text": t[:10]}] if t.startswith("Oona Quist") else [] for t in texts])

    from collections.abc import Iterator

    import pandas as pd

    tagger.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    x = Engine(Policy(tagger=tagger)).run(blocks(spark, "Oona Quist signed.", "We thank Quist and others."))
    assert [r.original for r in x["audit"].orderBy("block").collect()] == ["Oona Quist", "Quist"]


def test_policy_refuses_what_it_does_not_know():
    with pytest.raises(ValueError):
        Policy(labels=("SHOE_SIZE",))
    with pytest.raises(ValueError):
        Policy(mode="blur")


def test_empty_and_null_blocks(spark):
    empty = spark.createDataFrame([], BLOCKS)
    assert Engine().run(empty)["redacted"].count() == 0
    df = spark.createDataFrame([("d", 0, "body", None, None), ("d", 1, "body", "", "")], BLOCKS)
    assert Engine().run(df)["audit"].count() == 0
    assert as_blocks(spark.createDataFrame([(1, None), (2, "a\nb")], "doc_id int, text string")).count() == 3


def test_gold_spans_take_free_places():
    assert evalkit.gold_spans("Ana met  Ana", [["PERSON", "Ana"], ["PERSON", "Ana"]]) == [(0, 3, "PERSON", "Ana"), (9, 12, "PERSON", "Ana")]
    with pytest.raises(ValueError):
        evalkit.gold_spans("Ana", [["PERSON", "Bo"]])


def test_reidentification_counts_whole_words(spark):
    terms = spark.createDataFrame([("CRITICAL", "street", "Larkspur Court"), ("HIGH", "x", "a.b")], "severity string, anchor string, term string")
    texts = spark.createDataFrame([("at LARKSPUR  court. Larkspur Courts a.b axb",)], "text string")
    out = evalkit.reidentification(terms, texts)
    assert {r.term: r.hits for r in out.collect() if r.term} == {"Larkspur Court": 1, "a.b": 1}
    assert evalkit.blocking(out).first().blocking == 2


def test_leaks_are_found(spark):
    mapping = spark.createDataFrame([("d", "ORG", "Acme (North) Ltd.", "x"), ("d", "ORG", "abc", "y")], "doc_id string, label string, original string, replacement string")
    out = spark.createDataFrame([("d", "still Acme  (North)\tLtd. here"), ("e", "Acme (North) Ltd.")], "doc_id string, redacted string")
    found = evalkit.leaks(mapping, out)
    assert [(r.original, r.occurrences) for r in found.collect()] == [("Acme (North) Ltd.", 1)]
    assert tuple(evalkit.leak_summary(mapping, found).first()) == (1, 1, 1.0)


def test_prf_of_nothing_is_one(spark):
    r = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "tp int, fp int, fn int").select(*[v.alias(k) for k, v in evalkit.prf(F.col("tp"), F.col("fp"), F.col("fn")).items()]).collect()
    assert tuple(r[0]) == (1.0, 1.0, 1.0) and tuple(r[1]) == (0.0, 0.0, 0.0)
