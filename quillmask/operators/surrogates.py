"""Consistent invented values, as columns.

A value is drawn from a pool by the SHA-256 of its kind and normal form plus the policy's
seed, so equal inputs give equal outputs on every executor without any state. What must be
different for different originals of a document (companies, places) gets ranks of a window
over the few originals that drew the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.checks import digits, luhn_digit
from ..functions.spans import let
from ..functions.text import normalise, squeeze
from ..policy import Policy

SEP = "␟"

# Usual spellings of company endings, and cues of an Indian address.
SUFFIXES = {
    "limited": "Limited", "private limited": "Private Limited", "ltd": "Ltd", "ltd.": "Ltd.", "llp": "LLP", "inc": "Inc", "inc.": "Inc.",
    "incorporated": "Incorporated", "corporation": "Corporation", "corp": "Corp", "corp.": "Corp.", "plc": "PLC", "gmbh": "GmbH",
    "company": "Company", "chartered accountants": "Chartered Accountants",
}
SUFFIX = r"(?iU)\s+(private\s+limited|limited|ltd\.?|llp|inc\.?|incorporated|corporation|corp\.?|plc|gmbh|company|chartered\s+accountants)$"
INDIAN_CUE = r"(?iU)india|maharashtra|karnataka|gujarat|pune|mumbai|delhi|bengaluru|\bgat\b|village|taluka|tehsil|\bmarg\b|nagar|\bs\.?\s*no\b|\b\d{3}\s?\d{3}\b"
PIN_TAIL = r"(?U)(\s*[–—-]?\s*)(\d{3}\s?\d{3})\s*$"


def _hex(seed: int, *parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(SEP, F.lit(str(seed)), *cols), 256)


def _number(hex_: Column, at: int = 1, n: int = 12) -> Column:
    return F.conv(F.substring(hex_, at, n), 16, 10).cast("long")


def pick(pool, hex_: Column, at: int = 1) -> Column:
    """One of a pool."""
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (_number(hex_, at) % len(pool) + 1).cast("int"))


def _digit(hex_: Column, k: Column) -> Column:
    """The k-th digit (from 0) of a stream of 32 that repeats."""
    return (F.conv(hex_.substr((k % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") % 10).cast("string")


def _by_char(text: Column, body) -> Column:
    """body(character, how many digits come before it) for every character, joined."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: body(c, F.length(digits(F.substring(text, F.lit(1), i))), i)), "")


_IS_DIGIT = r"^\d$"


def phone(text: Column, seed: int) -> Column:
    """Every digit anew, the layout kept; after a plus sign the first two digits stay."""
    keep = F.ltrim(text).startswith("+")
    return let(
        _hex(seed, "phone", digits(text)),
        lambda h: _by_char(text, lambda c, k, _: F.when(c.rlike(_IS_DIGIT), F.when(keep & (k < 2), c).otherwise(_digit(h, k))).otherwise(c)),
    )


def card(text: Column, seed: int) -> Column:
    """As many digits in the same groups, a leading 4, and a valid check digit."""
    n = F.length(digits(text))
    body = let(
        _hex(seed, "cc", digits(text)),
        lambda h: F.concat(F.lit("4"), F.array_join(F.transform(F.sequence(F.lit(0), n - 3), lambda k: _digit(h, k)), "")),
    )
    full = let(body, lambda b: F.concat(b, luhn_digit(b).cast("string")))
    return let(full, lambda f: _by_char(text, lambda c, k, _: F.when(c.rlike(_IS_DIGIT), f.substr(k + 1, F.lit(1))).otherwise(c)))


def ssn(text: Column, seed: int) -> Column:
    """Never 000, 666 or 9xx, never 00 or 0000: the parts are drawn from valid ranges."""
    return let(
        _hex(seed, "ssn", text),
        lambda h: F.format_string("%03d-%02d-%04d", 1 + _number(h, 1, 8) % 665, 1 + _number(h, 9, 8) % 99, 1 + _number(h, 17, 8) % 9999),
    )


def ip(text: Column, seed: int) -> Column:
    h = _hex(seed, "ip", text)
    v4 = let(h, lambda x: F.concat_ws(".", F.lit("10"), *[(_number(x, a, 4) % 256).cast("string") for a in (1, 5, 9)]))
    v6 = let(h, lambda x: F.concat(F.lit("fd00:"), F.array_join(F.array(*[F.substring(x, a, 4) for a in range(1, 28, 4)]), ":")))
    return F.when(text.contains(":"), v6).otherwise(v4)


def shape(text: Column, seed: int) -> Column:
    """Digits for digits, letters for letters of the same case (never I or O), the rest kept."""
    letters = F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ")

    def one(h: Column, c: Column, i: Column) -> Column:
        v = F.conv(h.substr((i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        letter = letters.substr(v % 24 + 1, F.lit(1))
        return F.when(c.rlike(_IS_DIGIT), (v % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), letter).when(c.rlike(r"^\p{L}$"), F.lower(letter)).otherwise(c)

    return let(_hex(seed, "shape", text), lambda h: _by_char(text, lambda c, _, i: one(h, c, i)))


def dob(text: Column, seed: int) -> Column:
    """A birthday 25 to 75 years before a fixed day, written as the original is."""
    day = let(_hex(seed, "dob", normalise(text)), lambda h: F.date_sub(F.lit("2025-01-01").cast("date"), (25 * 365 + _number(h) % (50 * 365)).cast("int")))
    numeric = F.when(text.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd-MM-yyyy"))
    return F.when(text.rlike(r"^\d{1,2}[/-]"), numeric).when(text.rlike(r"^\d"), F.date_format(day, "dd MMMM yyyy")).otherwise(F.date_format(day, "MMMM d, yyyy"))


def address(text: Column, seed: int, indian: Column) -> Column:
    compact = squeeze(text)
    here = compact.rlike(INDIAN_CUE) | indian
    state = r"(?iU)\b(?:" + "|".join(sorted(L.STATES)) + r")\b"

    def home(h: Column) -> Column:
        line = F.format_string(
            "%d, %s %s, %s, %s – %d %03d",
            1 + _number(h, 1, 6) % 400, pick(L.STREETS, h, 7), pick(("Road", "Marg", "Lane"), h, 11), pick(L.LOCALITIES[:6], h, 15),
            pick(L.LOCALITIES[6:], h, 19), 110 + _number(h, 23, 6) % 590, 100 + _number(h, 29, 6) % 900,
        )
        region = F.when(compact.rlike(state), F.concat(F.lit(", "), pick(L.REGIONS, h, 33))).otherwise(F.lit(""))
        return F.concat(line, region, F.when(compact.rlike(r"(?iU)\bindia\b"), F.lit(", India")).otherwise(F.lit("")))

    def abroad(h: Column) -> Column:
        return F.format_string(
            "%d %s %s, %s, %s %d",
            10 + _number(h, 1, 6) % 9790, pick(L.STREETS, h, 7), pick(("Street", "Avenue", "Drive"), h, 11), pick(L.LOCALITIES, h, 15),
            pick(("QX", "QZ", "XQ", "ZX"), h, 19), 10000 + _number(h, 23, 6) % 90000,
        )

    return let(_hex(seed, "address", normalise(compact)), lambda h: F.when(here, home(h)).otherwise(abroad(h)))


def first_name(token: Column, seed: int) -> Column:
    return pick(L.FIRST_NAMES, _hex(seed, "first", F.lower(token)))


def surname(token: Column, seed: int) -> Column:
    return pick(L.SURNAMES, _hex(seed, "last", F.lower(token)))


def person(text: Column, seed: int, surnames: Column, firsts: Column) -> Column:
    """Word by word: known surnames and given names keep their invented ones, initials stay
    initials, capitals stay capitals."""
    words = F.split(squeeze(text), " ")

    def one(ws: Column, w: Column, i: Column) -> Column:
        bare = F.lower(F.btrim(w, F.lit(".,")))
        last = (i == F.size(ws) - 1) & (F.size(ws) > 1)
        initial = F.length(bare) == 1
        fake = (
            F.when(initial, F.concat(F.substring(first_name(bare, seed), 1, 1), F.lit(".")))
            .when(F.array_contains(surnames, bare), surname(bare, seed))
            .when(F.array_contains(firsts, bare), first_name(bare, seed))
            .when(last, surname(bare, seed))
            .otherwise(first_name(bare, seed))
        )
        return F.when((F.upper(w) == w) & (F.lower(w) != w), F.upper(fake)).otherwise(fake)

    return let(words, lambda ws: F.array_join(F.transform(ws, lambda w, i: one(ws, w, i)), " "))


def _slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def domain_slug(root: Column, seed: int, domains: Column) -> Column:
    """The invented domain of a host's root: its company's, or one of its own."""
    own = let(_hex(seed, "domain", root), lambda h: F.substring(_slug(F.concat(pick(L.ORG_HEADS, h), pick(L.ORG_TAILS, h, 13))), 1, 14))
    return F.coalesce(F.element_at(domains, _slug(root)), own)


def _root(host: Column) -> Column:
    """The first label of a host, without the last."""
    return F.split(F.regexp_replace(host, r"\.[^.]*$", ""), r"\.")[0]


def email(text: Column, seed: int, surnames: Column, firsts: Column, domains: Column) -> Column:
    local, host = F.split(text, "@")[0], F.lower(F.split(text, "@")[1])
    free = host.isin(*sorted(L.FREE_MAIL))

    def part(p: Column) -> Column:
        bare = F.lower(p)
        number = lambda run: let(_hex(seed, "num", run), lambda h: (1 + _number(h) % 99).cast("string"))
        runs = F.regexp_extract_all(bare, F.lit(r"\d+|\D+"), F.lit(0))
        renumbered = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(x)), "")
        role = bare.isin(*sorted(L.ROLE_MAILBOXES)) | ~bare.rlike(r"(?U)^\p{L}+$") | (F.length(bare) <= 2)
        return (
            F.when(p.rlike(r"^[._\-]$"), p)
            .when(F.array_contains(surnames, bare), F.lower(surname(bare, seed)))
            .when(F.array_contains(firsts, bare), F.lower(first_name(bare, seed)))
            .when(F.element_at(domains, bare).isNotNull(), F.element_at(domains, bare))
            .when(role, renumbered)
            .otherwise(F.lower(first_name(bare, seed)))
        )

    parts = F.regexp_extract_all(local, F.lit(r"[._\-]|[^._\-]+"), F.lit(0))
    where = F.when(free, F.lit("example.com")).otherwise(F.concat(domain_slug(_root(host), seed, domains), F.lit(".example.com")))
    return F.concat(F.array_join(F.transform(parts, part), ""), F.lit("@"), where)


def url(text: Column, seed: int, surnames: Column, firsts: Column, domains: Column, companies: Column) -> Column:
    """Scheme and www stay; the host is invented, and known names in the path are replaced."""
    pattern = r"(?is)^(https?://)?(www\.)?([^/]+)(/.*)?$"
    scheme, www, host, path = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3, 4))

    def word(w: Column) -> Column:
        low = F.lower(w)
        fake = (
            F.when(F.array_contains(surnames, low), surname(low, seed))
            .when(F.array_contains(firsts, low), first_name(low, seed))
            .when(F.element_at(companies, low).isNotNull(), F.regexp_replace(F.element_at(companies, low), "[^A-Za-z0-9]", ""))
        )
        cased = F.when(w == low, F.lower(fake)).when(w == F.upper(w), F.upper(fake)).otherwise(fake)
        return F.when(w.rlike("^[A-Za-z]{2,}$"), F.coalesce(cased, w)).otherwise(w)

    words = F.regexp_extract_all(path, F.lit(r"(?s)[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.concat(scheme, www, domain_slug(_root(F.lower(host)), seed, domains), F.lit(".example.com"), F.array_join(F.transform(words, word), ""))


# -- what must differ within a document ---------------------------------------------------------
def org_names(lexicon: DataFrame, seed: int) -> DataFrame:
    """(doc_id, key, name, core, full): an invented company for each one of a document; those that
    drew the same get numbers."""
    orgs = lexicon.where("kind = 'ORG'").select("doc_id", "key", "name")
    h = orgs.withColumn("h", _hex(seed, "org", F.col("key")))
    drawn = h.withColumn("drawn", F.concat_ws(" ", pick(L.ORG_HEADS, F.col("h")), pick(L.ORG_TAILS, F.col("h"), 13)))
    rank = F.row_number().over(Window.partitionBy("doc_id", "drawn").orderBy("key"))
    core = F.when(rank > 1, F.concat_ws(" ", F.col("drawn"), rank.cast("string"))).otherwise(F.col("drawn"))
    spelled = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    suffix = squeeze(F.regexp_extract("name", SUFFIX, 1))
    ending = F.when(suffix == "", F.lit("Limited")).otherwise(F.coalesce(F.element_at(spelled, F.lower(suffix)), F.initcap(suffix)))
    return drawn.withColumn("core", core).select("doc_id", "key", "name", "core", F.concat_ws(" ", "core", ending).alias("full"))


def org_aliases(lexicon: DataFrame, seed: int) -> DataFrame:
    """(doc_id, alias, fake): full names get full names, acronyms initials, the rest the core."""
    names = org_names(lexicon, seed).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "core", "full")
    a = lexicon.where("kind = 'ALIAS:ORG'").join(names, (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k")))
    short = (F.upper("name") == F.col("name")) & (F.length("name") <= 5) & ~F.col("name").contains(" ")
    initials = F.substring(F.array_join(F.transform(F.split("core", " "), lambda w: F.substring(w, 1, 1)), ""), 1, 5)
    return a.select(
        "doc_id", "alias", F.when(F.col("name").rlike(SUFFIX), F.col("full")).when(short, F.upper(F.substring(initials, F.lit(1), F.length("name")))).otherwise(F.col("core")).alias("fake")
    )


def place_names(lexicon: DataFrame, seed: int) -> DataFrame:
    """(doc_id, key, fake): an invented place for each one of a document; of those that drew the
    same, all but the first are compounds, and those that still agree get numbers."""
    p = lexicon.where("kind = 'PLACE'").select("doc_id", "key", "name").withColumn("h", _hex(seed, "place", F.col("key")))
    p = p.withColumn("one", pick(L.LOCALITIES, F.col("h"))).withColumn("tail", pick(L.PLACE_TAILS, F.col("h"), 13))
    single = ~F.col("name").contains(" ")
    first = F.row_number().over(Window.partitionBy("doc_id", "one", single).orderBy("key"))
    p = p.withColumn("drawn", F.when(single & (first == 1), F.col("one")).otherwise(F.concat_ws(" ", "one", "tail")))
    again = F.row_number().over(Window.partitionBy("doc_id", "drawn").orderBy("key"))
    return p.select("doc_id", "key", F.when(again > 1, F.concat_ws(" ", "drawn", again.cast("string"))).otherwise(F.col("drawn")).alias("fake"))


def location(text: Column, seed: int, places: Column) -> Column:
    """The place's invented name, with a new postal code where the original has one."""
    core, gap, pin = F.regexp_replace(text, PIN_TAIL, ""), F.regexp_extract(text, PIN_TAIL, 1), F.regexp_extract(text, PIN_TAIL, 2)
    own = let(_hex(seed, "place", normalise(core)), lambda h: F.concat_ws(" ", pick(L.LOCALITIES, h), pick(L.PLACE_TAILS, h, 13)))
    fake = F.coalesce(F.element_at(places, normalise(core)), own)
    cased = F.when((F.upper(core) == core) & (F.lower(core) != core), F.upper(fake)).otherwise(fake)
    code = let(_hex(seed, "pin", normalise(core)), lambda h: F.format_string("%d %03d", 100 + _number(h, 1, 6) % 800, 100 + _number(h, 7, 6) % 900))
    return F.when(pin != "", F.concat(cased, gap, code)).otherwise(cased)


def org(text: Column, seed: int, companies: Column) -> Column:
    own = let(_hex(seed, "org", normalise(text)), lambda h: F.concat_ws(" ", pick(L.ORG_HEADS, h), pick(L.ORG_TAILS, h, 13)))
    fake = F.coalesce(F.element_at(companies, F.lower(squeeze(text))), F.when(text.rlike(SUFFIX), F.concat(own, F.lit(" Limited"))).otherwise(own))
    return F.when((F.upper(text) == text) & (F.lower(text) != text), F.upper(fake)).otherwise(fake)


def context(lexicon: DataFrame, policy: Policy) -> DataFrame:
    """(ctx_doc, surnames, firsts, domains, companies, place_map, indian): what the surrogates of a
    document depend on; a row a document with a lexicon."""
    words = lexicon.where("kind = 'PERSON'").select("doc_id", F.posexplode(F.split("name", r"(?U)\s+")).alias("i", "w"), F.size(F.split("name", r"(?U)\s+")).alias("n"))
    words = words.withColumn("w", F.lower(F.btrim("w", F.lit(".")))).where("w != ''")
    last = (F.col("i") == F.col("n") - 1) & (F.col("n") > 1)
    names = words.groupBy("doc_id").agg(F.collect_set(F.when(last, F.col("w"))).alias("surnames"), F.collect_set(F.when(~last, F.col("w"))).alias("firsts"))

    def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        one = df.groupBy("doc_id", key).agg(F.min(value).alias(value))
        return one.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))

    orgs = org_names(lexicon, policy.seed)
    bare = F.regexp_replace("name", SUFFIX, "")
    slugs = orgs.select("doc_id", F.explode(F.array(_slug(bare), _slug(F.split(bare, " ")[0]))).alias("slug"), _slug(F.col("core")).alias("fake")).where(F.length("slug") >= 4)
    places = place_names(lexicon, policy.seed)
    indian = places.groupBy("doc_id").agg(F.bool_or(F.col("key").isin(*sorted(L.STATES))).alias("indian"))
    out = lexicon.select("doc_id").distinct()
    for part in (
        names,
        as_map(slugs, "slug", "fake", "domains"),
        as_map(org_aliases(lexicon, policy.seed), "alias", "fake", "companies"),
        as_map(places, "key", "fake", "place_map"),
        indian,
    ):
        out = out.join(part, "doc_id", "left")
    return out.withColumnRenamed("doc_id", "ctx_doc")


def replacement(label: Column, text: Column, policy: Policy) -> Column:
    """The invented value of a span, given the columns of context() (null without a lexicon)."""
    seed = policy.seed
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    s, f = F.coalesce("surnames", none), F.coalesce("firsts", none)
    d, c, p = (F.coalesce(x, empty) for x in ("domains", "companies", "place_map"))
    here = F.lit(policy.locale.endswith("_IN")) | F.coalesce("indian", F.lit(False))
    made = F.when(label == "PERSON", person(text, seed, s, f))
    for name, value in (
        ("ORG", org(text, seed, c)),
        ("EMAIL", email(text, seed, s, f, d)),
        ("PHONE", phone(text, seed)),
        ("ADDRESS", address(text, seed, here)),
        ("SSN", ssn(text, seed)),
        ("CREDIT_CARD", card(text, seed)),
        ("DOB", dob(text, seed)),
        ("IP_ADDRESS", ip(text, seed)),
        ("URL", url(text, seed, s, f, d, c)),
        ("LOCATION", location(text, seed, p)),
    ):
        made = made.when(label == name, value)
    for name, own in _own.items():
        made = made.when(label == name, own(text))
    return made.otherwise(shape(text, seed))


_own: dict = {}


def register_surrogate(label: str, of_text) -> None:
    """Add a function of the text column for a label of one's own."""
    _own[label] = of_text


def tags(values: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, label, norm, tag): [LABEL_n], numbered by first appearance. values: scope, label,
    text and `at`, an ordered place of appearance."""
    firsts = values.groupBy(scope, "label", normalise(F.col("text")).alias("norm")).agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy(scope, "label").orderBy("at", "norm"))
    return firsts.select(scope, "label", "norm", F.concat(F.lit("["), F.col("label"), F.lit("_"), n.cast("string"), F.lit("]")).alias("tag"))
