"""Structured detectors: patterns that give typed spans, as one projection.

Every detector is a row of DETECTORS; a plan is built from the rows that a policy wants.
(?U) gives Java's \\s, \\w, \\d and \\b their Unicode meaning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import spans as S
from ..policy import Policy
from .split_contacts import split_contacts

# The patterns.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"""(?U)\b(?:https?://|www\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[^\s,;)"']*)?"""
PHONE_LABELLED = r"(?iU)\b(?:tel(?:ephone)?|phone|mobile|mob|fax|contact\s*(?:no|number)|helpline)\b\s*(?:no\.?|number)?\s*[:.\-]?\s*([+\d][\d\s\-().]{6,20}\d)"
PHONE_INTL = r"(?U)\+\s?\d{1,3}[\s\-.]?(?:\(?\d{2,5}\)?[\s\-.]?){1,4}\d{2,5}"
PHONE_US = r"(?U)\(?\b\d{3}\)?[\s\-.]\d{3}[\s\-.]\d{4}\b"
PHONE_IN = r"(?U)\b[6-9]\d{4}[\s\-]?\d{5}\b"
SSN = r"(?U)\b(?!000|666|9\d\d)\d{3}[-\s](?!00)\d{2}[-\s](?!0000)\d{4}\b"
CARD = r"(?U)\b(?:\d[ -]?){12,18}\d\b"
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"(?U)\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b"
PAN = r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b"
CIN = r"(?U)\b[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b"
SEBI = r"(?U)\bIN[A-Z]\d{9}\b"
IFSC = r"(?U)\b[A-Z]{4}0[A-Z0-9]{6}\b"
GSTIN = r"(?U)\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b"
AADHAAR = r"(?U)\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b"
AADHAAR_CUE = r"(?iU)\b(?:aadhaar|aadhar|uidai)\b"
DIN = r"(?iU)\bDIN\s*[:\-]?\s*(\d{8})\b"
PASSPORT = r"(?iU)\bpassport\s*(?:no\.?|number)?\s*[:\-]?\s*([A-PR-WY]\d{7})\b"
FIRM = r"(?iU)\b(?:firm\s+registration|registration)\s*(?:no\.?|number)?\s*[:\-]?\s*([0-9]{6}[A-Z](?:\s*/\s*[A-Z]?[0-9]{6})?)\b"
REGISTRATION = r"(?iU)\b(?:registration|regn\.?|reg\.?|licence|license|membership)\s*(?:no\.?|number)?\s*[:\-]?\s*([A-Z]{0,3}[-/]?\d{5,8}[A-Z]?)\b"
ACCOUNT = r"(?iU)\b(?:a/?c|account)\s*(?:no\.?|number)?\s*[:\-]?\s*(\d[\d\s\-]{7,20}\d)\b"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec"
DATE = rf"(?U)\b(?:(?:{_MONTHS})\.?\s+\d{{1,2}},?\s+(?:19|20)\d{{2}}|\d{{1,2}}\s+(?:{_MONTHS})\.?,?\s+(?:19|20)\d{{2}}|\d{{1,2}}[/-]\d{{1,2}}[/-](?:19|20)?\d{{2}})\b"
BIRTH = r"(?iU)\b(?:date\s+of\s+birth|d\.?o\.?b\.?|born\s+(?:on|in)|birthday)\b"
BIRTH_REACH = 80
#: What a block must have for each label; for labels that aren't here, a digit.
MAYBE = {"EMAIL": "@", "URL": "(?i:www|http)", "IP_ADDRESS": r"\d|:[A-Fa-f0-9]{1,4}:"}


@dataclass(frozen=True)
class Detector:
    label: str
    source: str
    score: float
    pattern: str
    group: int = 0
    #: whether a match counts, from its text
    keep: Callable[[Column], Column] | None = None
    #: whether to look at all, from the block's text
    when: Callable[[Column], Column] | None = None

    def hits(self, text: Column) -> Column:
        hits = S.find(text, self.pattern, self.group)
        if self.keep is not None:
            hits = F.filter(hits, lambda h: self.keep(h.text))
        return hits if self.when is None else F.when(self.when(text), hits).otherwise(F.array().cast(f"array<{S.HIT}>"))


def _id(source: str, pattern: str, group: int = 0, score: float = 1.0, when=None) -> Detector:
    return Detector("NATIONAL_ID", f"regex:{source}", score, pattern, group, when=when)


DETECTORS: list[Detector] = [
    Detector("EMAIL", "regex:email", 1.0, EMAIL, when=lambda t: t.contains("@")),
    Detector("URL", "regex:url", 0.9, URL),
    Detector("PHONE", "regex:phone-anchored", 1.0, PHONE_LABELLED, 1, lambda x: checks.phone_ok(x, labelled=True)),
    Detector("PHONE", "regex:phone-intl", 0.9, PHONE_INTL, keep=checks.phone_ok, when=lambda t: t.contains("+")),
    Detector("PHONE", "regex:phone-us", 0.9, PHONE_US, keep=lambda x: checks.phone_ok(x, grouped=True)),
    Detector("PHONE", "regex:phone-in-mobile", 0.9, PHONE_IN, keep=checks.phone_ok),
    Detector("SSN", "regex:ssn", 1.0, SSN),
    Detector("CREDIT_CARD", "regex:card+luhn", 1.0, CARD, keep=checks.card_ok),
    Detector("IP_ADDRESS", "regex:ipv4", 1.0, IPV4, keep=checks.ipv4_ok),
    Detector("IP_ADDRESS", "regex:ipv6", 0.8, IPV6, when=lambda t: t.contains(":")),
    _id("pan", PAN),
    _id("cin", CIN),
    _id("sebi-reg", SEBI),
    _id("ifsc", IFSC),
    _id("gstin", GSTIN),
    _id("din", DIN, 1),
    _id("firm-registration", FIRM, 1),
    _id("registration-number", REGISTRATION, 1, 0.95),
    _id("passport", PASSPORT, 1),
    _id("aadhaar", AADHAAR, score=0.9, when=lambda t: t.rlike(AADHAAR_CUE)),
    Detector("BANK_ACCOUNT", "regex:bank-account", 0.9, ACCOUNT, 1),
]
#: Orders of emission of what isn't in the table.
ORD_SPLIT, ORD_DIN_COLUMN, ORD_DOB, ORD_ADDRESS, ORD_LEXICON, ORD_PLACE, ORD_NER, ORD_OWN = 2, 30, 40, 50, 60, 70, 80, 90
_own: list[Callable[[Column, Column], Column]] = []


def register_detector(detector: Callable[[Column, Column], Column]) -> None:
    """Add a function of the text and section columns that gives an array of spans."""
    _own.append(detector)


def din_column(text: Column, section: Column) -> Column:
    """A cell of eight digits under a header with the word DIN."""
    hit = F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"))
    there = F.coalesce(section, F.lit("")).rlike(r"(?iU)\bdin\b") & text.rlike(r"(?U)^\s*\d{8}\s*$")
    return F.when(there, F.array(hit)).otherwise(F.array().cast(f"array<{S.HIT}>"))


def dates_of_birth(text: Column, all_dates: bool = False) -> Column:
    """Dates with a birth cue that ends at most BIRTH_REACH before them, or all dates."""
    dates = S.find(text, DATE)
    if all_dates:
        return S.label(dates, "DOB", "regex:date-all", 0.6, ORD_DOB)
    near = S.let(
        S.find(text, BIRTH),
        lambda cues: F.filter(dates, lambda d: F.exists(cues, lambda c: (c.end <= d.start) & (c.end >= d.start - BIRTH_REACH))),
    )
    hits = F.when(text.rlike(BIRTH), near).otherwise(F.array().cast(f"array<{S.HIT}>"))
    return S.label(hits, "DOB", "regex:dob-anchored", 1.0, ORD_DOB)


def structured(text: Column, section: Column, wants: Callable[[str], bool] = lambda _: True) -> Column:
    """All structured spans of a block, not merged."""
    parts = [S.label(d.hits(text), d.label, d.source, d.score, k if k < 2 else k + 1) for k, d in enumerate(DETECTORS) if wants(d.label)]
    if wants("EMAIL") or wants("URL"):
        parts.append(F.filter(split_contacts(text), lambda s: s.label.isin([x for x in ("EMAIL", "URL") if wants(x)])))
    if wants("NATIONAL_ID"):
        parts.append(S.label(din_column(text, section), "NATIONAL_ID", "context:din-column", 0.9, ORD_DIN_COLUMN))
    none = F.array().cast(S.SPANS)
    maybe = dict.fromkeys(MAYBE.get(d.label, r"\d") for d in DETECTORS if wants(d.label))
    found = F.when(text.rlike("(?U)" + "|".join(maybe)), F.concat(*parts)).otherwise(none) if parts else none
    return F.concat(found, *[f(text, section) for f in _own]) if _own else found


def detect(text: Column, section: Column | None = None, policy: Policy | None = None) -> Column:
    """All spans that need no lexicon: structured, dates of birth and addresses."""
    from .addresses import addresses

    policy, section = policy or Policy(), F.lit("") if section is None else section
    parts = [structured(text, section, policy.wants)]
    if policy.wants("DOB"):
        parts.append(dates_of_birth(text, policy.redact_all_dates))
    if policy.wants("ADDRESS"):
        parts.append(addresses(text, section))
    return F.when(F.btrim(text) != "", F.concat(*parts)).otherwise(F.array().cast(S.SPANS))
