"""Detection from SQL: the table function pii_spans(text), made of the same table of patterns."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.detectors import DETECTORS
from .operators.split_contacts import SCORE, find_split


def python_pattern(pattern: str) -> str:
    """A Java pattern of ours for Python's re, which knows Unicode classes without a flag."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "")


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(values)) % 10 == 0


def _digits(x: str) -> str:
    return re.sub(r"\D", "", x)


def _phone(x: str, labelled: bool = False, grouped: bool = False) -> bool:
    n = _digits(x)
    ten = len(n) == 10 and (grouped or n[0] in "6789")
    return 8 <= len(n) <= 15 and (labelled or x.lstrip().startswith("+") or ten)


KEEP = {
    "regex:phone-anchored": lambda x: _phone(x, labelled=True),
    "regex:phone-intl": _phone,
    "regex:phone-us": lambda x: _phone(x, grouped=True),
    "regex:phone-in-mobile": _phone,
    "regex:card+luhn": lambda x: 13 <= len(_digits(x)) <= 19 and _luhn(_digits(x)),
    "regex:ipv4": lambda x: all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in x.split(".")),
}
CUES = {"regex:aadhaar": re.compile(r"(?i)\b(?:aadhaar|aadhar|uidai)\b")}
SCHEMA = "start int, end int, label string, text string, source string, score double"


class PiiSpans:
    """A row for each structured span of a text, not merged."""

    def eval(self, text: str):
        for d in DETECTORS if text else ():
            if d.source in CUES and not CUES[d.source].search(text):
                continue
            for m in re.finditer(python_pattern(d.pattern), text):
                value = m[d.group]
                if KEEP.get(d.source, bool)(value):
                    yield m.start(d.group), m.end(d.group), d.label, value, d.source, d.score
        for a, b, label, source in find_split(text or ""):
            yield a, b, label, text[a:b], source, SCORE


def register(spark: SparkSession) -> None:
    """Make pii_spans(text) known to SQL."""
    spark.udtf.register("pii_spans", F.udtf(PiiSpans, returnType=SCHEMA))
