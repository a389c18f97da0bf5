"""Normal forms of names and texts, as columns and as Python functions with equal results."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS = " .,:;–—-"
_CLEAN_ENDS = " ,.;:|-–—"


def squeeze(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """The identity of a name: straight apostrophes, single blanks, no punctuation at the
    ends, lower case (lower(), not case folding: sharp s stays)."""
    plain = F.translate(text, "’‘", "''")
    return F.lower(F.btrim(F.regexp_replace(plain, r"(?U)\s+", " "), F.lit(_ENDS)))


def clean(text: Column) -> Column:
    return F.btrim(squeeze(text), F.lit(_CLEAN_ENDS))


def py_normalise(text: str) -> str:
    return " ".join(text.replace("’", "'").replace("‘", "'").split()).strip(_ENDS).lower()


def py_clean(text: str) -> str:
    return " ".join(text.split()).strip(_CLEAN_ENDS)


def literal_pattern(value: str) -> str:
    """A pattern for a literal whose blanks match any white space."""
    return r"\s+".join(re.escape(p) for p in value.split())


def any_of(words) -> str:
    """A pattern for any of many words, sharing their beginnings: a scanner decides on the first
    letter instead of trying every word. Blanks match any white space."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in " ".join(word.split()):
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [(r"\s+" if c == " " else re.escape(c)) + pattern(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        joined = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return joined + ("?" if "" in node else "")

    return pattern(tree)
