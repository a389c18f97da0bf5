"""Check digits and plausibility of numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def card_ok(text: Column) -> Column:
    n = digits(text)
    return F.length(n).between(13, 19) & F.call_function("luhn_check", n)


def ipv4_ok(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: (p.cast("int") <= 255) & ((p == "0") | ~p.startswith("0")))


def phone_ok(text: Column, labelled: bool = False, grouped: bool = False) -> Column:
    """8 to 15 digits, and evidence: a label, a plus sign, a grouping of ten digits, or ten
    digits that begin like a mobile number."""
    n = digits(text)
    size = F.length(n).between(8, 15)
    if labelled:
        return size
    ten = F.length(n) == 10
    own = ten if grouped else ten & F.substring(n, 1, 1).isin("6", "7", "8", "9")
    return size & (F.ltrim(text).startswith("+") | own)


def luhn_digit(body: Column) -> Column:
    """The digit that completes a string of digits to a valid number."""
    reverse = F.transform(F.split(F.reverse(body), ""), lambda c: c.cast("int"))

    def value(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(reverse, value), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10
