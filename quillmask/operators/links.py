"""Hyperlink targets and field codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..policy import Policy
from . import detectors, surrogates


def _known(rows: DataFrame, lexicon: DataFrame | None, policy: Policy) -> DataFrame:
    if lexicon is not None:
        return rows.join(surrogates.context(lexicon, policy), F.col("doc_id") == F.col("ctx_doc"), "left")
    blank = {"surnames": "array<string>", "firsts": "array<string>", "domains": "map<string,string>", "companies": "map<string,string>", "place_map": "map<string,string>", "indian": "boolean"}
    return rows.withColumns({k: F.lit(None).cast(v) for k, v in blank.items()})


def rewritten(target: Column, policy: Policy) -> Column:
    """A link's new target: mail addresses and web addresses get theirs, others stay."""
    mail, web = F.lower(target).startswith("mailto:"), target.rlike(r"(?i)^https?://")
    address = F.substring(target, F.lit(8), F.length(target))
    new_mail = F.concat(F.lit("mailto:"), surrogates.replacement(F.lit("EMAIL"), address, policy))
    as_mail = F.when(mail & F.lit(policy.wants("EMAIL")), new_mail)
    return F.coalesce(as_mail, F.when(web & F.lit(policy.wants("URL")), surrogates.replacement(F.lit("URL"), target, policy)), target)


def rewrite_links(links: DataFrame, lexicon: DataFrame | None = None, policy: Policy | None = None) -> DataFrame:
    """links (doc_id, rel_id, target) with `rewritten`."""
    policy = policy or Policy()
    return _known(links, lexicon, policy).withColumn("rewritten", rewritten(F.col("target"), policy)).select(*links.columns, "rewritten")


def redact_fields(fields: DataFrame, lexicon: DataFrame | None = None, policy: Policy | None = None) -> DataFrame:
    """fields (doc_id, field_id, text) with `spans` and `redacted`: structured detectors only,
    of the labels that the policy wants."""
    policy = policy or Policy()
    found = S.merge(detectors.structured(F.col("text"), F.lit(""), policy.wants))
    rows = _known(fields.withColumn("spans", found), lexicon, policy)
    edits = F.transform(
        "spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), surrogates.replacement(s.label, s.text, policy).alias("replacement"))
    )
    return rows.withColumn("redacted", S.splice(F.col("text"), edits)).select(*fields.columns, "spans", "redacted")
