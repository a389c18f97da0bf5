"""The two-pass plan: learn every document's lexicon, then find and replace.

    blocks(doc_id, block_id, part, section, text)
      -> lexicon (learn.learn)                          pass 1: grouped by document
      -> spans   (detectors + lexicon matches, merged)  pass 2: one projection
      -> edits   (what replaces each span)              surrogates, in the same projection
      -> redacted blocks, mapping and audit rows, report

Documents are independent: every shuffle is by doc_id. Spans and edits stay arrays on their
block until a mapping or an audit needs them as rows. Without a lexicon an invented value
depends on its span alone, so text is never shuffled to meet its own edits; with one, and
for numbered tags, a document's distinct values are replaced and joined to its spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.lexicons import INSTITUTIONS, STATES
from ..functions.text import normalise, squeeze
from ..operators import detectors, learn, match, surrogates
from ..policy import Policy

TAGGED = "array<struct<start:int,end:int,label:string,text:string>>"
EDITS = "array<struct<start:int,end:int,replacement:string>>"
CONTEXT = {
    "surnames": "array<string>", "firsts": "array<string>", "domains": "map<string,string>", "companies": "map<string,string>",
    "place_map": "map<string,string>", "indian": "boolean",
}
#: Names that a lexicon shared by several documents may have: its aliases travel with the blocks that hold them.
SCOPE_NAMES = 200_000
LABELLED = r"(?iU)birth|d\.?o\.?b|aadhaar|aadhar|uidai|passport|account|a/?c|din|registration|licen[cs]e|membership|phone|mobile|fax|tel"


def as_blocks(texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A block a line of every text."""
    lines = F.posexplode(F.split(F.coalesce(texts[text], F.lit("")), "\n", -1)).alias("block_id", "text")
    rows = texts.select(texts[doc].cast("string").alias("doc_id"), lines)
    return rows.select("doc_id", "block_id", F.lit("body").alias("part"), F.lit("").alias("section"), "text")


def with_cell_labels(text: Column, row_label: Column, column_label: Column, policy: Policy) -> Column:
    """Spans of a cell that its row or column label gives away: anchored detectors on
    'label: text', moved back to the cell."""
    none = F.array().cast(S.SPANS)

    def one(label: Column) -> Column:
        head = F.concat(F.coalesce(label, F.lit("")), F.lit(": "))
        whole = F.concat(head, text)
        found = F.concat(detectors.structured(whole, F.lit(""), policy.wants), detectors.dates_of_birth(whole) if policy.wants("DOB") else none)
        moved = F.transform(
            F.filter(found, lambda s: s.start >= F.length(head)),
            lambda s: s.withField("start", (s.start - F.length(head)).cast("int")).withField("end", (s.end - F.length(head)).cast("int")),
        )
        return F.when(label.rlike(LABELLED), moved).otherwise(none)

    return F.concat(one(row_label), one(column_label))


class Engine:
    """A policy and the plans it makes over tables of blocks."""

    def __init__(self, policy: Policy | None = None):
        self.policy = policy or Policy()

    # -- pass 1 -------------------------------------------------------------------
    def tagged(self, blocks: DataFrame) -> DataFrame:
        """blocks with the tagger's spans, if the policy has one; else unchanged. Kinds of places are
        one, and short texts, public bodies and states are no names."""
        if self.policy.tagger is None:
            return blocks
        raw = F.pandas_udf(self.policy.tagger, TAGGED)(F.col("text"))
        place = lambda s: s.label.isin("PLACE", "GPE", "LOC", "FAC")
        known = F.transform(raw, lambda s: s.withField("label", F.when(place(s), F.lit("PLACE")).otherwise(s.label)))
        public = lambda s: F.lower(F.btrim(s.text)).isin(*sorted(INSTITUTIONS | STATES))
        fit = lambda s: s.label.isin("PERSON", "ORG", "PLACE") & (F.length(F.btrim(s.text)) >= 3) & ((s.label == "PLACE") | ~public(s))
        return blocks.withColumn("tagged", F.filter(F.coalesce(known, F.array().cast(TAGGED)), fit))

    def learn(self, blocks: DataFrame, table_rows: DataFrame | None = None) -> DataFrame:
        return learn.learn(blocks, table_rows, self.policy)

    # -- pass 2 -------------------------------------------------------------------
    def detect(self, blocks: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
        """blocks with `spans`: all spans, merged."""
        text, section = F.col("text"), F.col("section")
        found = detectors.detect(text, section, self.policy)
        if self.policy.use_cell_labels and {"row_label", "column_label"} <= set(blocks.columns):
            found = F.concat(found, with_cell_labels(text, F.col("row_label"), F.col("column_label"), self.policy))
        if lexicon is None:
            return blocks.withColumn("spans", S.merge(found))
        known = match.per_document(lexicon)
        both = blocks.join(known, blocks.doc_id == known.lex_doc, "left")
        has_tags = "tagged" in blocks.columns
        if has_tags:
            words = blocks.select("doc_id", F.explode("tagged").alias("t")).select("doc_id", F.explode(F.split("t.text", r"(?U)\s+")).alias("w"))
            words = words.select("doc_id", F.lower(F.btrim("w", F.lit(".,"))).alias("word")).distinct()
            common = learn.vocabulary(blocks).where(F.col("n") >= learn.COMMON).join(words, ["doc_id", "word"], "left_semi")
            common = common.groupBy(F.col("doc_id").alias("word_doc")).agg(F.collect_list("word").alias("common"))
            both = both.join(common, both.doc_id == common.word_doc, "left").drop("word_doc")
            seen = blocks.select(F.col("doc_id").alias("place_doc"), F.explode("tagged").alias("t")).where("t.label = 'PLACE'")
            seen = seen.groupBy("place_doc").agg(F.collect_set(normalise(F.col("t.text"))).alias("tagged_places"))
            both = both.join(seen, both.doc_id == seen.place_doc, "left").drop("place_doc")
        spans = F.concat(found, match.matches(text, policy=self.policy, tagged=has_tags))
        out = both.withColumn("spans", S.merge(F.filter(spans, lambda s: s.isNotNull())))
        return out.drop("lex_doc", "aliases", "places", "people", "orgs", "firsts", "common", "tagged_places")

    # -- replacement --------------------------------------------------------------
    def edited(self, detected: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
        """detected with `edits`, what replaces each of its spans, in their order. Without a lexicon
        an invented value depends on its span alone and is made in the same projection; else the
        distinct values of a document are replaced, and detected is read twice."""
        if self.policy.mode == "tag" or lexicon is not None:
            return self._by_value(detected, lexicon)
        known = detected.withColumns({k: F.lit(None).cast(v) for k, v in CONTEXT.items()})
        made = lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), surrogates.replacement(s.label, s.text, self.policy).alias("replacement"))
        return known.withColumn("edits", F.transform("spans", made)).drop(*CONTEXT)

    def _by_value(self, detected: DataFrame, lexicon: DataFrame | None) -> DataFrame:
        rows = detected.select("doc_id", "block_id", F.explode("spans").alias("s")).select("doc_id", "block_id", "s.start", "s.end", "s.label", "s.text")
        rows = rows.withColumn("at", F.struct("block_id", "start")).withColumn("o", squeeze(F.col("text")))
        m = self._replaced(rows, lexicon).toDF("d", "l", "original", "replacement")
        on = (F.col("doc_id") == F.col("d")) & (F.col("label") == F.col("l")) & (F.col("o") == F.col("original"))
        listed = F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits")
        out = detected.join(rows.join(m, on).groupBy("doc_id", "block_id").agg(listed), ["doc_id", "block_id"], "left")
        return out.withColumn("edits", F.coalesce("edits", F.array().cast(EDITS)))

    @staticmethod
    def _pairs(edited: DataFrame, *columns: str) -> DataFrame:
        """A row a span `s` with its edit `e`."""
        both = F.explode(F.arrays_zip("spans", "edits")).alias("x")
        return edited.select(*columns, both).select(*columns, F.col("x.spans").alias("s"), F.col("x.edits").alias("e"))

    def mapping(self, edited: DataFrame) -> DataFrame:
        """(doc_id, label, original, replacement): a row a distinct value of a document, as it is
        replaced where it comes first."""
        at = F.struct("block_id", "s.start", "e.replacement")
        rows = self._pairs(edited, "doc_id", "block_id").groupBy("doc_id", F.col("s.label").alias("label"), squeeze(F.col("s.text")).alias("original"))
        return rows.agg(F.min(at).getField("replacement").alias("replacement"))

    def audit(self, edited: DataFrame) -> DataFrame:
        """A row a detection: doc_id, block, part, label, start, end, original, replacement,
        find_in_output, detector, score."""
        return self._pairs(edited, "doc_id", "block_id", "part").select(
            "doc_id", F.col("block_id").alias("block"), "part", "s.label", "s.start", "s.end", squeeze(F.col("s.text")).alias("original"), "e.replacement",
            F.substring(squeeze(F.col("e.replacement")), 1, 60).alias("find_in_output"), F.col("s.source").alias("detector"), F.format_string("%.2f", "s.score").alias("score"),
        )

    def redact(self, edited: DataFrame) -> DataFrame:
        """edited blocks with `redacted`."""
        return edited.withColumn("redacted", S.splice(F.col("text"), F.col("edits")))

    def _replaced(self, rows: DataFrame, lexicon: DataFrame | None) -> DataFrame:
        """(doc_id, label, original, replacement) of rows (doc_id, at, label, text)."""
        values = rows.groupBy("doc_id", "label", squeeze(F.col("text")).alias("original")).agg(F.min("text").alias("text"), F.min("at").alias("at"))
        if self.policy.mode == "tag":
            t = surrogates.tags(values).toDF("d", "l", "n", "replacement")
            on = (F.col("doc_id") == F.col("d")) & (F.col("label") == F.col("l")) & (normalise(F.col("text")) == F.col("n"))
            return values.join(t, on).select("doc_id", "label", "original", "replacement")
        known = values.join(surrogates.context(lexicon, self.policy), F.col("doc_id") == F.col("ctx_doc"), "left")
        return known.select("doc_id", "label", "original", surrogates.replacement(F.col("label"), F.col("text"), self.policy).alias("replacement"))

    def across_blocks(self, redacted: DataFrame, lexicon: DataFrame) -> DataFrame:
        """redacted blocks, with names over the end of a block replaced in the first and cut from
        the second. The pairs are judged on the text that the main pass left."""
        known = match.per_document(lexicon)
        current = redacted.select("doc_id", "block_id", F.col("redacted").alias("text")).join(known, F.col("doc_id") == F.col("lex_doc"))
        hits = match.across_blocks(current, self.policy)
        values = hits.select("doc_id", F.struct(F.col("block_id"), F.col("span.start")).alias("at"), "span.label", "span.text")
        if self.policy.mode == "tag":  # tags go on counting where the main pass ended
            main = redacted.select("doc_id", "block_id", F.explode("spans").alias("s")).select("doc_id", F.struct(F.col("block_id"), F.col("s.start")).alias("at"), "s.label", "s.text")
            later = values.withColumn("at", F.col("at").withField("block_id", F.col("at.block_id") + (1 << 30)))
            values = main.select("doc_id", F.col("at").withField("block_id", F.col("at.block_id").cast("long")).alias("at"), "label", "text").unionByName(
                later.withColumn("at", F.col("at").withField("block_id", F.col("at.block_id").cast("long")))
            )
        m = self._replaced(values, lexicon).select(F.col("doc_id").alias("d"), F.col("label").alias("l"), F.col("original").alias("o"), "replacement")
        on = (F.col("doc_id") == F.col("d")) & (F.col("span.label") == F.col("l")) & (squeeze(F.col("span.text")) == F.col("o"))
        hits = hits.join(m, on)
        # a block may end one name and begin another
        ends = hits.select("doc_id", "block_id", F.struct(F.col("span.start").alias("from"), "replacement").alias("tail"))
        begins = hits.select("doc_id", F.col("next_id").alias("block_id"), (F.col("span.end") - F.col("head") - 1).alias("cut"))
        out = redacted.join(ends, ["doc_id", "block_id"], "left").join(begins, ["doc_id", "block_id"], "left")
        tailed = F.when(F.col("tail").isNotNull(), F.concat(F.expr("substring(redacted, 1, tail.from)"), F.col("tail.replacement"))).otherwise(F.col("redacted"))
        whole = F.when(F.col("cut").isNotNull(), F.substring(tailed, F.col("cut") + 1, F.length(tailed))).otherwise(tailed)
        return out.withColumn("redacted", whole).drop("tail", "cut")

    def run(
        self, blocks: DataFrame, table_rows: DataFrame | None = None, scope: str | None = None, progress: Callable[[str, float, int], None] | None = None
    ) -> dict[str, DataFrame]:
        """All tables of a run: lexicon, detected, mapping, audit, redacted, report. The lexicon is
        cut, spans and edits are persisted, as several tables use them; release() frees them. scope: a column of
        constants makes the documents that share one share a lexicon, of at most SCOPE_NAMES
        names. progress is told stages as they are done, the share of the run, and rows."""
        if scope is not None:
            blocks = blocks.withColumn("doc_id", F.col(scope).cast("string"))
        blocks = self.tagged(blocks)
        lexicon = self.learn(blocks, table_rows)
        if scope is not None and (largest := lexicon.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0) > SCOPE_NAMES:
            raise ValueError(f"a scope with {largest} names is too large to match against every block")
        spans = self.detect(blocks, lexicon).persist()
        detected = self.edited(spans, lexicon).persist()
        detected._held = [spans]
        redacted = self.across_blocks(self.redact(detected), lexicon)
        for stage, share, table in (("learn", 0.4, lexicon), ("detect", 0.9, detected)) if progress else ():
            table, seen = observed(table, stage)
            table.write.format("noop").mode("overwrite").save()
            progress(stage, share, seen.get["rows"])
        return {
            "lexicon": lexicon,
            "detected": detected,
            "mapping": self.mapping(detected),
            "audit": self.audit(detected),
            "redacted": redacted,
            "report": report(redacted),
        }


def release(tables: dict[str, DataFrame]) -> None:
    """Free what run() persisted."""
    for table in [*tables.values(), *getattr(tables["detected"], "_held", [])]:
        table.unpersist()


def report(redacted: DataFrame) -> DataFrame:
    """(doc_id, blocks, blocks_changed, detections, by_type): by_type is ordered by count."""
    size = redacted.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("redacted") != F.col("text")).alias("blocks_changed"), F.sum(F.size("spans")).alias("detections")
    )
    kinds = redacted.select("doc_id", F.explode("spans.label").alias("label")).groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    listed = kinds.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label", "n"))).alias("x"))
    by_type = F.transform("x", lambda v: F.struct(v.label.alias("label"), v.n.alias("n")))
    return size.join(listed, "doc_id", "left").select("doc_id", "blocks", "blocks_changed", "detections", by_type.alias("by_type"))


def lexicon_summary(lexicon: DataFrame) -> DataFrame:
    """(doc_id, people, companies, aliases, places, rejected)."""
    count = lambda cond: F.count_if(cond)
    kind = F.col("kind")
    return lexicon.groupBy("doc_id").agg(
        count(kind == "PERSON").alias("people"), count(kind == "ORG").alias("companies"), count(kind.startswith("ALIAS:")).alias("aliases"),
        count(kind == "PLACE").alias("places"), count(kind.startswith("REJECTED:")).alias("rejected"),
    )


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """df that reports, when it has been read, how many rows a stage handled: progress without a
    second job. The observation's get waits for the figures."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def ablation(blocks: DataFrame, policies: dict[str, Policy], table_rows: DataFrame | None = None) -> DataFrame:
    """(variant, label, n): detections of the same blocks under several policies."""
    out = None
    for name, policy in policies.items():
        engine = Engine(policy)
        found = engine.detect(engine.tagged(blocks), engine.learn(engine.tagged(blocks), table_rows)).select(F.explode("spans.label").alias("label"))
        part = found.groupBy("label").agg(F.count("*").alias("n")).select(F.lit(name).alias("variant"), "label", "n")
        out = part if out is None else out.unionByName(part)
    return out
