"""The engine's queries by name: each takes (spark, sf_dir) and gives a DataFrame; ORACLE has
equivalent SQL. Queries named fx_ run on small inline rows, because the driver's tables hold
no such texts; their SQL states the rows that must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as O
from .functions import spans as S
from .functions.text import normalise, squeeze
from .operators import detectors, evalkit, images, learn, links, match, surrogates
from .plans.engine import Engine, as_blocks, lexicon_summary
from .policy import Policy
from .sources import docx, files, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


# -- detectors over documents -------------------------------------------------------------------------
def _detector(source: str) -> detectors.Detector:
    return next(d for d in detectors.DETECTORS if d.source == source)


def _one(source: str, table: str = "documents", key: str = "doc_id", text: str = "text", planted: bool = False):
    d = _detector(source)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        whole = _with_line(F.col(key), F.col(text)) if planted else F.col(text)
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("doc_id"), F.explode(d.hits(whole)).alias("h"))
        return rows.select("doc_id", "h.start", F.col("h.end").alias("stop"), F.col("h.text").alias("value"))

    return run


#: Lines with values that the tables don't hold; documents get one each, in turn.
_LINES_TO_PLANT = (
    "See https://acme.example.org/u/ana?x=1, thanks", "Tel. no: (020) 4505-3237 or phone 4155550132", "Ring 98765 43210 or 9876543211.",
    "v6 2001:db8:0:0:0:0:0:1 and fe80:1:2:3", "PAN ABCDE1234F and ÉABCDE1234F", "IFSC TEST0ABC123.", "Account No. 1234 5678 901, a/c: 99887766554",
    "SSN 123-45-6789, not 000-12-3456", "Aadhaar 2345 6789 0123; DIN: 01234567; passport no. K1234567", "no value in this line",
)


def _with_line(key, text):
    lines = F.array(*[F.lit("\n" + x) for x in _LINES_TO_PLANT])
    return F.concat(text, F.element_at(lines, (F.pmod(key, F.lit(len(_LINES_TO_PLANT))) + 1).cast("int")))


_PLANTED = (
    "(SELECT doc_id, text || chr(10) || [" + ", ".join(map(O.quoted, _LINES_TO_PLANT)) + f"][doc_id % {len(_LINES_TO_PLANT)} + 1] AS text FROM documents)"
)


for _name, _source in {
    "detect_email": "regex:email", "detect_phone_intl": "regex:phone-intl", "detect_phone_us": "regex:phone-us", "detect_card": "regex:card+luhn",
    "detect_ipv4": "regex:ipv4",
}.items():
    query(_name, f"SELECT doc_id, start, stop, value FROM ({O.hits(_source)})")(_one(_source))
for _name, _source in {
    "detect_url": "regex:url", "detect_phone_labelled": "regex:phone-anchored", "detect_phone_in": "regex:phone-in-mobile", "detect_ipv6": "regex:ipv6",
    "detect_pan": "regex:pan", "detect_ifsc": "regex:ifsc", "detect_bank_account": "regex:bank-account", "detect_ssn": "regex:ssn",
    "detect_aadhaar": "regex:aadhaar", "detect_din": "regex:din", "detect_passport": "regex:passport",
}.items():
    query(_name, f"SELECT doc_id, start, stop, value FROM ({O.hits(_source, _PLANTED)})")(_one(_source, planted=True))
for _name, _source in {"detect_email_pages": "regex:email", "detect_card_pages": "regex:card+luhn", "detect_ipv4_pages": "regex:ipv4"}.items():
    query(_name, f"SELECT doc_id, start, stop, value FROM ({O.hits(_source, 'pages', 'page_id', 'html')})")(_one(_source, "pages", "page_id", "html"))
query("detect_url_links", f"SELECT doc_id, start, stop, value FROM ({O.hits('regex:url', 'pages', 'page_id', 'url')})")(
    _one("regex:url", "pages", "page_id", "url")
)


def _blocks_of(docs: DataFrame) -> DataFrame:
    return docs.withColumn("block_id", F.lit(0)).withColumn("part", F.lit("body")).withColumn("section", F.lit(""))


def _detected(spark: SparkSession, sf_dir: str, policy: Policy | None = None) -> DataFrame:
    """Documents, a block each, with the merged spans of all detectors that need no lexicon. The SQL
    has all structured ones; broken contacts, birth dates and addresses, which it can't follow,
    must find nothing in the tables for the two to agree."""
    return Engine(policy).detect(_blocks_of(_docs(spark, sf_dir)))


_MERGED = O.merged(O.MAIN)
_FLAT = f"SELECT doc_id, s.start AS start, s.stop AS stop, s.label AS label, s.value AS value, s.source AS source, s.score AS score FROM ({_MERGED})"


@query("detect_all_merged", _FLAT)
def detect_all_merged(spark, sf_dir):
    return _flat(_detected(spark, sf_dir))


def _flat(detected: DataFrame) -> DataFrame:
    rows = detected.select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.start", F.col("s.end").alias("stop"), "s.label", F.col("s.text").alias("value"), "s.source", "s.score")


@query("detections_by_label", f"SELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({_FLAT}) GROUP BY label")
def detections_by_label(spark, sf_dir):
    return _label_counts(detect_all_merged(spark, sf_dir))


def _label_counts(flat: DataFrame) -> DataFrame:
    return flat.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_NORM = "lower(trim(regexp_replace(translate({x}, '’‘', ''''''), '\\s+', ' ', 'g'), ' .,:;–—-'))"
_TAGS = (
    f"WITH s AS ({_FLAT}), v AS (SELECT doc_id, label, {_NORM.format(x='value')} AS norm, min(start) AS pos FROM s GROUP BY ALL), "
    "t AS (SELECT doc_id, label, norm, '[' || label || '_' || row_number() OVER (PARTITION BY doc_id, label ORDER BY pos, norm) || ']' AS tag FROM v)"
)


@query("tag_numbers", _TAGS + " SELECT doc_id, label, norm, tag FROM t")
def tag_numbers(spark, sf_dir):
    rows = _detected(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.label", "s.text", F.col("s.start").alias("at"))
    return surrogates.tags(rows)


@query(
    "redact_tag",
    _TAGS
    + f""", e AS (SELECT s.doc_id, list({{'start': s.start, 'stop': s.stop, 'tag': t.tag}} ORDER BY s.start) AS x FROM s
        JOIN t ON s.doc_id = t.doc_id AND s.label = t.label AND {_NORM.format(x='s.value')} = t.norm GROUP BY s.doc_id)
    SELECT d.doc_id, CASE WHEN x IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(x) + 1), lambda i:
        substr(text, coalesce(x[i - 1].stop, 0) + 1, x[i].start - coalesce(x[i - 1].stop, 0)) || x[i].tag), '') || substr(text, x[len(x)].stop + 1) END AS redacted
    FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id""",
)
def redact_tag(spark, sf_dir):
    engine = Engine(Policy(mode="tag"))
    return engine.redact(engine.edited(_once(_detected(spark, sf_dir)))).select("doc_id", "redacted")


def _once(detected: DataFrame) -> DataFrame:
    """Kept on the executors' disks, for plans that read the spans more than once; what a lost
    executor held is made again."""
    return detected.persist(StorageLevel.DISK_ONLY)


def _surrogate(label: str, of, sql):
    rows = f"SELECT DISTINCT value FROM ({_FLAT}) WHERE label = '{label}'"
    sql = f"SELECT value, {sql('value')} AS replacement FROM ({rows})"

    def run(spark, sf_dir):
        v = detect_all_merged(spark, sf_dir).where(F.col("label") == label).select("value").distinct()
        return v.select("value", of(F.col("value"), Policy.seed).alias("replacement"))

    return sql, run


for _name, _label, _of, _sql in (
    ("surrogate_phone", "PHONE", surrogates.phone, O.surrogate_phone),
    ("surrogate_card", "CREDIT_CARD", surrogates.card, O.surrogate_card),
    ("surrogate_ip", "IP_ADDRESS", surrogates.ip, O.surrogate_ip),
    ("surrogate_shape", "EMAIL", surrogates.shape, O.surrogate_shape),
):
    _s, _run = _surrogate(_label, _of, _sql)
    query(_name, _s)(_run)


@query("surrogate_email", f"SELECT value, {O.surrogate_email('value')} AS replacement FROM (SELECT DISTINCT value FROM ({_FLAT}) WHERE label = 'EMAIL')")
def surrogate_email(spark, sf_dir):
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    v = detect_all_merged(spark, sf_dir).where("label = 'EMAIL'").select("value").distinct()
    return v.select("value", surrogates.email(F.col("value"), Policy.seed, none, none, empty).alias("replacement"))


@query("surrogate_url", f"SELECT value, {O.surrogate_url('value')} AS replacement FROM (SELECT DISTINCT url AS value FROM pages)")
def surrogate_url(spark, sf_dir):
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    v = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("value")).distinct()
    return v.select("value", surrogates.url(F.col("value"), Policy.seed, none, none, empty, empty).alias("replacement"))


_FAKE = (
    f"CASE WHEN label = 'PHONE' THEN {O.surrogate_phone('value')} WHEN label = 'CREDIT_CARD' THEN {O.surrogate_card('value')} "
    f"WHEN label = 'IP_ADDRESS' THEN {O.surrogate_ip('value')} WHEN label = 'EMAIL' THEN {O.surrogate_email('value')} "
    f"WHEN label = 'URL' THEN {O.surrogate_url('value')} ELSE {O.surrogate_shape('value')} END"
)
_SQUEEZED = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(
    "mapping_table",
    f"SELECT doc_id, label, original, replacement FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label, original ORDER BY start) AS r "
    f"FROM (SELECT doc_id, label, start, {_SQUEEZED.format(x='value')} AS original, {_FAKE} AS replacement FROM ({_FLAT}))) WHERE r = 1",
)
def mapping_table(spark, sf_dir):
    return Engine().mapping(Engine().edited(_detected(spark, sf_dir)))


@query(
    "detection_audit",
    f"SELECT doc_id, label, start, {_SQUEEZED.format(x='value')} AS original, source AS detector, printf('%.2f', score) AS score, "
    f"substr({_SQUEEZED.format(x=_FAKE)}, 1, 60) AS find_in_output FROM ({_FLAT})",
)
def detection_audit(spark, sf_dir):
    return Engine().audit(Engine().edited(_detected(spark, sf_dir))).select("doc_id", "label", "start", "original", "detector", "score", "find_in_output")


@query(
    "redact_fake",
    f"""WITH s AS ({_FLAT}), e AS (SELECT doc_id, list({{'start': start, 'stop': stop, 'fake': fake}} ORDER BY start) AS x
        FROM (SELECT doc_id, start, stop, {_FAKE} AS fake FROM s) GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN x IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(x) + 1), lambda n:
        substr(text, coalesce(x[n - 1].stop, 0) + 1, x[n].start - coalesce(x[n - 1].stop, 0)) || x[n].fake), '') || substr(text, x[len(x)].stop + 1) END AS redacted
    FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id""",
)
def redact_fake(spark, sf_dir):
    return Engine().redact(Engine().edited(_detected(spark, sf_dir))).select("doc_id", "redacted")


@query("run_report")
def run_report(spark, sf_dir):
    """The whole two-pass run over documents, a block a line."""
    return Engine().run(as_blocks(_docs(spark, sf_dir)))["report"].select("doc_id", "blocks", "blocks_changed", "detections")


# -- vocabulary, sections, sampling ---------------------------------------------------------------------
_VOCAB = (
    "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(" + O.folded("text") + ", "
    "'\\S+@\\S+|https?://\\S+|www\\.\\S+', ' ', 'g'), '\\b[a-z][a-z''\\-]{2,}\\b')) AS word FROM documents) GROUP BY ALL"
)


@query("vocab_counts", _VOCAB)
def vocab_counts(spark, sf_dir):
    return learn.vocabulary(_docs(spark, sf_dir))


@query("common_words", f"SELECT word, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n FROM ({_VOCAB}) WHERE n >= 3 GROUP BY word")
def common_words(spark, sf_dir):
    return vocab_counts(spark, sf_dir).where(F.col("n") >= learn.COMMON).groupBy("word").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_id FROM documents"


@query(
    "block_neighbors",
    f"""WITH l AS ({_LINES}), n AS (SELECT *, lead(line) OVER w AS next_line FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY block_id))
    SELECT doc_id, CAST(block_id AS INTEGER) AS block_id, length(line) AS head, length(line || ' ' || next_line) AS both_length
    FROM n WHERE trim(line) <> '' AND trim(next_line) <> '' AND length(line) + length(next_line) <= 400""",
)
def block_neighbors(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_id", "line"))
    rows = rows.withColumn("next_line", F.lead("line").over(Window.partitionBy("doc_id").orderBy("block_id")))
    rows = rows.where((F.trim("line") != "") & (F.trim("next_line") != "") & (F.length("line") + F.length("next_line") <= match.JOIN_LIMIT))
    head = F.length("line").cast("long").alias("head")
    return rows.select("doc_id", "block_id", head, F.length(F.concat_ws(" ", "line", "next_line")).cast("long").alias("both_length"))


_HEADS = {"short": r"^[A-Z][a-z]+\.$", "thes": r"^(The|This|That)\b"}


@query(
    "section_carry_forward",
    f"""WITH l AS ({_LINES}), h AS (SELECT *, CASE WHEN length(trim(line)) > 3 AND length(trim(line)) < 120 THEN
        CASE WHEN regexp_matches(trim(line), '{_HEADS["short"]}') THEN 'short' WHEN regexp_matches(trim(line), '{_HEADS["thes"]}') THEN 'thes' END END AS head FROM l)
    SELECT doc_id, CAST(block_id AS INTEGER) AS block_id, coalesce(last_value(head IGNORE NULLS) OVER
        (PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'start') AS stratum FROM h""",
)
def section_carry_forward(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_id", "text"))
    return evalkit.carry_section(rows, _HEADS, "start").select("doc_id", "block_id", "stratum")


@query(
    "stratified_sample",
    """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS r FROM documents
       WHERE length(trim(text)) BETWEEN 40 AND 600) WHERE r <= CASE WHEN source IN ('src1', 'src2') THEN 5 ELSE 3 END""",
)
def stratified_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    quota = F.when(F.col("source").isin("src1", "src2"), 5).otherwise(3)
    return evalkit.stratified_sample(docs, "source", quota, "doc_id").select("source", "doc_id")


# -- evaluation: a prediction without addresses of machines against a gold without cards ----------------------------
_PRED, _GOLD = ["regex:email", "regex:card+luhn", "regex:phone-us"], ["regex:email", "regex:phone-intl", "regex:ipv4"]


def _judged(spark, sf_dir):
    def of(sources):
        return S.merge(F.concat(*[S.label(d.hits(F.col("text")), d.label, d.source, d.score, k) for k, d in enumerate(map(_detector, sources))]))

    return _docs(spark, sf_dir).withColumn("predicted", of(_PRED)).withColumn("gold", of(_GOLD))


_SPANS_SQL = "SELECT doc_id, s.start AS start, s.stop AS stop, s.label AS label, s.value AS value FROM ({})"
_P, _G = _SPANS_SQL.format(O.merged(_PRED)), _SPANS_SQL.format(O.merged(_GOLD))
#: spans of one kind rarely touch more than one of the other, so pairs are counted by existence
_PAIRED = f"""p AS ({_P}), g AS ({_G}),
    tp AS (SELECT p.label, count(*) AS n FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.label = p.label AND g.start < p.stop AND p.start < g.stop) GROUP BY 1),
    np AS (SELECT label, count(*) AS n FROM p GROUP BY 1), ng AS (SELECT label, count(*) AS n FROM g GROUP BY 1),
    e AS (SELECT l.label, CAST(coalesce(tp.n, 0) AS BIGINT) AS tp, CAST(coalesce(np.n, 0) - coalesce(tp.n, 0) AS BIGINT) AS fp, CAST(coalesce(ng.n, 0) - coalesce(tp.n, 0) AS BIGINT) AS fn
          FROM (SELECT label FROM np UNION SELECT label FROM ng) l LEFT JOIN tp USING (label) LEFT JOIN np USING (label) LEFT JOIN ng USING (label)),
    r AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM e GROUP BY ROLLUP (label)),
    q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS c FROM r)"""


@query(
    "prf_by_label",
    f"WITH {_PAIRED} SELECT label, tp, fp, fn, round(p, 4) AS precision, round(c, 4) AS recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0.0 END, 4) AS f1 FROM q",
)
def prf_by_label(spark, sf_dir):
    return evalkit.by_label(_judged(spark, sf_dir))


_LEFT_OVER = "SELECT a.doc_id, a.label, a.start, a.stop, substr(a.value, 1, 90) AS text FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE a.doc_id = b.doc_id AND a.start < b.stop AND b.start < a.stop)"


@query("misses_anti", f"WITH p AS ({_P}), g AS ({_G}) " + _LEFT_OVER.format(a="g", b="p"))
def misses_anti(spark, sf_dir):
    return evalkit.unmatched(_judged(spark, sf_dir), "gold", "predicted").withColumnRenamed("end", "stop")


@query("spurious_anti", f"WITH p AS ({_P}), g AS ({_G}) " + _LEFT_OVER.format(a="p", b="g"))
def spurious_anti(spark, sf_dir):
    return evalkit.unmatched(_judged(spark, sf_dir), "predicted", "gold").withColumnRenamed("end", "stop")


_COVERED = "EXISTS (SELECT 1 FROM {s} s WHERE s.doc_id = t.doc_id AND s.start < t.stop AND t.start < s.stop)"
_TOKENS = (
    "SELECT doc_id, sum(gap + size) OVER w - size AS start, sum(gap + size) OVER w AS stop FROM (SELECT doc_id, i, length(h) AS size, length(g) AS gap FROM "
    "(SELECT doc_id, unnest(h) AS h, unnest(g[1:len(h)]) AS g, unnest(range(1, len(h) + 1)) AS i FROM "
    "(SELECT doc_id, regexp_extract_all(f, '\\S+') AS h, regexp_split_to_array(f, '\\S+') AS g FROM (SELECT doc_id, " + O.folded("text") + " AS f FROM documents)))) "
    "WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
)


@query(
    "token_accuracy",
    f"WITH p AS ({_P}), g AS ({_G}), t AS ({_TOKENS}), x AS (SELECT t.doc_id, {_COVERED.format(s='p')} AS a, {_COVERED.format(s='g')} AS b FROM t) "
    "SELECT doc_id, CAST(count_if(a = b) AS BIGINT) AS correct, count(*) AS total FROM x GROUP BY doc_id",
)
def token_accuracy(spark, sf_dir):
    rows = evalkit.token_accuracy(_judged(spark, sf_dir)).where("total > 0")
    return rows.select("doc_id", F.col("correct").cast("long").alias("correct"), F.col("total").cast("long").alias("total"))


_LEAKS = f"""WITH s AS ({_FLAT}), v AS (SELECT doc_id, label, {_SQUEEZED.format(x='value')} AS original, min(start) AS first FROM s WHERE label <> 'EMAIL' GROUP BY ALL),
    e AS (SELECT doc_id, list({{'start': start, 'stop': stop, 'fake': fake}} ORDER BY start) AS x
          FROM (SELECT doc_id, start, stop, {_FAKE} AS fake FROM s WHERE label <> 'EMAIL') GROUP BY doc_id),
    o AS (SELECT d.doc_id, CASE WHEN x IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(x) + 1), lambda n:
        substr(text, coalesce(x[n - 1].stop, 0) + 1, x[n].start - coalesce(x[n - 1].stop, 0)) || x[n].fake), '') || substr(text, x[len(x)].stop + 1) END AS out
        FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id),
    m AS (SELECT doc_id, 'EMAIL' AS label, {_SQUEEZED.format(x='value')} AS original FROM s WHERE label = 'EMAIL' UNION SELECT doc_id, label, original FROM v)
    SELECT label, original, CAST(n AS BIGINT) AS occurrences FROM (SELECT m.label, m.original, len(regexp_extract_all(o.out, '\\Q' || replace(m.original, ' ', '\\E\\s+\\Q') || '\\E')) AS n
    FROM m JOIN o ON m.doc_id = o.doc_id WHERE length(m.original) >= {evalkit.MIN_LEAK}) WHERE n > 0"""


@query("leak_check", _LEAKS)
def leak_check(spark, sf_dir):
    """What is left of all values when a run forgets the e-mail addresses."""
    detected = _detected(spark, sf_dir)
    mapping = Engine().mapping(Engine().edited(detected))
    forgot = detected.withColumn("spans", F.filter("spans", lambda s: s.label != "EMAIL"))
    return evalkit.leaks(mapping, Engine().redact(Engine().edited(forgot))).select("label", "original", "occurrences")


@query("leak_check_whole_run")
def leak_check_whole_run(spark, sf_dir):
    """No replaced value may be left in its document's output: an empty table."""
    edited = _once(Engine().edited(_detected(spark, sf_dir)))
    return evalkit.leaks(Engine().mapping(edited), Engine().redact(edited)).select("label", "original", "occurrences")


_TERMS = [("CRITICAL", "a", "the"), ("CRITICAL", "a", "and the"), ("HIGH", "b", "sh"), ("HIGH", "c", "zzz zzz"), ("LOW", "d", "license")]


@query(
    "reid_audit",
    f"""WITH terms AS ({O.values([("severity", "VARCHAR"), ("anchor", "VARCHAR"), ("term", "VARCHAR")], _TERMS)}),
    d AS (SELECT {O.folded("text")} AS text FROM documents),
    e AS (SELECT severity, anchor, term, len(regexp_extract_all(text, '(?i)\\b' || array_to_string(string_split(term, ' '), '\\s+') || '\\b')) AS n FROM terms, d)
    SELECT severity, anchor, term, CAST(sum(n) AS BIGINT) AS hits FROM e GROUP BY ROLLUP (severity, anchor, term)""",
)
def reid_audit(spark, sf_dir):
    terms = spark.createDataFrame(_TERMS, "severity string, anchor string, term string")
    return evalkit.reidentification(terms, _docs(spark, sf_dir))


@query(
    "samples_top4",
    f"""SELECT label, doc_id, start, substr(value, 1, 70) AS original FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id, start) AS r FROM ({_FLAT})) WHERE r <= 4""",
)
def samples_top4(spark, sf_dir):
    rows = detect_all_merged(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("doc_id", "start"))
    return rows.withColumn("r", rank).where("r <= 4").select("label", "doc_id", "start", F.substring("value", 1, 70).alias("original"))


@query(
    "preview",
    f"""WITH l AS ({_LINES}), f AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM l WHERE regexp_matches(line, '\\S'))
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, substr(line, 1, 600) AS text, total, total > 2 AS truncated FROM f WHERE rank <= 2""",
)
def preview(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_id", "text"))
    return evalkit.preview(rows, 2)


@query("document_text", f"SELECT doc_id, string_agg(line, chr(10) ORDER BY block_id) AS body FROM ({_LINES}) GROUP BY doc_id")
def document_text(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_id", "text"))
    return evalkit.document_text(rows)


@query("normalised_lines", f"SELECT {_NORM.format(x='line')} AS norm, count(*) AS n FROM ({_LINES}) GROUP BY 1")
def normalised_lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return rows.groupBy(normalise(F.col("line")).alias("norm")).agg(F.count("*").alias("n"))


@query("digits_only", "SELECT c_custkey, regexp_replace(c_name, '\\D', '', 'g') AS digits FROM customer")
def digits_only(spark, sf_dir):
    from .functions.checks import digits

    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", digits(F.col("c_name")).alias("digits"))


# -- inline fixtures ----------------------------------------------------------------------------------------------
_TEXTS = [
    ("s1", "", "Write to ana.test@mail.example.org or +91 98765 43210."),
    ("s2", "", "SSN 123-45-6789 and 000-12-3456 and 666-12-3456"),
    ("s3", "", "card 4111 1111 1111 1111, not 4111 1111 1111 1112"),
    ("s4", "", "hosts 10.0.12.7 256.1.1.1 10.01.2.3"),
    ("s5", "", "v6 2001:db8:0:0:0:0:0:1"),
    ("s6", "", "PAN ABCDE1234F; IFSC TEST0ABC123; DIN: 01234567"),
    ("s7", "Director | DIN", "12345678"),
    ("s8", "Item | Qty", "12345678"),
    ("s9", "", "Registration number: 245678"),
    ("s10", "", "Firm registration no. 123456W/W100999"),
    ("s11", "", "Passport No. K1234567"),
    ("s12", "", "Aadhaar 2345 6789 0123"),
    ("s12b", "", "Total 2345 6789 0123"),
    ("s13", "", "Account No. 1234 5678 901"),
    ("s14", "", "Case #5512840 covers order 200003456 billed on invoice 774120."),
    ("s15", "", "Date of birth: 14 March 1988. Board met on March 4, 2021."),
    ("s16", "", "The board met on March 4, 2021."),
    ("s17", "", "WEBSITE www.acmetesting. com"),
    ("s18", "", "Open the page. Firms replied later."),
    ("s19", "", "See https://acme.example.org/u/ana?x=1, thanks"),
    ("a1", "", "He lives at 12 Larkspur Court, Eastmere, Norvale – 411 999, Maharashtra, India."),
    ("a2", "", "Case REF-200417 closed"),
    ("a3", "", "His SSN is 123-45-6789, logged last week, and the parcel went to 22 Tamarind Street, Westbrook, IL 62999, USA."),
    ("a4", "", "Policy QRS-HLT-5581020 renewed"),
    ("g1", "", "GSTIN 29ABCDE1234F1Z5 and CIN L12345AB1234CDE123456 and INZ123456789"),
]
_TEXT_SPANS = [
    ("s1", "EMAIL", "ana.test@mail.example.org"), ("s1", "PHONE", "+91 98765 43210"), ("s2", "SSN", "123-45-6789"),
    ("s3", "CREDIT_CARD", "4111 1111 1111 1111"), ("s4", "IP_ADDRESS", "10.0.12.7"), ("s5", "IP_ADDRESS", "2001:db8:0:0:0:0:0:1"),
    ("s6", "NATIONAL_ID", "ABCDE1234F"), ("s6", "NATIONAL_ID", "TEST0ABC123"), ("s6", "NATIONAL_ID", "01234567"), ("s7", "NATIONAL_ID", "12345678"),
    ("s9", "NATIONAL_ID", "245678"), ("s10", "NATIONAL_ID", "123456W/W100999"), ("s11", "NATIONAL_ID", "K1234567"), ("s12", "NATIONAL_ID", "2345 6789 0123"),
    ("s13", "BANK_ACCOUNT", "1234 5678 901"), ("s15", "DOB", "14 March 1988"), ("s15", "DOB", "March 4, 2021"), ("s17", "URL", "www.acmetesting. com"),
    ("s19", "URL", "https://acme.example.org/u/ana?x=1"),
    ("a1", "ADDRESS", "12 Larkspur Court, Eastmere, Norvale – 411 999, Maharashtra, India."), ("a3", "SSN", "123-45-6789"),
    ("a3", "ADDRESS", "and the parcel went to 22 Tamarind Street, Westbrook, IL 62999, USA."),
    ("g1", "NATIONAL_ID", "29ABCDE1234F1Z5"), ("g1", "NATIONAL_ID", "L12345AB1234CDE123456"), ("g1", "NATIONAL_ID", "INZ123456789"),
]


@query("fx_detect", O.values([("id", "VARCHAR"), ("label", "VARCHAR"), ("value", "VARCHAR")], _TEXT_SPANS))
def fx_detect(spark, sf_dir):
    rows = spark.createDataFrame(_TEXTS, "id string, section string, text string")
    found = rows.withColumn("spans", S.merge(detectors.detect(F.col("text"), F.col("section"))))
    return found.select("id", F.explode("spans").alias("s")).select("id", "s.label", F.col("s.text").alias("value"))


_MERGE = [
    ("m1", 0, 10, "ADDRESS", 1.0), ("m1", 5, 12, "SSN", 1.0), ("m1", 20, 25, "PERSON", 0.95), ("m1", 20, 25, "PHONE", 0.9),
    ("m2", 0, 4, "ORG", 0.6), ("m2", 0, 4, "ORG", 0.95), ("m3", 0, 5, "EMAIL", 1.0), ("m3", 5, 9, "URL", 0.9),
]


@query(
    "fx_merge",
    O.values(
        [("id", "VARCHAR"), ("start", "INTEGER"), ("stop", "INTEGER"), ("label", "VARCHAR"), ("score", "DOUBLE")],
        [("m1", 0, 10, "ADDRESS", 1.0), ("m1", 20, 25, "PHONE", 0.9), ("m2", 0, 4, "ORG", 0.95), ("m3", 0, 5, "EMAIL", 1.0), ("m3", 5, 9, "URL", 0.9)],
    ),
)
def fx_merge(spark, sf_dir):
    rows = spark.createDataFrame([(*r, k) for k, r in enumerate(_MERGE)], "id string, start int, end int, label string, score double, ord int")
    span = F.struct("start", "end", "label", F.lit("").alias("text"), F.lit("").alias("source"), "score", "ord")
    found = rows.groupBy("id").agg(F.collect_list(span).alias("spans")).withColumn("spans", S.merge(F.col("spans")))
    return found.select("id", F.explode("spans").alias("s")).select("id", "s.start", F.col("s.end").alias("stop"), "s.label", "s.score")


_STORY = [
    "Mr. Arjun Testwalla is our treasurer.", "Zenvale Components Private Limited (“Zenvale”) supplied parts.",
    "Office at 12 Larkspur Court, Eastmere, Norvale – 411 999, Maharashtra, India", "Payment by TESTWALLA and Zenvale.",
    "Our Eastmere plant near Norvale 411 999 opened.", "The buyer was Mr. Bo Lux of the trade desk.", "signed for Bo", "Lux yesterday",
]


def _story(spark) -> DataFrame:
    rows = [("d1", k, "body", "", t) for k, t in enumerate(_STORY)] + [("d2", 0, "body", "", "zenvale in lower case stays")]
    return spark.createDataFrame(rows, "doc_id string, block_id int, part string, section string, text string")


def _story_rows(spark) -> DataFrame:
    rows = [("d2", 0, 1, ["Name", "Holding"], ["Rupa K. Sample", "39,062"]), ("d2", 0, 2, ["Name", "Holding"], ["the Offer Price", "1"])]
    return spark.createDataFrame(rows, "doc_id string, table_id int, row_id int, header array<string>, cells array<string>")


_V3 = [("doc_id", "VARCHAR"), ("kind", "VARCHAR"), ("name", "VARCHAR")]


@query(
    "fx_learn",
    O.values(
        _V3,
        [
            ("d1", "PERSON", "Arjun Testwalla"), ("d1", "PERSON", "Bo Lux"), ("d1", "ORG", "Zenvale Components Private Limited"),
            ("d1", "PLACE", "Larkspur Court"), ("d1", "PLACE", "Eastmere"), ("d1", "PLACE", "Norvale"), ("d1", "PLACE", "Maharashtra"), ("d2", "PERSON", "Rupa K. Sample"),
        ],
    ),
)
def fx_learn(spark, sf_dir):
    lexicon = Engine().learn(_story(spark), _story_rows(spark))
    return lexicon.where(F.col("kind").isin("PERSON", "ORG", "PLACE")).select("doc_id", "kind", "name")


@query(
    "fx_aliases",
    O.values(
        [("doc_id", "VARCHAR"), ("alias", "VARCHAR"), ("owner", "VARCHAR")],
        [("d1", a, "arjun testwalla") for a in ("arjun testwalla", "a. testwalla", "arjun", "testwalla")]
        + [("d1", a, "bo lux") for a in ("bo lux", "b. lux")]
        + [("d1", a, "zenvale components private limited") for a in ("zenvale components private limited", "zenvale components", "zenvale")]
        + [("d2", a, "rupa k. sample") for a in ("rupa k. sample", "rupa sample", "r. sample", "rupa", "sample")],
    ),
)
def fx_aliases(spark, sf_dir):
    lexicon = Engine().learn(_story(spark), _story_rows(spark))
    return lexicon.where(F.col("kind").startswith("ALIAS")).select("doc_id", "alias", F.col("key").alias("owner"))


@query(
    "fx_match",
    O.values(
        [("block_id", "INTEGER"), ("label", "VARCHAR"), ("value", "VARCHAR")],
        [
            (0, "PERSON", "Arjun Testwalla"), (1, "ORG", "Zenvale Components Private Limited"), (1, "ORG", "Zenvale"),
            (2, "ADDRESS", "12 Larkspur Court, Eastmere, Norvale – 411 999, Maharashtra, India"), (3, "PERSON", "TESTWALLA"), (3, "ORG", "Zenvale"),
            (4, "LOCATION", "Eastmere"), (4, "LOCATION", "Norvale 411 999"), (5, "PERSON", "Bo Lux"),
        ],
    ),
)
def fx_match(spark, sf_dir):
    blocks = _story(spark)
    found = Engine().detect(blocks, Engine().learn(blocks)).select("block_id", F.explode("spans").alias("s"))
    return found.select("block_id", "s.label", F.col("s.text").alias("value"))


@query("fx_cross_block", O.values([("block_id", "INTEGER"), ("redacted", "VARCHAR")], [(6, "signed for [PERSON_3]"), (7, " yesterday")]))
def fx_cross_block(spark, sf_dir):
    out = Engine(Policy(mode="tag")).run(_story(spark))["redacted"]
    return out.where("doc_id = 'd1' AND block_id IN (6, 7)").select("block_id", "redacted")


@query(
    "fx_links",
    O.values(
        [("id", "VARCHAR"), ("same", "BOOLEAN"), ("shape", "VARCHAR")],
        [("l1", False, "mailto:*.example.com"), ("l2", False, "https://*.example.com/p"), ("l3", True, "file:///x")],
    ),
)
def fx_links(spark, sf_dir):
    rows = [("d", "l1", "mailto:ana.test@acme.example.org"), ("d", "l2", "https://acme.example.org/p"), ("d", "l3", "file:///x")]
    out = links.rewrite_links(spark.createDataFrame(rows, "doc_id string, rel_id string, target string"))
    masked = F.regexp_replace(F.regexp_replace("rewritten", r"^(mailto:).*(\.example\.com)$", "$1*$2"), r"^(https://)[^/]*(\.example\.com)", "$1*$2")
    return out.select(F.col("rel_id").alias("id"), (F.col("rewritten") == F.col("target")).alias("same"), masked.alias("shape"))


@query("fx_fields", O.values([("field_id", "INTEGER"), ("n", "INTEGER"), ("kept", "BOOLEAN")], [(0, 1, False), (1, 0, True)]))
def fx_fields(spark, sf_dir):
    rows = [("d", 0, 'HYPERLINK "mailto:ana.test@acme.example.org"'), ("d", 1, "PAGE")]
    out = links.redact_fields(spark.createDataFrame(rows, "doc_id string, field_id int, text string"))
    return out.select("field_id", F.size("spans").alias("n"), F.col("redacted").contains("ana.test").__or__(F.col("redacted") == F.col("text")).alias("kept"))


_PICTURES = [
    # name, width, height, text, codes, faces, ink, saturation, stroke, readable, engines, measured, context, label
    ("icon", 12, 12, "", [], 0, 0.05, 0.0, 0.0, True, True, True, "", ""),
    ("broken", 300, 200, "", [], 0, 0.0, 0.0, 0.0, False, True, True, "", "IMAGE_UNCLASSIFIED"),
    ("blind", 420, 260, "", [], 0, 0.0, 0.0, 0.0, True, False, False, "", "IMAGE_UNCLASSIFIED"),
    ("face", 420, 260, "", [], 1, 0.2, 0.0, 0.0, True, True, True, "", "IMAGE_ID_DOCUMENT"),
    ("card", 420, 260, "Date of Birth 06/05/1988\nPAN ABCDE1234F", [], 0, 0.2, 0.0, 0.0, True, True, True, "", "IMAGE_ID_DOCUMENT"),
    ("code", 200, 200, "", ["https://acme.example.org/x"], 0, 0.4, 0.0, 0.0, True, True, True, "", "IMAGE_CODE"),
    ("caption", 400, 300, "", [], 0, 0.05, 90.0, 0.0, True, True, True, "For and on behalf of the Board", "IMAGE_SIGNATURE"),
    ("ink", 300, 100, "", [], 0, 0.05, 20.0, 0.02, True, True, True, "", "IMAGE_SIGNATURE"),
    ("contact", 900, 700, "www.acme.example.org", [], 0, 0.5, 10.0, 0.0, True, True, True, "", "IMAGE_LOGO"),
    ("mark", 300, 110, "", [], 0, 0.05, 80.0, 0.0, True, True, True, "", "IMAGE_LOGO"),
    ("blank", 900, 700, "", [], 0, 0.0005, 0.0, 0.0, True, True, True, "", ""),
    ("photo", 900, 700, "", [], 0, 0.5, 10.0, 0.0, True, True, True, "", "IMAGE_UNCLASSIFIED"),
]


@query(
    "fx_image_decision",
    O.values(
        [("name", "VARCHAR"), ("label", "VARCHAR"), ("action", "VARCHAR")],
        [(p[0], p[-1], "kept" if p[-1] == "" else "replaced") for p in _PICTURES],
    ),
)
def fx_image_decision(spark, sf_dir):
    schema = "name string, width int, height int, ocr_text string, codes array<string>, faces int, ink_ratio double, saturation double, stroke_fraction double, readable boolean, engines boolean, ink_measured boolean, context string"
    rows = spark.createDataFrame([p[:-1] for p in _PICTURES], schema).withColumn("format", F.lit("PNG")).withColumn("doc_id", F.lit("d"))
    names = [c.split()[0] for c in images.EVIDENCE.split(", ")]
    return images.decide(rows.select("doc_id", "name", "context", F.struct(*names).alias("evidence"))).select("name", "label", "action")


@query(
    "fx_image_summary",
    O.values([("name", "VARCHAR"), ("summary", "VARCHAR")], [("card", "2 text line(s), 39 chars; 420x260 PNG; ink=0.200"), ("face", "1 face(s); 420x260 PNG; ink=0.200")]),
)
def fx_image_summary(spark, sf_dir):
    schema = "name string, width int, height int, ocr_text string, codes array<string>, faces int, ink_ratio double, readable boolean"
    rows = [(p[0], p[1], p[2], p[3], p[4], p[5], p[6], p[9]) for p in _PICTURES if p[0] in ("card", "face")]
    df = spark.createDataFrame(rows, schema).withColumn("format", F.lit("PNG"))
    return df.select("name", images.summary(F.struct(*[c for c in df.columns])).alias("summary"))


@query(
    "fx_scores",
    O.values(
        [("kind", "VARCHAR"), ("tp", "INTEGER"), ("fp", "INTEGER"), ("fn", "INTEGER")], [("typed", 1, 1, 1), ("exact", 0, 2, 2), ("untyped", 2, 0, 0)]
    ),
)
def fx_scores(spark, sf_dir):
    span = "array<struct<start:int,end:int,label:string,text:string>>"
    rows = spark.createDataFrame([([(0, 5, "PERSON", ""), (10, 15, "ORG", "")], [(0, 6, "PERSON", ""), (10, 15, "PERSON", "")])], f"predicted {span}, gold {span}")
    parts = [
        evalkit.counts(rows, typed, exact).select(F.lit(kind).alias("kind"), "tp", "fp", "fn")
        for kind, typed, exact in (("typed", True, False), ("exact", True, True), ("untyped", False, False))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "fx_cell_labels",
    O.values(
        [("id", "VARCHAR"), ("label", "VARCHAR"), ("value", "VARCHAR")],
        [("c1", "DOB", "17 May 1990"), ("c2", "NATIONAL_ID", "2345 6789 0123"), ("c3", "BANK_ACCOUNT", "12345678901234")],
    ),
)
def fx_cell_labels(spark, sf_dir):
    rows = [("c1", "Date of birth", "17 May 1990"), ("c2", "Aadhaar", "2345 6789 0123"), ("c3", "Bank account number", "12345678901234"), ("c4", "Amount", "1,10,000")]
    df = spark.createDataFrame(rows, "id string, row_label string, text string")
    df = df.withColumn("column_label", F.lit("Detail")).withColumn("section", F.lit("")).withColumn("doc_id", F.col("id"))
    found = Engine(Policy(use_cell_labels=True)).detect(df)
    return found.select("id", F.explode("spans").alias("s")).select("id", "s.label", F.col("s.text").alias("value"))


@query(
    "fx_splice",
    O.values([("id", "INTEGER"), ("out", "VARCHAR")], [(1, "x [A] z"), (2, "[A][B]c"), (3, "abc")]),
)
def fx_splice(spark, sf_dir):
    rows = [(1, "x yy z", [(2, 4, "[A]")]), (2, "abc", [(0, 1, "[A]"), (1, 2, "[B]")]), (3, "abc", [])]
    df = spark.createDataFrame(rows, "id int, text string, edits array<struct<start:int,end:int,replacement:string>>")
    return df.select("id", S.splice(F.col("text"), F.col("edits")).alias("out"))


@query("fx_squeeze", O.values([("out", "VARCHAR")], [("a b c",)]))
def fx_squeeze(spark, sf_dir):
    return spark.createDataFrame([(" a\t b \nc ",)], "t string").select(squeeze(F.col("t")).alias("out"))


def _packages(spark) -> DataFrame:
    rows = [(name, bytearray(content)) for name, content in sorted(samples.samples().items())]
    return spark.createDataFrame(rows, "doc_id string, content binary")


@query(
    "fx_docx_blocks",
    O.values(
        [("doc_id", "VARCHAR"), ("block_id", "INTEGER"), ("part", "VARCHAR"), ("section", "VARCHAR"), ("text", "VARCHAR")],
        [
            ("ticket_log.docx", 0, "body", "", "Ticket log"),
            *[("ticket_log.docx", 1 + k, "body", "Ticket | Date | Customer | Contact", t) for k, t in enumerate(
                ["Ticket", "Date", "Customer", "Contact", "TKT-100294", "04/03/2021", "Mr. Bo Luxemore", "bo.luxemore@mail.example.org"])],
            ("ticket_log.docx", 9, "body", "", "Card 4111 1111 1111 1111 was charged twice from 10.0.12.7."),
            ("ticket_log.docx", 10, "body", "", "Mr. Bo Luxemore is our client; Luxemore called again."),
        ],
    ),
)
def fx_docx_blocks(spark, sf_dir):
    return docx.blocks(_packages(spark)).where("doc_id = 'ticket_log.docx'").drop("pieces")


@query(
    "fx_docx_rows",
    O.values(
        [("doc_id", "VARCHAR"), ("row_id", "INTEGER"), ("cells", "VARCHAR")],
        [
            ("claim_form.docx", 1, "PAN|ABCDE1234F"), ("claim_form.docx", 2, "Bank account number|12345678901234"), ("claim_form.docx", 3, "Sum insured|1,10,000"),
            ("offer_letter.docx", 1, "Rupa K. Sample|39,062"), ("ticket_log.docx", 1, "TKT-100294|04/03/2021|Mr. Bo Luxemore|bo.luxemore@mail.example.org"),
        ],
    ),
)
def fx_docx_rows(spark, sf_dir):
    return docx.table_rows(_packages(spark)).select("doc_id", "row_id", F.array_join("cells", "|").alias("cells"))


@query(
    "fx_docx_images",
    O.values(
        [("doc_id", "VARCHAR"), ("name", "VARCHAR"), ("context", "VARCHAR"), ("label", "VARCHAR")],
        [("offer_letter.docx", "/word/media/image1.png", "For and on behalf of the Board", "IMAGE_UNCLASSIFIED")],
    ),
)
def fx_docx_images(spark, sf_dir):
    found = images.analyse(docx.images(_packages(spark)))
    decided = images.decide(found).select("doc_id", "name", "label")
    # the context ends with the paragraph next to the picture
    return found.select("doc_id", "name", F.regexp_extract("context", "(For and on behalf of the Board)$", 1).alias("context")).join(decided, ["doc_id", "name"])


@query(
    "fx_docx_rewrite",
    O.values(
        [("doc_id", "VARCHAR"), ("block_id", "INTEGER"), ("text", "VARCHAR")],
        [("ticket_log.docx", 8, "[EMAIL_1]"), ("ticket_log.docx", 9, "Card [CREDIT_CARD_1] was charged twice from [IP_ADDRESS_1]."), ("ticket_log.docx", 10, "Mr. [PERSON_1] is our client; [PERSON_2] called again.")],
    ),
)
def fx_docx_rewrite(spark, sf_dir):
    """Read, redact, write back, read again."""
    packages = _packages(spark).where("doc_id = 'ticket_log.docx'")
    redacted = Engine(Policy(mode="tag")).run(docx.blocks(packages).drop("pieces"), docx.table_rows(packages))["redacted"]
    out = docx.rewritten(packages, redacted.select("doc_id", "block_id", "edits"))
    return docx.blocks(out).where("block_id >= 8").select("doc_id", "block_id", "text")


@query("fx_terms", O.values([("severity", "VARCHAR"), ("anchor", "VARCHAR"), ("term", "VARCHAR")], [("CRITICAL", "a", "x"), ("CRITICAL", "a", "y"), ("HIGH", "b", "z")]))
def fx_terms(spark, sf_dir):
    raw = spark.createDataFrame([('{"_comment": ["no"], "CRITICAL": {"a": ["x", "y"]}, "HIGH": {"b": ["z"]}}',)], "value string")
    return files.terms_of(raw)


@query(
    "fx_mapping_json",
    O.values([("doc_id", "VARCHAR"), ("json", "VARCHAR")], [("d", '{"ORG":{"Acme":"X"},"PERSON":{"Ana":"Bea","Zed":"Yan"}}')]),
)
def fx_mapping_json(spark, sf_dir):
    rows = [("d", "PERSON", "Zed", "Yan"), ("d", "ORG", "Acme", "X"), ("d", "PERSON", "Ana", "Bea")]
    return files.mapping_json(spark.createDataFrame(rows, "doc_id string, label string, original string, replacement string"))


@query(
    "fx_csv",
    O.values(
        [(c, "VARCHAR") for c in files.CSV_COLUMNS],
        [("3", "body", "IP_ADDRESS", "10.0.12.7", "10.1.2.3", "10.1.2.3", "regex:ipv4", "1.00"), ("/word/media/i.png", "media", "IMAGE_CLEAN", "12x12 PNG; ink=0.050", "kept", "", "image:icon", "1.00")],
    ),
)
def fx_csv(spark, sf_dir):
    audit = spark.createDataFrame(
        [("d", 3, "body", "IP_ADDRESS", 0, 9, "10.0.12.7", "10.1.2.3", "10.1.2.3", "regex:ipv4", "1.00")],
        "doc_id string, block int, part string, label string, start int, end int, original string, replacement string, find_in_output string, detector string, score string",
    )
    pictures = spark.createDataFrame([("d", "/word/media/i.png", "", "icon", "kept", "12x12 PNG; ink=0.050")], "doc_id string, name string, label string, reason string, action string, summary string")
    return files.detections_csv(audit, pictures).drop("doc_id")


@query(
    "fx_surrogate_rules",
    O.values(
        [("rule", "VARCHAR"), ("holds", "BOOLEAN")],
        [(r, True) for r in ("surname kept", "capitals kept", "mail follows name", "company core", "company acronym", "suffix spelled", "link path", "phone layout", "place code", "initial kept")],
    ),
)
def fx_surrogate_rules(spark, sf_dir):
    """Related values stay related: one row a rule."""
    lex = spark.createDataFrame(
        [
            ("d", "PERSON", "arjun testwalla", "Arjun Testwalla", None, 1, ["x"], None), ("d", "ORG", "ksh trading limited", "KSH Trading LIMITED", None, 1, ["x"], None),
            ("d", "ALIAS:ORG", "ksh trading limited", "KSH", "ksh", 0, ["x"], None), ("d", "ALIAS:ORG", "ksh trading limited", "KSH Trading", "ksh trading", 0, ["x"], None),
            ("d", "ALIAS:ORG", "ksh trading limited", "KSH Trading LIMITED", "ksh trading limited", 0, ["x"], None), ("d", "PLACE", "norvale", "Norvale", None, 0, ["x"], None),
        ],
        learn.LEXICON,
    )
    values = [("PERSON", "Arjun Testwalla"), ("PERSON", "TESTWALLA"), ("PERSON", "A. Testwalla"), ("EMAIL", "arjun.testwalla@kshtrading.com"), ("ORG", "KSH Trading Limited"), ("ORG", "KSH Trading"),
              ("ORG", "KSH"), ("URL", "https://www.kshtrading.com/u/testwalla"), ("PHONE", "+91 (20) 4505-3237"), ("LOCATION", "Norvale – 411 999")]
    blocks = spark.createDataFrame([("d", k, label, v) for k, (label, v) in enumerate(values)], "doc_id string, block_id int, label string, v string")
    span = F.struct(F.lit(0).alias("start"), F.length("v").alias("end"), "label", F.col("v").alias("text"), F.lit("").alias("source"), F.lit(1.0).alias("score"), F.lit(0).alias("ord"))
    m = Engine().mapping(Engine().edited(blocks.select("doc_id", "block_id", F.array(span).alias("spans")), lex))
    one = m.agg(*[F.max(F.when((F.col("label") == label) & (F.col("original") == v), F.col("replacement"))).alias(f"v{k}") for k, (label, v) in enumerate(values)])
    last, low = F.element_at(F.split("v0", " "), -1), F.lower("v0")
    plain = lambda c: F.regexp_replace(c, r"\d", "0")
    rules = {
        "surname kept": F.lower("v1") == F.lower(last),
        "capitals kept": F.col("v1") == F.upper("v1"),
        "mail follows name": F.col("v3").startswith(F.concat(F.regexp_replace(low, " ", "."), F.lit("@"))) & F.col("v3").endswith(".example.com"),
        "company core": F.col("v4") == F.concat(F.col("v5"), F.lit(" Limited")),
        "company acronym": F.col("v6") == F.array_join(F.transform(F.split("v5", " "), lambda w: F.substring(w, 1, 1)), ""),
        "suffix spelled": F.col("v4").endswith(" Limited"),
        "link path": F.col("v7").endswith(F.concat(F.lit(".example.com/u/"), F.lower(last))) & F.col("v7").startswith("https://www."),
        "phone layout": (plain("v8") == "+00 (00) 0000-0000") & F.col("v8").startswith("+91"),
        "place code": F.col("v9").rlike(r"^\p{L}[\p{L} ]+ – \d{3} \d{3}$"),
        "initial kept": F.col("v2").rlike(r"^[A-Z]\. ") & F.col("v2").endswith(last),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("holds")) for k, v in rules.items()])).alias("r")).select("r.*")


@query(
    "fx_rejections",
    O.values(
        [("kind", "VARCHAR"), ("name", "VARCHAR"), ("reason", "VARCHAR")],
        [("PERSON", "Ana Harbour", "contains a word the document uses in prose"), ("PERSON", "Mira RTA", "contains an abbreviation, not a given name"), ("ORG", "Securities Limited", "bare legal suffix, no name")],
    ),
)
def fx_rejections(spark, sf_dir):
    texts = ["Ms. Ana Harbour is our guest.", "the harbour and a harbour by the harbour", "being Mira RTA today", "paid to Securities Limited today"]
    blocks = spark.createDataFrame([("d", k, "body", "", t) for k, t in enumerate(texts)], "doc_id string, block_id int, part string, section string, text string")
    found = Engine().learn(blocks).where(F.col("kind").startswith("REJECTED"))
    return found.select(F.regexp_extract("kind", ":(.*)", 1).alias("kind"), "name", "reason")


@query("fx_lexicon_summary", O.values([("doc_id", "VARCHAR"), ("people", "BIGINT"), ("companies", "BIGINT"), ("aliases", "BIGINT"), ("places", "BIGINT"), ("rejected", "BIGINT")], [("d1", 2, 1, 9, 4, 0), ("d2", 1, 0, 5, 0, 0)]))
def fx_lexicon_summary(spark, sf_dir):
    return lexicon_summary(Engine().learn(_story(spark), _story_rows(spark)))


@query("fx_leaks", O.values([("original", "VARCHAR"), ("occurrences", "BIGINT")], [("Acme (North) Ltd.", 2)]))
def fx_leaks(spark, sf_dir):
    mapping = spark.createDataFrame([("d", "ORG", "Acme (North) Ltd.", "x"), ("d", "ORG", "abc", "y"), ("d", "ORG", "Gone Ltd.", "z")], "doc_id string, label string, original string, replacement string")
    out = spark.createDataFrame([("d", "still Acme  (North)\tLtd. and Acme (North) Ltd."), ("e", "Gone Ltd.")], "doc_id string, redacted string")
    return evalkit.leaks(mapping, out).select("original", "occurrences")


@query("fx_image_leaks", O.values([("name", "VARCHAR"), ("original", "VARCHAR")], [("i1", "Zenvale Components")]))
def fx_image_leaks(spark, sf_dir):
    mapping = spark.createDataFrame([("d", "ORG", "Zenvale Components", "x"), ("d", "ORG", "Acme", "y")], "doc_id string, label string, original string, replacement string")
    recovered = spark.createDataFrame([("d", "i1", "ZENVALE\ncompo nents"), ("d", "i2", "acme")], "doc_id string, name string, text string")
    return evalkit.image_leaks(mapping, recovered).select("name", "original")


@query("fx_before_after", O.values([("name", "VARCHAR"), ("same", "BOOLEAN")], [("a", True), ("b", False), ("c", None)]))
def fx_before_after(spark, sf_dir):
    schema = "doc_id string, name string, content binary"
    before = spark.createDataFrame([("d", n, bytearray(b"1")) for n in "abc"], schema)
    after = spark.createDataFrame([("d", "a", bytearray(b"1")), ("d", "b", bytearray(b"2"))], schema)
    return evalkit.before_after(before, after).select("name", (F.col("before") == F.col("after")).alias("same"))


@query("fx_run_writeback", O.values([("k", "INTEGER"), ("piece", "VARCHAR")], [(0, "Mr. [PERSON_1]"), (1, ""), (2, " signed"), (3, "\t"), (4, "[EMAIL_1]"), (5, " now")]))
def fx_run_writeback(spark, sf_dir):
    """What replaces a span goes into the first run it touches; breaks stay."""
    pieces = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(e).alias("editable")) for t, e in (("Mr. An", True), ("a Sample", True), (" signed", True), ("\t", False), ("a@b.ex", True), ("ample.org now", True))])
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("replacement")) for a, b, r in ((4, 14, "[PERSON_1]"), (22, 37, "[EMAIL_1]"))])
    return spark.range(1).select(F.posexplode(S.write_back(pieces, edits)).alias("k", "p")).select("k", F.col("p.text").alias("piece"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents with their structured spans replaced by numbered tags."""
    return redact_tag(spark, sf_dir)
