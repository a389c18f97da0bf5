"""SQL for the queries that have an equivalent in DuckDB: generators and fixed statements.

RE2 knows neither look-around nor Unicode boundaries. So patterns, spelled out here anew, run
over a folded text, in which every letter, mark and digit beyond ASCII is one underscore and
every space one blank: boundaries fall where Unicode has them, places stay, and values are
cut from the text itself."""

from __future__ import annotations

from .functions import lexicons as L
from .policy import Policy

SEED = Policy.seed
SEP = "␟"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(columns: list[tuple[str, str]], rows: list[tuple]) -> str:
    """SELECT of literal rows; columns are (name, type)."""

    def lit(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else quoted(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns)
    return f"SELECT {cast} FROM (VALUES {body}) AS t({', '.join(n for n, _ in columns)})"


def folded(text: str) -> str:
    for kept, sign in (("L", "_"), ("M", "_"), ("Nd", "_"), ("Z", " ")):
        text = f"regexp_replace({text}, '[^\\x00-\\x7F\\P{{{kept}}}]', '{sign}', 'g')"
    return text


DIGITS = "regexp_replace({x}, '\\D', '', 'g')"
LUHN = (
    "(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN "
    "CASE WHEN 2 * CAST(substr(reverse({d}), i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(reverse({d}), i, 1) AS INTEGER) - 9 "
    "ELSE 2 * CAST(substr(reverse({d}), i, 1) AS INTEGER) END ELSE CAST(substr(reverse({d}), i, 1) AS INTEGER) END)) % 10 = 0)"
)
_D = DIGITS.format(x="value")
_PHONE = f"length({_D}) BETWEEN 8 AND 15"
_LONG = f"length({_D}) BETWEEN 13 AND 19 AND " + LUHN.format(d=_D)
_V4 = "len(list_filter(string_split(value, '.'), lambda p: CAST(p AS INTEGER) > 255 OR (p <> '0' AND starts_with(p, '0')))) = 0"
_INDIAN = f"length({_D}) = 10 AND substr({_D}, 1, 1) IN ('6','7','8','9')"
_PLUS = "starts_with(ltrim(value), '+')"
_SSN = "substr(value, 1, 3) NOT IN ('000', '666') AND substr(value, 1, 1) <> '9' AND substr(value, 5, 2) <> '00' AND substr(value, 8) <> '0000'"
_NO = "\\s*(?:no\\.?|number)?\\s*"
# source: order, label, score, pattern, group, condition on value, condition on text
DETECTORS = {
    "regex:email": (0, "EMAIL", 1.0, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, None, None),
    "regex:url": (1, "URL", 0.9, r"""\b(?:https?://|www\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[^\s,;)"']*)?""", 0, None, None),
    "regex:phone-anchored": (3, "PHONE", 1.0, r"(?i)\b(?:tel|telephone|phone|mobile|mob|fax|contact\s*no|contact\s*number|helpline)\b" + _NO + r"[:.\-]?\s*([+\d][\d\s\-().]{6,20}\d)", 1, _PHONE, None),
    "regex:phone-intl": (4, "PHONE", 0.9, r"\+\s?\d{1,3}[\s\-.]?(?:\(?\d{2,5}\)?[\s\-.]?){1,4}\d{2,5}", 0, f"{_PHONE} AND ({_PLUS} OR ({_INDIAN}))", None),
    "regex:phone-us": (5, "PHONE", 0.9, r"\(?\b\d{3}\)?[\s\-.]\d{3}[\s\-.]\d{4}\b", 0, f"{_PHONE} AND ({_PLUS} OR length({_D}) = 10)", None),
    "regex:phone-in-mobile": (6, "PHONE", 0.9, r"\b[6-9]\d{4}[\s\-]?\d{5}\b", 0, f"{_PHONE} AND {_INDIAN}", None),
    "regex:ssn": (7, "SSN", 1.0, r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", 0, _SSN, None),
    "regex:card+luhn": (8, "CREDIT_CARD", 1.0, r"\b(?:\d[ -]?){12,18}\d\b", 0, _LONG, None),
    "regex:ipv4": (9, "IP_ADDRESS", 1.0, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0, _V4, None),
    "regex:ipv6": (10, "IP_ADDRESS", 0.8, r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b", 0, None, None),
    "regex:pan": (11, "NATIONAL_ID", 1.0, r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0, None, None),
    "regex:cin": (12, "NATIONAL_ID", 1.0, r"\b[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}\b", 0, None, None),
    "regex:sebi-reg": (13, "NATIONAL_ID", 1.0, r"\bIN[A-Z][0-9]{9}\b", 0, None, None),
    "regex:ifsc": (14, "NATIONAL_ID", 1.0, r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0, None, None),
    "regex:gstin": (15, "NATIONAL_ID", 1.0, r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b", 0, None, None),
    "regex:din": (16, "NATIONAL_ID", 1.0, r"(?i)\bDIN\s*[:\-]?\s*([0-9]{8})\b", 1, None, None),
    "regex:firm-registration": (17, "NATIONAL_ID", 1.0, r"(?i)\b(?:firm\s+)?registration" + _NO + r"[:\-]?\s*([0-9]{6}[A-Z](?:\s*/\s*[A-Z]?[0-9]{6})?)\b", 1, None, None),
    "regex:registration-number": (18, "NATIONAL_ID", 0.95, r"(?i)\b(?:registration|regn\.?|reg\.?|licen[cs]e|membership)" + _NO + r"[:\-]?\s*([A-Z]{0,3}[-/]?[0-9]{5,8}[A-Z]?)\b", 1, None, None),
    "regex:passport": (19, "NATIONAL_ID", 1.0, r"(?i)\bpassport" + _NO + r"[:\-]?\s*([A-PR-WY][0-9]{7})\b", 1, None, None),
    "regex:aadhaar": (20, "NATIONAL_ID", 0.9, r"\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b", 0, None, r"(?i)\b(?:aadhaar|aadhar|uidai)\b"),
    "regex:bank-account": (21, "BANK_ACCOUNT", 0.9, r"(?i)\b(?:a/c|ac|account)" + _NO + r"[:\-]?\s*([0-9][0-9\s\-]{7,20}[0-9])\b", 1, None, None),
}
#: Which label wins between spans of equal length.
PRIORITY = {
    "CREDIT_CARD": 100, "SSN": 100, "IP_ADDRESS": 95, "EMAIL": 90, "NATIONAL_ID": 85, "BANK_ACCOUNT": 85, "PHONE": 80, "URL": 75, "DOB": 70,
    "ADDRESS": 60, "PERSON": 50, "ORG": 40, "LOCATION": 30,
}


def hits(source: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """doc_id, start, stop, value, label, source, score, ord of one detector."""
    ord_, label, score, pattern, group, keep, when = DETECTORS[source]
    p, sums = quoted(pattern), "list_sum(list_transform({}, lambda x: length(x)))"
    end = f"{sums.format('g[1:i]')} + {sums.format('h[1:i]')}"
    there = f" WHERE regexp_matches(f, {quoted(when)})" if when else ""
    value = f"substr(t, CAST({end} - length(v[i]) + 1 AS BIGINT), length(v[i]))"
    rows = (
        f"SELECT doc_id, CAST({end} - length(v[i]) AS INTEGER) AS start, CAST({end} AS INTEGER) AS stop, {value} AS value, "
        f"'{label}' AS label, '{source}' AS source, CAST({score} AS DOUBLE) AS score, {ord_} AS ord FROM "
        f"(SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(f, {p}) AS h, "
        f"regexp_extract_all(f, {p}, {group}) AS v, regexp_split_to_array(f, {p}) AS g FROM "
        f"(SELECT {key} AS doc_id, {text} AS t, {folded(text)} AS f FROM {table}){there}))"
    )
    return f"SELECT * FROM ({rows})" + (f" WHERE {keep}" if keep else "")


def merged(sources: list[str], table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """doc_id, s (struct) of the spans that stay after merging."""
    union = " UNION ALL ".join(hits(s, table, key, text) for s in sources)
    rank = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " END"
    item = "{'start': start, 'stop': stop, 'value': value, 'label': label, 'source': source, 'score': score}"
    fold = (
        "list_reduce(list_prepend([x[1:0]][1], list_transform(x, lambda e: [e])), lambda kept, e: "
        "CASE WHEN len(list_filter(kept, lambda k: k.start < e[1].stop AND e[1].start < k.stop)) > 0 THEN kept ELSE list_concat(kept, e) END)"
    )
    return (
        f"SELECT doc_id, unnest({fold}) AS s FROM (SELECT doc_id, list({item} ORDER BY start - stop, -({rank}), -score, start, ord) AS x FROM ({union}) GROUP BY doc_id)"
    )


#: All detectors of structured values.
MAIN = list(DETECTORS)


def stream(kind: str, value: str) -> str:
    """Hex digits that surrogates are drawn from."""
    return f"sha256(concat_ws('{SEP}', '{SEED}', '{kind}', {value}))"


def digit(hex_: str, k: str) -> str:
    return f"(CAST('0x' || substr({hex_}, ({k}) % 32 * 2 + 1, 2) AS INTEGER) % 10)"


def surrogate_phone(v: str) -> str:
    h, k = stream("phone", DIGITS.format(x=v)), DIGITS.format(x=f"substr({v}, 1, i - 1)")
    one = f"CASE WHEN regexp_matches(substr({v}, i, 1), '^\\d$') AND NOT (starts_with(ltrim({v}), '+') AND length({k}) < 2) THEN CAST({digit(h, f'length({k})')} AS VARCHAR) ELSE substr({v}, i, 1) END"
    return f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: {one}), '')"


def surrogate_card(v: str) -> str:
    d = DIGITS.format(x=v)
    body = f"('4' || array_to_string(list_transform(range(0, length({d}) - 2), lambda j: CAST({digit(stream('cc', d), 'j')} AS VARCHAR)), ''))"
    cell = f"CAST(substr(reverse({body}), q, 1) AS INTEGER)"
    total = f"list_sum(list_transform(range(1, length({body}) + 1), lambda q: CASE WHEN q % 2 = 1 THEN CASE WHEN 2 * {cell} > 9 THEN 2 * {cell} - 9 ELSE 2 * {cell} END ELSE {cell} END))"
    full = f"({body} || CAST((10 - {total} % 10) % 10 AS VARCHAR))"
    k = DIGITS.format(x=f"substr({v}, 1, i - 1)")
    one = f"CASE WHEN regexp_matches(substr({v}, i, 1), '^\\d$') THEN substr({full}, length({k}) + 1, 1) ELSE substr({v}, i, 1) END"
    return f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: {one}), '')"


def surrogate_ip(v: str) -> str:
    h = stream("ip", v)
    part = lambda a: f"CAST(CAST('0x' || substr({h}, {a}, 4) AS INTEGER) % 256 AS VARCHAR)"
    v6 = "'fd00:' || concat_ws(':', " + ", ".join(f"substr({h}, {a}, 4)" for a in range(1, 28, 4)) + ")"
    return f"CASE WHEN contains({v}, ':') THEN {v6} ELSE concat_ws('.', '10', {part(1)}, {part(5)}, {part(9)}) END"


def surrogate_shape(v: str) -> str:
    h = stream("shape", v)
    n = f"CAST('0x' || substr({h}, (i - 1) % 32 * 2 + 1, 2) AS INTEGER)"
    c, letter = f"substr({v}, i, 1)", f"substr('ABCDEFGHJKLMNPQRSTUVWXYZ', {n} % 24 + 1, 1)"
    one = f"CASE WHEN regexp_matches({c}, '^\\d$') THEN CAST({n} % 10 AS VARCHAR) WHEN regexp_matches({c}, '^\\p{{Lu}}$') THEN {letter} WHEN regexp_matches({c}, '^\\p{{L}}$') THEN lower({letter}) ELSE {c} END"
    return f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: {one}), '')"


def picked(pool: list[str], hex_: str, at: int = 1) -> str:
    return "[" + ", ".join(map(quoted, pool)) + f"][CAST('0x' || substr({hex_}, {at}, 12) AS BIGINT) % {len(pool)} + 1]"


def domain(root: str) -> str:
    """The invented host of a root that no company of the document has."""
    h = stream("domain", root)
    return f"(substr(regexp_replace(lower({picked(L.ORG_HEADS, h)} || {picked(L.ORG_TAILS, h, 13)}), '[^a-z0-9]', '', 'g'), 1, 14) || '.example.com')"


def root_of(host: str) -> str:
    return f"string_split(regexp_replace({host}, '\\.[^.]*$', ''), '.')[1]"


def surrogate_email(v: str) -> str:
    """Without a lexicon."""
    host = f"lower(string_split({v}, '@')[2])"
    free = ", ".join(quoted(x) for x in sorted(L.FREE_MAIL))
    roles = ", ".join(quoted(x) for x in sorted(L.ROLE_MAILBOXES))
    low = "lower(p)"
    number = f"CAST(1 + CAST('0x' || substr({stream('num', 'r')}, 1, 12) AS BIGINT) % 99 AS VARCHAR)"
    runs = f"array_to_string(list_transform(regexp_extract_all({low}, '\\d+|\\D+'), lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN {number} ELSE r END), '')"
    name = f"lower({picked(L.FIRST_NAMES, stream('first', low))})"
    role = f"{low} IN ({roles}) OR NOT regexp_matches({low}, '^\\p{{L}}+$') OR length({low}) <= 2"
    part = f"CASE WHEN regexp_matches(p, '^[._\\-]$') THEN p WHEN {role} THEN {runs} ELSE {name} END"
    local = f"array_to_string(list_transform(regexp_extract_all(string_split({v}, '@')[1], '[._\\-]|[^._\\-]+'), lambda p: {part}), '')"
    return f"{local} || '@' || CASE WHEN {host} IN ({free}) THEN 'example.com' ELSE {domain(root_of(host))} END"


def surrogate_url(v: str) -> str:
    """Without a lexicon the path stays."""
    p = "'(?is)^(https?://)?(www\\.)?([^/]+)(/.*)?$'"
    group = lambda k: f"regexp_extract({v}, {p}, {k})"
    return f"{group(1)} || {group(2)} || {domain(root_of(f'lower({group(3)})'))} || {group(4)}"
