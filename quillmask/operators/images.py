"""Pictures: evidence, what they are, and what happens to them.

Analysis (text recognition, codes, faces, ink) is a plug-in that runs once for each distinct
picture; deciding is a CASE over evidence columns, and its order is the contract."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.lexicons import MIN_IMAGE_SIDE, SIGNATURE_CUES, SIGNATURE_INK
from ..policy import IDENTITY_LABELS, Policy
from . import detectors, match

EVIDENCE = (
    "format string, width int, height int, ocr_text string, codes array<string>, faces int, "
    "ink_ratio double, saturation double, stroke_fraction double, readable boolean, engines boolean, ink_measured boolean"
)


def picture_size(content: bytes) -> tuple[str, int, int] | None:
    """Format, width and height from the header of a PNG, GIF, BMP or JPEG."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return ("PNG", *struct.unpack(">II", content[16:24]))
    if content[:4] == b"GIF8" and len(content) >= 10:
        return ("GIF", *struct.unpack("<HH", content[6:10]))
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return "BMP", w, abs(h)
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 < len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", content[at + 5 : at + 9])
            return "JPEG", w, h
        at += 2 + size
    return None


def header_only(content: bytes) -> dict:
    """The evidence that needs no engine: size and format."""
    size = picture_size(content)
    fmt, w, h = size or ("", 0, 0)
    return dict(
        format=fmt, width=w, height=h, ocr_text="", codes=[], faces=0, ink_ratio=0.0, saturation=0.0, stroke_fraction=0.0,
        readable=size is not None, engines=False, ink_measured=False,
    )


def analyse(images: DataFrame, analyser: Callable[[bytes], dict] = header_only) -> DataFrame:
    """images (doc_id, name, content, context) with `evidence`; equal pictures are analysed once,
    and one that can't be analysed is unreadable, not an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, content in zip(pdf["sha"], pdf["content"]):
                try:
                    found = analyser(content or b"")
                except Exception:
                    found = header_only(b"")
                rows.append({"sha": sha, **found})
            yield pd.DataFrame(rows, columns=["sha", *[c.split()[0] for c in EVIDENCE.split(", ")]])

    keyed = images.withColumn("sha", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    once = keyed.select("sha", "content").dropDuplicates(["sha"]).mapInPandas(run, "sha string, " + EVIDENCE)
    names = [c.split()[0] for c in EVIDENCE.split(", ")]
    return keyed.join(once.select("sha", F.struct(*names).alias("evidence")), "sha").drop("sha")


def labels_in(text: Column, policy: Policy, spans_of: Callable[[Column], Column] | None = None) -> Column:
    """The labels found in a text, and companies found in its title-cased copy."""
    spans_of = spans_of or (lambda t: detectors.detect(t, None, policy))
    as_read = F.transform(spans_of(text), lambda s: s.label)
    recased = F.filter(F.transform(spans_of(F.initcap(text)), lambda s: s.label), lambda x: x == "ORG")
    return F.array_distinct(F.concat(as_read, recased))


def classify(inside: Column, around: Column, policy: Policy) -> Column:
    """struct<label, reason> from the columns `evidence` and `context`; inside and around are the
    labels found in the picture and in the text next to it. An empty label keeps the picture."""
    e = F.col("evidence")
    text = F.coalesce(e.ocr_text, F.lit(""))
    context = F.lower(F.coalesce("context", F.lit("")))
    smaller, larger = F.least(e.width, e.height), F.greatest(e.width, e.height)
    lines = F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.btrim(x) != ""))
    found = F.array_intersect(inside, F.array(*map(F.lit, sorted(IDENTITY_LABELS))))
    lone = (F.size(found) == 1) & F.array_contains(found, "PERSON") & ~((lines >= 4) & (F.length(text) >= 30))
    cue = F.filter(F.array(*map(F.lit, SIGNATURE_CUES)), lambda c: context.contains(c))
    ink = SIGNATURE_INK
    drawn = (
        (F.btrim(text) == "")
        & e.ink_ratio.between(ink["min_ink"], ink["max_ink"])
        & (e.saturation <= ink["max_saturation"])
        & (e.stroke_fraction > 0)
        & (e.stroke_fraction <= ink["max_stroke"])
        & F.coalesce(e.width / F.nullif(e.height, F.lit(0)) >= ink["min_aspect"], F.lit(False))
    )
    contact = F.array_intersect(inside, F.array(*map(F.lit, ("EMAIL", "ORG", "PHONE", "URL"))))
    mark = (larger <= 600) & (e.saturation >= 25.0) & (e.ink_ratio >= 0.02)
    listed = lambda x: F.concat(F.lit("contains "), F.array_join(F.array_sort(x), ", "), F.lit(" in image text"))
    rules = (
        (F.lit(policy.redact_all_images), "IMAGE_UNCLASSIFIED", F.lit("--redact-all-images")),
        ((smaller > 0) & (smaller < MIN_IMAGE_SIDE), "", F.lit("icon or rule, too small to carry PII")),
        (~e.readable, "IMAGE_UNCLASSIFIED", F.lit("image could not be decoded for inspection")),
        (~e.engines, "IMAGE_UNCLASSIFIED", F.lit("no analysis engine available; redacted unexamined")),
        (e.faces > 0, "IMAGE_ID_DOCUMENT", F.format_string("contains %d detected face(s)", e.faces)),
        ((F.size(found) > 0) & ~lone, "IMAGE_ID_DOCUMENT", listed(found)),
        (F.size(e.codes) > 0, "IMAGE_CODE", F.lit("encodes a scannable payload")),
        (F.size(cue) > 0, "IMAGE_SIGNATURE", F.concat(F.lit("captioned '"), F.get(cue, F.lit(0)), F.lit("'"))),
        (drawn, "IMAGE_SIGNATURE", F.lit("ink morphology consistent with handwriting")),
        (F.size(contact) > 0, "IMAGE_LOGO", listed(contact)),
        (F.array_contains(around, "ORG"), "IMAGE_LOGO", F.lit("anchored to a company name in surrounding text")),
        (mark, "IMAGE_LOGO", F.lit("small, saturated wordmark")),
        ((e.ink_ratio < 0.002) & e.ink_measured, "", F.lit("blank or near-blank")),
        (F.lit(policy.keep_unclassified_images), "", F.lit("no evidence found (--keep-unclassified-images)")),
    )
    out = None
    for when, label, reason in rules:
        value = F.struct(F.lit(label).alias("label"), reason.alias("reason"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit("IMAGE_UNCLASSIFIED").alias("label"), F.lit("no evidence either way; redacted by default").alias("reason")))


def action(decision: Column, policy: Policy, writable: Column) -> Column:
    """struct<label, reason, action>: kept, replaced or removed."""
    label, reason = decision.label, decision.reason
    wanted = label.isin(*[x for x in policy.labels if x.startswith("IMAGE_")])
    done = F.when(writable, F.lit("replaced")).otherwise(F.lit("removed"))
    keep = lambda note: F.struct(label.alias("label"), F.concat(reason, F.lit(note)).alias("reason"), F.lit("kept").alias("action"))
    return (
        F.when(label == "", keep(""))
        .when(~wanted, keep(" (type not selected)"))
        .when(F.lit(policy.keep_images), keep(" (--keep-images)"))
        .otherwise(F.struct(label.alias("label"), reason.alias("reason"), done.alias("action")))
    )


def summary(e: Column) -> Column:
    """Shape and counts of a picture for the audit; never the text found in it."""
    text = F.coalesce(e.ocr_text, F.lit(""))
    lines = F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.btrim(x) != ""))
    return F.concat_ws(
        "; ",
        F.when(e.faces > 0, F.format_string("%d face(s)", e.faces)),
        F.when(text != "", F.format_string("%d text line(s), %d chars", lines, F.length(text))),
        F.when(F.size(e.codes) > 0, F.format_string("%d decoded code(s)", F.size(e.codes))),
        F.when(~e.readable, F.lit("undecodable")),
        F.concat(e.width.cast("string"), F.lit("x"), e.height.cast("string"), F.lit(" "), F.when(e.format == "", F.lit("?")).otherwise(e.format)),
        F.format_string("ink=%.3f", e.ink_ratio),
    )


def decide(images: DataFrame, policy: Policy | None = None, spans_of: Callable[[Column], Column] | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """images with evidence -> (doc_id, name, label, reason, action, summary). With a lexicon, a
    document's own people and companies count as evidence, too."""
    policy = policy or Policy()
    if lexicon is not None:
        known = match.per_document(lexicon)
        images = images.join(known, images.doc_id == known.lex_doc, "left")
        spans_of = spans_of or (lambda t: F.concat(detectors.detect(t, None, policy), match.matches(t, policy=policy)))
    text = F.concat_ws("\n", F.col("evidence.ocr_text"), F.array_join("evidence.codes", "\n"))
    marked = images.withColumn("inside", labels_in(text, policy, spans_of)).withColumn("around", labels_in(F.coalesce("context", F.lit("")), policy, spans_of))
    writable = F.col("evidence.format").isin("PNG", "BMP")
    ruled = marked.withColumn("ruled", classify(F.col("inside"), F.col("around"), policy))
    out = ruled.withColumn("done", action(F.col("ruled"), policy, writable))
    return out.select("doc_id", "name", "done.label", "done.reason", "done.action", summary(F.col("evidence")).alias("summary"))


def _canvas(width: int, height: int, label: str, seed: str) -> list[bytearray]:
    """Grey pixels, by row: a frame, and inside it a stroke, a field of modules or a plain plate whose
    details are drawn from the hash of what the picture stands for."""
    draw = hashlib.sha256(f"{label}:{seed}".encode()).digest()
    rows = [bytearray([214 if label != "IMAGE_SIGNATURE" else 250]) * width for _ in range(height)]
    if label == "IMAGE_SIGNATURE":
        for x in range(width // 10, width - width // 10):
            y = height / 2 + sum(math.sin(x * (1 + draw[k] % 7) / max(8, width) * 6 + draw[k + 8]) for k in range(4)) * height / 12
            for dy in range(max(1, height // 60) + 1):
                if 0 <= int(y) + dy < height:
                    rows[int(y) + dy][x] = 40
    elif label == "IMAGE_CODE":
        side = max(1, min(width, height) // 25)
        for y in range(height):
            for x in range(width):
                rows[y][x] = 255 * (draw[(y // side * 31 + x // side) % 32] >> (x // side % 8) & 1)
    elif label == "IMAGE_LOGO":
        band = 90 + draw[0] % 120
        for y in range(height // 3, height - height // 3):
            rows[y][width // 10 : width - width // 10] = bytes([band]) * max(0, width - 2 * (width // 10))
    for y in range(height):
        rows[y][0] = rows[y][-1] = 96
    rows[0][:] = rows[-1][:] = bytes([96]) * width
    return rows


def placeholder(width: int, height: int, label: str = "IMAGE_UNCLASSIFIED", seed: str = "", form: str = "PNG") -> bytes | None:
    """What replaces a picture: one of the same size and format (PNG or BMP; None for others, which
    are removed). The same label and seed give the same picture."""
    rows = _canvas(max(1, width), max(1, height), label, seed)
    width, height = len(rows[0]), len(rows)
    if form == "BMP":
        body = b"".join(bytes(r) + b"\0" * (-width % 4) for r in reversed(rows))
        palette = b"".join(bytes([k, k, k, 0]) for k in range(256))
        at = 54 + len(palette)
        return b"BM" + struct.pack("<IHHIIiiHHIIiiII", at + len(body), 0, 0, at, 40, width, height, 1, 8, 0, len(body), 2835, 2835, 256, 0) + palette + body
    if form != "PNG":
        return None

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def replacement_name(inside: Column, around: Column, label: str) -> Column:
    """The original whose surrogate a logo (first company inside, then around) or signature
    (first person around) carries; from span arrays."""
    first = lambda spans, kind: F.get(F.filter(spans, lambda s: s.label == kind), F.lit(0)).text
    return F.coalesce(first(inside, "ORG"), first(around, "ORG")) if label == "IMAGE_LOGO" else first(around, "PERSON")
