"""Small synthetic Word packages and block tables, for trials and for scaling tests.

All names are invented. A package is built from a list of parts: ("p", text), ("h", heading),
("li", item), ("table", rows) and ("picture", bytes)."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.images import placeholder

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_CT = "http://schemas.openxmlformats.org/package/2006/content-types"


def _p(text: str, style: str = "") -> str:
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{props}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def _table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def package(parts: list[tuple], header: str = "", author: str = "Author", title: str = "") -> bytes:
    """A Word package."""
    body, rels, media = [], [], []
    for kind, value in parts:
        if kind == "table":
            body.append(_table(value))
        elif kind == "picture":
            k = len(media) + 1
            media.append((f"word/media/image{k}.png", value))
            rels.append(f'<Relationship Id="rId{k}" Type="{_R}/image" Target="media/image{k}.png"/>')
            body.append(f'<w:p><w:r><w:drawing><a:blip xmlns:a="{_A}" r:embed="rId{k}"/></w:drawing></w:r></w:p>')
        else:
            body.append(_p(value, {"h": "Heading1", "li": "ListBullet"}.get(kind, "")))
    reference = ""
    files = []
    if header:
        rels.append(f'<Relationship Id="rIdH" Type="{_R}/header" Target="header1.xml"/>')
        files.append(("word/header1.xml", f'<?xml version="1.0"?><w:hdr xmlns:w="{_W}">{_p(header)}</w:hdr>'))
        reference = '<w:headerReference w:type="default" r:id="rIdH"/>'
    document = f'<?xml version="1.0"?><w:document xmlns:w="{_W}" xmlns:r="{_R}"><w:body>{"".join(body)}<w:sectPr>{reference}</w:sectPr></w:body></w:document>'
    core = (
        '<?xml version="1.0"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" '
        f'xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator></cp:coreProperties>'
    )
    types = (
        f'<?xml version="1.0"?><Types xmlns="{_CT}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>'
        '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    )
    root = f'<?xml version="1.0"?><Relationships xmlns="{_REL}"><Relationship Id="rId1" Type="{_R}/officeDocument" Target="word/document.xml"/></Relationships>'
    files += [
        ("[Content_Types].xml", types), ("_rels/.rels", root), ("word/document.xml", document), ("docProps/core.xml", core),
        ("word/_rels/document.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_REL}">{"".join(rels)}</Relationships>'), *media,
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def samples() -> dict[str, bytes]:
    """Three documents: an offer letter, a claim form, a ticket log; with values that must be found
    and traps (order, policy and ticket numbers, plain dates, amounts) that must stay."""
    letter = [
        ("h", "Offer of employment"), ("p", "Mr. Arjun Testwalla is our treasurer. Contact person: Oona Quistgaard, tel. 415-555-0132"),
        ("p", "Zenvale Components Private Limited (“Zenvale”) supplied parts on March 4, 2021 under order 200003456."),
        ("table", [["Name", "Holding"], ["Rupa K. Sample", "39,062"]]), ("p", "For and on behalf of the Board"), ("picture", placeholder(420, 140)),
    ]
    claim = [
        ("h", "Claim form"), ("p", "Policy QRS-HLT-5581020 of Ms. Mirabel Oakhollow, date of birth: 14 March 1988."),
        ("table", [["Field", "Detail"], ["PAN", "ABCDE1234F"], ["Bank account number", "12345678901234"], ["Sum insured", "1,10,000"]]),
        ("p", "Office at 12 Larkspur Court, Eastmere, Norvale – 411 999, Maharashtra, India"), ("p", "Our Eastmere plant near Norvale 411 999 opened."),
    ]
    log = [
        ("h", "Ticket log"),
        ("table", [["Ticket", "Date", "Customer", "Contact"], ["TKT-100294", "04/03/2021", "Mr. Bo Luxemore", "bo.luxemore@mail.example.org"]]),
        ("li", "Card 4111 1111 1111 1111 was charged twice from 10.0.12.7."), ("li", "Mr. Bo Luxemore is our client; Luxemore called again."),
    ]
    return {"offer_letter.docx": package(letter, "Zenvale", "Oona Quistgaard", "Offer"), "claim_form.docx": package(claim), "ticket_log.docx": package(log)}


def block_table(spark: SparkSession, n_documents: int, copies: int = 1) -> DataFrame:
    """Blocks of n_documents synthetic documents, made on the executors: for scaling tests."""
    lines = [
        "Mr. Arjun Testwalla{k} is our treasurer.", "Payment by TESTWALLA{k}, card 4111 1111 1111 1111.", "Plain prose about nothing in particular, with words.",
        "Write to user{k}@mail{k}.example.org or +91 98765 43210.",
    ] * copies
    docs = spark.range(n_documents).select(F.col("id").cast("string").alias("doc_id"))
    rows = docs.select("doc_id", F.posexplode(F.array(*map(F.lit, lines))).alias("block_id", "text"))
    letters = F.translate(F.col("doc_id"), "0123456789", "abcdefghij")
    return rows.select("doc_id", "block_id", F.lit("body").alias("part"), F.lit("").alias("section"), F.replace("text", F.lit("{k}"), letters).alias("text"))
