"""Word packages, artefacts, pictures, streams, and the command line."""

import io
import json
import time
import zipfile

from pyspark.sql import functions as F

from quillmask import cli
from quillmask.operators import images
from quillmask.policy import Policy
from quillmask.sources import docx, files
from quillmask.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def p(*runs):
    return "<w:p>" + "".join(r if r.startswith("<") else f"<w:r><w:rPr><w:b/></w:rPr><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def package(body, picture=None):
    """A small Word package."""
    drawing = '<w:p><w:r><w:drawing><a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" r:embed="rId2"/></w:drawing></w:r></w:p>' if picture else ""
    document = (
        f'<?xml version="1.0"?><w:document {W} xmlns:r="{REL}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" '
        f'xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"><w:body>{body}{drawing}'
        '<w:sectPr><w:headerReference w:type="default" r:id="rId3"/></w:sectPr></w:body></w:document>'
    )
    rels = (
        '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        f'<Relationship Id="rId1" Type="{REL}/hyperlink" Target="mailto:arjun.testwalla@zenvale.com" TargetMode="External"/>'
        f'<Relationship Id="rId2" Type="{REL}/image" Target="media/image1.png"/><Relationship Id="rId3" Type="{REL}/header" Target="header1.xml"/></Relationships>'
    )
    core = (
        '<?xml version="1.0"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" '
        'xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Secret plan</dc:title><dc:creator>Arjun</dc:creator></cp:coreProperties>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", document)
        z.writestr("word/_rels/document.xml.rels", rels)
        z.writestr("word/header1.xml", f'<?xml version="1.0"?><w:hdr {W}>{p("Page of Zenvale")}</w:hdr>')
        z.writestr("docProps/core.xml", core)
        if picture:
            z.writestr("word/media/image1.png", picture)
    return out.getvalue()


BODY = (
    p("Mr. Arj", "un Testwalla", " is our treasurer.")
    + p("Zenvale Components Private Limited (“Zenvale”) supplied parts.")
    + p("Mail ", "arjun.test", "walla@zenvale.com", "<w:r><w:tab/></w:r>", "now")
    + '<w:p><w:r><w:instrText>HYPERLINK "mailto:arjun.testwalla@zenvale.com"</w:instrText></w:r></w:p>'
    + table(["Name", "Holding"], ["Rupa K. Sample", "39,062"])
    + p("Payment by TESTWALLA and Sample.")
    + "<w:p/>"
)


def rows(spark, *contents):
    return spark.createDataFrame([(f"d{k}.docx", bytearray(c)) for k, c in enumerate(contents)], "doc_id string, content binary")


def test_reading(spark):
    df = rows(spark, package(BODY, images.placeholder(40, 40)))
    got = docx.blocks(df).orderBy("block_id").collect()
    assert [b.text for b in got[:3]] == ["Mr. Arjun Testwalla is our treasurer.", "Zenvale Components Private Limited (“Zenvale”) supplied parts.", "Mail arjun.testwalla@zenvale.com\tnow"]
    assert got[-1].part == "header" and got[3].section == "Name | Holding" and [x.editable for x in got[2].pieces] == [True, True, True, False, True]
    assert docx.table_rows(df).first().cells == ["Rupa K. Sample", "39,062"]
    assert docx.links(df).first().target.startswith("mailto:") and "HYPERLINK" in docx.fields(df).first().text
    picture = docx.images(df).first()
    assert picture.name == "/word/media/image1.png" and docx.media(df).count() == 1


def test_broken_packages_are_listed(spark):
    df = rows(spark, b"PK not a package", package(BODY), b"no")
    assert docx.valid(df).count() == 2
    assert [r.doc_id for r in docx.unreadable(docx.valid(df)).collect()] == ["d0.docx"]


def test_write_back_keeps_the_runs():
    x = docx.Package(package(BODY))
    x.edit(0, [(4, 19, "Emeric Vantage")])
    assert [t for _, t in x.paragraphs[0][3]] == ["Mr. Emeric Vantage", "", " is our treasurer."]
    x.edit(2, [(5, 32, "a@b.example.com")])
    again = docx.Package(x.save())
    assert again.blocks()[2][3] == "Mail a@b.example.com\tnow" and again.blocks()[2][4][3] == {"text": "\t", "editable": False}
    assert b'xmlns:w14="' in zipfile.ZipFile(io.BytesIO(x.save())).read("word/document.xml")


def test_command_line(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.docx").write_bytes(package(BODY, images.placeholder(420, 260)))
    args = cli.parser().parse_args(["--input", str(source), "-o", str(tmp_path / "out"), "--mapping", str(tmp_path / "m"), "--detections", str(tmp_path / "c")])
    report = cli.run(spark, args)
    assert report["documents"] == 1 and report["changed"] >= 5
    out = docx.Package((tmp_path / "out" / "a.docx").read_bytes())
    everything = " ".join([b[3] for b in out.blocks()] + [t for _, t in out.links()] + [t for _, t in out.fields()])
    for secret in ("Testwalla", "TESTWALLA", "Zenvale", "zenvale", "Rupa", "Sample"):
        assert secret not in everything
    core = zipfile.ZipFile(tmp_path / "out" / "a.docx").read("docProps/core.xml").decode()
    assert "Arjun" not in core and "Redacted document" in core
    mapping = json.loads(spark.read.json(str(tmp_path / "m")).first().json)
    assert "PERSON" in mapping and list(mapping) == sorted(mapping)
    audit = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert audit.columns[1:] == files.CSV_COLUMNS and audit.where("part = 'media'").first().replacement == "replaced"


def test_large_packages_are_redacted_or_refused_with_a_reason(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    big = io.BytesIO(package(BODY))
    with zipfile.ZipFile(big, "a") as z:
        z.writestr("word/embeddings/big.bin", bytes(docx.MAX_BYTES + 1))
    (source / "big.docx").write_bytes(big.getvalue())
    (source / "small.docx").write_bytes(package(BODY))
    (source / "no.docx").write_bytes(b"no")
    args = cli.parser().parse_args(["--input", str(source), "-o", str(tmp_path / "out"), "--no-ocr"])
    report = cli.run(spark, args)
    assert report["documents"] == 2 and report["refused"] == ["no.docx"]
    assert "Testwalla" not in " ".join(b[3] for b in docx.Package((tmp_path / "out" / "big.docx").read_bytes()).blocks())
    stream = jobs.refusals(spark, str(source)).writeStream.format("memory").queryName("refusals").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    reasons = {r.doc_id: r.reason for r in spark.table("refusals").collect()}
    assert reasons == {"big.docx": f"larger than {docx.MAX_BYTES} bytes", "no.docx": "not a Word package"}


def test_tags_and_flags(tmp_path):
    terms = tmp_path / "t.json"
    terms.write_text(json.dumps({"Acme": "ORG"}))
    a = cli.parser().parse_args(["--input", "x", "-o", "y", "--mode", "tag", "--types", "person,org", "--extra-terms", str(terms), "--keep-locations", "--no-ocr"])
    policy = cli.policy_of(a)
    assert policy.labels == ("PERSON", "ORG") and policy.extra_terms == {"Acme": "ORG"} and policy.disable_images and not policy.wants("LOCATION")


def test_pictures_are_analysed_once_and_never_fail(spark):
    calls = spark.sparkContext.accumulator(0)

    def analyser(content):
        calls.add(1)
        if content == b"bad":
            raise ValueError
        return images.header_only(content)

    good = images.placeholder(50, 60)
    df = spark.createDataFrame([("d", f"i{k}", bytearray(c), "") for k, c in enumerate((good, good, b"bad", b""))], docx.IMAGES)
    got = {r.name: r.evidence for r in images.analyse(df, analyser).collect()}
    assert (got["i0"].width, got["i0"].height, got["i0"].format) == (50, 60, "PNG") and not got["i2"].readable
    assert calls.value <= 3
    labels = {r.name: (r.label, r.action) for r in images.decide(images.analyse(df)).collect()}
    assert labels["i0"] == ("IMAGE_UNCLASSIFIED", "replaced") and labels["i2"] == ("IMAGE_UNCLASSIFIED", "removed")
    kept = {r.action for r in images.decide(images.analyse(df), Policy(keep_images=True)).collect()}
    assert kept == {"kept"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"block_id": 1, "section": "a", "text": "x"}\n\n{"block_id": 2, "section": "b", "text": "y"}\n')
    assert files.jsonl(spark, str(tmp_path / "s.jsonl"), files.SAMPLE).count() == 2
    (tmp_path / "t.json").write_text(json.dumps({"_comment": ["x"], "CRITICAL": {"a": ["x", "y"]}, "HIGH": {"b": ["z"]}}))
    assert files.reidentification_terms(spark, str(tmp_path / "t.json")).count() == 3
    assert list(files.existing(spark, {"a": str(tmp_path / "s.jsonl"), "b": str(tmp_path / "none")})) == ["a"]


def test_redaction_stream(spark, tmp_path):
    from quillmask.plans.engine import Engine

    schema = "doc_id string, block_id int, part string, section string, text string"
    batch = spark.createDataFrame([("d", 0, "body", "", "Mail ana@acme.example.org"), ("d", 1, "body", "", "plain")], schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = jobs.redact_stream(stream, Engine(Policy(mode="tag")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out" / "redacted"))
    assert {r.text for r in out.collect()} == {"Mail [EMAIL_1]", "plain"}


def test_job_states(spark, tmp_path):
    schema = "job_id string, stage string, fraction double, ts timestamp"

    def put(name, *events):
        spark.createDataFrame([(j, s, f) for j, s, f, _ in events], "job_id string, stage string, fraction double").withColumn(
            "ts", F.timestamp_seconds(F.lit(events[0][3]))
        ).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        time.sleep(1.1)  # files are taken in the order of their times

    put("a", ("j", "read", 0.1, 1_700_000_000), ("k", "learn", 0.2, 1_700_000_000))
    put("b", ("j", "detect", 0.5, 1_700_000_100))
    put("c", ("m", "read", 0.0, 1_700_009_000))
    put("d", ("m", "learn", 0.0, 1_700_009_010))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = jobs.job_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {(r.job_id, r.stage, r.status) for r in spark.table("states").collect()}
    assert ("j", "detect", "running") in got and ("j", "detect", "expired") in got and ("k", "learn", "expired") in got
    assert ("m", "learn", "running") in got and not any(x[0] == "m" and x[2] == "expired" for x in got)
