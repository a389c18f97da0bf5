"""WARC archives in seekable Zstandard bundles.

Pages become WARC/1.1 records: a response with the page as payload, or, where an earlier
page has an equal payload, a revisit that names the response's record. The records of a
bundle are grouped into independent Zstandard frames, and a footer in a skippable frame
lists the frames' sizes (the public seekable format), so any Zstandard tool reads the
bundle and a reader fetches one frame for one record. A map from record to bundle, frame
and offset inside the frame is written next to it as Parquet.

Equal payloads are found by their SHA-256: digests with more than one record are counted
by an aggregation that combines before the shuffle, so a payload that a third of all
pages share costs one row a task. Bundles are written under fresh names and reported; only
reported bundles are read, so repeated tasks leave no trace.

Defined cases: a null page is empty; payloads under MIN_BYTES are never deduplicated; of
equal payloads the row with the least id is the response (of equal ids the first in the
scan; null ids come last); null URLs are left out of the record; an empty table gives no
bundles and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .storage import open_file, write_file

MIN_BYTES = 100
#: A frame is closed at so many bytes of records, a bundle at so many frames.
FRAME = 1 << 20
FRAMES = 256
LEVEL = 3
#: Records carry a fixed date, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NULL_ID = "none"


def _urn(page_id) -> str:
    return f"<urn:page:{NULL_ID if page_id is None else page_id}>"


def _of_urn(urn: str | None) -> int | None:
    body = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(body) if re.fullmatch(r"-?\d+", body) else None


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record. A revisit's block is the HTTP head alone, which states the length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *[f"{k}: {v}\r\n".encode() for k, v in fields], b"\r\n", block, b"\r\n\r\n"])


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at a place of a frame: fields, block, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    begin = end + 4
    stop = begin + int(fields["Content-Length"])
    return fields, data[begin:stop], stop + 4


class Bundle:
    """A seekable Zstandard file read by frames."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self._read(size - 9 - 8 * n, 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self._read(at, packed), max_output_size=max(1, plain))

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def _write(folder: str):
    """Rows (page_id, url, payload, digest, refers_to, revisit) -> a row for each record written:
    page_id, bundle, frame, frame_offset."""

    def run(batches):
        part, pack = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=LEVEL)
        frames: list[bytes] = []  # packed frames of the open bundle
        sizes: list[tuple[int, int]] = []
        places: list[tuple] = []  # page_id, frame, offset
        open_frame: list[bytes] = []
        size = 0

        def close_frame():
            nonlocal size
            plain = b"".join(open_frame)
            frames.append(pack.compress(plain))
            sizes.append((len(frames[-1]), len(plain)))
            open_frame.clear()
            size = 0

        def close_bundle():
            if open_frame:
                close_frame()
            table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
            uri, _ = write_file(folder, f"bundle-{part:06d}", [*frames, struct.pack("<II", SKIPPABLE, len(table)), table])
            ids, frame, offset = zip(*places)
            n = len(places)
            cols = [pa.array(ids, pa.int64()), pa.array([uri] * n), pa.array(frame, pa.int32()), pa.array(offset, pa.int64()), pa.array([len(sizes)] * n, pa.int32())]
            frames.clear(), sizes.clear(), places.clear()
            return pa.RecordBatch.from_arrays(cols, ["page_id", "bundle", "frame", "frame_offset", "n_frames"])

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, refers_to, revisit = (b.column(k)[i].as_py() for k in range(6))
                places.append((page_id, len(sizes), size))
                open_frame.append(record(page_id, url, payload or b"", digest, refers_to, revisit))
                size += len(open_frame[-1])
                if size >= FRAME:
                    close_frame()
                    if len(sizes) >= FRAMES:
                        yield close_bundle()
        if places:
            yield close_bundle()

    return run


def marked(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit) of all pages."""
    payload = F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8")
    rows = pages.select(
        F.monotonically_increasing_id().alias("rid"), pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), payload.alias("payload")
    )
    # numbers and payloads are read from one table: a second scan of pages may number its rows otherwise
    rows = C.settle(rows.select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size")), "warc-pages")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")
    long = rows.where(F.col("size") >= min_bytes).select("digest", "page_id", "rid")
    copied = C.settle(
        long.groupBy(F.col("digest").alias("d")).agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select("d", "first"), "warc-copied"
    )
    out = rows.join(C.checked_broadcast(copied), (F.col("digest") == F.col("d")) & (F.col("size") >= min_bytes), "left")
    revisit = F.coalesce(F.col("first.rid") != F.col("rid"), F.lit(False))
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first.page_id")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, **names) -> DataFrame:
    """Write all pages as bundles under folder. Returns the map of records, settled:
    page_id, bundle, frame, frame_offset, n_frames."""
    C.bounded_memory(pages.sparkSession)
    schema = "page_id long, bundle string, frame int, frame_offset long, n_frames int"
    return C.settle(marked(pages, **names).mapInArrow(_write(folder), schema), "warc-map")


def _read(batches):
    """Rows (bundle, frame) -> the records in them."""
    last: tuple[str, Bundle] | None = None
    for b in batches:
        for uri, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if last is None or last[0] != uri:
                last = (uri, Bundle(uri))
            data, at, rows = last[1].frame(k), 0, []
            while at < len(data):
                fields, block, at = parse(data, at)
                head, _, payload = block.partition(b"\r\n\r\n")
                stated = int(re.search(rb"(?i)^content-length: (\d+)", head, re.M)[1])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = fields["WARC-Type"]
                if kind == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{fields['WARC-Record-ID']} in {uri} is damaged")
                rows.append((_of_urn(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), stated, digest, kind, _of_urn(fields.get("WARC-Refers-To")), payload))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read(records: DataFrame) -> DataFrame:
    """The records of the bundles in a map of records: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (empty for revisits). Frames are dealt
    out one by one, so bundles of any size are read side by side."""
    bundles = records.groupBy("bundle").agg(F.max("n_frames").alias("n"))
    frames = bundles.select("bundle", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame"))
    dealt = frames.repartition(C.parallel_width(records.sparkSession), "bundle", "frame").sortWithinPartitions("bundle", "frame")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return dealt.mapInArrow(_read, schema)


def lookup(records: DataFrame, page_id: int) -> tuple[dict[str, str], bytes] | None:
    """The record of a page by the map: one frame is read."""
    at = records.where(F.col("page_id") == page_id).select("bundle", "frame", "frame_offset").first()
    return None if at is None else Bundle(at.bundle).record(at.frame, at.frame_offset)
