"""WARC archives: writing one gzip member per record, and a splittable reader.

Writing goes through Spark's own committed file output, so a lost executor or a repeated task leaves no
half archive. Spark has no sink for raw bytes, but its text sink writes a string's bytes unchanged and then
the line separator. A gzip member ends with the high byte of the content's size, which is 0 below 16 MB; the
member goes without that byte and the separator is the byte 0. A larger member is followed by an empty
member, which ends with 0 as well.

Reading: files are cut into byte ranges. A task looks for gzip magic in its range, takes a candidate as
valid when it decodes (CRC included) to something that begins with a WARC header, owns the records that
start inside its range, reads past its end to finish the last one, and goes on behind each valid member.

Defined results: null html is an empty payload; payloads under `min_revisit_bytes` are always responses; a
null page_id is always a response and comes back null; rows that repeat page_id and payload are responses
alike; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, open_shared

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(kind: str, page_id: int | None, url: str | None, digest: str, n: int, payload: bytes, date: str, refers: int | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


_URL_SAFE = "!#$&'()*+,/:;=?@[]~%"


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 100, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per row (page_id, url, html). Of equal payloads of at least min_revisit_bytes the smallest
    page_id is the response, the others revisit it. Only compressed members are shuffled, and adaptive
    execution splits the partition of a hot payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    firsts = rows.filter(F.col("n") >= min_revisit_bytes).groupBy(F.col("digest").alias("g_digest")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")

    def pack(batches):
        for b in batches:
            ids, urls, htmls, digests, ns = (b.column(i) for i in range(5))
            members = [_gzip(_record("response", i.as_py(), u.as_py(), d.as_py(), n.as_py(), h.as_py().encode(), date), level) for i, u, h, d, n in zip(ids, urls, htmls, digests, ns)]
            yield pa.RecordBatch.from_arrays([ids, urls, digests, ns, pa.array(members, pa.binary())], ["page_id", "url", "digest", "n", "member"])

    def finish(batches):
        for b in batches:
            out = []
            for i, u, d, n, m, first in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "digest", "n", "member", "first_id"))):
                if first is not None and i is not None and i != first:
                    m = _gzip(_record("revisit", i, u, d, n, b"", date, first), level)
                out.append((m if m[-1] == 0 else m + _gzip(b"", level))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    members = rows.mapInArrow(pack, "page_id long, url string, digest string, n long, member binary")
    joined = members.join(firsts.hint("merge"), F.col("digest") == F.col("g_digest"), "left").drop("g_digest")
    joined.mapInArrow(finish, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(path)


class _Window:
    """A file's bytes from some offset on, read in blocks and forgotten when passed."""

    def __init__(self, file, start: int, block: int = 1 << 20):
        self.file, self.base, self.data, self.block = file, start, b"", block
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(self.block)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.base = self.data[n:], self.base + n


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """(content, length of the member) if a gzip member whose content is a WARC record starts at `at`."""
    z, out, fed, seen = zlib.decompressobj(31), [], at, 0
    while not z.eof:
        if fed >= len(window.data) and not window.more():
            return None
        piece = window.data[fed : fed + (1 << 16)]
        try:
            got = z.decompress(piece)
        except zlib.error:
            return None
        fed += len(piece)
        out.append(got)
        seen += len(got)
        if seen >= 5 and not b"".join(out[:6])[:5] == b"WARC/":
            return None
    content = b"".join(out)
    return (content, fed - len(z.unused_data) - at) if content.startswith(b"WARC/") else None


def scan_range(file, start: int, end: int):
    """(offset, content) of each WARC record whose gzip member starts in [start, end)."""
    window = _Window(file, start)
    window.more()
    at = 0
    while True:
        at = window.data.find(b"\x1f\x8b\x08", at)
        if at < 0:
            keep = min(2, len(window.data))
            window.drop(len(window.data) - keep)
            if window.base >= end or not window.more():
                return
            at = 0
            continue
        if window.base + at >= end:
            return
        found = _member(window, at)
        if found is None:
            at += 1
            continue
        yield window.base + at, found[0]
        window.drop(at + found[1])
        at = 0


def parse_record(content: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to); a response's figures are
    taken from its payload, a revisit's from its headers."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"^([A-Za-z-]+): (.*)$", head.decode().replace("\r\n", "\n"), re.M))
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    if fields["WARC-Type"] == "revisit":
        n = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), n, fields["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", number("WARC-Refers-To")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), len(payload), hashlib.sha256(payload).hexdigest(), fields["WARC-Type"], None


def read_warc(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """A row (see RECORD) for each record of the archives under path; tasks read range_bytes each."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    n = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")).repartition(int(n))

    def read(batches):
        for b in batches:
            for uri, length, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                with open_shared(uri) as file:
                    rows = []
                    for offset, content in scan_range(file, start, min(start + range_bytes, length)):
                        rows.append((*parse_record(content), uri, offset))
                        if len(rows) == 1000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return ranges.mapInArrow(read, RECORD)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in RECORD.split(", ")])


def warc_roundtrip(pages: DataFrame, path: str | None = None, range_bytes: int = 8 << 20, **options) -> DataFrame:
    """Write the archive, read it back."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_warc(pages, path, **options)
    return read_warc(spark, path, range_bytes)
