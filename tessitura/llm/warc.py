"""WARC archives: one transaction of request, response (or revisit) and metadata records per page.

Writing is Spark's text writer with the record separator CRLF CRLF as line separator, so archives go to any store under
the commit protocol, gzip-compressed, and a lost executor only repeats its task. Of captures with equal payloads of at
least ``min_bytes`` the one with the largest page id is stored as a response, the others as revisits (ties of page id:
the later row). Reading takes whole archive files, inflates them in pieces, walks records by Content-Length (a payload
may hold any text, blank lines and WARC headers too) and checks every payload digest. ``assemble`` then joins request
and metadata records to their capture through WARC-Concurrent-To and gives one nested row per capture; a revisit takes
the payload's length from the response it refers to.

Scale: pages are written once with their row numbers and payload keys, so that a repeated task finds the same numbers, and
aren't shuffled while the table of repeated payloads is small enough to broadcast after a count; else they are joined by
payload key, with frequent payloads by broadcast (``skew_join``), as are revisits with the response they refer to. Files
are bounded in records and bytes.

Defined cases: null html is an empty payload; null or blank urls leave the target header out; line breaks in a url are
escaped; a null page id is kept as null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, row_key, scratch_path, settle, skew_join, tidy

CRLF = "\r\n"
#: A file holds three records for each of so many pages at most, and so many bytes before compression, unless a single page has more.
PAGES_PER_FILE, FILE_BYTES = 2000, 256 << 20
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 40 bits are 10 hex or 8 base32 digits."""
    part = lambda i: F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), *_BASE32)


def _record_id(kind: str, page: Column, row: Column) -> Column:
    h = F.sha2(F.concat_ws(":", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), row.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column | None]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")] + [F.concat(F.lit(k + ": "), v) for k, v in headers if v is not None]  # concat_ws leaves nulls out
    return F.concat(F.concat_ws(CRLF, *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    key = F.when(F.octet_length("body") >= min_bytes, F.sha2("body", 256))
    # numbered as they are written, so every later job reads the same numbers
    rows = settle(row_key(rows, "_row").withColumns({"_key": key, "_size": F.octet_length("body") + 2 * F.coalesce(F.octet_length("url"), F.lit(0))}), "pages")
    groups = (rows.filter("_key is not null").groupBy("_key").agg(F.max(F.struct("page_id", "_row")).alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    groups = settle(groups, "repeats")
    largest = rows.agg(F.max("_size")).first()[0] or 0
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = (rows.join(F.broadcast(groups), "_key", "left") if few else skew_join(rows, groups, "_key")).drop("_size")
    revisit = F.col("_last").isNotNull() & (F.col("_last._row") != F.col("_row"))
    me = _record_id("capture", F.col("page_id"), F.col("_row"))
    target = F.when(F.trim("url") != "", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"))
    when = F.lit(date)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("body").cast("string"), F.lit(CRLF * 2))
    ask = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request", F.col("page_id"), F.col("_row"))), ("WARC-Date", when), ("WARC-Target-URI", target),
                   ("WARC-Concurrent-To", me), ("Content-Type", F.lit("application/http; msgtype=request"))],
                  F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    common = [("WARC-Record-ID", me), ("WARC-Date", when), ("WARC-Target-URI", target), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("body")))),
              ("Content-Type", F.lit("application/http; msgtype=response"))]
    answer = F.when(revisit, _record([("WARC-Type", F.lit("revisit")), *common, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                      ("WARC-Refers-To", _record_id("capture", F.col("_last.page_id"), F.col("_last._row")))], head)
                    ).otherwise(_record([("WARC-Type", F.lit("response")), *common], F.concat(head, "body")))
    note = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", F.col("page_id"), F.col("_row"))), ("WARC-Date", when),
                    ("WARC-Concurrent-To", me), ("Content-Type", F.lit("application/warc-fields"))],
                   F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(CRLF)))
    (rows.select(F.explode(F.array(ask, answer, note)).alias("value")).write.option("lineSep", CRLF * 2)
     .option("compression", "gzip").option("maxRecordsPerFile", 3 * max(1, min(PAGES_PER_FILE, FILE_BYTES // (largest + 2000)))).text(path))


_SCHEMA = "record_id string, kind string, concurrent_to string, refers_to string, target string, page_id long, payload_bytes long, payload_digest string, payload binary"


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive file, gzip (one or many members) or plain."""
    if data[:2] != b"\x1f\x8b":
        pieces: Iterator[bytes] = iter([data])
    else:
        def inflate() -> Iterator[bytes]:
            rest = data
            while rest:
                d = zlib.decompressobj(31)
                while rest and not d.eof:
                    yield d.decompress(rest, 1 << 20)
                    rest = d.unconsumed_tail
                if not d.eof:
                    yield d.flush()
                rest = d.unused_data
        pieces = inflate()
    buf, at = bytearray(), 0

    def need(enough) -> bool:
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            buf.extend(piece)
        return True

    while True:
        if at > 1 << 22:
            del buf[:at]
            at = 0
        if not need(lambda: buf.find(b"\r\n\r\n", at) >= 0):
            if bytes(buf[at:]).strip():
                raise ValueError("an archive ends inside a record header")
            return
        end = buf.index(b"\r\n\r\n", at)
        lines = bytes(buf[at:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one should start: {lines[0][:60]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n, at = int(head["content-length"]), end + 4
        if not need(lambda: len(buf) >= at + n + 4):
            raise ValueError("an archive ends inside a record")
        yield head, bytes(buf[at : at + n])
        at += n + 4


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, page, size, digest, payload = head["warc-type"], None, None, None, None
    if kind in ("response", "revisit"):
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest and digest != own:
                raise ValueError(f"payload of {head.get('warc-record-id')} doesn't fit its digest")
            digest = own
    elif kind == "metadata":
        fields = dict(x.partition(": ")[::2] for x in block.decode("utf-8").split("\r\n") if x)
        page = int(p) if (p := fields.get("pageId", "null")) != "null" else None
    return (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), page, size, digest, payload if with_payload else None)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives at path; rows leave in batches of at most 4 MB of payload."""
    types = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
        for batch in batches:
            for data in batch["content"]:
                for head, block in _records(data.as_buffer().to_pybytes()):
                    rows.append(_row(head, block, with_payload))
                    held += 300 + len(rows[-1][-1] or b"")
                    if held > 1 << 22:
                        yield pack()
                        rows, held = [], 0
        if rows:
            yield pack()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(parse), _SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, request, metadata; hub is the response's or revisit's id."""
    hub = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    pick = lambda kinds, *cols: F.max(F.when(F.col("kind").isin(*kinds), F.struct("record_id", *cols)))
    out = records.groupBy(hub.alias("record_id_")).agg(
        pick(("response", "revisit"), "kind", "target", "refers_to", "payload_bytes", "payload_digest", "payload").alias("response"),
        pick(("request",), "target").alias("request"), pick(("metadata",), "page_id").alias("metadata"))
    return out.filter("response is not null").withColumnRenamed("record_id_", "record_id")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    met = settle(assemble(read_records(spark, path, with_payload=False)), "captures")
    own = met.select("record_id", F.col("metadata.page_id").alias("page_id"), "response.kind", F.col("response.refers_to").alias("ref"),
                     F.col("response.payload_bytes").alias("n"), F.col("response.payload_digest").alias("payload_digest"))
    told = own.filter("kind = 'response'").select(F.col("record_id").alias("ref"), F.col("page_id").alias("refers_to"), F.col("n").alias("ref_n"))
    return skew_join(own, told, "ref").select("page_id", F.coalesce("n", "ref_n").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to")
