"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Archives are written through Spark's own text writer, so they land on any file system that Spark can reach and
tasks can be repeated. That writer ends each value with a separator; here the separator is a zero byte, which is
also the last byte of a gzip member (the top byte of the length in its trailer), so the value is the member
without it. A record of 16 MB or more has another top byte; its member is written whole and followed by the zero
byte as padding, which gzip readers skip.

The reader decompresses in small steps, frames records by their content length, and checks the digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fields, shared_dir

CHUNK = 1 << 16
READ = fields("record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, block_ok boolean, payload_ok boolean, payload binary")
_CRLF = b"\r\n"
_DATE = "2024-01-01T00:00:00Z"  # archives of the same pages are the same bytes


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str | None) -> str:
    """A header value: control characters and line ends as percent codes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit (which has the headers of the response but not its payload)."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + 2 * _CRLF + block + 2 * _CRLF


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, url, html, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
            data = member(make_record(page.as_py(), url.as_py(), html.as_py() or b"", refers.as_py()))
            out.append(data[:-1] if data[-1] == 0 else data)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def _inflate(data: memoryview) -> Iterator[Iterator[bytes]]:
    """For each member, its bytes in pieces; each must be read to its end before the next."""
    at = 0
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        z = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal at
            while not z.eof and at < len(data):
                step = data[at : at + CHUNK]
                part = z.decompress(step)
                at += len(step) - len(z.unused_data)
                yield part
            if not z.eof:
                raise ValueError("the archive ends within a member")

        yield pieces()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    for pieces in _inflate(memoryview(data)):
        held = bytearray()
        while (end := held.find(b"\r\n\r\n")) < 0:
            part = next(pieces, None)
            if part is None:
                raise ValueError("a record without headers")
            held += part
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(head["content-length"])
        for part in pieces:
            held += part
        block = bytes(held[end + 4 : end + 4 + length])
        if len(block) < length or bytes(held[end + 4 + length :]) != b"\r\n\r\n":
            raise ValueError("the content length doesn't meet the record's end")
        yield head, block


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _parse(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(READ)
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for head, block in read_records(archive.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = head["warc-type"] == "revisit"
                    named = head["warc-payload-digest"].removeprefix("sha1:")
                    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                    rows.append((
                        head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), _page(head["warc-record-id"]), _page(head.get("warc-refers-to")),
                        int(length[1]) if revisit else len(payload), named,
                        digest32(block) == head["warc-block-digest"].removeprefix("sha1:"), revisit or digest32(payload) == named,
                        payload if with_payload and not revisit else None,
                    ))
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives in a folder. A record that fails its framing raises; digests that fail are marked.

    Archives that repeat give their records again; an empty folder has no records; a record without a numbered page has a null page_id.
    An archive is read as one value, so none may have 2 GB or more.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(_parse(with_payload), READ)


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, and refers_to: of equal payloads the largest page_id, for all rows but those that have it.

    Only payloads that occur more than once are looked up. Those with more than a thousandth of the rows (a thousand
    at most) are broadcast, the others joined, so that a hot payload doesn't meet in one task.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("payload"), F.sha2(html, 256).alias("same"))
    groups = durable(rows.groupBy("same").agg(F.max("page_id").alias("original"), F.count("*").alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    groups = groups.filter("n > 1").withColumn("hot", F.col("n") > F.lit(max(1, total // 1000)))
    hot = groups.filter("hot").select("same", F.col("original").alias("hot_original"))
    rows = rows.join(F.broadcast(hot), "same", "left").join(groups.filter("NOT hot").select("same", "original"), "same", "left")
    original = F.coalesce("hot_original", "original")
    return rows.select("page_id", "url", "payload", F.when(original != F.coalesce("page_id", F.lit(-1 << 63)), original).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 16 << 20) -> None:
    """Archives of about archive_bytes of payload each; path must not exist yet."""
    rows = with_originals(pages)
    size = pages.select(F.sum(F.octet_length("html")).alias("s")).first()["s"] or 0
    rows = rows.repartition(int(max(1, size // archive_bytes + 1)), F.xxhash64("page_id", "url"))
    members = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(_members, fields("member binary"))
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Per page, as read back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    A null html is an empty payload, a null url an empty target. A null page_id stays null and refers to the group's
    largest page_id; if a group has none, all its rows are responses. Rows that repeat the largest page_id are
    responses too. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    back = read_archives(spark, path, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("block_ok") & F.col("payload_ok")).alias("verified"))
