"""WARC archives: segmented writing, and reassembly of what was read back.

The writer makes one response record per payload and a revisit for each repeat of a payload of
``REPEAT_BYTES`` or more. A response is an HTTP message in chunked transfer coding; messages
of more than ``SEGMENT_CHARS`` characters go on in continuation records. The reader frames
records by their Content-Length, groups segments by the origin's identifier, orders them by
number, verifies the total length and decodes the chunks.

Archives are written and read by Spark's own file formats, so they can lie in any store that
Spark reaches. Payloads are text, written as UTF-8.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_saved, saved, small

REPEAT_BYTES = 100
#: Characters of a message in one record, and of one chunk of the transfer coding.
SEGMENT_CHARS, CHUNK_CHARS = 65_536, 4_096
#: Records in one file; with the segment size it bounds what one task reads at once.
FILE_RECORDS = 500
_DATE = "2024-01-01T00:00:00Z"
_URN = "urn:textweir:page:"
#: Bytes unzipped at a time.
_STEP = 1 << 20


#: Columns of a record as read; ``body`` is a segment's bytes, or the payload if the message is whole.
_PARSED = ("record_id string, type string, uri string, digest string, refers_to string, http_length bigint, "
           "origin string, number int, total bigint, body binary")
_WHOLE = "record_id string, type string, uri string, digest string, refers_to string, http_length bigint, payload binary"


def _record(kind: str, ident: str, body: str, fields: list[tuple[str, str]]) -> str:
    size = len(body.encode("utf-8"))
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", _DATE), *fields, ("Content-Length", str(size))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + body


def _records(page: int | None, url: str, html: str, digest: str, refers: int | None, size: int, row: str = "0") -> Iterator[str]:
    ident = f"{_URN}{'' if page is None else page}:{row}"
    target = ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    stamp = ("WARC-Payload-Digest", f"sha256:{digest}")
    form = ("Content-Type", "application/http;msgtype=response")
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        yield _record("revisit", ident, f"{http}Content-Length: {size}\r\n\r\n", [
            target, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{_URN}{refers}>"), stamp, form])
        return
    chunks = [html[i:i + CHUNK_CHARS] for i in range(0, len(html), CHUNK_CHARS)]
    message = (http + "Transfer-Encoding: chunked\r\n\r\n"
               + "".join(f"{len(c.encode('utf-8')):x}\r\n{c}\r\n" for c in chunks) + "0\r\n\r\n")
    parts = [message[i:i + SEGMENT_CHARS] for i in range(0, len(message), SEGMENT_CHARS)]
    number = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
    yield _record("response", ident, parts[0], [target, stamp, form, *number])
    total = len(message.encode("utf-8"))
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(total))] if n == len(parts) else []
        yield _record("continuation", f"{ident}:{n}", part, [
            target, ("WARC-Segment-Origin-ID", f"<{ident}>"), ("WARC-Segment-Number", str(n)), *last])


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        out: list[str] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            out.extend(_records(*row, f"{part}.{n}"))
            n += 1
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write(pages: DataFrame, path: str) -> None:
    """Archive ``pages`` (page_id, url, html), one record per row, as gzip files below ``path``.

    Of equal payloads of ``REPEAT_BYTES`` or more those with the smallest page_id are responses, and the
    others revisit it. A row without a page_id is never the smallest, and without one that has an id a response.
    A record's identifier names its page_id (or none) and its row, so page_ids may repeat. Null html is
    an empty payload, a null url an empty one. An empty table writes no record.
    """
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("bigint").alias("size"))
    sized = saved(pages.filter(F.col("size") >= REPEAT_BYTES).select("page_id", "digest"), "digests")
    firsts = saved(sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                   .filter("n > 1 and first is not null").drop("n"), "firsts")
    revisits = saved(sized.join(firsts, "digest").filter("page_id is null or page_id != first")
                     .select(F.col("page_id").alias("again"), F.col("digest").alias("same"), F.col("first").alias("refers"))
                     .distinct(), "revisits")
    rows = (pages.join(small(revisits), F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left")
            .withColumn("html", F.when(F.col("refers").isNull(), F.col("html")))
            .select("page_id", "url", "html", "digest", "refers", "size"))
    # two line ends close a record
    (rows.mapInArrow(_archive, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))
    for table in (sized, firsts, revisits):
        drop_saved(table)


def _gunzip(content: bytes) -> bytes:
    """All members of a gzip file, or the content itself if it is none; of a broken one, what comes before the break."""
    out, view, at = [], memoryview(content), 0
    while view[at:at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while at < len(view) and not member.eof:
                piece = view[at:at + _STEP]
                out.append(member.decompress(piece))
                at += len(piece) - len(member.unused_data)
        except zlib.error:
            break
    return b"".join(out) if out else content


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields (names in lower case) and block of each record of an archive.

    The block is None where the header or the block is cut off, or the header gives no length; after
    such a header the next record is looked for.
    """
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        whole = end >= 0
        lines = data[at:end if whole else len(data)].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = _number(fields.get("content-length")) if whole else None
        if size is None:
            yield fields, None
            at = end + 4 if whole else len(data)
            continue
        block = data[end + 4:end + 4 + size]
        yield fields, block if len(block) == size else None
        at = end + 4 + size


def unchunk(message: bytes) -> tuple[dict[str, str], bytes | None]:
    """Fields and payload of an HTTP message; None for a payload whose chunks do not add up."""
    head, _, body = message.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in
              (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if fields.get("transfer-encoding", "").lower() != "chunked":
        return fields, body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or size and body[end + 2 + size:end + 4 + size] != b"\r\n":
            return fields, None
        if size == 0:
            return fields, b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def _name(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _reader(segmented: bool):
    """Records of whole messages, decoded, or the segments of the others."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in _parse(_gunzip(content.as_buffer().to_pybytes())):
                    if ("warc-segment-number" in fields) != segmented:
                        continue
                    ident, kind = _name(fields.get("warc-record-id")), fields.get("warc-type")
                    http, body = ({}, block) if segmented or block is None else unchunk(block)
                    rows.append((ident, kind, fields.get("warc-target-uri"), fields.get("warc-payload-digest"),
                                 _name(fields.get("warc-refers-to")), _number(http.get("content-length")),
                                 _name(fields.get("warc-segment-origin-id")) or ident,
                                 _number(fields.get("warc-segment-number")), _number(fields.get("warc-segment-total-length")),
                                 None if kind == "revisit" else body))
                columns = list(zip(*rows)) or [()] * 10
                kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=[c.split()[0] for c in _PARSED.split(", ")])
    return read


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for origin, parts in zip(*(batch.column(c).to_pylist() for c in ("origin", "parts"))):
            first, last = parts[0], parts[-1]
            message = b"".join(p["body"] or b"" for p in parts)
            whole = ([p["number"] for p in parts] == list(range(1, len(parts) + 1)) and last["total"] == len(message)
                     and all(p["body"] is not None for p in parts))
            http, payload = unchunk(message) if whole else ({}, None)
            out.append((origin, first["type"], first["uri"], first["digest"], None, None, payload))
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=[c.split()[0] for c in _WHOLE.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``, one row per message: record_id, type, uri, digest, refers_to,
    http_length (of a Content-Length field), payload.

    All files are read (but those that Spark hides), gzipped or not. The payload is null for revisits, and where
    segments are missing, repeated, or do not add up to the total length, chunks do not add up, or a record is cut
    off. What a cut header does not tell is null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(_reader(False), _PARSED).select(
        "record_id", "type", "uri", "digest", "refers_to", "http_length", F.col("body").alias("payload"))
    parts = files.mapInArrow(_reader(True), _PARSED)
    joined = parts.groupBy("origin").agg(F.sort_array(F.collect_list(
        F.struct("number", "type", "uri", "digest", "total", "body"))).alias("parts"))
    return whole.union(joined.mapInArrow(_assemble, _WHOLE))


def page_of(record_id: Column) -> Column:
    """The page_id in a record identifier of ``write``; null for a row that had none."""
    ident = F.regexp_extract(record_id, f"^{_URN}(-?[0-9]+)", 1)
    return F.when(ident != "", ident).cast("bigint")
