"""WARC archives: write captures, read records, and assemble one nested row per capture.

A capture is three records: the response (or a revisit of an equal payload), the request
and a metadata record, the last two naming the first in ``WARC-Concurrent-To``.  Spark's
text writer writes the archives (gzip), a record a line whose separator is the end of the
record; they are read as binary files and cut by ``Content-Length``, so payloads may hold
anything.  A file is one task's work: captures are written by size class, and a class's files
hold so many records that ``FILE_BYTES`` bounds each of them (a larger capture has a file of
its own); readers unpack a file piece by piece and hold one record at a time.  Record ids are
derived from the capture, so a lost task writes the same ids again.

Defined results: a null payload is empty; payloads under ``SMALL`` bytes are never
revisits; of rows that share the smallest id all are responses; a null id is larger than
any other; a null URL leaves out the target header; rows repeated in all three columns
share their record ids, and their assembled row counts them in ``copies``; an empty table
gives no records and no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm.registry import query, table
from siftloom.operators.skew import attach_per_key
from siftloom.session import cut_lineage, scratch_folder

#: Payloads below this size are always stored.
SMALL = 100
#: Bytes of records in an archive file before compression, and the bounds of the size classes of payloads.
FILE_BYTES = 256 << 20
CLASSES = (16 << 10, 256 << 10, 4 << 20, 64 << 20)
#: Bytes that the records of a capture take besides their payload and four times its URL, at most.
HEADERS = 8 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Bytes of records in a batch that the reader sends on.
BATCH_BYTES = 8 << 20
#: Bytes that are unpacked at a time.
PIECE_BYTES = 1 << 20
#: Captures of one payload, or revisits of one capture, from which it is met by broadcast.
HOT = 10_000


def _header(name: str, value: Column) -> Column:
    """Header line, or nothing for a null; line breaks in a value are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _record(kind: Column, record_id: Column, url: Column, media: str, block: Column, more: list[Column]) -> Column:
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id),
        F.lit(f"WARC-Date: {DATE}{CRLF}"), _header("WARC-Target-URI", url), *more, F.lit(f"Content-Type: {media}{CRLF}"),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block, F.lit(CRLF))


def _identifier(kind: str, *parts: Column) -> Column:
    """Name-based record id."""
    digest = F.md5(F.concat_ws("\x01", F.lit(kind), *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]))
    groups = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def with_revisits(captures: DataFrame) -> DataFrame:
    """Add ``refers_to`` (record id of the equal payload with the least ``page_id``) and ``first``.

    ``captures`` has record_id, page_id, digest and bytes.  Rows without a partner are
    scattered by their own id, so no partition gathers the small payloads.
    """
    large = captures.where(F.col("bytes") >= SMALL)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id"))
    firsts = (large.groupBy(F.col("digest").alias("_digest")).agg(first.alias("_first"), F.count("*").alias("_n"))
              .where("_n > 1"))
    key = F.when(F.col("bytes") >= SMALL, F.col("digest")).otherwise(F.col("record_id"))
    # a payload that very many captures share is met by broadcast
    joined = attach_per_key(captures.withColumn("_key", key), firsts.withColumnRenamed("_digest", "_key"), ["_key"], ["record_id"], hot_rows=HOT)
    tie = F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    again = F.col("_first").isNotNull() & ~tie
    return joined.withColumn("refers_to", F.when(again, F.col("_first.record_id"))).drop("_key", "_first")


def _size_class(payload_bytes: Column, url: Column) -> Column:
    """Number of bounds that a capture's records exceed; a URL stands in them four times."""
    size = payload_bytes + 4 * F.coalesce(F.octet_length(url), F.lit(0))
    return sum(((size > bound).cast("int") for bound in CLASSES), F.lit(0))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write an archive of ``pages`` under ``path``."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("payload"),
        F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes"))
    named = [F.col("page_id").cast("string"), F.col("url"), F.col("digest")]
    rows = with_revisits(rows.withColumn("record_id", _identifier("answer", *named)))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
                    _header("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    answer = _record(
        F.when(revisit, "revisit").otherwise("response"), F.col("record_id"), F.col("url"), "application/http; msgtype=response",
        F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))),
        [_header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), _header("WARC-Refers-To", F.col("refers_to")),
         F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}{CRLF}")).otherwise("")])
    with_it = _header("WARC-Concurrent-To", F.col("record_id"))
    rest = F.regexp_extract("url", "(?s)^[^/]*//[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), F.coalesce(rest, F.lit("")))), F.lit(f" HTTP/1.1{CRLF}"),
                     _header("Host", F.regexp_extract("url", "(?s)^[^/]*//([^/?#]*)", 1)), F.lit(CRLF))
    request = _record(F.lit("request"), _identifier("request", *named), F.col("url"), "application/http; msgtype=request", asked, [with_it])
    metadata = _record(F.lit("metadata"), _identifier("metadata", *named), F.col("url"), "application/warc-fields",
                       _header("page-id", F.col("page_id").cast("string")), [with_it])
    there = pages.select(_size_class(F.octet_length(body), F.col(url)).alias("k")).distinct().collect()  # one row per class
    rows = rows.withColumn("_class", _size_class(F.col("bytes"), F.col("url")))
    for k in sorted(r.k for r in there) or [0]:
        most = max(3, 3 * (FILE_BYTES // (CLASSES[k] + HEADERS))) if k < len(CLASSES) else 3
        (rows.where(F.col("_class") == k).select(F.explode(F.array(answer, request, metadata)).alias("value"))
         .write.mode("append").option("lineSep", CRLF).option("maxRecordsPerFile", most).option("compression", "gzip").text(path))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode(errors="replace").split(CRLF)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _unpacked(content: memoryview | bytes) -> Iterator[bytes]:
    """Pieces of a file's bytes; gzip files, of one member or many, are unpacked on the way."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield bytes(content)
        return
    rest = content
    while len(rest):
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        while not member.eof:
            piece = member.decompress(rest, PIECE_BYTES)
            rest = member.unconsumed_tail if not member.eof else member.unused_data
            if piece:
                yield piece
            elif not member.eof and not len(rest):
                raise ValueError("the gzip file ends early")


class _Reader:
    """Reads bytes of an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at:] + piece, 0
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes before ``mark``, which is read too; empty at the end of the file."""
        start = self.at
        while (end := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - self.at - len(mark))
            if not self._more():
                if self.held[self.at:]:
                    raise ValueError("no WARC record: the file ends inside it")
                return b""
        out, self.at = self.held[self.at: end], end + len(mark)
        return out

    def take(self, size: int) -> bytes:
        parts, missing = [], size
        while missing:
            part = self.held[self.at: self.at + missing]
            parts.append(part)
            missing, self.at = missing - len(part), self.at + len(part)
            if missing and not self._more():
                raise ValueError("no WARC record: the file ends inside it")
        return b"".join(parts)


def parse(content: memoryview | bytes) -> Iterator[dict]:
    """Records of one archive file, one at a time; ValueError where the file is no WARC."""
    source = _Reader(_unpacked(content))
    while top := source.until(b"\r\n\r\n"):
        if not top.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        head = _fields(top)
        block = source.take(int(head["content-length"]))
        source.take(4)
        kind = head["warc-type"]
        out = {"record_id": head["warc-record-id"], "record_type": kind, "concurrent_to": head.get("warc-concurrent-to"),
               "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
               "http": {}, "fields": {}, "payload": None, "payload_bytes": None, "payload_digest": None}
        if kind in ("response", "revisit", "request"):
            top, _, payload = block.partition(b"\r\n\r\n")
            out["http"] = _fields(top)
            if kind == "response":
                out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
            elif kind == "revisit":
                size = out["http"].get("content-length")
                digest = head.get("warc-payload-digest")
                out |= {"payload_bytes": size and int(size), "payload_digest": digest and digest.rpartition(":")[2]}
        elif kind == "metadata":
            out["fields"] = _fields(b"\r\n" + block)
        yield out


RECORD = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "http map<string,string>, fields map<string,string>, payload binary, payload_bytes long, payload_digest string")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archive files under ``path``; without ``payload`` only its size and digest."""
    text, names = pa.string(), pa.map_(pa.string(), pa.string())
    schema = pa.schema([("record_id", text), ("record_type", text), ("concurrent_to", text), ("refers_to", text), ("target_uri", text),
                        ("date", text), ("http", names), ("fields", names), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for record in parse(content.as_buffer()):
                    held += 600 + len(record["payload"] or b"")
                    if not payload:
                        record["payload"] = None
                    rows.append(record | {"http": list(record["http"].items()), "fields": list(record["fields"].items())})
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, copies and the structs ``answer``, ``request``, ``metadata``.

    Records meet by the identifier they are concurrent to; the answer by its own.  Of
    several of a kind the one with the least record id is taken; a missing one is null.
    """
    kind = F.col("record_type")
    whole = F.struct(*records.columns)
    own = kind.isin("response", "revisit")

    def one(condition: Column, name: str) -> Column:
        return F.min_by(whole, F.when(condition, F.col("record_id"))).alias(name)

    capture = F.when(own, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    grouped = records.groupBy(capture.alias("capture_id")).agg(
        F.count_if(own).alias("copies"), one(own, "answer"), one(kind == "request", "request"), one(kind == "metadata", "metadata"))
    return grouped


@query("op2_warc_captures")
def op2(spark, sf_dir):
    path = scratch_folder(spark)
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    captures = assemble(read(spark, path, payload=False)).select(
        "capture_id", "copies", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("answer.payload_bytes").alias("payload_bytes"),
        F.col("answer.payload_digest").alias("payload_digest"), F.col("answer.record_type").alias("record_type"),
        F.col("answer.refers_to").alias("_target"), F.col("request.target_uri").alias("url"))
    captures = cut_lineage(captures)
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    rows = captures.select("*", each.alias("_")).drop("_")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    stored = rows.where("_target is null").withColumn("refers_to", F.lit(None).cast("long")).select(*names)
    origin = captures.where("record_type = 'response'").select(F.col("capture_id").alias("_target"), F.col("page_id").alias("refers_to"))
    asked = rows.where("_target is not null")
    counted = origin.join(asked.groupBy("_target").agg(F.count("*").alias("_n")), "_target")
    again = attach_per_key(asked.drop("refers_to"), counted, ["_target"], ["capture_id"], hot_rows=HOT).select(*names)
    return stored.unionByName(again)
