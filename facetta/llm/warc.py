"""WARC writing and reading with segment reassembly.

A page becomes an HTTP response with chunked framing in a ``response`` record, or a ``revisit`` record if a page
with a larger id has the same payload. A block longer than a segment is cut: the first segment stays a
``response``, the others are ``continuation`` records that name it as origin. Every record is a gzip member of its
own, so a reader may seek by record. A file is one row of Spark's text writer (any store that Spark writes to will
do); the writer's line separator is an empty gzip member, which ends the file and reads as nothing.

Reading parses every file once, decodes whole records at once, groups the segments of the others by origin, orders
them by number, verifies count and total length, and decodes the chunks. Records of other types and of other
writers are read too: their payload is the HTTP body where the block is an HTTP message, else the block.

Defined cases: a null html is an empty payload; a null url has no target URI; a null page_id is kept null. Rows
that repeat a page_id with the same payload as the response are responses too. Very long pages are cut in segments;
a task holds one file of about ``FILE_BYTES`` and one record. An empty table has no records. Extra columns are
ignored. A record without a payload digest, or with one of another kind than SHA-1, has a null verified; framing
that does not parse leaves the body as it is. Continuations whose origin is not in the archive are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetta.llm.common import by_batch, new_path, stored, utf8

CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SEGMENT = 1 << 16
CHUNK = 1 << 14
PER_FILE = 1024
#: Compressed bytes after which a file ends.
FILE_BYTES = 1 << 23
#: An empty gzip member.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    if b"chunked" not in fields.get(b"transfer-encoding", b""):
        return body
    try:
        return dechunked(body)
    except ValueError:
        return body  # stored after decoding, or damaged: the digest tells


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf8") + CRLF + block + b"\r\n\r\n"


def urn(*parts) -> str:
    """A record id that a task run again gives again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def page_records(archive: str, name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, repeated: bool, segment: int) -> list[bytes]:
    """archive: tells apart the records of archives; name: those of an archive; repeated: other rows are the same response."""
    sha, uri = base32_sha1(payload), None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    own = urn(archive, name) if revisit or repeated else urn(archive, page_id, sha)
    number = lambda x: None if x is None else str(x)
    about = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Page-ID", number(page_id)), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        to = None if repeated else urn(archive, refers_to, sha)
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *about, ("WARC-Profile", profile), ("WARC-Refers-To", to), ("WARC-Refers-To-Page-ID", number(refers_to))], HTTP)]
    block = HTTP + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *about]
    if len(block) <= segment:
        return [record(first, block)]
    out = [record([*first, ("WARC-Segment-Number", "1")], block[:segment])]
    for i, at in enumerate(range(segment, len(block), segment), 2):
        total = str(len(block)) if at + segment >= len(block) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", urn(archive, name, i)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(i)), ("WARC-Segment-Total-Length", total)]
        out.append(record(fields, block[at : at + segment]))
    return out


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """__id, __sha, refers_to, revisit and repeated of the rows that are no single response.

    repeated: the response of this payload is more than one row; then it has no id that a revisit could name.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    ids = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha"), (F.octet_length(html) >= least).alias("long"))
    counted = ids.groupBy("page_id", "sha", "long").agg(F.count("*").alias("n"))
    top = F.max(F.when(F.col("long"), F.struct("page_id", "n")))
    same = counted.groupBy("sha").agg(top.alias("top"), F.sum("n").alias("c")).filter("c > 1").select("sha", F.col("top.page_id").alias("refers_to"), F.coalesce(F.col("top.n") > 1, F.lit(False)).alias("repeated"))
    found = counted.join(same, "sha").withColumn("revisit", F.col("long") & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    found = found.withColumn("repeated", F.when(F.col("revisit"), F.col("repeated")).otherwise(F.col("n") > 1)).filter("revisit or repeated")
    return found.select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"), "revisit", "repeated")


def write_warc(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """One response or revisit record for each page, with continuations for long ones; a file has ``per_file`` records at most."""
    spark = pages.sparkSession
    again, _ = stored(spark, revisits(pages, least), "warc-revisits")
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html")
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.join(again, rows.page_id.eqNullSafe(again["__id"]) & (sha == again["__sha"]), "left").select(F.col("page_id").cast("long"), "url", "html", "refers_to", flag("revisit"), flag("repeated"))
    archive = uuid.uuid4().hex

    def run(batches):
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        file = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                ids, urls, refers, twice, repeated = (piece.column(j).to_pylist() for j in (0, 1, 3, 4, 5))
                for page_id, url, payload, to, revisit, several in zip(ids, urls, utf8(piece.column(2)), refers, twice, repeated):
                    for one in page_records(archive, f"{part}:{n}", page_id, url, payload or b"", to, revisit, several, segment):
                        held.append(gzip.compress(one, 6, mtime=0))
                        size += len(held[-1])
                        if len(held) >= per_file or size >= FILE_BYTES:
                            yield file()
                            held, size = [], 0
                    n += 1
        if held:
            yield file()

    files = rows.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def members(data: bytes):
    """The content of each gzip member of a file; a file that is not compressed is one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            piece = data[at : at + (1 << 14)]
            if not piece:
                raise ValueError("a gzip member is cut off")
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def parsed(data: bytes):
    """(fields, block) of each record of a member."""
    at = 0
    while True:
        while data[at : at + 2] == CRLF:
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip().decode("utf8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        n = int(fields[b"content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n


RECORDS = "record_type string, record_id string, page_id long, url string, payload_digest string, refers_to long, refers_to_id string, payload_bytes long, payload binary, verified boolean"
NAMES = [c.split()[0] for c in RECORDS.split(", ")]
KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
SEGMENTS = "origin string, number int, total long, head string, block binary"
SEGMENT_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]


def whole(fields: dict[bytes, str], block: bytes, complete: bool = True, payloads: bool = True) -> tuple:
    """The row of a record."""
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    kind = fields.get(b"warc-type", "")
    payload = None
    if kind != "revisit":
        payload = http_payload(block) if complete and fields.get(b"content-type", "").startswith("application/http") else block
    digest = fields.get(b"warc-payload-digest")
    name, _, value = (digest or "").partition(":")
    good = None
    if not complete:
        good = False
    elif payload is None:
        good = True  # a revisit has none to verify
    elif name.lower() == "sha1":
        good = value.upper() == base32_sha1(payload) or value.lower() == hashlib.sha1(payload).hexdigest()
    shown = None if digest is None else value if name.lower() == "sha1" else digest
    size = None if payload is None else len(payload)
    return kind, fields.get(b"warc-record-id"), number(b"warc-page-id"), fields.get(b"warc-target-uri"), shown, number(b"warc-refers-to-page-id"), fields.get(b"warc-refers-to"), size, payload if payloads else None, good


def read_warc(spark: SparkSession, path: str, payloads: bool = True, pattern: str = "part-*") -> DataFrame:
    """A row for each record but continuations; verified is false where segments miss or the digest differs, null where nothing can be verified.

    The files are parsed once, into a written table of whole records and segments; without ``payloads`` it holds no
    payload of a whole record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")
    names = [*NAMES, *(c.split()[0] for c in SEGMENTS.split(", "))]
    kinds = [*KINDS, *SEGMENT_KINDS]
    none, one = (None,) * len(KINDS), (None,) * len(SEGMENT_KINDS)

    def row(fields, block):
        if b"warc-segment-number" not in fields:
            return whole(fields, block, payloads=payloads) + one
        first = fields[b"warc-segment-number"] == "1"
        head = "\n".join(f"{k.decode()}:{v}" for k, v in fields.items()) if first else None
        total = fields.get(b"warc-segment-total-length")
        return (*none, fields[b"warc-record-id"] if first else fields.get(b"warc-segment-origin-id"), int(fields[b"warc-segment-number"]), int(total) if total else None, head, block)

    def run(batches):
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for member in members(content.as_py()):
                    for fields, block in parsed(member):
                        out.append(row(fields, block))
                        held += len(block) + 512
                        if held > 1 << 23:
                            yield table()
                            out, held = [], 0
                if out:
                    yield table()

    found, _ = stored(spark, files.mapInArrow(run, f"{RECORDS}, {SEGMENTS}"), "warc-records")
    singles = found.filter("number is null").select(*NAMES)
    parts = found.filter("number is not null")
    groups = parts.groupBy("origin").agg(F.max("total").alias("total"), F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for total, head, segments in zip(*(batch.column(i) for i in range(3))):
            segments, total, head = segments.as_py(), total.as_py(), head.as_py()
            if head is None:
                continue  # continuations whose origin is not in the archive
            fields = {k.encode(): v for k, _, v in (x.partition(":") for x in head.split("\n"))}
            block = b"".join(s["block"] for s in segments)
            complete = [s["number"] for s in segments] == list(range(1, len(segments) + 1)) and total == len(block)
            out.append(whole(fields, block, complete, payloads))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * len(KINDS), KINDS)], names=NAMES)

    return singles.unionByName(by_batch(groups.select("total", "head", "parts"), join, RECORDS, 16))


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, from the archives written and read back; a revisit has the size of its response."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, least)
    digest = read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")
    found, _ = stored(spark, digest, "warc-digests")
    if not found.filter("record_type = 'response' and not coalesce(verified, false)").isEmpty():
        raise ValueError("an archive record is damaged or incomplete")
    responses = found.filter("record_type = 'response'")
    of = responses.groupBy(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    second = found.filter("record_type = 'revisit'").drop("payload_bytes")
    second = second.join(of, (second.refers_to == of["__id"]) & (second.payload_digest == of["__digest"]), "left").withColumn("payload_bytes", F.col("__bytes"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*names).union(second.select(*names))
