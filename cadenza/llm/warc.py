"""WARC archives: writing with revisits and segments, reading with segment reassembly.

*Writing.*  Every page is one capture whose block is an HTTP response in chunked transfer
framing.  Of captures with equal payloads of at least ``SMALLEST`` bytes the one with the
smallest page_id is stored as response, the others as revisits without payload.  Blocks longer
than ``SEGMENT`` bytes are cut into a first record and continuation records.  Spark's text
writer lays the records down, since a record is text and ends with two line ends.

*Reading.*  Archives are parsed one file at a time (the writer bounds files); a record that
cannot be read gives a row with its problem, and reading goes on at the next record.  Whole
records are decoded at once.  Segments are grouped by their origin identifier, ordered by
number, checked for gaps and for the total length, and decoded; a revisit takes length and
digest from the response that it names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cadenza.llm import common
from cadenza.timeline import checkpoint_folder

SMALLEST = 100
SEGMENT = 65_536
CHUNK = 16_384
#: A record's block is at most SEGMENT bytes, so that a file is bounded in bytes too.
RECORDS_A_FILE = 1_000
DATE = "2025-01-01T00:00:00Z"
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing -------------------------------------------------------------------------------


def cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes that do not split a UTF-8 character; none of no bytes."""
    out, at = [], 0
    while at < len(data):
        stop = min(at + size, len(data))
        while stop < len(data) and stop > at + 1 and data[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append(data[at:stop])
        at = stop
    return out


def chunked(payload: bytes) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cut(payload, CHUNK)) + b"0\r\n\r\n"


def header(fields: dict[str, object], block: bytes) -> str:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + END


def safe(url: str | None) -> str | None:
    """An address without the characters that would end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None


def records(page_id: int | None, url: str | None, html: str, first: int | None, identity: str, segment: int = SEGMENT) -> list[str]:
    """The records of one capture; ``first`` is the page that a revisit repeats."""
    payload = html.encode("utf-8", "replace")
    identifier = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(identity.encode()).digest())}>"
    fields: dict[str, object] = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": identifier,
        "WARC-Date": DATE,
        "WARC-Target-URI": safe(url),
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type": "application/http;msgtype=response",
        "Page-ID": page_id,
    }
    if first is not None:
        fields |= {"WARC-Profile": PROFILE, "Refers-To-Page-ID": first}
        block = HTTP + b"\r\n"
        return [header(fields, block) + block.decode()]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = cut(block, segment)
    if len(parts) == 1:
        return [header(fields, block) + block.decode()]
    out = [header(fields | {"WARC-Segment-Number": 1}, parts[0]) + parts[0].decode()]
    for k, part in enumerate(parts[1:], 2):
        more: dict[str, object] = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{identity} {k}'.encode()).digest())}>",
            "WARC-Date": DATE,
            "WARC-Segment-Number": k,
            "WARC-Segment-Origin-ID": identifier,
            "WARC-Segment-Total-Length": len(block) if k == len(parts) else None,
        }
        out.append(header(more, part) + part.decode())
    return out


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``path``; a null html is an empty payload.

    Only short digests are grouped, never payloads.  Repeated rows are captures of their own;
    those that repeat the smallest page_id are responses too.  A row without page_id never
    stands for others unless no row of its payload has one.
    """
    captures = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256).alias("digest")
    copies = (
        captures.where(F.octet_length("html") >= SMALLEST)
        .select("page_id", digest)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    joined = captures.withColumn("digest", digest).join(common.small(common.stage(copies, "copies")), "digest", "left")
    repeats = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def laid(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                rows: list[str] = []
                for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.slice(low, 200).columns), strict=True):
                    n += 1
                    rows += records(page_id, url, html, first, f"{page_id} {task} {n}", segment)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    lines = joined.select("page_id", "url", "html", F.when(repeats, F.col("first")).alias("first")).mapInArrow(laid, "value string")
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


# --- reading -------------------------------------------------------------------------------


def dechunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size without line end")
        size = int(body[at:line].split(b";")[0].strip() or b"x", 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another size")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP message."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP header without end")
    if re.search(rb"^transfer-encoding:[^\r\n]*chunked", head, re.I | re.M):
        return dechunked(body)
    return body


def parsed(data: bytes):
    """(fields, block, problem) of every record of an archive; fields have lower-case names."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            yield {}, b"", "header without end"
            return
        head = data[at:stop].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = fields.get("content-length", "")
        begin = stop + 4
        if size.isdigit() and data[begin + int(size) : begin + int(size) + 4] == b"\r\n\r\n":
            yield fields, data[begin : begin + int(size)], None
            at = begin + int(size) + 4
            if at < len(data) and not data.startswith(b"WARC/", at):
                at = data.find(b"\r\n\r\nWARC/", at) + 4 if data.find(b"\r\n\r\nWARC/", at) >= 0 else -1
        else:
            yield fields, b"", "record of another length"
            following = data.find(b"\r\n\r\nWARC/", stop)
            at = following + 4 if following >= 0 else -1


def unpacked(content: bytes) -> bytes:
    """An archive without its compression, which may be in several members; what is cut off is missing."""
    out = []
    while content[:2] == b"\x1f\x8b":
        step = zlib.decompressobj(31)
        try:
            out.append(step.decompress(content))
        except zlib.error:
            break
        content = step.unused_data
    return b"".join(out) if out else content


LONG, TEXT, BYTES = T.LongType(), T.StringType(), T.BinaryType()
ROW = T.StructType(
    [
        T.StructField("page_id", LONG),
        T.StructField("url", TEXT),
        T.StructField("record_type", TEXT),
        T.StructField("refers_to", LONG),
        T.StructField("payload_bytes", LONG),
        T.StructField("payload_digest", TEXT),
        T.StructField("payload", BYTES),
        T.StructField("problem", TEXT),
        T.StructField("origin", TEXT),
        T.StructField("segment", T.IntegerType()),
        T.StructField("total", LONG),
        T.StructField("block", BYTES),
    ]
)
SHAPE = to_arrow_schema(ROW)


def number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


def decoded(row: dict, block: bytes, stated: str | None, keep: bool) -> dict:
    """``row`` with what the block of a response says, or with its problem."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return row | {"problem": str(e)}
    digest = hashlib.sha256(payload).hexdigest()
    wrong = stated is not None and stated.startswith("sha256:") and stated[7:].lower() != digest
    return row | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload if keep else None, "problem": "digest differs" if wrong else None}


def rows_of(content: bytes, keep: bool):
    for fields, block, problem in parsed(unpacked(content)):
        kind = fields.get("warc-type")
        row = {
            "page_id": number(fields.get("page-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": number(fields.get("refers-to-page-id")), "payload_digest": fields.get("warc-payload-digest"), "problem": problem,
        }
        if problem is None and "warc-segment-number" in fields:
            origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
            yield row | {"origin": origin, "segment": number(fields["warc-segment-number"]), "total": number(fields.get("warc-segment-total-length")), "block": block}
        elif problem is None and kind == "response":
            yield decoded(row, block, row["payload_digest"], keep)
        elif problem is not None or kind == "revisit":
            yield row
        # other kinds (warcinfo, request, metadata, ...) hold no page


def joined(parts: list[dict]) -> tuple[bytes, str | None]:
    """The block of a capture's segments, and what is wrong with it."""
    numbers = [p["segment"] for p in parts]
    if numbers != list(range(1, len(parts) + 1)):
        return b"", "segments missing or repeated"
    block = b"".join(p["block"] for p in parts)
    if parts[-1]["total"] is None:
        return b"", "total length missing"
    if parts[-1]["total"] != len(block):
        return b"", "another total length"
    return block, None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, problem: one row per capture below ``path``.

    ``payload`` is filled for responses if asked for.  A capture that cannot be read has its
    problem and no length or digest; a revisit whose response is missing or broken likewise.
    """

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                found: list[dict] = []
                for row in rows_of(content.as_py(), payloads):
                    found.append(row)
                    if len(found) == 500:
                        yield pa.RecordBatch.from_pylist(found, SHAPE)
                        found = []
                yield pa.RecordBatch.from_pylist(found, SHAPE)

    files = spark.read.format("binaryFile").load(path)
    rows = common.stage(files.select("content").mapInArrow(parse, ROW), "records")
    whole = rows.where("segment is null and origin is null")
    names = [f.name for f in ROW if f.name not in ("origin", "segment", "total", "block")]
    # one group is one capture
    segments = F.array_sort(F.collect_list(F.struct("segment", "total", "block", "page_id", "url", "record_type", "payload_digest")))
    grouped = rows.where("origin is not null").groupBy("origin").agg(segments.alias("parts")).select("parts")
    short = T.StructType([ROW[n] for n in names])
    shape = to_arrow_schema(short)

    def assemble(batches):
        for batch in batches:
            for parts in batch.column(0):
                parts = parts.as_py()
                first = parts[0]
                row = {"page_id": first["page_id"], "url": first["url"], "record_type": first["record_type"]}
                block, problem = joined(parts)
                done = row | {"problem": problem} if problem else decoded(row, block, first["payload_digest"], payloads)
                yield pa.RecordBatch.from_pylist([done], shape)

    captures = whole.select(names).unionByName(grouped.mapInArrow(assemble, short))
    captures = common.stage(captures, "captures")
    responses = captures.where("record_type = 'response' and problem is null and page_id is not null")
    # one page_id may stand for several payloads: a revisit that states its digest means the response with that
    known = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("bytes"))
    known = common.stage(known.withColumnRenamed("payload_digest", "digest"), "responses")
    same = known.select("refers_to", F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"), F.col("bytes").alias("own"))
    some = known.groupBy("refers_to").agg(F.max_by("bytes", "digest").alias("bytes"), F.max("digest").alias("digest"))
    revisits = captures.where("record_type = 'revisit'").join(common.small(same), ["refers_to", "payload_digest"], "left").join(common.small(some), "refers_to", "left")
    met, stated = F.col("own").isNotNull(), F.col("payload_digest").startswith("sha256:")
    differs = ~met & F.coalesce(stated, F.lit(False))
    problem = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("digest").isNull(), "response missing").when(differs, "digest differs")
    digest = F.when(met, F.substring("payload_digest", 8, 64)).otherwise(F.col("digest"))
    followed = revisits.withColumns({"problem": problem, "payload_bytes": F.coalesce("own", "bytes"), "payload_digest": digest}).select(names)
    return captures.where("record_type is null or record_type <> 'revisit'").select(names).unionByName(followed)


def round_trip(pages: DataFrame, payloads: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    path = f"{checkpoint_folder(pages.sparkSession)}/llm-warc-{uuid.uuid4().hex}"
    write(pages, path, segment)
    return read(pages.sparkSession, path, payloads)
