"""WARC archives: writing segmented, chunked records and putting them together again."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialise, new_path

#: Payloads from this size on are written once; equal ones become revisits.
REVISIT_BYTES = 100
#: A record's block is cut into segments of this size, its payload into transfer chunks of that size.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 2_048, 1_024, 4_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Payload in HTTP/1.1 chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are passed over, broken framing raises ValueError."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk size line is missing")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size says")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Body of an HTTP response block, without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(b"transfer-encoding" in line.lower() and b"chunked" in line.lower() for line in head.split(b"\r\n")[1:])
    return unchunked(body) if framed else body


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _record(headers: dict[str, object], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def records(page_id: object, url: str | None, payload: bytes, digest: str, first: object, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> Iterator[bytes]:
    """WARC records of one page: a revisit without payload if ``first`` is another page's id, else one or more segments."""
    own = {
        "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": "1970-01-01T00:00:00Z", "X-Page-ID": None if page_id is None else quote(str(page_id), safe=""),
        # Rows that are alike have one record identifier; what each of them has written is told apart by this.
        "X-Write-ID": uuid.uuid4().hex,
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
    }
    if first is not None and first != page_id:
        original = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first, digest), "WARC-Payload-Digest": f"sha256:{digest}"}
        yield _record({"WARC-Type": "revisit"} | own | original, b"")
        return
    block = _HTTP + chunked(payload, chunk)
    head = {"WARC-Type": "response"} | own | {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if len(block) <= segment:
        yield _record(head, block)
        return
    starts = range(0, len(block), segment)
    for number, i in enumerate(starts, 1):
        last = {"WARC-Segment-Total-Length": len(block)} if number == len(starts) else {}
        if number > 1:
            head = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{number}')}>", "WARC-Segment-Origin-ID": own["WARC-Record-ID"], "WARC-Date": own["WARC-Date"], "X-Write-ID": own["X-Write-ID"]}
        yield _record(head | {"WARC-Segment-Number": number} | last, block[i : i + segment])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive file."""
    at, size = 0, len(data)
    while at < size:
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        at = end + 4 + int(headers["content-length"])
        if at > size:
            raise ValueError("a record is cut off")
        yield headers, data[end + 4 : at]


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each row of (page_id, url, html) as WARC files under ``path``.

    Of rows with equal payloads of at least 100 bytes the smallest page_id is written in full, the others as revisits.
    Spark's text writer puts the record ends between records, so any store it reaches can hold the archives; files
    are compressed, and cut by a number of records, none of which is longer than a segment with its headers. Null html is an empty payload; a null page_id is always written in full.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    big = rows.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    firsts = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    firsts = broadcast_if_small(materialise(firsts.select(F.col("digest").alias("_digest"), "first"), "firsts"))
    marked = rows.join(firsts, F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "digest", "first")]
                for record in records(*row[:4], None if row[0] is None else row[4]):
                    out.append(record)
                    size += len(record)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
                    out, size = [], 0
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    made = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


_FIELDS = "record_id string, record_type string, page_id string, url string, digest string, refers_to string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All logical records of the archives under ``path`` with their payloads.

    Returns (record_id, record_type, page_id string, url, digest, refers_to, payload). Segments are grouped by the
    identifier of their origin record, ordered by segment number, checked
    for gaps and against the total length, and then decoded. A record that is written several times comes back as
    often. A revisit has a null payload: it stands in the record it refers to. Broken archives raise an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in parse(unpacked(batch.column("content")[k].as_buffer().to_pybytes())):
                    page, kind = headers.get("x-page-id"), headers["warc-type"]
                    own = headers["warc-record-id"]
                    rows.append((
                        own, kind, None if page is None else unquote(page), headers.get("warc-target-uri"), headers.get("warc-payload-digest", "").removeprefix("sha256:"), headers.get("warc-refers-to"),
                        f"{headers.get('warc-segment-origin-id', own)} {headers.get('x-write-id', '')}", int(headers.get("warc-segment-number", 0)), int(headers.get("warc-segment-total-length", -1)), block,
                    ))
                    size += len(block)
                    if size > 4_000_000:
                        yield _batch(rows, _PARTS)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _PARTS)

    # Archives are read and parsed once; whole records are groups of one row.
    parts = files.mapInArrow(read, f"{_FIELDS}, origin string, number int, total long, block binary")
    groups = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "record_id", "record_type", "page_id", "url", "digest", "refers_to", "total", "block"))).alias("segments")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for segments in batch.column("segments") for row in _joined(segments.as_py())]
            if rows:
                yield _batch(rows, _WHOLE)

    return groups.mapInArrow(join, f"{_FIELDS}, payload binary")


def unpacked(data: bytes) -> bytes:
    """An archive file without its compression, if it has any; it may consist of several compressed members."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join([*out, data])


_WHOLE = pa.schema([(c, pa.string()) for c in ("record_id", "record_type", "page_id", "url", "digest", "refers_to")] + [("payload", pa.binary())])
_PARTS = pa.schema([*list(_WHOLE)[:6], pa.field("origin", pa.string()), pa.field("number", pa.int32()), pa.field("total", pa.int64()), pa.field("block", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _joined(segments: list[dict]) -> list[tuple]:
    """The logical record of sorted segments, once for each time that it was written. Number 0 is a whole record."""
    if segments[-1]["number"] == 0:
        return [_logical(s, s["block"]) for s in segments]
    times = sum(s["number"] == 1 for s in segments)
    single = segments[:: max(times, 1)]
    if not times or [s["number"] for s in single] != list(range(1, len(single) + 1)) or len(single) * times != len(segments):
        raise ValueError(f"segments are missing of {segments[0]['record_id']}")
    block = b"".join(s["block"] for s in single)
    if single[-1]["total"] != len(block):
        raise ValueError(f"the total length of {single[0]['record_id']} is {single[-1]['total']}, its segments have {len(block)}")
    return [_logical(single[0], block)] * times


def _logical(head: dict, block: bytes) -> tuple:
    payload = None if head["record_type"] == "revisit" else http_payload(block)
    return head["record_id"], head["record_type"], head["page_id"], head["url"], head["digest"], head["refers_to"], payload


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages as archives to the shared folder, read them back and describe every page's full payload.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to). A revisit takes size and digest from the
    payload of the response that it refers to. Ids come back with the type they had.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    found = read_archives(spark, path)
    found = materialise(found.select("record_id", "record_type", F.col("page_id").cast(kind).alias("page_id"), "refers_to", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha")), "records")
    # A written table: the join below exchanges both sides by itself, so that a response with very many revisits is split.
    responses = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("_id")).agg(F.min("page_id").alias("_page"), F.min("bytes").alias("_bytes"), F.min("sha").alias("_sha"))
    responses = broadcast_if_small(materialise(responses, "responses"))
    both = found.join(responses, F.col("refers_to") == F.col("_id"), "left")
    return both.select(
        "page_id",
        F.coalesce("bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("sha", "_sha").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("_page")).alias("refers_to"),
    )
