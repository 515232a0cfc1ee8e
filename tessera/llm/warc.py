"""WARC archives of pages: written with segments and chunked bodies, read back and reassembled.

Writing: a record for every page, its HTTP body in chunked transfer framing. A page whose
payload of at least `revisit_bytes` equals that of a page with a smaller id is a revisit of
the first such page. Blocks beyond `segment_bytes` go on in continuation records, so every
record, and with `records_per_file` every file, is of bounded size. The files are gzipped WARC
1.1 written by Spark's text sink: a record ends with two line ends, which are the separator.

Reading: records are cut by their Content-Length. Continuations are grouped by the id of
their origin and ordered by segment number; numbers without gap, the total length of the last
segment, the chunk framing and the payload digest are verified (`valid`). A revisit is valid if
the response that it refers to is there, valid, and of the digest and length that it states.

Null html is an empty payload, a null url gives a record without target; null page ids come
back as null and count as the largest. Repeated rows are records each, of equal ones the
first is the response. No pages give an archive without records. Other columns are not kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import batches_of, discard, stored

REVISIT_BYTES, SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 100, 16 << 10, 4096, 4096
#: Pages that Python gets at once; they may be large.
PAGES_AT_ONCE = 256
_END = b"\r\n\r\n"
_BATCH_BYTES = 4 << 20
_INFLATE = 1 << 14


def _chunked(body: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + CHUNK_BYTES]), body[i : i + CHUNK_BYTES]) for i in range(0, len(body), CHUNK_BYTES)]
    return b"".join([*parts, b"0", _END])


def dechunk(body: bytes) -> bytes | None:
    """The payload of a body in chunked transfer framing; None where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at:end]) if end >= 0 else None
        if not size:
            return None
        n, at = int(size[0], 16), end + 2
        if n == 0:  # then only trailer lines and an empty line
            return b"".join(parts) if body.endswith(b"\r\n") else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}".encode() + _END + block


def records_of(page_id, uri: str | None, payload: bytes, number: int, digest: str, first: tuple | None, segment_bytes: int, date: str) -> Iterator[bytes]:
    """The record of a page and its continuations, without the ends of records."""
    name = lambda page, k: f"<urn:x-page:{'null' if page is None else page}:{k}>"
    own = name(page_id, number)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if first is not None:
        headers += [("WARC-Refers-To", name(*first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record(headers, http + b"Content-Length: %d" % len(payload) + _END)
        return
    block = http + b"Transfer-Encoding: chunked" + _END + _chunked(payload)
    if len(block) <= segment_bytes:
        yield _record(headers, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([*headers, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        more: list[tuple[str, object]] = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Date", date), ("WARC-Target-URI", target),
            ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None),
        ]
        yield _record(more, part)


def write(pages: DataFrame, path: str, *, key: str = "page_id", uri: str = "url", text: str = "html", revisit_bytes: int = REVISIT_BYTES,
          segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write the archive of the pages to a new folder."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pages.select(
        F.col(key).alias("key"), F.col(uri).alias("uri"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"),
        F.monotonically_increasing_id().alias("number"),
    )
    # copies are counted where they lie, before the shuffle, and only digests that repeat go on
    order = F.struct(F.col("key").isNull().alias("last"), "key", "number")
    firsts = rows.where(F.octet_length("body") >= revisit_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("digest", F.col("first.key").alias("first_key"), F.col("first.number").alias("first_number"))
    joined = rows.join(firsts, "digest", "left").select("key", "uri", "body", "number", "digest", "first_key", "first_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                page, target, html, number, digest, first_key, first_number = (batch.column(c)[i].as_py() for c in range(7))
                first = None if first_number is None or first_number == number else (first_key, first_number)
                for record in records_of(page, target, html.encode(), number, digest, first, segment_bytes, date):
                    out.append(record)
                    size += len(record)
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    with batches_of(pages.sparkSession, PAGES_AT_ONCE):
        records.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (small letters) and block of each record of an archive's bytes."""
    at = 0
    while at < len(data):
        end = data.index(_END, at)
        lines = data[at:end].decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def unzip(data: bytes) -> bytes:
    """All members of a gzip file, or the bytes themselves; a member for each record is usual."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts, at, view = [], 0, memoryview(data)
    member = zlib.decompressobj(31)
    while at < len(data):
        # what lies behind a member's end comes back, so no more than a piece is handed over
        piece = view[at : at + _INFLATE]
        parts.append(member.decompress(piece))
        at += len(piece) - len(member.unused_data)
        if member.eof:
            if data[at : at + 2] != b"\x1f\x8b":
                break
            member = zlib.decompressobj(31)
    return b"".join(parts)


_HEADERS = ["warc-record-id", "warc-target-uri", "warc-type", "warc-refers-to", "warc-payload-digest", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length"]
_RAW = T.StructType([*[T.StructField(h.replace("-", "_"), T.StringType()) for h in _HEADERS], T.StructField("block", T.BinaryType())])


def records(spark: SparkSession, path: str, *, segmented: bool | None = None) -> DataFrame:
    """All records of an archive, or those that are (or are no) segments, with their headers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in _RAW]
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:-1]], pa.array(columns[-1], pa.binary())], names=_RAW.names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in parse(unzip(batch.column(0)[k].as_py())):
                    if segmented is None or segmented == ("warc-segment-number" in headers):
                        rows.append((*[headers.get(h) for h in _HEADERS], block))
                        size += len(block)
                        if size >= _BATCH_BYTES:
                            yield flushed(rows)
                            rows, size = [], 0
                yield flushed(rows)

    return files.mapInArrow(run, _RAW)


def reassembled(segments: DataFrame) -> DataFrame:
    """One row for each origin, its blocks joined by number; `whole` tells whether the segments
    are 1 to n without gap and have the total length that the last of them states."""
    origin = F.coalesce("warc_segment_origin_id", "warc_record_id")
    number = F.col("warc_segment_number").cast("int")
    head = [F.max(F.when(number == 1, F.col(c))).alias(c) for c in _RAW.names[1:5]]
    parts = F.array_sort(F.collect_list(F.struct(number.alias("number"), "block")))
    grouped = segments.groupBy(origin.alias("warc_record_id")).agg(*head, F.max(F.col("warc_segment_total_length").cast("long")).alias("total"), parts.alias("parts"))
    # joined as texts, whose bytes stay as they are: one copy, where concatenation in turn makes many
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    right = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    grouped = grouped.withColumn("block", block).withColumn("whole", right & (F.col("total") == F.octet_length("block")))
    return grouped.select(*_RAW.names[:5], "block", F.coalesce("whole", F.lit(False)).alias("whole"))


_PAGE = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("valid", T.BooleanType()),
    T.StructField("record_id", T.StringType()), T.StructField("refers_id", T.StringType()),
])
#: What a revisit states of its response.
_STATED = ["refers_id", "payload_bytes", "payload_digest"]


def _page(record_id, uri, kind, refers_to, stated, block, whole) -> tuple:
    """A row of _PAGE and the payload (None of a revisit)."""
    key_of = lambda x: None if x is None or (k := x[1:-1].split(":")[2]) == "null" else k
    stated = (stated or "").removeprefix("sha256:")
    head, _, body = block.partition(_END)
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode("latin-1").split("\r\n")[1:])}
    if kind == "revisit":
        size = headers.get("content-length", "")
        return key_of(record_id), uri, kind, key_of(refers_to), int(size) if size.isdigit() else None, stated, bool(size.isdigit() and whole), record_id, refers_to or "", None
    payload = dechunk(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body
    if payload is None:
        return key_of(record_id), uri, kind, None, None, None, False, record_id, None, None
    digest = hashlib.sha256(payload).hexdigest()
    return key_of(record_id), uri, kind, None, len(payload), digest, bool(whole and digest == stated), record_id, None, payload


def _pages(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """The pages of an archive, each checked for itself."""
    schema = T.StructType([*_PAGE.fields, *([T.StructField("payload", T.BinaryType())] if payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.binary()][: len(schema)]
        for batch in batches:
            rows = [_page(*(batch.column(c)[i].as_py() for c in range(7)))[: len(schema)] for i in range(batch.num_rows)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    single = records(spark, path, segmented=False).select(*_RAW.names[:5], "block", F.lit(True).alias("whole"))
    return single.unionByName(reassembled(records(spark, path, segmented=True))).mapInArrow(run, schema)


def read(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """A row for each page of an archive: key (text), uri, record_type, refers_to, payload_bytes,
    payload_digest, valid and, if asked for, payload (binary; null of a revisit)."""
    used: list[str] = []
    found = stored(_pages(spark, path, False), "warc-pages", into=used)
    sound = found.where("record_type = 'response' AND valid").select(F.col("record_id").alias("refers_id"), *_STATED[1:])
    # what revisits state is few distinct rows, and hardly ever is any of it wrong
    stated = found.where("record_type = 'revisit' AND valid").select(_STATED).distinct()
    wrong = stored(stated.join(sound, _STATED, "left_anti"), "warc-wrong", into=used)
    none_wrong = wrong.isEmpty()
    if payload:
        discard(spark, used[:1])
        found = _pages(spark, path, True)
    names = [c for c in found.columns if c not in ("record_id", "refers_id")]
    if none_wrong:
        discard(spark, used[1:])
        return found.select(names)
    marked = found.join(wrong.withColumn("wrong", F.lit(True)), _STATED, "left")
    return marked.withColumn("valid", F.col("valid") & F.col("wrong").isNull()).select(names)
