"""WARC archives: writing records in segments, reading them back and joining the segments.

A record whose block is longer than a segment is written as a first record and continuation
records. Payloads sit in HTTP responses with chunked transfer coding. Of the records with equal
payloads one is a response and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm.common import new_folder, staged

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
ARCHIVE_BYTES = 8 << 20
READ_BYTES = 16 * 1024
MIN_REVISIT_BYTES = 0
DATE = "2020-01-01T00:00:00Z"

RECORDS = (
    "record_id string, origin_id string, segment int, total bigint, type string, url string, page_id bigint, "
    "digest string, refers_id string, refers_to bigint, block binary"
)


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest, and the record that each row becomes.

    Of equal payloads of at least ``min_bytes``, a row with the largest page_id is the response
    (null ids come last; of repeated rows one), the others are revisits of it. ``single`` says
    that the row is the one response of its payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    # Payloads that occur again need to know of each other; the payloads themselves stay out.
    known = rows.where(F.length("payload") >= min_bytes).groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    again = known.groupBy("sha").agg(
        F.max("page_id").alias("lead_page"), F.sum("n").alias("n"),
        F.max_by("n", F.coalesce("page_id", F.lit(-(2**63)))).alias("n_lead"),
    ).where("n > 1")
    # Written first, so that Spark knows its size: while it is small no payload is shuffled for it.
    again = staged(again, "repeated-payloads")
    leads = F.col("n").isNotNull() & F.col("page_id").eqNullSafe(F.col("lead_page"))
    marked = rows.join(again, "sha", "left").withColumn("leads", leads)
    columns = ["page_id", "url", "sha", "payload", "lead_page", "revisit", "single"]
    single = (F.length("payload") >= min_bytes) & (F.col("n").isNull() | F.col("leads"))
    plain = marked.where(~F.col("leads") | (F.col("n_lead") == 1)).select(
        "*", (F.col("n").isNotNull() & ~F.col("leads")).alias("revisit"), single.alias("single")
    )
    # Rows repeated with the leading id: equal rows meet as one row and a count, and one is the response.
    tied = rows.join(again.where("n_lead > 1"), "sha").where(leads).groupBy("sha", "page_id", "url", "lead_page").agg(
        F.first("payload").alias("payload"), F.count("*").alias("copies")
    )
    order = Window.partitionBy("sha").orderBy("url")
    spread = tied.withColumn("rank", F.row_number().over(order)).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    )
    first = (F.col("rank") == 1) & (F.col("copy") == 1)
    return plain.select(columns).unionByName(
        spread.select("*", (~first).alias("revisit"), first.alias("single")).select(columns)
    )


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def _urn(namespace: uuid.UUID, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(namespace, name)}>"


def _records(row: dict, place: str, namespace: uuid.UUID, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: one, or a first segment and its continuations."""
    own = _urn(namespace, row["sha"] if row["single"] else place)
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["sha"])).decode()
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A") or None
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-Id", row["page_id"])]
    if row["revisit"]:
        yield _record([
            ("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared,
            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _urn(namespace, row["sha"])), ("X-Refers-To-Page-Id", row["lead_page"]),
            ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"),
        ], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(row["payload"], chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [
        ("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, ("WARC-Payload-Digest", digest),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if len(parts) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        yield _record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(namespace, f"{own}{k}")),
            ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k),
            ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None),
        ], part)


def _write(
    batches: Iterator[pa.RecordBatch], folder: str, namespace: uuid.UUID, segment: int, chunk: int, most: int
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
    names, sizes, held, size, number, seen = [], [], [], 0, 0, 0

    def close() -> None:
        nonlocal held, size, number
        name = f"part-{task:06d}-{attempt}-{number:05d}.warc.gz"
        with store.whole_file(folder, name) as out:
            for data in held:
                out.write(data)
        names.append(name)
        sizes.append(size)
        held, size, number = [], 0, number + 1

    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            seen += 1
            for data in _records(row, f"{task}-{seen}", namespace, segment, chunk):
                if size and size + len(data) > most:
                    close()
                held.append(data)
                size += len(data)
    if held:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])


def write_archives(
    pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES,
    most: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """Write ``pages`` to gzipped archives of about ``most`` bytes; returns their names and sizes.

    Segments of one record may lie in different archives. A repeated task writes files of its own; the
    result names those of the attempt that counted, and only they are the archives.
    """
    namespace = uuid.uuid5(uuid.NAMESPACE_URL, folder)
    rows = plan_records(pages, min_bytes)
    return staged(
        rows.mapInArrow(
            lambda batches: _write(batches, folder, namespace, segment, chunk, most), "file string, bytes bigint"
        ),
        "archive-names",
    )


def _parse(content: bytes) -> Iterator[dict]:
    view, at = memoryview(content), 0
    while at < len(view):  # one gzip member is one record
        member, parts = zlib.decompressobj(wbits=31), []
        while not member.eof and at < len(view):
            step = view[at : at + READ_BYTES]
            parts.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block = rest[: int(headers["content-length"])]
        number = lambda name: int(headers[name]) if name in headers else None
        yield {
            "record_id": headers["warc-record-id"],
            "origin_id": headers.get("warc-segment-origin-id", headers["warc-record-id"]),
            "segment": number("warc-segment-number"),
            "total": number("warc-segment-total-length"),
            "type": headers["warc-type"],
            "url": headers.get("warc-target-uri"),
            "page_id": number("x-page-id"),
            "digest": headers.get("warc-payload-digest"),
            "refers_id": headers.get("warc-refers-to"),
            "refers_to": number("x-refers-to-page-id"),
            "block": block,
        }


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORDS.split(", ")])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for record in _parse(content.as_py()):
                rows.append(record)
                size += len(record["block"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_schema())
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_schema())


def read_records(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Every record of the archives in ``folder``, segments still apart.

    ``names`` is the result of ``write_archives``: only the files that it names are read. Without it
    all archives of the folder are. Names reach the driver, as those of any files that Spark reads do.
    """
    paths = folder if names is None else [f"{folder}/{r.file}" for r in names.select("file").collect()]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(paths)
    return files.select("content").mapInArrow(_read, RECORDS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, wrong = [], [], []
        for cell, kind in zip(batch.column("block"), batch.column("type"), strict=True):
            size = digest = fault = None
            block = cell.as_py()
            if kind.as_py() == "response" and block is not None:
                head, _, body = block.partition(b"\r\n\r\n")
                try:
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    size = len(payload)
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                except ValueError as error:
                    fault = str(error)
            sizes.append(size)
            digests.append(digest)
            wrong.append(fault)
        kept = [batch.column(c) for c in ("record_id", "type", "url", "page_id", "digest", "refers_id", "refers_to", "fault")]
        faults = [a.as_py() or b for a, b in zip(kept.pop(), wrong, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(faults, pa.string())],
            names=["record_id", "type", "url", "page_id", "digest", "refers_id", "refers_to", "bytes", "found", "fault"],
        )


def join_segments(records: DataFrame) -> DataFrame:
    """One row per logical record with its whole ``block``; ``fault`` says why a block is missing.

    Continuations are grouped by their origin and ordered by segment number. The numbers must run
    from 1 without a gap or a repeat, and the bytes must add up to the stated total. Records in one
    piece are not moved. A group holds one record, so it is as large as one page.
    """
    single = records.where("segment is null").select("*", F.lit(None).cast("string").alias("fault"))
    first = F.filter("parts", lambda p: p["segment"] == 1)
    grouped = (
        records.where("segment is not null").groupBy("origin_id")
        .agg(F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
             *(F.max(c).alias(c) for c in ("url", "page_id", "digest", "refers_id", "refers_to")),
             F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"))
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    last = F.element_at("parts", -1)
    joined = grouped.select(
        "*", whole.alias("whole"), last["total"].alias("total"), F.size(first).alias("firsts"),
        (numbers == F.sequence(F.lit(1), F.size("parts"))).alias("ordered"),
    )
    fault = (
        F.when(F.col("firsts") != 1, "no first segment")
        .when(~F.col("ordered"), "segments missing or repeated")
        .when(F.col("total").isNull(), "last segment missing")
        .when(F.length("whole") != F.col("total"), "length differs from the stated total")
    )
    done = joined.select(
        F.col("origin_id").alias("record_id"), "origin_id", F.lit(None).cast("int").alias("segment"), "total",
        "type", "url", "page_id", "digest", "refers_id", "refers_to",
        F.when(fault.isNull(), F.col("whole")).alias("block"), fault.alias("fault"),
    )
    return single.unionByName(done)


def read_payloads(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``fault``.

    Bytes and digest are those of the full payload: of a response, of what was decoded; of a
    revisit, of the response that it refers to. A digest that differs from the record's own is a
    fault, and so is a revisit whose response is not there.
    """
    columns = "record_id string, type string, url string, page_id bigint, digest string, refers_id string, refers_to bigint, bytes bigint, found string, fault string"
    decoded = staged(join_segments(read_records(spark, folder, names)).mapInArrow(_digested, columns), "records")
    response = decoded.where("type = 'response'")
    targets = response.select(F.col("record_id").alias("refers_id"), F.col("bytes").alias("b"), F.col("found").alias("d"))
    named = F.regexp_replace("digest", "^sha1:", "")
    own = response.select(
        "page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
        F.coalesce("fault", F.when(named != F.col("found"), "digest differs")).alias("fault"),
    )
    again = decoded.where("type = 'revisit'").join(targets, "refers_id", "left").select(
        "page_id", "url", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), "refers_to",
        F.when(F.col("d").isNull(), "response missing").when(named != F.col("d"), "digest differs").alias("fault"),
    )
    return own.unionByName(again)


def archive_and_read(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` to archives in a new shared folder and read them back (``read_payloads``).

    Null html is an empty payload; null ids and urls stay null; repeated rows are records of their
    own; other columns are not read; an empty table gives no row.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    names = write_archives(pages, folder, min_bytes=min_bytes)
    if names.isEmpty():
        return spark.createDataFrame(
            [], "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
            "refers_to bigint, fault string",
        )
    return read_payloads(spark, folder, names)
