"""WARC archives: writing pages with revisit records and segmentation, and
reading archives back with segment reassembly.

Writing.  Of pages with equal payloads of at least ``least`` bytes the one
with the smallest id becomes a response, the others revisit it; smaller pages
are all responses.  The payload travels as an HTTP message in chunked
transfer framing.  A block above ``segment`` bytes is split: the first part
in the response record, the rest in continuation records that name the origin
record and their number, the last one the total length.  A task rolls over
to a new archive after ``archive`` bytes.  Spark's text writer stores the
archives, gzipped (a record ends with two line ends, which is the row separator), so
they work on any store and a lost task leaves nothing behind.

Reading.  Whole archives are parsed per task; segments of a record are
grouped by the origin's identifier, ordered by number, joined and checked
against the total length, then the framing is decoded and the payload
checked against its digest.  Revisits find their response by its identifier.

Defined cases: a null html is the empty payload; a null url or id is a field
left out (a null id is ordered after all others); rows that repeat id and
payload are repeated records, each of which is returned; an empty table gives
no archive and an empty result; other columns are ignored; damaged archives
raise ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, delete, exists, rid, shared_folder, small_batches, stage, unrid

END = b"\r\n\r\n"
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


# ------------------------------------------------------------------- framing
def chunked(payload: bytes, size: int = 8192) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0" + END])


def unchunked(data: bytes) -> bytes:
    parts, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body ends early")
        size = int(data[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk length does not match")
        parts.append(data[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


# ------------------------------------------------------------------- writing
def record_id(page: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page} {digest}'.encode()).digest()[:16])}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION]
    for name, value in [*fields, ("Content-Length", len(block))]:
        if value is not None:
            text = str(value).replace("\r", "%0D").replace("\n", "%0A")
            lines.append(f"{name}: {text}".encode("utf-8", "surrogatepass"))
    return b"\r\n".join(lines) + END + block


def page_records(page: int, url: str | None, digest: str, first: int, payload: bytes, segment: int) -> list[bytes]:
    own = record_id(page, digest)
    fields = [
        ("WARC-Record-ID", own),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", None if page == NULL_ID else page),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if first != page:
        refers = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest))]
        return [record(refers + fields, HTTP)]
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), *fields], block)]
    out = [record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], block[:segment])]
    for number, at in enumerate(range(segment, len(block), segment), 2):
        total = len(block) if at + segment >= len(block) else None
        mine = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}/{number}')}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", total),
        ]
        out.append(record(mine, block[at : at + segment]))
    return out


def writer(segment: int, archive: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        number, size = 0, 0
        for batch in batches:
            payloads = batch.column("payload").cast(pa.binary())
            at = 0
            while at < batch.num_rows:
                names, values, held = [], [], 0
                while at < batch.num_rows and held < archive:
                    row = {c: batch.column(c)[at].as_py() for c in ("page", "url", "digest", "first")}
                    for r in page_records(**row, payload=payloads[at].as_py(), segment=segment):
                        if size and size + len(r) > archive:
                            number, size = number + 1, 0
                        size += len(r)
                        held += len(r)
                        names.append(f"{part:06d}-{number:05d}")
                        values.append(r)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, pa.binary()), pa.array(names)], names=["value", "archive"]
                )

    return run


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 100,
    segment: int = 32 << 10,
    archive: int = 32 << 20,
) -> None:
    """Write the archives of a pages table below ``folder``."""
    small_batches(pages.sparkSession)
    rows = pages.select(
        rid(id_col).alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # only digests that occur more than once can have revisits
    firsts = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    (
        rows.join(firsts, "digest", "left")
        .withColumn("first", F.coalesce("first", "page"))
        .mapInArrow(writer(segment, archive), "value binary, archive string")
        .withColumn("value", F.col("value").cast("string"))  # the bytes as they are
        .write.partitionBy("archive")
        .option("lineSep", END.decode())
        .option("compression", "gzip")
        .text(folder)
    )


# ------------------------------------------------------------------- reading
def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of the records of an archive."""
    at = 0
    while at < len(data):
        head = data.find(END, at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:head].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.lower()] = value.strip()
        start = head + len(END)
        at = start + int(fields["content-length"])
        if data[at : at + len(END)] != END:
            raise ValueError("record length does not match")
        yield fields, data[start:at]
        at += len(END)


RECORD = pa.schema(
    [
        ("record", pa.string()),
        ("page", pa.int64()),
        ("url", pa.string()),
        ("type", pa.string()),
        ("refers", pa.string()),
        ("digest", pa.string()),
        ("bytes", pa.int64()),
        ("origin", pa.string()),
        ("segment", pa.int64()),
        ("total", pa.int64()),
        ("block", pa.binary()),
    ]
)
RECORD_DDL = (
    "record string, page long, url string, type string, refers string, digest string, bytes long, "
    "origin string, segment long, total long, block binary"
)


def checked(payload: bytes, digest: str) -> int:
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload does not match its digest")
    return len(payload)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives in, records out; segments keep their part of the block."""
    for batch in batches:
        for content in batch.column(0):
            rows, data = [], content.as_py()
            if data.startswith(b"\x1f\x8b"):
                data = gzip.decompress(data)
            for f, block in parse(data):
                number = f.get("warc-segment-number")
                own = f["warc-record-id"]
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                whole = number is None and f["warc-type"] == "response"
                rows.append(
                    (
                        own,
                        int(f["x-page-id"]) if "x-page-id" in f else NULL_ID,
                        f.get("warc-target-uri"),
                        f["warc-type"],
                        f.get("warc-refers-to"),
                        digest,
                        checked(http_payload(block), digest) if whole else None,
                        f.get("warc-segment-origin-id", own) if number else None,
                        int(number) if number else None,
                        int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                        block if number else None,
                    )
                )
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(RECORD.names, r)) for r in rows[at : at + 256]], schema=RECORD
                )


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(origin fields, parts) rows: order, join, check the total, decode."""
    for batch in batches:
        sizes = []
        for digest, parts in zip(batch.column("digest").to_pylist(), batch.column("parts")):
            parts = sorted(parts.as_py(), key=lambda p: p["segment"])
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                raise ValueError("a segment is missing")
            block = b"".join([p["block"] for p in parts])
            if parts[-1]["total"] != len(block):
                raise ValueError("segments do not add up to the total length")
            sizes.append(checked(http_payload(block), digest))
        columns = [batch.column(c) for c in ("record", "page", "url", "type", "digest", "copies")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sizes, pa.int64())], names=["record", "page", "url", "type", "digest", "copies", "bytes"]
        )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit record of the archives below
    ``folder``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to (page_id of the response), and the record's identifier."""
    if exists(spark, folder) and exists(spark, f"{folder}/_SUCCESS") and _archives(spark, folder):
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "part-*")
            .load(folder)
            .select("content")
        )
        records = stage(files.mapInArrow(_read, RECORD_DDL), "records")
    else:
        records = spark.createDataFrame([], RECORD_DDL)
    columns = ["record", "page", "url", "type", "refers", "digest", "bytes"]
    whole = records.where("origin is null").select(*columns)
    # the segments of one record; a repeated record repeats all its segments
    parts = records.where("origin is not null").groupBy("origin", "segment").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("page", "url", "type", "digest", "total", "block")]
    )
    first = F.col("segment") == 1
    joined = (
        parts.groupBy("origin")
        .agg(
            *[F.max(F.when(first, F.col(c))).alias(c) for c in ("page", "url", "type", "digest", "copies")],
            F.collect_list(F.struct("segment", "total", "block")).alias("parts"),
        )
        .withColumnRenamed("origin", "record")
        .mapInArrow(
            _reassemble, "record string, page long, url string, type string, digest string, copies long, bytes long"
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .withColumn("refers", F.lit(None).cast("string"))
        .select(*columns)
    )
    found = stage(whole.unionByName(joined), "found")
    responses = (
        found.where("type = 'response'")
        .groupBy(F.col("record").alias("refers"))
        .agg(F.min("page").alias("to"), F.min("bytes").alias("there"))
    )
    return found.join(responses, "refers", "left").select(
        unrid("page").alias("page_id"),
        "url",
        F.coalesce("bytes", "there").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        unrid("to").alias("refers_to"),
        F.col("record").alias("record_id"),
    )


def _archives(spark: SparkSession, folder: str) -> bool:
    """Whether the folder holds any archive."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return any(f.isDirectory() for f in files)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archives of a pages table to the shared folder, read them
    back and delete them."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc"
    write_warc(pages, folder, **options)
    out = read_warc(spark, folder)
    delete(spark, folder)
    return out
