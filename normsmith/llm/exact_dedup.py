"""Exact deduplication with an extendible-hash index on shared files.

Two texts are equal when they are identical after replacing each run of
ASCII white space by one space.  The 64-bit key of a text is the head of its
SHA-256.  The index lives in the shared checkpoint folder: bucket files hold
the distinct texts of a key range, a directory maps key prefixes to buckets,
and a bucket above its capacity is split by one more key bit, doubling the
directory when the bucket was as deep as it.  Only the directory (one entry
per bucket) is on the driver.

1. Each task combines equal texts by their bytes, so copies travel once per
   task however many there are, and writes one small member row per document.
2. Entries go to the owner of their key range, which writes its bucket file.
3. Overfull buckets are split until they fit (a single text never splits).
4. Each owner task reads whole bucket files, chains entries of equal key and
   compares their bytes; it returns one row per distinct text.
5. Members join these rows on the digest, a plain equi-join in which Spark
   splits a hot key.

Defined cases: a null text is the empty text; a null id is ordered after all
others and comes back as null; of rows that repeat both id and text exactly
one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, delete, exists, keyed, shared_folder, stage, unrid

# Distinct texts that a task holds before it passes them on.
HELD_BYTES = 32 << 20
# Text bytes of a bucket above which it is split.
CAPACITY = 32 << 20

COLUMNS = "key long, sha binary, rid long, pos long, n long, size long, body binary"
ARROW = pa.schema(
    [("kind", pa.string())]
    + [(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in COLUMNS.split(", ")]
)


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space (ends included)."""
    words = text.split()
    if not words:
        return b" " if text else b""
    head = b" " if text[0] in WS else b""
    tail = b" " if text[-1] in WS else b""
    return head + b" ".join(words) + tail


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member rows for all documents; one entry row per distinct text of the
    task (texts are compared by their bytes, as keys of a dict)."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    pos = part << 40
    held: dict[bytes, list] = {}
    size = 0

    def entries():
        shas = [e[0] for e in held.values()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["entry"] * len(held)),
                pa.array([signed(int.from_bytes(s[:8], "big")) for s in shas], pa.int64()),
                pa.array(shas, pa.binary()),
                pa.array([e[1] for e in held.values()], pa.int64()),
                pa.array([e[2] for e in held.values()], pa.int64()),
                pa.array([e[3] for e in held.values()], pa.int64()),
                pa.array([len(b) for b in held], pa.int64()),
                pa.array(list(held), pa.binary()),
            ],
            schema=ARROW,
        )

    for batch in batches:
        rids = batch.column(0).to_pylist()
        shas, at = [], []
        for rid, text in zip(rids, batch.column(1).cast(pa.binary())):
            body = normalise(text.as_py())
            e = held.get(body)
            if e is None:
                if size + len(body) > HELD_BYTES and held:
                    yield entries()
                    held, size = {}, 0
                e = held[body] = [hashlib.sha256(body).digest(), rid, pos, 0]
                size += len(body)
            elif (rid, pos) < (e[1], e[2]):
                e[1], e[2] = rid, pos
            e[3] += 1
            shas.append(e[0])
            at.append(pos)
            pos += 1
        none = [None] * len(rids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["member"] * len(rids)),
                pa.array([signed(int.from_bytes(s[:8], "big")) for s in shas], pa.int64()),
                pa.array(shas, pa.binary()),
                pa.array(rids, pa.int64()),
                pa.array(at, pa.int64()),
                pa.array([1] * len(rids), pa.int64()),
                pa.array(none, pa.int64()),
                pa.array(none, pa.binary()),
            ],
            schema=ARROW,
        )
    if held:
        yield entries()


class Directory:
    """Extendible-hash directory: the first ``depth`` bits of a key select a
    bucket.  A bucket is (its own depth, its own prefix); ``leaves`` holds
    the buckets, which stand for 2**(depth - own depth) slots each."""

    def __init__(self, depth: int):
        self.depth = depth
        self.leaves = {(depth, p) for p in range(1 << depth)}

    def split(self, bucket: tuple[int, int]) -> list[tuple[int, int]]:
        """Replace a bucket by its halves; the directory doubles when the
        bucket was as deep as the directory."""
        local, prefix = bucket
        halves = [(local + 1, prefix << 1), (local + 1, prefix << 1 | 1)]
        self.leaves.remove(bucket)
        self.leaves.update(halves)
        self.depth = max(self.depth, local + 1)
        return halves


def code(bucket: tuple[int, int]) -> int:
    """A bucket as one number: its prefix behind a leading one."""
    return 1 << bucket[0] | bucket[1]


def decode(number: int) -> tuple[int, int]:
    local = number.bit_length() - 1
    return local, number ^ (1 << local)


def head_bits(bits: int):
    """The first ``bits`` bits of the key as a number (0 bits: one bucket)."""
    return F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole bucket files in, one row per distinct text out.  Entries of
    equal key form a chain, in which bytes decide."""
    for batch in batches:
        for content in batch.column(0):
            bucket = pq.read_table(pa.BufferReader(content.as_buffer()))
            chains: dict[int, list[list]] = {}
            cols = [bucket.column(c).to_pylist() for c in ("key", "rid", "pos", "n")]
            bodies, shas = bucket.column("body"), bucket.column("sha")
            for i, (key, rid, pos, n) in enumerate(zip(*cols)):
                chain = chains.setdefault(key, [])
                body = bodies[i]
                for e in chain:
                    if e[0].equals(body):
                        e[2] += n
                        if (rid, pos) < e[1]:
                            e[1] = (rid, pos)
                        break
                else:
                    chain.append([body, (rid, pos), n, shas[i].as_py()])
            found = [e for chain in chains.values() for e in chain]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([e[3] for e in found], pa.binary()),
                    pa.array([e[1][0] for e in found], pa.int64()),
                    pa.array([e[1][1] for e in found], pa.int64()),
                    pa.array([e[2] for e in found], pa.int64()),
                ],
                names=["sha", "keep_rid", "keep_pos", "group_size"],
            )


def _write(entries: DataFrame, owner, path: str, parts: int) -> None:
    """Deal rows to their owners; each owner writes one file per bucket."""
    (
        entries.repartitionById(parts, owner)
        .sortWithinPartitions("kind", "bucket", "key")
        .write.option("compression", "zstd")
        .partitionBy("kind", "bucket")
        .parquet(path)
    )


def build_index(
    rows: DataFrame, folder: str, depth: int | None = None, capacity: int = CAPACITY, look: int = 8
) -> tuple[DataFrame, DataFrame, Directory]:
    """Write the index of (rid, text) rows below ``folder``.

    Returns the member rows, the bucket files (one row per file: bucket,
    content) and the directory.  ``depth`` is the directory's first depth
    (default: about two buckets per shuffle partition); a bucket of more than
    ``capacity`` text bytes is split.  The loads of overfull buckets, ``look``
    bits below the directory, are partial sums: the driver sees only those,
    and each overfull bucket is rewritten once per ``look`` levels.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    depth = (2 * parts - 1).bit_length() if depth is None else depth
    is_entry = F.col("kind") == "entry"
    _write(
        rows.mapInArrow(_combine, "kind string, " + COLUMNS).withColumn(
            "bucket", F.when(is_entry, head_bits(depth) + F.lit(1 << depth)).otherwise(F.lit(0))
        ),
        # an entry goes to the owner of its key range, a member row anywhere
        F.when(is_entry, F.floor(head_bits(depth) * parts / F.lit(1 << depth)))
        .otherwise(F.pmod(F.col("pos"), F.lit(parts)))
        .cast("int"),
        f"{folder}/level0",
        parts,
    )
    directory, level = Directory(depth), 0
    schema = COLUMNS + ", kind string, bucket long"

    def read(k: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/level{k}")

    members = read(0).where("kind = 'member'").select("sha", "rid", "pos")
    kept_files = []
    while True:
        entries, at = read(level).where("kind = 'entry'"), min(64, directory.depth + look)
        full = (
            entries.groupBy("bucket")
            .agg(F.sum("size").alias("t"), F.min("key").alias("k0"), F.max("key").alias("k1"))
            .where((F.col("t") > capacity) & (F.col("k0") < F.col("k1")))
            .select("bucket")
        )
        fine = (
            entries.join(full, "bucket")
            .groupBy("bucket", head_bits(at).alias("p"))
            .agg(F.sum("size"), F.min("key") == F.max("key"))
            .collect()
        )
        moved = sorted({r[0] for r in fine})
        where = f"{folder}/level{level}/kind=entry"
        if not exists(spark, where):  # an empty table has no bucket
            kept_files.append(spark.createDataFrame([], "bucket long, content binary"))
            break
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(where)
        kept_files.append(files.where(~F.col("bucket").isin(moved)) if moved else files)
        if not moved:
            break
        # split in the directory until every half fits, look bits down at most
        assign = []
        for b in moved:
            todo = [(decode(b), [r for r in fine if r[0] == b])]
            while todo:
                bucket, subs = todo.pop()
                alone = len(subs) <= 1 and (not subs or subs[0][3] or bucket[0] >= at)
                if alone or bucket[0] >= at or (sum(r[2] for r in subs) <= capacity and bucket != decode(b)):
                    assign += [(r[1], code(bucket)) for r in subs]
                    continue
                for half in directory.split(bucket):
                    todo.append((half, [r for r in subs if r[1] >> (at - half[0]) == half[1]]))
        level += 1
        to = spark.createDataFrame([(p, c, i % parts) for i, (p, c) in enumerate(assign)], "p long, new long, owner int")
        owners = to.groupBy("new").agg(F.min("owner").alias("owner"))
        _write(
            entries.where(F.col("bucket").isin(moved))
            .withColumn("p", head_bits(at))
            .join(to.drop("owner").join(owners, "new"), "p")
            .withColumn("bucket", F.col("new"))
            .drop("p", "new")
            .select("owner", *[c.split()[0] for c in schema.split(", ")]),
            F.col("owner"),
            f"{folder}/level{level}",
            parts,
        )
    found = kept_files[0]
    for f in kept_files[1:]:
        found = found.unionByName(f)
    return members, found.select("bucket", "content"), directory


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per document: doc_id, keep_id (smallest id of its equal
    texts), group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    members, files, _ = build_index(keyed(docs, id_col, text_col), folder, depth, capacity)
    groups = stage(
        files.select("content").mapInArrow(_chain, "sha binary, keep_rid long, keep_pos long, group_size long"), "groups"
    )
    for level in range(64):  # the texts are compared: only member rows are read from here on
        if not delete(spark, f"{folder}/level{level}/kind=entry"):
            break
    return members.join(groups, "sha").select(
        unrid("rid").alias("doc_id"),
        unrid("keep_rid").alias("keep_id"),
        "group_size",
        ((F.col("rid") == F.col("keep_rid")) & (F.col("pos") == F.col("keep_pos"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
