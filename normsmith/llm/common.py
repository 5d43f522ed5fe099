"""Helpers shared by the operators of this package.

* ``keyed``: (rid, text) rows with a defined id for null ids;
* ``stage`` / ``drop``: tables written to the shared checkpoint folder,
  which cut lineage and survive the loss of any executor;
* ``buckets`` / ``blocks``: a self-join on hash keys whose groups are split
  into chunk pairs, so that a hot key is spread over many tasks;
* ``groups``: complete groups out of a stream of sorted Arrow batches;
* ``components``: connected components by alternating stars.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, track

# Stands for a null id inside the operators: ordered after every real id.
NULL_ID = (1 << 63) - 1


def rid(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def unrid(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != NULL_ID, c)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python in batches of at most 8 MB, unless the session says
    otherwise: a task's memory then does not depend on how long texts are."""
    if spark.conf.get(BATCH_BYTES, None) in (None, "64MB", "67108864", "67108864b"):
        spark.conf.set(BATCH_BYTES, "8MB")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, text): only the two columns an operator needs, under its own
    names, so further columns of the input can not clash.  A null text is
    the empty text; a null id becomes ``NULL_ID``."""
    small_batches(df.sparkSession)
    return df.select(rid(id_col).alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


# ------------------------------------------------------------------ staging
def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder; a ``scratch`` block
    around the caller deletes it at its end."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/normsmith-{uuid.uuid4().hex}"
    track(path)
    return path


def stage(df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: later steps depend on the
    files, not on the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path  # for drop()
    return out


def drop(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    delete(staged.sparkSession, staged._staged_at)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of the shared store; False if there was none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ------------------------------------------------------- self-join on hashes
def buckets(keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (key, id, weight, ...) whose key holds at least two
    rows, with ``total`` = the key's summed weight.  Counting is a partial
    aggregate; the join back is a plain equi-join that Spark splits where a
    key is hot."""
    n = keys.groupBy("key").agg(F.count("*").alias("members"), F.sum("weight").alias("total")).where("members > 1")
    return keys.join(n.select("key", "total"), "key")


def blocks(members: DataFrame, budget: int) -> DataFrame:
    """Split each key into chunks of about ``budget`` weight and give every
    pair of chunks a block (key, lo, hi): each pair of members meets in
    exactly one block.  A key below the budget is one block."""
    chunks = F.ceil(F.col("total") / F.lit(budget)).cast("int")
    m = members.withColumn("chunk", F.pmod(F.xxhash64("id", "key"), chunks).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return m.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("other", "total")


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Complete groups from batches sorted by ``by``: yields a table and the
    start offsets (plus the end) of the groups in it.  The last group of a
    batch is held back until its end is seen."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for c in by:
            v = t.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        if held and all(held[-1].column(c)[0] == b.column(c)[b.num_rows - 1] for c in by):
            held.append(b)  # still the one group that is held
            continue
        t = pa.Table.from_batches([*held, b])
        at = cut(t)
        last = int(at[-2])
        if last:
            yield t.slice(0, last), at[:-1]
        held = t.slice(last).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, cut(t)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), root = the
    smallest id.  Alternating large-star / small-star rounds; each round is
    staged, hubs are pre-aggregated and their joins can be split.  Nodes
    without an edge to another node do not appear."""
    spark = edges.sparkSession

    def size_of(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # a > b in every round's edges
    cur = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = size_of(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stage(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = size_of(new)
        drop(cur)
        cur = new
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# -------------------------------------------------------------------- words
WS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words (runs without ASCII white space) of many texts: a code for each
    word, the distinct words by code, and the texts' offsets in the codes."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.append(0, np.cumsum(full))[offsets]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), offsets


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes (the same in every process) of all words, and offsets."""
    codes, words, offsets = split_words(texts)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)
    return hashes[codes], offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes (multiply and fold, with wrap-around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside each text, and their offsets.  A
    text of fewer words has one shingle of all its words, one without words
    has none."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out = np.append(0, np.cumsum(counts))
    start = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(out[-1])
    length = np.repeat(np.minimum(sizes, n), counts)
    acc = length.astype(np.uint64)
    for k in range(n):
        here = np.where(length > k, h[np.minimum(start + k, max(len(h) - 1, 0))], np.uint64(0)) if len(h) else acc
        acc = mix64(acc + here)
    return acc, out
