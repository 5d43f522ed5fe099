"""Embedding near-duplicates with a pivot-permutation index.

Every vector is described by the ordered list of its ``nearest`` reference
points (pivots).  Near vectors share many of them, so inverted lists over
pivot triples retrieve the pairs that share at least three; a pair is taken
up in the list of its three lowest shared pivots only, its shared pivots are
counted there, and the exact cosine (double precision) decides.

Pivots come from a bounded sample (``sample`` vectors with the smallest id
hashes), from which only vectors that lie apart are chosen, so that a hot
cluster does not fill the list; seeded random directions make up the number.
All vectors are indexed.  Equal vectors form a class first, a list above the
block size is split into chunk pairs, and pairs never become rows.

The number of pivots grows with the number of vectors (``pivot_count``), so
that the chance meetings per vector stay about the same, and the length of the
lists with the number of pivots (``nearest_count``), so that recall does.

Defined cases: vectors that are null, empty or zero or hold a null or
non-finite component link with nothing; vectors link only with vectors of
their own length; a null id is ordered after all others and comes back as
null; repeated rows are copies of each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, buckets, components, forest, groups, rid, stage, unrid

CHUNK = 1024  # classes in a chunk of a split list
BLOCK = ["bucket", "lo", "hi"]


def pivot_count(vectors: int) -> int:
    """1024 up to 100,000 vectors, doubled for each factor of eight."""
    return 1024 << max(0, math.ceil(math.log(max(vectors, 1) / 100_000, 8)))


def nearest_count(pivots: int) -> int:
    """8 up to 1024 pivots, one more for each factor of four begun: among more
    pivots near vectors share fewer of a list of the same length.  Recall at
    cosine 0.95 in 64 dimensions, simulated with random pivots: 0.99 at 1024,
    0.994 at 2048, 0.984 at 4096, 0.993 at 8192, 0.989 at 16,384, 0.99 at
    32,768, 0.988 at 65,536."""
    return 8 + max(0, math.ceil(math.log2(pivots / 1024) / 2))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (rows must be finite and not zero)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spread(sample: np.ndarray, count: int, apart: float = 0.5, seed: int = 8) -> np.ndarray:
    """``count`` unit pivots: sample rows whose cosine to all chosen ones is
    below ``apart``, then seeded random directions."""
    width = sample.shape[1]
    chosen = np.zeros((count, width))
    n = 0
    for row in unit(sample) if len(sample) else sample:
        if n == count:
            break
        if not n or (chosen[:n] @ row).max() < apart:
            chosen[n] = row
            n += 1
    if n < count:
        chosen[n:] = unit(np.random.default_rng(seed).normal(size=(count - n, width)))
    return chosen


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, start and length of each usable vector (length 0: none)."""
    values = column.flatten()
    # flatten() leaves null lists out
    lengths = np.where(column.is_valid(), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)), 0)
    lengths = lengths.astype(np.int64)
    starts = np.append(0, np.cumsum(lengths))[:-1]
    v = values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(owner[~np.isfinite(v)], minlength=len(lengths)) > 0
    zero = np.bincount(owner, weights=v != 0, minlength=len(lengths)) == 0
    return v, starts, np.where(bad | zero, 0, lengths)


def describer(pivots: np.ndarray, nearest: int):
    """(rid, vector) batches -> digest, vector, ascending nearest pivots, and
    their order (nearest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        pos = part << 40
        for batch in batches:
            v, starts, lengths = rows_of(batch.column(1))
            n = batch.num_rows
            near: list = [None] * n
            raw: list = [None] * n
            for width in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == width)
                x = v[starts[at][:, None] + np.arange(width)]
                p = np.zeros((len(pivots), width))
                p[:, : pivots.shape[1]] = pivots[:, :width]
                norm = np.sqrt((p * p).sum(1, keepdims=True))
                order = np.argsort(-(unit(x) @ (p / np.where(norm > 0, norm, 1)).T), axis=1, kind="stable")[:, :nearest]
                for k, row in enumerate(at):
                    near[row] = order[k]
                    raw[row] = x[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.arange(pos, pos + n)),
                    pa.array([None if r is None else hashlib.sha256(r).digest()[:16] for r in raw], pa.binary()),
                    pa.array(raw, pa.binary()),
                    pa.array(near, pa.list_(pa.int64())),
                ],
                names=["rid", "pos", "key", "vec", "near"],
            )
            pos += n

    return run


def lister(count: int, shared: int):
    """Inverted lists: each class under every set of ``shared`` of its
    pivots (a number made of the vector length and the pivots, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            p = np.sort(near.flatten().to_numpy().reshape(batch.num_rows, -1), axis=1)
            sets = np.array(list(itertools.combinations(range(p.shape[1]), shared)))
            key = np.repeat(batch.column("width").to_numpy()[:, None], len(sets), 1)
            for c in range(shared):
                key = key * count + p[:, sets[:, c]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), len(sets)))],
                names=["key", "id"],
            )

    return run


def linker(count: int, shared: int, cosine: float):
    """Sorted block rows in; per linked class its links (copies counted) and
    its root in the block out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, BLOCK):
            ids, mult, bucket = (t.column(c).to_numpy() for c in ("id", "mult", "bucket"))
            chunk = t.column("chunk").to_numpy()
            cross = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            near = t.column("near").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            vec = t.column("vec")
            out: list[list] = [[], [], []]
            for a, e in zip(at[:-1], at[1:]):
                key, listed = int(bucket[a]), []
                for _ in range(shared):
                    key, p = divmod(key, count)
                    listed.append(p)
                n = e - a
                # shared pivots below the list's highest: only its own, or the pair belongs to another list
                low, where = np.unique(near[a:e], return_inverse=True)
                has = np.zeros((n, len(low)), np.float32)
                has[np.repeat(np.arange(n), near.shape[1]), where.ravel()] = 1
                has = has[:, low <= max(listed)]
                mask = np.triu(has @ has.T == shared, 1)
                if cross[a]:
                    mask &= chunk[a:e][:, None] != chunk[a:e][None, :]
                i, j = np.nonzero(mask)
                if not len(i):
                    continue
                x = unit(np.stack([np.frombuffer(vec[r].as_buffer(), np.float64) for r in range(a, e)]))
                if len(i) > n * 8:
                    linked = (x @ x.T)[i, j] >= cosine
                else:
                    linked = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                i, j = i[linked], j[linked]
                if not len(i):
                    continue
                m = mult[a:e]
                links = np.bincount(i, m[j], n) + np.bincount(j, m[i], n)
                root = forest(n, i, j)
                some = np.flatnonzero(links)
                out[0].append(ids[a:e][some])
                out[1].append(links[some].astype(np.int64))
                out[2].append(ids[a:e][root[some]])
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in out], names=["id", "links", "root"]
                )

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.95,
    pivots: int | None = None,
    nearest: int | None = None,
    shared: int = 3,
    sample: int = 8192,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id
    reachable by links), kept."""
    rows = vectors.select(rid(id_col).alias("rid"), F.col(vector_col).cast("array<double>").alias("v"))
    count = pivots or pivot_count(rows.count())
    nearest = nearest or nearest_count(count)
    sampled = rows.where("size(v) > 0").orderBy(F.xxhash64("rid"), "rid").limit(sample).select("v").toArrow()
    width, usable = 1, []
    for column in sampled.column("v").chunks:
        v, starts, lengths = rows_of(column)
        usable += [v[s : s + n] for s, n in zip(starts, lengths) if n]
    if usable:
        width = max(map(len, usable))
    points = spread(np.array([u for u in usable if len(u) == width]).reshape(-1, width), count)

    described = stage(
        rows.mapInArrow(describer(points, nearest), "rid long, pos long, key binary, vec binary, near array<long>"),
        "described",
    )
    classes = stage(
        described.where("key is not null")
        .groupBy("key")
        .agg(
            F.min(F.struct("rid", "pos")).alias("r"),
            F.count("*").alias("mult"),
            F.first("vec").alias("vec"),
            F.first("near").alias("near"),
        )
        .select("key", F.col("r.pos").alias("id"), F.col("r.rid").alias("rid"), "mult", "vec", "near"),
        "classes",
    )
    lists = classes.select("id", "near", (F.octet_length("vec") / 8).cast("long").alias("width")).mapInArrow(
        lister(count, shared), "key long, id long"
    )
    met = buckets(lists.withColumn("weight", F.lit(1))).drop("weight")
    linked = stage(
        blocks(met, chunk)
        .join(classes.select("id", "mult", "vec", "near"), "id")
        .withColumnRenamed("key", "bucket")
        .repartition(*BLOCK)
        .sortWithinPartitions(*BLOCK)
        .mapInArrow(linker(count, shared, cosine), "id long, links long, root long"),
        "linked",
    )
    roots = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    known = (
        classes.select("id", "rid", "key", "mult")
        .join(links, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    firsts = known.groupBy("root").agg(F.min("rid").alias("first"))
    known = known.join(firsts, "root").select(
        "key", "first", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return described.select("rid", "key").join(stage(known, "known"), "key", "left").select(
        unrid("rid").alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        unrid(F.coalesce("first", "rid")).alias("component_id"),
        (F.coalesce("first", "rid") == F.col("rid")).alias("kept"),
    )
