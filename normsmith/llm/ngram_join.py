"""N-gram Jaccard self-join: MinHash banding, then exact verification.

Documents are sets of word n-grams (words: runs without ASCII white space,
as written).  Bands and rows follow from the wanted recall at the threshold.

1. One pass over the texts gives each document its word-sequence digest and
   its band hashes.  Documents of equal words form a class (a partial
   aggregate, so copies never meet in one task) and only classes go on.
2. Band hashes are shuffled; a bucket above the block budget is split into
   chunk pairs.  A pair of classes belongs to its first common band, so that
   it is examined once.
3. Texts of classes that have such a pair are read again; their full n-gram
   sets travel to the blocks, where pairs are counted by bit sets and linked
   when the exact Jaccard similarity reaches the threshold.  A block returns
   one row per linked class: its number of links and its root in the block.
4. Link counts are summed; roots are joined into connected components.

No pair is ever a row of a table.  Defined cases: a text of fewer than n
words has one n-gram of all its words; a text without words (null, empty,
white space) links with nothing and is its own class; a null id is ordered
after all others and comes back as null; rows that repeat id and text are
copies of each other of which one is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, buckets, components, forest, groups, keyed, mix64, shingles, stage, unrid, word_hashes

# n-grams (plus ROW_COST per document) in a chunk of a split bucket.
BLOCK_BUDGET, ROW_COST = 256_000, 256


def choose_bands(threshold: float, recall: float, budget: int = 200) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which ``bands * rows``
    hashes within the budget reach the recall at the threshold."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(1, budget):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > budget:
            break
        best = (bands, rows)
    return best


def band_hashes(s: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each non-empty n-gram set (rows of the result)."""
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    rng = np.random.default_rng(20_011)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out
    work = np.empty_like(s)
    for b in range(bands):
        acc = np.full(len(full), np.uint64(b + 1))
        for k in range(b * rows, (b + 1) * rows):
            np.multiply(s, factors[k], out=work)
            np.add(work, shifts[k], out=work)
            acc = mix64(acc + np.minimum.reduceat(work, starts))
        out[:, b] = acc
    return out


def word_key(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.split())).digest()[:16]


def signer(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        pos = part << 40
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, 256)
                at += piece.num_rows
                texts = piece.column(1)
                s, offsets = shingles(*word_hashes(texts), n)
                held = np.diff(offsets)
                sig = band_hashes(s, offsets, bands, rows).view(np.int64)
                ends = np.append(0, np.cumsum(np.where(held > 0, bands, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(np.arange(pos, pos + len(held))),
                        pa.array([word_key(t.as_py()) for t in texts.cast(pa.binary())], pa.binary()),
                        pa.array(held),
                        pa.ListArray.from_arrays(ends, pa.array(sig.ravel())),
                        piece.column(2),
                    ],
                    names=["rid", "pos", "key", "n", "sig", "text_hash"],
                )
                pos += len(held)

    return run


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def fresh_pairs(sig: np.ndarray, band: int, chunk: np.ndarray, cross: bool) -> np.ndarray:
    """Upper-triangle mask of the block's pairs whose first common band is
    ``band``; between two chunks only pairs across them."""
    mask = np.triu(np.ones((len(sig), len(sig)), bool), 1)
    if cross:
        mask &= chunk[:, None] != chunk[None, :]
    for b in range(band):
        mask &= sig[:, b][:, None] != sig[:, b][None, :]
    return mask


BLOCK = ["bucket", "lo", "hi"]


def needer(bands: int):
    """Sorted block rows in; out those of classes with a pair of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, BLOCK):
            sig = matrix(t.column("sig"), bands)
            band, chunk = t.column("band").to_numpy(), t.column("chunk").to_numpy()
            cross = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            need = np.zeros(t.num_rows, bool)
            size = np.diff(at)
            two = at[:-1][size == 2]
            apart = ~cross[two] | (chunk[two] != chunk[two + 1])
            first = (sig[two] == sig[two + 1]).argmax(1)
            need[two] = need[two + 1] = apart & (first == band[two])
            for a, n in zip(at[:-1][size > 2], size[size > 2]):
                mask = fresh_pairs(sig[a : a + n], band[a], chunk[a : a + n], cross[a])
                need[a : a + n] = mask.any(0) | mask.any(1)
            yield from t.select(["id", "rid", "bucket", "band", "lo", "hi", "chunk"]).filter(pa.array(need)).to_batches()

    return run


def setter(n: int):
    """(text, key, class columns, blocks) rows: the n-gram set of each class,
    once for each of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, 64)
                at += piece.num_rows
                texts = piece.column("text")
                s, offsets = shingles(*word_hashes(texts), n)
                sets = [np.unique(s[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                same = [word_key(t.as_py()) == k for t, k in zip(texts.cast(pa.binary()), piece.column("key").to_pylist())]
                lists = piece.column("blocks")
                row = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                ok = np.array(same, bool)[row]
                row, flat = row[ok], flat.filter(pa.array(ok))
                take = pa.array(row)
                columns = [flat.field(c) for c in ("bucket", "band", "lo", "hi", "chunk")]
                columns += [piece.column(c).take(take) for c in ("id", "mult", "sig")]
                columns.append(pa.array([sets[r] for r in row], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    columns, names=["bucket", "band", "lo", "hi", "chunk", "id", "mult", "sig", "grams"]
                )

    return run


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, slab: int = 1 << 14) -> np.ndarray:
    """Common n-grams of pairs (i, j): bit sets over the n-grams that several
    members share, a slab of columns at a time."""
    if len(i) <= 16:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    rank = np.cumsum(held > 1) - 1
    owner, column = owner[shared], rank[column[shared]]
    out = np.zeros(len(i), np.int64)
    for start in range(0, int((held > 1).sum()), slab):
        here = (column >= start) & (column < start + slab)
        bits = np.zeros((len(sets), slab), bool)
        bits[owner[here], column[here] - start] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(i), 4096):
            both = packed[i[k : k + 4096]] & packed[j[k : k + 4096]]
            out[k : k + 4096] += np.bitwise_count(both).sum(1, dtype=np.int64)
    return out


def linker(bands: int, threshold: Fraction):
    """Sorted block rows with their sets in; per linked class its links
    (copies counted) and its root in the block out."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, BLOCK):
            sig = matrix(t.column("sig"), bands)
            ids, mult = t.column("id").to_numpy(), t.column("mult").to_numpy()
            band, chunk = t.column("band").to_numpy(), t.column("chunk").to_numpy()
            cross = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            grams = t.column("grams")
            out: list[list] = [[], [], []]
            for a, e in zip(at[:-1], at[1:]):
                own = a + np.unique(ids[a:e], return_index=True)[1]  # rows that repeat a document give its set twice
                mask = fresh_pairs(sig[own], band[a], chunk[own], cross[a])
                i, j = np.nonzero(mask)
                if not len(i):
                    continue
                sets = [np.frombuffer(grams[int(r)].as_buffer(), np.uint64) for r in own]
                size = np.array([len(s) for s in sets], np.int64)
                common = overlaps(sets, i, j)
                linked = common * (num + den) >= num * (size[i] + size[j])
                i, j = i[linked], j[linked]
                if not len(i):
                    continue
                m = mult[own]
                links = np.bincount(i, m[j], len(own)) + np.bincount(j, m[i], len(own))
                root = forest(len(own), i, j)
                some = np.flatnonzero(links)
                out[0].append(ids[own][some])
                out[1].append(links[some].astype(np.int64))
                out[2].append(ids[own][root[some]])
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in out], names=["id", "links", "root"]
                )

    return run


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    budget: int = BLOCK_BUDGET,
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id that links
    reach), n_links (documents linked directly), n_grams, kept (one document
    of each class), text_hash (xxhash64 of the text; tells rows apart that
    share an id)."""
    bands, rows = choose_bands(threshold, recall)
    texts = keyed(docs, id_col, text_col)
    signed = stage(
        texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            signer(n, bands, rows), "rid long, pos long, key binary, n long, sig array<long>, text_hash long"
        ),
        "signatures",
    )
    classes = stage(
        signed.where("n > 0")
        .groupBy("key")
        .agg(F.min(F.struct("rid", "pos")).alias("r"), F.count("*").alias("mult"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .select("key", F.col("r.pos").alias("id"), F.col("r.rid").alias("rid"), "mult", "n", "sig"),
        "classes",
    )
    banded = classes.select(
        "id", (F.col("n") + ROW_COST).alias("weight"), F.posexplode("sig").alias("band", "key")
    )
    met = buckets(banded).drop("weight").join(classes.select("id", "rid", "sig"), "id")
    need = (
        blocks(met, budget)
        .withColumnRenamed("key", "bucket")
        .repartition(*BLOCK)
        .sortWithinPartitions(*BLOCK)
        .select("id", "rid", "bucket", "band", "lo", "hi", "chunk", "sig")
        .mapInArrow(needer(bands), "id long, rid long, bucket long, band int, lo int, hi int, chunk int")
    )
    need = stage(
        need.groupBy("id", "rid").agg(F.collect_list(F.struct("bucket", "band", "lo", "hi", "chunk")).alias("blocks")),
        "needed",
    )
    linked = stage(
        texts.join(need.join(classes.select("id", "key", "mult", "sig"), "id"), "rid")
        .select("text", "key", "id", "mult", "sig", "blocks")
        .mapInArrow(
            setter(n),
            "bucket long, band int, lo int, hi int, chunk int, id long, mult long, sig array<long>, grams binary",
        )
        .repartition(*BLOCK)
        .sortWithinPartitions(*BLOCK)
        .mapInArrow(linker(bands, Fraction(threshold).limit_denominator(1_000_000)), "id long, links long, root long"),
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
    firsts = known.groupBy("root").agg(F.min(F.struct("rid", F.col("id").alias("pos"))).alias("first"))
    known = known.join(firsts, "root").select(
        "key", "first", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return signed.select("rid", "pos", "key", "n", "text_hash").join(stage(known, "known"), "key", "left").select(
        unrid("rid").alias("doc_id"),
        unrid(F.coalesce("first.rid", "rid")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("n").alias("n_grams"),
        (F.coalesce("first.pos", "pos") == F.col("pos")).alias("kept"),
        "text_hash",
    )
