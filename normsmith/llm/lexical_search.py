"""Ranked lexical search with a K2-treap over the term-document grid.

Documents are taken in blocks (ranges of the document axis).  A block is a
grid of its terms (rows) by its documents (columns); the cell of a term that
occurs in a document holds its impact, the part of the score that depends on
the document alone.  The grid is kept as a compressed quadtree: a cell with at
least two entries has a four-bit mask of its non-empty quadrants, a cell with
one entry is a leaf that holds the entry, and every cell stores the maximum
impact below it.  Nodes lie level by level, so a child is found by counting
mask bits and no pointers are stored.

An item's terms are searched together.  For a range of documents each term
has the cell on its row's path; the sum over the terms of weight times cell
maximum bounds the score of every document of the range.  The ranges with the
greatest bounds are halved first, each term stepping to its child cell; a
range of one document has its exact score.  Ranges whose bound is below the
k-th best score found so far are left out, which loses nothing.

1. ``build_index``: counts of the corpus (JVM), then one task per block of
   texts builds its quadtree; the index is parquet in the shared folder.
2. ``search``: document frequencies of the items' terms (a sum over blocks),
   then one task per range of blocks gives its k best documents per item, and
   these are merged in two steps.

Items are searched in batches of at most ``BATCH_TERMS`` different terms (an
item with more is a batch of its own), so what is sent to the tasks does not
grow with the number of items.

Terms are runs of ASCII letters, digits and all characters above ASCII, with
only A-Z lower-cased.  All arithmetic is whole-number 64-bit, except for the
weight, floor(1000 ln((2N + 2) / (2 df + 1))).

Defined cases: a null text has no term; a document without terms is not
counted; a null id is ordered after all others and comes back as null; rows
that repeat an id are documents of their own; items that share an id (null is
one) are one item whose terms are united; an item none of whose terms occurs
has no rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, keyed, rid, shared_folder, split_words, stage, unrid

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Different terms of the items that are searched in one job.
BATCH_TERMS = 200_000
# Ranges of an item that are halved together, the ones with the best bounds.
BEST = 64
# Blocks in one file of the index: what a reader holds at once.
FILE_BLOCKS = 8

INDEX = "rids binary, terms array<string>, df binary, bits int, mask binary, top binary, leaf_row binary, leaf_col binary"


# -------------------------------------------------------------------- terms
def byte_table() -> np.ndarray:
    """Bytes of terms stay (A-Z in lower case), all others become a space."""
    t = np.full(256, 0x20, np.uint8)
    t[0x80:] = np.arange(0x80, 0x100)
    for c in LOWER + "0123456789":
        t[ord(c)] = ord(c)
    for c in UPPER:
        t[ord(c)] = ord(c) + 32
    return t


def terms_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all terms, the distinct terms by code, offsets of the texts."""
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    if not n or at[-1] == at[0]:
        return np.zeros(0, np.int64), [], np.zeros(n + 1, np.int64)
    data = byte_table()[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]]
    return split_words(pa.StringArray.from_buffers(n, pa.py_buffer(at - at[0]), pa.py_buffer(data)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Score of a term in a document, without the term's weight."""
    m = 50 + (50 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ----------------------------------------------------------------- quadtree
POPCOUNT = np.array([bin(m).count("1") for m in range(16)], np.int64)


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^31, each followed by a zero bit."""
    x = x.astype(np.uint64)
    for shift, keep in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


@dataclass
class Treap:
    """Nodes level by level: ``mask`` of quadrants (0: leaf), ``top`` impact;
    leaves in the same order: their row and column."""

    bits: int
    mask: np.ndarray
    top: np.ndarray
    leaf_row: np.ndarray
    leaf_col: np.ndarray

    def __post_init__(self) -> None:
        # children follow the children of all nodes before
        self.first = 1 + np.append(0, np.cumsum(POPCOUNT[self.mask]))[:-1]
        self.leaf_at = np.cumsum(self.mask == 0) - 1


def build_treap(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> Treap:
    """The compressed quadtree of at least one entry, no cell given twice."""
    bits = max(1, int(max(row.max(), col.max())).bit_length())
    code = (spread(row) << np.uint64(1)) | spread(col)
    order = np.argsort(code)
    code, value = code[order], value[order]
    inside = np.arange(len(code))  # entries whose cell is not yet a leaf
    masks, tops, leaves = [], [], []
    for level in range(bits + 1):
        key = code[inside] >> np.uint64(2 * (bits - level))
        change = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(change, len(key)))
        cell = key[change]
        if level:  # quadrants present below each cell of the level above
            parent = cell >> np.uint64(2)
            at = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            above = masks[-1]
            above[above > 0] = np.add.reduceat(1 << (cell & np.uint64(3)).astype(np.int64), at)
        leaf = size == 1
        masks.append(np.where(leaf, 0, 1).astype(np.uint8))
        tops.append(np.maximum.reduceat(value[inside], change))
        leaves.append(inside[change[leaf]])
        inside = inside[np.repeat(~leaf, size)]
        if not len(inside):
            break
    at = order[np.concatenate(leaves)]
    return Treap(bits, np.concatenate(masks), np.concatenate(tops), row[at], col[at])


# -------------------------------------------------------------------- index
def block_of(rids: np.ndarray, texts: pa.Array, n_docs: int, n_terms: int) -> dict | None:
    """The index row of a block of texts; None if they have no terms."""
    codes, terms, at = terms_of(texts)
    if not terms:
        return None
    length = np.diff(at)
    doc = np.repeat(np.arange(len(length)), length)
    cell, tf = np.unique(codes.astype(np.int64) * len(length) + doc, return_counts=True)
    row, col = cell // len(length), cell % len(length)
    t = build_treap(row, col, impacts(tf, length[col], n_docs, n_terms))
    return {
        "rids": rids.astype(np.int64).tobytes(), "terms": terms,
        "df": np.bincount(row, minlength=len(terms)).astype(np.int32).tobytes(), "bits": t.bits,
        "mask": t.mask.tobytes(), "top": t.top.astype(np.uint32).tobytes(),
        "leaf_row": t.leaf_row.astype(np.uint32).tobytes(), "leaf_col": t.leaf_col.astype(np.uint32).tobytes(),
    }


def treap_of(b: dict) -> Treap:
    return Treap(
        b["bits"], np.frombuffer(b["mask"], np.uint8), np.frombuffer(b["top"], np.uint32).astype(np.int64),
        np.frombuffer(b["leaf_row"], np.uint32).astype(np.int64), np.frombuffer(b["leaf_col"], np.uint32).astype(np.int64),
    )


@dataclass
class LexicalIndex:
    """Blocks in the shared folder; ``n_docs`` documents with terms and
    ``n_terms`` terms in all.  ``drop`` deletes it."""

    blocks: DataFrame
    path: str
    n_docs: int
    n_terms: int

    def drop(self) -> None:
        delete(self.blocks.sparkSession, self.path)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    rows = keyed(docs, id_col, text_col)
    n = F.regexp_count("text", F.lit(TERM))
    n_docs, n_terms = rows.agg(F.count_if(n > 0), F.coalesce(F.sum(n), F.lit(0))).first()
    out = pa.schema([(f.name, {"int": pa.int32(), "binary": pa.binary()}.get(f.dataType.simpleString(),
                     pa.list_(pa.string()))) for f in rows.sparkSession.createDataFrame([], INDEX).schema])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (row := block_of(b.column(0).to_numpy(), b.column(1), n_docs, n_terms)):
                yield pa.RecordBatch.from_pylist([row], out)

    path = f"{shared_folder(rows.sparkSession)}/treap"
    blocks = rows.mapInArrow(build, INDEX)
    blocks.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    return LexicalIndex(rows.sparkSession.read.schema(INDEX).parquet(path), path, n_docs, n_terms)


# ------------------------------------------------------------------- search
@dataclass
class Found:
    """The k best documents per item so far."""

    k: int
    item: np.ndarray
    score: np.ndarray
    rid: np.ndarray
    least: np.ndarray  # per item: the k-th best score, 0 while there are fewer

    def add(self, item: np.ndarray, score: np.ndarray, rids: np.ndarray) -> None:
        item, score, rids = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.rid, rids)))
        order = np.lexsort((rids, -score, item))
        place = places(item[order])
        order = order[place < self.k]
        self.item, self.score, self.rid = item[order], score[order], rids[order]
        full = places(self.item) == self.k - 1
        self.least[self.item[full]] = self.score[full]


def places(sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each element within its run of equal keys."""
    n = len(sorted_keys)
    start = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if n else np.zeros(0, np.int64)
    return np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))


@dataclass
class Ranges:
    """Document ranges of one level (a prefix of the column's bits) with the
    bound of each, and for each range the cells on its terms' row paths."""

    level: int
    item: np.ndarray
    col: np.ndarray
    bound: np.ndarray
    of: np.ndarray  # of each cell: its range
    node: np.ndarray
    row: np.ndarray
    weight: np.ndarray

    def keep(self, wanted: np.ndarray) -> Ranges:
        cells = wanted[self.of]
        new = np.cumsum(wanted) - 1
        return Ranges(
            self.level, self.item[wanted], self.col[wanted], self.bound[wanted], new[self.of[cells]],
            self.node[cells], self.row[cells], self.weight[cells],
        )


def start_ranges(t: Treap, item: np.ndarray, row: np.ndarray, w: np.ndarray) -> Ranges:
    """All documents, for each item; (item, row, weight) sorted by item."""
    items, of = np.unique(item, return_inverse=True)
    zero = np.zeros(len(item), np.int64)
    if t.mask[0] == 0:  # one entry in all
        w = np.where(row == t.leaf_row[0], w, 0)
    bound = np.bincount(of, w * t.top[0], len(items)).astype(np.int64)
    return Ranges(0, items, np.zeros(len(items), np.int64), bound, of, zero, row, w)


def halve(t: Treap, r: Ranges) -> Ranges:
    """Both halves of every range, without those that hold no term."""
    shift = t.bits - 1 - r.level
    m = t.mask[r.node].astype(np.int64)
    leaf = m == 0
    leaf_bit = (t.leaf_col[t.leaf_at[r.node]] >> shift) & 1
    row_bit = (r.row >> shift) & 1
    first = t.first[r.node]
    parts = []
    for bit in (0, 1):
        quadrant = 2 * row_bit + bit
        there = np.flatnonzero(np.where(leaf, leaf_bit == bit, (m >> quadrant) & 1))
        child = np.where(leaf, r.node, first + POPCOUNT[m & ((1 << quadrant) - 1)])[there]
        # a leaf below may be another term's entry
        right = (t.mask[child] != 0) | (t.leaf_row[t.leaf_at[child]] == r.row[there])
        there, child = there[right], child[right]
        old = r.of[there]
        start = np.flatnonzero(np.append(True, old[1:] != old[:-1])) if len(old) else np.zeros(0, np.int64)
        w = r.weight[there]
        bound = np.add.reduceat(w * t.top[child], start) if len(old) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(old))))
        ranges = old[start]
        parts.append((r.item[ranges], 2 * r.col[ranges] + bit, bound, of, child, r.row[there], w))
    a, b = parts
    return Ranges(
        r.level + 1, *(np.concatenate(p) for p in zip(a[:3], b[:3])), np.append(a[3], b[3] + len(a[0])),
        *(np.concatenate(p) for p in zip(a[4:], b[4:])),
    )


def descend(t: Treap, rids: np.ndarray, r: Ranges, found: Found) -> None:
    """Best-first search below ``r``: of each item the ``BEST`` ranges with
    the greatest bounds go down first, the others wait for the scores that
    these find."""
    waiting = [r]
    while waiting:
        r = waiting.pop()
        r = r.keep((r.bound > 0) & (r.bound >= found.least[r.item]))
        if not len(r.item):
            continue
        if r.level == t.bits:
            found.add(r.item, r.bound, rids[r.col])
            continue
        if len(r.item) > BEST:
            order = np.lexsort((-r.bound, r.item))
            best = np.zeros(len(order), bool)
            best[order[places(r.item[order]) < BEST]] = True
            if not best.all():
                waiting.append(r.keep(~best))
                r = r.keep(best)
        waiting.append(halve(t, r))


def item_batches(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str], np.ndarray, np.ndarray]]:
    """Batches of items: their ids, the distinct terms, and for each pair of
    an item and a term their numbers in these lists, sorted by item."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    pairs = items.select(rid(id_col).alias("rid"), F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term"))
    ids, numbers, of, term = [], {}, [], []
    for row in pairs.distinct().orderBy("rid", "term").toLocalIterator():
        if not ids or ids[-1] != row.rid:
            if len(numbers) >= BATCH_TERMS:
                yield ids, list(numbers), np.array(of), np.array(term)
                ids, numbers, of, term = [], {}, [], []
            ids.append(row.rid)
        of.append(len(ids) - 1)
        term.append(numbers.setdefault(row.term, len(numbers)))
    if ids:
        yield ids, list(numbers), np.array(of), np.array(term)


def frequencies(index: LexicalIndex, terms: list[str]) -> np.ndarray:
    """Documents that hold each term: sums over the blocks."""
    wanted = pa.array(terms, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                at = pc.index_in(wanted, value_set=b.column(0)[k].values)
                here = pc.is_valid(at).to_numpy(zero_copy_only=False)
                df = np.frombuffer(b.column(1)[k].as_py(), np.int32)
                total[here] += df[at.drop_null().to_numpy()]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["term", "df"])

    parts = index.blocks.select("terms", "df").mapInArrow(count, "term long, df long")
    out = np.zeros(len(terms), np.int64)
    for row in parts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row per term of the batch
        out[row.term] = row.df
    return out


def search(index: LexicalIndex, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a
    score above 0, equal scores by ascending id."""
    spark = items.sparkSession
    out = None
    for ids, terms, of, term in item_batches(items, id_col, text_col):
        df = frequencies(index, terms)
        w = np.array([weight(index.n_docs, d) if d else 0 for d in df.tolist()], np.int64)
        wanted, n_items = pa.array(terms, pa.string()), len(ids)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(0, np.int64)
            found = Found(k, none, none, none, np.zeros(n_items, np.int64))
            for batch in batches:
                for b in batch.to_pylist() if batch.num_rows else []:
                    at = pc.index_in(wanted, value_set=pa.array(b["terms"], pa.string()))
                    row = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)[term]
                    here = (row >= 0) & (w[term] > 0)
                    if here.any():
                        t = treap_of(b)
                        start = start_ranges(t, of[here], row[here], w[term][here])
                        descend(t, np.frombuffer(b["rids"], np.int64), start, found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids)[found.item]), pa.array(found.rid), pa.array(found.score)],
                ["item", "rid", "score"],
            )

        part = stage(index.blocks.mapInArrow(best, "item long, rid long, score long").withColumn(
            "task", F.spark_partition_id()), "found")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "item long, rid long, score long, task int")
    best_first = [F.col("score").desc(), F.col("rid")]
    # two steps: what 256 tasks have found, then the whole
    near = Window.partitionBy("item", F.shiftright("task", 8)).orderBy(*best_first)
    out = out.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best_first)))
    return out.where(F.col("rank") <= k).select(
        unrid("item").alias("item_id"), "rank", unrid("rid").alias("doc_id"), "score"
    )


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Index and search in one: the index is deleted once the result is staged."""
    index = build_index(docs)
    out = stage(search(index, items, k), "ranked")
    index.drop()
    return out
