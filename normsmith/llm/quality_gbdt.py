"""Quality classifier: histogram gradient-boosted trees over document
statistics.

Statistics are computed for every whole text in vectorised batches (byte
classes, word lengths, repetition) and staged once.  The trees are fitted on
the driver on a bounded sample of labelled rows (``sample_rows``, those with
the smallest id hashes): features are cut into at most ``bins`` quantile bins
and each level adds gradient histograms per node.  A fitted model is a few
flat arrays; tasks walk all rows of a batch through a tree at once.

Defined cases: null and empty texts have all-zero statistics and are scored
like any other; a document without an id or label is scored, not learned
from; documents labelled more than once count with the mean label; without
both labels in the sample every score is the smoothed share of label 1 (0.8
when nothing is labelled);
repeated rows are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shingles, small_batches, split_words, stage

# Byte classes; bytes of non-ASCII letters count as letters.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, SYMBOL, CONTROL = range(9)


def _classes() -> np.ndarray:
    out = np.full(256, CONTROL, np.uint8)
    out[ord("!") : 0x7F] = SYMBOL
    out[0x80:] = LOWER
    for text, kind in (
        ("abcdefghijklmnopqrstuvwxyz", LOWER),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
        ("0123456789", DIGIT),
        (" \t\x0b\x0c", SPACE),
        ("\n\r", LINE),
        (".,;:'\"()-", STOP),
        ("!?", MARK),
    ):
        out[[ord(c) for c in text]] = kind
    return out


CLASSES = _classes()
FEATURES = (
    "log_bytes log_words lower upper digit space line stop mark symbol control non_ascii word_mean word_std "
    "word_max short_words long_words distinct_words top_word same_next same_second distinct_pairs distinct_runs "
    "upper_words marked_words wordless_runs".split()
)


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per owner (owners ascending)."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[first], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text (no nulls)."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)), np.float32)
    raw = texts.cast(pa.binary())
    sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1]).astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    first = int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset])
    data = data[first : first + int(sizes.sum())]
    doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
    per = np.bincount(doc * 9 + CLASSES[data], minlength=9 * n).reshape(n, 9)
    high = np.bincount(doc, weights=data >= 0x80, minlength=n)
    some = np.maximum(sizes, 1)
    out[:, 0] = np.log1p(sizes)
    out[:, 2:11] = per / some[:, None]
    out[:, 11] = high / some

    codes, words, offsets = split_words(texts)
    counts = np.diff(offsets)
    out[:, 1] = np.log1p(counts)
    if not len(codes):
        return out
    many = np.maximum(counts, 1)
    own = np.repeat(np.arange(n), counts)

    def share(flags: np.ndarray, of: np.ndarray = many) -> np.ndarray:
        return np.bincount(own[: len(flags)], weights=flags, minlength=n) / of

    width = np.array([len(w) for w in words], np.int64)
    big = np.array([w.isupper() and len(w) > 1 for w in words])
    marked = np.array([not w[-1].isalnum() and w[-1] not in ".,;:" for w in words])
    wordless = np.array([not any(map(str.isalnum, w)) for w in words])
    length = width[codes].astype(np.float64)
    mean = share(length)
    out[:, 12] = mean
    out[:, 13] = np.sqrt(np.maximum(share(length**2) - mean**2, 0))
    full = np.flatnonzero(counts)
    out[full, 14] = np.log1p(np.maximum.reduceat(length, offsets[full]))
    out[:, 15] = share(length <= 3)
    out[:, 16] = share(length > 15)
    order = np.lexsort((codes, own))
    o, c = own[order], codes[order]
    edge = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (c[1:] != c[:-1])))
    often = np.diff(np.append(edge, len(c)))
    out[:, 17] = np.bincount(o[edge], minlength=n) / many
    top = np.zeros(n)
    np.maximum.at(top, o[edge], often)
    out[:, 18] = top / many
    for f, k in ((19, 1), (20, 2)):
        if len(codes) > k:
            out[:, f] = share((codes[k:] == codes[:-k]) & (own[k:] == own[:-k]))
    hashes = codes.astype(np.uint64)
    for f, k in ((21, 2), (22, 5)):
        s, at = shingles(hashes, offsets, k)
        held = np.diff(at)
        out[:, f] = _distinct(s, np.repeat(np.arange(n), held), n) / np.maximum(held, 1)
    out[:, 23] = share(big[codes])
    out[:, 24] = share(marked[codes])
    out[:, 25] = share(wordless[codes])
    return out


# --------------------------------------------------------------------- trees
@dataclass
class Trees:
    """Flat arrays over all nodes of all trees: a leaf points at itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[node]] <= self.cut[node]
                node = np.where(go, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    ridge: float = 5.0,
    least: int = 20,
) -> Trees:
    """Logistic loss, second-order gains on binned features."""
    n, m = x.shape
    base = (y.sum() + 4) / (n + 5)  # nothing known: accepted
    flat: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}

    def node(value: float) -> int:
        at = len(flat["value"])
        for k, v in zip(flat, (0, 0.0, at, at, value)):
            flat[k].append(v)
        return at

    roots: list[int] = []
    margin = np.full(n, np.log(base / (1 - base)))
    if 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], 1)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(node(0.0))
            place, live = np.full(n, roots[-1]), [roots[-1]]
            for level in range(depth + 1):
                slot = np.full(len(flat["value"]), -1)
                slot[live] = np.arange(len(live))
                mine = slot[place]
                rows = np.flatnonzero(mine >= 0)
                k = len(live)
                gs = np.bincount(mine[rows], g[rows], k)
                hs = np.bincount(mine[rows], h[rows], k)
                for i, at in enumerate(live):
                    flat["value"][at] = -rate * gs[i] / (hs[i] + ridge)
                if level == depth:
                    break
                best = [(1e-6, -1, -1)] * k
                for f in range(m):
                    key = mine[rows] * bins + binned[rows, f]
                    gh = np.bincount(key, g[rows], k * bins).reshape(k, bins).cumsum(1)
                    hh = np.bincount(key, h[rows], k * bins).reshape(k, bins).cumsum(1)
                    nn = np.bincount(key, minlength=k * bins).reshape(k, bins).cumsum(1)
                    rest_g, rest_h, rest_n = gs[:, None] - gh, hs[:, None] - hh, nn[:, -1:] - nn
                    gain = gh**2 / (hh + ridge) + rest_g**2 / (rest_h + ridge) - (gs**2 / (hs + ridge))[:, None]
                    gain[(nn < least) | (rest_n < least)] = 0
                    gain[:, len(cuts[f]) :] = 0
                    for i in range(k):
                        b = int(gain[i].argmax())
                        if gain[i, b] > best[i][0]:
                            best[i] = (gain[i, b], f, b)
                nxt = []
                for i, at in enumerate(live):
                    _, f, b = best[i]
                    if f < 0:
                        continue
                    flat["feature"][at], flat["cut"][at] = f, float(cuts[f][b])
                    flat["left"][at], flat["right"][at] = node(0.0), node(0.0)
                    here = rows[mine[rows] == i]
                    place[here] = np.where(binned[here, f] <= b, flat["left"][at], flat["right"][at])
                    nxt += [flat["left"][at], flat["right"][at]]
                live = nxt
                if not live:
                    break
            margin += np.array(flat["value"])[place]
    arrays = [np.array(flat[k], t) for k, t in zip(flat, (np.int64, np.float64, np.int64, np.int64, np.float64))]
    return Trees(*arrays, np.array(roots, np.int64), depth, float(np.log(base / (1 - base))))


# --------------------------------------------------------------------- Spark
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 500)
            at += part.num_rows
            x = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel())),
                    part.column(2),
                ],
                names=["doc_id", "x", "text_hash"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(FEATURES))


def scorer(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), batch.column(2)], names=["doc_id", "score", "text_hash"]
            )

    return run


def in_fold(doc_id: str = "doc_id") -> Column:
    """The held-out fold: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(_statistics, "doc_id long, x array<float>, text_hash long")


def fit_quality(stats: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents outside the fold."""
    y = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(~in_fold())
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
    )
    rows = (
        stats.join(y, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x")
        .limit(sample_rows)
        .toArrow()
        .combine_chunks()
    )
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.concatenate([_matrix(c) for c in rows.column("x").chunks])
    return fit(x.astype(np.float64), (rows.column("y").to_numpy() >= 0.5).astype(np.float64))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 20_000,
    cut: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted
    (1 when score >= cut), text_hash (xxhash64 of the text; tells rows apart
    that share an id)."""
    stats = stage(document_statistics(docs, id_col, text_col), "statistics")
    model = fit_quality(stats, labels, sample_rows)
    return stats.mapInArrow(scorer(model), "doc_id long, score double, text_hash long").select(
        "doc_id",
        in_fold().alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        "text_hash",
    )
