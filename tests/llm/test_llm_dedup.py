"""Exact dedup and n-gram join against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from normsmith.llm.common import components, forest, groups
from normsmith.llm.exact_dedup import Directory, code, decode, exact_dedup, normalise
from normsmith.llm.ngram_join import choose_bands, ngram_join, overlaps

SF = "/root/testdata/sf0.001"


def brute_exact(rows):
    groups_ = defaultdict(list)
    for i, t in rows:
        groups_[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted(
        (i, min(v), len(v), i == min(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups_.items() for i in v
    )


def brute_join(rows, n=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    links, label = Counter(), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    first = defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(rows):
        first[label[k]] = min(first[label[k]], i)
    return sorted((i, first[label[k]], links[k]) for k, (i, _) in enumerate(rows))


EDGE = [
    (1, "a  b c"), (1, "a b c"), (None, "a\tb c"), (2, None), (3, ""), (4, " "), (5, "\n\n"),
    (6, "w " * 60000), (7, "w " * 300), (1, "other text of the same id"), (9, "other text of the same id"),
]


def edge(spark):
    """Nulls, empties, ties, repeated rows, a long text, clashing columns."""
    names = "doc_id long, text string, rid string, key int, sig int, pos int, kind int, n int, sha int"
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in EDGE], names)


@pytest.mark.parametrize("options", [{}, {"depth": 0, "capacity": 20_000}])
def test_exact_dedup(spark, options):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in exact_dedup(d, **options).collect())
    assert got == brute_exact([tuple(r) for r in d.select("doc_id", "text").collect()])


def test_exact_dedup_edges(spark):
    got = exact_dedup(edge(spark)).drop("text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [
            (1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (2, 2, 2, True), (3, 2, 2, False),
            (4, 4, 2, True), (5, 4, 2, False), (6, 6, 1, True), (7, 7, 1, True),
            (1, 1, 2, True), (9, 1, 2, False),
        ],
        key=str,
    )
    assert exact_dedup(edge(spark).limit(0)).count() == 0


def test_normalise_matches_pattern():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("ab \t\n\r\x0b\x0c\xa0\x1c") for _ in range(rng.randrange(12)))
        assert normalise(t.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_directory_doubles():
    d = Directory(1)
    assert d.split((1, 0)) == [(2, 0), (2, 1)] and d.depth == 2
    d.split((1, 1))
    assert d.depth == 2 and len(d.leaves) == 4
    assert all(decode(code(b)) == b for b in d.leaves)


@pytest.mark.parametrize("options", [{}, {"budget": 3000}])
def test_ngram_join(spark, options):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join(d, **options).collect())
    assert got == brute_join(sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()))


def test_ngram_join_large_group(spark):
    """Many near copies of one text, split over small blocks."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{i}_{k}" for k in range(40))) for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join(d, budget=4000).collect())
    assert got == brute_join(rows)


def test_ngram_join_edges(spark):
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in ngram_join(edge(spark)).collect()), key=str)
    assert got == sorted(
        [
            (1, 1, 2, True), (1, 1, 2, False), (None, 1, 2, False), (2, 2, 0, True), (3, 3, 0, True),
            (4, 4, 0, True), (5, 5, 0, True), (6, 6, 1, True), (7, 6, 1, False),
            (1, 1, 1, True), (9, 1, 1, False),
        ],
        key=str,
    )
    assert ngram_join(edge(spark).limit(0)).count() == 0


def test_bands_reach_recall():
    bands, rows = choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 200


def test_overlaps_by_bits():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]
    assert overlaps(sets, i, j, slab=64).tolist() == want


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    i, j = np.array(pairs).T
    label = forest(1041, i, j)
    assert got == {k: label[k] for p in pairs if p[0] != p[1] for k in p}
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_groups_across_batches():
    import pyarrow as pa

    keys = [0, 0, 1, 2, 2, 2, 2, 2, 3, 4]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_pydict({"k": keys[a : a + size]}) for a in range(0, len(keys), size)]
        got = []
        for t, at in groups(iter(batches), ["k"]):
            got += [t.column("k").to_pylist()[a:e] for a, e in zip(at[:-1], at[1:])]
        assert got == [[0, 0], [1], [2] * 5, [3], [4]]


def test_pre_aggregation_keeps_hot_text_small(spark):
    """A text that fills a third of all rows is one row per task."""
    d = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"),
    )
    got = exact_dedup(d)
    assert got.where("kept").count() == 2001
    assert got.where("keep_id = 0").agg(F.max("group_size")).first()[0] == 1000
