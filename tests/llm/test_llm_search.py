"""Ranked search against brute force over all documents and items."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from normsmith.llm import lexical_search as LS

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(LS.UPPER, LS.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if none else i, -s))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.collect()])
    assert got(LS.ranked_search(d.repartition(5), b)) == want


def test_batches_and_small_beam(spark, monkeypatch):
    """Items in many batches, a few ranges at a time, small k."""
    monkeypatch.setattr(LS, "BATCH_TERMS", 60)
    monkeypatch.setattr(LS, "BEST", 2)
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    b = b.limit(8)
    want = brute([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.collect()], 3)
    index = LS.build_index(d)
    assert got(LS.search(index, b, 3)) == want
    path = index.path.removeprefix("file:")
    index.drop()
    import os

    assert not os.path.exists(path)


def test_edges(spark):
    docs = [(None, "Alpha beta"), (1, None), (2, ""), (3, "..."), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha"),
            (5, "Ünï code 日本 alpha"), (6, "word " * 50_000 + "rare"), (7, "ALPHA-Beta_gamma 1a2"), (8, "É é")]
    items = [(1, "alpha Beta"), (None, "rare 日本"), (2, None), (3, "absent"), (1, "gamma"), (4, "É"), (5, "ünï code ünï code"),
             (6, "É É")]
    names = "text string, rid int, term int, item int, score int, rank int, bits int"
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in docs], "doc_id long, " + names)
    q = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in items], "item_id long, " + names)
    assert got(LS.ranked_search(d, q)) == brute(docs, items)
    assert LS.ranked_search(d.limit(0), q).collect() == [] == LS.ranked_search(d, q.limit(0)).collect()
    assert LS.ranked_search(d.where("doc_id = 3"), q).collect() == []


def test_treap_holds_every_cell():
    rng = random.Random(2)
    for n, rows, cols in ((1, 5, 9), (300, 40, 20), (2000, 3000, 50), (50, 1, 200)):
        cells = {(rng.randrange(rows), rng.randrange(cols)): rng.randrange(1, 10**6) for _ in range(n)}
        row, col = (np.array([c[k] for c in cells]) for k in (0, 1))
        t = LS.build_treap(row, col, np.array(list(cells.values())))

        def walk(node, level, r, c):
            if t.mask[node] == 0:
                at = t.leaf_at[node]
                cell = (t.leaf_row[at], t.leaf_col[at])
                assert (cell[0] >> (t.bits - level), cell[1] >> (t.bits - level)) == (r, c)
                assert t.top[node] == cells[cell]
                return {cell}, t.top[node]
            found, best, child = set(), 0, t.first[node]
            for q in range(4):
                if t.mask[node] >> q & 1:
                    got_, top = walk(child, level + 1, 2 * r + (q >> 1), 2 * c + (q & 1))
                    found |= got_
                    best, child = max(best, top), child + 1
            assert best == t.top[node]
            return found, best

        assert walk(0, 0, 0, 0)[0] == set(cells)
