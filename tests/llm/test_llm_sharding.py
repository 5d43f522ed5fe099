"""K-d tree shards against a tree built by plain sorting."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from normsmith.llm import kd_shards as KD

SF = "/root/testdata/sf0.001"


def brute_tree(units, shards, n_dims):
    """units: (values, tie, bytes) -> first shard of each unit's leaf."""
    extent = [max(1, max(u[0][k] for u in units) - min(u[0][k] for u in units)) for k in range(n_dims)]
    out = {}

    def split(part, first, s):
        if s == 1 or not part:
            out.update({(u[0], u[1]): first for u in part})
            return
        share = [(max(u[0][k] for u in part) - min(u[0][k] for u in part)) / extent[k] for k in range(n_dims)]
        dim = share.index(max(share))
        want = sum(u[2] for u in part) * (s // 2) / s
        total = Counter()
        for u in part:
            total[u[0][dim], u[1]] += u[2]
        below = 0
        for at in sorted(total):
            if below + total[at] >= want or at == max(total):
                behind = want - below >= total[at] / 2
                break
            below += total[at]
        left = [u for u in part if (u[0][dim], u[1]) < at or (behind and (u[0][dim], u[1]) == at)]
        gone = {id(u) for u in left}
        split(left, first, s // 2)
        split([u for u in part if id(u) not in gone], first + s // 2, s - s // 2)

    split(units, 0, shards)
    return out


@pytest.mark.parametrize("shards", [8, 5])
def test_tree_equals_plain_sort(spark, monkeypatch, shards):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    real = KD.split_units

    def keep(units, n):
        rows = units.collect()
        seen["units"] = [((r.d0, r.d1, r.d2, r.d3), r.tie, r.bytes) for r in rows]
        out = real(units, n)
        seen["got"] = {((r.d0, r.d1, r.d2, r.d3), r.tie): r.shard for r in out.collect()}
        return out

    monkeypatch.setattr(KD, "split_units", keep)
    for buckets in (4096, 4):  # few buckets: many rounds of refinement
        monkeypatch.setattr(KD, "BUCKETS", buckets)
        KD.kd_shards(d, shards=shards)
        assert seen["got"] == brute_tree(seen["units"], shards, 4)


def check(rows, got, shards, slack):
    """All rows, right sizes and checksums, gapless slots, near equal bytes."""
    want = sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(size.values()) / shards
    assert all(abs(size[k] - mean) <= slack for k in range(shards)), (size, mean)


def test_whole_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
    got = KD.kd_shards(d, shards=8).collect()
    check(rows, got, 8, 2 * max(len(t.encode()) for _, t in rows if t))
    assert got == KD.kd_shards(d, shards=8).collect() or sorted(got) == sorted(KD.kd_shards(d, shards=8).collect())
    one = KD.kd_shards(d, target_bytes=40_000).agg(F.countDistinct("shard")).first()[0]
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    assert one == -(-total // 40_000)


def test_large_group_is_divided_small_ones_stay(spark):
    rows = [(i, "copy of one text " * 3) for i in range(900)] + [(1000 + i, f"text number {i} " * 4) for i in range(900)]
    rows += [(5000 + i, f"pair {i // 2} " * 5) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = KD.kd_shards(d, shards=8, dims=("n_chars", "doc_id")).collect()
    check(rows, got, 8, 2000)
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    pairs = [shards[zlib.crc32(t.encode())] for i, t in rows if i >= 5000]
    assert all(len(s) == 1 for s in pairs)
    assert len(shards[zlib.crc32(rows[0][1].encode())]) > 1


def test_edges(spark):
    rows = [(None, None), (None, ""), (1, "a"), (1, "a"), (2, "x" * 300_000), (3, "é€"), (None, "a")]
    names = "doc_id long, text string, source string, lang string, h int, size int, crc int, row int, d0 int, node int"
    d = spark.createDataFrame([(*r, None, "en", 1, 2, 3, 4, 5, 6) for r in rows], names)
    d = d.withColumn("n_chars", F.lit(None).cast("double"))
    got = KD.kd_shards(d, shards=3).collect()
    check(rows, got, 3, 300_000)
    assert KD.kd_shards(d.limit(0), shards=8).count() == 0
    assert {r.shard for r in KD.kd_shards(d, shards=1).collect()} == {0}
    odd = spark.createDataFrame([(i, f"t{i}", v) for i, v in enumerate([float("nan"), 1e300, -1e300, 0.5, None])],
                                "doc_id long, text string, w double")
    assert KD.kd_shards(odd, shards=2, dims=("w",)).count() == 5
    with pytest.raises(ValueError):
        KD.kd_shards(d)
