"""Drawing by permutation, full corridor and bootstrap by value against plain
Python on small fixtures; chi-square of the draws."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from normsmith.operators import agreement as AG
from normsmith.operators import resample as RS

SCHEMA = "exp string, session_id long, trial_name string, dv int"


def word(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def permute(j, k, key):
    a = math.ceil(math.sqrt(k))
    b = math.ceil(k / a)
    x = j
    while True:
        left, right = divmod(x, b)
        for r in range(RS.FEISTEL_ROUNDS):
            if r % 2 == 0:
                left = (left + word(key, r, right)) % a
            else:
                right = (right + word(key, r, left)) % b
        x = left * b + right
        if x < k:
            return x


@pytest.mark.parametrize("k", [1, 2, 3, 5, 17, 100, 1009])
def test_permutation_is_one_to_one(spark, k):
    key = F.lit("123|A|10|0")
    got = [r[0] for r in spark.range(k).select(RS.permuted(F.col("id"), F.lit(k), key)).collect()]
    assert sorted(got) == list(range(k))
    assert got == [permute(j, k, "123|A|10|0") for j in range(k)]


def ratings(n_raters=12, n_stim=9, seed=1, exp="t"):
    rng = np.random.default_rng(seed)
    out = []
    for r in range(n_raters):
        for s in range(n_stim):
            if (r + s) % 5 != 0:
                out.append((exp, 100 + r, f"s{s}", None if (r * s) % 11 == 7 else int(rng.integers(1, 8) + s // 4)))
    return out


def moments(cells):
    """ICC(2,k) by the method of moments: plain sums."""
    by_r, by_s = defaultdict(list), defaultdict(list)
    for _, r, s, x in cells:
        by_r[r].append(x)
        by_s[s].append(x)
    xs = [c[3] for c in cells]
    n, a, b = len(xs), len(by_s), len(by_r)
    if a < 2 or b < 2:
        return None
    ta = sum(sum(v) ** 2 / len(v) for v in by_s.values())
    tb = sum(sum(v) ** 2 / len(v) for v in by_r.values())
    t0, tm = sum(x * x for x in xs), sum(xs) ** 2 / n
    k1, k2 = (sum(len(v) ** 2 for v in d.values()) / n for d in (by_s, by_r))
    if n in (a, b) or not n - k1 - k2 + 1:
        return None
    p, q = (t0 - ta) / (n - a), (t0 - tb) / (n - b)
    ve = ((n - k1) * q + (a - k2) * p - (ta - tm)) / (n - k1 - k2 + 1)
    total = q - ve + p / b
    return (q - ve) / total if ve >= 0 and p >= 0 and total > 0 else None


def test_full_corridor_equals_plain_sums(spark):
    rows = ratings() + ratings(7, 6, 2, None) + [("lone", 1, "s1", 3)]
    cells = spark.createDataFrame(rows, SCHEMA)
    got = {(r.exp, r.n, r.iter): r for r in RS.full_corridor(cells, (2, 5, 9, 50), 3, 7).collect()}
    want = {}
    for exp in ("t", None, "lone"):
        raters = sorted({r[1] for r in rows if r[0] == exp})
        for n in (2, 5, 9, 50):
            for it in range(3 if n <= len(raters) else 0):
                key = "|".join(str(p) for p in (7, exp, n, it) if p is not None)
                drawn = {raters[permute(j, len(raters), key)] for j in range(n)}
                assert len(drawn) == n
                want[exp, n, it] = [r for r in rows if r[0] == exp and r[1] in drawn and r[3] is not None]
    assert set(got) == set(want)
    for k, cells_ in want.items():
        r, icc = got[k], moments(cells_)
        n_r, n_s = len({c[1] for c in cells_}), len({c[2] for c in cells_})
        assert (r.n_raters, r.n_stimuli, r.n_cells_missing) == (n_r, n_s, n_r * n_s - len(cells_))
        assert r.icc2k == (None if icc is None else pytest.approx(icc, abs=1e-9))


def test_samples_do_not_depend_on_partitioning(spark):
    cells = spark.createDataFrame(ratings(), SCHEMA)
    a, b = (sorted(map(tuple, RS.permuted_samples(c, (3, 8), 5, 9).collect())) for c in
            (cells.coalesce(1), cells.repartition(7)))
    assert a == b and Counter(r[1] for r in a) == {3: 15, 8: 40}


def position(base, d, m):
    z = (base + d * 0x9E3779B9) & RS.MASK32
    for _ in range(2):
        z = ((z ^ (z >> 16)) * 0x45D9F3B) & RS.MASK32
    return ((z ^ (z >> 16)) * m) >> 32


@pytest.mark.parametrize("few", [64, 2])
def test_bootstrap_by_value_equals_plain_draws(spark, monkeypatch, few):
    """By cumulative counts, and (few = 2) by a join on positions."""
    monkeypatch.setattr(RS, "FEW_VALUES", few)
    rows = ratings() + ratings(4, 3, 5, None)
    got = {(r.exp, r.trial_name, r.sample_size, r.iteration): r.mean_rating for r in
           RS.bootstrap_by_value(spark.createDataFrame(rows, SCHEMA), 6, 4, 11).collect()}
    answers = defaultdict(list)
    for exp, _, s, x in rows:
        if x is not None:
            answers[exp, s].append(x)
    want = {}
    for (exp, s), xs in answers.items():
        xs.sort()
        for n in range(1, 7):
            for it in range(4):
                base = word(*[p for p in (11, exp, s, n, it) if p is not None])
                drawn = [xs[position(base, d, len(xs))] for d in range(1, n + 1)]
                want[exp, s, n, it] = sum(drawn) / n - sum(xs) / len(xs)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_draws_are_even(spark):
    """Chi-square of 200,000 positions over 40 places, and of pairs of
    neighbouring draws over 8 x 8 places."""
    samples = spark.range(2000).withColumn("base", RS.word32(F.md5(F.col("id").cast("string"))))
    d = samples.withColumn("d", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(100).cast("long"))))
    at = RS.draw_position(F.col("base"), F.col("d"), F.lit(40))
    n = np.array([r["count"] for r in d.groupBy(at.alias("at")).count().collect()])
    assert len(n) == 40 and ((n - 5000) ** 2 / 5000).sum() < 39 + 5 * math.sqrt(2 * 39)
    two = d.groupBy(RS.draw_position(F.col("base"), F.col("d"), F.lit(8)).alias("a"),
                    RS.draw_position(F.col("base"), F.col("d") + 1, F.lit(8)).alias("b")).count().collect()
    n = np.array([r["count"] for r in two])
    assert len(n) == 64 and ((n - 3125) ** 2 / 3125).sum() < 63 + 5 * math.sqrt(2 * 63)


def test_bootstrap_shuffles_no_draws(spark):
    """Stimulus-size rows are what is distributed; the means need no further
    shuffle."""
    cells = spark.createDataFrame(ratings(), SCHEMA)
    plan = RS.bootstrap_by_value(cells, 100, 300, 1)._jdf.queryExecution().executedPlan().toString()
    below = plan.index("explode(sequence(1, sample_size")
    assert "Exchange" not in plan[:below]


# -------------------------------------------------------------------- omega
def imputed_omega(rows):
    raters, stims = (sorted({r[k] for r in rows}) for k in (1, 2))
    x = np.full((len(stims), len(raters)), np.nan)
    for _, r, s, v in rows:
        x[stims.index(s), raters.index(r)] = np.nan if v is None else v
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    return AG.omega_from_corr(np.corrcoef(x.T))


def test_omega_equals_matrix_fit(spark):
    rng = np.random.default_rng(8)
    rows = []
    for exp, absent in (("full", 0), ("holes", 6), (None, 4)):
        for r in range(8):
            for s in range(30):
                if absent and (r + s) % absent == 0:
                    continue
                v = 4 + 2 * math.sin(s) * (-1 if r == 3 else 1) + rng.normal(0, 1.2)
                rows.append((exp, r, f"s{s}", v))
    rows += [("one", 1, "s1", 2.0), ("one", 1, "s2", 3.0)] + [("flat", r, f"s{s}", 3.0) for r in range(3) for s in range(4)]
    cells = spark.createDataFrame(rows, "exp string, session_id long, trial_name string, dv double")
    got = {r.exp: r for r in AG.omega_total(cells, min_values=None).collect()}
    for exp in ("full", "holes", None):
        assert got[exp].converged
        assert got[exp].omega_t == pytest.approx(imputed_omega([r for r in rows if r[0] == exp]), abs=1e-6)
    assert got["full"].n_cells_missing == 0 and got["holes"].n_cells_missing == 40
    assert got["one"].omega_t is None and got["flat"].omega_t is None and got["flat"].n_raters == 0


# ------------------------------------------------------------ improper, null
def test_improper_components_give_no_icc(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(40):
        x = rng.integers(1, 8, (6, 6))
        rows += [(f"t{t}", r, f"s{s}", int(x[s, r])) for s in range(6) for r in range(6) if r != s]
    got = AG.icc2k(spark.createDataFrame(rows, SCHEMA), min_values=None, missing="all").collect()
    assert all(r.icc2k is None or r.icc2k <= 1 for r in got)
    assert any(r.improper for r in got) and all(r.improper for r in got if r.icc2k is None)


def test_null_task_is_screened(spark):
    rows = [(None, r, f"s{s}", 3 if r == 0 else (r * s) % 5 + s % 3) for r in range(5) for s in range(8)]
    cells = spark.createDataFrame(rows, SCHEMA)
    kept, dropped = AG.screen_raters(cells)
    assert [r.session_id for r in dropped.collect()] == [0]
    assert {r.session_id for r in kept.collect()} == {1, 2, 3, 4}
    assert AG.icc2k(cells).first().n_raters == 4
    assert {r.session_id: r.n_values for r in AG.rater_variety(cells.where("session_id < 1 or trial_name <> 's1'")).collect()}[1] >= 4
