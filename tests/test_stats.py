"""Hand-worked statistics, distribution functions and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from normsmith.functions import dist
from normsmith.operators import agreement as AG
from normsmith.operators import resample as RS
from normsmith.operators import stability as ST

# Shrout & Fleiss (1979): six stimuli x four raters.
SF_MATRIX = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]


def long_cells(spark, matrix, exp="T"):
    rows = [(exp, j, f"s{i}", int(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "exp string, session_id long, trial_name string, dv int")


def test_shrout_fleiss(spark):
    icc = AG.icc2k(long_cells(spark, SF_MATRIX), min_values=None).first()
    assert icc.msb == pytest.approx(11.2417, abs=1e-4)
    assert icc.msj == pytest.approx(32.4861, abs=1e-4)
    assert icc.mse == pytest.approx(1.0194, abs=1e-4)
    assert icc.icc2k == pytest.approx(0.62005, abs=1e-5)
    ms = AG.mean_squares(AG.variance_sums(long_cells(spark, SF_MATRIX))).select(AG.icc21_column().alias("r")).first()
    assert ms.r == pytest.approx(0.28976, abs=1e-5)
    b = AG.with_icc_bounds(AG.icc2k(long_cells(spark, SF_MATRIX), min_values=None)).first()
    assert b.icc2k_lower < b.icc2k < b.icc2k_upper < 1


def test_alpha_matches_numpy(spark):
    x = np.array(SF_MATRIX, dtype=float)
    k = x.shape[1]
    want = k / (k - 1) * (1 - x.var(axis=0, ddof=1).sum() / x.sum(axis=1).var(ddof=1))
    got = AG.cronbach_alpha(long_cells(spark, SF_MATRIX), min_values=None).first().alpha
    assert got == pytest.approx(want, rel=1e-12)


def test_distribution_functions():
    assert dist.f_ppf(0.975, 5, 15) == pytest.approx(3.576421, abs=1e-5)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert dist.t_ppf(0.025, 10) == pytest.approx(-2.228139, abs=1e-6)
    assert dist.f_cdf(dist.f_ppf(0.3, 3.5, 40.2), 3.5, 40.2) == pytest.approx(0.3, abs=1e-10)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert 2 * (1 - dist.t_cdf(2.228139, 10)) == pytest.approx(0.05, abs=1e-6)


def test_omega_compound_symmetry():
    k, r = 6, 0.4
    m = np.full((k, k), r)
    np.fill_diagonal(m, 1.0)
    lam = AG.one_factor_minres(m)
    assert np.allclose(lam, math.sqrt(r), atol=1e-6)
    assert AG.omega_from_corr(m) == pytest.approx(k * r / (1 + (k - 1) * r), abs=1e-8)


def test_omega_query_runs(spark, cells01):
    om = {r.exp: r.omega_t for r in AG.omega_total(cells01).collect()}
    assert set(om) == {"A", "N", "R"}
    assert om["A"] > om["N"] > om["R"] > 0


def test_variety_counts_missing_and_absent(spark):
    rows = [("T", 1, "s1", 1), ("T", 1, "s2", 1), ("T", 1, "s3", 2),        # 2 values
            ("T", 2, "s1", 1), ("T", 2, "s2", 2), ("T", 2, "s3", None),     # 2 + missing
            ("T", 3, "s1", 1), ("T", 3, "s2", 2),                           # 2 + absent cell
            ("T", 4, "s1", 1), ("T", 4, "s2", 2), ("T", 4, "s3", 3)]        # 3
    df = spark.createDataFrame(rows, "exp string, session_id long, trial_name string, dv int")
    got = {r.session_id: r.n_values for r in AG.rater_variety(df).collect()}
    assert got == {1: 2, 2: 3, 3: 3, 4: 3}
    kept, dropped = AG.screen_raters(df)
    assert [r.session_id for r in dropped.collect()] == [1]


def test_constant_and_single_rater(spark):
    const = long_cells(spark, [[4, 1], [4, 2], [4, 3], [4, 5]])
    r = AG.icc2k(const).first()   # rater 0 is constant -> dropped -> one rater left
    assert r.n_raters == 1 and r.icc2k is None


def test_permuting_raters_leaves_icc(spark):
    a = AG.icc2k(long_cells(spark, SF_MATRIX), min_values=None).first().icc2k
    perm = [[row[2], row[0], row[3], row[1]] for row in SF_MATRIX]
    b = AG.icc2k(long_cells(spark, perm), min_values=None).first().icc2k
    assert a == pytest.approx(b, rel=1e-12)


def test_resampling_independent_of_partitioning(cells01):
    a = RS.bootstrap_means(cells01.coalesce(1), 5, 3, 7).orderBy("exp", "trial_name", "sample_size", "iteration")
    b = RS.bootstrap_means(cells01.repartition(13), 5, 3, 7, method="join").orderBy(
        "exp", "trial_name", "sample_size", "iteration")
    ra, rb = a.collect(), b.collect()
    assert len(ra) == len(rb) > 0
    assert all(x.mean_rating == pytest.approx(y.mean_rating, abs=1e-12) for x, y in zip(ra, rb))
    s1 = RS.rater_samples(cells01.coalesce(1), (3,), 4, 9).collect()
    s2 = RS.rater_samples(cells01.repartition(11), (3,), 4, 9).collect()
    assert sorted(map(tuple, s1)) == sorted(map(tuple, s2))


def test_percentile_interval_positions(spark):
    rows = [("T", 1, float(v)) for v in range(1, 41)] + [("T", 2, float(v)) for v in range(1, 11)]
    df = spark.createDataFrame(rows, "exp string, sample_size long, mean_rating double")
    got = {r.sample_size: (r.ll, r.ul) for r in ST.percentile_interval(df).collect()}
    assert got[1] == (1.0, 39.0)          # b = floor(40*0.05/2) = 1
    assert got[2] == (None, 10.0)         # b = 0: no lower position


def test_point_of_stability_modes(spark):
    cis = spark.createDataFrame(
        [("T", 1, -2.0, 2.0), ("T", 2, -0.4, 0.4), ("T", 3, -0.6, 0.6), ("T", 4, -0.3, 0.3), ("T", 5, -0.2, 0.2),
         ("U", 1, -1.0, 1.0), ("U", 2, None, 0.1)],
        "exp string, sample_size long, ll double, ul double")
    first = {r.exp: r.pos for r in ST.point_of_stability(cis, 0.5).collect()}
    sust = {r.exp: r.pos for r in ST.point_of_stability(cis, 0.5, mode="sustained").collect()}
    run2 = {r.exp: r.pos for r in ST.point_of_stability(cis, 0.5, inarow=2).collect()}
    assert first == {"T": 2, "U": None}
    assert sust == {"T": 4, "U": None}
    assert run2 == {"T": 4, "U": None}


def test_thresholds(spark):
    s = spark.createDataFrame([("A", 10, 0.7), ("A", 20, 0.8), ("A", 30, 0.95), ("B", 10, 0.5)],
                              "exp string, n long, icc_median double")
    got = {r.exp: (r.n_for_075, r.n_for_090) for r in RS.corridor_thresholds(s).collect()}
    assert got == {"A": (20, 30), "B": (None, None)}


def test_exact_quantile_matches_numpy(spark):
    from normsmith.operators.quantile import exact_quantile, kth_smallest

    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.lognormal(3, 2, 5000), np.full(300, 7.25), rng.integers(0, 50, 2000).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double").repartition(6)
    for p in (0.0, 0.01, 0.25, 0.5, 0.975, 1.0):
        got = exact_quantile(df, "x", p)
        assert got == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)
    s = np.sort(vals)
    for k in (0, 1, 299, 4000, len(vals) - 1):
        assert kth_smallest(df, "x", k) == s[k]
    assert exact_quantile(df.where("x is null"), "x", 0.5) is None


def test_task_subset_and_intervals(spark):
    df = spark.createDataFrame([("attractive", "3"), ("anger", "x"), ("attractive (unstd)", "5")], "exp string, dv string")
    assert [r.dv for r in AG.task_subset(df, tasks=["attractive"]).collect()] == [3.0]
    assert sorted(r.exp for r in AG.task_subset(df, pattern="unstd").collect()) == ["attractive (unstd)"]
    assert [r.dv for r in AG.task_subset(df, tasks=["anger"]).collect()] == [None]
    means = spark.createDataFrame([("T", 1, float(v)) for v in range(10)], "exp string, sample_size long, mean_rating double")
    r = ST.interval(means, 0.95, "normal").first()
    half = 1.959963984540054 * np.std(np.arange(10), ddof=1) / math.sqrt(10)
    assert r.ll == pytest.approx(4.5 - half) and r.ul == pytest.approx(4.5 + half)
    with pytest.raises(ValueError):
        ST.interval(means, 0.95, "bogus")


def test_xxhash64_paths_agree(cells01):
    a = RS.bootstrap_means(cells01, 6, 4, 11, algo="xxhash64", method="array")
    b = RS.bootstrap_means(cells01.repartition(5), 6, 4, 11, algo="xxhash64", method="join")
    key = ["exp", "trial_name", "sample_size", "iteration"]
    ra, rb = a.orderBy(*key).collect(), b.orderBy(*key).collect()
    assert len(ra) == len(rb) == 150 * 6 * 4
    assert all(x.mean_rating == pytest.approx(y.mean_rating, abs=1e-12) for x, y in zip(ra, rb))
    s = RS.rater_samples(cells01, (3, 5), 2, 1, algo="xxhash64").groupBy("exp", "n", "iter").count().collect()
    assert {r["count"] for r in s} == {3, 5}


def test_arrow_engine_reproducible(cells01):
    key = ["exp", "trial_name", "sample_size", "iteration"]
    a = RS.bootstrap_means(cells01.coalesce(1), 8, 5, 3, method="arrow").orderBy(*key).collect()
    b = RS.bootstrap_means(cells01.repartition(9), 8, 5, 3, method="arrow").orderBy(*key).collect()
    assert len(a) == 150 * 8 * 5 and a == b
    # a mean of centred ratings lies within the stimulus' centred range; n=1 means are single ratings
    c = RS.centred(cells01).groupBy("exp", "trial_name").agg(F.collect_set("rating_c").alias("vals")).collect()
    vals = {(r.exp, r.trial_name): set(r.vals) for r in c}
    for r in a:
        if r.sample_size == 1:
            assert any(abs(r.mean_rating - v) < 1e-12 for v in vals[(r.exp, r.trial_name)])


def test_grouped_quantile_hot_groups(spark):
    from normsmith.operators.quantile import grouped_quantile

    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.lognormal(2, 1.5, 20000)]
    rows += [("tie", 3.5)] * 3000 + [("tie", 9.0)] * 10
    rows += [("small", float(v)) for v in (1, 2, 3, 10)] + [("nul", 1.0), ("nul", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    for p in (0.5, 0.01, 0.9):
        got = {r.g: r.q for r in grouped_quantile(df, ["g"], "x", p).collect()}
        want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", p).alias("q")).collect()}
        assert set(got) == set(want)
        for g in want:
            assert got[g] == pytest.approx(want[g], rel=1e-12), (g, p)
    strict = {r.g: r.q for r in grouped_quantile(df, ["g"], "x", 0.5, strict=True).collect()}
    assert strict["nul"] is None and strict["small"] == 2.5


def test_percentile_interval_large_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("T", 1, float(v)) for v in rng.normal(0, 1, 3000)] + [("T", 2, float(v)) for v in range(10)]
    df = spark.createDataFrame(rows, "exp string, sample_size long, mean_rating double").repartition(4)
    a = {r.sample_size: (r.ll, r.ul) for r in ST.percentile_interval(df).collect()}
    b = {r.sample_size: (r.ll, r.ul) for r in ST.percentile_interval(df).collect()}
    assert a == b
    s = sorted(v for _, n, v in rows if n == 1)
    assert a[1] == (s[75 - 1], s[3000 - 75 - 1])


def test_rater_samples_sizes(cells01):
    s = RS.rater_samples(cells01, (3, 25), 4, 5)
    counts = {(r.exp, r.n, r.iter): r["count"] for r in s.groupBy("exp", "n", "iter").count().collect()}
    assert set(counts.values()) == {3} and len(counts) == 12   # n = 25 exceeds the 20 raters: skipped


def test_arrow_engine_holds_no_stimulus_in_a_row(spark, cells01):
    """The draws are those of NumPy on the ratings ordered by rater, and no
    row collects the ratings of a stimulus."""
    import numpy as np
    from pyspark.sql import functions as F

    out = RS.bootstrap_means(cells01, 6, 4, 3, method="arrow")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__r" not in plan and "collect_list(struct(pos" not in plan
    ratings = {}
    for r in RS.centred(cells01).orderBy("pos").collect():
        ratings.setdefault((r.exp, r.trial_name), []).append(r.rating_c)
    sizes = spark.range(1, 7).withColumnRenamed("id", "sample_size")
    keys = cells01.select("exp", "trial_name").distinct().crossJoin(sizes).withColumn(
        "key", F.xxhash64(F.lit(3).cast("long"), "exp", "trial_name", "sample_size"))
    want = {}
    for r in keys.collect():
        x = np.array(ratings[r.exp, r.trial_name])
        rng = np.random.Generator(np.random.Philox(key=r.key & 0xFFFFFFFFFFFFFFFF))
        for i, m in enumerate(x[rng.integers(0, len(x), size=(4, r.sample_size))].mean(axis=1)):
            want[r.exp, r.trial_name, r.sample_size, i] = m
    got = {(r.exp, r.trial_name, r.sample_size, r.iteration): r.mean_rating for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quantile_counts_nan_as_largest(spark):
    from normsmith.operators.quantile import grouped_quantile, order_statistics

    rows = [("n", float(v)) for v in (5, 7, "nan", 9, 11)] + [("o", 1.0), ("o", None), (None, 2.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q for r in grouped_quantile(df, ["g"], "x", 0.5).collect()}
    assert got == {"n": 9.0, "o": 1.0, None: 2.0, "e": None}
    top = {r.g: (r.n_values, r.n_rows, r.t) for r in order_statistics(df, ["g"], "x", {"t": F.lit(4)}).collect()}
    assert math.isnan(top["n"][2]) and top["n"][:2] == (5, 5)
    assert top["o"] == (1, 2, None) and top["e"] == (0, 1, None)
    assert grouped_quantile(df.limit(0), ["g"], "x", 0.5).collect() == []


def test_positions_of_one_large_group(spark):
    """A million raters of one stimulus, ids with a long common prefix: the
    positions are those of a plain sort and no partition holds much more than
    the others."""
    from normsmith.operators.ranks import PLACE_BITS, sorted_rows, with_positions

    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("s1").alias("stim"), F.concat(F.lit("rater_"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("r"))
    rows = rows.repartition(8, "r")
    got = with_positions(rows, ["stim"], ["r"])
    bad = got.where((F.col("pos") != F.substring("r", 7, 7).cast("long")) | (F.col("n_rows") != n)).count()
    assert bad == 0 and got.count() == n
    sizes = [r["count"] for r in sorted_rows(rows, ["stim"], ["r"]).groupBy(
        F.shiftright("__at", PLACE_BITS)).count().collect()]
    assert max(sizes) <= 1.5 * sorted(sizes)[len(sizes) // 2]


def test_positions_of_many_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(g if g else None, float(x)) for g, x in zip(rng.integers(0, 40, 3000).tolist(), rng.random(3000))]
    df = spark.createDataFrame(rows, "g long, x double").repartition(6)
    from normsmith.operators.ranks import with_positions

    groups = {}
    for g, x in sorted(rows, key=lambda t: t[1]):
        groups.setdefault(g, []).append(x)
    for r in with_positions(df, ["g"], ["x"]).collect():
        assert groups[r.g][r.pos] == r.x and r.n_rows == len(groups[r.g])


def test_first_match_behind_a_line_end(spark):
    from normsmith.functions.text import first_match_removed

    df = spark.createDataFrame([("x\ny a- z a-",), ("a-b",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(first_match_removed(F.col("t"), "a-")).collect()] == ["x\ny  z a-", "b", "none", None]
