"""Agreement with fractions, absent cells and lone raters; omega held to
proper solutions; bounds of whole columns."""

import numpy as np
import pytest

from normsmith.functions import dist
from normsmith.operators import agreement as AG


def cells(spark, matrix, exp="t", absent=()):
    rows = [(exp, j, f"s{i}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if (i, j) not in absent]
    return spark.createDataFrame(rows, "exp string, session_id long, trial_name string, dv double")


def anova_icc2k(x):
    n, k = x.shape
    msb = k * x.mean(1).var(ddof=1)
    msj = n * x.mean(0).var(ddof=1)
    mse = ((x - x.mean(1, keepdims=True) - x.mean(0) + x.mean()) ** 2).sum() / ((n - 1) * (k - 1))
    return (msb - mse) / (msb + (msj - mse) / n), (msb - mse) / msb


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    return rng.normal(size=(12, 1)) + 0.3 * rng.normal(size=(1, 5)) + 0.8 * rng.normal(size=(12, 5)) + 4


@pytest.mark.parametrize("missing", ["complete", "all"])
def test_fractions_are_not_cut(spark, matrix, missing):
    icc, alpha = anova_icc2k(matrix)
    c = cells(spark, matrix)
    assert AG.icc2k(c, missing=missing).first().icc2k == pytest.approx(icc, abs=1e-9)
    assert AG.cronbach_alpha(c, missing=missing).first().alpha == pytest.approx(alpha, abs=1e-9)


def test_absent_cells(spark, matrix):
    absent = {(i, i % 5) for i in range(12)}
    c = cells(spark, matrix, absent=absent).union(cells(spark, matrix[:, :1], "alone"))
    all_ = {r.exp: r for r in AG.icc2k(c, missing="all").collect()}
    assert all_["t"].n_cells_missing == 12 and abs(all_["t"].icc2k - anova_icc2k(matrix)[0]) < 0.15
    assert all_["alone"].icc2k is None and all_["alone"].n_raters == 1
    part = {r.exp: r for r in AG.icc2k(c).collect()}
    assert part["t"].icc2k is None and part["t"].n_stimuli_dropped == 12 and part["t"].n_cells_dropped == 48
    alpha = {r.exp: r for r in AG.cronbach_alpha(c, missing="all").collect()}
    assert alpha["t"].estimator == "components" and 0 < alpha["t"].alpha < 1


def test_all_raters_screened_out(spark):
    r = AG.icc2k(cells(spark, np.ones((6, 3)))).collect()
    assert [(x.exp, x.n_raters, x.icc2k) for x in r] == [("t", 0, None)]


def test_null_task_is_a_task(spark, matrix):
    c = cells(spark, matrix, exp=None)
    for missing in ("complete", "all"):
        r = AG.icc2k(c, missing=missing).collect()
        assert len(r) == 1 and r[0].exp is None and r[0].icc2k == pytest.approx(anova_icc2k(matrix)[0], abs=1e-9)


@pytest.mark.parametrize("a,b,c", [(0.9, 0.8, 0.6), (0.85, 0.85, 0.5)])
def test_omega_stays_proper(a, b, c):
    r = np.array([[1, a, b], [a, 1, c], [b, c, 1]])
    loadings, converged = AG.one_factor_minres(r, flag=True)
    assert converged and (loadings**2).max() <= 1 - AG.MIN_UNIQUENESS + 1e-12
    assert AG.omega_from_corr(r) < 1


def test_bounds_of_columns():
    rows = [(8.0, 2.0, 1.5, 20, 6), (3.0, 1.0, 2.0, 50, 30), (1.0, 1.0, 0.0, 9, 9), (5.0, 4.0, 1.0, 2, 2)]
    lower, upper = dist.icc2k_bounds_array(*zip(*rows))
    for got, want in zip(zip(lower, upper), (dist.icc2k_bounds(*r) for r in rows)):
        assert got == pytest.approx(want, rel=1e-9, nan_ok=True)


def test_small_p_values_do_not_cancel():
    assert 0 < dist.t_two_sided(40.0, 100) < 1e-60
    assert dist.t_two_sided(1.984, 100) == pytest.approx(0.05, abs=1e-4)
