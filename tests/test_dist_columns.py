"""Beta, F and t as Columns against the scalar functions; both forms of the
bounds in one session."""

import pytest
from pyspark.sql import functions as F

from normsmith.functions import dist
from normsmith.functions import dist_columns as DC
from normsmith.operators import agreement as AG


def test_quantiles_and_tails(spark):
    rows = [(float(a), float(b)) for a in (1, 2.5, 5, 49, 1234.5) for b in (1, 3.3, 40.2, 5000.0)]
    df = spark.createDataFrame(rows, "d1 double, d2 double")
    a, b = F.col("d1"), F.col("d2")
    got = df.select(a, b, DC.f_quantile(0.975, a, b).alias("f"), DC.t_quantile(0.975, a).alias("t"),
                    DC.t_two_sided(F.lit(-2.1), b).alias("p"), DC.t_two_sided(F.lit(40.0), b).alias("far")).collect()
    for r in got:
        assert r.f == pytest.approx(dist.f_ppf(0.975, r.d1, r.d2), rel=1e-8)
        assert r.t == pytest.approx(dist.t_ppf(0.975, r.d1), rel=1e-9)
        assert r.p == pytest.approx(dist.t_two_sided(2.1, r.d2), rel=1e-9)
        assert r.far == pytest.approx(dist.t_two_sided(40.0, r.d2), rel=1e-8)


def test_impossible_parameters_are_null(spark):
    null = F.lit(None).cast("double")
    row = spark.range(1).select(
        DC.f_quantile(0.975, null, F.lit(3.0)), DC.f_quantile(0.975, F.lit(0.5), F.lit(3.0)),
        DC.t_quantile(0.975, F.lit(-1.0)), DC.t_two_sided(null, F.lit(5.0)), DC.t_two_sided(F.lit(0.0), F.lit(9.0))).first()
    assert tuple(row) == (None, None, None, None, 1.0)


def test_bounds_equal_the_array_form(spark):
    rows = [("a", 8.0, 2.0, 1.5, 20, 6), ("b", 3.0, 1.0, 2.0, 50, 30), ("c", 1.0, 1.0, 0.0, 9, 9), ("d", 5.0, 4.0, 1.0, 2, 2)]
    lower, upper = dist.icc2k_bounds_array(*zip(*[r[1:] for r in rows]))  # on the driver first
    df = spark.createDataFrame(rows, "exp string, msb double, msj double, mse double, n_stimuli long, n_raters long")
    got = {r.exp: r for r in AG.with_icc_bounds(df.withColumn("icc2k", F.lit(0.5))).collect()}
    for k, r in enumerate(rows):
        for g, w in ((got[r[0]].icc2k_lower, lower[k]), (got[r[0]].icc2k_upper, upper[k])):
            assert g == pytest.approx(w, rel=1e-8) if w == w else g is None
