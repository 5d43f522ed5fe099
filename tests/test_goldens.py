"""Expected answers at sf0.01 (FIXTURES.md §5), obtained alike from Spark
and DuckDB on the ratings adapter."""

import pytest
from pyspark.sql import functions as F

from data_paths import SF01
from normsmith.operators import agreement as AG
from normsmith.operators import resample as RS
from normsmith.operators import stability as ST
from normsmith.plans import flows


def test_keep_first_rows_and_sum(spark):
    r = flows.firsts(spark, SF01).agg(F.count("*").alias("n"), F.sum("dv").alias("s")).first()
    assert (r.n, r.s) == (3839, 15209)


@pytest.fixture(scope="module")
def subset(cells01):
    return cells01.where(~F.col("session_id").isin(1, 2, 5))


def test_icc2k_subset(subset):
    got = {r.exp: r for r in AG.icc2k(subset, min_values=None).collect()}
    for exp, want in {"A": 0.949958, "N": 0.854009, "R": 0.613004}.items():
        assert got[exp].n_raters == 17 and got[exp].n_stimuli == 50
        assert got[exp].icc2k == pytest.approx(want, abs=5e-7)


def test_alpha_subset(subset):
    got = {r.exp: r.alpha for r in AG.cronbach_alpha(subset, min_values=None).collect()}
    for exp, want in {"A": 0.951081, "N": 0.854717, "R": 0.613225}.items():
        assert got[exp] == pytest.approx(want, abs=5e-7)


def test_corridor_medians(subset):
    cor = RS.icc_corridor(subset, (3, 5, 10, 15), 20, 123)
    got = {(r.exp, r.n): round(r.icc_median, 3) for r in RS.corridor_summary(cor).collect()}
    want = {
        "A": (0.769, 0.859, 0.918, 0.944),
        "N": (0.522, 0.639, 0.770, 0.839),
        "R": (0.218, 0.279, 0.468, 0.558),
    }
    for exp, vals in want.items():
        for n, v in zip((3, 5, 10, 15), vals):
            assert got[(exp, n)] == pytest.approx(v, abs=1e-9)


def test_point_of_stability(subset):
    res = ST.stability_stats(subset, N=20, iterations=20, cos_threshold=0.75, seed=123)
    assert {r.exp: r.pos for r in res.pos.collect()} == {"A": 8, "N": 14, "R": 20}


def test_screening_finds_planted_raters(spark):
    s = flows.rating_flow(spark, SF01)
    inc = s.incomplete.collect()
    assert [(r.session_id, r.exp, r.n, r.trials_total) for r in inc] == [(5, "R", 63, 64)]
    cons = {(r.session_id, r.exp): (r.same_pcnt, r.n_unique) for r in s.consistent.collect()}
    assert cons == {(1, "A"): (1.0, 1), (2, "N"): (None, 2)}
    assert [(r.session_id, r.exp) for r in s.fast.collect()] == [(4, "R")]
    att = {(r.session_id, r.exp): round(r.attn_checks_passed, 4) for r in s.attention.collect()}
    assert att == {(3, "A"): 0.5714, (3, "N"): 0.7857, (3, "R"): 0.5}
    assert [r.session_id for r in s.honesty.collect()] == [6]
    led = s.ledger.collect()
    assert len(led) == 7
    hon = [r for r in led if r.honesty_check is not None]
    assert len(hon) == 1 and hon[0].exp is None
    final_sessions = sorted(r.session_id for r in s.final.select("session_id").distinct().collect())
    assert final_sessions == [0] + list(range(7, 20))
