"""Screening operators on tiny hand-made inputs."""

import datetime as dt


from normsmith.operators import quality as Q

SCHEMA = "session_id long, exp string, trial_name string, dv string, rt double, dt timestamp"


def t(day):
    return dt.datetime(2024, 1, day)


def test_keep_first_orders_nulls_last(spark):
    rows = [(1, "A", "s1", "5", 1.0, None), (1, "A", "s1", "3", 2.0, t(2)), (1, "A", "s1", "4", 3.0, t(3)),
            (1, "A", "s2", "1", 1.0, t(1))]
    out = Q.keep_first(spark.createDataFrame(rows, SCHEMA), ["session_id", "exp", "trial_name"], ["dt"])
    got = {r.trial_name: r.dv for r in out.collect()}
    assert got == {"s1": "3", "s2": "1"}


def test_first_task_modes(spark):
    rows = [(1, "B", "s1", "1", 1.0, t(1)), (1, "A", "s1", "1", 1.0, t(2)), (2, "A", "s1", "1", 1.0, t(5)),
            (3, "B", "s1", "1", 1.0, t(3)), (3, "A", "s1", "1", 1.0, t(3))]
    df = spark.createDataFrame(rows, SCHEMA)
    first = sorted((r.session_id, r.exp) for r in Q.first_task(df).collect())
    assert first == [(1, "B"), (2, "A"), (3, "A")]  # tie on time -> lowest task key
    as_written = sorted((r.session_id, r.exp) for r in Q.first_task(df, keep="as_written").collect())
    assert as_written == [(1, "A"), (2, "A"), (3, "B")]


def test_incomplete_scopes(spark):
    rows = [(1, "A", "s1", "1", 1.0, t(1)), (1, "A", "s2", "1", 1.0, t(1)), (1, "B", "s1", "1", 1.0, t(1)),
            (2, "B", "s1", "1", 1.0, t(1)), (2, "B", "s2", "1", 1.0, t(1))]
    df = spark.createDataFrame(rows, SCHEMA)
    tasks = spark.createDataFrame([("A", 2), ("B", 2)], "exp string, trials_total long")
    inc = Q.incomplete_tasks(df, tasks)
    assert [(r.session_id, r.exp) for r in inc.collect()] == [(1, "B")]
    assert Q.drop_incomplete(df, inc, "session").select("session_id").distinct().count() == 1
    assert Q.drop_incomplete(df, inc, "task").count() == 4


def test_modal_share_counts_missing(spark):
    rows = [(1, "A", f"s{i}", v, 1.0, t(1)) for i, v in enumerate(["1"] * 9 + [None])] + \
           [(2, "A", f"s{i}", v, 1.0, t(1)) for i, v in enumerate(["1", "2", None, None])] + \
           [(3, "A", "check_x_1", "1", 1.0, t(1))] * 5 + [(3, "A", "s1", "2", 1.0, t(1)), (3, "A", "s2", "3", 1.0, t(1)),
                                                          (3, "A", "s3", "4", 1.0, t(1))]
    prof = {r.session_id: (r.same_pcnt, r.n_unique) for r in Q.response_profile(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert prof[1] == (0.9, 1)
    assert prof[2] == (0.5, 2)
    assert prof[3] == (1 / 3, 3)  # check trials left out
    oc = {r.session_id: (r.same_pcnt, r.n_unique) for r in Q.overly_consistent(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert oc == {1: (0.9, 1), 2: (None, 2)}


def test_median_strict_and_fast(spark):
    rows = [(s, "A", f"s{i}", "1", float(s * 10 + i), t(1)) for s in range(1, 101) for i in range(3)]
    rows.append((101, "A", "s1", "1", None, t(1)))
    df = spark.createDataFrame(rows, SCHEMA)
    med = {r.session_id: r.med_rt for r in Q.median_rt(df).collect()}
    assert med[1] == 11.0 and med[101] is None
    fast = [r.session_id for r in Q.overly_fast(df).collect()]
    assert fast == [1]  # 1% quantile of 11, 21, ... lies between the two smallest


def test_attention_rate_and_substring_task(spark):
    rows = [(1, "A", f"check_o_{k}", str(k), 1.0, t(1)) for k in range(1, 8)] + \
           [(2, "A", f"check_o_{k}", str(k if k > 2 else 9), 1.0, t(1)) for k in range(1, 8)] + \
           [(3, "X", "check_p_abc123", "123", 1.0, t(1)), (3, "X", "check_p_abc124", "999", 1.0, t(1)),
            (4, "A", "check_o_1", None, 1.0, t(1))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.session_id, r.exp): r.attn_checks_passed for r in Q.attention_failed(df, substring_task="X").collect()}
    assert got == {(2, "A"): 5 / 7, (3, "X"): 0.5}   # 6/7 passes; a missing answer is never flagged


def test_ledger_keeps_honesty_row_separate(spark):
    s = "session_id long, exp string"
    cons = spark.createDataFrame([(1, "A", 1.0, 1)], s + ", same_pcnt double, n_unique long")
    fast = spark.createDataFrame([(1, "A", 10.0)], s + ", med_rt double")
    hon = spark.createDataFrame([(2, 1), (1, 3)], "session_id long, honesty_check long")
    att = spark.createDataFrame([(2, "B", 0.5)], s + ", attn_checks_passed double")
    led = Q.exclusion_ledger(cons, fast, hon, att).collect()
    assert sorted((r.session_id, str(r.exp)) for r in led) == [(1, "A"), (2, "B"), (2, "None")]
    first = [r for r in led if r.session_id == 1][0]
    assert first.honesty_check == 3 and first.med_rt == 10.0
    counts = {r.reason: r.n for r in Q.exclusion_counts(Q.exclusion_ledger(cons, fast, hon, att)).collect()}
    assert counts == {"same_pcnt": 1, "n_unique": 1, "med_rt": 1, "honesty_check": 2, "attn_checks_passed": 1,
                      "total": 3}
