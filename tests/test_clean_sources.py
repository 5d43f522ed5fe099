"""Recodes, unit rules, reshaping, and file sources."""

import os

import pytest
from pyspark.sql import functions as F

from normsmith.functions.text import TITLE_EXAMPLE, TRIAL_FOLDERS
from data_paths import SF001
from normsmith.functions.text import first_match_removed, format_p, split_parts, strip_prefix, task_label
from normsmith.operators import clean as CL
from normsmith.operators import reshape as RE
from normsmith.sources import files as FS
from normsmith.sources import tables as S


def test_unit_rules_examples(spark):
    rows = [(66.0, "cm", 70.0, "lb"), (188.0, "in", 0.0, "kg"), (70.0, "in", 150.0, "lb"), (170.0, "cm", 60.0, "kg"),
            (170.0, None, 60.0, "st")]
    df = spark.createDataFrame(rows, "h double, hu string, w double, wu string")
    got = df.select(CL.height_cm(F.col("h"), F.col("hu")).alias("cm"), CL.weight_kg(F.col("w"), F.col("wu")).alias("kg")).collect()
    assert got[0].cm == pytest.approx(167.64) and got[0].kg == 70.0
    assert got[1].cm == 188.0 and got[1].kg is None
    assert got[2].cm == pytest.approx(177.8) and got[2].kg == pytest.approx(150 / 2.20462)
    assert got[3].cm == 170.0 and got[3].kg == 60.0
    assert got[4].cm is None and got[4].kg is None


def test_recode_na_label_and_gaps(spark):
    table = CL.lookup_table(spark, [("Mulher", "female"), ("hetero cis", "NA")], "gender", "gender_rec")
    df = spark.createDataFrame([("MULHER",), ("Hetero Cis",), ("other",), (None,)], "gender string")
    got = [r.gender_rec for r in CL.recode(df, "gender", table, "gender_rec").orderBy("gender").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [None, "female", None, None]))
    kept = [r.gender_rec for r in CL.recode(df, "gender", table, "gender_rec", keep_na_label=True).collect()]
    assert "NA" in kept
    with pytest.raises(ValueError):
        CL.lookup_table(spark, [("a", "x"), ("A", "y")], "k", "v")


def test_level_counts_keeps_zero_levels(spark):
    lv = CL.level_table(spark, ["a", "b", "z"])
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("q",), (None,)], "x string")
    got = {(r.label, r.ord): r.n for r in CL.level_counts(df, "x", lv).collect()}
    assert got == {("a", 1): 2, ("b", 2): 1, ("z", 3): 0, (None, None): 2}


def test_text_functions(spark):
    df = spark.createDataFrame([("check_o_3 check_x_4",), ("Study Ratings:  Attractive ",),
                                ("attention_checks/check_a_1",)], "s string")
    r = df.select(first_match_removed(F.col("s"), "check_[a-z0-9-]+_").alias("a"), task_label(F.col("s")).alias("b"),
                  strip_prefix(F.col("s")).alias("c")).collect()
    assert r[0].a == "3 check_x_4"
    assert r[1].b == "Attractive"
    assert r[2].c == "check_a_1"
    p = spark.createDataFrame([(0.0004,), (0.0456,)], "p double").select(format_p(F.col("p")).alias("p")).collect()
    assert [x.p for x in p] == ["<.001", ".046"]
    with pytest.raises(Exception):
        spark.createDataFrame([("L01",)], "id string").select(*split_parts(F.col("id"), "_", ("lab", "model"))).collect()


def test_eav_repeated_answer(spark):
    rows = [(1, "age", "25", 1), (1, "try", "2", 1), (1, "try", "1", 2), (2, "age", "30", 1)]
    df = spark.createDataFrame(rows, "session_id long, q_name string, dv string, t long")
    wide = {r.session_id: (r.age, r["try"]) for r in RE.eav_to_wide(df, ["session_id"], "q_name", "dv", ["age", "try"], order="t").collect()}
    assert wide == {1: ("25", "1"), 2: ("30", None)}
    with pytest.raises(Exception):
        RE.eav_to_wide(df, ["session_id"], "q_name", "dv", ["age", "try"]).collect()


def test_project_json_file(spark, tmp_path):
    proj = [
        {"component_type": "exp", "id": 1384, "name": "attr", "res_name": TITLE_EXAMPLE + "attractive",
         "exptype": "rating", "total_stim": 2,
         "trial": [{"trial_n": 1, "name": TRIAL_FOLDERS[0] + "/lab1_m1", "center_img": 11},
                   {"trial_n": 2, "name": "attention_checks/check_o_3", "center_img": 12}],
         "stimuli": {"11": "img/a.jpg", "12": "img/b.jpg"}},
        {"component_type": "quest", "id": 9, "name": "q", "res_name": "Questionnaire", "trial": [], "stimuli": {}},
    ]
    import json
    path = tmp_path / "project.json"
    path.write_text(json.dumps(proj, indent=2))
    comps = FS.read_project_json(spark, str(path), RE.PROJECT)
    tasks = RE.task_dimension(comps).collect()
    assert [(r.exp_id, r.exp, r.trials, r.stim) for r in tasks] == [(1384, "attractive", 2, 2)]
    trials = sorted(RE.trial_dimension(comps).collect(), key=lambda r: r.n)
    assert [(r.name, r.img_path) for r in trials] == [("lab1_m1", "img/a.jpg"), ("check_o_3", "img/b.jpg")]


def test_csv_sources(spark, tmp_path):
    ev = S.trial_log(spark, SF001).select("session_id", "exp", "rt", "event_id").withColumn(
        "user_status", F.when(F.col("session_id") % 4 == 0, "admin").otherwise("guest"))
    d = str(tmp_path / "exp")
    # two overlapping pages, as a paged export gives
    FS.write_table(ev.where(F.col("event_id") < 600), d + "/page1", fmt="csv")
    FS.write_table(ev.where(F.col("event_id") >= 400), d + "/page2", fmt="csv")
    schema = "session_id long, exp string, rt double, event_id long, user_status string"
    got = FS.read_export_dir(spark, d + "/*/*.csv", schema)
    want = ev.distinct().where(F.col("user_status") == "guest")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    # latest-file pick by name
    lf = str(tmp_path / "raw")
    os.makedirs(lf)
    for day, n in (("2025-01-01", 3), ("2025-02-01", 5)):
        with open(f"{lf}/exps_{day}.csv", "w") as fh:
            fh.write("a,b\n" + "".join(f"{i},x{day}\n" for i in range(n)))
    latest = FS.latest_file(spark, lf, "exps_*.csv", "a int, b string")
    assert latest.count() == 5 and latest.select("b").distinct().first().b == "x2025-02-01"
    # NA tokens: default reader drops them, recode-table reader keeps text NA
    rec = tmp_path / "recode.csv"
    rec.write_text("gender,gender_rec\nmulher,female\nhetero cis,NA\nnone,\n")
    kept = FS.read_csv(spark, str(rec), "gender string, gender_rec string", null_value="", tokens=None).collect()
    assert [r.gender_rec for r in kept] == ["female", "NA", None]
    dropped = FS.read_csv(spark, str(rec), "gender string, gender_rec string").collect()
    assert [r.gender_rec for r in dropped] == ["female", None, None]


def test_page_and_fingerprint(spark, tmp_path):
    df = spark.range(0, 103).withColumnRenamed("id", "k")
    pages = [FS.page(df, ["k"], 25, i).collect() for i in range(5)]
    assert [len(p) for p in pages] == [25, 25, 25, 25, 3]
    assert pages[1][0].k == 25
    a = FS.fingerprint(df).first()
    b = FS.fingerprint(df.repartition(7)).first()
    c = FS.fingerprint(df.union(spark.range(0, 1).withColumnRenamed("id", "k"))).first()
    assert a == b and a.fingerprint != c.fingerprint and c.n_rows == 104


def test_run_or_load_reuses(spark, tmp_path):
    df = spark.range(0, 10)
    calls = []

    def compute():
        calls.append(1)
        return df.withColumn("sq", F.col("id") * F.col("id"))

    root = str(tmp_path / "cache")
    a = FS.run_or_load(spark, "sq", df, {"p": 1}, compute, root)
    b = FS.run_or_load(spark, "sq", df, {"p": 1}, compute, root)
    c = FS.run_or_load(spark, "sq", df, {"p": 2}, compute, root)
    assert len(calls) == 2
    assert sorted(a.collect()) == sorted(b.collect()) == sorted(c.collect())


def test_normalise_nulls(spark):
    from normsmith.functions.nulls import normalise_nulls, to_int_truncating

    df = spark.createDataFrame([("NULL", "x", 1), ("NA", "", 2)], "a string, b string, c int")
    got = normalise_nulls(df).collect()
    assert got[0].a is None and got[0].b == "x" and got[1].b is None and got[1].c == 2
    r = spark.createDataFrame([("25.7",), ("abc",)], "s string").select(to_int_truncating(F.col("s")).alias("i")).collect()
    assert [x.i for x in r] == [25, None]


def test_column_range(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert RE.column_range(df, "b", "d") == ["b", "c", "d"]


def test_task_trials_matches_dimensions(spark):
    from normsmith.plans.queries import packed_projects

    comps = RE.components_from_json(packed_projects(spark, SF001), "project").cache()
    one = RE.task_trials(comps)
    two = RE.trial_dimension(comps).join(RE.task_dimension(comps).select("exp_id", "exp", "trials", "stim"), "exp_id")
    assert one.count() == two.count() > 0
    assert one.exceptAll(two.select(*one.columns)).count() == 0


def test_recode_table_with_repeated_key_is_rejected(spark, tmp_path):
    rec = tmp_path / "rec.csv"
    rec.write_text("gender,gender_rec\nmulher,female\nmulher,woman\n")
    table = FS.read_csv(spark, str(rec), "gender string, gender_rec string", null_value="", tokens=None)
    df = spark.createDataFrame([("Mulher",)], "gender string")
    with pytest.raises(ValueError):
        CL.recode(df, "gender", table, "gender_rec")


def test_pages_open_only_their_ranges(spark):
    """Pages of a large table are those of a plain sort, and reading one
    touches the rows of few partitions."""
    import os

    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("k"), F.col("id").alias("v")).repartition(8)
    export = FS.PagedExport(df, ["k"])
    want = sorted((i * 7919 % 200_003, i) for i in range(200_000))
    for number in (0, 3, 1000, 1999, 2000):
        page = export.page(100, number)
        assert [tuple(r) for r in page.collect()] == want[number * 100 : number * 100 + 100]
    plan = export.page(100, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(__at," in plan and "PushedFilters" in plan
    parts = [e for e in export._directory if e[1] < 100_100 and e[1] + e[2] > 100_000]
    assert 1 <= len(parts) <= 2 < len(export._directory)
    path = export._rows._staged_path.removeprefix("file:")
    export.close()
    assert not os.path.exists(path)


def test_racing_writers_publish_one_result(spark, tmp_path):
    path = str(tmp_path / "result")
    a, b = spark.range(5), spark.range(7)
    assert FS.publish(spark, a, path) is True
    assert FS.publish(spark, b, path) is False
    assert spark.read.parquet(path).count() == 5
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["result"]


def test_cache_knows_files_without_reading(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).write.parquet(src)
    runs_ = []

    def compute():
        runs_.append(1)
        return spark.read.parquet(src).selectExpr("sum(id) as s")

    def load():
        return FS.run_or_load(spark, "sum", spark.read.parquet(src), {}, compute, str(tmp_path / "c"), by_files=True).first().s

    assert (load(), load(), len(runs_)) == (45, 45, 1)
    spark.range(3).write.mode("append").parquet(src)
    assert (load(), len(runs_)) == (48, 2)
