"""End-to-end run from export files made from the driver tables."""

import json

import pytest
from pyspark.sql import functions as F

from normsmith.functions.text import TITLE_EXAMPLE, TRIAL_FOLDERS
from data_paths import SF01
from normsmith.plans import study
from normsmith.sources import files as FS
from normsmith.sources import tables as S

EXP_IDS = {"A": (1384, "attractive"), "N": (1385, "dominant"), "R": (1386, "trustworthy")}


@pytest.fixture(scope="module")
def exports(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("exports")
    r = S.ratings(spark, SF01)
    exp_id = F.when(F.col("exp") == "A", 1384).when(F.col("exp") == "N", 1385).otherwise(1386)
    name = F.when(F.col("trial_name").startswith("check_"), F.concat(F.lit("attention_checks/"), "trial_name")) \
        .otherwise(F.concat(F.lit(TRIAL_FOLDERS[0] + "/"), "trial_name"))
    trials = r.select(
        "session_id", F.lit(1136).alias("project_id"), F.lit("x").alias("exp_name"), exp_id.alias("exp_id"),
        F.col("session_id").alias("user_id"), F.lit("f").alias("user_sex"), F.lit("guest").alias("user_status"),
        F.lit(30.0).alias("user_age"), name.alias("trial_name"), F.lit(1).alias("trial_n"), F.lit(1).alias("order"),
        F.col("dv").cast("string").alias("dv"), "rt", F.lit("l").alias("side"),
        # a strict time order: ship date plus the source key as microseconds
        (F.col("dt").cast("timestamp") + F.make_interval(secs=(F.col("l_orderkey") * 8 + F.col("l_linenumber")) / 1e6))
        .alias("dt"),
    )
    FS.write_table(trials, str(d / "trials"), fmt="csv")
    sessions = r.select("session_id").distinct()
    quest = sessions.select("session_id", F.lit("try").alias("q_name"),
                            F.when(F.col("session_id") == 6, "1").otherwise("2").alias("dv"),
                            F.lit("2024-01-02 10:00:00").cast("timestamp").alias("endtime"),
                            F.lit("guest").alias("user_status")).unionByName(
        sessions.select("session_id", F.lit("age").alias("q_name"), F.lit("25.7").alias("dv"),
                        F.lit("2024-01-02 10:00:00").cast("timestamp").alias("endtime"),
                        F.lit("guest").alias("user_status")))
    FS.write_table(quest, str(d / "quest"), fmt="csv")
    comps = []
    for code, (eid, label) in EXP_IDS.items():
        trials_list = [{"trial_n": i + 1, "name": f"{TRIAL_FOLDERS[0]}/s{i}", "center_img": i} for i in range(50)]
        trials_list += [{"trial_n": 51 + j, "name": f"attention_checks/check_{s}_{k}", "center_img": 100 + j}
                        for j, (s, k) in enumerate([(s, k) for s in "fo" for k in range(1, 8)])]
        comps.append({"component_type": "exp", "id": eid, "name": label,
                      "res_name": TITLE_EXAMPLE + label, "exptype": "rating", "total_stim": 64,
                      "trial": trials_list, "stimuli": {str(t["center_img"]): f"img/{t['center_img']}.jpg"
                                                         for t in trials_list}})
    comps.append({"component_type": "quest", "id": 1, "name": "q", "res_name": "Questionnaire", "trial": [],
                  "stimuli": {}})
    (d / "project.json").write_text(json.dumps(comps))
    with open(d / "models.csv", "w", encoding="utf-8") as fh:
        fh.write("﻿ID,std_neu,age,ethnicity,gender,height,height_units,weight,weight_units\n")
        fh.write("L01_0001,1,25,White,Mulher,66,cm,70,lb\nL01_0002_x,0,NULL,n/a,NULL,188,in,0,kg\n")
        fh.write("L02_0003,1,31,preta,hetero cis,170,NULL,NA,NULL\n")
    (d / "gender.csv").write_text("gender,gender_rec\nmulher,female\nhetero cis,NA\n")
    return d


def test_prepare_and_agreement(spark, exports, tmp_path):
    d = exports
    cfg = study.StudyConfig(first_task_only=False, substring_task=None, corridor_sizes=(3, 5), corridor_iters=4,
                            boot_n=5, boot_iters=4)
    prep = study.prepare(spark, str(d / "trials"), str(d / "quest"), str(d / "project.json"), cfg,
                         models=str(d / "models.csv"), gender_recode=str(d / "gender.csv"))
    led = {(r.session_id, r.exp_id) for r in prep["exclusions"].collect()}
    assert led == {(1, 1384), (2, 1385), (3, 1384), (3, 1385), (3, 1386), (4, 1386), (6, None)}
    sessions = sorted(r.session_id for r in prep["data_exp"].select("session_id").distinct().collect())
    assert sessions == [0] + list(range(7, 20))
    assert prep["data_exp"].where(F.col("trial_name").contains("check")).count() == 0
    assert {r.exp for r in prep["data_exp"].select("exp").distinct().collect()} == {"attractive", "dominant",
                                                                                   "trustworthy"}
    flow = {r.step: r.n for r in prep["flow"].collect()}
    assert flow["initial_raters"] == 20 and flow["excluded_raters"] == 7 and flow["final_raters"] == 14
    q = prep["data_quest"].collect()
    assert len(q) == 14 and all(r.age == 25 for r in q)
    m = {r.model_id: r for r in prep["data_models"].collect()}
    assert m["0001"].lab_id == "L01" and m["0001"].height_cm == pytest.approx(167.64) and m["0001"].weight_kg == 70
    assert m["0001"].gender_rec == "female" and m["0003"].gender_rec == "NA" and m["0002"].age is None
    assert m["0002"].height_cm == 188 and m["0002"].weight_kg is None
    study.write_all(prep, str(tmp_path / "out"))
    data_exp = spark.read.parquet(str(tmp_path / "out" / "data_exp"))
    agr = study.agreement(data_exp, cfg)
    icc = {r.exp: r for r in agr["icc_trait"].collect()}
    assert set(icc) == {"attractive", "dominant", "trustworthy"}
    assert all(0 < r.icc2k <= 1 and r.icc2k_lower < r.icc2k < r.icc2k_upper and r.n_raters == 14 for r in icc.values())
    assert icc["attractive"].icc2k > icc["dominant"].icc2k > icc["trustworthy"].icc2k
    assert agr["icc_corridor"].count() == 3 * 2 * 4
    assert agr["pos_trait"].count() == 3 and agr["icc_unstd"].count() == 0
    study.write_all({k: v for k, v in agr.items() if k.endswith("trait") or k.startswith("icc_")},
                    str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "icc_thresholds")).count() == 3
