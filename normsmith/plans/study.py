"""End-to-end study run from export files, as the reference's two scripts
do: data preparation (project JSON, trial and questionnaire exports, model
sheet, recode tables -> cleaned ratings, exclusion ledger) and agreement
(ICC, alpha, omega per task; ICC corridor; points of stability).

    python -m normsmith.plans.study --trials t.csv --quest q.csv \\
        --project project.json --out /shared/results

Inputs are read with declared schemas; every output is a parquet table
under ``--out``.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import normalise_nulls, to_int_truncating
from ..functions.text import TITLE_PATTERN, TRIAL_FOLDERS, split_parts, strip_prefix
from ..operators import agreement as AG
from ..operators import clean as CL
from ..operators import quality as Q
from ..operators import reshape as RE
from ..operators import resample as RS
from ..operators import stability as ST
from ..operators import summaries as SM
from ..session import checkpoint_dir, scratch
from ..sources import files as FS

TRIAL_SCHEMA = (
    "session_id long, project_id int, exp_name string, exp_id int, user_id long, user_sex string, "
    "user_status string, user_age double, trial_name string, trial_n int, `order` int, dv string, rt double, "
    "side string, dt timestamp"
)
QUEST_SCHEMA = "session_id long, q_name string, dv string, endtime timestamp, user_status string"

# Questionnaire items that become columns, the task order and
# the task families.
QUESTIONS = ["age", "gender", "ethnicity", "residence", "device", "try"]
TASK_ORDER = [
    "attractive", "dominant", "trustworthy", "attractive (unstd)", "dominant (unstd)", "trustworthy (unstd)",
    "memorable", "gender-typical", "age", "anger", "disgust", "fear", "happiness", "sadness", "surprise",
    "emotion 1", "emotion 2", "emotion 3", "emotion 4", "emotion 5", "emotion 6",
]
TRAIT_TASKS = ["attractive", "dominant", "trustworthy", "gender-typical", "memorable"]
EMOTION_TASKS = ["anger", "happiness", "disgust", "surprise", "sadness", "fear"]


@dataclass
class StudyConfig:
    substring_task: int | None = 1400          # attention-check answer in characters 4-6 (one task)
    first_task_only: bool = True
    keep: str = "first"
    scope: str = "session"
    corridor_sizes: tuple = tuple(range(10, 101, 10))
    corridor_iters: int = 50
    boot_n: int = 100
    boot_iters: int = 300
    cos_threshold: float = 0.5
    seed: int = 123
    boot_method: str = "values"
    title_pattern: str = TITLE_PATTERN         # the study's title prefix, as a pattern
    trial_folders: tuple = TRIAL_FOLDERS       # folder prefixes of trial names
    families: dict = field(default_factory=lambda: {
        "trait": {"tasks": TRAIT_TASKS},
        "unstd": {"pattern": "unstd"},
        "emotion": {"tasks": EMOTION_TASKS},
        "emotion_category": {"pattern": "^em", "numeric": False},
    })


def prepare(spark: SparkSession, trials: str, quest: str, project: str, cfg: StudyConfig | None = None,
            models: str | None = None, gender_recode: str | None = None, ethnicity_recode: str | None = None,
            quest_ethnicity_recode: str | None = None) -> dict[str, DataFrame]:
    """Data preparation: returns the cleaned tables and the ledger."""
    cfg = cfg or StudyConfig()
    comps = FS.read_project_json(spark, project, RE.PROJECT)
    tasks = RE.task_dimension(comps, cfg.title_pattern).select("exp_id", "exp", F.col("trials").alias("trials_total"))
    raw = FS.read_csv(spark, trials, TRIAL_SCHEMA)
    raw = (
        raw.select("session_id", "exp_id", strip_prefix(F.col("trial_name"), cfg.trial_folders).alias("trial_name"), "dv", "rt", "dt")
        .distinct()
        .join(tasks, "exp_id", "left")
    )
    q_raw = FS.read_csv(spark, quest, QUEST_SCHEMA).select("session_id", "q_name", "dv", "endtime").distinct()
    q_wide = RE.eav_to_wide(q_raw, ["session_id", "endtime"], "q_name", "dv", QUESTIONS)
    q_wide = q_wide.withColumn("age", to_int_truncating(F.col("age"))).withColumn(
        "try_answer", F.col("try"))  # compared as text: any other answer than the honest one fails
    if quest_ethnicity_recode:
        rec = FS.read_csv(spark, quest_ethnicity_recode, "ethnicity string, ethnicity_rec string", null_value="",
                          tokens=None)
        q_wide = CL.recode(q_wide, "ethnicity", rec, "ethnicity_rec", keep_na_label=True)
    levels = spark.createDataFrame([(t, i + 1) for i, t in enumerate(TASK_ORDER)], "exp string, ord int")
    s = Q.screen(
        raw, q_wide, ["dt"], tasks=tasks.select(F.col("exp_id"), "trials_total"),
        first_task_only=cfg.first_task_only, keep=cfg.keep, scope=cfg.scope, substring_task=cfg.substring_task,
        task="exp_id",
    )
    final = s.final.join(levels, "exp", "left")
    out = {
        "exp_long": s.exp_long,
        "exclusions": s.ledger,
        "data_exp": final,
        "data_quest": Q.restrict_to(q_wide, final),
        "flow": Q.flow_counts(s, task="exp_id"),
    }
    if models:
        out["data_models"] = prepare_models(spark, models, gender_recode, ethnicity_recode)
    return out


def prepare_models(spark: SparkSession, path: str, gender_recode: str | None, ethnicity_recode: str | None) -> DataFrame:
    """Model sheet: id split into lab/model, text NULL -> null, recodes,
    numeric casts, unit rules (P7, P9-P14)."""
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)  # all text; first name may carry a BOM
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    m = normalise_nulls(raw, ("", "NA", "NULL"))
    m = m.select(*split_parts(F.col("ID"), "_", ("lab_id", "model_id")), *[c for c in m.columns if c != "ID"])
    m = m.withColumn("gender", F.lower("gender")).withColumn("ethnicity", F.lower("ethnicity"))
    if gender_recode:
        g = FS.read_csv(spark, gender_recode, "gender string, gender_rec string", null_value="", tokens=None)
        m = CL.recode(m, "gender", g, "gender_rec", keep_na_label=True)
    if ethnicity_recode:
        e = FS.read_csv(spark, ethnicity_recode, "ethnicity string, ethnicity_rec string", null_value="",
                        tokens=None)
        m = CL.recode(m, "ethnicity", e, "ethnicity_rec", keep_na_label=True)
    for c in ("age", "weight", "height"):
        m = m.withColumn(c, F.col(c).try_cast("double"))
    return m.withColumn("height_cm", CL.height_cm(F.col("height"), F.col("height_units"))).withColumn(
        "weight_kg", CL.weight_kg(F.col("weight"), F.col("weight_units")))


def agreement(data_exp: DataFrame, cfg: StudyConfig | None = None, cache_root: str | None = None) -> dict[str, DataFrame]:
    """Agreement tables per task family: ICC(2,k) with bounds, alpha and
    omega; ICC corridor with its summary and thresholds (trait tasks);
    stability intervals and points of stability.  With ``cache_root`` the
    corridor and the intervals, which take longest, are loaded where a run on
    the same answers with the same parameters has stored them (S11)."""
    cfg = cfg or StudyConfig()
    spark = data_exp.sparkSession

    def stored(name: str, data: DataFrame, params: dict, compute) -> DataFrame:
        return FS.run_or_load(spark, name, data, params, compute, cache_root) if cache_root else compute()

    cells = data_exp.select("exp", "session_id", "trial_name", "dv")
    out: dict[str, DataFrame] = {}
    for fam, sel in cfg.families.items():
        numeric = sel.get("numeric", True)
        sub = AG.task_subset(cells, tasks=sel.get("tasks"), pattern=sel.get("pattern"), numeric=numeric)
        if not numeric:  # categories: counts and shares of the answers
            out[f"counts_{fam}"] = SM.share_within(sub, ["exp", "trial_name"], "dv")
            continue
        # all present cells, as a mixed model would use them
        out[f"icc_{fam}"] = AG.with_icc_bounds(AG.icc2k(sub, missing="all"))
        out[f"alpha_{fam}"] = AG.cronbach_alpha(sub, missing="all").join(
            AG.omega_total(sub).select("exp", "omega_t", "converged"), "exp", "left")
        boot = {"n": cfg.boot_n, "iters": cfg.boot_iters, "seed": cfg.seed, "method": cfg.boot_method}
        cis = stored(f"stability_ci_{fam}", sub, boot, lambda: ST.stability_stats(
            sub, cfg.boot_n, cfg.boot_iters, cos_threshold=cfg.cos_threshold, seed=cfg.seed, method=cfg.boot_method).cis)
        out[f"stability_ci_{fam}"] = cis
        out[f"pos_{fam}"] = ST.point_of_stability(cis, cfg.cos_threshold)
    trait = AG.task_subset(cells, tasks=cfg.families["trait"].get("tasks"))
    grid = {"sizes": list(cfg.corridor_sizes), "iters": cfg.corridor_iters, "seed": cfg.seed}
    corridor = stored("icc_corridor", trait, grid, lambda: RS.full_corridor(
        trait, cfg.corridor_sizes, cfg.corridor_iters, cfg.seed))
    summary = RS.corridor_summary(corridor)
    out["icc_corridor"] = corridor
    out["icc_corridor_summary"] = summary
    out["icc_thresholds"] = RS.corridor_thresholds(summary)
    return out


# Fact tables are written partitioned by task, so a task subset read later
# prunes whole directories.
PARTITION_BY = {"data_exp": ["exp"], "exp_long": ["exp_id"]}


def write_all(tables: dict[str, DataFrame], out_dir: str) -> None:
    for name, df in tables.items():
        FS.write_table(df, f"{out_dir.rstrip('/')}/{name}", partition_by=PARTITION_BY.get(name))


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("--trials", required=True)
    ap.add_argument("--quest", required=True)
    ap.add_argument("--project", required=True)
    ap.add_argument("--models")
    ap.add_argument("--gender-recode")
    ap.add_argument("--ethnicity-recode")
    ap.add_argument("--quest-ethnicity-recode")
    ap.add_argument("--out", required=True)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("normsmith-study").getOrCreate()
    if checkpoint_dir(spark) is None:  # what is read often is staged beside the results
        spark.sparkContext.setCheckpointDir(f"{a.out.rstrip('/')}/_stage")
    prep = prepare(spark, a.trials, a.quest, a.project, models=a.models, gender_recode=a.gender_recode,
                   ethnicity_recode=a.ethnicity_recode, quest_ethnicity_recode=a.quest_ethnicity_recode)
    write_all(prep, a.out)
    data_exp = spark.read.parquet(f"{a.out.rstrip('/')}/data_exp")
    with scratch(spark):
        write_all(agreement(data_exp, cache_root=f"{a.out.rstrip('/')}/_cache"), a.out)


if __name__ == "__main__":
    main()
