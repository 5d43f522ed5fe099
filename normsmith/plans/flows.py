"""Shared lineages used by several named queries.

``rating_flow`` runs the whole screening chain on the ``ratings`` adapter.
Every rater in the adapter does all three tasks, so the first-task rule
(Q3) is off in the registered flow (with it on, only task A would remain);
``first_task`` is a query of its own.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..session import cut_lineage, staged
from ..sources import tables as S

# Task order of the adapter's three tasks.
TASK_LEVELS = [("A", 1), ("N", 2), ("R", 3)]


def task_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASK_LEVELS, "exp string, ord int")


def rating_flow(spark: SparkSession, sf_dir: str, first_task_only: bool = False) -> Q.Screening:
    raw = S.ratings(spark, sf_dir)
    fst = firsts(spark, sf_dir)
    return Q.screen(
        raw,
        S.quest(fst),  # same sessions as the raw log, without rescanning it
        S.RATINGS_ORDER,
        first_task_only=first_task_only,
        levels=task_levels(spark),
        firsts=fst,
    )


def firsts(spark: SparkSession, sf_dir: str, materialise: bool = True) -> DataFrame:
    """Keep-first ratings (W1), checkpointed when a checkpoint folder is
    configured (every later step reads them several times)."""
    out = Q.keep_first(S.ratings(spark, sf_dir), ["session_id", "exp", "trial_name"], S.RATINGS_ORDER)
    return cut_lineage(out) if materialise else out


def rating_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exp, session_id, trial_name, dv) after keep-first, check trials
    removed: the input of the agreement and resampling operators.  Raters
    are not screened here, so the agreement operators meet the planted
    low-variety and incomplete raters themselves."""
    return (
        firsts(spark, sf_dir)
        .where(~F.col("trial_name").contains("check_"))
        .select("exp", "session_id", "trial_name", "dv")
    )


def grown_cells(spark: SparkSession, sf_dir: str, n_stimuli: int | None = 50) -> DataFrame:
    """As ``rating_cells``, but every supplier is a rater (and with
    ``n_stimuli=None`` every part a stimulus): the input of the resampling
    queries at the study's full workload, which grows with the tables."""
    log = S.ratings(spark, sf_dir, n_raters=None, n_stimuli=n_stimuli).where(~F.col("trial_name").contains("check_"))
    first = Q.keep_first(log, ["session_id", "exp", "trial_name"], S.RATINGS_ORDER)
    return staged(first.select("exp", "session_id", "trial_name", "dv"))
