"""Reshaping.

Pivots always name their value list, so the output schema is known when
the plan is built and Spark does not run an extra job to find the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TITLE_PATTERN, strip_prefix, task_label


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive, in schema order."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return cols[i : j + 1]


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name",
                 value: str = "value") -> DataFrame:
    """``pivot_longer``."""
    return df.unpivot(list(ids), list(values), name, value)


def long_to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per listed name (a missing cell is null)."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value))


def eav_to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str],
                order: str | None = None) -> DataFrame:
    """Entity-attribute-value rows to one row per entity.

    Where an entity answers a question twice, ``order`` picks the latest
    answer (``max_by``); without ``order`` a repeated answer is an error
    (the reference would silently build list columns)."""
    k = list(keys)
    if order is not None:
        one = df.groupBy(*k, name).agg(F.max_by(value, order).alias(value))
    else:
        one = df.groupBy(*k, name).agg(
            F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated attribute in EAV input")))
            .otherwise(F.first(value))
            .alias(value)
        )
    return one.groupBy(*k).pivot(name, list(names)).agg(F.first(value))


def round_columns(df: DataFrame, digits: int = 2) -> DataFrame:
    """Every floating or decimal column rounded, the others as they
    are."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


# --------------------------------------------------------------------------
# P1 / P2  nested project structure
# --------------------------------------------------------------------------
# The field names of the project file.
TRIAL = T.StructType([
    T.StructField("trial_n", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("center_img", T.LongType()),
])
COMPONENT = T.StructType([
    T.StructField("component_type", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("res_name", T.StringType()),
    T.StructField("instructions", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("exptype", T.StringType()),
    T.StructField("trial_order", T.StringType()),
    T.StructField("total_stim", T.LongType()),
    T.StructField("random_stim", T.LongType()),
    T.StructField("trial", T.ArrayType(TRIAL)),
    T.StructField("stimuli", T.MapType(T.StringType(), T.StringType())),
])
PROJECT = T.ArrayType(COMPONENT)


def task_dimension(components: DataFrame, title_pattern: str = TITLE_PATTERN) -> DataFrame:
    """One row per component of type ``exp``: id, name, label (P3), its
    texts and settings, number of trials and of stimuli."""
    exps = components.where(F.col("component_type") == "exp")
    return exps.select(
        F.col("id").alias("exp_id"),
        "name",
        "res_name",
        task_label(F.col("res_name"), title_pattern).alias("exp"),
        "instructions",
        "question",
        "exptype",
        "trial_order",
        "total_stim",
        "random_stim",
        F.size("trial").cast("long").alias("trials"),
        F.size("stimuli").cast("long").alias("stim"),
    )


def trial_dimension(components: DataFrame) -> DataFrame:
    """One row per trial of each ``exp`` component; the image path is
    looked up in the component's stimulus map by the image id as text."""
    exps = components.where(F.col("component_type") == "exp")
    t = exps.select(F.col("id").alias("exp_id"), "stimuli", F.explode("trial").alias("t"))
    return t.select(
        "exp_id",
        F.col("t.trial_n").alias("n"),
        strip_prefix(F.col("t.name")).alias("name"),
        F.col("t.center_img").alias("img_id"),
        F.element_at(F.col("stimuli"), F.col("t.center_img").cast("string")).alias("img_path"),
    )


def task_trials(components: DataFrame) -> DataFrame:
    """P1 + P2 in one pass: every trial of each ``exp`` component with its
    task's columns (no second parse of the components, no join back)."""
    exps = components.where(F.col("component_type") == "exp")
    t = exps.select(
        F.col("id").alias("exp_id"),
        task_label(F.col("res_name")).alias("exp"),
        F.size("trial").cast("long").alias("trials"),
        F.size("stimuli").cast("long").alias("stim"),
        "stimuli",
        F.explode("trial").alias("t"),
    )
    return t.select(
        "exp_id", "exp", "trials", "stim",
        F.col("t.trial_n").alias("n"),
        strip_prefix(F.col("t.name")).alias("name"),
        F.col("t.center_img").alias("img_id"),
        F.element_at(F.col("stimuli"), F.col("t.center_img").cast("string")).alias("img_path"),
    )


def components_from_json(df: DataFrame, col: str) -> DataFrame:
    """S9 on a text column: each value is a JSON array of components."""
    return df.select(F.explode(F.from_json(F.col(col), PROJECT)).alias("c")).select("c.*")
