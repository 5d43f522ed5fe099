"""Descriptive tables and plot data.

The drawing is not built; these are the tables behind each figure/table.
All are grouped aggregates (partial aggregation before the shuffle) or
windows over already-aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_parts
from . import reshape as RE

# Emotion codes of the image flags and their labels, in the
# reference's display order.
EMOTION_LEVELS = [
    ("neu", "neutral"),
    ("ang", "anger"),
    ("dis", "disgust"),
    ("fea", "fear"),
    ("hap", "happy"),
    ("sad", "sad"),
    ("sur", "surprised"),
]


def age_brackets(first: int = 16, width: int = 5, last_open: int = 81) -> list[tuple[str, float]]:
    """Perceived-age answer brackets 16-20, 21-25, ..., 76-80, 81+ with
    their midpoints (the open bracket's midpoint is taken as its lower
    bound + 2)."""
    out = []
    lo = first
    while lo < last_open:
        hi = lo + width - 1
        out.append((f"{lo}-{hi}", (lo + hi) / 2.0))
        lo += width
    out.append((f"{last_open}+", last_open + 2.0))
    return out


# --------------------------------------------------------------------------
def labs_and_models(models: DataFrame, lab: str = "lab_id") -> DataFrame:
    """Number of labs, models, and models per lab (mean/min/max)."""
    per_lab = models.groupBy(lab).agg(F.count(F.lit(1)).alias("n"))
    return per_lab.agg(
        F.count(F.lit(1)).cast("long").alias("n_labs"),
        F.sum("n").cast("long").alias("n_models"),
        F.avg("n").alias("mean_per_lab"),
        F.min("n").cast("long").alias("min_per_lab"),
        F.max("n").cast("long").alias("max_per_lab"),
    )


def images_per_type(models: DataFrame, flags: Sequence[str], levels: DataFrame) -> DataFrame:
    """Wide flags -> long -> keep 1s -> count per flag -> split the flag
    name into (type, emotion) -> one column per type, rows in level order."""
    long = RE.wide_to_long(models.select(*flags), [], list(flags), "name", "value")
    counts = long.where(F.col("value") == 1).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parts = name_parts(F.col("name"))
    typed = counts.select(F.element_at(parts, 1).alias("type"), F.element_at(parts, 2).alias("emotion"), "n")
    wide = RE.long_to_wide(typed, ["emotion"], "type", "n", ["std", "unstd"])
    lv = levels.withColumnRenamed(levels.columns[0], "emotion")
    return wide.join(lv, "emotion", "left").select(
        F.col("label").alias("emotion"), "ord", F.col("std").cast("long").alias("std"),
        F.col("unstd").cast("long").alias("unstd"),
    )


def group_summary(df: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """N and min/max/mean of each measure per group, missing values
    skipped (an all-missing group gives null)."""
    aggs = [F.count(F.lit(1)).cast("long").alias("n")]
    for m in measures:
        aggs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.avg(m).alias(f"{m}_mean")]
    return df.groupBy(by).agg(*aggs)


def hist_bins(x: Column, width: float) -> Column:
    """Right-closed bins of ``width`` from 0: (0,w] -> 0, (w,2w] -> w ...;
    0 falls in the first bin."""
    return F.greatest(F.ceil(x / F.lit(width)) - 1, F.lit(0)) * F.lit(width)


def median_histogram(df: DataFrame, rater: str, task: str, rt: str, width: float, marker: float = 0.01) -> DataFrame:
    """Histogram of per-(rater, task) median rt, with the ``marker``
    quantile of the medians on every row."""
    from ..session import cut_lineage
    from .quality import median_rt
    from .quantile import quantile_scalar

    med = cut_lineage(median_rt(df, task, rater, rt))
    cut = quantile_scalar(med, "med_rt", marker)
    return med.where(F.col("med_rt").isNotNull()).groupBy(hist_bins(F.col("med_rt"), width).alias("bin_start")).agg(
        F.count(F.lit(1)).cast("long").alias("n")
    ).withColumn("marker", cut)


def distinct_per_group(df: DataFrame, by: str, what: str, name: str = "n") -> DataFrame:
    """Distinct count per group; a missing value counts as one
    value, as ``length(unique(x))`` does."""
    return df.groupBy(by).agg(
        (F.count_distinct(what) + F.max(F.col(what).isNull().cast("int"))).cast("long").alias(name)
    )


def equal_count_groups(df: DataFrame, item: str, sep: str = ", ") -> DataFrame:
    """Count per item, then the items that share a count listed in
    order (``listagg`` per count value)."""
    counts = df.groupBy(item).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return counts.groupBy("n").agg(
        F.expr(f"listagg(`{item}`, '{sep}') within group (order by `{item}`)").alias("items")
    )


def equal_count_rows(df: DataFrame, item: str) -> DataFrame:
    """D8 as rows (n, item): items under the count that they share, without a
    long cell."""
    return df.groupBy(item).agg(F.count(F.lit(1)).cast("long").alias("n")).select("n", item)


def rating_skewness(cells: DataFrame, task: str = "exp", value: str = "dv") -> DataFrame:
    """Skewness of the answers per task, the third central moment over
    the 1.5th power of the second; null for answers that do not vary."""
    return cells.groupBy(task).agg(F.skewness(value).alias("skewness"))


def rating_descriptives(cells: DataFrame, task: str = "exp", value: str = "dv") -> DataFrame:
    """N, mean, sd, median, min, max per task; the median comes from
    ``order_statistics``, so no task holds all answers of a rating task."""
    from .quantile import grouped_quantile

    d = cells.groupBy(task).agg(
        F.count(value).cast("long").alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    med = grouped_quantile(cells, [task], value, 0.5, out="median").withColumnRenamed(task, "__t")
    return d.join(med, F.col(task).eqNullSafe(F.col("__t")), "left").select(
        task, "n", "mean", "sd", "median", "min", "max")


def share_within(df: DataFrame, by: Sequence[str], of: str, n: str = "n") -> DataFrame:
    """Count per (by, of) and its share within ``by`` (window over the
    already-aggregated counts)."""
    counts = df.groupBy(*by, of).agg(F.count(F.lit(1)).cast("long").alias(n))
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*by)))


def mode_info(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Modal value (as text; ties -> first in text order), its count and
    share of the non-missing values, per group."""
    xs = F.col(x).cast("string")
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, xs.alias("value")).agg(F.count(F.lit(1)).alias("freq"))
    return counts.groupBy(*by).agg(
        F.min_by("value", F.struct(-F.col("freq"), F.col("value"))).alias("mode"),
        F.max("freq").cast("long").alias("freq"),
        (F.max("freq") / F.sum("freq")).alias("prop"),
    )


def attribute_ids(df: DataFrame, item: str, attributes: Sequence[str]) -> DataFrame:
    """The items that have each value of each attribute, as (attribute,
    value, item) rows -- an id list of any length without a long cell."""
    return df.unpivot([item], list(attributes), "attribute", "value").select("attribute", "value", item)
