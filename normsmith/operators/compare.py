"""Paired comparisons.

The pairs are an inner join of two per-unit aggregates; every statistic is
a Spark aggregate over the pairs, and the t quantile and tail probability are
Column expressions of its rows (``dist_columns``), one test or many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist_columns import t_quantile, t_two_sided
from ..functions.text import format_p


def paired_pairs(x: DataFrame, y: DataFrame, key: str | list[str], xcol: str = "x", ycol: str = "y") -> DataFrame:
    """Units present on both sides, (key, x, y)."""
    return x.join(y, key, "inner").where(F.col(xcol).isNotNull() & F.col(ycol).isNotNull())


def paired_t(x: DataFrame, y: DataFrame, key: str | list[str], xcol: str = "x", ycol: str = "y") -> DataFrame:
    """One row: m_std / m_unstd (means over all values of each side),
    n_pairs, m_diff, sd_diff, t, df.  The test uses complete pairs only."""
    pairs = paired_pairs(x, y, key, xcol, ycol).select((F.col(xcol) - F.col(ycol)).alias("d"))
    stats = pairs.agg(
        F.count("d").cast("long").alias("n_pairs"),
        F.avg("d").alias("m_diff"),
        F.stddev_samp("d").alias("sd_diff"),
    )
    mx = x.agg(F.avg(xcol)).scalar()
    my = y.agg(F.avg(ycol)).scalar()
    return stats.select(
        mx.alias("m_std"),
        my.alias("m_unstd"),
        "n_pairs",
        "m_diff",
        "sd_diff",
        F.try_divide(F.col("m_diff"), F.col("sd_diff") / F.sqrt(F.col("n_pairs"))).alias("t"),
        (F.col("n_pairs") - 1).cast("double").alias("df"),
    )


def paired_t_by(x: DataFrame, y: DataFrame, key: str, by: list[str], xcol: str = "x", ycol: str = "y") -> DataFrame:
    """The paired test of every group ``by`` (e.g. trait) in one pass:
    ``x`` and ``y`` hold one value per (key, group)."""
    d = (F.col(xcol) - F.col(ycol)).alias("d")
    stats = x.join(y, [key, *by]).select(*by, d).where(F.col("d").isNotNull()).groupBy(*by).agg(
        F.count("d").cast("long").alias("n_pairs"), F.avg("d").alias("m_diff"), F.stddev_samp("d").alias("sd_diff"))
    means = x.groupBy(*by).agg(F.avg(xcol).alias("m_std")).join(y.groupBy(*by).agg(F.avg(ycol).alias("m_unstd")), by)
    return means.join(stats, by).select(
        *by, "m_std", "m_unstd", "n_pairs", "m_diff", "sd_diff",
        F.try_divide(F.col("m_diff"), F.col("sd_diff") / F.sqrt(F.col("n_pairs"))).alias("t"),
        (F.col("n_pairs") - 1).cast("double").alias("df"),
    )


def with_t_interval(tests: DataFrame, conf: float = 0.95) -> DataFrame:
    """Adds the interval of the mean difference, the two-sided p value and
    its APA text to rows of ``paired_t`` or ``paired_t_by``; null where there
    are fewer than two pairs."""
    df = F.when(F.col("n_pairs") >= 2, F.col("df"))
    half = t_quantile(1 - (1 - conf) / 2, df) * F.col("sd_diff") / F.sqrt(F.col("n_pairs"))
    out = tests.withColumns({"__half": half, "p_value": t_two_sided(F.col("t"), df)})
    return out.select(
        *tests.columns, (F.col("m_diff") - F.col("__half")).alias("ci_95_lower"),
        (F.col("m_diff") + F.col("__half")).alias("ci_95_upper"), "p_value", format_p(F.col("p_value")).alias("p"))


def paired_t_summary(x: DataFrame, y: DataFrame, key: str | list[str], xcol: str = "x", ycol: str = "y") -> DataFrame:
    """``paired_t`` plus the 95% interval of the mean difference, the
    two-sided p value and its APA text."""
    return with_t_interval(paired_t(x, y, key, xcol, ycol))
