"""Exact order statistics and quantiles, of a whole table or per group, with
no task that holds all values of a group (SURVEY A8, A9, F8).

One path for every size: the values are sorted by one range shuffle
(``ranks``), the wanted ranks are turned into places of that order from the
small table of runs, and these few rows are looked up.  Nothing reaches the
driver.  NaN counts as a value above all numbers, as in Spark's own
percentile.  A null key is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import runs, sorted_rows


def order_statistics(df: DataFrame, keys: Sequence[str], col: str, ranks: dict[str, Column]) -> DataFrame:
    """Per group of ``keys``: n_values (non-null values of ``col``), n_rows,
    and for each entry of ``ranks`` the value at that 0-based rank, given as
    an expression of ``n_values``; null where the group has no such rank."""
    keys = list(keys)
    # the row's number breaks ties, so that a frequent value is spread as well
    rows = df.select(*keys, F.col(col).cast("double").alias("__x"), F.monotonically_increasing_id().alias("__t"))
    rows = sorted_rows(rows, keys, ["__x", "__t"])
    r = runs(rows, keys, "__x")
    wanted = F.explode(F.array(F.struct(F.lit("").alias("name"), F.lit(None).cast("long").alias("rank")),
                               *[F.struct(F.lit(name).alias("name"), e.cast("long").alias("rank"))
                                 for name, e in ranks.items()]))
    # every run keeps its group's row (the empty name); a rank below n_values
    # lies in exactly one run, whose first place gives the row to look up
    r = r.withColumn("__w", wanted)
    inside = (F.col("__w.rank") >= F.col("__before")) & (F.col("__w.rank") < F.col("__before") + F.col("__c"))
    r = r.where((F.col("__w.name") == "") | (inside & (F.col("__w.rank") < F.col("n_values")))).select(
        "__key", "n_values", "n_rows", F.col("__w.name").alias("__name"),
        (F.col("__first") + F.col("__w.rank") - F.col("__before")).alias("__look"))
    found = r.join(rows.select("__x", "__at"), F.col("__look") == F.col("__at"), "left")
    out = found.groupBy("__key").agg(
        F.max("n_values").alias("n_values"), F.max("n_rows").alias("n_rows"),
        *[F.max(F.when(F.col("__name") == name, F.col("__x"))).alias(name) for name in ranks])
    return out.select(*[F.col("__key")[c].alias(c) for c in keys], "n_values", "n_rows", *ranks)


def grouped_quantile(df: DataFrame, keys: Sequence[str], col: str, p: float, strict: bool = False,
                     out: str = "q") -> DataFrame:
    """Exact type-7 quantile (linear interpolation between order statistics,
    as R ``quantile`` and Spark ``percentile``) of ``col`` per group.  With
    ``strict`` a group with any missing value gets null (R ``median`` without
    ``na.rm``)."""
    at = (F.col("n_values") - 1).cast("double") * F.lit(p)
    s = order_statistics(df, keys, col, {"__lo": F.floor(at), "__hi": F.ceil(at)})
    whole = F.floor(at) == F.ceil(at)
    q = F.when(whole, F.col("__lo")).otherwise(
        (F.ceil(at) - at) * F.col("__lo") + (at - F.floor(at)) * F.col("__hi"))
    if strict:
        q = F.when(F.col("n_rows") == F.col("n_values"), q)
    return s.select(*keys, q.alias(out))


def quantile_scalar(df: DataFrame, col: str, p: float) -> Column:
    """The quantile of all non-null values as a scalar subquery, for use in a
    filter of the same plan (F8)."""
    return grouped_quantile(df, [], col, p).select("q").scalar()


def kth_smallest(df: DataFrame, col: str, k: int) -> float | None:
    """0-based k-th smallest non-null value of ``col``."""
    row = order_statistics(df, [], col, {"x": F.lit(k)}).first()
    return None if row is None else row["x"]


def exact_quantile(df: DataFrame, col: str, p: float) -> float | None:
    """The quantile of all non-null values, on the driver."""
    row = grouped_quantile(df, [], col, p).first()
    q = None if row is None else row["q"]
    return None if q is None or math.isnan(q) else q
