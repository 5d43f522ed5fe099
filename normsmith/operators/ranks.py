"""Exact positions of rows within their groups by one range shuffle (A8, A9,
F8, W4, R8).

Rows are dealt to partitions by ranges of (keys, order) and sorted inside
them.  Spark samples the ranges, so a group that holds a third of all rows,
or ids with a long common prefix, are spread over many tasks; no task sorts
or holds a whole group.  A row's place in its partition is written beside it
(``__at``: partition in the high bits, place in the low 33).  What remains is
one small aggregate, the *runs*: per (group, partition) the number of rows
and the first place.  The running sum of a group's runs is the number of its
rows in earlier partitions, so

    position = rows of the group in earlier partitions + place - first place.

The sorted rows are staged once, because the runs and the rows must come from
the same evaluation of the shuffle.  Nulls in ``order`` come last, NaN behind
all numbers (Spark's order).  A null key is a group of its own.  Rows that are
equal in all order columns take consecutive positions in no particular order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

PLACE_BITS = 33
_PLACE = (1 << PLACE_BITS) - 1


def partitions_of(df: DataFrame) -> int:
    """The cluster's setting for shuffles, or its cores if these are more."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def sorted_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` dealt by ranges of (keys, order), sorted, with ``__at``; staged."""
    by = [F.col(c) for c in keys] + [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    rows = df.repartitionByRange(partitions_of(df), *by).sortWithinPartitions(*by)
    return staged(rows.withColumn("__at", F.monotonically_increasing_id()))


def runs(rows: DataFrame, keys: Sequence[str], value: str | None = None) -> DataFrame:
    """Per (keys, partition) of ``sorted_rows``: ``__key`` (struct of the
    keys), ``__part``, ``__first`` (smallest ``__at``), ``__c`` rows,
    ``__before`` rows of the group in earlier partitions, ``n_rows`` of the
    group and, with ``value``, its non-null ``n_values``."""
    key = F.struct(*[F.col(c) for c in keys], F.lit(0).alias("__0"))
    part = F.shiftright("__at", PLACE_BITS)
    out = rows.groupBy(key.alias("__key"), part.alias("__part")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__c"),
        (F.count(value) if value else F.count(F.lit(1))).alias("__v"))
    group = Window.partitionBy("__key")
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        "__key", "__part", "__first", "__c", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__c").over(group).alias("n_rows"), F.sum("__v").over(group).alias("n_values"))


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "pos") -> DataFrame:
    """``df`` with the 0-based position of each row in its group, and the
    group's ``n_rows``."""
    rows = sorted_rows(df, keys, order)
    r = runs(rows, keys).select(
        F.col("__key").alias("__rkey"), F.col("__part").alias("__rpart"), "__first", "__before", "n_rows")
    key = F.struct(*[F.col(c) for c in keys], F.lit(0).alias("__0"))
    on = (F.shiftright("__at", PLACE_BITS) == F.col("__rpart")) & key.eqNullSafe(F.col("__rkey"))
    return rows.join(r, on).select(
        *df.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias(out), "n_rows")
