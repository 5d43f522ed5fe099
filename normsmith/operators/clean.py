"""Recodes, unit rules and level sets.

Lookup tables are joined plainly: Spark broadcasts one whose measured size
allows it.  Their keys are checked for uniqueness first (a duplicate key
would silently multiply rows).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lookup_table(spark: SparkSession, pairs: Iterable[tuple[str, str | None]], key: str, out: str) -> DataFrame:
    """A recode dimension from (key, label) pairs; duplicate keys are an
    error.  Keys are compared lower-cased."""
    rows = [(k.lower() if k is not None else None, v) for k, v in pairs]
    keys = [k for k, _ in rows]
    dup = {k for k in keys if keys.count(k) > 1}
    if dup:
        raise ValueError(f"duplicate recode keys: {sorted(map(str, dup))}")
    return spark.createDataFrame(rows, f"`{key}` string, `{out}` string")


def check_unique(table: DataFrame, key: str) -> None:
    """Raise if a (small) dimension has a repeated key: a join against it
    would silently multiply fact rows."""
    dup = table.groupBy(key).count().where(F.col("count") > 1).limit(5).collect()
    if dup:
        raise ValueError(f"repeated keys in lookup table: {[r[key] for r in dup]}")


def recode(df: DataFrame, col: str, table: DataFrame, out: str, keep_na_label: bool = False,
           check: bool = True) -> DataFrame:
    """P10 + P15 + J1: lower-case ``col``, left-join the recode table,
    unmatched -> null.  The label text ``NA`` becomes null unless
    ``keep_na_label`` (the reference keeps it as text).  The table's
    keys are checked for repeats first."""
    if check:
        check_unique(table, table.columns[0])
    dim = table.withColumnRenamed(table.columns[0], "__rk")
    lowered = df.withColumn(col, F.lower(F.col(col)))
    joined = lowered.join(dim, F.col(col) == F.col("__rk"), "left").drop("__rk")
    if not keep_na_label:
        joined = joined.withColumn(out, F.when(F.col(out) == "NA", F.lit(None)).otherwise(F.col(out)))
    return joined


def height_cm(height: Column, units: Column) -> Column:
    """P13, first matching rule wins: cm below 100 were inches (x2.54); in
    above 100 were centimetres; in -> x2.54; cm as is; otherwise null."""
    return (
        F.when((units == "cm") & (height < 100), height * 2.54)
        .when((units == "in") & (height > 100), height)
        .when(units == "in", height * 2.54)
        .when(units == "cm", height)
        .otherwise(F.lit(None).cast("double"))
    )


def weight_kg(weight: Column, units: Column) -> Column:
    """0 -> null; lb below 80 were kilograms; lb -> /2.20462; kg as
    is; otherwise null."""
    return (
        F.when(weight == 0, F.lit(None).cast("double"))
        .when((units == "lb") & (weight < 80), weight)
        .when(units == "lb", weight / 2.20462)
        .when(units == "kg", weight)
        .otherwise(F.lit(None).cast("double"))
    )


def level_table(spark: SparkSession, levels: Sequence[str], labels: Sequence[str] | None = None,
                col: str = "level") -> DataFrame:
    """A level dimension (value, label, ord) for an ordered factor."""
    labels = list(labels) if labels is not None else list(levels)
    rows = [(v, lab, i + 1) for i, (v, lab) in enumerate(zip(levels, labels))]
    return spark.createDataFrame(rows, f"`{col}` string, label string, ord int")


def as_factor(df: DataFrame, col: str, levels: DataFrame) -> DataFrame:
    """Value outside the level set -> null label and null order."""
    dim = levels.withColumnRenamed(levels.columns[0], "__lv")
    return df.join(dim, F.col(col) == F.col("__lv"), "left").drop("__lv")


def level_counts(df: DataFrame, col: str, levels: DataFrame) -> DataFrame:
    """Counts per level with zero-count levels kept, plus one row for
    values outside the set / missing (label null).  Output (label, ord, n)."""
    counted = as_factor(df.select(col), col, levels).groupBy("label", "ord").agg(F.count(F.lit(1)).alias("n"))
    known = levels.select("label", "ord").join(counted.where(F.col("ord").isNotNull()), ["label", "ord"], "left")
    known = known.select("label", "ord", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    other = counted.where(F.col("ord").isNull()).select("label", "ord", F.col("n").cast("long"))
    return known.unionByName(other)


def widest(a: Column, b: Column) -> Column:
    """``pmax(abs(a), abs(b))`` with R's null rule (any null -> null)."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.greatest(F.abs(a), F.abs(b)))
