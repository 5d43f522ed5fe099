"""Driver tables (parquet, one file per table) and the adapter views that
turn them into rating-study inputs.

Everything here is lazy: a view is a DataFrame plan over the parquet scan,
so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str, n_raters: int | None = 20, n_stimuli: int | None = 50) -> DataFrame:
    """Trial log in rating-study shape, derived from ``lineitem``.

    Raters are suppliers and stimuli parts, folded to ``n_raters`` and
    ``n_stimuli``; with None they are not folded, so that raters (stimuli) and
    kept rows grow with the table and a rater misses many cells.

    One row per answer event: ``session_id`` (rater), ``exp`` (task),
    ``trial_name`` (stimulus or attention check), ``dv`` (answer), ``rt``,
    ``dt`` plus the source key columns that give a total order for
    keep-first deduplication.  Planted raters: 1/A constant, 2/N two-valued,
    3 fails attention checks, 4/R fast, 5/R lacks stimulus 49.
    """
    li = table(spark, sf_dir, "lineitem")
    session_id = F.col("l_suppkey") % n_raters if n_raters else F.col("l_suppkey")
    exp = F.col("l_returnflag")
    st = F.col("l_partkey") % n_stimuli if n_stimuli else F.col("l_partkey")
    chk = F.col("l_linenumber") == 7
    qn = F.col("l_quantity").cast("int")
    signal = (st * 7) % 50  # 0..49, the planted stimulus effect

    def band(width: int) -> Column:  # floor(signal * width / 50)
        return F.floor(signal * width / F.lit(50)).cast("int")

    expected = (F.col("l_partkey") % 7 + 1).cast("int")
    dv = (
        F.when(chk, F.when((session_id == 3) & (F.col("l_partkey") % 2 == 0), F.lit(8)).otherwise(expected))
        .when((session_id == 1) & (exp == "A"), F.lit(4))
        .when((session_id == 2) & (exp == "N"), (3 + st % 2).cast("int"))
        .when(exp == "A", 1 + band(4) + qn % 4)
        .when(exp == "N", 1 + band(3) + qn % 5)
        .otherwise(1 + band(2) + qn % 6)
        .cast("int")
    )
    trial_name = F.when(
        chk, F.concat(F.lit("check_"), F.lower("l_linestatus"), F.lit("_"), expected.cast("string"))
    ).otherwise(F.concat(F.lit("s"), st.cast("string")))
    rt = F.when((session_id == 4) & (exp == "R"), F.col("l_extendedprice") / 20).otherwise(F.col("l_extendedprice"))
    return li.where(~((session_id == 5) & (exp == "R") & (st == 49) & ~chk)).select(
        session_id.alias("session_id"),
        exp.alias("exp"),
        trial_name.alias("trial_name"),
        dv.alias("dv"),
        rt.alias("rt"),
        F.col("l_shipdate").alias("dt"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


# Order that makes keep-first deterministic on the adapter (unique key).
RATINGS_ORDER = ("dt", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def quest(ratings_df: DataFrame) -> DataFrame:
    """Questionnaire answers per session: session 6 answers the honesty
    question 'try' with 1 (not serious), everyone else with 2."""
    return (
        ratings_df.select("session_id")
        .distinct()
        .select("session_id", F.when(F.col("session_id") == 6, 1).otherwise(2).alias("try_answer"))
    )


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial log from ``events``: session=user, task=event type,
    rt=value, dt=ts, plus the JSON props text."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("exp"),
        F.col("value").alias("rt"),
        F.col("ts").alias("dt"),
        "event_id",
        "props",
    )


def age_of(custkey: Column) -> Column:
    """Model age in years for the customer-based models view (null for
    every 23rd model, to exercise missing values)."""
    return F.when(custkey % 23 == 0, F.lit(None)).otherwise((18 + custkey % 50).cast("int"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stimulus models (people photographed) from ``customer`` and
    ``nation``: lab = nation, model = customer, raw gender text = market
    segment, raw ethnicity text = nation name, age, and eight 0/1
    image-availability flags taken from the bits of the customer key."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    flags = [
        (F.shiftright(F.col("c_custkey"), i).bitwiseAND(F.lit(1))).cast("int").alias(name)
        for i, name in enumerate(IMAGE_FLAGS)
    ]
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.concat(F.lit("L"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("_"),
                 F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("ID"),
        F.col("c_custkey").alias("model_key"),
        F.col("c_mktsegment").alias("gender"),
        F.col("n_name").alias("ethnicity"),
        age_of(F.col("c_custkey")).alias("age"),
        F.col("c_acctbal").alias("acctbal"),
        *flags,
    )


# Image-availability flags of a model (fixed names of the reference's columns).
IMAGE_FLAGS = ("std_ang", "std_dis", "std_fea", "std_hap", "std_neu", "std_sad", "std_sur", "unstd_neu")
