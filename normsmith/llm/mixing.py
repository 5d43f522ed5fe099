"""Mixing sources to target weights with hash-threshold histograms.

The mix holds ``share`` times all words.  Sources in code-point order (null
last) get the weights of a repeating pattern; no source gives more than
``most`` times its own words, and what is above is shared again by weight
among the others, until none is above (water filling, in closed form).

Within a source a document belongs to the mix when its hash lies below the
source's threshold.  The threshold is found without sorting documents: words
are summed by source and hash bucket, the bucket in which the running sum
passes the budget is refined by the next bits of the hash, and so on until
one hash value is left, which is taken when that comes nearer.  A target
above the source's words takes every document once and the rest by threshold.

Native DataFrame operators only.  Unpartitioned windows run over one row per
source, windows per source over one row per hash bucket.

Defined cases: a null text has size 0; a null source is a source of its own,
after all others; rows that repeat id and text share their hash and are taken
or left together; null ids stay null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

# Hash bits, and how many of them one histogram resolves.
BITS, STEP = 60, 10
WORDS = r"[^\x20\x09-\x0D]+"


def mix_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(k, source, source_size) -> also target, in words."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("rank", rank).withColumn(
        "w", F.element_at(pattern, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("rate", F.lit(float(share)) * F.sum("source_size").over(everything) - before).withColumn(
        "rate", F.col("rate") / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    )
    # the first source (by cap over weight) that stays below its cap sets the rate
    open_at = F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "rank", "rate"))
    s = s.withColumn("level", F.min(open_at).over(everything)["rate"])
    return s.select(
        "k",
        "source_size",
        F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(k, size, h) rows and (k, rest) budgets -> (k, limit): the words of
    rows with h < limit come as near to the budget as one hash value allows."""
    # a source's search: hash prefix fixed so far, words below that prefix
    open_ = stage(
        budgets.select("k", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), "open"
    )
    found = None
    for level in range(BITS // STEP):
        left = BITS - STEP * (level + 1)
        bucket = F.shiftright("h", left)
        inside = rows.withColumn("prefix", F.shiftright("h", left + STEP)) if level else rows.withColumn(
            "prefix", F.lit(0).cast("long")
        )
        hist = (
            inside.join(open_.select("k", "prefix"), ["k", "prefix"])
            .groupBy("k", bucket.alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        )
        run = F.sum("words").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        at = (
            hist.withColumn("upto", run)
            .join(open_, "k")
            .where((F.col("below") + F.col("upto") > F.col("rest")) & (F.col("words") > 0))
            .groupBy("k")
            .agg(F.min_by(F.struct("bucket", "words", "h0", "h1", "upto", "below", "rest"), "bucket").alias("b"))
            .select("k", "b.*")
            .withColumn("below", F.col("below") + F.col("upto") - F.col("words"))
        )
        at = stage(at, "boundary")
        alone = F.col("h0") == F.col("h1")
        nearer = F.col("rest") - F.col("below") > F.col("words") / 2
        done = at.where(alone | F.lit(left == 0)).select("k", (F.col("h0") + nearer.cast("long")).alias("limit"))
        found = done if found is None else found.unionByName(done)
        open_ = at.where(~(alone | F.lit(left == 0))).select("k", "rest", F.col("bucket").alias("prefix"), "below")
        if open_.isEmpty():
            break
    return found


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target (of
    its source), taken (words that the mix takes, repeats counted), text_hash
    (xxhash64 of the text; tells rows apart that share an id)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.col(source_col).cast("string")
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("k"),
            F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
            F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text), 64 - BITS).alias("h"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "rows",
    )
    sizes = rows.groupBy("k").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)))
    plan = mix_targets(sizes, weights, share, most)
    # whole copies first, the rest by threshold
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("copies", copies)
    plan = stage(plan.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "plan")
    limits = thresholds(rows.select("k", "size", "h"), plan.where("rest > 0").select("k", "rest"))
    plan = plan.join(limits, "k", "left").withColumn("limit", F.coalesce("limit", F.lit(0)))
    return rows.join(plan, "k").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("copies") + (F.col("h") < F.col("limit")).cast("long"))).alias("taken"),
        "text_hash",
    )
