"""Reproducible resampling.

Random draws are not taken from a generator whose stream depends on the
partitioning.  Every draw is a hash of its key,
``md5(seed|key...|draw)``: the same input gives the same samples on 8 cores
or 8000, and a lost executor recomputes exactly the same rows.

* Without replacement (corridor): the images of 0..n-1 under a permutation
  of the raters' positions that ``seed|task|n|iter`` chooses; or, by ranking,
  the n raters with the smallest ``hash(seed|task|n|iter|rater)``.
* With replacement (bootstrap): draw index = first 8 hex digits of
  ``hash(seed|task|stim|n|iter|draw)`` mod m, into the stimulus' ratings
  ordered by rater.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from . import agreement as AG
from .ranks import partitions_of, with_positions


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def hash_key(seed: int, *parts) -> Column:
    """Hex md5 of ``seed|part|part...`` (text form of each part)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_s(p) for p in parts]))


def hash_index(h: Column, m: Column) -> Column:
    """1-based index in 1..m from the first 8 hex digits of a hash."""
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % m.cast("long")) + 1


def same_keys(left: Sequence[str], right: Sequence[str]) -> list[Column]:
    """Equality of key columns in which null equals null."""
    return [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)]


ALGOS = ("md5", "xxhash64")


def sort_key(seed: int, parts, algo: str = "md5") -> Column:
    """Pseudo-random sort key of a row from its key parts.  ``md5`` is
    portable (the oracle SQL computes the same); ``xxhash64`` is Spark's
    native 64-bit hash, several times cheaper per row for full-size runs."""
    if algo == "md5":
        return hash_key(seed, *parts)
    if algo == "xxhash64":
        return F.xxhash64(F.lit(int(seed)).cast("long"), *parts)
    raise ValueError(f"algo must be one of {ALGOS}")


def draw_index(seed: int, parts, m: Column, algo: str = "md5") -> Column:
    """1-based draw index in 1..m from the hash of the draw's key."""
    if algo == "md5":
        return hash_index(hash_key(seed, *parts), m)
    if algo == "xxhash64":
        return F.pmod(F.xxhash64(F.lit(int(seed)).cast("long"), *parts), m.cast("long")) + 1
    raise ValueError(f"algo must be one of {ALGOS}")


MASK32 = (1 << 32) - 1


def word32(h: Column) -> Column:
    """The first 32 bits of a hex hash as a whole number."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def scramble32(z: Column) -> Column:
    """A 32-bit number scrambled (shift, exclusive or, multiply, twice): one
    to one, and far cheaper than a hash of text, so that a text hash is needed
    per sample only and not per draw."""
    for _ in range(2):
        z = (z.bitwiseXOR(F.shiftrightunsigned(z, 16)) * F.lit(0x45D9F3B)).bitwiseAND(F.lit(MASK32))
    return z.bitwiseXOR(F.shiftrightunsigned(z, 16))


def draw_position(base: Column, draw: Column, m: Column) -> Column:
    """0-based position in 0..m-1 (m < 2^31) of the given draw of a sample
    whose 32-bit ``base`` comes from its keys."""
    z = scramble32((base + draw * F.lit(0x9E3779B9)).bitwiseAND(F.lit(MASK32)))
    return F.shiftrightunsigned(z * m.cast("long"), 32)


# --------------------------------------------------------------------------
# R4  ICC corridor
# --------------------------------------------------------------------------
def rater_samples(cells: DataFrame, n_seq: Sequence[int], n_iter: int, seed: int = 123, iter_start: int = 0,
                  group: Sequence[str] = ("exp",), rater: str = "session_id", algo: str = "md5") -> DataFrame:
    """(group..., n, iter, rater): n raters drawn without replacement per
    (group, n, iter) = the n raters with the smallest hash keys; sizes above
    the number of raters of a group are skipped, as in the reference.

    One ranking over the (size, iteration) grid with a literal bound
    (``row_number <= largest size``), so Spark keeps only that many per map
    task before the shuffle (partial window-group limit): a task with
    millions of raters never ranks them all in one place.  The grid comes
    from ``explode`` (no join, one scan)."""
    g = list(group)
    raters = cells.select(*g, rater).distinct()
    avail = raters.groupBy(*g).agg(F.count(F.lit(1)).alias("__avail"))
    iters = F.explode(F.sequence(F.lit(iter_start).cast("long"), F.lit(iter_start + n_iter - 1).cast("long")))
    sizes = F.explode(F.array(*[F.lit(int(n)).cast("long") for n in n_seq]))
    grid = raters.withColumn("n", sizes).withColumn("iter", iters)
    h = sort_key(seed, [*[F.col(c) for c in g], F.col("n"), F.col("iter"), F.col(rater)], algo)
    w = Window.partitionBy(*g, "n", "iter").orderBy(h, F.col(rater))
    largest = int(max(n_seq))
    ranked = grid.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= largest)
    samples = ranked.where(F.col("__rk") <= F.col("n")).select(*g, "n", "iter", rater)
    hidden = [f"__{c}" for c in g]
    avail = avail.select(*[F.col(c).alias(h) for c, h in zip(g, hidden)], "__avail")
    return samples.join(avail, same_keys(g, hidden)).where(F.col("n") <= F.col("__avail")).select(*g, "n", "iter", rater)


def icc_corridor(cells: DataFrame, n_seq: Sequence[int] = tuple(range(10, 101, 10)), n_iter: int = 500,
                 seed: int = 123, iter_start: int = 0, group: Sequence[str] = ("exp",), rater: str = "session_id",
                 stim: str = "trial_name", value: str = "dv", algo: str = "md5") -> DataFrame:
    """ICC(2,k) for every (group, n, iter) sample of ``rater_samples``, with
    the mean squares (for bounds).  No low-variety screen here (the reference
    does none); stimuli not answered by every sampled rater are left out.  For
    studies without absent cells; ``full_corridor`` takes all cells and draws
    without ranking."""
    from ..session import cut_lineage

    g = list(group)
    samples = rater_samples(cells, n_seq, n_iter, seed, iter_start, g, rater, algo)
    hidden = [f"__{c}" for c in [*g, rater]]
    samples = samples.select(*[F.col(c).alias(h) for c, h in zip([*g, rater], hidden)], "n", "iter")
    sampled = cells.join(samples, same_keys([*g, rater], hidden)).drop(*hidden)
    sampled = cut_lineage(sampled)  # read several times below
    key = [*g, "n", "iter"]
    rect = AG.complete_cases(sampled, key, rater, stim, value)
    ms = AG.mean_squares(AG.variance_sums(rect, key, rater, stim, value))
    return ms.select(*g, "n", "iter",
                     F.col("n_rater").alias("n_raters"), F.col("n_stim").alias("n_stimuli"), AG.icc2k_column().alias("icc2k"), "msb", "msj", "mse")


FEISTEL_ROUNDS = 6


def permuted(j: Column, k: Column, key: Column) -> Column:
    """Where a permutation of 0..k-1, chosen by the text ``key``, takes ``j``.

    A Feistel network on a x b >= k cells (a near the square root of k) whose
    rounds add md5 words modulo a and b in turn; a place outside 0..k-1 is
    permuted again until it is inside, which takes at most a * b - k + 1 more
    times.  So n distinct members of k are drawn by n computations, without
    listing or ranking the others."""
    k = k.cast("long")
    a = F.ceil(F.sqrt(k.cast("double"))).cast("long")
    shape = F.struct(a.alias("a"), F.ceil(k / a).cast("long").alias("b"), k.alias("k"), key.alias("key"))

    def word(s: Column, r: Column, v: Column) -> Column:
        return word32(F.md5(F.concat_ws("|", s["key"], r.cast("string"), v.cast("string"))))

    def once(s: Column, x: Column) -> Column:
        start = F.struct(F.floor(x / s["b"]).cast("long").alias("l"), (x % s["b"]).alias("r"))

        def turn(v: Column, r: Column) -> Column:
            left = F.struct(((v["l"] + word(s, r, v["r"])) % s["a"]).alias("l"), v["r"].alias("r"))
            right = F.struct(v["l"].alias("l"), ((v["r"] + word(s, r, v["l"])) % s["b"]).alias("r"))
            return F.when(r % 2 == 0, left).otherwise(right)

        return F.aggregate(F.sequence(F.lit(0), F.lit(FEISTEL_ROUNDS - 1)), start, turn,
                           lambda v: v["l"] * s["b"] + v["r"])

    def walk(s: Column) -> Column:
        tries = F.sequence(F.lit(0).cast("long"), s["a"] * s["b"] - s["k"])
        return F.aggregate(tries, once(s, j.cast("long")), lambda x, _: F.when(x < s["k"], x).otherwise(once(s, x)))

    return F.transform(F.array(shape), walk)[0]


def permuted_samples(cells: DataFrame, n_seq: Sequence[int], n_iter: int, seed: int = 123, iter_start: int = 0,
                     group: Sequence[str] = ("exp",), rater: str = "session_id") -> DataFrame:
    """(group..., n, iter, rater): n raters drawn without replacement per
    (group, n, iter); sizes above the number of raters of a group are skipped,
    as in the reference.

    Raters get positions by one range shuffle; a sample's members are the
    images of 0..n-1 under the permutation of its key, so the rows made are
    the rows returned, whatever the number of raters."""
    g = list(group)
    hidden = [f"__{c}" for c in g]
    raters = with_positions(cells.select(*g, rater).distinct(), g, [rater], "__pos")
    groups = raters.where("__pos = 0").select(*[F.col(c).alias(h) for c, h in zip(g, hidden)], F.col("n_rows").alias("__k"))
    iters = F.sequence(F.lit(iter_start).cast("long"), F.lit(iter_start + n_iter - 1).cast("long"))
    grid = groups.withColumn("n", F.explode(F.array(*[F.lit(int(n)).cast("long") for n in n_seq])))
    grid = grid.where(F.col("n") <= F.col("__k")).withColumn("iter", F.explode(iters))
    # few groups fan out into many samples: spread them before the members are drawn
    grid = grid.repartition(partitions_of(grid), *hidden, "n", "iter")
    grid = grid.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    key = F.concat_ws("|", F.lit(str(seed)), *[_s(c) for c in [*hidden, "n", "iter"]])
    drawn = grid.withColumn("__at", permuted(F.col("__j"), F.col("__k"), key))
    return drawn.join(raters, [*same_keys(hidden, g), F.col("__at") == F.col("__pos")]).select(*g, "n", "iter", rater)


def full_corridor(cells: DataFrame, n_seq: Sequence[int] = tuple(range(10, 101, 10)), n_iter: int = 500,
                  seed: int = 123, iter_start: int = 0, group: Sequence[str] = ("exp",), rater: str = "session_id",
                  stim: str = "trial_name", value: str = "dv") -> DataFrame:
    """ICC(2,k) from all present cells for every (group, n, iter) sample of
    raters: n_raters and n_stimuli with an answer, n_cells_missing, icc2k and
    the mean squares (for bounds).  No low-variety screen here (the reference
    does none).  Every sample has a row, with nulls where nothing can be
    estimated; see ``agreement.unbalanced_components`` for the estimates.

    A rater's totals do not depend on the sample: they are computed once and
    joined to the samples.  Only the stimulus totals need the sampled cells,
    as one partial aggregate."""
    g = list(group)
    key = [*g, "n", "iter"]
    present = cells.where(F.col(value).isNotNull()).select(*g, rater, stim, AG.numeric(cells, value).alias("__x"))
    samples = staged(permuted_samples(cells, n_seq, n_iter, seed, iter_start, g, rater))
    hidden = [f"__{c}" for c in [*g, rater]]
    mine = [F.col(c).alias(h) for c, h in zip([*g, rater], hidden)]
    totals = present.groupBy(*[F.col(c).alias(h) for c, h in zip([*g, rater], hidden)]).agg(
        F.sum("__x").cast("double").alias("__s"), F.sum(F.col("__x") * F.col("__x")).cast("double").alias("__ss"),
        F.count(F.lit(1)).cast("double").alias("__c"))
    s, c = F.col("__s"), F.col("__c")
    by_rater = samples.join(totals, same_keys([*g, rater], hidden), "left").groupBy(*key).agg(
        F.count("__c").cast("double").alias("b"), F.coalesce(F.sum(c), F.lit(0.0)).alias("n_cells"),
        F.sum(s).alias("__g"), F.sum("__ss").alias("t0"), F.sum(s * s / c).alias("tb"), F.sum(c * c).alias("q2"))
    cell = present.select(*mine, stim, "__x").join(samples, same_keys(hidden, [*g, rater]))
    per_stim = cell.groupBy(*key, stim).agg(
        F.sum("__x").cast("double").alias("__s"), F.count(F.lit(1)).cast("double").alias("__c"))
    by_stim = per_stim.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(
        F.count(F.lit(1)).cast("double").alias("a"), F.sum(s * s / c).alias("ta"), F.sum(c * c).alias("q1"))
    sums = by_rater.join(by_stim, same_keys(key, [f"__k{i}" for i in range(len(key))]), "left").select(
        *key, F.coalesce("a", F.lit(0.0)).alias("a"), "b", F.col("n_cells").alias("n__"), "__g", "t0", "ta", "tb", "q1", "q2")
    sums = sums.withColumn("tm", F.try_divide(F.col("__g") * F.col("__g"), F.col("n__")))
    est = AG.unbalanced_components(sums.withColumnRenamed("n__", "__n"), key, "__n")
    return est.select(
        *key, F.col("n_rater").alias("n_raters"), F.col("n_stim").alias("n_stimuli"),
        (F.col("n_stim") * F.col("n_rater") - F.col("n_cells")).alias("n_cells_missing"),
        AG.icc2k_of_components().alias("icc2k"), "msb", "msj", "mse")


# --------------------------------------------------------------------------
# R5  corridor summary, A13 thresholds
# --------------------------------------------------------------------------
def corridor_summary(corridor: DataFrame, group: Sequence[str] = ("exp",), low: float = 0.025,
                     high: float = 0.975) -> DataFrame:
    """Per (group, n): median and the ``low``/``high`` quantiles (type 7) of
    ICC(2,k) over iterations, missing values skipped."""
    return corridor.groupBy(*group, "n").agg(
        F.median("icc2k").alias("icc_median"),
        F.percentile("icc2k", low).alias("icc_low"),
        F.percentile("icc2k", high).alias("icc_high"),
    )


def corridor_thresholds(summary: DataFrame, thresholds: Sequence[float] = (0.75, 0.90),
                        group: Sequence[str] = ("exp",)) -> DataFrame:
    """Per group, the smallest n whose median reaches each threshold
    (null if none).  Column ``n_for_<t>`` per threshold, e.g. n_for_075."""
    aggs = [
        F.min(F.when(F.col("icc_median") >= t, F.col("n"))).alias("n_for_" + f"{t:.2f}".replace(".", ""))
        for t in thresholds
    ]
    return summary.groupBy(*group).agg(*aggs)


def with_thresholds(summary: DataFrame, thresholds: Sequence[float] = (0.75, 0.90),
                    group: Sequence[str] = ("exp",)) -> DataFrame:
    """The summary with the thresholds of its group on every row (a
    window over the summary, which is computed once)."""
    w = Window.partitionBy(*group)
    return summary.withColumns({
        "n_for_" + f"{t:.2f}".replace(".", ""): F.min(F.when(F.col("icc_median") >= t, F.col("n"))).over(w)
        for t in thresholds
    })


# --------------------------------------------------------------------------
# W4 + R8  centre and bootstrap means
# --------------------------------------------------------------------------
def centred(cells: DataFrame, group: Sequence[str] = ("exp",), stim: str = "trial_name", value: str = "dv",
            rater: str = "session_id") -> DataFrame:
    """Ratings centred on their stimulus mean (``scale(scale=FALSE)``) with
    their 1-based position among the stimulus' ratings (by rater) and the
    stimulus' rating count m.  Missing ratings are left out.  Positions come
    from one range shuffle, so no task sorts or holds a whole stimulus."""
    key = [*group, stim]
    rows = cells.where(F.col(value).isNotNull()).select(*key, rater, F.col(value).cast("double").alias("__x"))
    placed = with_positions(rows, key, [rater, "__x"], "__pos")
    hidden = [f"__k{i}" for i in range(len(key))]
    means = rows.groupBy(*[F.col(k).alias(h) for k, h in zip(key, hidden)]).agg(F.avg("__x").alias("__mean"))
    return placed.join(means, same_keys(key, hidden)).select(
        *key, rater, (F.col("__x") - F.col("__mean")).alias("rating_c"),
        (F.col("__pos") + 1).cast("int").alias("pos"), F.col("n_rows").alias("m"))


def work_partitions(df: DataFrame) -> int:
    """Partitions for a generated workload: the session's shuffle
    partitions or its default parallelism, whichever is larger (the
    cluster's setting, never a fixed number)."""
    return partitions_of(df)


# Distinct answers of a stimulus up to which a draw finds its answer by
# comparing with the cumulative counts; beyond, by a join on positions.
FEW_VALUES = 64


def value_counts(cells: DataFrame, group: Sequence[str], stim: str, value: str) -> DataFrame:
    """Per (group, stim): m answers, their total, and the distinct answers in
    order with the number of answers up to and including each.  An array holds
    distinct answers, not answers; callers check ``FEW_VALUES`` first."""
    key = [*group, stim]
    x = F.col(value).cast("double").alias("__x")
    per = cells.where(F.col(value).isNotNull()).select(*key, x).groupBy(*key, "__x").agg(F.count(F.lit(1)).alias("__c"))
    out = per.groupBy(*key).agg(F.sum("__c").alias("m"), F.sum(F.col("__x") * F.col("__c")).alias("__total"),
                                F.sort_array(F.collect_list(F.struct("__x", "__c"))).alias("__l"))
    upto = F.transform("__l", lambda e, i: F.aggregate(F.slice("__l", 1, i + 1), F.lit(0).cast("long"),
                                                       lambda acc, y: acc + y["__c"]))
    return out.select(*key, "m", (F.col("__total") / F.col("m")).alias("__mean"),
                      F.transform("__l", lambda e: e["__x"]).alias("__values"), upto.alias("__upto"))


def bootstrap_by_value(cells: DataFrame, N: int = 100, iterations: int = 500, seed: int = 123, iter_start: int = 0,
                       group: Sequence[str] = ("exp",), stim: str = "trial_name", value: str = "dv") -> DataFrame:
    """R8 for the full workload.  Drawing from m answers with replacement is
    drawing from their distinct values in proportion to their counts, so what
    is distributed is one row per (stimulus, sample size) with its values and
    cumulative counts: no draw is shuffled and no answer is joined.  A draw's
    position among the answers in ascending order is a scrambled 32-bit number
    of its key, its value the one whose cumulative count passes the position;
    a mean is summed in the task that draws it (the partitioning by stimulus
    and size serves the aggregate as well).

    With more than ``FEW_VALUES`` distinct answers of a stimulus (answers on a
    continuous scale) the same positions are joined to the answers instead."""
    g = list(group)
    key = [*g, stim]
    rows = cells.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("__x"))
    most = rows.groupBy(*key, "__x").count().groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    few = most <= FEW_VALUES
    if few:
        # the cumulative counts as columns: comparing them is what a draw costs
        never = F.lit((1 << 63) - 1)
        stims = value_counts(rows, g, stim, "__x").select(
            *key, "m", "__mean", "__values",
            *[F.coalesce(F.get("__upto", F.lit(k)), never).alias(f"__u{k}") for k in range(int(most))])
    else:
        placed = with_positions(rows, key, ["__x"], "__pos")
        stims = rows.groupBy(*key).agg(F.count("__x").alias("m"), F.avg("__x").alias("__mean"))
    sized = stims.withColumn("sample_size", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N).cast("long"))))
    sized = sized.repartition(partitions_of(sized), *key, "sample_size")
    iters = F.sequence(F.lit(iter_start).cast("long"), F.lit(iter_start + iterations - 1).cast("long"))
    sampled = sized.withColumn("iteration", F.explode(iters))
    sampled = sampled.withColumn("__base", word32(hash_key(seed, *[F.col(c) for c in key], "sample_size", "iteration")))
    draws = sampled.withColumn("__d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("sample_size"))))
    draws = draws.withColumn("__at", draw_position(F.col("__base"), F.col("__d"), F.col("m")))
    if few:
        # the number of cumulative counts at or below the position
        n = F.lit(0)
        for k in range(int(most)):
            n = n + (F.col(f"__u{k}") <= F.col("__at")).cast("int")
        draws = draws.withColumn("__x", F.get("__values", n))
    else:
        hidden = [f"__k{i}" for i in range(len(key))]
        answers = placed.select(*[F.col(k).alias(h) for k, h in zip(key, hidden)], "__x", "__pos")
        draws = draws.join(answers, [*same_keys(key, hidden), F.col("__at") == F.col("__pos")])
    return draws.groupBy(*key, "sample_size", "iteration").agg(
        (F.sum("__x") / F.first("sample_size") - F.first("__mean")).alias("mean_rating"))


def bootstrap_means(cells: DataFrame, N: int = 100, iterations: int = 500, seed: int = 123, iter_start: int = 0,
                    group: Sequence[str] = ("exp",), stim: str = "trial_name", value: str = "dv",
                    rater: str = "session_id", method: str = "join", algo: str = "md5") -> DataFrame:
    """For every (group, stim), sample size n in 1..N and iteration, the
    mean of n centred ratings drawn with replacement.

    ``method='join'`` (the default) emits one row per draw and joins it to
    the ratings by (group, stim, position): no bound on ratings per stimulus.
    ``method='array'`` keeps each stimulus' ratings as one sorted array and
    computes every mean with a higher-order ``aggregate`` over its n draws; it
    holds one stimulus' ratings in a row, is for studies whose stimuli have a
    known, small number of ratings, and is only used when asked for.
    ``'arrow'`` draws the positions in NumPy and joins them as ``'join'`` does.
    """
    g = list(group)
    c = centred(cells, g, stim, value, rater)
    sizes = F.sequence(F.lit(1).cast("long"), F.lit(N).cast("long"))
    iters = F.sequence(F.lit(iter_start).cast("long"), F.lit(iter_start + iterations - 1).cast("long"))

    def pick(d: Column) -> Column:
        if algo == "xxhash64":  # one base hash per mean row, then one 2-long hash per draw
            return (F.pmod(F.xxhash64(F.col("__h"), d), F.col("m").cast("long")) + 1).cast("int")
        parts = [*[F.col(x) for x in g], F.col(stim), F.col("sample_size"), F.col("iteration"), d]
        return draw_index(seed, parts, F.col("m"), algo).cast("int")

    def with_base(df: DataFrame) -> DataFrame:
        if algo != "xxhash64":
            return df
        parts = [*[F.col(x) for x in g], F.col(stim), F.col("sample_size"), F.col("iteration")]
        return df.withColumn("__h", sort_key(seed, parts, algo))

    if method == "array":
        per_stim = c.groupBy(*g, stim).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "rating_c"))), lambda x: x["rating_c"]).alias("__r"),
            F.max("m").alias("m"),
        )
        # Few stimulus rows fan out into N x iterations means each: spread the
        # (stimulus, size) rows over the cluster before the second explode,
        # so the work is not left in the few tasks that hold the stimuli.
        sized = per_stim.withColumn("sample_size", F.explode(sizes))
        sized = sized.repartition(work_partitions(sized), *g, stim, "sample_size")
        grid = with_base(sized.withColumn("iteration", F.explode(iters)))
        total = F.aggregate(
            F.sequence(F.lit(1).cast("long"), F.col("sample_size")),
            F.lit(0.0),
            lambda acc, d: acc + F.element_at(F.col("__r"), pick(d)),
        )
        return grid.select(*g, stim, "sample_size", "iteration", (total / F.col("sample_size")).alias("mean_rating"))
    if method == "join":
        stims = c.groupBy(*g, stim).agg(F.max("m").alias("m"))
        sized = stims.withColumn("sample_size", F.explode(sizes))
        sized = sized.repartition(work_partitions(sized), *g, stim, "sample_size")
        draws = with_base(sized.withColumn("iteration", F.explode(iters))).withColumn(
            "draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("sample_size")))
        )
        draws = draws.withColumn("pos", pick(F.col("draw")))
        picked = draws.join(c.select(*g, stim, "pos", "rating_c"), [*g, stim, "pos"])
        return picked.groupBy(*g, stim, "sample_size", "iteration").agg(F.avg("rating_c").alias("mean_rating"))
    if method == "arrow":
        return _bootstrap_arrow(c, g, stim, N, iterations, seed, iter_start)
    raise ValueError("method must be 'join', 'array' or 'arrow'")


def _bootstrap_arrow(c: DataFrame, g: list[str], stim: str, N: int, iterations: int, seed: int,
                     iter_start: int) -> DataFrame:
    """Vectorised draws for full-size runs: one input row per (stimulus,
    sample size) with the stimulus' rating count; NumPy draws the positions of
    all iterations of that size with a Philox generator keyed by
    ``xxhash64(seed, keys..., size)``, so the result does not depend on
    partitioning or retries (but differs from the md5 draws).  The ratings
    come by a join on (group, stim, position); a mean adds them in the order
    of their draws."""
    import numpy as np
    import pandas as pd

    stims = c.groupBy(*g, stim).agg(F.max("m").alias("__m"))
    sized = stims.withColumn("sample_size", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N).cast("long"))))
    sized = sized.withColumn(
        "__key", sort_key(seed, [*[F.col(x) for x in g], F.col(stim), F.col("sample_size")], "xxhash64")
    )
    sized = sized.repartition(work_partitions(sized), *g, stim, "sample_size")
    fields = [f for f in sized.schema.fields if f.name in (*g, stim)]
    out_schema = T.StructType(fields + [
        T.StructField("sample_size", T.LongType()), T.StructField("iteration", T.LongType()),
        T.StructField("draw", T.LongType()), T.StructField("pos", T.IntegerType()),
    ])
    iters = np.arange(iter_start, iter_start + iterations, dtype=np.int64)

    key_names = [f.name for f in fields]

    def draw(batches):
        for pdf in batches:
            for k in range(len(pdf)):
                row = pdf.iloc[k]
                n = int(row["sample_size"])
                rng = np.random.Generator(np.random.Philox(key=int(row["__key"]) & 0xFFFFFFFFFFFFFFFF))
                out = {x: pdf[x].iloc[[k]].repeat(iterations * n).to_numpy() for x in key_names}
                out["sample_size"] = np.full(iterations * n, n, dtype=np.int64)
                out["iteration"] = np.repeat(iters, n)
                out["draw"] = np.tile(np.arange(n, dtype=np.int64), iterations)
                out["pos"] = (rng.integers(0, int(row["__m"]), size=(iterations, n)) + 1).astype(np.int32).ravel()
                yield pd.DataFrame(out)[[f.name for f in out_schema.fields]]

    draws = sized.mapInPandas(draw, out_schema)
    picked = draws.join(c.select(*g, stim, "pos", "rating_c"), [*g, stim, "pos"])
    # at most N draws a mean; sorted, so that the sum is the same on any partitioning
    drawn = F.array_sort(F.collect_list(F.struct("draw", "rating_c")))
    total = F.aggregate(drawn, F.lit(0.0), lambda acc, x: acc + x["rating_c"])
    return picked.groupBy(*g, stim, "sample_size", "iteration").agg(
        (total / F.col("sample_size")).alias("mean_rating")
    )
