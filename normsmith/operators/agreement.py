"""Inter-rater agreement from long-form aggregates.

The rating matrix (stimuli x raters) is never pivoted.  ICC(2,k) and
Cronbach's alpha only need four kinds of sums per task: per-stimulus totals,
per-rater totals, the grand total and the sum of squares.  They come from
one ``GROUPING SETS`` aggregate (one scan, one shuffle) followed by a tiny
per-task aggregate; integer answers are summed as BIGINT so the sums are
exact whatever the partitioning.

Missing cells: raters are screened first (A18, optional).  Then either
``missing='complete'``: only stimuli answered by every remaining rater are
used, and ``n_stimuli_dropped`` / ``n_cells_dropped`` say what that left out;
or ``missing='all'``: every cell is used, the variance components of the
two-way random model coming from the method of moments for unequal numbers
(uncorrected sums of squares by stimulus, by rater and in total and their
expectations), which equals the analysis of variance on a full rectangle.
Every task keeps its row, with nulls where nothing can be estimated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dist_columns import f_quantile
from ..session import discard, staged


# --------------------------------------------------------------------------
# R1  task families
# --------------------------------------------------------------------------
def task_subset(df: DataFrame, tasks: Sequence[str] | None = None, pattern: str | None = None, task: str = "exp",
                value: str = "dv", numeric: bool = True) -> DataFrame:
    """Rows of the named tasks (``isin``) or of tasks matching ``pattern``;
    answers cast to double with bad text as null when ``numeric``."""
    out = df
    if tasks is not None:
        out = out.where(F.col(task).isin(list(tasks)))
    if pattern is not None:
        out = out.where(F.col(task).rlike(pattern))
    if numeric:
        out = out.withColumn(value, F.col(value).try_cast("double"))
    return out


# --------------------------------------------------------------------------
# A18  distinct answers per rater (missing counted, absent cells counted)
# --------------------------------------------------------------------------
def rater_variety(cells: DataFrame, group: Sequence[str] = ("exp",), rater: str = "session_id",
                  stim: str = "trial_name", value: str = "dv") -> DataFrame:
    """Per (group, rater): ``n_values`` = distinct answers, where a missing
    answer or an absent cell (stimulus of the task the rater has no row for)
    counts as one more value, as ``length(unique(column))`` of the wide
    matrix would."""
    g = list(group)
    per_value = cells.groupBy(*g, rater, value).agg(F.count(F.lit(1)).alias("__cnt"))
    per_rater = per_value.groupBy(*g, rater).agg(
        F.count(value).alias("n_nonnull_values"),
        F.max(F.col(value).isNull().cast("int")).alias("has_null"),
        F.sum("__cnt").alias("n_cells"),
    )
    n_stim = cells.groupBy(*[F.col(c).alias(f"__{c}") for c in g]).agg(F.count_distinct(stim).alias("n_stim_task"))
    return per_rater.join(n_stim, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in g], "left").select(
        *g,
        rater,
        (F.col("n_nonnull_values") + F.col("has_null")
         + F.when(F.col("n_cells") < F.col("n_stim_task"), 1).otherwise(0)).cast("long").alias("n_values"),
    )


def screen_raters(cells: DataFrame, min_values: int = 3, group: Sequence[str] = ("exp",), rater: str = "session_id",
                  stim: str = "trial_name", value: str = "dv") -> tuple[DataFrame, DataFrame]:
    """Split raters into kept (>= ``min_values`` distinct answers) and
    dropped; returns (cells of kept raters, dropped (group, rater)).  A null
    task or rater is one like any other."""
    var = rater_variety(cells, group, rater, stim, value)
    dropped = var.where(F.col("n_values") < min_values).select(*group, rater)
    key = [*group, rater]
    gone = dropped.select(*[F.col(c).alias(f"__{c}") for c in key])
    return cells.join(gone, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left_anti"), dropped


def complete_cases(cells: DataFrame, group: Sequence[str] = ("exp",), rater: str = "session_id",
                   stim: str = "trial_name", value: str = "dv") -> DataFrame:
    """Cells of the stimuli answered (non-null) by every rater of the group."""
    g = list(group)
    k = cells.groupBy(*g).agg(F.count_distinct(rater).alias("__k"))
    k = k.select(*[F.col(c).alias(f"__{c}") for c in g], "__k")
    per_stim = cells.groupBy(*g, stim).agg(F.count(value).alias("__m"))
    full = per_stim.join(k, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in g]).where(F.col("__m") == F.col("__k"))
    full = full.select(*[F.col(c).alias(f"__{c}") for c in [*g, stim]])
    return cells.join(full, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*g, stim]], "left_semi")


# --------------------------------------------------------------------------
# The sums
# --------------------------------------------------------------------------
def numeric(df: DataFrame, value: str) -> Column:
    """The answers as BIGINT if their type holds whole numbers only, else as
    double."""
    return F.col(value).cast("long" if isinstance(df.schema[value].dataType, T.IntegralType) else "double")


def with_every_group(found: DataFrame, cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """``found`` (one row per group) completed by a row of nulls for each
    group of ``cells`` that it lacks; a null group counts as a group."""
    g = list(group)
    every = cells.select(*[F.col(c).alias(f"__{c}") for c in g]).distinct()
    on = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in g]
    rest = [c for c in found.columns if c not in g]
    return every.join(found, on, "left").select(*[F.col(f"__{c}").alias(c) for c in g], *rest)


def unbalanced_components(sums: DataFrame, group: Sequence[str], n_cells: str = "n") -> DataFrame:
    """Variance components of the two-way random model from the sums of each
    group: a stimuli, b raters, n cells, tm = G^2/N, t0 = sum x^2, ta = sum
    S_i^2/n_i (stimuli), tb = sum S_j^2/n_j (raters), q1 = sum n_i^2 and q2 =
    sum n_j^2.

    With k1 = q1/N and k2 = q2/N the expectations give v_rater + v_error = P =
    (t0 - ta)/(N - a), v_stim + v_error = Q = (t0 - tb)/(N - b) and v_error =
    ((N - k1) Q + (a - k2) P - (ta - tm)) / (N - k1 - k2 + 1).  Moments do not
    keep a component at 0 or above; ``improper`` says that one is below, and
    where the error, or what lies between raters, comes out below 0 there is
    no estimate (see ``icc2k_of_components``)."""
    a, b, n = F.col("a"), F.col("b"), F.col(n_cells)
    sums = sums.withColumns({"p": F.try_divide(F.col("t0") - F.col("ta"), n - a),
                             "q": F.try_divide(F.col("t0") - F.col("tb"), n - b),
                             "k1": F.try_divide(F.col("q1"), n), "k2": F.try_divide(F.col("q2"), n)})
    error = F.try_divide(
        (n - F.col("k1")) * F.col("q") + (a - F.col("k2")) * F.col("p") - (F.col("ta") - F.col("tm")),
        n - F.col("k1") - F.col("k2") + 1)
    # what is 0 but for rounding is 0
    error = F.when(F.abs(error) <= 1e-12 * F.col("t0"), 0.0).otherwise(error)
    out = sums.withColumn("v_error", F.when((a >= 2) & (b >= 2), error))
    v_stim, v_rater = F.col("q") - F.col("v_error"), F.col("p") - F.col("v_error")
    return out.select(
        *group, a.cast("long").alias("n_stim"), b.cast("long").alias("n_rater"), n.cast("long").alias("n_cells"),
        v_stim.alias("v_stim"), v_rater.alias("v_rater"), "v_error",
        F.coalesce((v_stim < 0) | (v_rater < 0) | (F.col("v_error") < 0), F.lit(False)).alias("improper"),
        (F.col("v_error") + b * v_stim).alias("msb"), (F.col("v_error") + a * v_rater).alias("msj"),
        F.col("v_error").alias("mse"))


def icc2k_of_components() -> Column:
    """v_stim over v_stim + (v_rater + v_error) / k; null where the parts
    below the line are not those of any model."""
    rest = F.col("v_rater") + F.col("v_error")
    total = F.col("v_stim") + rest / F.col("n_rater")
    return F.when((F.col("v_error") >= 0) & (rest >= 0) & (total > 0), F.col("v_stim") / total)


def components(cells: DataFrame, group: Sequence[str] = ("exp",), rater: str = "session_id",
               stim: str = "trial_name", value: str = "dv") -> DataFrame:
    """``unbalanced_components`` from all present cells, whatever is missing:
    one ``GROUPING SETS`` aggregate by stimulus, by rater and in total."""
    g = list(group)
    rows = cells.where(F.col(value).isNotNull()).select(*g, rater, stim, numeric(cells, value).alias("__x"))
    sets = rows.groupingSets([[*g, stim], [*g, rater], list(g)], *g, stim, rater).agg(
        F.sum("__x").cast("double").alias("__s"), F.sum(F.col("__x") * F.col("__x")).cast("double").alias("__ss"),
        F.count(F.lit(1)).cast("double").alias("__c"), F.grouping_id().alias("__gid"))
    gid, s, c = F.col("__gid"), F.col("__s"), F.col("__c")

    def over(kind: int, x: Column) -> Column:
        return F.sum(F.when(gid == kind, x))

    # grouping_id 1: by stimulus, 2: by rater, 3: the group's total
    sums = sets.groupBy(*g).agg(
        over(1, F.lit(1.0)).alias("a"), over(2, F.lit(1.0)).alias("b"), over(3, c).alias("n"),
        over(3, s * s / c).alias("tm"), over(3, F.col("__ss")).alias("t0"),
        over(1, s * s / c).alias("ta"), over(2, s * s / c).alias("tb"),
        over(1, c * c).alias("q1"), over(2, c * c).alias("q2"))
    return unbalanced_components(sums, g)


def variance_sums(rect: DataFrame, group: Sequence[str] = ("exp",), rater: str = "session_id",
                  stim: str = "trial_name", value: str = "dv") -> DataFrame:
    """Per group: n_stim (n), n_rater (k), T, sum x^2, sum over stimuli of
    S_i^2 and over raters of S_j^2, from a complete rectangle of cells.

    One scan: ``GROUPING SETS ((g, stim), (g, rater), (g))``, then one small
    aggregate per group.  Answers of a whole-number type are summed as BIGINT
    (exact), all others as doubles."""
    g = list(group)
    x = numeric(rect, value)
    base = rect.select(*g, rater, stim, x.alias("__x"))
    sets = base.groupingSets(
        [[*g, stim], [*g, rater], list(g)], *g, stim, rater
    ).agg(
        F.sum("__x").alias("__s"),
        F.sum(F.col("__x") * F.col("__x")).alias("__ss"),
        F.count(F.lit(1)).alias("__c"),
        F.grouping_id().alias("__gid"),
    )
    # grouping_id bits: (stim, rater) in that order after the group keys.
    # (g, stim): rater aggregated -> bit 0 set; (g, rater): stim aggregated
    # -> bit 1 set; (g): both set.
    gid = F.col("__gid")
    is_stim = gid == 1
    is_rater = gid == 2
    is_total = gid == 3
    return sets.groupBy(*g).agg(
        F.sum(F.when(is_stim, 1).otherwise(0)).cast("long").alias("n_stim"),
        F.sum(F.when(is_rater, 1).otherwise(0)).cast("long").alias("n_rater"),
        F.max(F.when(is_total, F.col("__s"))).alias("total"),
        F.max(F.when(is_total, F.col("__ss"))).alias("sum_sq"),
        F.sum(F.when(is_stim, F.col("__s") * F.col("__s"))).alias("ss_stim"),
        F.sum(F.when(is_rater, F.col("__s") * F.col("__s"))).alias("ss_rater"),
    )


def mean_squares(sums: DataFrame) -> DataFrame:
    """Two-way ANOVA mean squares from ``variance_sums`` (doubles).  A
    degenerate group (one rater or one stimulus) gives nulls, not an
    error."""
    n = F.col("n_stim").cast("double")
    k = F.col("n_rater").cast("double")
    t = F.col("total").cast("double")
    c = t * t / (n * k)
    ssb = F.col("ss_stim").cast("double") / k - c
    ssj = F.col("ss_rater").cast("double") / n - c
    sse = F.col("sum_sq").cast("double") - c - ssb - ssj
    return sums.select(
        "*",
        F.try_divide(ssb, n - 1).alias("msb"),
        F.try_divide(ssj, k - 1).alias("msj"),
        F.try_divide(sse, (n - 1) * (k - 1)).alias("mse"),
    )


def _ok() -> Column:
    return (F.col("n_rater") >= 2) & (F.col("n_stim") >= 2)


def icc2k_column() -> Column:
    n = F.col("n_stim").cast("double")
    return F.when(_ok(), F.try_divide(F.col("msb") - F.col("mse"), F.col("msb") + (F.col("msj") - F.col("mse")) / n))


def icc21_column() -> Column:
    n = F.col("n_stim").cast("double")
    k = F.col("n_rater").cast("double")
    return F.when(_ok(), F.try_divide(
        F.col("msb") - F.col("mse"),
        F.col("msb") + (k - 1) * F.col("mse") + k * (F.col("msj") - F.col("mse")) / n,
    ))


def alpha_column() -> Column:
    """Raw Cronbach's alpha with raters as items:
    k/(k-1) * (1 - sum of rater variances / variance of stimulus totals)."""
    n = F.col("n_stim").cast("double")
    k = F.col("n_rater").cast("double")
    t = F.col("total").cast("double")
    item_var = F.col("sum_sq").cast("double") - F.col("ss_rater").cast("double") / n
    total_var = F.col("ss_stim").cast("double") - t * t / n
    return F.when(_ok(), F.try_divide(k, k - 1) * (1 - F.try_divide(item_var, total_var)))


def prepared_cells(cells: DataFrame, min_values: int | None = 3, group: Sequence[str] = ("exp",),
                   rater: str = "session_id", stim: str = "trial_name", value: str = "dv") -> tuple[DataFrame, DataFrame | None]:
    if min_values:
        kept, dropped = screen_raters(cells, min_values, group, rater, stim, value)
    else:
        kept, dropped = cells, None
    return complete_cases(kept, group, rater, stim, value), dropped


# --------------------------------------------------------------------------
# R2 / R3  ICC(2,k)
# --------------------------------------------------------------------------
def screened(cells: DataFrame, min_values: int | None, group: Sequence[str], rater: str, stim: str,
             value: str) -> DataFrame:
    return screen_raters(cells, min_values, group, rater, stim, value)[0] if min_values else cells


def _complete_sums(cells: DataFrame, kept: DataFrame, group: Sequence[str], rater: str, stim: str,
                   value: str) -> DataFrame:
    """Mean squares of the complete stimuli for every group of ``cells``,
    with what the screened cells lost by leaving out the others."""
    g = list(group)
    ms = mean_squares(variance_sums(complete_cases(kept, g, rater, stim, value), g, rater, stim, value))
    had = kept.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(f"__{c}") for c in g]).agg(
        F.count_distinct(rater).alias("__raters"), F.count_distinct(stim).alias("__stimuli"),
        F.count(F.lit(1)).alias("__cells"))
    out = with_every_group(ms, cells, g)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in g]
    out = out.join(had, on, "left").drop(*[f"__{c}" for c in g])
    none = F.lit(0).cast("long")
    return out.withColumns({
        "n_raters": F.coalesce("n_rater", "__raters", none), "n_stimuli": F.coalesce("n_stim", none),
        "n_stimuli_dropped": F.coalesce("__stimuli", none) - F.coalesce("n_stim", none),
        "n_cells_dropped": F.coalesce("__cells", none) - F.coalesce(F.col("n_stim") * F.col("n_rater"), none),
    })


def _all_cells(cells: DataFrame, kept: DataFrame, group: Sequence[str], rater: str, stim: str,
               value: str) -> DataFrame:
    out = with_every_group(components(kept, group, rater, stim, value), cells, group)
    none = F.lit(0).cast("long")
    return out.withColumns({
        "n_raters": F.coalesce("n_rater", none), "n_stimuli": F.coalesce("n_stim", none),
        "n_cells_missing": F.coalesce(F.col("n_stim") * F.col("n_rater") - F.col("n_cells"), none),
        "improper": F.coalesce("improper", F.lit(False)),
    })


def icc2k(cells: DataFrame, min_values: int | None = 3, group: Sequence[str] = ("exp",), rater: str = "session_id",
          stim: str = "trial_name", value: str = "dv", missing: str = "complete") -> DataFrame:
    """ICC(2,k) per group: (group..., n_raters, n_stimuli, icc2k, msb, msj,
    mse) and, by ``missing`` (see the module text), n_stimuli_dropped and
    n_cells_dropped or n_cells_missing and improper (a variance component
    came out below 0).  Raters with fewer than
    ``min_values`` distinct answers are dropped first (``None``/0 disables).
    Every group of ``cells`` has a row; fewer than 2 raters or stimuli give
    nulls."""
    kept = screened(cells, min_values, group, rater, stim, value)
    if missing == "all":
        c = _all_cells(cells, kept, group, rater, stim, value)
        return c.select(*group, "n_raters", "n_stimuli", "n_cells_missing", "improper",
                        icc2k_of_components().alias("icc2k"), "msb", "msj", "mse")
    ms = _complete_sums(cells, kept, group, rater, stim, value)
    return ms.select(*group, "n_raters", "n_stimuli", "n_stimuli_dropped", "n_cells_dropped",
                     icc2k_column().alias("icc2k"), "msb", "msj", "mse")


def with_icc_bounds(icc: DataFrame, conf: float = 0.95) -> DataFrame:
    """Adds ``icc2k_lower``/``icc2k_upper``: Satterthwaite degrees of freedom
    for the rater term, F quantiles (``dist_columns``), then the
    Spearman-Brown step to k raters.  Null where the error is not above 0 or
    the ICC itself is null."""
    n, k = F.col("n_stimuli").cast("double"), F.col("n_raters").cast("double")
    msb, msj, mse = F.col("msb"), F.col("msj"), F.col("mse")
    ok = (n >= 2) & (k >= 2) & (mse > 0) & F.col("icc2k").isNotNull()
    q = 1 - (1 - conf) / 2
    rows = icc.withColumn("__r", F.when(ok, F.try_divide(msb - mse, msb + (k - 1) * mse + k * (msj - mse) / n)))
    r, fj = F.col("__r"), msj / mse
    rows = rows.withColumns({"__fj": F.when(ok, fj), "__a": n * (1 + (k - 1) * r) - k * r})
    a, fj = F.col("__a"), F.col("__fj")
    rows = rows.withColumn("__v", F.try_divide(
        (k - 1) * (n - 1) * (k * r * fj + a) * (k * r * fj + a), (n - 1) * k * k * r * r * fj * fj + a * a))
    rows = rows.withColumns({"__f1": f_quantile(q, n - 1, F.col("__v")), "__f2": f_quantile(q, F.col("__v"), n - 1),
                             "__c": k * msj + (k * n - k - n) * mse})
    f1, f2, c = F.col("__f1"), F.col("__f2"), F.col("__c")
    low = F.try_divide(n * (msb - f1 * mse), f1 * c + n * msb)
    high = F.try_divide(n * (f2 * msb - mse), c + n * f2 * msb)

    def up(x: Column) -> Column:
        return F.try_divide(k * x, 1 + (k - 1) * x)

    return rows.select(*icc.columns, up(low).alias("icc2k_lower"), up(high).alias("icc2k_upper"))


def dropped_raters(cells: DataFrame, min_values: int = 3, group: Sequence[str] = ("exp",), rater: str = "session_id",
                   stim: str = "trial_name", value: str = "dv") -> DataFrame:
    """Per group, how many raters were dropped and their ids (ordered,
    '; '-separated).  The id list is built by ``listagg`` per task; it only
    holds the dropped raters."""
    _, dropped = screen_raters(cells, min_values, group, rater, stim, value)
    return dropped.groupBy(*group).agg(
        F.count(F.lit(1)).cast("long").alias("dropped_n"),
        F.expr(f"listagg(cast(`{rater}` as string), '; ') within group (order by `{rater}`)").alias("dropped_ids"),
    )


def dropped_rater_rows(cells: DataFrame, min_values: int = 3, group: Sequence[str] = ("exp",),
                       rater: str = "session_id", stim: str = "trial_name", value: str = "dv") -> DataFrame:
    """R3 as rows (group..., rater, n_values): a list of any length without a
    long cell."""
    return rater_variety(cells, group, rater, stim, value).where(F.col("n_values") < min_values)


# --------------------------------------------------------------------------
# R6  Cronbach's alpha
# --------------------------------------------------------------------------
def cronbach_alpha(cells: DataFrame, min_values: int | None = 3, group: Sequence[str] = ("exp",),
                   rater: str = "session_id", stim: str = "trial_name", value: str = "dv",
                   missing: str = "complete") -> DataFrame:
    """R6 per group, every group of ``cells`` with a row.  With
    ``missing='all'`` and absent cells alpha is the consistency of the
    components, k v_stim / (k v_stim + v_error), which equals raw alpha on a
    full rectangle; ``estimator`` says which of the two it is."""
    kept = screened(cells, min_values, group, rater, stim, value)
    if missing == "all":
        c = _all_cells(cells, kept, group, rater, stim, value)
        true = F.col("n_rater") * F.col("v_stim")
        return c.select(*group, "n_raters", "n_stimuli", "n_cells_missing",
                        F.when(F.col("n_cells_missing") == 0, "complete").otherwise("components").alias("estimator"),
                        F.when((F.col("v_error") >= 0) & (true + F.col("v_error") > 0),
                               true / (true + F.col("v_error"))).alias("alpha"))
    sums = _complete_sums(cells, kept, group, rater, stim, value)
    return sums.select(*group, "n_raters", "n_stimuli", "n_stimuli_dropped", "n_cells_dropped",
                       F.lit("complete").alias("estimator"), alpha_column().alias("alpha"))


# --------------------------------------------------------------------------
# R7  McDonald's omega total (one factor): NumPy reference for one small
# correlation matrix, then the distributed fit
# --------------------------------------------------------------------------
MIN_UNIQUENESS = 0.005


def one_factor_minres(r, tol: float = 1e-10, max_iter: int = 5000, flag: bool = False):
    """Loadings of one factor fitted by minimum residuals (unweighted least
    squares on the off-diagonal), by iterated principal axes from squared
    multiple correlations (largest correlations where the matrix is
    singular).  Uniquenesses are held at ``MIN_UNIQUENESS`` or more; with
    ``flag`` the result is (loadings, converged)."""
    import numpy as np

    r = np.asarray(r, dtype=float)
    k = r.shape[0]
    if np.linalg.matrix_rank(r) == k:
        h2 = 1.0 - 1.0 / np.diag(np.linalg.inv(r))
    else:
        h2 = np.max(np.abs(r - np.diag(np.diag(r))), axis=1)
    lam, converged = np.zeros(k), False
    h2 = np.clip(h2, 0.0, 1.0 - MIN_UNIQUENESS)
    for _ in range(max_iter):
        rr = r.copy()
        np.fill_diagonal(rr, h2)
        w, v = np.linalg.eigh(rr)
        lam = v[:, -1] * np.sqrt(max(w[-1], 0.0))
        # held to proper solutions: no communality above 1 - MIN_UNIQUENESS
        lam = np.clip(lam, -np.sqrt(1.0 - MIN_UNIQUENESS), np.sqrt(1.0 - MIN_UNIQUENESS))
        new = lam * lam
        converged = bool(np.max(np.abs(new - h2)) < tol)
        h2 = new
        if converged:
            break
    if lam.sum() < 0:
        lam = -lam
    return (lam, converged) if flag else lam


def omega_from_corr(r, flag: bool = False):
    """Omega total of a one-factor model: 1 - sum of uniquenesses / sum of
    the correlation matrix, with raters of negative loading reversed; with
    ``flag`` also whether the fit converged."""
    import numpy as np

    r = np.asarray(r, dtype=float)
    lam, converged = one_factor_minres(r, flag=True)
    sign = np.where(lam < 0, -1.0, 1.0)
    rf = r * np.outer(sign, sign)
    omega = float(1.0 - np.sum(1.0 - lam * lam) / rf.sum())
    return (omega, converged) if flag else omega


def standardised(cells: DataFrame, group: Sequence[str], rater: str, stim: str, value: str) -> DataFrame:
    """(__g, __r, __s, z): the present cells, each rater's answers centred on
    their mean and scaled to a sum of squares of 1, so that raters' sums of
    products are correlations.  An absent cell is 0, the rater's mean.
    Raters whose answers do not vary correlate with nothing and are left
    out."""
    x = F.col(value).cast("double")
    rows = cells.where(x.isNotNull()).select(
        F.struct(*[F.col(c) for c in group], F.lit(0).alias("__0")).alias("__g"),
        F.struct(F.col(rater), F.lit(0).alias("__0")).alias("__r"),
        F.struct(F.col(stim), F.lit(0).alias("__0")).alias("__s"), x.alias("__x"))
    size = rows.groupBy(F.col("__g").alias("__sg"), F.col("__r").alias("__sr")).agg(
        F.avg("__x").alias("__m"), (F.var_pop("__x") * F.count("__x")).alias("__ss"),
        F.max(F.abs("__x")).alias("__big"), F.count("__x").alias("__c"))
    size = size.where(F.col("__ss") > 1e-12 * F.col("__big") * F.col("__big") * F.col("__c"))
    on = F.col("__g").eqNullSafe(F.col("__sg")) & F.col("__r").eqNullSafe(F.col("__sr"))
    return rows.join(size, on).select("__g", "__r", "__s", ((F.col("__x") - F.col("__m")) / F.sqrt("__ss")).alias("z"))


def loading_step(z: DataFrame, state: DataFrame) -> DataFrame:
    """One step towards the one-factor loadings of least squared residuals off
    the diagonal; staged.  ``state``: __g, __r, the loadings ``l``, and ``l1``, ``f1``,
    ``l2``, ``f2``, the loadings and changes of the two steps before.

    The products of the correlations and the loadings come without the
    correlations: weighted sums of the cells by stimulus, then by rater, two
    partial aggregates.  With y these products off the diagonal, l and y are
    scaled so that l fits best as it is, then each loading becomes the best
    one given the others, y / (sum of squares of the others), held to a
    uniqueness of ``MIN_UNIQUENESS`` or more; ``moved`` is that change.  Plain
    steps approach the solution by a constant share.  So the next loadings are
    the combination of the last three points whose combined change is least
    (two coefficients per group, from five sums), which takes a fraction of
    the steps."""
    most = (1.0 - MIN_UNIQUENESS) ** 0.5

    def held(x: Column) -> Column:
        return F.greatest(F.least(x, F.lit(most)), F.lit(-most))

    kept = ["l", "l1", "f1", "l2", "f2"]
    w = state.select(F.col("__g").alias("__wg"), F.col("__r").alias("__wr"), *kept)
    mine = z.join(w, F.col("__g").eqNullSafe(F.col("__wg")) & F.col("__r").eqNullSafe(F.col("__wr")))
    sums = mine.groupBy(F.col("__g").alias("__ug"), F.col("__s").alias("__us")).agg(
        F.sum(F.col("z") * F.col("l")).alias("__u"))
    back = mine.join(sums, F.col("__g").eqNullSafe(F.col("__ug")) & F.col("__s").eqNullSafe(F.col("__us")))
    y = back.groupBy("__g", "__r").agg(F.sum(F.col("z") * F.col("__u")).alias("__y"), *[F.first(c).alias(c) for c in kept])
    # one row per rater, read several times below
    y = staged(y.withColumn("__y", F.col("__y") - F.col("l")))
    sq = F.col("l") * F.col("l")
    fit = y.groupBy(F.col("__g").alias("__fg")).agg(
        F.sum(sq).alias("__s2"), F.sum(sq * sq).alias("__s4"), F.sum(F.col("l") * F.col("__y")).alias("__ly"))
    c2 = F.try_divide(F.col("__ly"), F.col("__s2") * F.col("__s2") - F.col("__s4"))
    fit = fit.select("__fg", "__s2", F.when(c2 > 0, F.sqrt(c2)).alias("__c"))
    best = held(F.try_divide(F.try_divide(F.col("__y"), F.col("__c")), F.col("__s2") - sq))
    out = y.join(fit, F.col("__g").eqNullSafe(F.col("__fg"))).select("__g", "__r", *kept, (best - F.col("l")).alias("f"))
    out = out.withColumns({"d1": F.col("f") - F.col("f1"), "d2": F.col("f") - F.col("f2")})
    d1, d2, f = F.col("d1"), F.col("d2"), F.col("f")
    gram = out.groupBy(F.col("__g").alias("__hg")).agg(
        F.sum(d1 * d1).alias("a11"), F.sum(d1 * d2).alias("a12"), F.sum(d2 * d2).alias("a22"),
        F.sum(d1 * f).alias("b1"), F.sum(d2 * f).alias("b2"))
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    both = det > 1e-12 * F.col("a11") * F.col("a22")
    gram = gram.select(
        "__hg",
        F.coalesce(F.when(both, (F.col("b1") * F.col("a22") - F.col("b2") * F.col("a12")) / det),
                   F.try_divide("b1", "a11"), F.lit(0.0)).alias("w1"),
        F.coalesce(F.when(both, (F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1")) / det), F.lit(0.0)).alias("w2"))
    out = out.join(gram, F.col("__g").eqNullSafe(F.col("__hg")))
    none = F.lit(0.0)
    back1 = F.coalesce(F.col("w1") * (F.col("l") - F.col("l1") + d1), none)
    back2 = F.coalesce(F.col("w2") * (F.col("l") - F.col("l2") + d2), none)
    new = staged(out.select("__g", "__r", held(F.col("l") + f - back1 - back2).alias("l"), F.col("l").alias("l1"),
                            f.alias("f1"), F.col("l1").alias("l2"), F.col("f1").alias("f2"), F.abs(f).alias("moved")))
    discard(y)
    return new


def omega_total(cells: DataFrame, min_values: int | None = 3, group: Sequence[str] = ("exp",),
                rater: str = "session_id", stim: str = "trial_name", value: str = "dv", max_steps: int = 100,
                tol: float = 3e-7) -> DataFrame:
    """R7 per group: (group..., n_raters, n_cells_missing, omega_t,
    converged), every group of ``cells`` with a row.

    The one-factor loadings come from matrix-free steps (``loading_step``):
    a step reads the cells twice and keeps one number per rater and one per
    stimulus, so neither a raters x raters matrix nor a group is ever in one
    task.  Steps are staged; they end when no loading of any group moves by
    ``tol``, or after ``max_steps`` (``converged`` is false then).  Omega is 1
    - sum of uniquenesses / sum of all correlations, raters of negative
    loading reversed; the sum of correlations is that of the squared stimulus
    sums.  Null for fewer than two raters whose answers vary, or where no
    positive factor exists."""
    g = list(group)
    kept = screened(cells, min_values, g, rater, stim, value)
    z = staged(standardised(kept, g, rater, stim, value))
    null = F.lit(None).cast("double")
    loadings = staged(z.select("__g", "__r").distinct().select(
        "__g", "__r", F.lit(0.5).alias("l"), *[null.alias(c) for c in ("l1", "f1", "l2", "f2")], F.lit(1.0).alias("moved")))
    moved, steps = 1.0, 0
    while moved is not None and moved > tol and steps < max_steps:
        new = loading_step(z, loadings)
        discard(loadings)
        loadings, steps = new, steps + 1
        moved = loadings.agg(F.max("moved")).first()[0]
    sign = F.when(F.col("l") < 0, -1.0).otherwise(1.0).alias("__w")
    w = loadings.select(F.col("__g").alias("__wg"), F.col("__r").alias("__wr"), sign)
    sums = z.join(w, F.col("__g").eqNullSafe(F.col("__wg")) & F.col("__r").eqNullSafe(F.col("__wr"))).groupBy(
        "__g", "__s").agg(F.sum(F.col("z") * F.col("__w")).alias("__u"), F.count(F.lit(1)).alias("__c"))
    total = sums.groupBy("__g").agg(F.sum(F.col("__u") * F.col("__u")).alias("total"), F.count(F.lit(1)).alias("n_stim"),
                                    F.sum("__c").alias("n_cells"))
    unique = loadings.groupBy(F.col("__g").alias("__fg")).agg(
        F.count(F.lit(1)).alias("k"), F.sum(1 - F.col("l") * F.col("l")).alias("unique"), F.count("l").alias("known"),
        F.max("moved").alias("moved"))
    omega = F.when((F.col("k") >= 2) & (F.col("known") == F.col("k")), 1 - F.try_divide(F.col("unique"), F.col("total")))
    out = total.join(unique, F.col("__g").eqNullSafe(F.col("__fg"))).select(
        *[F.col("__g")[c].alias(c) for c in g], F.col("k").alias("n_raters"),
        (F.col("k") * F.col("n_stim") - F.col("n_cells")).alias("n_cells_missing"), omega.alias("omega_t"),
        (omega.isNotNull() & (F.col("moved") <= tol)).alias("converged"))
    none = F.lit(0).cast("long")
    return with_every_group(out, cells, g).select(
        *g, F.coalesce("n_raters", none).alias("n_raters"), F.coalesce("n_cells_missing", none).alias("n_cells_missing"),
        "omega_t", F.coalesce("converged", F.lit(False)).alias("converged"))
