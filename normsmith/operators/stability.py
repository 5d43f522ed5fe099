"""Point of stability of means.

Pipeline: centre ratings per (task, stimulus) -> bootstrap means for sample
sizes 1..N -> an interval per (task, N) over all stimuli and iterations ->
the first N whose interval lies inside +/- threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import resample as RS
from .clean import widest
from .quantile import order_statistics


def percentile_interval(means: DataFrame, interval: float = 0.95, group: Sequence[str] = ("exp",),
                        size: str = "sample_size", value: str = "mean_rating") -> DataFrame:
    """With len values and b = floor(len*(1-interval)/2), the sorted
    values at positions b and len-b (1-based), not a quantile estimate.
    b = 0 has no lower position: ``ll`` is null then."""
    n = F.col("n_values")
    b = F.floor(n * F.lit(1.0 - interval) / 2)
    return order_statistics(means, [*group, size], value, {"ll": b - 1, "ul": n - b - 1}).select(
        *group, size, "ll", "ul")


def normal_interval(means: DataFrame, interval: float = 0.95, group: Sequence[str] = ("exp",),
                    size: str = "sample_size", value: str = "mean_rating") -> DataFrame:
    """Mean +/- z * sd / sqrt(n) per (group, size)."""
    z = NormalDist().inv_cdf(interval + (1 - interval) / 2)
    margin = F.lit(z) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return means.groupBy(*group, size).agg(
        (F.avg(value) - margin).alias("ll"),
        (F.avg(value) + margin).alias("ul"),
    )


def interval(means: DataFrame, interval: float = 0.95, method: str = "percentile", group: Sequence[str] = ("exp",),
             size: str = "sample_size", value: str = "mean_rating") -> DataFrame:
    """Dispatch on ``method``."""
    if method == "percentile":
        return percentile_interval(means, interval, group, size, value)
    if method == "normal":
        return normal_interval(means, interval, group, size, value)
    raise ValueError(f"unknown interval method {method!r}: percentile or normal")


def point_of_stability(cis: DataFrame, threshold: float = 0.5, inarow: int = 1, mode: str = "first",
                       group: Sequence[str] = ("exp",), size: str = "sample_size") -> DataFrame:
    """Per group, the first size (position in the ordered series) from
    which ``inarow`` consecutive intervals lie strictly inside +/-threshold.

    ``mode='first'`` is the reference's rule; ``'sustained'`` asks that no
    later interval leaves the corridor again (the rule stated in its text).
    Null when no such size exists or the series is shorter than ``inarow``.
    """
    t = abs(threshold)
    stable = F.coalesce((widest(F.col("ll"), F.col("ul")) < t).cast("int"), F.lit(0))
    w = Window.partitionBy(*group).orderBy(size)
    if mode == "first":
        frame = w.rowsBetween(0, inarow - 1)
        run = (F.min(stable).over(frame) == 1) & (F.count(F.lit(1)).over(frame) == inarow)
    elif mode == "sustained":
        frame = w.rowsBetween(0, Window.unboundedFollowing)
        run = F.min(stable).over(frame) == 1
    else:
        raise ValueError("mode must be 'first' or 'sustained'")
    flagged = cis.select(*group, size, F.row_number().over(w).alias("__idx"), run.alias("__run"))
    return flagged.groupBy(*group).agg(F.min(F.when(F.col("__run"), F.col("__idx"))).cast("long").alias("pos"))


def ribbon(cis: DataFrame, pos: DataFrame, group: Sequence[str] = ("exp",), size: str = "sample_size") -> DataFrame:
    """A16 + D11: mean bounds per (group, size) with the group's point of
    stability attached."""
    mean_bounds = cis.groupBy(*group, size).agg(F.avg("ll").alias("ll"), F.avg("ul").alias("ul"))
    return mean_bounds.join(pos, list(group), "left")


@dataclass
class StabilityResult:
    cis: DataFrame
    pos: DataFrame
    means: DataFrame | None = None


def stability_stats(cells: DataFrame, N: int = 100, iterations: int = 500, ci_interval: float = 0.95,
                    ci_method: str = "percentile", cos_threshold: float = 0.5, seed: int = 123, iter_start: int = 0,
                    save_means: bool = False, group: Sequence[str] = ("exp",), stim: str = "trial_name",
                    value: str = "dv", rater: str = "session_id", method: str = "join",
                    algo: str = "md5") -> StabilityResult:
    """Centre -> resample -> interval per (group, N) -> POS.  The means
    are checkpointed once (when a checkpoint folder is configured): the
    interval reads them twice (group sizes, then ranks).  ``method='values'``
    is for the full workload (``resample.bootstrap_by_value``)."""
    from ..session import cut_lineage, staged

    if method == "values":
        means = staged(RS.bootstrap_by_value(cells, N, iterations, seed, iter_start, group, stim, value))
    else:
        means = cut_lineage(RS.bootstrap_means(cells, N, iterations, seed, iter_start, group, stim, value, rater, method,
                                               algo=algo))
    cis = interval(means, ci_interval, ci_method, group)
    pos = point_of_stability(cis, cos_threshold, group=group)
    return StabilityResult(cis, pos, means if save_means else None)
