"""Rater screening: keep-first dedup, completeness, first task, and the four
exclusion rules with their ledger (SURVEY Q1-Q13, W1-W3, A5, A8-A10).

All rules are grouped aggregates with map-side partial aggregation; none
pivots raters into columns and none gathers a group into one task.  The
ledger and the flagged sets are tiny (one row per flagged rater/task); the
joins against the fact table are left-semi/anti joins that Spark may turn
into broadcasts at runtime (AQE) when the measured side is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_match_removed
from ..session import cut_lineage


# --------------------------------------------------------------------------
# Q1 / W1  keep-first per key
# --------------------------------------------------------------------------
def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the row that sorts first by ``order``
    (ascending, nulls last), i.e. ``arrange(keys, order) |> distinct(keys)``.

    Written as ``min(struct(order..., payload...))`` per key: an aggregate
    with a partial (map-side) step, so a key holding a third of all rows is
    reduced inside every map task before the shuffle; no sort of a whole
    group in one task.  A struct buffer makes Spark use its sort-based
    aggregate; grouping by a 64-bit hash of the key first (it adds no
    groups) gives that sort a distinct 8-byte prefix to radix-sort on.
    """
    keys = list(keys)
    order = list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    fields = []
    for i, c in enumerate(order):
        fields.append(F.col(c).isNull().alias(f"__null{i}"))  # nulls last
        fields.append(F.col(c).alias(c))
    fields += [F.col(c).alias(c) for c in rest]
    first = F.min(F.struct(*fields)).alias("__first")
    out = df.withColumn("__kh", F.xxhash64(*keys)).groupBy("__kh", *keys).agg(first)
    return out.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in order + rest]).select(*df.columns)


# --------------------------------------------------------------------------
# Q2  incomplete tasks
# --------------------------------------------------------------------------
def trials_per_task(facts: DataFrame, task: str = "exp", rater: str = "session_id") -> DataFrame:
    """Task dimension ``(task, trials_total)`` when no project file is given:
    the largest number of distinct trials any rater answered in the task."""
    per = facts.groupBy(task, rater).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(task).agg(F.max("n").cast("long").alias("trials_total"))


def incomplete_tasks(
    firsts: DataFrame, tasks: DataFrame, task: str = "exp", rater: str = "session_id"
) -> DataFrame:
    """(rater, task, n, trials_total) where fewer trials than the task has
    were answered.  A null ``trials_total`` never counts as incomplete."""
    per = firsts.groupBy(rater, task).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return per.join(tasks, task, "left").where(F.col("n") < F.col("trials_total"))


def drop_incomplete(
    firsts: DataFrame, incomplete: DataFrame, scope: str = "session", task: str = "exp", rater: str = "session_id"
) -> DataFrame:
    """``scope='session'`` (as the reference code does) drops every task of a
    rater with any incomplete task; ``'task'`` drops only that task."""
    if scope == "session":
        return firsts.join(incomplete.select(rater).distinct(), rater, "left_anti")
    if scope == "task":
        return firsts.join(incomplete.select(rater, task), [rater, task], "left_anti")
    raise ValueError("scope must be 'session' or 'task'")


# --------------------------------------------------------------------------
# Q3  first task of a rater
# --------------------------------------------------------------------------
def first_task(
    facts: DataFrame, keep: str = "first", task: str = "exp", rater: str = "session_id", time: str = "dt"
) -> DataFrame:
    """Raters who did several tasks keep only the task they started first
    (ties: lowest task key).  ``keep='as_written'`` reproduces the written
    join key of the reference, which removes the first task instead."""
    per = facts.groupBy(rater, task).agg(F.min(time).alias("first_dt"))
    firsts = per.groupBy(rater).agg(
        F.count(F.lit(1)).alias("n_exp"),
        F.min(F.struct(F.col("first_dt").isNull(), F.col("first_dt"), F.col(task))).getField(task).alias("first_exp"),
    )
    if keep == "first":
        keep_set = firsts.select(rater, F.col("first_exp").alias(task))
        return facts.join(keep_set, [rater, task], "left_semi")
    if keep == "as_written":
        drop_set = firsts.where(F.col("n_exp") > 1).select(rater, F.col("first_exp").alias(task))
        return facts.join(drop_set, [rater, task], "left_anti")
    raise ValueError("keep must be 'first' or 'as_written'")


# --------------------------------------------------------------------------
# Q4 / Q5  overly consistent
# --------------------------------------------------------------------------
def response_profile(
    facts: DataFrame, task: str = "exp", rater: str = "session_id", value: str = "dv", stim: str = "trial_name"
) -> DataFrame:
    """Per (rater, task), non-check trials only: ``same_pcnt`` = share of the
    most frequent answer (missing counts as an answer and in the
    denominator) and ``n_unique`` = distinct non-missing answers."""
    rows = facts.where(~F.col(stim).startswith("check_"))
    counts = rows.groupBy(rater, task, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(rater, task).agg(
        (F.max("n") / F.sum("n")).alias("same_pcnt"),
        F.count(value).cast("long").alias("n_unique"),
    )


def overly_consistent(
    facts: DataFrame,
    share: float = 0.90,
    max_unique: int = 2,
    task: str = "exp",
    rater: str = "session_id",
    value: str = "dv",
    stim: str = "trial_name",
) -> DataFrame:
    """Q4 (share >= 0.90) full-outer Q5 (<= 2 distinct answers), one row per
    flagged (rater, task); the column of a rule that did not fire is null."""
    return consistent_among(response_profile(facts, task, rater, value, stim), share, max_unique, task, rater)


def consistent_among(
    prof: DataFrame, share: float = 0.90, max_unique: int = 2, task: str = "exp", rater: str = "session_id"
) -> DataFrame:
    """The same from completions with ``same_pcnt`` and ``n_unique``."""
    return prof.where((F.col("same_pcnt") >= share) | (F.col("n_unique") <= max_unique)).select(
        rater,
        task,
        F.when(F.col("same_pcnt") >= share, F.col("same_pcnt")).alias("same_pcnt"),
        F.when(F.col("n_unique") <= max_unique, F.col("n_unique")).alias("n_unique"),
    )


# --------------------------------------------------------------------------
# Q6  overly fast
# --------------------------------------------------------------------------
def median_rt(facts: DataFrame, task: str = "exp", rater: str = "session_id", rt: str = "rt") -> DataFrame:
    """Median rt per (rater, task), null if any rt is missing.  Exact,
    and safe when one rater's log holds a large share of all rows (see
    ``quantile.grouped_quantile``)."""
    from .quantile import grouped_quantile

    return grouped_quantile(facts, [rater, task], rt, 0.5, strict=True, out="med_rt")


def overly_fast(
    facts: DataFrame, prob: float = 0.01, task: str = "exp", rater: str = "session_id", rt: str = "rt"
) -> DataFrame:
    """Median rt strictly below the ``prob`` quantile (linear interpolation,
    R type 7 == Spark ``percentile``) of all (rater, task) medians; check
    trials included.  The medians (one row per task completion) are
    materialised once; their quantile is a scalar subquery of the filter."""
    from .quantile import quantile_scalar

    med = cut_lineage(median_rt(facts, task, rater, rt))
    return med.where(F.col("med_rt") < quantile_scalar(med, "med_rt", prob)).select(rater, task, "med_rt")


# --------------------------------------------------------------------------
# Q7  honesty
# --------------------------------------------------------------------------
def honesty_failed(quest_df: DataFrame, rater: str = "session_id", answer: str = "try_answer", ok: int = 2) -> DataFrame:
    """Sessions whose honesty answer is not ``ok``; a missing answer stays in."""
    return (
        quest_df.select(rater, F.col(answer).alias("honesty_check"))
        .distinct()
        .where(F.col("honesty_check").cast("string") != F.lit(str(ok)))
    )


# --------------------------------------------------------------------------
# Q8  attention checks
# --------------------------------------------------------------------------
# Fixed value: one failed check of seven is allowed.
ATTENTION_RATE = 6 / 7


def expected_answer(stim: str, task: str, substring_task: object | None = None) -> F.Column:
    """The answer a check trial asks for: its name after the first
    ``check_<word>_`` prefix; for ``substring_task`` characters 4-6 of it."""
    # Fixed value: the prefix pattern of check names.
    expected = first_match_removed(F.col(stim), "check_[a-z0-9-]+_")
    if substring_task is None:
        return expected
    return F.when(F.col(task) == F.lit(substring_task), F.substring(expected, 4, 3)).otherwise(expected)


def attention_failed(
    facts: DataFrame,
    min_rate: float = ATTENTION_RATE,
    substring_task: object | None = None,
    task: str = "exp",
    rater: str = "session_id",
    value: str = "dv",
    stim: str = "trial_name",
) -> DataFrame:
    """Pass rate of check trials below ``min_rate``.  The expected answer is
    the trial name after its first ``check_<word>_`` prefix; for
    ``substring_task`` only characters 4-6 of it count.  A missing answer
    makes the rate missing (never flagged), as R ``mean`` does."""
    checks = facts.where(F.col(stim).contains("check"))
    hit = (expected_answer(stim, task, substring_task) == F.col(value).cast("string")).cast("double")
    return (
        checks.withColumn("__hit", hit)
        .groupBy(rater, task)
        .agg(
            F.when(F.count(F.lit(1)) > F.count("__hit"), F.lit(None))
            .otherwise(F.avg("__hit"))
            .alias("attn_checks_passed")
        )
        .where(F.col("attn_checks_passed") < min_rate)
    )


# --------------------------------------------------------------------------
# Q9 ledger, Q10 apply, Q11 questionnaire, Q12 flow, Q13 counts
# --------------------------------------------------------------------------
# The ledger's column names.
LEDGER_COLUMNS = ("same_pcnt", "n_unique", "med_rt", "honesty_check", "attn_checks_passed")


def exclusion_ledger(
    consistent: DataFrame,
    fast: DataFrame,
    honesty: DataFrame,
    attention: DataFrame,
    task: str = "exp",
    rater: str = "session_id",
) -> DataFrame:
    """Full outer chain, one column per reason.  Honesty joins on the rater
    alone (it is per session), so an honesty-only row has a null task and a
    later attention row of the same rater stays a separate row."""
    led = consistent.join(fast, [rater, task], "full_outer")
    led = led.join(honesty, [rater], "full_outer")
    led = led.join(attention, [rater, task], "full_outer")
    return led.select(rater, task, *LEDGER_COLUMNS)


def apply_exclusions(
    facts: DataFrame, ledger: DataFrame, levels: DataFrame | None = None, task: str = "exp", rater: str = "session_id",
    stim: str = "trial_name",
) -> DataFrame:
    """Drop every task of an excluded rater, drop check trials, attach the
    task order (``levels``: task, ord) when given; tasks outside the level
    set get a null order, as a factor would give NA."""
    kept = facts.join(ledger.select(rater).distinct(), rater, "left_anti").where(~F.col(stim).contains("check_"))
    if levels is not None:
        kept = kept.join(levels, task, "left")
    return kept


def restrict_to(quest_df: DataFrame, facts: DataFrame, rater: str = "session_id") -> DataFrame:
    """Q11: questionnaire rows of raters who survive."""
    return quest_df.join(facts.select(rater).distinct(), rater, "left_semi")


def exclusion_counts(ledger: DataFrame) -> DataFrame:
    """Q13: per reason the number of ledger rows where it fired, plus the
    total; long form (reason, n)."""
    wide = ledger.agg(
        *[F.count(c).cast("long").alias(c) for c in LEDGER_COLUMNS],
        F.count(F.lit(1)).cast("long").alias("total"),
    )
    return wide.unpivot([], list(LEDGER_COLUMNS) + ["total"], "reason", "n")


def completion_profile(
    firsts: DataFrame, substring_task: object | None = None, task: str = "exp", rater: str = "session_id",
    value: str = "dv", stim: str = "trial_name", time: str = "dt",
) -> DataFrame:
    """One row per (rater, task) with what the rules ask for: n, first_dt,
    n_answers, same_pcnt, n_unique, attn_checks_passed.
    Answers are counted by value first (a partial aggregate), so a rater
    with a third of all rows is spread over the map tasks."""
    answer = ~F.col(stim).startswith("check_")
    check = F.col(stim).contains("check")
    hit = F.when(check, (expected_answer(stim, task, substring_task) == F.col(value).cast("string")).cast("double"))
    by_value = firsts.groupBy(rater, task, answer.alias("__a"), F.when(answer, F.col(value)).alias("__v")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(time).alias("first_dt"), F.count(F.when(check, 1)).alias("__checks"),
        F.count(hit).alias("__hits_n"), F.sum(hit).alias("__hits"))
    answers = F.when(F.col("__a"), F.col("__n"))
    return by_value.groupBy(rater, task).agg(
        F.sum("__n").cast("long").alias("n"), F.min("first_dt").alias("first_dt"),
        F.coalesce(F.sum(answers), F.lit(0)).alias("n_answers"), (F.max(answers) / F.sum(answers)).alias("same_pcnt"),
        F.count("__v").cast("long").alias("n_unique"),
        # a missing answer to a check makes the rate missing
        F.when(F.sum("__checks") == F.sum("__hits_n"), F.try_divide(F.sum("__hits"), F.sum("__hits_n")))
        .alias("attn_checks_passed"))


class Screening:
    """The screening flow Q1 -> Q2 -> (Q3) -> Q4..Q8 -> Q9 -> Q10/Q11.

    Every step is built on first access only (some steps run small jobs
    when built, e.g. the global quantile of the overly-fast rule), so a
    query that needs only the complete sessions does not pay for the
    ledger.  Small tables are materialised in the shared checkpoint folder
    (with ``materialise``, when the session names one): the keep-first
    ratings, so that the raw log is scanned once, and the profile with one
    row per (rater, task), from which the rules (the median time apart), the
    ledger and all counts are read; trials are only touched again to be returned."""

    def __init__(self, raw, quest, order, tasks=None, first_task_only=True, keep="first", scope="session",
                 substring_task=None, levels=None, task="exp", rater="session_id", stim="trial_name",
                 materialise=True, firsts=None):
        self.raw, self._quest_in, self.order = raw, quest, list(order)
        self._tasks, self.first_task_only, self.keep, self.scope = tasks, first_task_only, keep, scope
        self.substring_task, self.levels = substring_task, levels
        self.task, self.rater, self.stim = task, rater, stim
        self.materialise = materialise
        self._cache: dict[str, DataFrame] = {}
        if firsts is not None:
            self._cache["firsts"] = firsts

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def firsts(self) -> DataFrame:
        def build():
            out = keep_first(self.raw, [self.rater, self.task, self.stim], self.order)
            return cut_lineage(out) if self.materialise else out

        return self._get("firsts", build)

    @property
    def profile(self) -> DataFrame:
        """One row per (rater, task) of the keep-first ratings."""
        def build():
            out = completion_profile(self.firsts, self.substring_task, self.task, self.rater, stim=self.stim)
            return cut_lineage(out) if self.materialise else out

        return self._get("profile", build)

    @property
    def tasks(self) -> DataFrame:
        return self._get("tasks", lambda: self._tasks if self._tasks is not None else self.profile.groupBy(self.task)
                         .agg(F.max("n").cast("long").alias("trials_total")))

    @property
    def incomplete(self) -> DataFrame:
        return self._get("incomplete", lambda: self.profile.select(self.rater, self.task, "n").join(
            self.tasks, self.task, "left").where(F.col("n") < F.col("trials_total")))

    @property
    def complete_profile(self) -> DataFrame:
        return self._get("complete_profile", lambda: drop_incomplete(self.profile, self.incomplete, self.scope,
                                                                     self.task, self.rater))

    @property
    def completions(self) -> DataFrame:
        """The profile of the completions that the exclusion rules judge."""
        return self._get("completions", lambda: first_task(self.complete_profile, self.keep, self.task, self.rater,
                                                           time="first_dt")
                         if self.first_task_only else self.complete_profile)

    def _trials(self, of: DataFrame) -> DataFrame:
        return self.firsts.join(of.select(self.rater, self.task), [self.rater, self.task], "left_semi")

    @property
    def complete(self) -> DataFrame:
        return self._get("complete", lambda: self._trials(self.complete_profile))

    @property
    def exp_long(self) -> DataFrame:
        return self._get("exp_long", lambda: self._trials(self.completions))

    @property
    def consistent(self) -> DataFrame:
        return self._get("consistent", lambda: consistent_among(
            self.completions.where(F.col("n_answers") > 0), task=self.task, rater=self.rater))

    @property
    def fast(self) -> DataFrame:
        return self._get("fast", lambda: overly_fast(self.exp_long, task=self.task, rater=self.rater))

    @property
    def honesty(self) -> DataFrame:
        return self._get("honesty", lambda: honesty_failed(self._quest_in, self.rater))

    @property
    def attention(self) -> DataFrame:
        return self._get("attention", lambda: self.completions.where(F.col("attn_checks_passed") < ATTENTION_RATE)
                         .select(self.rater, self.task, "attn_checks_passed"))

    @property
    def ledger(self) -> DataFrame:
        def build():
            out = exclusion_ledger(self.consistent, self.fast, self.honesty, self.attention, self.task, self.rater)
            return cut_lineage(out) if self.materialise else out

        return self._get("ledger", build)

    @property
    def survivors(self) -> DataFrame:
        """The profile of the completions of raters who are not excluded."""
        return self._get("survivors", lambda: self.completions.join(
            self.ledger.select(self.rater).distinct(), self.rater, "left_anti"))

    @property
    def final(self) -> DataFrame:
        def build():
            kept = self._trials(self.survivors).where(~F.col(self.stim).contains("check_"))
            return kept if self.levels is None else kept.join(self.levels, self.task, "left")

        return self._get("final", build)

    @property
    def quest(self) -> DataFrame:
        return self._get("quest", lambda: restrict_to(self._quest_in, self.survivors.where(F.col("n_answers") > 0),
                                                      self.rater))


def screen(raw: DataFrame, quest_df: DataFrame, order: Sequence[str], **kw) -> Screening:
    """Build the screening flow (lazily; see ``Screening``)."""
    return Screening(raw, quest_df, order, **kw)


def flow_counts(s: Screening, task: str = "exp", rater: str = "session_id") -> DataFrame:
    """Q12: the flow as a long report (step, n); distinct counts are exact
    and count a missing rater as one.  Everything is read from the profile
    and the ledger (one row per completion), the trials are not."""

    def one(df: DataFrame, name: str, n: F.Column) -> DataFrame:
        return df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("step"), "n")

    raters = F.count_distinct(F.struct(rater))
    start = s.profile.agg(raters.alias("initial_raters"), F.count(F.lit(1)).alias("initial_completions"))
    parts = [
        start.unpivot([], ["initial_raters", "initial_completions"], "step", "n"),
        one(s.completions, "complete_raters", raters),
        one(s.ledger, "excluded_raters", F.count(F.lit(1))),
        one(s.consistent, "additionally_excluded", F.count(F.when(F.col("same_pcnt").isNull(), 1))),
        one(s.survivors.where(F.col("n_answers") > 0), "final_raters", raters),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
