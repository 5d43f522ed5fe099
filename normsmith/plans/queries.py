"""Named queries: one per operator group of SURVEY §2 / §7.3.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  Computed columns carry the same names as the SQL in
``plans.oracle``; floating results are rounded to 6 decimals (summation
order differs between engines), counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TITLE_EXAMPLE, TRIAL_FOLDERS
from ..operators import agreement as AG
from ..operators import quality as Q
from . import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def r6(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


# ---------------------------------------------------------------- screening
@register("first_rating")
def q_first_rating(spark, sf):
    return flows.firsts(spark, sf).select(
        "session_id", "exp", "trial_name", "dv", "rt", "l_orderkey", "l_linenumber"
    )


@register("incomplete_tasks")
def q_incomplete(spark, sf):
    s = flows.rating_flow(spark, sf)
    return s.incomplete.select("session_id", "exp", F.col("n").cast("long").alias("n"), "trials_total")


@register("complete_sessions")
def q_complete(spark, sf):
    s = flows.rating_flow(spark, sf)
    return s.complete.select("session_id", "exp", "trial_name", "dv")


@register("first_task")
def q_first_task(spark, sf):
    s = flows.rating_flow(spark, sf)
    return Q.first_task(s.complete).select("session_id", "exp", "trial_name", "dv")


@register("first_task_as_written")
def q_first_task_as_written(spark, sf):
    s = flows.rating_flow(spark, sf)
    return Q.first_task(s.complete, keep="as_written").select("session_id", "exp", "trial_name", "dv")


@register("overly_consistent")
def q_consistent(spark, sf):
    s = flows.rating_flow(spark, sf)
    return s.consistent.select("session_id", "exp", r6("same_pcnt").alias("same_pcnt"), "n_unique")


@register("overly_fast")
def q_fast(spark, sf):
    s = flows.rating_flow(spark, sf)
    return s.fast.select("session_id", "exp", r6("med_rt").alias("med_rt"))


@register("honesty_failed")
def q_honesty(spark, sf):
    s = flows.rating_flow(spark, sf)
    return s.honesty.select("session_id", F.col("honesty_check").cast("int").alias("honesty_check"))


@register("attention_failed")
def q_attention(spark, sf):
    s = flows.rating_flow(spark, sf)
    return s.attention.select("session_id", "exp", r6("attn_checks_passed").alias("attn_checks_passed"))


@register("exclusion_ledger")
def q_ledger(spark, sf):
    s = flows.rating_flow(spark, sf)
    return s.ledger.select(
        "session_id",
        "exp",
        r6("same_pcnt").alias("same_pcnt"),
        "n_unique",
        r6("med_rt").alias("med_rt"),
        F.col("honesty_check").cast("int").alias("honesty_check"),
        r6("attn_checks_passed").alias("attn_checks_passed"),
    )


@register("exclusion_counts")
def q_excl_counts(spark, sf):
    s = flows.rating_flow(spark, sf)
    return Q.exclusion_counts(s.ledger)


@register("apply_exclusions")
def q_apply(spark, sf):
    s = flows.rating_flow(spark, sf)
    return s.final.select("session_id", "exp", "ord", "trial_name", "dv")


@register("quest_restricted")
def q_quest(spark, sf):
    s = flows.rating_flow(spark, sf)
    return s.quest.select("session_id", "try_answer")


@register("flow_counts")
def q_flow(spark, sf):
    return Q.flow_counts(flows.rating_flow(spark, sf))


# ---------------------------------------------------------------- agreement
@register("rater_variety")
def q_variety(spark, sf):
    return AG.rater_variety(flows.rating_cells(spark, sf))


@register("dropped_raters")
def q_dropped(spark, sf):
    return AG.dropped_raters(flows.rating_cells(spark, sf))


@register("icc2k")
def q_icc2k(spark, sf):
    icc = AG.icc2k(flows.rating_cells(spark, sf))
    return icc.select("exp", "n_raters", "n_stimuli", r6("icc2k").alias("icc2k"))


@register("icc2k_bounds")
def q_icc2k_bounds(spark, sf):
    icc = AG.with_icc_bounds(AG.icc2k(flows.rating_cells(spark, sf)))
    return icc.select(
        "exp", "n_raters", "n_stimuli", r6("icc2k").alias("icc2k"),
        r6("icc2k_lower").alias("icc2k_lower"), r6("icc2k_upper").alias("icc2k_upper"),
    )


@register("cronbach_alpha")
def q_alpha(spark, sf):
    a = AG.cronbach_alpha(flows.rating_cells(spark, sf))
    return a.select("exp", "n_raters", "n_stimuli", r6("alpha").alias("alpha"))


# ---------------------------------------------------------------- resampling
# The study's own workload: corridor sizes 10..100 with 50 iterations,
# bootstrap sizes 1..100 with 300 iterations; seed 123.
CORRIDOR_SIZES = tuple(range(10, 101, 10))
CORRIDOR_ITERS = 50
BOOT_N = 100
BOOT_ITERS = 300
# A small one of row-per-draw means, compared row by row.
SMALL_N = 20
SMALL_ITERS = 20
SEED = 123
POS_THRESHOLD = 0.75


def _corridor(spark, sf):
    from ..operators import resample as RS

    return RS.full_corridor(flows.grown_cells(spark, sf), CORRIDOR_SIZES, CORRIDOR_ITERS, SEED)


@register("icc_corridor")
def q_corridor(spark, sf):
    c = _corridor(spark, sf)
    return c.select("exp", "n", "iter", "n_raters", "n_stimuli", "n_cells_missing", r6("icc2k").alias("icc2k"))


@register("icc_corridor_bounds")
def q_corridor_bounds(spark, sf):
    from ..operators.ranks import partitions_of
    from ..session import staged

    # few rows, each with two quantiles: spread over the cluster's shuffle partitions
    c = AG.with_icc_bounds(staged(_corridor(spark, sf).repartition(partitions_of(spark.range(1)))))
    return c.select("exp", "n", "iter", "n_stimuli", r6("icc2k").alias("icc2k"),
                    r6("icc2k_lower").alias("icc2k_lower"), r6("icc2k_upper").alias("icc2k_upper"))


@register("icc_corridor_summary")
def q_corridor_summary(spark, sf):
    from ..operators import resample as RS

    s = RS.corridor_summary(_corridor(spark, sf))
    return s.select("exp", "n", r6("icc_median").alias("icc_median"), r6("icc_low").alias("icc_low"),
                    r6("icc_high").alias("icc_high"))


@register("icc_thresholds")
def q_thresholds(spark, sf):
    from ..operators import resample as RS

    return RS.corridor_thresholds(RS.corridor_summary(_corridor(spark, sf)))


@register("rater_sample_counts")
def q_sample_counts(spark, sf):
    """How often each rater is drawn, over all sizes and iterations."""
    from ..operators import resample as RS

    samples = RS.permuted_samples(flows.grown_cells(spark, sf), CORRIDOR_SIZES, CORRIDOR_ITERS, SEED)
    return samples.groupBy("exp", "session_id").agg(F.count(F.lit(1)).alias("n_drawn"),
                                                    F.sum(F.col("n") * (F.col("iter") + 1)).alias("check_sum"))


def _means(spark, sf):
    from ..operators import resample as RS
    from ..session import staged

    return staged(RS.bootstrap_by_value(flows.grown_cells(spark, sf), BOOT_N, BOOT_ITERS, SEED))


def _small_means(spark, sf):
    from ..operators import resample as RS

    return RS.bootstrap_means(flows.rating_cells(spark, sf), SMALL_N, SMALL_ITERS, SEED)


@register("bootstrap_full")
def q_boot_full(spark, sf):
    """R8 at N=100 x 300: per task and sample size the means over all stimuli
    and iterations, summed up."""
    return _means(spark, sf).groupBy("exp", "sample_size").agg(
        F.count("mean_rating").alias("n_means"), r6(F.avg("mean_rating")).alias("mean"),
        r6(F.stddev_samp("mean_rating")).alias("sd"), r6(F.min("mean_rating")).alias("low"),
        r6(F.max("mean_rating")).alias("high"))


@register("bootstrap_means")
def q_boot(spark, sf):
    m = _small_means(spark, sf)
    return m.select("exp", "trial_name", "sample_size", "iteration", r6("mean_rating").alias("mean_rating"))


@register("bootstrap_means_join")
def q_boot_join(spark, sf):
    from ..operators import resample as RS

    m = RS.bootstrap_means(flows.rating_cells(spark, sf), SMALL_N, SMALL_ITERS, SEED, method="join")
    return m.select("exp", "trial_name", "sample_size", "iteration", r6("mean_rating").alias("mean_rating"))


@register("stability_ci")
def q_stab_ci(spark, sf):
    from ..operators import stability as ST

    cis = ST.percentile_interval(_means(spark, sf))
    return cis.select("exp", "sample_size", r6("ll").alias("ll"), r6("ul").alias("ul"))


@register("stability_normal_ci")
def q_stab_normal(spark, sf):
    from ..operators import stability as ST

    cis = ST.normal_interval(_means(spark, sf))
    return cis.select("exp", "sample_size", r6("ll").alias("ll"), r6("ul").alias("ul"))


@register("point_of_stability")
def q_pos(spark, sf):
    from ..operators import stability as ST

    return ST.point_of_stability(ST.percentile_interval(_means(spark, sf)), POS_THRESHOLD)


@register("point_of_stability_sustained")
def q_pos_sustained(spark, sf):
    from ..operators import stability as ST

    cis = ST.percentile_interval(_means(spark, sf))
    return ST.point_of_stability(cis, POS_THRESHOLD, mode="sustained")


@register("stability_ribbon")
def q_ribbon(spark, sf):
    from ..operators import stability as ST

    cis = ST.percentile_interval(_means(spark, sf))
    rib = ST.ribbon(cis, ST.point_of_stability(cis, POS_THRESHOLD))
    return rib.select("exp", "sample_size", r6("ll").alias("ll"), r6("ul").alias("ul"), "pos")


# ---------------------------------------------------------------- omega, t
@register("omega_total")
def q_omega(spark, sf):
    om = AG.omega_total(flows.rating_cells(spark, sf))
    return om.select("exp", "n_raters", "n_cells_missing", r6("omega_t").alias("omega_t"))


def _customer_means(spark, sf):
    from ..sources import tables as S

    o = S.table(spark, sf, "orders")
    x = o.where(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("x"))
    y = o.where(F.col("o_orderstatus") == "O").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("y"))
    return x, y


@register("paired_t")
def q_paired_t(spark, sf):
    from ..operators import compare as CP

    x, y = _customer_means(spark, sf)
    t = CP.paired_t(x, y, "o_custkey")
    return t.select(*[r6(c).alias(c) if c != "n_pairs" else F.col(c) for c in t.columns])


@register("paired_t_p")
def q_paired_t_p(spark, sf):
    from ..operators import compare as CP

    x, y = _customer_means(spark, sf)
    t = CP.paired_t_summary(x, y, "o_custkey")
    return t.select(*[r6(c).alias(c) if c not in ("n_pairs", "p") else F.col(c) for c in t.columns])


# ---------------------------------------------------------------- sources
@register("trial_star_join")
def q_star(spark, sf):
    from ..sources import tables as S

    li = S.table(spark, sf, "lineitem")
    o = S.table(spark, sf, "orders")
    c = S.table(spark, sf, "customer")
    n = S.table(spark, sf, "nation")
    bday = F.concat(
        (1950 + F.col("c_custkey") % 40).cast("string"), F.lit("-"),
        F.lpad((F.col("c_custkey") % 13).cast("string"), 2, "0"), F.lit("-"),
        F.lpad((F.col("c_custkey") % 29).cast("string"), 2, "0"),
    )
    j = (
        li.join(o, li.l_orderkey == o.o_orderkey, "left")
        .join(c, o.o_custkey == c.c_custkey, "left")
        .join(n, c.c_nationkey == n.n_nationkey, "left")
        .where(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING") & F.col("o_orderstatus").isin("F", "O"))
    )
    age = F.round(
        F.datediff(F.col("l_shipdate").cast("date"), F.to_date(F.replace(bday, F.lit("-00"), F.lit("-01")))) / 365.25, 1
    )
    return j.select("l_orderkey", "l_linenumber", "o_orderpriority", "c_custkey", "n_name", age.alias("user_age"))


@register("distinct_trials")
def q_distinct(spark, sf):
    from ..sources import tables as S

    tl = S.trial_log(spark, sf)
    return tl.select("session_id", "exp", "rt", "props").distinct().where(F.col("exp").isin("click", "view", "purchase"))


def packed_projects(spark, sf):
    """Orders with their lines packed into the nested project JSON text
    (one JSON array with one component per order)."""
    from ..sources import tables as S

    li = S.table(spark, sf, "lineitem")
    o = S.table(spark, sf, "orders")
    trials = li.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(
            F.col("l_linenumber").cast("long").alias("trial_n"),
            F.concat(F.lit(TRIAL_FOLDERS[0] + "/s"), (F.col("l_partkey") % 50).cast("string")).alias("name"),
            F.col("l_partkey").alias("center_img"),
        )).alias("trial"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct(
            F.col("l_partkey").cast("string"), F.concat(F.lit("img/"), F.col("l_partkey").cast("string"), F.lit(".jpg"))
        )))).alias("stimuli"),
    )
    comp = o.join(trials, o.o_orderkey == trials.l_orderkey, "inner").select(
        F.to_json(F.array(F.struct(
            F.when(F.col("o_orderstatus") == "F", "exp").otherwise("other").alias("component_type"),
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("task_"), F.col("o_orderkey").cast("string")).alias("name"),
            F.concat(F.lit(TITLE_EXAMPLE), F.lower("o_orderpriority")).alias("res_name"),
            F.concat(F.lit("Rate "), F.lower("o_orderpriority")).alias("instructions"),
            F.concat(F.lit("How "), F.lower("o_orderpriority"), F.lit("?")).alias("question"),
            F.lit("rating").alias("exptype"),
            F.lit("random").alias("trial_order"),
            F.size("trial").cast("long").alias("total_stim"),
            (F.col("o_orderkey") % 10).alias("random_stim"),
            "trial",
            "stimuli",
        ))).alias("project")
    )
    return comp


@register("json_flatten")
def q_json(spark, sf):
    from ..operators import reshape as RE

    comps = RE.components_from_json(packed_projects(spark, sf), "project")
    return RE.task_trials(comps)


@register("content_fingerprint")
def q_fingerprint(spark, sf):
    from ..sources import files as FS

    return FS.fingerprint_by(flows.rating_cells(spark, sf), ["exp"]).select(
        "exp", "n_rows", "fingerprint", F.concat(F.lit("icc_"), F.col("exp")).alias("cache_prefix")
    )


# ---------------------------------------------------------------- recode, units, reshape
def _models(spark, sf):
    from ..operators import clean as CL
    from ..sources import tables as S
    from ..functions.text import split_parts
    from . import adapters as AD

    m = S.models(spark, sf)
    m = m.select(*split_parts(F.col("ID"), "_", ("lab_id", "model_id")), *[c for c in m.columns if c != "ID"])
    m = CL.recode(m, "gender", CL.lookup_table(spark, AD.GENDER_RECODE, "gender", "gender_rec"), "gender_rec")
    m = CL.recode(m, "ethnicity", CL.lookup_table(spark, AD.ethnicity_recode(), "ethnicity", "ethnicity_rec"),
                  "ethnicity_rec")
    return m


@register("recode_lookup")
def q_recode(spark, sf):
    return _models(spark, sf).select("lab_id", "model_id", "gender", "gender_rec", "ethnicity", "ethnicity_rec")


@register("ethnicity_counts")
def q_eth_counts(spark, sf):
    from ..operators import clean as CL
    from . import adapters as AD

    lv = CL.level_table(spark, AD.ETHNICITY_LEVELS)
    return CL.level_counts(_models(spark, sf), "ethnicity_rec", lv)


@register("level_counts")
def q_level_counts(spark, sf):
    from ..operators import clean as CL
    from ..sources import tables as S
    from . import adapters as AD

    lv = CL.level_table(spark, AD.PRIORITY_LEVELS)
    return CL.level_counts(S.table(spark, sf, "orders"), "o_orderpriority", lv)


@register("unit_normalise")
def q_units(spark, sf):
    from ..functions.nulls import normalise_nulls
    from ..operators import clean as CL
    from ..sources import tables as S

    p = S.table(spark, sf, "part")
    raw = p.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 13 == 0, F.lit("n/a")).otherwise((F.col("p_size") * 4).cast("string")).alias("height"),
        F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "cm").when(F.col("p_type").isin("SMALL", "MEDIUM"), "in")
        .when(F.col("p_type") == "PROMO", "NULL").alias("height_units"),
        (F.col("p_partkey") % 120).cast("string").alias("weight"),
        F.when(F.col("p_partkey") % 3 == 0, "lb").when(F.col("p_partkey") % 3 == 1, "kg").otherwise("NULL")
        .alias("weight_units"),
    )
    clean = normalise_nulls(raw, ("NULL",))
    h = F.col("height").try_cast("double")
    w = F.col("weight").try_cast("double")
    return clean.select(
        "p_partkey", h.alias("height"), "height_units", r6(CL.height_cm(h, F.col("height_units"))).alias("height_cm"),
        w.alias("weight"), "weight_units", r6(CL.weight_kg(w, F.col("weight_units"))).alias("weight_kg"),
    )


@register("eav_to_wide")
def q_eav(spark, sf):
    from ..operators import reshape as RE
    from ..sources import tables as S

    tl = S.trial_log(spark, sf).withColumn("endtime", F.to_date("dt"))
    wide = RE.eav_to_wide(tl, ["session_id", "endtime"], "exp", "rt",
                          ["click", "error", "purchase", "signup", "view"], order="dt")
    return wide.withColumn("endtime", F.col("endtime").cast("string"))


@register("flags_long_count_wide")
def q_flags(spark, sf):
    from ..operators import summaries as SM
    from ..sources import tables as S

    lv = spark.createDataFrame([(c, lab, i + 1) for i, (c, lab) in enumerate(SM.EMOTION_LEVELS)],
                               "code string, label string, ord int")
    return SM.images_per_type(S.models(spark, sf), S.IMAGE_FLAGS, lv)


# ---------------------------------------------------------------- descriptives
@register("labs_models")
def q_labs(spark, sf):
    from ..operators import summaries as SM

    d = SM.labs_and_models(_models(spark, sf))
    return d.select("n_labs", "n_models", r6("mean_per_lab").alias("mean_per_lab"), "min_per_lab", "max_per_lab")


@register("group_demographics")
def q_demog(spark, sf):
    from ..operators import summaries as SM

    d = SM.group_summary(_models(spark, sf), "gender_rec", ["age", "acctbal"])
    return d.select(*[r6(c).alias(c) if c.endswith("_mean") or c.startswith("acctbal") else F.col(c)
                      for c in d.columns])


@register("age_histogram")
def q_age_hist(spark, sf):
    return _models(spark, sf).groupBy("age", "gender_rec").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("counts_by_group")
def q_counts_by(spark, sf):
    m = _models(spark, sf)
    a = m.groupBy(F.col("ethnicity_rec").alias("level")).agg(F.count(F.lit(1)).cast("long").alias("n")) \
        .select(F.lit("ethnicity").alias("dimension"), "level", "n")
    b = m.groupBy(F.col("gender").alias("level")).agg(F.count(F.lit(1)).cast("long").alias("n")) \
        .select(F.lit("segment").alias("dimension"), "level", "n")
    return a.unionByName(b)


@register("count_listagg")
def q_listagg(spark, sf):
    from ..operators import summaries as SM

    return SM.equal_count_groups(_models(spark, sf), "ethnicity")


@register("raters_per_task")
def q_raters_per_task(spark, sf):
    from ..operators import summaries as SM

    return SM.distinct_per_group(flows.rating_flow(spark, sf).final, "exp", "session_id", "n_raters")


@register("rt_histogram")
def q_rt_hist(spark, sf):
    from ..operators import summaries as SM
    from ..sources import tables as S

    h = SM.median_histogram(S.trial_log(spark, sf), "session_id", "exp", "rt", width=10.0)
    return h.select(r6("bin_start").alias("bin_start"), "n", r6("marker").alias("marker"))


@register("corridor_ribbon")
def q_corr_ribbon(spark, sf):
    from ..operators import resample as RS

    return RS.with_thresholds(RS.corridor_summary(_corridor(spark, sf))).select(
        "exp", "n", r6("icc_median").alias("icc_median"), r6("icc_low").alias("icc_low"),
        r6("icc_high").alias("icc_high"), "n_for_075", "n_for_090",
    )


def _stim_no() -> F.Column:
    return F.substring(F.col("trial_name"), 2, 10).cast("int")


@register("tile_counts")
def q_tiles(spark, sf):
    from ..functions.text import name_parts

    cells = flows.rating_cells(spark, sf).where(F.col("exp").isin("A", "N"))
    st = _stim_no()
    parts = name_parts(F.format_string("lab%d_m%02d_std_neu_front", st % 5, st))
    return cells.groupBy(F.element_at(parts, 1).alias("lab_id"), F.element_at(parts, 2).alias("model_id"), "dv") \
        .agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("rating_descriptives")
def q_desc(spark, sf):
    from ..operators import summaries as SM

    d = SM.rating_descriptives(flows.rating_cells(spark, sf))
    return d.select("exp", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("median").alias("median"),
                    F.col("min").cast("int").alias("min"), F.col("max").cast("int").alias("max"))


@register("rating_histogram")
def q_rhist(spark, sf):
    return flows.rating_cells(spark, sf).groupBy("exp", "dv").agg(F.count(F.lit(1)).cast("long").alias("n"))


def _emo(idx: F.Column) -> F.Column:
    from . import adapters as AD

    return F.element_at(F.array(*[F.lit(e) for e in AD.EMOTION_CATEGORIES]), idx.cast("int"))


@register("confusion_share")
def q_confusion(spark, sf):
    from ..operators import summaries as SM

    cells = flows.rating_cells(spark, sf).where(F.col("exp") == "R")
    st = _stim_no()
    lab = cells.select(_emo(st % 6 + 1).alias("intended"), _emo((F.col("dv") - 1) % 6 + 1).alias("chosen"))
    s = SM.share_within(lab, ["intended"], "chosen")
    return s.select("intended", "chosen", "n", r6("share").alias("share"))


@register("perceived_age_hist")
def q_age_perceived(spark, sf):
    from . import adapters as AD

    cells = flows.rating_cells(spark, sf).where(F.col("exp") == "N")
    labels = F.array(*[F.lit(b) for b, _ in AD.BRACKETS])
    return cells.groupBy(F.element_at(labels, F.col("dv")).alias("bracket")) \
        .agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("correct_by_expression")
def q_correct(spark, sf):
    cells = flows.rating_cells(spark, sf)
    st = _stim_no()
    cat = cells.where(F.col("exp") == "R").groupBy(_emo(st % 6 + 1).alias("expression")).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.avg(((F.col("dv") - 1) % 6 == st % 6).cast("double")).alias("prop_correct"),
    )
    inten = cells.where(F.col("exp") == "A").groupBy(_emo(st % 6 + 1).alias("expression")).agg(
        F.avg("dv").alias("mean_intensity")
    )
    return cat.join(inten, "expression", "left").select(
        "expression", "n", r6("prop_correct").alias("prop_correct"), r6("mean_intensity").alias("mean_intensity")
    )


@register("mode_share")
def q_mode(spark, sf):
    from ..operators import summaries as SM
    from ..sources import tables as S

    m = SM.mode_info(S.table(spark, sf, "part"), ["p_brand"], "p_size")
    return m.select("p_brand", "mode", "freq", r6("prop").alias("prop"))


@register("mode_vs_actual_corr")
def q_mode_corr(spark, sf):
    from ..operators import summaries as SM
    from ..sources import tables as S
    from . import adapters as AD

    o = S.table(spark, sf, "orders")
    modes = SM.mode_info(o, ["o_custkey"], "o_orderpriority")
    mids = F.array(*[F.lit(mid) for _, mid in AD.BRACKETS])
    perceived = modes.select(
        "o_custkey", F.element_at(mids, F.substring("mode", 1, 1).cast("int") + 1).alias("perceived"))
    actual = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                   S.age_of(F.col("c_custkey")).alias("age"))
    j = perceived.join(actual, "o_custkey").where(F.col("age").isNotNull())
    return j.agg(F.count(F.lit(1)).cast("long").alias("n"), r6(F.corr("age", "perceived")).alias("r"))


@register("stimulus_attributes")
def q_stim_attr(spark, sf):
    from ..functions.text import name_parts
    from ..sources import tables as S
    from . import adapters as AD

    p = S.table(spark, sf, "part")
    codes = F.array(*[F.lit(c) for c in AD.EMOTION_CODES])
    views = F.array(*[F.lit(v) for v in AD.VIEWS])
    name = F.concat_ws(
        "_", F.concat(F.lit("lab"), (F.col("p_partkey") % 20).cast("string")), F.col("p_partkey").cast("string"),
        F.when(F.col("p_size") % 2 == 0, "std").otherwise("unstd"),
        F.element_at(codes, (F.col("p_partkey") % 7 + 1).cast("int")),
        F.element_at(views, (F.col("p_partkey") % 5 + 1).cast("int")),
    )
    parts = name_parts(name)
    attrs = p.select(*[F.element_at(parts, i + 1).alias(c) for i, c in enumerate(["lab", "img", "type", "emo", "view"])])
    return attrs.where(F.col("view") == "front").select("lab", F.col("img").cast("long").alias("img"), "type", "emo")


@register("point_of_stability_arrow")
def q_pos_arrow(spark, sf):
    """Same pipeline with the vectorised (Philox) draw engine for full-size
    runs; its draws differ from the md5 ones, so it has no SQL twin."""
    from ..operators import stability as ST

    res = ST.stability_stats(flows.rating_cells(spark, sf), SMALL_N, SMALL_ITERS, cos_threshold=POS_THRESHOLD,
                             seed=SEED, method="arrow")
    return res.pos
