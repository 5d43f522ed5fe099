"""Registered queries of the file, text and small statistics operators, with
their oracle SQL beside them.  File operators run on CSV written from the
driver tables to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import to_int_truncating
from ..functions.text import first_match_removed, format_p, name_values
from ..operators import agreement as AG
from ..operators import clean as CL
from ..operators import compare as CP
from ..operators import quality as Q
from ..operators import reshape as RE
from ..operators import summaries as SM
from ..operators.quantile import grouped_quantile
from ..session import ensure_checkpoint_dir, track
from ..sources import files as FS
from ..sources import tables as S
from . import adapters as AD
from . import flows
from .oracle import AGREE_BASE, CELLS, FIRSTS, ORACLE, RATINGS
from .oracle_full import GROWN, P_TEXT, t_interval
from .queries import packed_projects, r6, register


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one query's files, in the shared store."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    track(path)
    return path


def query(name: str, sql: str | None):
    if sql:
        ORACLE[name] = sql
    return register(name)


# ------------------------------------------------------------------- sources
_USER_STATUS = "case o_orderstatus when 'F' then 'guest' when 'O' then 'registered' else 'test' end"


@query(
    "export_pages_union",
    f"select o_orderkey as session_id, o_custkey as user_id, {_USER_STATUS} as user_status, o_totalprice as rt "
    "from orders where o_orderstatus in ('F', 'O')",
)
def q_export_pages(spark, sf):
    """An export written in overlapping CSV pages, read as one."""
    o = S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"),
        F.expr(_USER_STATUS).alias("user_status"), F.col("o_totalprice").alias("rt"),
    )
    pages = o.withColumn("page", F.col("session_id") % 4)
    again = pages.where(F.col("session_id") % 7 == 0).withColumn("page", (F.col("page") + 1) % 4)
    folder = new_folder(spark, "pages")
    FS.write_table(pages.unionByName(again), folder, "csv", partition_by=["page"])
    return FS.read_export_dir(spark, f"{folder}/*", "session_id long, user_id long, user_status string, rt double")


@query(
    "latest_export",
    "select p_partkey, p_size, 3 as export_day from part",
)
def q_latest_export(spark, sf):
    """Of three dated exports only the newest is read."""
    folder = new_folder(spark, "exports")
    p = S.table(spark, sf, "part")
    for day in (2, 3, 1):
        out = p.where(F.col("p_partkey") % 5 < day + 2).select("p_partkey", "p_size", F.lit(day).alias("export_day"))
        FS.write_table(out, f"{folder}/export_2024-01-0{day}", "csv")
    return FS.latest_file(spark, folder, "export_*", "p_partkey long, p_size int, export_day int")


@query(
    "export_page",
    "select c_custkey, c_acctbal from customer order by c_custkey limit 25 offset 50",
)
def q_export_page(spark, sf):
    """S3: the third page of 25 rows of the ordered export."""
    return FS.page(S.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"], 25, 2)


@query(
    "csv_typed_tokens",
    f"""select p_partkey, case when p_partkey % 11 in (1, 2, 3) then null else cast(p_size as int) end as size,
       case when p_type in {tuple(AD.PART_TYPES)} then p_type end as type,
       cast(list_position({AD.sql_list(AD.PART_TYPES)}, p_type) as int) as type_ord
from part""",
)
def q_csv_typed(spark, sf):
    """Null tokens, text with decimals as whole numbers and a
    column of declared levels, out of a CSV of text."""
    k = F.col("p_partkey") % 11
    text = F.when(k == 1, "NA").when(k == 2, "NULL").when(k == 3, "").otherwise(
        F.concat(F.col("p_size").cast("string"), F.lit(".7")))
    folder = new_folder(spark, "typed")
    FS.write_table(S.table(spark, sf, "part").select("p_partkey", text.alias("size"), F.col("p_type").alias("type")),
                   folder, "csv")
    raw = FS.read_csv(spark, folder, "p_partkey long, size string, type string", tokens=("", "NA", "NULL"),
                      levels={"type": AD.PART_TYPES})
    return raw.select("p_partkey", to_int_truncating(F.col("size")).alias("size"), "type", "type_ord")


@query(
    "recode_text_na",
    """select n_nationkey, case when n_nationkey % 5 = 0 then 'NA' when n_nationkey % 5 = 1 then null
       else 'group' || cast(n_nationkey % 5 as varchar) end as label from nation""",
)
def q_recode_text_na(spark, sf):
    """In a recode file the text NA is a label, an absent key is
    missing."""
    n = S.table(spark, sf, "nation")
    g = F.col("n_nationkey") % 5
    folder = new_folder(spark, "recode")
    FS.write_table(
        n.where(g != 1).select(F.lower("n_name").alias("k"),
                               F.when(g == 0, "NA").otherwise(F.concat(F.lit("group"), g.cast("string"))).alias("label")),
        folder, "csv")
    table = FS.read_csv(spark, folder, "k string, label string", null_value="", tokens=None)
    return CL.recode(n.select("n_nationkey", "n_name"), "n_name", table, "label", keep_na_label=True).select(
        "n_nationkey", "label")


@query(
    "sink_by_task",
    """select o_orderstatus as exp, count(*) as n, round(sum(o_totalprice), 2) as total from orders
where o_orderstatus <> 'P' group by o_orderstatus""",
)
def q_sink(spark, sf):
    """Written partitioned by task, two task folders read back."""
    folder = new_folder(spark, "sink")
    o = S.table(spark, sf, "orders")
    FS.write_table(o.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("exp")), folder,
                   partition_by=["exp"])
    back = spark.read.parquet(folder).where(F.col("exp") != "P")
    return back.groupBy("exp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "cached_result",
    "select event_type as exp, count(*) as n, count(distinct user_id) as raters from events group by event_type",
)
def q_cached(spark, sf):
    """Computed once, then loaded by the content of its input."""
    tl = S.trial_log(spark, sf)
    root = new_folder(spark, "cache")

    def compute() -> DataFrame:
        return tl.groupBy("exp").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("raters"))

    def never() -> DataFrame:
        raise RuntimeError("the stored result was not found")

    data = tl.select("session_id", "exp")
    FS.run_or_load(spark, "raters", data, {"by": "exp"}, compute, root)
    return FS.run_or_load(spark, "raters", data, {"by": "exp"}, never, root)


@query(
    "content_digest",
    """with h as (select event_type as exp, md5(concat_ws('|', cast(user_id as varchar), cast(event_id as varchar))) as d
           from events)
select exp, count(*) as n_rows,
       cast(sum(cast(('0x' || substr(d, 1, 8))::bigint as hugeint)) as varchar) as lo,
       cast(sum(cast(('0x' || substr(d, 9, 8))::bigint as hugeint)) as varchar) as hi
from h group by exp""",
)
def q_content_digest(spark, sf):
    """S12 with a digest that any engine has: sums of MD5 words by task."""
    return FS.digest_by(S.trial_log(spark, sf), ["exp"], ["session_id", "event_id"])


# ------------------------------------------------------------------ columns
@query(
    "column_range_sums",
    """select l_returnflag, round(sum(l_quantity), 2) as l_quantity, round(sum(l_extendedprice), 2) as l_extendedprice,
       round(sum(l_discount), 2) as l_discount, round(sum(l_tax), 2) as l_tax
from lineitem group by l_returnflag""",
)
def q_column_range(spark, sf):
    """The columns from l_quantity to l_tax, rounded to two places."""
    li = S.table(spark, sf, "lineitem")
    cols = RE.column_range(li, "l_quantity", "l_tax")
    sums = li.groupBy("l_returnflag").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in cols])
    return RE.round_columns(sums, 2)


@query(
    "attention_substring",
    """with c as (
  select l_suppkey % 20 as session_id, l_returnflag as exp, 'emo' || cast(100 + l_partkey % 7 as varchar) as code,
         cast(case when l_suppkey % 20 < 6 and l_partkey % 2 = 0 then 999 else 100 + l_partkey % 7 end as varchar) as said
  from lineitem where l_linenumber = 7),
h as (select session_id, exp, case when (case when exp = 'R' then substr(code, 4, 3) else code end)
             = (case when exp = 'R' then said else 'emo' || said end) then 1.0 else 0.0 end as hit from c)
select session_id, exp, round(avg(hit), 6) as attn_checks_passed from h group by session_id, exp having avg(hit) < 6.0 / 7""",
)
def q_attention_substring(spark, sf):
    """In one task only characters 4-6 of the expected answer count."""
    li = S.table(spark, sf, "lineitem").where(F.col("l_linenumber") == 7)
    rater, code = F.col("l_suppkey") % 20, (100 + F.col("l_partkey") % 7).cast("string")
    said = F.when((rater < 6) & (F.col("l_partkey") % 2 == 0), "999").otherwise(code)
    facts = li.select(
        rater.alias("session_id"), F.col("l_returnflag").alias("exp"),
        F.concat(F.lit("check_q_emo"), code).alias("trial_name"),
        F.when(F.col("l_returnflag") == "R", said).otherwise(F.concat(F.lit("emo"), said)).alias("dv"),
    )
    failed = Q.attention_failed(facts, substring_task="R")
    return failed.select("session_id", "exp", r6("attn_checks_passed").alias("attn_checks_passed"))


@query(
    "p_value_text",
    """select l_orderkey, l_linenumber, case when p < 0.001 then '<.001' else substr(printf('%.3f', p), 2) end as p
from (select l_orderkey, l_linenumber, l_discount * l_discount / (1 + l_partkey % 16) as p from lineitem) t""",
)
def q_p_text(spark, sf):
    """P20: p values as text."""
    p = F.col("l_discount").cast("double") * F.col("l_discount").cast("double") / (1 + F.col("l_partkey") % 16)
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", format_p(p).alias("p"))


@query(
    "task_dimension",
    """with t as (select l_orderkey, count(*) as trials, count(distinct l_partkey) as stim from lineitem group by l_orderkey)
select o_orderkey as exp_id, 'task_' || cast(o_orderkey as varchar) as name, lower(o_orderpriority) as exp, t.trials, t.stim,
       'rating' as exptype, 'Rate ' || lower(o_orderpriority) as instructions, 'How ' || lower(o_orderpriority) || '?' as question,
       'random' as trial_order, t.trials as total_stim, cast(o_orderkey % 10 as bigint) as random_stim
from orders join t on o_orderkey = l_orderkey where o_orderstatus = 'F'""",
)
def q_task_dimension(spark, sf):
    """The task dimension with all its fields."""
    d = RE.task_dimension(RE.components_from_json(packed_projects(spark, sf), "project"))
    return d.select("exp_id", "name", "exp", "trials", "stim", "exptype", "instructions", "question", "trial_order",
                    "total_stim", "random_stim")


@query(
    "first_match_only",
    """select o_orderkey, regexp_replace('a-' || o_orderpriority || '-a-' || o_orderstatus, 'a-', '') as label from orders""",
)
def q_first_match(spark, sf):
    """Only the leftmost match goes."""
    label = F.concat(F.lit("a-"), "o_orderpriority", F.lit("-a-"), "o_orderstatus")
    return S.table(spark, sf, "orders").select("o_orderkey", first_match_removed(label, "a-").alias("label"))


_VIEWS = AD.sql_list(AD.VIEW_CODES)


@query(
    "stimulus_views_typed",
    f"""select p_partkey, 'lab' || cast(p_partkey % 20 as varchar) as lab, cast(p_partkey as int) as img,
       {AD.sql_list(AD.EMOTION_CODES)}[p_partkey % 7 + 1] as emo, {_VIEWS}[p_partkey % {len(AD.VIEW_CODES)} + 1] as view
from part""",
)
def q_views_typed(spark, sf):
    """The parts of a stimulus name, whole numbers converted."""
    p = S.table(spark, sf, "part")
    codes, views = (F.array(*[F.lit(c) for c in v]) for v in (AD.EMOTION_CODES, AD.VIEW_CODES))
    name = F.concat_ws(
        "_", F.concat(F.lit("lab"), (F.col("p_partkey") % 20).cast("string")), F.col("p_partkey").cast("string"),
        F.element_at(codes, (F.col("p_partkey") % 7 + 1).cast("int")),
        F.element_at(views, (F.col("p_partkey") % len(AD.VIEW_CODES) + 1).cast("int")),
    )
    return p.select("p_partkey", *name_values(name, {"lab": "string", "img": "int", "emo": "string", "view": "string"}))


@query(
    "attribute_ids",
    f"""with a as (select cast(p_partkey as int) as img, 'lab' || cast(p_partkey % 20 as varchar) as lab,
       {AD.sql_list(AD.EMOTION_CODES)}[p_partkey % 7 + 1] as emo, {_VIEWS}[p_partkey % {len(AD.VIEW_CODES)} + 1] as view from part)
select 'lab' as attribute, lab as value, img from a union all select 'emo', emo, img from a
union all select 'view', view, img from a""",
)
def q_attribute_ids(spark, sf):
    """For each value of each attribute the stimuli that have it, as rows."""
    return SM.attribute_ids(q_views_typed(spark, sf), "img", ["lab", "emo", "view"])


@query(
    "ordered_levels",
    """with l as (select * from (values ('5-LOW', 1), ('4-NOT SPECIFIED', 2), ('3-MEDIUM', 3), ('2-HIGH', 4), ('1-URGENT', 5)) v(p, ord))
select o_custkey, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by l.ord, o_orderkey) as place
from orders join l on o_orderpriority = l.p""",
)
def q_ordered_levels(spark, sf):
    """Rows in level order (not text order) within each customer."""
    from pyspark.sql import Window

    lv = CL.level_table(spark, ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])
    o = CL.as_factor(S.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"),
                     "o_orderpriority", lv)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("ord", "o_orderkey"))
    return o.select("o_custkey", "o_orderkey", "o_orderpriority", place.cast("long").alias("place"))


@query(
    "task_families",
    """select 'plain' as family, event_type as exp, count(*) as n, round(avg(value), 6) as mean from events
where event_type in ('click', 'view') group by event_type
union all select 'pattern', event_type, count(*), round(avg(value), 6) from events
where regexp_matches(event_type, '^(si|er)') group by event_type""",
)
def q_families(spark, sf):
    """Task families by list and by pattern."""
    tl = S.trial_log(spark, sf)
    parts = [
        AG.task_subset(tl, tasks=["click", "view"], value="rt").withColumn("family", F.lit("plain")),
        AG.task_subset(tl, pattern="^(si|er)", value="rt").withColumn("family", F.lit("pattern")),
    ]
    return parts[0].unionByName(parts[1]).groupBy("family", "exp").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("rt")).alias("mean"))


# --------------------------------------------------------------- paired tests
_PAIRS = """with x as (select o_custkey, substr(o_orderpriority, 1, 1) as trait, avg(o_totalprice) as x from orders
  where o_orderstatus = 'F' group by 1, 2),
y as (select o_custkey, substr(o_orderpriority, 1, 1) as trait, avg(o_totalprice) as y from orders
  where o_orderstatus = 'O' group by 1, 2),
d as (select x.trait, x - y as d from x join y on x.o_custkey = y.o_custkey and x.trait = y.trait)
"""


def _trait_means(spark, sf):
    o = S.table(spark, sf, "orders").withColumn("trait", F.substring("o_orderpriority", 1, 1))
    x = o.where(F.col("o_orderstatus") == "F").groupBy("o_custkey", "trait").agg(F.avg("o_totalprice").alias("x"))
    y = o.where(F.col("o_orderstatus") == "O").groupBy("o_custkey", "trait").agg(F.avg("o_totalprice").alias("y"))
    return x, y


@query(
    "paired_t_by_trait",
    _PAIRS
    + """select d.trait, max(mx) as m_std, max(my) as m_unstd, count(d) as n_pairs, round(avg(d), 2) as m_diff,
       round(stddev_samp(d), 2) as sd_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 2) as t,
       cast(count(d) - 1 as double) as df
from d join (select trait, round(avg(x), 2) as mx from x group by trait) a on d.trait = a.trait
join (select trait, round(avg(y), 2) as my from y group by trait) b on d.trait = b.trait
group by d.trait""",
)
def q_paired_by_trait(spark, sf):
    """One test per trait out of one pass, rounded to two
    places."""
    x, y = _trait_means(spark, sf)
    return RE.round_columns(CP.paired_t_by(x, y, "o_custkey", ["trait"]), 2)


_PAIRS_ST = "with recursive " + _PAIRS.removeprefix("with ").rstrip() + """,
st as (select trait, count(d) as n_pairs, avg(d) as m_diff, stddev_samp(d) as sd_diff,
         avg(d) / (stddev_samp(d) / sqrt(count(d))) as t, cast(count(d) - 1 as double) as df
       from d where d is not null group by trait),
"""


@query(
    "paired_t_p_by_trait",
    _PAIRS_ST + t_interval("st", "trait")
    + f"""select st.trait, n_pairs, round(m_diff, 6) as m_diff, round(t, 6) as t, df, round(lo, 6) as ci_95_lower,
       round(hi, 6) as ci_95_upper, round(p, 6) as p_value, {P_TEXT} as p
from st join tint on st.trait = tint.trait""",
)
def q_paired_p_by_trait(spark, sf):
    """Interval and p value of every trait's test, in one pass."""
    x, y = _trait_means(spark, sf)
    t = CP.with_t_interval(CP.paired_t_by(x, y, "o_custkey", ["trait"]))
    return t.select("trait", "n_pairs", *[r6(c).alias(c) for c in ("m_diff", "t")], "df",
                    *[r6(c).alias(c) for c in ("ci_95_lower", "ci_95_upper", "p_value")], "p")


@query(
    "quantile_nan",
    """select event_type, round(quantile_cont(v, 0.25), 6) as q25, round(quantile_cont(v, 0.5), 6) as q50
from (select event_type, case when event_id % 17 = 0 then 'nan'::double else value end as v from events) t
where v is not null group by event_type""",
)
def q_quantile_nan(spark, sf):
    """Values that are no numbers count as the largest."""
    v = F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("rt"))
    rows = S.trial_log(spark, sf).select(F.col("exp").alias("event_type"), v.cast("double").alias("v"))
    out = None
    for p, name in ((0.25, "q25"), (0.5, "q50")):
        q = grouped_quantile(rows, ["event_type"], "v", p, out=name)
        out = q if out is None else out.join(q, "event_type")
    return out.select("event_type", r6("q25").alias("q25"), r6("q50").alias("q50"))


# ------------------------------------------------------------------ agreement
_NULL_TASK = AGREE_BASE.replace(
    "select exp, session_id, trial_name, dv from firsts where",
    "select case when exp = 'A' then '~' else exp end as exp, session_id, trial_name, dv from firsts where")


@query(
    "icc2k_null_task",
    _NULL_TASK
    + """select nullif(exp, '~') as exp, k as n_raters, n as n_stimuli,
        round(case when k >= 2 and n >= 2 then (msb - mse) / (msb + (msj - mse) / n) end, 6) as icc2k from ms""",
)
def q_icc_null_task(spark, sf):
    """A task without a name is screened and estimated like others."""
    c = flows.rating_cells(spark, sf).withColumn("exp", F.when(F.col("exp") != "A", F.col("exp")))
    return AG.icc2k(c).select("exp", "n_raters", "n_stimuli", r6("icc2k").alias("icc2k"))


_VAR_COMPONENTS = """n_i as (select exp, trial_name, count(dv) as n, sum(dv) as s from obs group by exp, trial_name),
n_j as (select exp, session_id, count(dv) as n, sum(dv) as s from obs group by exp, session_id),
tot as (select exp, count(dv) as nn, sum(dv) as g, sum(dv * dv) as t0 from obs group by exp),
si as (select exp, count(*) as a, sum(s * s / n) as ta, sum(cast(n as double) * n) as q1 from n_i group by exp),
sj as (select exp, count(*) as b, sum(s * s / n) as tb, sum(cast(n as double) * n) as q2 from n_j group by exp),
m as (select tot.exp, a, b, nn, t0, ta, tb, g * g / nn as tm, q1 / nn as k1, q2 / nn as k2,
             (t0 - ta) / nullif(nn - a, 0) as p, (t0 - tb) / nullif(nn - b, 0) as q
      from tot join si on tot.exp = si.exp join sj on tot.exp = sj.exp),
vc as (select *, ((nn - k1) * q + (a - k2) * p - (ta - tm)) / nullif(nn - k1 - k2 + 1, 0) as ve from m)"""


def _obs(dv: str, keep: str) -> str:
    return (
        AGREE_BASE.rstrip()
        + f""",
tasks as (select distinct exp from cells),
src as (select c.exp, c.session_id, c.trial_name, {dv} as dv from cells c join firsts f
        on c.exp = f.exp and c.session_id = f.session_id and c.trial_name = f.trial_name where {keep}),
obs as (select * from src where dv is not null),
{_VAR_COMPONENTS}
"""
    )


_ICC_SELECT = """select t.exp, cast(coalesce(b, 0) as bigint) as n_raters, cast(coalesce(a, 0) as bigint) as n_stimuli,
  cast(coalesce(a * b - nn, 0) as bigint) as n_cells_missing,
  round(case when a >= 2 and b >= 2 then (q - ve) / ((q - ve) + (p - ve + ve) / b) end, 6) as {out}
from tasks t left join vc on t.exp = vc.exp"""
_FRACTION = "c.dv + (f.rt % 97) / 97.0"
_KEEP = "(c.exp <> 'R' or c.session_id = 7) and (c.session_id + coalesce(try_cast(substr(c.trial_name, 2) as int), 0)) % 9 <> 0"


def _fractional(spark, sf) -> DataFrame:
    f = flows.firsts(spark, sf).where(~F.col("trial_name").contains("check_"))
    dv = F.col("dv") + (F.col("rt").cast("double") % 97) / 97.0
    return f.select("exp", "session_id", "trial_name", dv.alias("dv"))


def _missing(spark, sf) -> DataFrame:
    """Cells absent from every stimulus; one task left with a single rater."""
    stim = F.substring("trial_name", 2, 10).cast("int")
    absent = (F.col("session_id") + stim) % 9 == 0
    alone = (F.col("exp") == "R") & (F.col("session_id") != 7)
    return _fractional(spark, sf).withColumn("dv", F.when(~(absent | alone), F.col("dv")))


@query("icc2k_fractional", _obs(_FRACTION, "true") + _ICC_SELECT.format(out="icc2k"))
def q_icc_fractional(spark, sf):
    """R2 on answers that are no whole numbers, all cells used."""
    icc = AG.icc2k(_fractional(spark, sf), min_values=None, missing="all")
    return icc.select("exp", "n_raters", "n_stimuli", "n_cells_missing", r6("icc2k").alias("icc2k"))


@query("icc2k_missing", _obs(_FRACTION, _KEEP) + _ICC_SELECT.format(out="icc2k"))
def q_icc_missing(spark, sf):
    """R2 with absent cells in every stimulus; every task keeps its row."""
    icc = AG.icc2k(_missing(spark, sf), min_values=None, missing="all")
    return icc.select("exp", "n_raters", "n_stimuli", "n_cells_missing", r6("icc2k").alias("icc2k"))


@query(
    "alpha_missing",
    _obs(_FRACTION, _KEEP)
    + """select t.exp, cast(coalesce(b, 0) as bigint) as n_raters, cast(coalesce(a, 0) as bigint) as n_stimuli,
  cast(coalesce(a * b - nn, 0) as bigint) as n_cells_missing,
  case when coalesce(a * b - nn, 0) = 0 then 'complete' else 'components' end as estimator,
  round(case when a >= 2 and b >= 2 then b * (q - ve) / (b * (q - ve) + ve) end, 6) as alpha
from tasks t left join vc on t.exp = vc.exp""",
)
def q_alpha_missing(spark, sf):
    """R6 with absent cells in every stimulus."""
    a = AG.cronbach_alpha(_missing(spark, sf), min_values=None, missing="all")
    return a.select("exp", "n_raters", "n_stimuli", "n_cells_missing", "estimator", r6("alpha").alias("alpha"))


_GROWN_OBS = (
    "with " + GROWN.replace("l_partkey % 50 as st", "l_partkey as st") + ",\n" + FIRSTS + ",\n" + CELLS
    + ",\nobs as (select * from cells where dv is not null),\n" + _VAR_COMPONENTS
)


@query(
    "icc2k_grown",
    _GROWN_OBS
    + """select exp, cast(b as bigint) as n_raters, cast(a as bigint) as n_stimuli, cast(a * b - nn as bigint) as n_cells_missing,
  ve < 0 or q - ve < 0 or p - ve < 0 as improper,
  round(case when ve >= 0 and p >= 0 and (q - ve) + p / b > 0 then (q - ve) / ((q - ve) + p / b) end, 6) as icc2k,
  round(case when ve >= 0 and b * (q - ve) + ve > 0 then b * (q - ve) / (b * (q - ve) + ve) end, 6) as alpha
from vc""",
)
def q_icc_grown(spark, sf):
    """R2, R6 with every supplier a rater and every part a stimulus: raters,
    stimuli and absent cells grow with the table."""
    c = flows.grown_cells(spark, sf, n_stimuli=None)
    icc = AG.icc2k(c, min_values=None, missing="all")
    alpha = AG.cronbach_alpha(c, min_values=None, missing="all").select("exp", "alpha")
    return icc.join(alpha, "exp").select("exp", "n_raters", "n_stimuli", "n_cells_missing", "improper",
                                         r6("icc2k").alias("icc2k"), r6("alpha").alias("alpha"))


@query("dropped_rater_rows", AGREE_BASE + "select exp, session_id, n_values from variety where n_values < 3")
def q_dropped_rows(spark, sf):
    """R3 in rows."""
    return AG.dropped_rater_rows(flows.rating_cells(spark, sf))


@query("count_rows", "select n, nation as item from (select n_name as nation, count(*) as n from customer join nation "
       "on c_nationkey = n_nationkey group by n_name) t")
def q_count_rows(spark, sf):
    """D8 in rows: nations under the number of customers that they share."""
    c, n = S.table(spark, sf, "customer"), S.table(spark, sf, "nation")
    items = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("item"))
    return SM.equal_count_rows(items, "item")


@query(
    "rating_skewness",
    "with " + RATINGS + ",\n" + FIRSTS + ",\n" + CELLS
    + """,
m as (select exp, dv, avg(dv) over (partition by exp) as mean from cells where dv is not null)
select exp, round(avg((dv - mean) ** 3) / avg((dv - mean) ** 2) ** 1.5, 6) as skewness from m group by exp""",
)
def q_skewness(spark, sf):
    """Skewness of the answers of each task."""
    return SM.rating_skewness(flows.rating_cells(spark, sf)).select("exp", r6("skewness").alias("skewness"))
