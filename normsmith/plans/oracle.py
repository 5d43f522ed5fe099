"""Equivalent SQL for the named queries, written for DuckDB over the driver
tables (pre-registered views).  Used only as the correctness oracle; the
Spark side never runs these strings.

The SQL is assembled from shared CTE blocks so that every query states the
whole path from the base tables.
"""

from __future__ import annotations

# The adapter view, as given in FIXTURES.md §5 (portable SQL).
RATINGS = """ratings as (
  with b as (select l_suppkey % 20 as session_id, l_returnflag as exp, l_partkey % 50 as st,
                    l_linenumber = 7 as chk, cast(l_quantity as int) as qn, lineitem.* from lineitem)
  select session_id, exp,
   case when chk then concat('check_', lower(l_linestatus), '_', cast(l_partkey % 7 + 1 as varchar(9)))
        else concat('s', cast(st as varchar(9))) end as trial_name,
   cast(case when chk then case when session_id = 3 and l_partkey % 2 = 0 then 8 else l_partkey % 7 + 1 end
        when session_id = 1 and exp = 'A' then 4
        when session_id = 2 and exp = 'N' then 3 + st % 2
        when exp = 'A' then 1 + floor((st * 7 % 50) * 4 / 50.0) + qn % 4
        when exp = 'N' then 1 + floor((st * 7 % 50) * 3 / 50.0) + qn % 5
        else 1 + floor((st * 7 % 50) * 2 / 50.0) + qn % 6 end as int) as dv,
   case when session_id = 4 and exp = 'R' then l_extendedprice / 20 else l_extendedprice end as rt,
   l_shipdate as dt, l_orderkey, l_linenumber, l_partkey, l_suppkey
  from b where not (session_id = 5 and exp = 'R' and st = 49 and not chk)
)"""

FIRSTS = """firsts as (
  select session_id, exp, trial_name, dv, rt, dt, l_orderkey, l_linenumber, l_partkey, l_suppkey from (
    select *, row_number() over (partition by session_id, exp, trial_name
                                 order by dt, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn
    from ratings) t where rn = 1
)"""

SCREEN = """tasks as (
  select exp, max(n) as trials_total from (select exp, session_id, count(*) as n from firsts group by exp, session_id) t
  group by exp
),
incomplete as (
  select p.session_id, p.exp, p.n, t.trials_total
  from (select session_id, exp, count(*) as n from firsts group by session_id, exp) p
  left join tasks t on p.exp = t.exp
  where p.n < t.trials_total
),
complete as (
  select * from firsts f where not exists (select 1 from incomplete i where i.session_id = f.session_id)
),
exp_long as (select * from complete),
prof as (
  select session_id, exp, max(n) / sum(n) as same_pcnt, count(dv) as n_unique
  from (select session_id, exp, dv, count(*) as n from exp_long where not starts_with(trial_name, 'check_')
        group by session_id, exp, dv) t
  group by session_id, exp
),
consistent as (
  select session_id, exp,
         case when same_pcnt >= 0.9 then same_pcnt end as same_pcnt,
         case when n_unique <= 2 then n_unique end as n_unique
  from prof where same_pcnt >= 0.9 or n_unique <= 2
),
med as (
  select session_id, exp, case when count(*) > count(rt) then null else median(rt) end as med_rt
  from exp_long group by session_id, exp
),
fast as (
  select session_id, exp, med_rt from med where med_rt < (select quantile_cont(med_rt, 0.01) from med)
),
quest as (
  select distinct session_id, case when session_id = 6 then 1 else 2 end as try_answer from ratings
),
honesty as (
  select distinct session_id, try_answer as honesty_check from quest where try_answer <> 2
),
att as (
  select session_id, exp, case when count(*) > count(hit) then null else avg(hit) end as attn_checks_passed
  from (select session_id, exp,
               cast(regexp_replace(trial_name, 'check_[a-z0-9-]+_', '') = cast(dv as varchar) as double) as hit
        from exp_long where contains(trial_name, 'check')) t
  group by session_id, exp
  having case when count(*) > count(hit) then null else avg(hit) end < 6.0 / 7.0
),
l1 as (
  select coalesce(c.session_id, f.session_id) as session_id, coalesce(c.exp, f.exp) as exp,
         c.same_pcnt, c.n_unique, f.med_rt
  from consistent c full outer join fast f on c.session_id = f.session_id and c.exp = f.exp
),
l2 as (
  select coalesce(l1.session_id, h.session_id) as session_id, l1.exp, l1.same_pcnt, l1.n_unique, l1.med_rt,
         h.honesty_check
  from l1 full outer join honesty h on l1.session_id = h.session_id
),
ledger as (
  select coalesce(l2.session_id, a.session_id) as session_id, coalesce(l2.exp, a.exp) as exp,
         l2.same_pcnt, l2.n_unique, l2.med_rt, l2.honesty_check, a.attn_checks_passed
  from l2 full outer join att a on l2.session_id = a.session_id and l2.exp = a.exp
),
levels as (select * from (values ('A', 1), ('N', 2), ('R', 3)) v(exp, ord)),
final as (
  select e.session_id, e.exp, lv.ord, e.trial_name, e.dv, e.rt, e.dt
  from exp_long e left join levels lv on e.exp = lv.exp
  where not exists (select 1 from ledger l where l.session_id = e.session_id)
    and not contains(e.trial_name, 'check_')
)"""

CELLS = """cells as (
  select exp, session_id, trial_name, dv from firsts where not contains(trial_name, 'check_')
)"""

# A18 screen + complete-case rectangle over a cell CTE named ``cells``.
RECT = """pv as (select exp, session_id, dv, count(*) as n from cells group by exp, session_id, dv),
pr as (select exp, session_id, count(dv) as nn, max(case when dv is null then 1 else 0 end) as has_null,
              sum(n) as n_cells from pv group by exp, session_id),
ns as (select exp, count(distinct trial_name) as n_stim_task from cells group by exp),
variety as (
  select pr.exp, pr.session_id,
         cast(nn + has_null + case when n_cells < n_stim_task then 1 else 0 end as bigint) as n_values
  from pr left join ns on pr.exp = ns.exp
),
kept as (
  select c.* from cells c where not exists (
    select 1 from variety v where v.exp = c.exp and v.session_id = c.session_id and v.n_values < 3)
),
kk as (select exp, count(distinct session_id) as k from kept group by exp),
full_stim as (
  select m.exp, m.trial_name from (select exp, trial_name, count(dv) as m from kept group by exp, trial_name) m
  join kk on m.exp = kk.exp where m.m = kk.k
),
rect as (
  select k.* from kept k where exists (
    select 1 from full_stim f where f.exp = k.exp and f.trial_name = k.trial_name)
),
stim_s as (select exp, trial_name, sum(dv) as s from rect group by exp, trial_name),
rater_s as (select exp, session_id, sum(dv) as s from rect group by exp, session_id),
sums as (
  select t.exp, a.n, b.k, t.total, t.sum_sq, a.ss_stim, b.ss_rater
  from (select exp, cast(sum(dv) as double) as total, cast(sum(dv * dv) as double) as sum_sq from rect group by exp) t
  join (select exp, count(*) as n, cast(sum(s * s) as double) as ss_stim from stim_s group by exp) a on t.exp = a.exp
  join (select exp, count(*) as k, cast(sum(s * s) as double) as ss_rater from rater_s group by exp) b on t.exp = b.exp
),
ms as (
  select *, (ss_stim / k - total * total / (n * k)) / (n - 1) as msb,
            (ss_rater / n - total * total / (n * k)) / (k - 1) as msj,
            (sum_sq - total * total / (n * k) - (ss_stim / k - total * total / (n * k))
                     - (ss_rater / n - total * total / (n * k))) / ((n - 1) * (k - 1)) as mse
  from sums
)"""


def _with(*blocks: str) -> str:
    return "with " + ",\n".join(blocks) + "\n"


SCREEN_BASE = _with(RATINGS, FIRSTS, SCREEN)
AGREE_BASE = _with(RATINGS, FIRSTS, CELLS, RECT)

ORACLE: dict[str, str] = {
    "first_rating": _with(RATINGS, FIRSTS)
    + "select session_id, exp, trial_name, dv, rt, l_orderkey, l_linenumber from firsts",
    "incomplete_tasks": SCREEN_BASE + "select session_id, exp, n, trials_total from incomplete",
    "complete_sessions": SCREEN_BASE + "select session_id, exp, trial_name, dv from complete",
    "first_task": SCREEN_BASE
    + """, fx as (select session_id, exp, min(dt) as first_dt from complete group by session_id, exp),
        fe as (select session_id, arg_min(exp, (first_dt, exp)) as first_exp from fx group by session_id)
        select c.session_id, c.exp, c.trial_name, c.dv from complete c
        join fe on c.session_id = fe.session_id and c.exp = fe.first_exp""",
    "first_task_as_written": SCREEN_BASE
    + """, fx as (select session_id, exp, min(dt) as first_dt from complete group by session_id, exp),
        fe as (select session_id, count(*) as n_exp, arg_min(exp, (first_dt, exp)) as first_exp
               from fx group by session_id)
        select c.session_id, c.exp, c.trial_name, c.dv from complete c
        where not exists (select 1 from fe where fe.n_exp > 1 and fe.session_id = c.session_id
                          and fe.first_exp = c.exp)""",
    "overly_consistent": SCREEN_BASE
    + "select session_id, exp, round(same_pcnt, 6) as same_pcnt, n_unique from consistent",
    "overly_fast": SCREEN_BASE + "select session_id, exp, round(med_rt, 6) as med_rt from fast",
    "honesty_failed": SCREEN_BASE + "select session_id, cast(honesty_check as int) as honesty_check from honesty",
    "attention_failed": SCREEN_BASE
    + "select session_id, exp, round(attn_checks_passed, 6) as attn_checks_passed from att",
    "exclusion_ledger": SCREEN_BASE
    + """select session_id, exp, round(same_pcnt, 6) as same_pcnt, n_unique, round(med_rt, 6) as med_rt,
        cast(honesty_check as int) as honesty_check, round(attn_checks_passed, 6) as attn_checks_passed from ledger""",
    "exclusion_counts": SCREEN_BASE
    + """select 'same_pcnt' as reason, count(same_pcnt) as n from ledger
        union all select 'n_unique', count(n_unique) from ledger
        union all select 'med_rt', count(med_rt) from ledger
        union all select 'honesty_check', count(honesty_check) from ledger
        union all select 'attn_checks_passed', count(attn_checks_passed) from ledger
        union all select 'total', count(*) from ledger""",
    "apply_exclusions": SCREEN_BASE + "select session_id, exp, ord, trial_name, dv from final",
    "quest_restricted": SCREEN_BASE
    + """select q.session_id, q.try_answer from quest q
        where exists (select 1 from final f where f.session_id = q.session_id)""",
    "flow_counts": SCREEN_BASE
    + """select 'initial_raters' as step, count(distinct session_id) as n from ratings
        union all select 'initial_completions', count(distinct (session_id, exp)) from ratings
        union all select 'complete_raters', count(distinct session_id) from exp_long
        union all select 'excluded_raters', count(*) from ledger
        union all select 'additionally_excluded', count(case when same_pcnt is null then 1 end) from consistent
        union all select 'final_raters', count(distinct session_id) from final""",
    "rater_variety": AGREE_BASE + "select exp, session_id, n_values from variety",
    "dropped_raters": AGREE_BASE
    + """select exp, count(*) as dropped_n,
        string_agg(cast(session_id as varchar), '; ' order by session_id) as dropped_ids
        from variety where n_values < 3 group by exp""",
    "icc2k": AGREE_BASE
    + """select exp, k as n_raters, n as n_stimuli,
        round(case when k >= 2 and n >= 2 then (msb - mse) / (msb + (msj - mse) / n) end, 6) as icc2k from ms""",
    "cronbach_alpha": AGREE_BASE
    + """select exp, k as n_raters, n as n_stimuli,
        round(case when k >= 2 and n >= 2 then
          k / (k - 1.0) * (1 - (sum_sq - ss_rater / n) / (ss_stim - total * total / n)) end, 6) as alpha from sums""",
}

BOOT = """centred as (
  select exp, trial_name, session_id,
         cast(dv as double) - avg(cast(dv as double)) over (partition by exp, trial_name) as rc,
         row_number() over (partition by exp, trial_name order by session_id) as pos,
         count(*) over (partition by exp, trial_name) as m
  from cells where dv is not null
),
stims as (select exp, trial_name, max(m) as m from centred group by exp, trial_name),
draws as (
  select exp, trial_name, m, sample_size, iteration, unnest(generate_series(1, sample_size)) as draw
  from (select s.*, z.sample_size, i.iteration from stims s,
          (select range as sample_size from range(1, 21)) z, (select range as iteration from range(0, 20)) i) t
),
picked as (
  select exp, trial_name, sample_size, iteration,
         ('0x' || substr(md5(concat_ws('|', '123', exp, trial_name, sample_size, iteration, draw)), 1, 8))::bigint
           % m + 1 as pos
  from draws
),
means as (
  select p.exp, p.trial_name, p.sample_size, p.iteration, avg(c.rc) as mean_rating
  from picked p join centred c on p.exp = c.exp and p.trial_name = c.trial_name and p.pos = c.pos
  group by p.exp, p.trial_name, p.sample_size, p.iteration
)"""

BOOT_BASE = _with(RATINGS, FIRSTS, CELLS, BOOT)

ORACLE.update({
    "bootstrap_means": BOOT_BASE
    + "select exp, trial_name, sample_size, iteration, round(mean_rating, 6) as mean_rating from means",
    "bootstrap_means_join": BOOT_BASE
    + "select exp, trial_name, sample_size, iteration, round(mean_rating, 6) as mean_rating from means",
})


# ---------------------------------------------------------------- batch 3
def _batch3() -> dict[str, str]:
    from ..functions.text import TITLE_EXAMPLE, TITLE_PATTERN
    from . import adapters as AD

    flags = ", ".join(f"cast((c_custkey >> {i}) & 1 as integer) as {n}" for i, n in enumerate(
        ("std_ang", "std_dis", "std_fea", "std_hap", "std_neu", "std_sad", "std_sur", "unstd_neu")))
    models = f"""models as (
  select split_part(id_, '_', 1) as lab_id, split_part(id_, '_', 2) as model_id, t.* exclude (id_) from (
    select concat('L', lpad(cast(c_nationkey as varchar), 2, '0'), '_', lpad(cast(c_custkey as varchar), 5, '0')) as id_,
           c_custkey as model_key, lower(c_mktsegment) as gender, lower(n_name) as ethnicity,
           case when c_custkey % 23 = 0 then null else cast(18 + c_custkey % 50 as integer) end as age,
           c_acctbal as acctbal, {flags}
    from customer left join nation on c_nationkey = n_nationkey) t
),
grec as {AD.sql_values(AD.GENDER_RECODE, 'k, lab')},
erec as {AD.sql_values(AD.ethnicity_recode(), 'k, lab')},
mrec as (
  select m.*, case when g.lab = 'NA' then null else g.lab end as gender_rec,
         case when e.lab = 'NA' then null else e.lab end as ethnicity_rec
  from models m left join grec g on m.gender = g.k left join erec e on m.ethnicity = e.k
)"""
    mbase = _with(models)

    def level_counts(src: str, col: str, levels: list[str]) -> str:
        lv = AD.sql_values([(v, v, i + 1) for i, v in enumerate(levels)], "level, label, ord")
        return f""", lv as {lv},
counted as (select lv.label, lv.ord, count(*) as n from {src} s left join lv on s.{col} = lv.level
            group by lv.label, lv.ord)
select lv.label, lv.ord, cast(coalesce(c.n, 0) as bigint) as n from lv left join counted c on lv.ord = c.ord
union all select label, ord, cast(n as bigint) from counted where ord is null"""

    emo_lv = AD.sql_values([(c, lab, i + 1) for i, (c, lab) in enumerate(AD.EMOTION_LEVELS)], "code, label, ord")
    cats = AD.sql_list(AD.EMOTION_CATEGORIES)
    brackets = AD.sql_list([b for b, _ in AD.BRACKETS])
    mids = "[" + ", ".join(repr(m) for _, m in AD.BRACKETS) + "]"
    agree = _with(RATINGS, FIRSTS, CELLS)
    stim = "cast(substr(trial_name, 2) as integer)"
    x_y = """x as (select o_custkey, avg(o_totalprice) as x from orders where o_orderstatus = 'F' group by o_custkey),
y as (select o_custkey, avg(o_totalprice) as y from orders where o_orderstatus = 'O' group by o_custkey),
d as (select x - y as d from x join y on x.o_custkey = y.o_custkey where x is not null and y is not null)"""
    return {
        "trial_star_join": """select l_orderkey, l_linenumber, o_orderpriority, c_custkey, n_name,
  round(datediff('day', cast(replace(bday, '-00', '-01') as date), cast(l_shipdate as date)) / 365.25, 1) as user_age
from (select *, concat(cast(1950 + c_custkey % 40 as varchar), '-', lpad(cast(c_custkey % 13 as varchar), 2, '0'), '-',
                       lpad(cast(c_custkey % 29 as varchar), 2, '0')) as bday
      from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
      left join nation on c_nationkey = n_nationkey) t
where c_mktsegment in ('AUTOMOBILE', 'BUILDING') and o_orderstatus in ('F', 'O')""",
        "distinct_trials": """select distinct user_id as session_id, event_type as exp, value as rt, props from events
where event_type in ('click', 'view', 'purchase')""",
        "json_flatten": f"""with lines as (select l_orderkey, count(*) as trials, count(distinct l_partkey) as stim
               from lineitem group by l_orderkey)
select o_orderkey as exp_id,
  trim(regexp_replace('{TITLE_EXAMPLE}' || lower(o_orderpriority), '{TITLE_PATTERN}', '')) as exp,
  lines.trials, lines.stim, cast(l_linenumber as bigint) as n, 's' || cast(l_partkey % 50 as varchar) as name,
  l_partkey as img_id, 'img/' || cast(l_partkey as varchar) || '.jpg' as img_path
from orders join lineitem on o_orderkey = lineitem.l_orderkey join lines on lines.l_orderkey = o_orderkey
where o_orderstatus = 'F'""",
        "recode_lookup": mbase
        + "select lab_id, model_id, gender, gender_rec, ethnicity, ethnicity_rec from mrec",
        "ethnicity_counts": mbase.rstrip() + level_counts("mrec", "ethnicity_rec", AD.ETHNICITY_LEVELS),
        "level_counts": "with dummy as (select 1)" + level_counts("orders", "o_orderpriority", AD.PRIORITY_LEVELS),
        "unit_normalise": """with raw as (
  select p_partkey,
    case when p_partkey % 13 = 0 then 'n/a' else cast(p_size * 4 as varchar) end as height,
    case when p_type in ('ECONOMY', 'LARGE') then 'cm' when p_type in ('SMALL', 'MEDIUM') then 'in'
         when p_type = 'PROMO' then 'NULL' end as height_units,
    cast(p_partkey % 120 as varchar) as weight,
    case when p_partkey % 3 = 0 then 'lb' when p_partkey % 3 = 1 then 'kg' else 'NULL' end as weight_units
  from part),
c as (select p_partkey, try_cast(nullif(height, 'NULL') as double) as h, nullif(height_units, 'NULL') as height_units,
             try_cast(nullif(weight, 'NULL') as double) as w, nullif(weight_units, 'NULL') as weight_units from raw)
select p_partkey, h as height, height_units,
  round(case when height_units = 'cm' and h < 100 then h * 2.54 when height_units = 'in' and h > 100 then h
             when height_units = 'in' then h * 2.54 when height_units = 'cm' then h end, 6) as height_cm,
  w as weight, weight_units,
  round(case when w = 0 then null when weight_units = 'lb' and w < 80 then w when weight_units = 'lb' then w / 2.20462
             when weight_units = 'kg' then w end, 6) as weight_kg
from c""",
        "eav_to_wide": """with tl as (select user_id as session_id, event_type as exp, value as rt, ts as dt,
                   cast(ts as date) as endtime from events),
one as (select session_id, endtime, exp, arg_max(rt, dt) as rt from tl group by session_id, endtime, exp)
select session_id, cast(endtime as varchar) as endtime,
  max(case when exp = 'click' then rt end) as click, max(case when exp = 'error' then rt end) as error,
  max(case when exp = 'purchase' then rt end) as purchase, max(case when exp = 'signup' then rt end) as signup,
  max(case when exp = 'view' then rt end) as view
from one group by session_id, endtime""",
        "flags_long_count_wide": mbase
        + f""", long as (unpivot (select std_ang, std_dis, std_fea, std_hap, std_neu, std_sad, std_sur, unstd_neu from models)
          on std_ang, std_dis, std_fea, std_hap, std_neu, std_sad, std_sur, unstd_neu into name name value value),
counts as (select name, count(*) as n from long where value = 1 group by name),
typed as (select split_part(name, '_', 1) as type, split_part(name, '_', 2) as emotion, n from counts),
wide as (select emotion, max(case when type = 'std' then n end) as std, max(case when type = 'unstd' then n end) as unstd
         from typed group by emotion)
select lv.label as emotion, lv.ord, cast(std as bigint) as std, cast(unstd as bigint) as unstd
from wide left join {emo_lv} lv on wide.emotion = lv.code""",
        "labs_models": mbase
        + """, per_lab as (select lab_id, count(*) as n from mrec group by lab_id)
select count(*) as n_labs, cast(sum(n) as bigint) as n_models, round(avg(n), 6) as mean_per_lab,
       min(n) as min_per_lab, max(n) as max_per_lab from per_lab""",
        "group_demographics": mbase
        + """select gender_rec, count(*) as n, min(age) as age_min, max(age) as age_max, round(avg(age), 6) as age_mean,
       round(min(acctbal), 6) as acctbal_min, round(max(acctbal), 6) as acctbal_max,
       round(avg(acctbal), 6) as acctbal_mean
from mrec group by gender_rec""",
        "age_histogram": mbase + "select age, gender_rec, count(*) as n from mrec group by age, gender_rec",
        "counts_by_group": mbase
        + """select 'ethnicity' as dimension, ethnicity_rec as level, count(*) as n from mrec group by ethnicity_rec
union all select 'segment', gender, count(*) from mrec group by gender""",
        "count_listagg": mbase
        + """, c as (select ethnicity, count(*) as n from mrec group by ethnicity)
select n, string_agg(ethnicity, ', ' order by ethnicity) as items from c group by n""",
        "raters_per_task": SCREEN_BASE
        + """select exp, cast(count(distinct session_id) + max(case when session_id is null then 1 else 0 end) as bigint)
  as n_raters from final group by exp""",
        "rt_histogram": """with med as (select user_id, event_type,
                    case when count(*) > count(value) then null else median(value) end as med_rt
             from events group by user_id, event_type)
select round(greatest(ceil(med_rt / 10.0) - 1, 0) * 10.0, 6) as bin_start, count(*) as n,
       round((select quantile_cont(med_rt, 0.01) from med), 6) as marker
from med where med_rt is not null group by 1""",
        "tile_counts": agree
        + f""", t as (select string_split_regex(printf('lab%d_m%02d_std_neu_front', {stim} % 5, {stim}), '[^A-Za-z0-9]+') as p,
                 dv from cells where exp in ('A', 'N'))
select p[1] as lab_id, p[2] as model_id, dv, count(*) as n from t group by p[1], p[2], dv""",
        "rating_descriptives": agree
        + """select exp, count(dv) as n, round(avg(dv), 6) as mean, round(stddev_samp(dv), 6) as sd,
       round(median(dv), 6) as median, min(dv) as min, max(dv) as max from cells group by exp""",
        "rating_histogram": agree + "select exp, dv, count(*) as n from cells group by exp, dv",
        "confusion_share": agree
        + f""", lab as (select {cats}[{stim} % 6 + 1] as intended, {cats}[(dv - 1) % 6 + 1] as chosen
             from cells where exp = 'R'),
c as (select intended, chosen, count(*) as n from lab group by intended, chosen)
select intended, chosen, n, round(n / sum(n) over (partition by intended), 6) as share from c""",
        "perceived_age_hist": agree
        + f"select {brackets}[dv] as bracket, count(*) as n from cells where exp = 'N' group by 1",
        "correct_by_expression": agree
        + f""", cat as (select {cats}[{stim} % 6 + 1] as expression, count(*) as n,
                   avg(case when (dv - 1) % 6 = {stim} % 6 then 1.0 else 0.0 end) as prop_correct
            from cells where exp = 'R' group by 1),
inten as (select {cats}[{stim} % 6 + 1] as expression, avg(dv) as mean_intensity from cells where exp = 'A' group by 1)
select cat.expression, n, round(prop_correct, 6) as prop_correct, round(mean_intensity, 6) as mean_intensity
from cat left join inten on cat.expression = inten.expression""",
        "mode_share": """with counts as (select p_brand, cast(p_size as varchar) as value, count(*) as freq from part
                where p_size is not null group by p_brand, value)
select p_brand, first(value order by freq desc, value) as mode, max(freq) as freq,
       round(max(freq) / sum(freq), 6) as prop from counts group by p_brand""",
        "mode_vs_actual_corr": f"""with counts as (select o_custkey, o_orderpriority as value, count(*) as freq from orders
                where o_orderpriority is not null group by o_custkey, value),
modes as (select o_custkey, first(value order by freq desc, value) as mode from counts group by o_custkey),
perceived as (select o_custkey, {mids}[cast(substr(mode, 1, 1) as integer) + 1] as perceived from modes),
actual as (select c_custkey, case when c_custkey % 23 = 0 then null else 18 + c_custkey % 50 end as age from customer)
select count(*) as n, round(corr(age, perceived), 6) as r
from perceived p join actual a on p.o_custkey = a.c_custkey where age is not null""",
        "paired_t": "with " + x_y + """
select round((select avg(x) from x), 6) as m_std, round((select avg(y) from y), 6) as m_unstd, count(d) as n_pairs,
       round(avg(d), 6) as m_diff, round(stddev_samp(d), 6) as sd_diff,
       round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) as t, round(cast(count(d) - 1 as double), 6) as df from d""",
        "stimulus_attributes": f"""with nm as (
  select concat_ws('_', 'lab' || cast(p_partkey % 20 as varchar), cast(p_partkey as varchar),
                   case when p_size % 2 = 0 then 'std' else 'unstd' end,
                   {AD.sql_list(AD.EMOTION_CODES)}[p_partkey % 7 + 1], {AD.sql_list(AD.VIEWS)}[p_partkey % 5 + 1]) as name
  from part),
parts as (select string_split_regex(name, '[^A-Za-z0-9]+') as p from nm)
select p[1] as lab, cast(p[2] as bigint) as img, p[3] as type, p[4] as emo from parts where p[5] = 'front'""",
    }


ORACLE.update(_batch3())
