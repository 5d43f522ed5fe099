"""Oracle SQL of the resampling queries at the study's full workload, of the
interval bounds and of omega, written for DuckDB like ``plans.oracle``."""

from __future__ import annotations

from .oracle import AGREE_BASE, CELLS, FIRSTS, ORACLE, RATINGS

GROWN = RATINGS.replace("l_suppkey % 20 as session_id", "l_suppkey as session_id")


def _recursive(*blocks: str) -> str:
    return "with recursive " + ",\n".join(blocks) + "\n"


# ------------------------------------------------------------- distributions
def _terms(a: str, b: str) -> str:
    """Coefficients of the continued fraction of I_x(a, b), last one first."""
    n = f"cast(61 + 10 * ceil(sqrt(greatest({a}, {b}))) as bigint)"
    return f"""list_transform(range({n}, 0, -1), lambda i: case when i % 2 = 1
      then -({a} + i // 2) * ({a} + {b} + i // 2) / (({a} + 2 * (i // 2)) * ({a} + 2 * (i // 2) + 1))
      else (i // 2) * ({b} - i // 2) / (({a} + 2 * (i // 2) - 1) * ({a} + 2 * (i // 2))) end)"""


def _inc(x: str, a: str, b: str, ab: str, ba: str) -> str:
    """I_x(a, b), 0 < x < 1."""
    front = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - (lgamma({a}) + lgamma({b}) - lgamma({a} + {b})))"

    def fold(terms: str, y: str) -> str:
        return f"(1 / (1 + list_reduce(list_prepend(0.0::double, {terms}), lambda acc, term: term * ({y}) / (1 + acc))))"

    return f"""case when {x} < ({a} + 1) / ({a} + {b} + 2) then {front} * {fold(ab, x)} / {a}
      else 1 - {front} * {fold(ba, f'1 - {x}')} / {b} end"""


def beta_quantiles(src: str, keys: str, out: str) -> str:
    """CTEs: ``src`` (keys, q, a, b) -> ``out`` (keys, x) with I_x(a, b) = q,
    by bisection."""
    return f"""{out}_p as (
  select {keys}, q, a, b, {_terms('a', 'b')} as ab, {_terms('b', 'a')} as ba from {src} where a >= 0.5 and b >= 0.5
),
{out}_b as (
  select *, 0.0::double as lo, 1.0::double as hi, 0 as step from {out}_p
  union all
  select {keys}, q, a, b, ab, ba, case when f < q then mid else lo end, case when f < q then hi else mid end, step + 1
  from (select *, {_inc('mid', 'a', 'b', 'ab', 'ba')} as f
        from (select *, (lo + hi) / 2 as mid from {out}_b where step < 60) t) u
),
{out} as (select {keys}, (lo + hi) / 2 as x from {out}_b where step = 60)"""


def icc_bounds(src: str, keys: str) -> str:
    """CTE ``bounds`` (keys, lower_, upper_) from ``src`` (keys, n, k, msb,
    msj, mse, icc2k)."""
    on = " and ".join(f"f1.{c.strip()} = s.{c.strip()} and f2.{c.strip()} = s.{c.strip()}" for c in keys.split(","))
    mine = ", ".join(f"s.{c.strip()}" for c in keys.split(","))
    return f"""sat as (
  select *, (k - 1) * (n - 1) * (k * r * fj + aa) ** 2 / ((n - 1) * k * k * r * r * fj * fj + aa * aa) as v
  from (select *, n * (1 + (k - 1) * r) - k * r as aa
        from (select *, (msb - mse) / (msb + (k - 1) * mse + k * (msj - mse) / n) as r, msj / mse as fj
              from {src} where n >= 2 and k >= 2 and mse > 0 and icc2k is not null) t) u
),
wanted as (
  select {keys}, 1 as w, 0.025::double as q, v / 2 as a, (n - 1) / 2.0::double as b from sat
  union all select {keys}, 2, 0.025::double, (n - 1) / 2.0::double, v / 2 from sat
),
{beta_quantiles('wanted', keys + ', w', 'fq')},
raw as (
  select {mine}, s.n, s.k, msb, msj, mse, s.v * (1 - f1.x) / ((s.n - 1) * f1.x) as f1,
         (s.n - 1) * (1 - f2.x) / (s.v * f2.x) as f2
  from sat s join fq f1 on f1.w = 1 join fq f2 on f2.w = 2 and {on}
),
lohi as (
  select {keys}, k, n * (msb - f1 * mse) / (f1 * (k * msj + (k * n - k - n) * mse) + n * msb) as lo,
         n * (f2 * msb - mse) / (k * msj + (k * n - k - n) * mse + n * f2 * msb) as hi from raw
),
bounds as (select {keys}, k * lo / (1 + (k - 1) * lo) as lower_, k * hi / (1 + (k - 1) * hi) as upper_ from lohi)"""


# ------------------------------------------------------------------ corridor
def _permuted(src: str) -> str:
    """One Feistel pass over column x of ``src`` (a, b, key)."""
    sql = f"select *, x // b as l, x % b as r from {src}"
    for i in range(6):
        side, mod, other = ("l", "a", "r") if i % 2 == 0 else ("r", "b", "l")
        word = f"('0x' || substr(md5(concat_ws('|', key, {i}, {other})), 1, 8))::bigint"
        sql = f"select * replace (({side} + {word}) % {mod} as {side}) from ({sql}) p{i}"
    return f"select * exclude (l, r) replace (l * b + r as x) from ({sql}) p"


SAMPLES = f"""raters as (
  select exp, session_id, row_number() over (partition by exp order by session_id) - 1 as pos,
         count(*) over (partition by exp) as k from (select distinct exp, session_id from cells) t
),
shape as (
  select exp, k, cast(ceil(sqrt(k)) as bigint) as a, cast(ceil(k / ceil(sqrt(k))) as bigint) as b
  from (select distinct exp, k from raters) t
),
grid as (
  select exp, k, a, b, n, iter, concat_ws('|', '123', exp, n, iter) as key, unnest(range(0, n)) as x
  from shape, (select 10 * range as n from range(1, 11)) s, (select range as iter from range(0, 50)) i where n <= k
),
walk as (
  select * from ({_permuted('grid')}) t
  union all
  select * from ({_permuted('(select * from walk where x >= k) w')}) t
),
samples as (
  select w.exp, w.n, w.iter, r.session_id from walk w join raters r on r.exp = w.exp and r.pos = w.x where w.x < w.k
)"""

CORRIDOR = f"""{SAMPLES},
sc as (
  select s.exp, s.n, s.iter, c.session_id, c.trial_name, cast(c.dv as bigint) as dv
  from cells c join samples s on c.exp = s.exp and c.session_id = s.session_id where c.dv is not null
),
n_i as (select exp, n, iter, trial_name, count(*) as c, sum(dv) as s from sc group by exp, n, iter, trial_name),
n_j as (select exp, n, iter, session_id, count(*) as c, sum(dv) as s from sc group by exp, n, iter, session_id),
tot as (select exp, n, iter, cast(count(*) as double) as nn, cast(sum(dv) as double) as g, cast(sum(dv * dv) as double) as t0
        from sc group by exp, n, iter),
si as (select exp, n, iter, count(*) as a, sum(cast(s as double) * cast(s as double) / c) as ta, sum(cast(c as double) * c) as q1
       from n_i group by exp, n, iter),
sj as (select exp, n, iter, count(*) as b, sum(cast(s as double) * cast(s as double) / c) as tb, sum(cast(c as double) * c) as q2
       from n_j group by exp, n, iter),
mm as (
  select tot.exp, tot.n, tot.iter, a, b, nn, t0, ta, tb, g * g / nn as tm, q1 / nn as k1, q2 / nn as k2,
         (t0 - ta) / nullif(nn - a, 0) as p, (t0 - tb) / nullif(nn - b, 0) as q
  from tot join si on tot.exp = si.exp and tot.n = si.n and tot.iter = si.iter
  join sj on tot.exp = sj.exp and tot.n = sj.n and tot.iter = sj.iter
),
vc as (select *, ((nn - k1) * q + (a - k2) * p - (ta - tm)) / nullif(nn - k1 - k2 + 1, 0) as ve from mm),
corridor as (
  select exp, n, iter, b as n_raters, a as n_stimuli, cast(a * b - nn as bigint) as n_cells_missing,
         case when a >= 2 and b >= 2 and ve >= 0 and p >= 0 and q - ve + p / b > 0 then (q - ve) / (q - ve + p / b) end as icc2k,
         ve + b * (q - ve) as msb, ve + a * (p - ve) as msj, ve as mse
  from vc
),
csummary as (
  select exp, n, median(icc2k) as icc_median, quantile_cont(icc2k, 0.025) as icc_low,
         quantile_cont(icc2k, 0.975) as icc_high
  from corridor group by exp, n
)"""
CORRIDOR_BASE = _recursive(GROWN, FIRSTS, CELLS, CORRIDOR)

# ----------------------------------------------------------------- bootstrap
_MASK = "4294967295"


def _scrambled(z: str) -> str:
    for _ in range(2):
        z = f"((xor({z}, ({z}) >> 16) * 73244475) & {_MASK})"
    return z


BOOT = f"""vals as (
  select sid, dv, row_number() over (partition by sid order by dv) - 1 as at
  from (select dense_rank() over (order by exp, trial_name) as sid, cast(dv as bigint) as dv from cells where dv is not null) t
),
stims as (
  select sid, exp, trial_name, count(*) as m, avg(cast(dv as double)) as mean
  from (select dense_rank() over (order by exp, trial_name) as sid, exp, trial_name, dv from cells where dv is not null) t
  group by sid, exp, trial_name
),
drawn as (
  select sid, m, sample_size, iteration, (base + unnest(range(1, sample_size + 1)) * 2654435769) & {_MASK} as z
  from (select sid, m, sample_size, iteration,
               ('0x' || substr(md5(concat_ws('|', '123', exp, trial_name, sample_size, iteration)), 1, 8))::bigint as base
        from stims, (select range as sample_size from range(1, 101)) s, (select range as iteration from range(0, 300)) i) t
),
mix1 as (select sid, m, sample_size, iteration, (xor(z, z >> 16) * 73244475) & {_MASK} as z from drawn),
mix2 as (select sid, m, sample_size, iteration, (xor(z, z >> 16) * 73244475) & {_MASK} as z from mix1),
sums as (
  select d.sid, sample_size, iteration, sum(v.dv) as s
  from (select sid, sample_size, iteration, (xor(z, z >> 16) * m) >> 32 as at from mix2) d
  join vals v on v.sid = d.sid and v.at = d.at group by d.sid, sample_size, iteration
),
means as (
  select exp, trial_name, sample_size, iteration, s / sample_size - mean as mean_rating
  from sums join stims on sums.sid = stims.sid
),
ranked_means as (
  select exp, sample_size, mean_rating,
         row_number() over (partition by exp, sample_size order by mean_rating) as rpos,
         count(*) over (partition by exp, sample_size) as len
  from means
),
cis as (
  select exp, sample_size,
         max(case when floor(len * (1 - 0.95) / 2) > 0 and rpos = floor(len * (1 - 0.95) / 2) then mean_rating end) as ll,
         max(case when rpos = len - floor(len * (1 - 0.95) / 2) then mean_rating end) as ul
  from ranked_means group by exp, sample_size
),
pos as (
  select k.exp, p.pos from (select distinct exp from cis) k left join (
    select exp, cast(min(sample_size) as bigint) as pos from cis
    where ll is not null and ul is not null and greatest(abs(ll), abs(ul)) < 0.75 group by exp) p on k.exp = p.exp
)"""
BOOT_BASE = _recursive(GROWN, FIRSTS, CELLS, BOOT)

# --------------------------------------------------------------------- omega
OMEGA = """mstat as (
  select exp, session_id, avg(cast(dv as double)) as m, var_pop(cast(dv as double)) * count(dv) as ss
  from kept where dv is not null group by exp, session_id
),
zz as (
  select k.exp, k.session_id, k.trial_name, (k.dv - m) / sqrt(ss) as z
  from kept k join mstat s on s.exp = k.exp and s.session_id = k.session_id where k.dv is not null and ss > 1e-9
),
rr as (
  select a.exp, a.session_id as i, b.session_id as j, sum(a.z * b.z) as r
  from zz a join zz b on a.exp = b.exp and a.trial_name = b.trial_name group by a.exp, a.session_id, b.session_id
),
fit as (
  select exp, i, 0.5::double as l, 0 as step from (select distinct exp, i from rr) t
  union all
  select exp, i, least(greatest((y / c) / (s2 - l * l), -sqrt(0.995)), sqrt(0.995)), step + 1
  from (select exp, i, l, y, step, sum(l * l) over w as s2,
               sqrt(sum(l * y) over w / ((sum(l * l) over w) ** 2 - sum(l ** 4) over w)) as c
        from (select rr.exp, rr.i, max(case when rr.i = rr.j then f.l end) as l,
                     sum(case when rr.i <> rr.j then r * f.l else 0 end) as y, max(f.step) as step
              from rr join fit f on f.exp = rr.exp and f.i = rr.j where f.step < 400 group by rr.exp, rr.i) t
        window w as (partition by exp)) u
),
sgn as (select exp, i, l, case when l < 0 then -1 else 1 end as s from fit where step = 400),
om as (
  select t.exp, 1 - u / t.r as omega from
    (select rr.exp, sum(r * a.s * b.s) as r from rr join sgn a on a.exp = rr.exp and a.i = rr.i
     join sgn b on b.exp = rr.exp and b.i = rr.j group by rr.exp) t
    join (select exp, sum(1 - l * l) as u from sgn group by exp) v on v.exp = t.exp
)"""

_TRAIT_T = """select count(d) as n_pairs, avg(d) as m_diff, stddev_samp(d) as sd_diff,
  avg(d) / (stddev_samp(d) / sqrt(count(d))) as t, cast(count(d) - 1 as double) as df"""


def t_interval(src: str, keys: str) -> str:
    """CTE ``tint`` (keys, lo, hi, p) from ``src`` (keys, n_pairs, m_diff,
    sd_diff, t, df)."""
    on = " and ".join(f"x.{c.strip()} = s.{c.strip()}" for c in keys.split(","))
    mine = ", ".join(f"s.{c.strip()}" for c in keys.split(","))
    a, b = "(df / 2)", "(0.5::double)"
    tail = _inc("(df / (df + t * t))", a, b, _terms(a, b), _terms(b, a))
    return f"""tw as (select {keys}, 0.05::double as q, df / 2 as a, 0.5::double as b from {src}),
{beta_quantiles('tw', keys, 'tq')},
tint as (
  select {mine}, m_diff - sqrt(df * (1 - x.x) / x.x) * sd_diff / sqrt(n_pairs) as lo,
         m_diff + sqrt(df * (1 - x.x) / x.x) * sd_diff / sqrt(n_pairs) as hi, {tail} as p
  from {src} s join tq x on {on}
)"""


P_TEXT = "case when p < 0.001 then '<.001' else regexp_replace(printf('%.3f', p), '^0', '') end"

ORACLE.update({
    "icc_corridor": CORRIDOR_BASE
    + "select exp, n, iter, n_raters, n_stimuli, n_cells_missing, round(icc2k, 6) as icc2k from corridor",
    "icc_corridor_bounds": _recursive(
        GROWN, FIRSTS, CELLS, CORRIDOR,
        "cin as (select exp, n as size_, iter, n_stimuli as n, n_raters as k, msb, msj, mse, icc2k from corridor)",
        icc_bounds("cin", "exp, size_, iter"))
    + """select c.exp, c.n, c.iter, c.n_stimuli, round(icc2k, 6) as icc2k, round(lower_, 6) as icc2k_lower,
       round(upper_, 6) as icc2k_upper
from corridor c left join bounds b on b.exp = c.exp and b.size_ = c.n and b.iter = c.iter""",
    "icc_corridor_summary": CORRIDOR_BASE
    + """select exp, n, round(icc_median, 6) as icc_median, round(icc_low, 6) as icc_low,
        round(icc_high, 6) as icc_high from csummary""",
    "icc_thresholds": CORRIDOR_BASE
    + """select exp, min(case when icc_median >= 0.75 then n end) as n_for_075,
        min(case when icc_median >= 0.90 then n end) as n_for_090 from csummary group by exp""",
    "corridor_ribbon": CORRIDOR_BASE
    + """, th as (select exp, min(case when icc_median >= 0.75 then n end) as n_for_075,
                 min(case when icc_median >= 0.90 then n end) as n_for_090 from csummary group by exp)
select s.exp, s.n, round(icc_median, 6) as icc_median, round(icc_low, 6) as icc_low, round(icc_high, 6) as icc_high,
       n_for_075, n_for_090 from csummary s left join th on s.exp = th.exp""",
    "rater_sample_counts": _recursive(GROWN, FIRSTS, CELLS, SAMPLES)
    + """select exp, session_id, count(*) as n_drawn, cast(sum(n * (iter + 1)) as bigint) as check_sum
from samples group by exp, session_id""",
    "bootstrap_full": BOOT_BASE
    + """select exp, sample_size, count(*) as n_means, round(avg(mean_rating), 6) as mean,
       round(stddev_samp(mean_rating), 6) as sd, round(min(mean_rating), 6) as low, round(max(mean_rating), 6) as high
from means group by exp, sample_size""",
    "stability_ci": BOOT_BASE + "select exp, sample_size, round(ll, 6) as ll, round(ul, 6) as ul from cis",
    "stability_normal_ci": BOOT_BASE
    + """select exp, sample_size,
        round(avg(mean_rating) - 1.959963984540054 * stddev_samp(mean_rating) / sqrt(count(mean_rating)), 6) as ll,
        round(avg(mean_rating) + 1.959963984540054 * stddev_samp(mean_rating) / sqrt(count(mean_rating)), 6) as ul
        from means group by exp, sample_size""",
    "point_of_stability": BOOT_BASE + "select exp, pos from pos",
    "point_of_stability_sustained": BOOT_BASE
    + """, flagged as (
          select exp, sample_size,
                 min(case when ll is not null and ul is not null and greatest(abs(ll), abs(ul)) < 0.75 then 1 else 0 end)
                   over (partition by exp order by sample_size rows between current row and unbounded following) as ok
          from cis)
        select k.exp, p.pos from (select distinct exp from cis) k left join
          (select exp, cast(min(sample_size) as bigint) as pos from flagged where ok = 1 group by exp) p on k.exp = p.exp""",
    "stability_ribbon": BOOT_BASE
    + """select c.exp, c.sample_size, round(c.ll, 6) as ll, round(c.ul, 6) as ul, p.pos
        from cis c left join pos p on c.exp = p.exp""",
    "icc2k_bounds": _recursive(
        AGREE_BASE.strip().removeprefix("with "),
        """fin as (select exp, n, k, msb, msj, mse,
       case when k >= 2 and n >= 2 then (msb - mse) / (msb + (msj - mse) / n) end as icc2k from ms)""",
        icc_bounds("fin", "exp"))
    + """select f.exp, f.k as n_raters, f.n as n_stimuli, round(icc2k, 6) as icc2k, round(lower_, 6) as icc2k_lower,
       round(upper_, 6) as icc2k_upper from fin f left join bounds b on b.exp = f.exp""",
    "omega_total": _recursive(AGREE_BASE.strip().removeprefix("with "), OMEGA)
    + """select k.exp, k.n_raters, k.n_cells_missing, round(om.omega, 6) as omega_t
from (select exp, count(distinct session_id) as n_raters,
             count(distinct session_id) * count(distinct trial_name) - count(*) as n_cells_missing from zz group by exp) k
left join om on om.exp = k.exp""",
    "paired_t_p": _recursive(
        """x as (select o_custkey, avg(o_totalprice) as x from orders where o_orderstatus = 'F' group by o_custkey),
y as (select o_custkey, avg(o_totalprice) as y from orders where o_orderstatus = 'O' group by o_custkey),
d as (select x - y as d from x join y on x.o_custkey = y.o_custkey where x is not null and y is not null)""",
        f"st as ({_TRAIT_T}, 1 as one from d)", t_interval("st", "one"))
    + f"""select round((select avg(x) from x), 6) as m_std, round((select avg(y) from y), 6) as m_unstd, n_pairs,
       round(m_diff, 6) as m_diff, round(sd_diff, 6) as sd_diff, round(t, 6) as t, round(df, 6) as df,
       round(lo, 6) as ci_95_lower, round(hi, 6) as ci_95_upper, round(p, 6) as p_value, {P_TEXT} as p
from st join tint on st.one = tint.one""",
})
