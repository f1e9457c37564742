"""Registered queries: one for each operator and some composites, over panels made from the test tables, with equal SQL.

The monthly panel is lineitem by supplier and month of shipping; its columns use aggregates that don't depend on the order of rows and are
scaled to the order of one, by primes, so that no value lies between two results. Results are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import evaluate
from ..sources import panel as P
from .planner import compile_request

Query = Callable[[SparkSession, str], DataFrame]


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey is not null and l_shipdate is not null")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    keyed = t.groupBy(F.col("l_suppkey").alias("instrument"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("ts"))
    made = keyed.agg(
        (F.max(net) / 98317).alias("bar__close"), (F.min(net) / 98317).alias("bar__open"), (F.max("l_extendedprice") / 98317).alias("bar__high"),
        (F.min("l_extendedprice") / 98317).alias("bar__low"), (F.sum("l_quantity") / 997).alias("bar__volume"),
    )
    return made.withColumn("data__sector", (F.col("instrument") % 5).cast("double"))


MONTHLY_SQL = """panel as (
  select l_suppkey as instrument, (year(l_shipdate) * 12 + month(l_shipdate))::bigint as ts,
         max(l_extendedprice * (1 - l_discount)) / 98317 as close, min(l_extendedprice * (1 - l_discount)) / 98317 as open,
         max(l_extendedprice) / 98317 as high, min(l_extendedprice) / 98317 as low, sum(l_quantity) / 997 as volume, (l_suppkey % 5)::double as sector
  from lineitem where l_suppkey is not null and l_shipdate is not null group by 1, 2)"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def factor(expr: str) -> Query:
    plan = compile_request([expr], ["value"])
    return lambda spark, sf_dir: rounded(evaluate(plan, monthly(spark, sf_dir)), "value")


def _sql(value: str, base: str = "panel", steps: str = "") -> str:
    return f"with {MONTHLY_SQL}{steps} select ts, instrument, round(case when isfinite(v) then v end, 6) + 0.0 as value from (select ts, instrument, ({value})::double as v from {base})"


def _frame(w: int) -> str:
    return f"(partition by instrument order by ts rows between {w - 1} preceding and current row)"


def _full(f: str, w: int, x: str = "close") -> str:
    return f"case when count({x}) over {_frame(w)} = {w} then {f} end"


def _agg(name: str, w: int, x: str = "close") -> str:
    return _full(f"{name}({x}) over {_frame(w)}", w, x)


def _list(f: str, w: int, x: str = "close") -> tuple[str, str]:
    """(final value, step): the window's list first, then a function of it called a."""
    return f"case when n = {w} then {f} end", f", s as (select *, {x} as x, list({x}) over {_frame(w)} as a, count({x}) over {_frame(w)} as n from panel)"


def _ewm(w: int, item: str) -> str:
    weight = f"power(1 - 2.0 / {w + 1}, {w} - k)"
    return f"list_sum(list_transform(a, lambda v, k: {item} * {weight})) / list_sum(list_transform(a, lambda v, k: {weight}))"


#: name -> (expression, SQL of the value, SQL of the table it reads, steps before it)
OPERATORS: dict[str, tuple[str, ...]] = {}


def _add(name: str, expr: str, value: str, base: str = "panel", steps: str = "") -> None:
    OPERATORS[name] = (expr, value, base, steps)


# element-wise
_add("elem_abs", "elem_abs(close - open * 4)", "abs(close - open * 4)")
_add("elem_exp", "elem_exp(close - low)", "exp(close - low)")
_add("elem_log", "elem_log(close - 0.5)", "case when close - 0.5 > 0 then ln(close - 0.5) end")
_add("elem_sign", "elem_sign(close - open * 4)", "case when close - open * 4 >= 0 then 1.0 else -1.0 end")
_add("elem_sqrt", "elem_sqrt(close - 0.5)", "case when close - 0.5 >= 0 then sqrt(close - 0.5) end")
_add("elem_clip", "elem_clip(close, 0.3, 0.6)", "least(greatest(close, 0.3), 0.6)")
_add("elem_where", "elem_where(close > 0.6, volume, open)", "case when close > 0.6 then volume else open end")
_add("elem_fillna", "elem_fillna(elem_log(close - 0.5), 0 - open)", "coalesce(case when close - 0.5 > 0 then ln(close - 0.5) end, 0 - open)")
_add("elem_add", "close + open", "close + open")
_add("elem_sub", "close - open", "close - open")
_add("elem_mul", "close * volume", "close * volume")
_add("elem_div", "volume / elem_max(close - 0.6, 0)", "case when greatest(close - 0.6, 0) <> 0 then volume / greatest(close - 0.6, 0) end")
_add("elem_pow", "elem_pow(close, volume)", "power(close, volume)")
_add("elem_min", "elem_min(close, volume)", "least(close, volume)")
_add("elem_max", "elem_max(close, volume)", "greatest(close, volume)")
_add("elem_signed_power", "elem_signed_power(close - open * 4, 2)", "(case when close - open * 4 >= 0 then 1 else -1 end) * power(abs(close - open * 4), 2)")
_add("elem_to_int", "elem_to_int(elem_max(close - 0.6, 0))", "case when greatest(close - 0.6, 0) <> 0 then 1.0 else 0.0 end")
_add("elem_not", "~elem_max(close - 0.6, 0)", "case when greatest(close - 0.6, 0) = 0 then 1.0 else 0.0 end")
for _name, _op in (("elem_lt", "<"), ("elem_le", "<="), ("elem_gt", ">"), ("elem_ge", ">="), ("elem_eq", "=="), ("elem_ne", "!=")):
    _other = "elem_max(close, 0.6)"
    _add(_name, f"close {_op} {_other}", f"case when close {_op.replace('==', '=').replace('!=', '<>')} greatest(close, 0.6) then 1.0 else 0.0 end")
_add("elem_and", "(close > 0.5) & (volume > 0.1)", "case when close > 0.5 and volume > 0.1 then 1.0 else 0.0 end")
_add("elem_or", "(close > 0.8) | (volume > 0.2)", "case when close > 0.8 or volume > 0.2 then 1.0 else 0.0 end")

# rolling
for _name, _f in (("ts_mean", "avg"), ("ts_sum", "sum"), ("ts_product", "product"), ("ts_min", "min"), ("ts_max", "max"), ("ts_std", "stddev_samp"), ("ts_var", "var_samp"), ("ts_skew", "skewness"), ("ts_kurt", "kurtosis")):
    _add(_name, f"{_name}(close, 5)", _agg(_f, 5))
_add("ts_mad", "ts_mad(close, 5)", *_list("list_avg(list_transform(a, lambda v: abs(v - list_avg(a))))", 5)[:1], "s", _list("", 5)[1])
_add("ts_delta", "ts_delta(close, 3)", "close - lag(close, 3) over (partition by instrument order by ts)")
_add("ts_lag", "ts_lag(close, 3)", "lag(close, 3) over (partition by instrument order by ts)")
_add("ts_zscore", "ts_zscore(close, 5)", _full(f"case when stddev_samp(close) over {_frame(5)} > 0 then (close - avg(close) over {_frame(5)}) / stddev_samp(close) over {_frame(5)} else 0.0 end", 5))
_add("ts_cov", "ts_cov(close, volume, 6)", _full(f"covar_samp(close, volume) over {_frame(6)}", 6))
_add("ts_beta", "ts_beta(close, volume, 6)", _full(f"case when var_samp(volume) over {_frame(6)} * 5 > 1e-12 then covar_samp(close, volume) over {_frame(6)} / var_samp(volume) over {_frame(6)} end", 6))
_add("ts_linear_regression", "ts_linear_regression(volume, close, 6)", OPERATORS["ts_beta"][1])
_add(
    "ts_corr", "ts_corr(close, volume, 6)",
    _full(f"case when var_samp(volume) over {_frame(6)} * 5 > 1e-12 and var_samp(close) over {_frame(6)} * 5 > 1e-12 then covar_samp(close, volume) over {_frame(6)} / stddev_samp(volume) over {_frame(6)} / stddev_samp(close) over {_frame(6)} end", 6),
)
_add("ts_ewm_mean", "ts_ewm_mean(close, 5)", _list(_ewm(5, "v"), 5)[0], "s", _list("", 5)[1])
_add("ts_ewm_var", "ts_ewm_var(close, 5)", _list(f"greatest(0.0, {_ewm(5, 'v * v')} - power({_ewm(5, 'v')}, 2))", 5)[0], "s", _list("", 5)[1])
_add("ts_ewm_cov", "ts_ewm_cov(close, volume, 5)", f"case when n = 5 then {_ewm(5, 'v.x * v.y')} - {_ewm(5, 'v.x')} * {_ewm(5, 'v.y')} end", "s", f", s as (select *, list({{'x': close, 'y': volume}}) over {_frame(5)} as a, count(close) over {_frame(5)} as n from panel)")
_add("ts_decay_linear", "ts_decay_linear(close, 5)", _list("list_sum(list_transform(a, lambda v, k: v * k)) / 15", 5)[0], "s", _list("", 5)[1])
_add("ts_argmax", "ts_argmax(close, 5)", _list("list_position(list_reverse(a), list_max(a)) - 1", 5)[0], "s", _list("", 5)[1])
_add("ts_argmin", "ts_argmin(close, 5)", _list("list_position(list_reverse(a), list_min(a)) - 1", 5)[0], "s", _list("", 5)[1])
_add("ts_quantile", "ts_quantile(close, 6, 0.3)", _full(f"quantile_cont(close, 0.3) over {_frame(6)}", 6))
_add("ts_rank", "ts_rank(close, 5)", _list("((len(list_filter(a, lambda v: v < x)) + 1 + len(list_filter(a, lambda v: v <= x))) / 2.0 - 1) / 4", 5)[0], "s", _list("", 5)[1])

# cross-sectional
_T = "over (partition by ts)"
_RANK = "case when count(x) over (partition by ts) > 1 then (rank() over (partition by ts, x is null order by x) + (count(*) over (partition by ts, x) - 1) / 2.0 - 1) / (count(x) over (partition by ts) - 1) else 0.0 end"
_X = ", s as (select *, case when close > 0.5 then close end as x from panel)"  # some invalid values
_IN = "elem_where(close > 0.5, close, elem_log(0 - close))"  # the same in an expression
_add("cs_rank", f"cs_rank({_IN})", f"case when x is not null then {_RANK} end", "s", _X)
_add("cs_zscore", f"cs_zscore({_IN})", f"case when x is not null then case when stddev_pop(x) {_T} > 0 then (x - avg(x) {_T}) / stddev_pop(x) {_T} else 0.0 end end", "s", _X)
_add("cs_center", f"cs_center({_IN})", f"x - avg(x) {_T}", "s", _X)
_add("cs_scale", f"cs_scale({_IN})", f"x / sum(abs(x)) {_T}", "s", _X)
_add("cs_norm", f"cs_norm({_IN})", f"case when x is not null then case when max(x) {_T} > min(x) {_T} then (x - min(x) {_T}) / (max(x) {_T} - min(x) {_T}) else 0.0 end end", "s", _X)
_add("cs_fillna", f"cs_fillna({_IN})", f"coalesce(x, avg(x) {_T})", "s", _X)
_add("cs_winsorize", f"cs_winsorize({_IN}, 0.1)", f"case when x is not null then least(greatest(x, quantile_cont(x, 0.1) {_T}), quantile_cont(x, 0.9) {_T}) end", "s", _X)
_add("cs_percentiles", f"cs_percentiles({_IN}, 0.25, 0.75)", f"case when x is not null then case when x <= quantile_cont(x, 0.25) {_T} or x >= quantile_cont(x, 0.75) {_T} then x else 0.0 end end", "s", _X)
_G = "over (partition by ts, sector)"
_add("cs_neutralize", "cs_neutralize(close, group=data.sector, weights=volume)", f"case when volume > 0 then close - sum(volume * close) {_G} / sum(volume) {_G} end")
_add(
    "cs_neutralize_ols", "cs_neutralize_ols(close, volume, group=data.sector, standardize=true)", "case when vr > 1e-12 then (r - ar) / sqrt(vr) end", "u",
    f""", s as (select *, close - avg(close) {_G} as cy, volume - avg(volume) {_G} as cx from panel),
  q as (select *, cy - case when avg(cx * cx) {_G} > 1e-12 then avg(cx * cy) {_G} / avg(cx * cx) {_G} else 0 end * cx as r from s),
  u as (select *, var_samp(r) {_G} as vr, avg(r) {_G} as ar from q)""",
)
_add(
    "cs_neutralize_ols_multi", "cs_neutralize_ols_multi(close, volume, open)", "cy - b1 * x1 - b2 * x2", "u",
    f""", s as (select *, close - avg(close) {_T} as cy, volume - avg(volume) {_T} as x1, open - avg(open) {_T} as x2 from panel),
  q as (select *, avg(x1 * x1) {_T} as m11, avg(x1 * x2) {_T} as m12, avg(x2 * x2) {_T} as m22, avg(x1 * cy) {_T} as v1, avg(x2 * cy) {_T} as v2 from s),
  u as (select *, case when small then 0 else (v1 * m22 - v2 * m12) / d end as b1, case when small then 0 else (v2 * m11 - v1 * m12) / d end as b2
        from (select *, m11 * m22 - m12 * m12 as d, greatest(m11, abs(m12)) <= 1e-12 or abs(m11 * m22 - m12 * m12) / greatest(m11, abs(m12)) <= 1e-12 as small from q))""",
)

_add(
    "cs_neutralize_ols_three", "cs_neutralize_ols_multi(close, volume, open, high)", "cy - (c1 * x1 + c2 * x2 + c3 * x3) / d", "u",
    f""", s as (select *, close - avg(close) {_T} as cy, volume - avg(volume) {_T} as x1, open - avg(open) {_T} as x2, high - avg(high) {_T} as x3 from panel),
  q as (select *, avg(x1 * x1) {_T} as a, avg(x1 * x2) {_T} as b, avg(x1 * x3) {_T} as c, avg(x2 * x2) {_T} as e, avg(x2 * x3) {_T} as f, avg(x3 * x3) {_T} as g,
               avg(x1 * cy) {_T} as v1, avg(x2 * cy) {_T} as v2, avg(x3 * cy) {_T} as v3 from s),
  u as (select *, v1 * (e * g - f * f) - b * (v2 * g - f * v3) + c * (v2 * f - e * v3) as c1, a * (v2 * g - f * v3) - v1 * (b * g - f * c) + c * (b * v3 - v2 * c) as c2,
               a * (e * v3 - v2 * f) - b * (b * v3 - v2 * c) + v1 * (b * f - e * c) as c3, a * (e * g - f * f) - b * (b * g - f * c) + c * (b * f - e * c) as d from q)""",
)

# composites
_add("cs_rank_ts_mean", "cs_rank(ts_mean(close, 3))", f"case when x is not null then {_RANK} end", "s", f", s as (select *, {_agg('avg', 3)} as x from panel)")
_add("alpha_101", "(close - open) / (high - low + 0.001)", "(close - open) / (high - low + 0.001)")
_add("alpha_012", "elem_sign(ts_delta(volume, 1)) * (-1 * ts_delta(close, 1))", "(case when volume - pv >= 0 then 1 else -1 end) * -(close - pc)", "s", ", s as (select *, lag(volume) over (partition by instrument order by ts) as pv, lag(close) over (partition by instrument order by ts) as pc from panel)")
_add("alpha_028", "cs_scale(ts_mean(volume, 5) + (high + low) / 2 - close)", f"x / sum(abs(x)) {_T}", "s", f", s as (select *, {_agg('avg', 5, 'volume')} + (high + low) / 2 - close as x from panel)")
_add("alpha_023", "elem_where(ts_sum(high, 20) / 20 < high, -1 * ts_delta(high, 2), 0)", "case when m is not null and d is not null then case when m < high then -d else 0 end end", "s", f", s as (select *, {_full(f'sum(high) over {_frame(20)}', 20, 'high')} / 20 as m, high - lag(high, 2) over (partition by instrument order by ts) as d from panel)")

QUERIES: dict[str, Query] = {name: factor(expr) for name, (expr, *_) in OPERATORS.items()}
ORACLE_SQL: dict[str, str] = {name: _sql(value, base, steps) for name, (_, value, base, steps) in OPERATORS.items()}


# --- sources: as-of alignment, late and revised events, the grid of the universe, readiness and flags


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds as a long: the same whatever the session's time zone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and ts is not null")
    return e.withColumn("ts", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))"))


def cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are one source, purchases another; their latest values meet on every timestamp of either."""
    e = _events(spark, sf_dir)
    one = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    views = P.from_table(one("view"), "bar", "user_id", "ts", close="value")
    bought = P.from_table(one("purchase"), "quote_tick", "user_id", "ts", bid_price="value")
    got = evaluate(["bar.close - quote_tick.bid_price"], P.carry_forward(P.align([views, bought])))
    return rounded(got.select("ts", "instrument", F.col(got.columns[-1]).alias("value")), "value")


QUERIES["source_as_of"] = cross_source
ORACLE_SQL["source_as_of"] = """
with p as (select user_id as instrument, ts, max(value) filter (event_type = 'view') as c, max(value) filter (event_type = 'purchase') as b
           from events where event_type in ('view', 'purchase') and user_id is not null and ts is not null group by 1, 2),
f as (select instrument, ts, last_value(c ignore nulls) over w as c, last_value(b ignore nulls) over w as b from p window w as (partition by instrument order by ts rows unbounded preceding))
select epoch_us(ts) as ts, instrument, round(c - b, 6) + 0.0 as value from f
"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the hour, arriving in the order of a shuffled number: many come late or revise an hour."""
    e = _events(spark, sf_dir)
    return e.select(F.col("user_id").alias("instrument"), F.floor(F.col("ts") / 43_200_000_000).cast("long").alias("ts"), ((F.col("event_id") * 7919) % 100003).alias("arrival"), F.col("value").alias("bar__close"), F.when(F.col("event_type") == "error", P.REVISION).otherwise(0).alias("flags"))


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.settle_events(_arrivals(spark, sf_dir), ["bar__close"], all_count=True)
    return got.select("ts", "instrument", F.col("bar__close").alias("value"))


QUERIES["source_late_and_revised"] = settled
ORACLE_SQL["source_late_and_revised"] = """
with e as (select user_id as instrument, floor(epoch_us(ts) / 43200000000)::bigint as ts, (event_id * 7919) % 100003 as arrival, value from events where user_id is not null and ts is not null),
m as (select *, max(ts) over (partition by instrument order by arrival rows between unbounded preceding and 1 preceding) as seen from e)
select ts, instrument, arg_max(value, arrival) as value from m where seen is null or ts >= seen group by ts, instrument
"""


def forced_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user at every half day with the last value so far, and the flags of the events since the one before."""
    e = _arrivals(spark, sf_dir)
    universe, times = e.select("instrument").distinct(), e.select("ts").distinct()
    panel, marked = P.advance_grid(P.settle_events(e, ["bar__close"]), universe, times, ["bar__close"], "force")
    value = evaluate(["bar.close * 2"], panel)
    flags = P.quality_flags(e, times, universe, marked)
    got = value.join(flags, ["ts", "instrument"]).select("ts", "instrument", F.col(value.columns[-1]).alias("value"), F.col("quality_flags").cast("long").alias("quality_flags"))
    return rounded(got, "value")


QUERIES["source_forced_grid"] = forced_grid
ORACLE_SQL["source_forced_grid"] = """
with e as (select user_id as instrument, floor(epoch_us(ts) / 43200000000)::bigint as ts, (event_id * 7919) % 100003 as arrival, value, case when event_type = 'error' then 2 else 0 end as f
           from events where user_id is not null and ts is not null),
m as (select *, max(ts) over (partition by instrument order by arrival rows between unbounded preceding and 1 preceding) as seen from e),
s as (select ts, instrument, arg_max(value, arrival) as value from m where seen is null or ts >= seen group by ts, instrument),
grid as (select * from (select distinct ts from e), (select distinct instrument from e)),
r as (select min(x) as ready from (select max(ts) as x from s group by instrument)),
g as (select grid.ts, grid.instrument, last_value(s.value ignore nulls) over (partition by grid.instrument order by grid.ts rows unbounded preceding) as value
      from grid left join s on s.ts = grid.ts and s.instrument = grid.instrument),
fl as (select ts, instrument, bit_or(f) as f from e group by 1, 2)
select g.ts, g.instrument, round(g.value * 2, 6) + 0.0 as value, (coalesce(fl.f, 0) | case when g.ts > r.ready then 1 else 0 end)::bigint as quality_flags
from g cross join r left join fl on fl.ts = g.ts and fl.instrument = g.instrument
"""


def long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form: a row for each output and cell; the two expressions are one node, under two names."""
    from ..engine import long_form

    got = evaluate(["close + open", "open + close", "cs_center(volume)"], monthly(spark, sf_dir).select("*"))
    names = [c for c in got.columns if c not in ("ts", "instrument")]
    return rounded(long_form(got, names), "value")


QUERIES["sink_long_form"] = long_rows
ORACLE_SQL["sink_long_form"] = f"""
with {MONTHLY_SQL}, v as (select ts, instrument, close + open as a, volume - avg(volume) over (partition by ts) as b from panel)
select output, instrument, ts, round(value, 6) + 0.0 as value from (
  select 'f0_elem_add' as output, instrument, ts, a as value from v union all select 'f1_elem_add', instrument, ts, a from v union all select 'f2_cs_center', instrument, ts, b from v)
"""


def event_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five views against the last five purchases of each user, by position."""
    from ..operators.event_clock import evaluate_on_event_clocks

    e = _events(spark, sf_dir)
    one = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    views = P.from_table(one("view"), "bar", "user_id", "ts", close="value")
    bought = P.from_table(one("purchase"), "quote_tick", "user_id", "ts", bid_price="value")
    return rounded(evaluate_on_event_clocks("ts_corr(bar.close, quote_tick.bid_price, 5)", [views, bought]), "value")


QUERIES["source_event_clocks"] = event_clocks
ORACLE_SQL["source_event_clocks"] = """
with p as (select event_type, user_id as instrument, ts, max(value) as v from events where event_type in ('view', 'purchase') and user_id is not null and ts is not null group by 1, 2, 3),
l as (select event_type, instrument, ts, list(v) over (partition by event_type, instrument order by ts rows between 4 preceding and current row) as a from p),
m as (select instrument, ts, max(a) filter (event_type = 'view') as x, max(a) filter (event_type = 'purchase') as y from l group by 1, 2),
f as (select instrument, ts, last_value(x ignore nulls) over w as x, last_value(y ignore nulls) over w as y from m window w as (partition by instrument order by ts rows unbounded preceding)),
c as (select *, list_transform(x, lambda v: v - list_avg(x)) as dx, list_transform(y, lambda v: v - list_avg(y)) as dy from f),
s as (select *, list_sum(list_transform(dx, lambda v: v * v)) as xx, list_sum(list_transform(dy, lambda v: v * v)) as yy, list_sum(list_transform(dx, lambda v, k: v * dy[k])) as xy from c)
select epoch_us(ts) as ts, instrument, round(case when len(x) = 5 and len(y) = 5 and xx > 1e-12 and yy > 1e-12 then xy / sqrt(xx * yy) end, 6) + 0.0 as value from s
"""


def two_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Views as bars, purchases as quotes."""
    e = _events(spark, sf_dir)
    one = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return [P.from_table(one("view"), "bar", "user_id", "ts", close="value"), P.from_table(one("purchase"), "quote_tick", "user_id", "ts", bid_price="value")]


def clocks_in_a_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair window by position inside a larger expression, beside values as of each time."""
    from ..engine import evaluate_sources

    got = evaluate_sources(["ts_cov(bar.close, quote_tick.bid_price, 3) * 2 - bar.close"], two_sources(spark, sf_dir))
    return rounded(got.select("ts", "instrument", F.col(got.columns[-1]).alias("value")), "value")


QUERIES["source_event_clocks_in_a_plan"] = clocks_in_a_plan
ORACLE_SQL["source_event_clocks_in_a_plan"] = """
with p as (select event_type, user_id as instrument, ts, max(value) as v from events where event_type in ('view', 'purchase') and user_id is not null and ts is not null group by 1, 2, 3),
l as (select event_type, instrument, ts, v, list(v) over (partition by event_type, instrument order by ts rows between 2 preceding and current row) as a from p),
m as (select instrument, ts, max(a) filter (event_type = 'view') as x, max(a) filter (event_type = 'purchase') as y, max(v) filter (event_type = 'view') as c from l group by 1, 2),
f as (select instrument, ts, last_value(x ignore nulls) over w as x, last_value(y ignore nulls) over w as y, last_value(c ignore nulls) over w as c
      from m window w as (partition by instrument order by ts rows unbounded preceding)),
s as (select *, list_sum(list_transform(x, lambda v, k: (v - list_avg(x)) * (y[k] - list_avg(y)))) / 2 as cov from f)
select epoch_us(ts) as ts, instrument, round(case when len(x) = 3 and len(y) = 3 then cov * 2 - c end, 6) + 0.0 as value from s
"""


def group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups from another source, as of each half day: the parity of the user's last purchase, over all users' last views."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("instrument"), F.floor(F.col("ts") / 43_200_000_000).cast("long").alias("ts"), "event_type", "value")
    last = lambda kind: e.where(F.col("event_type") == kind).groupBy("instrument", "ts").agg(F.max("value").alias("value"))
    views = last("view").select("instrument", "ts", F.col("value").alias("bar__close"))
    groups = last("purchase").select("instrument", "ts", (F.floor("value") % 2).cast("double").alias("data__sector"))
    both = P.align([views, groups])
    panel = P.carry_forward(P.densify(both, both.select("instrument").distinct()))
    got = evaluate(["cs_neutralize(bar.close, group=data.sector)"], panel)
    return rounded(got.select("ts", "instrument", F.col(got.columns[-1]).alias("value")), "value")


QUERIES["source_group_lookup"] = group_lookup
ORACLE_SQL["source_group_lookup"] = """
with e as (select user_id as instrument, floor(epoch_us(ts) / 43200000000)::bigint as ts, event_type, value from events where user_id is not null and ts is not null and event_type in ('view', 'purchase')),
s as (select instrument, ts, max(value) filter (event_type = 'view') as c, floor(max(value) filter (event_type = 'purchase')) % 2 as g from e group by 1, 2),
grid as (select * from (select distinct ts from s), (select distinct instrument from s)),
f as (select grid.ts, grid.instrument, last_value(c ignore nulls) over w as c, last_value(g ignore nulls) over w as g from grid left join s on s.ts = grid.ts and s.instrument = grid.instrument
      window w as (partition by grid.instrument order by grid.ts rows unbounded preceding))
select ts, instrument, round(case when c is not null and g is not null then c - avg(c) over (partition by ts, g) end, 6) + 0.0 as value from f
"""
