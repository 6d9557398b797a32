"""Registered queries that fold days: runs with lag, breaker and minimum holding, and Python strategies. Their SQL steps through the days by recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.operators import research
from tarnwise.operators.diversification import effective_bets, protect
from tarnwise.operators.simulator import Blend, simulate, strategy_targets
from tarnwise.plans.market import Market
from tarnwise.plans.relations import COST, OFFSETS, STRESS, resolve

#: Variants of one run: settlement lag, days that a position has to be held, and limits of a breaker.
LAG, HOLD, PENALTY = 2, 45, 0.015
BREAKER = {"soft_dd": 0.07, "soft_scale": 0.6, "hard_dd": 0.1, "hard_cool": 8, "daily_loss": 0.025, "daily_cool": 4}


def simulated(m: Market, settings: dict, tiers: tuple[tuple[str, float], ...] = (("single", float(COST)),)) -> DataFrame:
    """Daily results of every offset and cost tier with the given settings; run_id is offset and tier."""
    runs = m.spark.createDataFrame([(f"{o} {p}", o, c) for o in OFFSETS for p, c in tiers], "run_id string, off int, cost double")
    of = lambda df: F.broadcast(runs.select("run_id", "off")).join(df, "off")
    schedule = of(m.decisions).select("run_id", "dt")
    targets = of(m.targets).select("run_id", F.col("decided").alias("dt"), "code", "w")
    return simulate(m.grown.select("dt", "code", "close", "r"), schedule, targets, runs.select("run_id", "cost", *(F.lit(v).alias(k) for k, v in settings.items())))


def _daily(rows: DataFrame, *more: str) -> DataFrame:
    split = [F.split("run_id", " ")[0].cast("int").alias("off"), F.split("run_id", " ")[1].alias("profile")]
    return rows.select(*split, "dt", *((F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("gross", "net", "turnover")), *more)


def backtest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day loop without lag or breaker, all offsets and both cost tiers: the same numbers as the set form."""
    return _daily(simulated(Market(spark, sf_dir), {}, tiers=(("single", float(COST)), ("double", float(COST) * STRESS))))


def backtest_trade_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders settle two trading days later."""
    return _daily(simulated(Market(spark, sf_dir), {"lag": LAG}))


def backtest_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft and hard drawdown and daily loss limits, into cash."""
    return _daily(simulated(Market(spark, sf_dir), BREAKER), "cooling")


def backtest_min_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales within 45 days of a position's opening pay the penalty rate."""
    return _daily(simulated(Market(spark, sf_dir), {"min_hold": HOLD, "penalty": PENALTY}), "violations")


def strategy_python_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the passive control as a Python strategy: equal weights over the members with 20 prices before the day."""
    m = Market(spark, sf_dir)
    found = strategy_targets(m.panel, m.decisions.select(F.col("off").cast("string").alias("run_id"), "dt"), lambda run_id: Blend())
    return found.select(F.col("run_id").cast("int").alias("off"), F.col("dt").alias("decided"), "code", (F.round("w", 8) + F.lit(0.0)).alias("w"))


def effective_number_of_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent bets among all instruments, from the covariances of their daily returns."""
    pairs = research.correlations(Market(spark, sf_dir).grown, F.covar_pop, "c")
    return effective_bets(pairs).select("n", F.round("bets", 6).alias("bets"), F.round("mean_vol", 8).alias("mean_vol"))


def peak_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passive control of every offset behind a floor of 90 % of its peak, exposed three times the cushion."""
    path = Market(spark, sf_dir).net.where("profile = 'single'").select(F.col("off").cast("string").alias("run_id"), "dt", F.col("net").alias("r"))
    return protect(path).select(F.col("run_id").cast("int").alias("off"), "dt", *(F.round(c, 6).alias(c) for c in ("value", "floor", "exposure")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (backtest_fold, backtest_trade_lag, backtest_circuit_breaker, backtest_min_hold, strategy_python_blend, effective_number_of_bets, peak_floor)}


def each(x: str) -> str:
    """A list of x over all instruments j."""
    return f"list_transform(range(1, len(w) + 1), lambda j: {x})"


#: Days of every run with the returns of all instruments, and the target where it is a rebalance day, as lists in the order of codes.
ARRAYS = """, wanted as materialized (select s.off, s.dt, list(coalesce(t.w, 0.0e0) order by i.code) t from decisions s cross join instruments i left join targets t on t.off = s.off and t.decided = s.dt and t.code = i.code group by s.off, s.dt),
    moves_of as materialized (select dt, list(coalesce(r, 0.0e0) order by code) r from returns group by dt),
    arr as materialized (select o.off, d.dt, d.r, b.t, row_number() over (partition by o.off order by d.dt) k, date_diff('day', cast('1990-01-01' as date), d.dt) dayno from moves_of d cross join offsets o left join wanted b on b.off = o.off and b.dt = d.dt)"""
#: The part of a day that all variants share: gain on yesterday's weights (w), and the weights that it leaves (d).
DRIFT = f"select *, {each('case when w[j] * (1 + r[j]) / (1 + g) > 1e-9 then w[j] * (1 + r[j]) / (1 + g) else 0 end')} d from (select *, list_sum({each('w[j] * r[j]')}) g from"


def stepped(first: str, state: str, day: str) -> str:
    """Recursion over arr: `first` are the extra state columns on day one, `state` their names, `day` the rows of the next day from those of DRIFT."""
    none = "list_transform(r, lambda x: 0.0e0)"
    names = f"off, dt, k, w, gross, cost, turnover{state}"
    inner = f"{DRIFT} (select a.*, s.* exclude (off, dt, k, gross, cost, turnover) from walk s join arr a on a.off = s.off and a.k = s.k + 1) q) p"
    return f"{ARRAYS}, walk as (select off, dt, k, {none} w, 0.0e0 gross, 0.0e0 cost, 0.0e0 turnover{first} from arr where k = 1 union all select {names} from ({day.format(inner=inner)}) z)"


def oracle_sql() -> dict[str, str]:
    """The set form says the same as the plain fold and the Python strategy; recursion says the same as the others."""
    plain = "select off, profile, dt, round(gross, 8) + 0.0e0 gross, round(net, 8) + 0.0e0 net, round(turnover, 8) + 0.0e0 turnover from net"
    blend = "select off, decided, code, round(w, 8) + 0.0e0 w from targets"
    exposed = "case when v > 0 then least(1, greatest(0, 3 * (v - fl) / v)) else 0 end"
    floor = f""", path as materialized (select off, dt, net r, row_number() over (partition by off order by dt) k from net where profile = 'single'),
        walk as (select off, dt, k, 1.0e0 v, 0.9e0 fl from path where k = 1
        union all select off, dt, k, v, greatest(fl, 0.9e0 * v) from (select d.off, d.dt, d.k, s.v * (1 + {exposed} * d.r) v, s.fl from walk s join path d on d.off = s.off and d.k = s.k + 1) x)
        select off, dt, round(v, 6) "value", round(fl, 6) floor, round({exposed}, 6) exposure from walk"""
    out = "select off, 'single' profile, dt, round(gross, 8) + 0.0e0 gross, round(gross - cost, 8) + 0.0e0 net, round(turnover, 8) + 0.0e0 turnover"
    paid = f"coalesce(list_sum({each(f'case when abs(x[j] - d[j]) > 1e-9 then {COST} * abs(x[j] - d[j]) else 0 end')}), 0)"
    turned = f"coalesce(list_sum({each('abs(x[j] - d[j])')}), 0)"
    lag = f"""select off, dt, k, case when t is not null then {each('least(d[j], t[j])')} when due <= k then pend else d end w, g gross, {paid} cost, {turned} turnover,
        case when t is not null then t when due <= k then null else pend end pend, case when t is not null then k + {LAG} when due <= k then null else due end due from (select *, t x from ({{inner}}) u) y"""
    b = BREAKER
    hit = f"(cooling > 0 or g < -{b['daily_loss']} or level2 / peak2 - 1 < -{b['hard_dd']})"
    aim = f"case when {hit} then {each('0.0e0')} when t is not null then {each('t[j] * case when level2 / peak2 - 1 < -%s then %s else 1 end' % (b['soft_dd'], b['soft_scale']))} end"
    breaker = f"""select off, dt, k, coalesce(x, d) w, g gross, {paid} cost, {turned} turnover, level2 * (1 - {paid}) level, peak2 peak, case when cooling > 0 then cooling - 1 when g < -{b['daily_loss']} then {b['daily_cool']} when {hit} then {b['hard_cool']} else 0 end cooling
        from (select *, {aim} x from (select *, level * (1 + g) level2, greatest(peak, level * (1 + g)) peak2 from ({{inner}}) u) y) v"""
    early = f"x[j] < d[j] - 1e-9 and opened[j] is not null and dayno - opened[j] < {HOLD}"
    hold = f"""select off, dt, k, coalesce(x, d) w, g gross, coalesce(list_sum({each(f'case when {early} then {PENALTY} * (d[j] - x[j]) when abs(x[j] - d[j]) > 1e-9 then {COST} * abs(x[j] - d[j]) else 0 end')}), 0) cost, {turned} turnover,
        coalesce(list_sum({each(f'case when {early} then 1 else 0 end')}), 0) violations, case when x is null then opened else {each('case when x[j] < d[j] - 1e-9 and x[j] <= 1e-9 then null when x[j] > d[j] + 1e-9 and d[j] <= 1e-9 then dayno else opened[j] end')} end opened from (select *, t x from ({{inner}}) u) y"""
    lagged = stepped(", cast(null as double[]) pend, cast(null as bigint) due", ", pend, due", lag) + out + " from walk"
    broken = stepped(", 1.0e0 level, 1.0e0 peak, 0 cooling", ", level, peak, cooling", breaker) + out + ", cast(cooling as int) cooling from walk"
    keeping = stepped(", 0 violations, list_transform(r, lambda x: cast(null as bigint)) opened", ", violations, opened", hold) + out + ", cast(violations as bigint) violations from walk"
    asks = {"backtest_trade_lag": lagged, "backtest_circuit_breaker": broken, "backtest_min_hold": keeping, "peak_floor": floor}
    return {"backtest_fold": resolve(plain), "strategy_python_blend": resolve(blend)} | {n: resolve(q, recursive=True) for n, q in asks.items()}
