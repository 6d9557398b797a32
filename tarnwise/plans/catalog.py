"""Registered queries: operators over the test panel and over literal fixtures, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwise.functions import markdown
from tarnwise.operators import protocol, quality, research, schedule, scores, series, setpath, strategies, tracking
from tarnwise.plans import fixtures, folds
from tarnwise.plans.market import Market
from tarnwise.plans.relations import DAYS, OFFSETS, resolve
from tarnwise.streaming.bars import daily_bars

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents")
_QUERIES: dict[str, Callable[[Market], DataFrame]] = {}
_SQL: dict[str, str] = {}


def r(x: str, digits: int = 8) -> str:
    """A rounded double without a negative zero; a name stays its name."""
    name, _, alias = x.rpartition(" ") if " " in x else (x, "", x)
    return f"round({name}, {digits}) + 0.0e0 {alias}"


def rs(*xs: str, digits: int = 8) -> str:
    return ", ".join(r(x, digits) for x in xs)


def show(df: DataFrame, keys: str, *xs: str, digits: int = 8) -> DataFrame:
    """The columns `keys` (by spaces) as they are and xs rounded."""
    return df.select(*keys.split(), *((F.round(x, digits) + F.lit(0.0)).alias(x) for x in xs))


def query(name: str, sql: str | None, make: Callable[[Market], DataFrame]) -> None:
    _QUERIES[name] = make
    if sql is not None:
        _SQL[name] = sql


# sources and panel
query("panel_vwap", f"select code, dt, {r('close')} from panel", lambda m: show(m.panel, "code dt", "close"))
query("panel_cutoff", f"select code, dt, {r('close')} from panel where dt <= cast('2000-12-31' as date)", lambda m: show(m.research_panel, "code dt", "close"))
query("panel_densify", f"select code, dt, {r('close')} from dense", lambda m: show(m.dense, "code dt", "close"))
query("panel_ffill", f"select code, dt, {r('f')} from filled", lambda m: show(m.filled, "code dt", "f"))


def panel_wide(m: Market) -> DataFrame:
    """A column for every instrument of the panel, whatever there are."""
    codes = [x[0] for x in m.instruments.orderBy("code").collect()]
    wide = m.dense.groupBy("dt").pivot("code", codes).agg(F.first("close"))
    long = wide.unpivot(["dt"], [F.col(f"`{c}`") for c in codes], "code", "close")
    return long.groupBy("dt").agg(F.count("close").alias("n_priced"), F.round(F.sum("close"), 6).alias("total"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("close").isNotNull(), F.col("code")))), ",").alias("priced"))


query("panel_wide", "select dt, count(close) n_priced, round(sum(close), 6) total, string_agg(case when close is not null then code end, ',' order by code) priced from dense group by dt", panel_wide)
query("returns_engine", f"select code, dt, {r('r')} from returns where r is not null", lambda m: show(m.returns.where("r is not null"), "code dt", "r"))
query("returns_positional", f"select code, dt, {r('r')} from stepwise where r is not null", lambda m: show(m.stepwise.where("r is not null"), "code dt", "r"))
query("growth_index", f"select code, dt, {r('g')} from growth", lambda m: show(m.growth, "code dt", "g"))
query("coverage_first_full_date", "select min(dt) dt from (select dt from panel group by dt having count(*) = (select count(*) from instruments)) x", lambda m: series.first_full_day(m.panel))
query("panel_assembly", "select code, dt, round(close, 8) close from panel where month(dt) <> 2 union all select code, dt, round(close, 8) close from second where month(dt) = 2", lambda m: show(series.assemble([m.panel.where("month(dt) <> 2"), m.second.where("month(dt) = 2"), m.panel.where("month(dt) <> 2")]), "code dt", "close"))
query("panel_rescaled", "select a.code, a.dt, round(a.tr * e.last_close / z.tr, 6) + 0.0e0 as \"close\" from adjusted a join ends e on e.code = a.code join (select code, arg_max(tr, dt) tr from adjusted group by code) z on z.code = a.code", lambda m: show(series.rescaled(m.adjusted, m.panel), "code dt", "close", digits=6))
query("missing_instruments", "select code from f_universe where code not in (select code from f_raw)", lambda m: series.missing(fixtures.raw(m.spark), fixtures.universe(m.spark)))
# schedules
query("schedule_monthly", "select off, dt from monthly union all select 99 off, dt from ranked where k = least(100, n)", lambda m: m.monthly.unionByName(m.clamped))
query("schedule_weekly", "select dt from weekly", lambda m: m.weekly)
query("weekly_holds_month_starts", "select dt from monthly where off = 0 and dt not in (select dt from weekly)", lambda m: m.monthly.where("off = 0").select("dt").exceptAll(m.weekly))


def window_grid(m: Market) -> DataFrame:
    m.spark.udtf.register("window_grid", schedule.WindowGrid)
    return m.spark.sql(f"select * from window_grid({m.spec.first_year}, {m.spec.last_year}, {m.spec.lookback}, '{','.join(map(str, OFFSETS))}')")


query("window_grid", "select w.y, cast(o.off as int) off, p.profile, make_date(w.y - 2, 1, 1) warm_up, make_date(w.y, 1, 1) test_start, make_date(w.y, 12, 31) test_end from w_years w cross join offsets o cross join tiers p", window_grid)
# strategies and simulation
query("passive_targets", f"select off, decided, code, {r('w')} from targets", lambda m: show(m.targets, "off decided code", "w"))


def normalize_weights(m: Market) -> DataFrame:
    from tarnwise.operators.simulator import normalize

    raw = m.targets.where("off = 0").select(F.lit("x").alias("run_id"), F.col("decided").alias("dt"), "code", (F.col("w") * 3 - 0.4).alias("w"))
    return show(normalize(raw).withColumnRenamed("dt", "decided"), "decided code", "w")


query("normalize_weights", f"select decided, code, {r('w')} from (select decided, code, greatest(x, 0) / greatest(sum(greatest(x, 0)) over (partition by decided), 1) w from (select decided, code, w * 3 - 0.4e0 x from targets where off = 0) a) b where w > 0", normalize_weights)
query("transit_weights", "select off, dt, code, round(least(new, old), 8) + 0.0e0 w from trades where least(new, old) > 0", lambda m: show(m.trades.withColumn("w", F.least("new", "old")).where("w > 0"), "off dt code", "w"))
query("backtest_gross", f"select off, dt, {r('gross')} from gross", lambda m: show(m.gross, "off dt", "gross"))
query("backtest_turnover", f"select off, dt, {r('turnover')} from turnover", lambda m: show(m.turnover, "off dt", "turnover"))
query("backtest_net", f"select off, profile, dt, {r('net')} from net", lambda m: show(m.net, "off profile dt", "net"))
query("backtest_equity", f"select off, profile, dt, {r('equity', 6)} from equity", lambda m: show(m.equity, "off profile dt", "equity", digits=6))
query("backtest_holdings", "select off, dt, code, round(new, 8) + 0.0e0 w from trades where new > 0", lambda m: show(m.trades.where("new > 0").withColumnRenamed("new", "w"), "off dt code", "w"))


def double_cost_gap(m: Market) -> DataFrame:
    two = m.net.groupBy("off", "dt").pivot("profile", ["single", "double"]).agg(F.first("net").alias("net"), F.first("turnover").alias("t"))
    return show(two.groupBy("off").agg(F.sum(F.col("single_net") - F.col("double_net")).alias("gap"), (F.sum("single_t") * 0.0006).alias("expected")), "off", "gap", "expected")


query("double_cost_gap", "select a.off, round(sum(a.net - b.net), 8) + 0.0e0 gap, round(sum(a.turnover) * 0.0006e0, 8) + 0.0e0 expected from net a join net b on a.off = b.off and a.dt = b.dt where a.profile = 'single' and b.profile = 'double' group by a.off", double_cost_gap)
# metrics of walk-forward windows
COLS = ("annual", "before_cost", "bench", "vol", "sharpe", "sharpe_no_rf", "sortino", "mdd", "turnover", "ir", "excess", "calmar")
query("metrics_by_run", f"select off, profile, y, n, {rs(*COLS, digits=6)} from wide", lambda m: show(m.wide, "off profile y n", *COLS, digits=6))
HEAD = ("annual", "vol", "sharpe", "mdd", "turnover")
query("passive_scorecard", f"select y, n, {rs(*HEAD, digits=6)} from wide where off = 0 and profile = 'single'", lambda m: show(protocol.walk_forward(m.panel, replace(m.spec, offsets=(0,))).windows.where("profile = 'single'"), "y n", *HEAD, digits=6))
query("drawdown_path", f"select off, profile, y, dt, {r('dd')} from drops", lambda m: show(m.drops, "off profile y dt", "dd"))
query("monthly_win_rate", f"select off, profile, y, {r('win_rate')} from months", lambda m: show(m.months, "off profile y", "win_rate"))
query("regime_label", "select code, dt, label from regimes", lambda m: m.regimes)
REGIME = ("annual", "excess", "turnover", "after_cost")
query("regime_report", f"select label, n_days, {rs(*REGIME, digits=6)} from regime_report", lambda m: show(m.regime_report, "label n_days", *REGIME, digits=6))
# evaluation protocol
query("walk_forward_windows", "select off, y, profile, 'W-' || y || '-' || profile || '-off' || off window_id, min(dt) first_day, max(dt) last_day, count(*) n from tested group by off, y, profile", lambda m: m.tested.groupBy("off", "y", "profile").agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"), F.count("*").alias("n")).join(m.wide.select("off", "y", "profile", "window_id"), ["off", "y", "profile"]))
STAB = ("mean_annual", "median_annual", "std_annual", "mean_excess", "best", "worst", "positive", "beats", "after_cost_positive", "worst_drawdown", "sharpe_mean", "calmar_mean", "turnover_mean", "continuous_drawdown", "continuous_annual")
query("stability", f"select profile, windows, {rs(*STAB, digits=6)} from stability", lambda m: show(m.stability, "profile windows", *STAB, digits=6))
LUCK = ("mean_annual", "std_annual", "min_annual", "max_annual", "mean_mdd", "worst_mdd", "std_mdd", "mean_sharpe", "std_sharpe")
query("timing_luck", f"select profile, offsets, {rs(*LUCK, digits=6)} from luck", lambda m: show(m.luck, "profile offsets", *LUCK, digits=6))
query("continuous_path", f"select off, profile, n, {rs('mdd', 'annual', digits=6)} from paths", lambda m: show(m.paths, "off profile n", "mdd", "annual", digits=6))
query("worst_path", f"select profile, off, {rs('mdd', 'annual', digits=6)} from worst", lambda m: show(m.worst, "profile off", "mdd", "annual", digits=6))
query("scrutiny_triggers", "select * from (values ('high sharpe', 1.8e0), ('high excess', 0.05e0), ('identical offsets', 0.0e0), ('identical tiers', 0.0e0)) v(flag, \"value\")", lambda m: protocol.triggers(*fixtures.summaries(m.spark)))
query("scrutiny_of_the_control", "select flag, round(v, 6) + 0.0e0 as \"value\" from (select 'high sharpe' flag, sharpe_mean v from stability where profile = 'single' and sharpe_mean > 1.5 union all select 'high excess', mean_excess from stability where profile = 'single' and mean_excess > 0.02 union all select 'identical offsets', std_annual from luck where profile = 'single' and offsets > 1 and std_annual < 1e-9 union all select 'offsets disagree', std_annual from luck where profile = 'single' and std_annual > 0.01 union all select 'identical tiers', a.mean_annual - b.mean_annual from stability a join stability b on a.profile = 'single' and b.profile = 'double' where abs(a.mean_annual - b.mean_annual) < 1e-9) x", lambda m: show(protocol.triggers(m.stability, m.luck), "flag", "value", digits=6))
query("limitations", "select 'timing_luck' \"check\", 'NOT PERFORMED' status, 1 offsets", lambda m: (lambda e: e.limitations().select("check", "status").crossJoin(e.daily.agg(F.count_distinct("off").cast("int").alias("offsets"))))(protocol.walk_forward(m.panel, replace(m.spec, freq="weekly", first_year=m.spec.last_year))))
query("year_offset_pivot", "select y, " + ", ".join(f"round(avg(case when off = {o} then annual end), 6) + 0.0e0 off{o}" for o in OFFSETS) + " from wide where profile = 'single' group by y", lambda m: (lambda p: p.select("y", *((F.round(str(o), 6) + 0.0).alias(f"off{o}") for o in OFFSETS)))(m.wide.where("profile = 'single'").groupBy("y").pivot("off", list(OFFSETS)).agg(F.avg("annual"))))


def ship_gate(m: Market) -> DataFrame:
    """The control against itself: whatever the bar, it can't beat the control."""
    return protocol.ship_gate(m.stability, m.stability, m.luck, {"mean_annual": -0.5, "sharpe_mean": 5.0, "worst_drawdown": -0.9, "positive": 0.0})


query("ship_gate", """select g.gate, case g.gate when 'beats control' then false when 'beats control at double cost' then false when 'edge exceeds offsets' then false when 'ship' then false
    when 'mean_annual at double cost' then mean_annual >= -0.5 when 'sharpe_mean at double cost' then sharpe_mean >= 5 when 'worst_drawdown at double cost' then worst_drawdown >= -0.9 else positive >= 0 end passed
    from (select * from stability where profile = 'double') s cross join (values ('beats control'), ('beats control at double cost'), ('edge exceeds offsets'), ('mean_annual at double cost'), ('sharpe_mean at double cost'), ('worst_drawdown at double cost'), ('positive at double cost'), ('ship')) g(gate)""", ship_gate)
# data quality, on the panel
query("qc_implied_yield", "select f.code, count(*) + 1 n, round(power(product(case when abs(step - 1) > 0.25 then 1 else step end), 1 / max(s.yrs)) - 1, 6) + 0.0e0 implied, sum(case when abs(step - 1) > 0.25 then 1 else 0 end) undeclared_steps, case when sum(case when abs(step - 1) > 0.25 then 1 else 0 end) > 0 then 'undeclared' when power(product(case when abs(step - 1) > 0.25 then 1 else step end), 1 / max(s.yrs)) - 1 < -0.002 then 'negative' else 'no expectation' end verdict from factors f join spans s on s.code = f.code where step is not null group by f.code having count(*) >= 249", lambda m: show(quality.implied_yield(m.adjusted, m.panel, fixtures.declared(m.spark), fixtures.universe(m.spark)), "code n undeclared_steps verdict", "implied", digits=6))
query("qc_magnitude", "select code, round(power(last_close / first_close, 1 / yrs) - 1, 6) + 0.0e0 cagr, not power(last_close / first_close, 1 / yrs) - 1 between -0.1 and 0.35 bad from ends where n >= 250", lambda m: show(quality.magnitude(m.panel, fixtures.universe(m.spark)), "code bad", "cagr", digits=6))
query("qc_gaps", "select s.code, count(c.dt) span_days, max(s.n) n, (count(c.dt) - max(s.n)) / cast(count(c.dt) as double) > 0.02 bad from spans s join calendar c on c.dt >= s.a and c.dt <= s.z group by s.code", lambda m: quality.gaps(m.panel))
query("qc_generic", "select code, count(*) - count(distinct dt) duplicates, sum(case when close <= 0 then 1 else 0 end) non_positive from panel group by code", lambda m: quality.generic(m.panel))


def limits_of_all(m: Market) -> DataFrame:
    return m.instruments.select("code", F.lit(0.05).alias("move"))


query("qc_price_limits", "select code, sum(n) n, max(u) worst_up, min(d) worst_down, string_agg(y || ':' || n, ',' order by y) by_year from (select code, year(dt) y, count(*) n, round(max(r), 6) + 0.0e0 u, round(min(r), 6) + 0.0e0 d from stepwise where abs(r) > 0.05 + 0.005 group by code, year(dt)) x group by code", lambda m: show(quality.price_limits(m.panel, limits_of_all(m)).withColumn("by_year", F.array_join(F.transform(F.sort_array(F.map_entries("by_year")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")), "code n by_year", "worst_up", "worst_down", digits=6))
query("qc_price_limit_first_dates", "select code, dt from (select code, dt, row_number() over (partition by code order by dt) k from stepwise where abs(r) > 0.055) x where k <= 20", lambda m: quality.price_limits(m.panel, limits_of_all(m)).select("code", F.explode("first_days").alias("dt")))
query("qc_flat_runs", "select code, max(n) longest from (select code, run, count(*) n from (select code, dt, sum(case when close = prev then 0 else 1 end) over (partition by code order by dt rows between unbounded preceding and current row) run from present) x group by code, run) y group by code", lambda m: quality.flat_runs(m.panel))
query("qc_calendar_gaps", "select code, max(date_diff('day', prev_dt, dt)) longest from present where prev_dt is not null group by code", lambda m: quality.calendar_gaps(m.panel))
query("qc_adjustment_monotone", "select code, min(step) >= 0.995 ok, count(*) n from factors where step is not null and abs(step - 1) <= 0.25 group by code", lambda m: quality.adjustment(m.adjusted, m.panel).select("code", "ok", "n"))
query("qc_redenominations", "select code, dt, round(step, 6) + 0.0e0 step from factors where abs(step - 1) > 0.25", lambda m: show(quality.factors(m.adjusted, m.panel, fixtures.declared(m.spark)).where("kind = 'undeclared'"), "code dt", "step", digits=6))
query("qc_coverage", "select s.code, s.a first_day, s.z last_day, s.n from spans s", lambda m: quality.coverage(m.panel))
# data quality, on fixtures in which every verdict occurs
STEPS = "(select x.*, u.expect_yield, d.dt is not null said, product(case when d.dt is null and abs(step - 1) <= 0.25 then step else 1 end) over (partition by x.code) p from (select a.code, a.dt, (a.close / q.close) / lag(a.close / q.close) over (partition by a.code order by a.dt) step from f_adjusted a join f_raw q on q.code = a.code and q.dt = a.dt where q.close <> 0) x join f_universe u on u.code = x.code left join f_declared d on d.code = x.code and d.dt = x.dt where step is not null)"
query("fixture_yield_verdicts", f"select code, case when undeclared > 0 then 'undeclared' when implied < -0.002 then 'negative' when e is null then 'no expectation' when abs(implied - e) > 0.005 then 'off expectation' else 'ok' end verdict, declared declared_steps, undeclared undeclared_steps, round(implied, 6) + 0.0e0 implied from (select code, max(expect_yield) e, count(case when said then 1 end) declared, count(case when not said and abs(step - 1) > 0.25 then 1 end) undeclared, power(max(p), 365.25e0 / 599) - 1 implied from {STEPS} s group by code) z where code <> 'H'", lambda m: show(quality.implied_yield(fixtures.adjusted(m.spark), fixtures.raw(m.spark), fixtures.declared(m.spark), fixtures.universe(m.spark)).where("code <> 'H'"), "code verdict declared_steps undeclared_steps", "implied", digits=6))
query("fixture_magnitude", "select a.code, round(c, 6) + 0.0e0 cagr, not c between coalesce(low, -0.1) and coalesce(high, 0.35) bad from (select code, power(arg_max(close, dt) / arg_min(close, dt), 365.25e0 / 599) - 1 c from f_adjusted group by code) a join f_universe u on u.code = a.code", lambda m: show(quality.magnitude(fixtures.adjusted(m.spark), fixtures.universe(m.spark)), "code bad", "cagr", digits=6))
query("qc_split_jumps", "select code, dt, t target, round(q, 6) + 0.0e0 ratio from (select code, dt, close / nullif(lag(close) over (partition by code order by dt), 0) q from f_adjusted) x cross join (values (0.1e0), (0.25e0), (1 / 3.0e0), (0.5e0), (2.0e0), (3.0e0), (4.0e0), (10.0e0)) s(t) where abs(q - t) / t < 0.02", lambda m: show(quality.split_jumps(fixtures.adjusted(m.spark)), "code dt target", "ratio", digits=6))
query("fixture_price_limits", "select code, dt, round(r, 6) + 0.0e0 r from (select code, dt, close / nullif(lag(close) over (partition by code order by k), 0) - 1 r from f_raw) x join f_universe u using (code) where limit_group = 'ten' and abs(r) > 0.105", lambda m: show(quality.price_limits(fixtures.raw(m.spark), quality.with_limits(fixtures.universe(m.spark), fixtures.RULES)).select("code", F.explode("first_days").alias("dt")).join(series.stepwise(series.dense(fixtures.raw(m.spark))).select("code", "dt", "r"), ["code", "dt"]), "code dt", "r", digits=6))
query("fixture_anomalies", "select * from (values ('H', 'non-positive', 1), ('G', 'flat', 12), ('G', 'gap', 41)) v(code, problem, size)", lambda m: quality.anomalies(fixtures.raw(m.spark)).select("code", "problem", F.coalesce(F.get_json_object("payload", "$.longest"), F.get_json_object("payload", "$.non_positive")).cast("int").alias("size")))
query("fixture_findings", "select * from (values ('magnitude', 3), ('split', 2), ('gaps', 1), ('universe', 1), ('anomaly', 2), ('implied_yield', 3), ('price_limit', 2)) v(\"check\", n)", lambda m: quality.findings(fixtures.adjusted(m.spark), fixtures.raw(m.spark).select("dt", "code", "close"), fixtures.universe(m.spark), fixtures.declared(m.spark), rules=fixtures.RULES).where("code <> 'H' or check in ('anomaly', 'price_limit')").groupBy("check").count().withColumnRenamed("count", "n"))
query("qc_limitations", "select 'implied_yield' \"check\", 'PARTIAL' status, 'no expected yield for: F' reason union all select 'implied_yield', 'NOT PERFORMED', 'there are no unadjusted prices'", lambda m: quality.limitations(fixtures.adjusted(m.spark), fixtures.raw(m.spark), fixtures.universe(m.spark)).unionByName(quality.limitations(fixtures.adjusted(m.spark), None, fixtures.universe(m.spark))).select("check", "status", "reason"))


def rebuild(m: Market) -> DataFrame:
    """A payout of a hundredth of the price on every 90th day, published as the sum so far, and a re-denomination on the 400th."""
    rows = series.present(m.panel)
    paid = rows.where("k % 90 = 0").withColumn("cumulative", F.sum(F.col("close") * 0.01).over(series.along().rowsBetween(Window.unboundedPreceding, 0)))
    return show(series.total_return(m.panel, paid.select("code", "dt", "cumulative"), rows.where("k = 400").select("code", "dt", F.lit(2.0).alias("ratio"))), "code dt", "tr", digits=6)


query("total_return_rebuild", "select code, dt, round(i / max(case when k = n then i end) over (partition by code) * max(case when k = n then close end) over (partition by code), 6) + 0.0e0 tr from (select code, dt, close, k, n, product(coalesce((close + case when k % 90 = 0 then close * 0.01e0 else 0 end) / prev * case when k = 400 then 2 else 1 end, 1)) over (partition by code order by dt rows between unbounded preceding and current row) i from present) x", rebuild)


# tracking
def placed(m: Market) -> DataFrame:
    return tracking.orders(m.targets.where("off = 0").select(F.col("decided").alias("signal"), "code", "w"), m.panel, 100_000, 10)


query("snapshot_orders", f"select signal, code, stale, {rs('w', 'px', digits=6)}, cast(units as bigint) units from orders", lambda m: show(placed(m).withColumn("units", F.col("units").cast("long")), "signal code stale units", "w", "px", digits=6))
query("snapshot_cash", "select signal, round(100000 - sum(units * px), 4) + 0.0e0 cash, sum(case when units = 0 then 1 else 0 end) zero_orders, (100000 - sum(units * px)) / 100000 > 0.02 idle from orders group by signal", lambda m: show(tracking.warnings(placed(m)), "signal zero_orders idle", "cash", digits=4))
query("snapshot_records", "select strftime(signal, '%Y-%m-%d') signal_date, count(*) n, round(sum(round(units * px, 2)), 1) invested from orders group by signal", lambda m: tracking.exploded(tracking.snapshots(placed(m), "s0")).groupBy(F.date_format("signal", "yyyy-MM-dd").alias("signal_date")).agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("units") * F.col("px"), 2)), 1).alias("invested")))
query("reconcile_data", "select o.signal, o.code, case when p.close is null then 'MISSING' else 'CHANGED' end status from orders o left join revised p on p.code = o.code and p.dt = o.signal where p.close is null or abs(p.close / o.px - 1) > 0.001", lambda m: tracking.data_layer(placed(m), m.panel.where(~((F.col("code") == m.last_code) & (F.month("dt") == 7))).withColumn("close", F.col("close") * F.when((F.col("code") == m.first_code) & (F.month("dt") == 3), 1.1).otherwise(1.0))))
query("reconcile_execution", "select signal, round(max(abs(units * px / 100000 - w)), 8) + 0.0e0 max_drift, round(1 - sum(units * px) / 100000, 8) + 0.0e0 idle from orders group by signal", lambda m: show(tracking.execution_layer(placed(m), F.lit(100_000.0)), "signal", "max_drift", "idle"))


def reconcile_strategy(m: Market) -> DataFrame:
    book = placed(m)
    cash = book.groupBy("signal").agg((100_000 - F.sum("amount")).alias("cash"))
    rows = tracking.strategy_layer(stored_book(book.join(cash, "signal").withColumn("capital", F.lit(100_000.0))), m.panel, m.blend, m.first_code)
    return show(rows, "signal until open alert", "paper", "backtest", "gap", "blend", "benchmark")


def stored_book(df: DataFrame) -> DataFrame:
    from tarnwise.sources.store import stored

    return stored(df)


query("reconcile_strategy", "select h.signal, h.until, h.open, coalesce(abs(p.ret - x.backtest) > 0.002, false) alert, round(p.ret, 8) + 0.0e0 paper, round(x.backtest, 8) + 0.0e0 backtest, round(p.ret - x.backtest, 8) + 0.0e0 gap, round(x.blend, 8) + 0.0e0 blend, round(x.benchmark, 8) + 0.0e0 benchmark from holdings h left join paper p on p.signal = h.signal left join (select signal, max(case when book = 'backtest' then ret end) backtest, max(case when book = 'blend' then ret end) blend, max(case when book = 'benchmark' then ret end) benchmark from book_returns group by signal) x on x.signal = h.signal", reconcile_strategy)


def registration(m: Market) -> DataFrame:
    asks = m.spark.createDataFrame([("1995-06-01", 12.0), ("2001-10-01", 12.0)], "d string, minimum double").select(F.col("d").cast("date").alias("oos_start"), "minimum")
    return show(tracking.registration(asks, m.panel), "start latest in_force", "months", digits=6)


query("registration_evaluation", "select s.start, z.latest, date_diff('day', s.start, z.latest) / 30.4e0 >= 12 in_force, round(date_diff('day', s.start, z.latest) / 30.4e0, 6) \"months\" from (select cast('1995-06-01' as date) start union all select cast('2001-10-01' as date)) s cross join (select max(dt) latest from panel) z", registration)
# research
query("n_eff", "select cast(count(distinct code_a) as bigint) n, round(power(count(distinct code_a), 2) / sum(rho * rho), 6) + 0.0e0 n_eff from corrs", lambda m: show(research.effective_count(m.corrs), "n", "n_eff", digits=6))
query("pair_correlations", "select code_a, code_b, round(rho, 6) + 0.0e0 rho from corrs where code_a < code_b", lambda m: show(m.corrs.where("code_a < code_b"), "code_a code_b", "rho", digits=6))
query("exposure_corr", "select round(corr(a.net / a.invested, b.net / b.invested), 6) + 0.0e0 rho, count(*) n from net a join net b on a.dt = b.dt where a.off = 0 and b.off = 5 and a.profile = 'single' and b.profile = 'single' and a.invested > 1e-9 and b.invested > 1e-9", lambda m: show(research.exposure_corr(m.net, (F.col("off") == 0) & (F.col("profile") == "single"), (F.col("off") == 5) & (F.col("profile") == "single")), "n", "rho", digits=6))
query("drawdown_corr", "select a.y, round(corr(a.net, a.b), 6) + 0.0e0 rho, count(*) n from drops a where a.off = 0 and a.profile = 'single' and a.dd < 0 group by a.y", lambda m: show(research.drawdown_corr(m.drops.where("off = 0 and profile = 'single'"), ["y"]), "y n", "rho", digits=6))
query("asymmetry", "select y, round(regr_slope(case when b > 0 then net end, case when b > 0 then b end) - regr_slope(case when b < 0 then net end, case when b < 0 then b end), 6) + 0.0e0 asymmetry from tested where off = 0 and profile = 'single' group by y", lambda m: show(research.asymmetry(m.tested.where("off = 0 and profile = 'single'"), ["y"]), "y", "asymmetry", digits=6))
query("realization_rate", "select o.off, round(o.annual / i.annual, 6) + 0.0e0 rate from (select off, avg(annual) annual from wide where profile = 'single' and y >= 1999 group by off) o join (select off, avg(annual) annual from wide where profile = 'single' and y < 1999 group by off) i on i.off = o.off", lambda m: show(research.realization(m.wide.where("profile = 'single'"), ["off"], 1999), "off", "rate", digits=6))
query("diversification_ratio", "select round(avg(v) / max(pv), 6) + 0.0e0 ratio from (select code, stddev_pop(r) v from returns where r is not null group by code) a cross join (select stddev_pop(x) pv from (select dt, avg(r) x from returns where r is not null group by dt) b) c", lambda m: show(research.diversification(m.returns), "", "ratio", digits=6))
query("ic_tstat", "select count(*) n, round(avg(ic), 6) + 0.0e0 ic, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 5) + 0.0e0 t from ics where ic is not null and not isnan(ic)", lambda m: research.ic_tstat(m.ics).select("n", F.round("ic", 6).alias("ic"), F.round("t", 5).alias("t")))
query("exposure_profile", "select off, round(avg(invested), 6) + 0.0e0 avg_exposure, round(avg(case when invested < 1e-9 then 1.0e0 else 0 end), 6) + 0.0e0 share_zero, round(quantile_cont(invested, 0.1), 6) + 0.0e0 low, round(median(invested), 6) + 0.0e0 mid from gross group by off", lambda m: show(research.exposure(m.value, ["off"]), "off", "avg_exposure", "share_zero", "low", "mid", digits=6))
query("oos_spearman", "select round(corr(cast(a as double), cast(b as double)), 6) + 0.0e0 rho, count(*) n from (select off, rank() over (order by sum(case when y < 1999 then annual end)) a, rank() over (order by sum(case when y >= 1999 then annual end)) b from wide where profile = 'single' group by off) x", lambda m: show(research.spearman(m.wide.where("profile = 'single'").groupBy("off").agg(F.sum(F.when(F.col("y") < 1999, F.col("annual"))).alias("a"), F.sum(F.when(F.col("y") >= 1999, F.col("annual"))).alias("b")), "a", "b"), "n", "rho", digits=6))
query("plateau_delta", "select a.off, round(a.annual - avg(b.annual), 6) + 0.0e0 delta, count(b.annual) < 2 edge, case when count(b.annual) = 0 then null when a.annual - avg(b.annual) > 0.01 then 'spike' when max(b.annual) - a.annual > 0.01 then 'cliff' else 'plateau' end verdict from by_offset a left join by_offset b on a.profile = b.profile and abs(a.off - b.off) = 5 where a.profile = 'single' group by a.off, a.annual", lambda m: show(research.plateau(m.by_offset.where("profile = 'single'"), "off", 5), "off edge verdict", "delta", digits=6))
query("pareto_frontier", "select off, profile from by_offset a where not exists (select 1 from by_offset b where b.annual >= a.annual and b.mdd >= a.mdd and (b.annual > a.annual or b.mdd > a.mdd))", lambda m: research.pareto(m.by_offset, ["off", "profile"], ["annual", "mdd"]))
query("rolling_benchmark", "select round(min(x), 6) + 0.0e0 lo, round(quantile_cont(x, 0.25), 6) + 0.0e0 low, round(median(x), 6) + 0.0e0 mid, round(quantile_cont(x, 0.75), 6) + 0.0e0 high, round(max(x), 6) + 0.0e0 hi, count(*) n, round(avg(case when x < 0.05 then 1.0e0 else 0 end), 6) \"location\" from (select f / lag(f, 365) over (order by dt) - 1 x from filled where f is not null and code = (select min(code) from instruments)) z where x is not null", lambda m: show(research.rolling(m.benchmark, 365, 0.05), "n", "lo", "low", "mid", "high", "hi", "location", digits=6))
query("staggered_blend", "select profile, dt, round(avg(equity), 6) + 0.0e0 equity, round(stddev_pop(equity), 6) + 0.0e0 sigma from equity group by profile, dt", lambda m: show(research.staggered(m.equity, ["profile"]), "profile dt", "equity", "sigma", digits=6))
query("moving_average_gate", "select code, dt, f > b above from averages where b is not null", lambda m: m.averages.where("b is not null").select("code", "dt", (F.col("f") > F.col("b")).alias("above")))
def never_rebalanced(m: Market) -> DataFrame:
    first = strategies.never(m.grown, m.decisions.where("off = 0"))
    day = first.select(F.col("decided").alias("__day")).distinct()
    plan = m.plan.where("off = 0").join(F.broadcast(day), how="cross").withColumn("rebal", F.col("dt") == F.col("__day"))
    worth = setpath.value(setpath.held(plan.drop("__day"), first, m.grown)).crossJoin(F.broadcast(day))
    return show(worth.where("dt > __day"), "dt", "v", digits=6)


query("never_rebalanced", "select dt, round(sum(w), 6) + 0.0e0 v from (select g.dt, t.w * g.g / t.g w from targets t join growth g on g.code = t.code where t.off = 0 and t.decided = (select min(decided) from targets where off = 0) and g.dt > t.decided) x group by dt", never_rebalanced)
query("zero_return_floor", f"select code, round(avg(case when r = 0 then 1.0e0 else 0 end), 6) + 0.0e0 zero_share, avg(case when r = 0 then 1.0e0 else 0 end) > 0.2 stale, stddev_pop(r) * sqrt({DAYS}) < 0.02 too_quiet from (select code, close / prev - 1 r from present where prev is not null) x group by code", lambda m: show(quality.fake_volatility(m.panel, days=DAYS), "code stale too_quiet", "zero_share", digits=6))
query("year_by_year", "select code, y, round(product(1 + r) - 1, 6) + 0.0e0 total from (select code, year(dt) y, r from returns where r is not null) x group by code, y", lambda m: show(quality.year_totals(m.returns), "code y", "total", digits=6))
query("attribution", "select t.off, t.code, round(sum(t.w * (g.f / a.f - 1)), 6) + 0.0e0 contribution from targets t join (select off, decided, lead(decided) over (partition by off order by decided) until from (select distinct off, decided from targets) q) i on i.off = t.off and i.decided = t.decided join filled a on a.code = t.code and a.dt = t.decided join filled g on g.code = t.code and g.dt = i.until group by t.off, t.code", lambda m: show(research.attribution(m.targets, m.grown), "off code", "contribution", digits=6))
query("sharpe_standard_error", "select off, profile, round(1 / sqrt(count(*)), 6) + 0.0e0 se from wide group by off, profile", lambda m: show(m.wide.groupBy("off", "profile").agg((1 / F.sqrt(F.count("*"))).alias("se")), "off profile", "se", digits=6))
query("sensitivity_spread", "select 'off' dimension, round(max(a) - min(a), 6) + 0.0e0 spread from (select off, avg(annual) a from wide group by off) x union all select 'profile', round(max(a) - min(a), 6) + 0.0e0 from (select profile, avg(annual) a from wide group by profile) x union all select 'y', round(max(a) - min(a), 6) + 0.0e0 from (select y, avg(annual) a from wide group by y) x", lambda m: show(research.sensitivity(m.wide, ["off", "profile", "y"]), "dimension", "spread", digits=6))
query("profile_offset_rollup", "select profile, off, round(avg(annual), 6) + 0.0e0 annual from wide group by rollup(profile, off)", lambda m: show(m.wide.rollup("profile", "off").agg(F.avg("annual").alias("annual")), "profile off", "annual", digits=6))
query("chain_agreement", "select d.code, \"days\", round(rho, 6) + 0.0e0 rho, alone, round(worst_year, 6) + 0.0e0 worst_year, case when worst_year > 0.1 then 'exclude' when alone > 0 then 'repair' else 'agree' end verdict from (select code, count(*) \"days\", corr(a, b) rho, count(case when (abs(a) > 0.05 and abs(b) < 0.005) or (abs(b) > 0.05 and abs(a) < 0.005) then 1 end) alone from both group by code) d join (select code, max(d) worst_year from (select code, abs(product(1 + a) - product(1 + b)) d from both group by code, year(dt)) z group by code) y on y.code = d.code", lambda m: show(quality.adjudicate(m.panel, m.second), "code days alone verdict", "rho", "worst_year", digits=6))
_SQL["chain_agreement"] = _SQL["chain_agreement"].replace("from both", "from (select a.code, a.dt, a.r a, b.r b from (select code, dt, close / lag(close) over (partition by code order by dt) - 1 r from panel) a join (select code, dt, close / lag(close) over (partition by code order by dt) - 1 r from second) b on b.code = a.code and b.dt = a.dt where a.r is not null and b.r is not null) q")
query("increments_over_control", "select y, round(avg(case when off = 5 then annual end), 6) + 0.0e0 own, round(avg(case when off = 0 then annual end), 6) + 0.0e0 control, round(avg(case when off = 5 then annual end) - avg(case when off = 0 then annual end), 6) + 0.0e0 increment from wide where profile = 'single' group by y", lambda m: show(research.increments(m.wide.where("profile = 'single' and off = 5"), m.wide.where("profile = 'single' and off = 0")), "y", "own", "control", "increment", digits=6))


def segment_repair(m: Market) -> DataFrame:
    bad = m.panel.where("code = 'PROMO'")
    _, log = quality.repair(m.panel, m.second.where("code <> 'PROMO' or month(dt) > 3"), m.instruments)
    return log.crossJoin(bad.agg(F.count("*").alias("promo")))


query("segment_repair", "select p.code, p.n \"old\", coalesce(s.n, 0) \"new\", coalesce(s.n, 0) >= 0.9 * p.n replaced, (select count(*) from panel where code = 'PROMO') promo from (select code, count(*) n from panel group by code) p left join (select code, count(*) n from second where code <> 'PROMO' or month(dt) > 3 group by code) s on s.code = p.code", segment_repair)
query("cumulative_only", f"select off, y, n, n >= {DAYS} annualised, round(power(1 + annual, n / {DAYS}.0e0) - 1, 6) + 0.0e0 total, round(case when n >= {DAYS} then annual else power(1 + annual, n / {DAYS}.0e0) - 1 end, 6) + 0.0e0 annual from wide where profile = 'single'", lambda m: show(scores.cumulative_only(m.wide.where("profile = 'single'"), DAYS), "off y n annualised", "total", "annual", digits=6))
# strategies, as relations over the panel's decisions
VIEW = "(select code, dt, seen, lag(f) over (partition by code order by dt) p, lag(f) over (partition by code order by dt) / lag(f, 61) over (partition by code order by dt) - 1 move, stddev_pop(r) over (partition by code order by dt rows between 60 preceding and 1 preceding) vol, avg(f) over (partition by code order by dt rows between 60 preceding and 1 preceding) lev from returns)"
ASKED = f"(select s.off, s.dt decided, v.* from decisions s join {VIEW} v on v.dt = s.dt where v.seen >= 20)"


def chosen_by(name: str, **settings: object) -> Callable[[Market], DataFrame]:
    return lambda m: show(strategies.load(name)(strategies.history(m.grown), m.decisions, **settings), "off decided code", "w")


query("strategy_momentum", f"select off, decided, code, {r('w')} from (select *, 1.0e0 / count(*) over (partition by off, decided) w from (select *, row_number() over (partition by off, decided order by move desc, code) k from {ASKED} a where move is not null) x where k <= 2) y", chosen_by("momentum", top_n=2))
query("strategy_trend", f"select off, decided, code, {r('w')} from (select *, 1.0e0 / count(*) over (partition by off, decided) w from {ASKED} a where move is not null) x where move > 0", chosen_by("trend"))
query("strategy_reversion", f"select off, decided, code, {r('w')} from (select *, 1.0e0 / count(*) over (partition by off, decided) w from (select *, row_number() over (partition by off, decided order by p / lev, code) k from {ASKED} a where p is not null and lev is not null) x where k <= 2) y", chosen_by("reversion", top_n=2))
query("strategy_inverse_vol", f"select off, decided, code, {r('w')} from (select *, (1 / vol) / sum(1 / vol) over (partition by off, decided) w from {ASKED} a where vol > 0) x", chosen_by("inverse_vol"))
query("strategy_vol_target", f"select off, decided, code, {r('w')} from (select off, decided, code, w * least(1, 0.1e0 / (sum(w * vol) over (partition by off, decided) * sqrt({DAYS}))) w from (select *, (1 / vol) / sum(1 / vol) over (partition by off, decided) w from {ASKED} a where vol > 0) x) y", chosen_by("vol_target", target=0.1, days=DAYS))
query("strategy_average_gate", f"select off, decided, code, {r('w')} from (select *, 1.0e0 / count(*) over (partition by off, decided) w from {ASKED} a) x where p > lev", chosen_by("average_gate"))
query("strategy_hysteresis", f"select off, decided, code, {r('w')} from (select *, 1.0e0 / count(*) over (partition by off, decided) w, last_value(case when p / lev - 1 > 0.02 then true when p / lev - 1 < -0.02 then false end ignore nulls) over (partition by off, code order by decided rows between unbounded preceding and current row) inside from {ASKED} a) x where inside", chosen_by("hysteresis"))
query("strategy_blend_of_two", f"select off, decided, code, {r('w')} from (select off, decided, code, sum(w) w from (select off, decided, code, 0.5e0 / count(*) over (partition by off, decided) w from (select *, row_number() over (partition by off, decided order by move desc, code) k from {ASKED} a where move is not null) x where k <= 2 union all select off, decided, code, 0.5e0 * (1 / vol) / sum(1 / vol) over (partition by off, decided) w from {ASKED} a where vol > 0) y group by off, decided, code) z", chosen_by("blend_of_two", top_n=2))


def risk_parity(m: Market) -> DataFrame:
    return show(strategies.risk_parity(strategies.history(m.grown), m.decisions.where("off = 0")), "off decided code", "w")


query("strategy_risk_parity", None, risk_parity)
query("walk_forward_momentum", None, lambda m: show(protocol.walk_forward(m.panel, replace(m.spec, strategy="momentum", settings={"top_n": 2})).windows, "experiment_id window_id n", "annual", "excess", "mdd", digits=6))
query("lag_sweep", None, lambda m: show(protocol.lag_sweep(m.panel, replace(m.spec, offsets=(0,))), "experiment_id profile", "mean_annual", "turnover_mean", digits=6))
query("ablation", None, lambda m: show(protocol.ablation(m.panel, replace(m.spec, offsets=(0,), strategy="momentum", settings={"top_n": 2}, lag=1)), "layer profile", "contribution", digits=6))
query("random_control", None, lambda m: protocol.random_control(m.panel, replace(m.spec, offsets=(0,), strategy="momentum", settings={"top_n": 2}), 3, 1998))
query("report_block", None, lambda m: m.evaluation.block())
# batch twin of the streaming bars, and text checks
query("events_daily_bars", "select event_type code, cast(ts as date) dt, count(*) n, round(min(value), 6) lo, round(max(value), 6) hi, round(arg_min(value, (ts, value)), 6) first, round(arg_max(value, (ts, value)), 6) last from events group by event_type, cast(ts as date)", lambda m: show(daily_bars(m.table("events")), "code dt n", "lo", "hi", "first", "last", digits=6))


def docs_as_files(m: Market, table: str, key: str, body: str) -> DataFrame:
    return m.table(table).select(F.concat(F.lit(f"{table}/"), F.col(key).cast("string"), F.lit(".md")).alias("path"), F.col(body).alias("body"))


query("html_links", "select page_id, link, count(*) n from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) link from pages) x group by page_id, link", lambda m: m.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n")))
query("broken_links", "select * from (values ('a/one.md', 'two.md#Absent', 'anchor'), ('a/one.md', '../gone.md', 'file'), ('b.md', '#nope', 'anchor')) v(path, target, problem)", lambda m: markdown.broken_links(markdown.sample(m.spark)))
query("count_claims", "select * from (values ('b.md', 2, 7, 3)) v(path, line, claimed, actual)", lambda m: markdown.count_claims(markdown.sample(m.spark), "list.md", r"(?m)^- ", ["entries", "cases"]).select("path", "line", "claimed", "actual"))
query("document_sections", "select * from (values ('b.md', 'no front matter'), ('list.md', 'no name'), ('list.md', 'no section ## Use')) v(path, problem)", lambda m: markdown.structure(markdown.sample(m.spark), ["## Use"]).select("path", "problem"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(name: str) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _QUERIES[name](Market(spark, sf_dir))

        run.__name__ = name
        return run

    return {name: make(name) for name in _QUERIES} | folds.queries()


def oracle_sql() -> dict[str, str]:
    return {name: resolve(q) for name, q in _SQL.items()} | folds.oracle_sql()
