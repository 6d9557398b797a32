import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwise.operators import protocol, scores, series, strategies
from tarnwise.operators.protocol import Spec, walk_forward
from tarnwise.sinks import reports


def daily(spark, net, b=None, gross=None, turnover=0.0):
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(len(net))]
    rows = [("x", d, g, n, turnover, m) for d, n, g, m in zip(days, net, gross or net, b or [0.0] * len(net))]
    return spark.createDataFrame(rows, "run string, dt date, gross double, net double, turnover double, b double")


@pytest.fixture(scope="module")
def panel(spark):
    """Three instruments over four years; C has no price in its first year, and B's fall in the third."""
    rng, rows = np.random.default_rng(5), []
    price = {"A": 100.0, "B": 50.0, "C": 20.0}
    for k in range(4 * 365):
        day = dt.date(2018, 1, 1) + dt.timedelta(k)
        if day.weekday() > 4:
            continue
        for c in price:
            price[c] *= 1 + rng.normal(0.0004, 0.01)
            if c != "C" or k > 365:
                rows.append((day, c, price[c]))
    return spark.createDataFrame(rows, "dt date, code string, close double")


SPEC = Spec(benchmark="A", offsets=(0, 5), first_year=2020, last_year=2021, lookback=2, days=252, rf=0.01)


def test_scores_are_the_formulas(spark):
    rng = np.random.default_rng(7)
    x, b = rng.normal(0.0004, 0.01, 1000), rng.normal(0.0003, 0.01, 1000)
    got = scores.metrics(daily(spark, x.tolist(), b.tolist()), ["run"], 252, 0.04).first()
    e = np.cumprod(1 + x)
    down = (x - 0.04 / 252)[x < 0.04 / 252]
    want = {
        "annual": e[-1] ** (252 / 1000) - 1, "vol": x.std() * 252**0.5, "sharpe": (x.mean() * 252 - 0.04) / (x.std() * 252**0.5), "sharpe_no_rf": x.mean() * 252 / (x.std() * 252**0.5),
        "mdd": (e / np.maximum.accumulate(e) - 1).min(), "sortino": (x.mean() * 252 - 0.04) / (down.std() * 252**0.5), "ir": (x - b).mean() * 252 / ((x - b).std() * 252**0.5), "bench": np.prod(1 + b) ** (252 / 1000) - 1,
    }
    assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())
    assert math.isclose(got["sharpe_no_rf"] - got["sharpe"], 0.04 / got["vol"], rel_tol=1e-9) and math.isclose(got["excess"], got["annual"] - got["bench"])


def test_degenerate_paths(spark):
    lost = scores.metrics(daily(spark, [0.1, -1.0, 0.5]), ["run"]).first()
    assert lost.annual == -1 and lost.mdd == -1
    one = scores.metrics(daily(spark, [0.1]), ["run"]).first()
    assert one.n == 1 and one.annual is None
    flat = scores.metrics(daily(spark, [0.0] * 5), ["run"], 252, 0.0).first()
    assert flat.sharpe == flat.calmar == flat.sortino == flat.ir == 0
    assert scores.metrics(daily(spark, []), ["run"]).count() == 0
    short = scores.cumulative_only(scores.metrics(daily(spark, [0.01] * 10), ["run"])).first()
    assert not short.annualised and math.isclose(short.annual, 1.01**10 - 1, rel_tol=1e-9)


def test_first_days_loss_is_no_drawdown(spark):
    assert scores.metrics(daily(spark, [-0.5, 0.1, 0.1]), ["run"]).first().mdd == 0


def test_windows_start_from_cash_in_their_own_warm_up(spark, panel):
    e = walk_forward(panel, SPEC)
    first = e.view.groupBy("y").agg(F.min("dt").alias("a"), F.max("dt").alias("z")).orderBy("y").collect()
    assert [(r.y, r.a.year, r.z.year) for r in first] == [(2020, 2018, 2020), (2021, 2019, 2021)]
    assert e.decisions.join(e.view.groupBy("y").agg(F.min("dt").alias("a")), "y").where("dt <= a").count() == 0
    rows = e.windows.collect()
    assert {r.window_id for r in rows} == {f"W-{y}-{p}-off{o}" for y in (2020, 2021) for p in ("single", "double") for o in (0, 5)}
    by = {(r.y, r.off, r.profile): r for r in rows}
    assert all(by[y, o, "double"].annual < by[y, o, "single"].annual and by[y, o, "double"].before_cost == by[y, o, "single"].before_cost for y in (2020, 2021) for o in (0, 5))
    # a window is what its own slice of the panel gives, whatever else the panel holds
    alone = walk_forward(panel.where("year(dt) between 2018 and 2020"), replace(SPEC, last_year=2020)).windows.collect()
    assert all(math.isclose(r.annual, by[r.y, r.off, r.profile].annual, rel_tol=1e-12) for r in alone) and len(alone) == 4


def test_folds_and_sets_give_the_same_windows(spark, panel):
    e = walk_forward(panel, SPEC)
    folded = protocol.Evaluation(e.panel, replace(SPEC, min_hold=1, penalty=SPEC.cost))
    a, b = ({(r.y, r.off, r.profile, r.dt): (r.net, r.turnover) for r in x.daily.collect()} for x in (e, folded))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-10) for k in a)


def test_lag_costs_once_and_changes_the_path(spark, panel):
    got = {(r.experiment_id, r.profile): r for r in protocol.lag_sweep(panel, replace(SPEC, offsets=(0,)), (0, 3)).collect()}
    assert set(got) == {("s0_passive", "single"), ("s0_passive", "double"), ("s0_passive_lag3", "single"), ("s0_passive_lag3", "double")}
    assert got["s0_passive", "single"].mean_annual != got["s0_passive_lag3", "single"].mean_annual


def test_weekly_evaluation_says_what_it_did_not_check(spark, panel):
    e = walk_forward(panel, replace(SPEC, freq="weekly", first_year=2021))
    assert e.limitations().collect()[0].status == "NOT PERFORMED" and [r.off for r in e.windows.select("off").distinct().collect()] == [0]
    assert walk_forward(panel, SPEC).limitations().count() == 0


def test_what_cannot_be_evaluated_raises(spark, panel):
    with pytest.raises(KeyError):
        walk_forward(panel, replace(SPEC, benchmark="NOPE"))
    with pytest.raises(ValueError):
        walk_forward(panel, replace(SPEC, first_year=2030, last_year=2031))


@pytest.mark.parametrize("name", [n for n in strategies.names() if n != "never_rebalanced"])
def test_strategies_are_long_only_and_never_look_ahead(spark, panel, name):
    view = strategies.history(series.growth(series.dense(panel)), lookback=30)
    days = [dt.date(2019, 6, 3), dt.date(2020, 6, 1)]
    chosen = spark.createDataFrame([(0, d) for d in days], "off int, dt date")
    book = strategies.load(name)(view, chosen, lookback=30, top_n=2).toPandas()
    total = book.groupby("decided").w.sum()
    assert len(total) and (book.w > 0).all() and (total <= 1 + 1e-9).all()
    # prices from the decision's day on are of no matter
    bent = panel.withColumn("close", F.when(F.col("dt") >= F.lit(days[1]), F.col("close") * (1 + F.rand(1))).otherwise(F.col("close")))
    other = strategies.load(name)(strategies.history(series.growth(series.dense(bent)), lookback=30), chosen, lookback=30, top_n=2).toPandas()
    key = ["decided", "code"]
    assert np.allclose(book.sort_values(key).w, other.sort_values(key).w) and book.sort_values(key).code.tolist() == other.sort_values(key).code.tolist()


def test_equal_risk_contributions(spark, panel):
    view = strategies.history(series.growth(series.dense(panel)), lookback=60)
    chosen = spark.createDataFrame([(0, dt.date(2020, 6, 1))], "off int, dt date")
    w = {r.code: r.w for r in strategies.risk_parity(view, chosen).collect()}
    wide = view.where("dt < '2020-06-01'").toPandas().pivot(index="dt", columns="code", values="r").tail(60)
    x = np.array([w[c] for c in wide])
    share = x * (np.cov(wide.to_numpy().T, bias=True) @ x)
    assert np.allclose(share, share.mean(), rtol=1e-6) and math.isclose(x.sum(), 1)


def test_triggers_fire_and_stay_silent(spark):
    def flags(sharpe, excess, double, std, offsets=4):
        stable = spark.createDataFrame([("single", 0.1, sharpe, excess), ("double", double, sharpe, excess)], "profile string, mean_annual double, sharpe_mean double, mean_excess double")
        return {r.flag for r in protocol.triggers(stable, spark.createDataFrame([("single", offsets, std)], "profile string, offsets long, std_annual double")).collect()}

    assert flags(1.0, 0.01, 0.09, 0.005) == set()
    assert flags(1.6, 0.03, 0.1, 0.0) == {"high sharpe", "high excess", "identical tiers", "identical offsets"}
    assert flags(1.0, 0.0, 0.09, 0.0, 1) == set() and flags(1.0, 0.0, 0.09, 0.02) == {"offsets disagree"}


def test_ship_gate_needs_every_bar(spark):
    table = lambda a, d: spark.createDataFrame([("single", a, 1.0, -0.1, 0.8), ("double", d, 0.9, -0.1, 0.8)], "profile string, mean_annual double, sharpe_mean double, worst_drawdown double, positive double")
    luck = spark.createDataFrame([("single", 0.01)], "profile string, std_annual double")
    bar = {"mean_annual": 0.05, "worst_drawdown": -0.2}
    gate = lambda own: {r.gate: r.passed for r in protocol.ship_gate(own, table(0.05, 0.04), luck, bar).collect()}
    assert all(gate(table(0.1, 0.08)).values())
    weak = gate(table(0.055, 0.03))
    assert not weak["ship"] and not weak["edge exceeds offsets"] and not weak["mean_annual at double cost"] and weak["beats control"]


def test_config_says_the_spec():
    values = {
        "calendar": {"trading_days_per_year": 244}, "cost": {"one_way": 0.001, "min_hold_days": 7}, "rebalance": {"freq": "weekly", "offsets": [3], "top_n": 2, "trade_lag": 1}, "walk_forward": {"first_test_year": 2016},
        "benchmark": {"primary": "X", "passive_blend": [{"code": 1, "weight": 0.5}]}, "circuit_breaker": {"enabled": True, "hard_dd": 0.3, "daily_loss_cool": 9, "defensive_code": "B"},
    }
    s = Spec.from_config(values, tag="t")
    assert (s.days, s.cost, s.min_hold, s.freq, s.offsets, s.lag, s.first_year, s.benchmark) == (244, 0.001, 7, "weekly", (3,), 1, 2016, "X")
    assert s.settings == {"top_n": 2, "blend": {"1": 0.5}} and s.breaker == {"hard_dd": 0.3, "daily_cool": 9, "shelter": "B"} and s.experiment == "s0_passive_n2_wk_lag1_hold7_cb_t"


def test_artifacts_are_written(spark, panel, tmp_path):
    e = walk_forward(panel, replace(SPEC, offsets=(0,), first_year=2021))
    at = reports.write(e, f"file://{tmp_path}")
    assert spark.read.option("header", True).csv(at["window_reports"]).count() == 2
    assert spark.read.json(at["stability"] + "_double").count() == 1 and spark.read.json(at["regime"]).count() == 3
    assert spark.read.option("header", True).csv(at["window_daily"]).select("window_id").distinct().count() == 2
    assert {r.part for r in spark.read.json(at["block"]).select("part").distinct().collect()} >= {"1 windows", "2 stability", "3 regimes", "4 offsets", "5 context", "6 caveats"}
