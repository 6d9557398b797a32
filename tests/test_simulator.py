import datetime as dt
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from tarnwise.operators.simulator import SETTINGS, Blend, fold, simulate, strategy_targets
from tarnwise.plans import catalog, folds
from tarnwise.sources import panel as files
from tarnwise.streaming.bars import daily_bars, read_events, write_bars
from tests.test_panel import SF, plain


def settings(**more) -> dict:
    return {k: v for k, (_, v) in SETTINGS.items()} | more


def by_hand(days, returns, priced, orders, run, shelter):
    """One day after the other, with dicts of the positions that are held."""
    held, opened, out = {}, {}, []
    level = peak = 1.0
    cool, pending = 0, None
    for i, day in enumerate(days):
        live = run["eval_start"] is None or day >= run["eval_start"]
        if live and run["eval_start"] is not None and (i == 0 or days[i - 1] < run["eval_start"]):
            level, peak, cool = 1.0, 1.0, 0
        if i == 0:
            out.append((0.0, 0.0, 0.0, 0))
            continue
        gain = sum(w * returns[i][c] for c, w in held.items())
        level *= 1 + gain
        peak = max(peak, level)
        drop = level / peak - 1
        held = {c: w * (1 + returns[i][c]) / (1 + gain) for c, w in held.items()}
        held = {c: w for c, w in held.items() if w > 1e-9}
        to, ordered = None, None
        after = dict(held)
        if pending and pending[0] <= i and not cool:
            after, pending = pending[1], None
        daily = live and run["daily_loss"] is not None and gain < -run["daily_loss"]
        hard = live and run["hard_dd"] is not None and drop < -run["hard_dd"]
        if cool or daily or hard:
            cool = cool - 1 if cool else run["daily_cool"] if daily else run["hard_cool"]
            after = ordered = {shelter: 1.0} if shelter is not None and priced[i][shelter] else {}
            pending = None
        elif i in orders:
            soft = live and run["soft_dd"] is not None and drop < -run["soft_dd"]
            ordered = to = {c: w * (run["soft_scale"] if soft else 1) for c, w in enumerate(orders[i]) if w > 0}
            after = to
            if run["lag"] > 0:
                after = {c: min(held[c], to[c]) for c in held if c in to}
                pending = (i + run["lag"], to)
        cost = turnover = 0.0
        early = 0
        for c in set(held) | set(ordered) if ordered is not None else ():
            a, b = held.get(c, 0.0), ordered.get(c, 0.0)
            turnover += abs(b - a)
            if b < a - 1e-9:
                soon = c in opened and day - opened[c] < run["min_hold"]
                early += soon
                cost += (a - b) * (run["penalty"] if soon else run["cost"])
                if b <= 1e-9:
                    opened.pop(c, None)
            elif b > a + 1e-9:
                cost += (b - a) * run["cost"]
                if a <= 1e-9:
                    opened[c] = day
        level *= 1 - cost
        held = after
        out.append((gain, cost, turnover, early))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_fold_gives_what_a_loop_over_positions_gives(seed):
    rnd = random.Random(seed)
    n, codes = 120, 4
    days = np.cumsum([rnd.choice([1, 1, 1, 3]) for _ in range(n)]) + 730000
    r = np.array([[rnd.gauss(0, 0.02) if rnd.random() > 0.1 else 0.0 for _ in range(codes)] for _ in range(n)])
    priced = np.array([[rnd.random() > 0.2 for _ in range(codes)] for _ in range(n)])
    orders = {}
    for i in range(1, n):
        if rnd.random() < 0.2:
            w = np.array([rnd.choice([0, rnd.random()]) for _ in range(codes)])
            orders[i] = w / max(w.sum(), 1)
    run = settings(
        lag=rnd.choice([0, 1, 4]), min_hold=rnd.choice([0, 20]), eval_start=rnd.choice([None, int(days[30])]), soft_dd=rnd.choice([None, 0.03]),
        hard_dd=rnd.choice([None, 0.08]), daily_loss=rnd.choice([None, 0.025]), daily_cool=rnd.choice([0, 3]),
    )
    shelter = rnd.choice([None, 2])
    got = [x[:4] for x in fold(days, r, priced, orders, run, shelter)]
    want = by_hand(days.tolist(), r, priced, orders, run, shelter)
    assert np.allclose(np.array(got, float), np.array(want, float), atol=1e-12)


@pytest.mark.parametrize("name", list(folds.oracle_sql()))
def test_folds_give_the_rows_of_the_set_form(spark, name):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = folds.queries()[name](spark, SF).toPandas(), con.sql(folds.oracle_sql()[name]).df()
    assert plain(got) == plain(want) and len(got)


def test_weights_settle_after_the_lag_and_cost_falls_on_the_order_day(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(6)]
    market = spark.createDataFrame([(d, "A", 100.0 * 1.1**k, None if k == 0 else 0.1) for k, d in enumerate(days)], "dt date, code string, close double, r double")
    schedule = spark.createDataFrame([("x", days[1])], "run_id string, dt date")
    targets = spark.createDataFrame([("x", days[1], "A", 2.0), ("x", days[1], "B", -1.0), ("x", days[1], None, None)], "run_id string, dt date, code string, w double").where("code is not null")
    runs = spark.createDataFrame([("x", 2)], "run_id string, lag int")
    rows = simulate(market, schedule, targets, runs).orderBy("dt").collect()
    assert [round(x.gross, 9) for x in rows] == [0, 0, 0, 0, 0.1, 0.1]
    assert [round(x.cost, 9) for x in rows] == [0, 0.0006, 0, 0, 0, 0]


def test_no_market_or_no_runs_give_no_rows(spark):
    market = spark.createDataFrame([], "dt date, code string, close double, r double")
    schedule = spark.createDataFrame([], "run_id string, dt date")
    targets = spark.createDataFrame([], "run_id string, dt date, code string, w double")
    assert simulate(market, schedule, targets, spark.createDataFrame([("x",)], "run_id string")).count() == 0


def test_strategies_see_only_days_before(spark):
    days = pd.bdate_range("2020-01-01", periods=40)
    panel = spark.createDataFrame([(d.date(), c, 100.0 + k) for k, d in enumerate(days) for c in "AB" if c == "A" or k > 25], "dt date, code string, close double")
    schedule = spark.createDataFrame([("x", d.date()) for d in days], "run_id string, dt date")

    class Spy(Blend):
        def target_weights(self, prices, asof):
            assert prices.index.max() < asof
            return super().target_weights(prices, asof)

    found = strategy_targets(panel, schedule, lambda run: Spy({"A": 0.4, "B": 0.4, "C": 0.2})).toPandas()
    assert len(found) == 20 and set(found.code) == {"A"} and (found.w == 1).all()


def test_wide_files_come_back_and_the_cutoff_holds(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,510300,B.x\n2022-12-30,1.5,\n2022-12-31,2,NaN\n2023-01-02,3,4\n")
    assert sorted(map(tuple, files.read_wide(spark, str(tmp_path / "p.csv")).select("code", "close").collect())) == [("510300", 1.5), ("510300", 2.0), ("510300", 3.0), ("B.x", 4.0)]
    cut = files.load_prices(spark, str(tmp_path / "p.csv"), "2022-12-31")
    assert cut.count() == 2 and str(cut.agg({"dt": "max"}).first()[0]) == "2022-12-31"
    files.write_wide(files.read_wide(spark, str(tmp_path / "p.csv")), str(tmp_path / "w.parquet"))
    assert files.read_wide(spark, str(tmp_path / "w.parquet")).count() == 4
    with pytest.raises(KeyError):
        files.load_benchmark(cut, "NOPE")
    with pytest.raises(ValueError):
        files.read_wide(spark, "x.xls")


def test_config_is_found_above_and_holdable_is_the_default(spark, tmp_path):
    (tmp_path / "config.yaml").write_text("research_end: 2022-12-31\nuniverse:\n- {code: 510300, limit_group: a}\n- {code: B, holdable: false}\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    config = files.load_config(files.find_config(tmp_path / "a" / "b"))
    assert {x.code: x.holdable for x in config.universe(spark).collect()} == {"510300": True, "B": False}
    assert files.unfilled({"a": ["TODO: x", "y", "not a TODO"], "b": {"c": "TODO"}, "d": [{"e": " TODO"}]}) == ["a[0]", "b.c", "d[0].e"]


def test_snapshots_are_appended_once(spark, tmp_path):
    new = spark.createDataFrame([("2024-01-02", "s0", 1.0), ("2024-02-01", "s0", 2.0)], "signal_date string, strategy string, capital double")
    assert [files.append_snapshots(spark, new, str(tmp_path / "t")) for _ in range(2)] == [2, 0]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_streamed_bars_are_the_batch_bars_of_days_that_are_over(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    write_bars(daily_bars(read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = {(x.code, x.dt): x for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(x.code, x.dt): x for x in daily_bars(events).collect()}
    assert got and all(want[k] == x for k, x in got.items()) and len(want) - len(got) <= 3 * len({k[0] for k in want})
