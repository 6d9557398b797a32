import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwise import cli
from tarnwise.operators import quality, series, tracking
from tarnwise.sources import panel as files
from tarnwise.sources import vendors
from tarnwise.streaming import bars

START, END = dt.date(2024, 1, 2), dt.date(2024, 6, 28)


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows, price = np.random.default_rng(42), [], dict.fromkeys(("AAA", "BBB", "CCC", "DDD"), 50.0)
    for k in range(400):
        day = dt.date(2023, 6, 1) + dt.timedelta(k)
        for c, drift in zip(price, (0.0006, -0.0004, 0.0002, -0.0001)):
            price[c] *= 1 + rng.normal(drift, 0.008)
            rows.append((day, c, price[c]))
    return spark.createDataFrame(rows, "dt date, code string, close double")


def book(spark, panel, capital, codes=("AAA", "BBB", "CCC", "DDD"), lot=100):
    wanted = spark.createDataFrame([(d, c, 0.25) for d in (START, END) for c in codes], "signal date, code string, w double")
    return tracking.orders(wanted, panel, capital, lot).withColumn("capital", F.lit(float(capital))).withColumn("cash", F.col("capital") - F.sum("amount").over(__import__("pyspark").sql.Window.partitionBy("signal")))


def layer(spark, panel, placed, alert=0.002):
    blend = spark.createDataFrame([(c, 0.25) for c in ("AAA", "BBB", "CCC", "DDD")], "code string, w double")
    return {r.signal: r for r in tracking.strategy_layer(placed, panel, blend, "AAA", alert=alert).collect()}


def test_large_capital_has_no_friction_and_small_has(spark, panel):
    gaps = [abs(layer(spark, panel, book(spark, panel, c))[START].gap) for c in (20_000, 1e7, 1e10)]
    assert gaps[2] < 2e-6 and gaps[0] > gaps[2]
    row = layer(spark, panel, book(spark, panel, 1e10))[START]
    price = {(r.code, r.dt): r.close for r in panel.where(F.col("dt").isin(START, END)).collect()}
    want = sum(0.25 * (price[c, END] / price[c, START] - 1) for c in ("AAA", "BBB", "CCC", "DDD")) - 0.0006
    assert math.isclose(row.backtest, want, abs_tol=1e-12) and math.isclose(row.blend, want, abs_tol=1e-12) and row.until == END and not row.open
    assert math.isclose(row.benchmark, price["AAA", END] / price["AAA", START] - 1 - 0.0006, abs_tol=1e-12)


def test_last_interval_is_open_and_missing_prices_are_null(spark, panel):
    got = layer(spark, panel, book(spark, panel, 100_000))
    assert got[END].open and got[END].until == dt.date(2024, 7, 4) and got[END].paper is not None
    # one instrument stops: the book is no book any more, and nothing is summed over the rest
    cut = panel.where("code <> 'DDD' or dt <= '2024-01-02'")
    gone = layer(spark, cut, book(spark, panel, 100_000))
    assert gone[START].paper is None and gone[START].backtest is None and gone[START].gap is None and not gone[START].alert and gone[START].benchmark is not None


def test_paper_identity(spark, panel):
    placed = book(spark, panel, 100_000, lot=1)
    got = layer(spark, panel, placed)[START].paper
    price = {(r.code, r.dt): r.close for r in panel.where(F.col("dt").isin(START, END)).collect()}
    units = {r.code: r.units for r in placed.where(F.col("signal") == F.lit(START)).collect()}
    start, end = (sum(u * price[c, d] for c, u in units.items()) for d in (START, END))
    assert math.isclose(got, (end + 100_000 - start - 0.0006 * start) / 100_000 - 1, abs_tol=1e-12)


def test_orders_take_the_last_close_and_unpriced_codes_raise(spark, panel):
    rows = tracking.orders(spark.createDataFrame([(END, "AAA", 0.5)], "signal date, code string, w double"), panel.where(F.col("dt") < F.lit(END)), 1000).collect()
    assert rows[0].stale and rows[0].units == math.floor(500 / rows[0].px)
    with pytest.raises(Exception, match="no price"):
        tracking.orders(spark.createDataFrame([(END, "NOPE", 0.5)], "signal date, code string, w double"), panel, 1000).collect()


def test_snapshot_sees_nothing_of_its_fill_day(spark, panel):
    seen = []

    def decide(history, asof):
        seen.append((history.agg(F.max("dt")).first()[0], asof))
        return history.select("code").distinct().withColumn("w", F.lit(0.25))

    got = tracking.snapshot(panel, decide, "s", 100_000).first()
    assert seen == [(dt.date(2024, 7, 3), dt.date(2024, 7, 4))] and got.signal_date == "2024-07-04" and got.decision_cutoff == "2024-07-03"
    assert math.isclose(got.invested + got.cash_residual, 100_000, abs_tol=0.02) and len(got.orders) == 4
    with pytest.raises(ValueError):
        tracking.snapshot(panel.where("dt = '2024-07-04'"), decide, "s")


def test_revised_and_missing_prices_are_named(spark, panel):
    placed = book(spark, panel, 100_000)
    assert tracking.data_layer(placed, panel).count() == 0
    bent = panel.withColumn("close", F.when(F.col("code") == "AAA", F.col("close") * 1.1).otherwise(F.col("close"))).where("code <> 'BBB'")
    assert {(r.code, r.status) for r in tracking.data_layer(placed, bent).collect()} == {("AAA", "CHANGED"), ("BBB", "MISSING")}
    assert {r.code for r in bars.revised(bent, placed).collect()} == {"AAA"}


def test_records_come_back_and_results_are_written_back(spark, panel, tmp_path):
    placed = book(spark, panel, 100_000)
    records = tracking.snapshots(placed, "s")
    records.write.json(str(tmp_path / "r"))
    flat = tracking.exploded(records)
    assert flat.count() == 8 and {r.units for r in flat.collect()} == {r.units for r in placed.collect()}
    blend = spark.createDataFrame([("AAA", 1.0)], "code string, w double")
    back = {r.signal_date: r for r in tracking.written_back(records, tracking.strategy_layer(flat, panel, blend, "AAA")).collect()}
    assert back["2024-01-02"].actual_return is not None and round(back["2024-01-02"].backtest_return, 6) == back["2024-01-02"].backtest_return
    (tmp_path / "track.json").write_text(json.dumps({"meta": {}, "records": [{"signal_date": "2024-01-02", "orders": [{"code": "A", "units": 1}]}]}))
    assert files.read_tracking(spark, str(tmp_path / "track.json")).first().orders[0].code == "A"


def test_registration_speaks_after_its_months(spark, panel):
    asks = spark.createDataFrame([(dt.date(2023, 6, 1),), (dt.date(2024, 6, 1),)], "oos_start date")
    assert [r.in_force for r in tracking.registration(asks, panel).orderBy("start").collect()] == [True, False]


def test_unknown_limit_group_raises(spark):
    u = spark.createDataFrame([("A", "x")], "code string, limit_group string")
    with pytest.raises(Exception, match="no such limit group"):
        quality.with_limits(u, {"none": None}).collect()


def test_repair_takes_whole_series_and_is_scanned_again(spark, panel):
    bad = panel.withColumn("close", F.when((F.col("code") == "AAA") & (F.col("dt") == F.lit(START)), F.col("close") * 2).otherwise(F.col("close")))
    allowed = spark.createDataFrame([(c, 0.2) for c in ("AAA", "BBB")], "code string, move double")
    assert [r.code for r in quality.price_limits(bad, allowed).collect()] == ["AAA"]
    fixed, log = quality.repair(bad, panel.where("code <> 'BBB' or dt > '2024-01-01'"), spark.createDataFrame([("AAA",), ("BBB",)], "code string"))
    assert {r.code: r.replaced for r in log.collect()} == {"AAA": True, "BBB": False}
    assert quality.price_limits(fixed, allowed).count() == 0 and fixed.count() == panel.count()


def test_two_chains_are_judged(spark, panel):
    other = panel.withColumn("close", F.when((F.col("code") == "AAA") & (F.col("dt") == F.lit(START)), F.col("close") * 1.08).when(F.col("code") == "BBB", F.col("close") * F.pow(F.lit(1.0008), F.datediff("dt", F.lit(START)))).otherwise(F.col("close")))
    got = {r.code: r.verdict for r in quality.adjudicate(panel, other, expected=spark.createDataFrame([("DDD",)], "code string")).collect()}
    assert got["BBB"] == "exclude" and got["CCC"] == "agree" and got["DDD"] == "flag" and got["AAA"] in ("repair", "agree")


def test_zero_prices_are_null_returns(spark):
    rows = [(dt.date(2020, 1, k), "A", p) for k, p in enumerate([1.0, 0.0, 2.0, None, 4.0], 1)] + [(dt.date(2020, 1, 4), "B", 1.0)]
    g = series.growth(series.dense(spark.createDataFrame(rows, "dt date, code string, close double"))).where("code = 'A'").orderBy("dt").collect()
    assert [r.r for r in g] == [None, -1.0, None, 0.0, 1.0]


def test_total_return_rebuild(spark):
    days = [dt.date(2020, 1, k) for k in range(1, 5)]
    panel = spark.createDataFrame([(d, "A", p) for d, p in zip(days, (10.0, 9.5, 19.0, 19.0))], "dt date, code string, close double")
    paid = spark.createDataFrame([("A", days[1], 0.5), ("A", days[3], 1.5)], "code string, dt date, cumulative double")
    ratio = spark.createDataFrame([("A", days[2], 0.5)], "code string, dt date, ratio double")
    got = [r.tr for r in series.total_return(panel, paid, ratio).orderBy("dt").collect()]
    steps = [1, 10 / 10, 19 / 9.5 * 0.5, 20 / 19]
    assert np.allclose(got, np.cumprod(steps) / np.prod(steps) * 19)


def test_vendor_pages_retries_and_cache(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(30)]
    for c in "AB":
        (tmp_path / f"{c}.csv").write_text("dt,close\n" + "\n".join(f"{d},{k + 1}" for k, d in enumerate(days)))
    rows = vendors.fetch(spark, ["A", "B"], path=str(tmp_path), page=7, start="2024-01-01", end="2024-01-30")
    assert rows.groupBy("code").count().where("count = 30").count() == 2
    again = vendors.cached(spark, ["A"], f"file://{tmp_path}/cache", path=str(tmp_path), start="2024-01-01", end="2024-01-30")
    assert again.count() == 30
    (tmp_path / "A.csv").unlink()
    assert vendors.cached(spark, ["A", "B"], f"file://{tmp_path}/cache", path=str(tmp_path), start="2024-01-01", end="2024-01-30").count() == 60
    waits, fails = [], iter([True, True, False])

    def ask():
        if next(fails):
            raise vendors.Unavailable("busy")
        return [1]

    assert vendors.patient(ask, 4, vendors.quadratic, waits.append) == [1] and waits == [2, 8]
    with pytest.raises(vendors.Unavailable):
        vendors.patient(lambda: [], 3, vendors.linear, waits.append)
    assert vendors.pages(days[0], days[9], 4) == [(days[0], days[3]), (days[4], days[7]), (days[8], days[9])]
    assert spark.range(1).select(vendors.prefixed(F.lit("510300"), {"5": "sh"}).alias("x")).first().x == "sh510300"


def test_command_line(spark, panel, tmp_path):
    config = {
        "research_end": "2024-07-04", "data": {"cache_dir": ".", "price_file": "p.parquet"}, "walk_forward": {"first_test_year": 2024, "last_test_year": 2024, "lookback_years": 1},
        "benchmark": {"primary": "AAA", "passive_blend": [{"code": c, "weight": 0.25} for c in ("AAA", "BBB", "CCC", "DDD")]}, "universe": [{"code": c, "limit_group": "none"} for c in ("AAA", "BBB", "CCC", "DDD")], "rebalance": {"offsets": [0]}, "qc": {"plausible_cagr": [-0.5, 0.5]},
    }
    (tmp_path / "c.json").write_text(json.dumps(config))
    files.write_wide(panel, str(tmp_path / "p.parquet"))
    (tmp_path / "r.json").write_text(json.dumps({"meta": {"true_oos_start": "2024-01-01", "prereg": {"min_months_before_judgement": 1}}}))
    base = ["--config", str(tmp_path / "c.json")]
    assert cli.main(["evaluate", *base, "--out", f"file://{tmp_path}/out"]) == 0
    assert cli.main(["check", *base, "--out", f"file://{tmp_path}/qc"]) == 0
    track = ["--registration", str(tmp_path / "r.json"), "--table", str(tmp_path / "t")]
    assert [cli.main(["snapshot", *base, *track]) for _ in range(2)] == [0, 1]
    assert cli.main(["reconcile", *base, *track]) == 0
    (tmp_path / "r.json").write_text(json.dumps({"meta": {"x": "TODO"}}))
    with pytest.raises(SystemExit):
        cli.main(["snapshot", *base, *track])


def test_breaker_state_goes_from_batch_to_batch(spark, tmp_path):
    rows = [("x", dt.date(2024, 1, k + 1), r) for k, r in enumerate([0.01, -0.05, 0.02, 0.03, 0.01, None])]
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], "run_id string, dt date, r double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, dt date, r double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = bars.breaker(stream, 0.04, 0.5, 2)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = [(round(r.r, 6), r.cooling) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("dt").collect()]
    assert got == [(0.01, 0), (-0.05, 2), (0.0, 1), (0.0, 0), (0.01, 0), (0.0, 0)]
