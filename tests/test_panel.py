import duckdb
import pandas as pd
import pytest

from tarnwise.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["panel_densify", "schedule_weekly", "backtest_gross", "backtest_turnover", "metrics_by_run", "regime_report", "timing_luck", "fixture_yield_verdicts", "fixture_findings", "reconcile_strategy", "reconcile_data", "n_eff", "strategy_hysteresis", "broken_links", "count_claims"]


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6g}"
        return str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert plain(got) == plain(want) and len(got)


def test_double_cost_is_worse_by_cost_times_turnover(spark):
    rows = catalog.queries()["double_cost_gap"](spark, SF).collect()
    assert rows and all(abs(r.gap - r.expected) < 1e-7 for r in rows)


def test_weekly_schedule_holds_the_first_day_of_every_month(spark):
    weekly = {r.dt for r in catalog.queries()["schedule_weekly"](spark, SF).collect()}
    assert {r.dt for r in catalog.queries()["schedule_monthly"](spark, SF).where("off = 0").collect()} <= weekly


def test_targets_are_long_only_and_full(spark):
    rows = catalog.queries()["passive_targets"](spark, SF).toPandas()
    assert (rows.w > 0).all() and (abs(rows.groupby(["off", "decided"]).w.sum() - 1) < 1e-6).all()


def test_returns_begin_after_the_first_price(spark):
    first = {r.code: r.dt for r in catalog.queries()["panel_vwap"](spark, SF).groupBy("code").agg({"dt": "min"}).withColumnRenamed("min(dt)", "dt").collect()}
    assert all(r.dt > first[r.code] for r in catalog.queries()["returns_engine"](spark, SF).collect())
