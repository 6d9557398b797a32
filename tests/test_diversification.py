import math

import duckdb
import numpy as np

from tarnwise.operators.diversification import effective_bets, protect
from tarnwise.plans import catalog, folds
from tests.test_panel import SF, plain


def bets(spark, rows):
    return effective_bets(spark.createDataFrame(rows, "code_a string, code_b string, c double")).collect()


def test_bets_of_equal_independent_instruments_are_their_number(spark):
    (got,) = bets(spark, [(a, b, 4.0 if a == b else 0.0) for a in "xyz" for b in "xyz"])
    assert got.n == 3 and math.isclose(got.bets, 3) and got.mean_vol == 2


def test_bets_of_one_risk_and_of_nothing(spark):
    (one,) = bets(spark, [(a, b, 1.0) for a in "xy" for b in "xy"] + [(None, "x", 1.0)])
    (none,) = bets(spark, [("x", "x", None), ("x", "y", 0.0)])
    assert math.isclose(one.bets, 1, abs_tol=1e-6) and none.bets == 0 and none.n == 2
    assert bets(spark, []) == []


def test_bets_query_is_the_entropy_of_the_spectrum(spark):
    wide = catalog.queries()["returns_engine"](spark, SF).toPandas().pivot(index="dt", columns="code", values="r")
    n = wide.shape[1]
    cov = np.zeros((n, n))
    for i, a in enumerate(wide):
        for j, b in enumerate(wide):
            both = wide[a].notna() & wide[b].notna()
            x, y = wide[a][both].to_numpy(), wide[b][both].to_numpy()
            cov[i, j] = ((x - x.mean()) * (y - y.mean())).mean()
    share = np.clip(np.linalg.eigvalsh(cov), 0, None)
    share = share[share > 0] / share.sum()
    (got,) = folds.queries()["effective_number_of_bets"](spark, SF).collect()
    assert got.n == n and math.isclose(got.bets, np.exp(-(share * np.log(share)).sum()), rel_tol=1e-4)


def test_floor_follows_the_peak_and_is_never_broken_by_small_steps(spark):
    rows = [("a", f"2020-01-{d:02d}", r) for d, r in enumerate([0.5, 0.1, -0.02, None, -0.03, -0.01], 1)] + [(None, "2020-01-01", 0.1)]
    got = protect(spark.createDataFrame(rows, "run_id string, dt string, r double").selectExpr("run_id", "cast(dt as date) dt", "r")).orderBy("dt").collect()
    assert got[0].value == 1 and math.isclose(got[0].exposure, 0.3) and math.isclose(got[1].value, 1.03)
    assert all(r.value >= r.floor for r in got) and [r.floor for r in got] == sorted(r.floor for r in got) and len(got) == 6


def test_peak_floor_gives_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = folds.queries()["peak_floor"](spark, SF).toPandas(), con.sql(folds.oracle_sql()["peak_floor"]).df()
    assert plain(got) == plain(want) and len(got)
