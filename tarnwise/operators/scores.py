"""Scores of daily results. A row of `daily` is one day of one run: keys, dt, gross, net, turnover, b (the benchmark's return).

Degenerate cases: fewer than two days give no scores (nulls); a path that loses everything has -1 a year; a ratio whose
denominator is 0 is 0. The running peak starts at the first day's value, so a loss on day one is no drawdown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.operators.series import annual

STATES = ("bull", "bear", "sideways")


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def drops(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """daily with e, the growth of 1, and dd, how far it is below its peak so far."""
    upto = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    grown = daily.withColumn("e", F.product(1 + F.col("net")).over(upto))
    return grown.withColumn("dd", F.coalesce(F.try_divide(F.col("e"), F.max("e").over(upto)) - 1, F.lit(0.0)))


def metrics(daily: DataFrame, keys: Sequence[str], days: float = 252, rf: float = 0.04) -> DataFrame:
    """One row a run: n and the scores, from one aggregation over drops()."""
    each, year = rf / days, F.lit(float(days))
    below = F.when(F.col("net") < each, F.col("net") - each)
    got = drops(daily, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.product(1 + F.col(c)).alias(f"p_{c}") for c in ("net", "gross", "b")), F.avg("net").alias("m"), F.stddev_pop("net").alias("s"),
        F.min("dd").alias("mdd"), F.stddev_pop(below).alias("down"), F.count(below).alias("n_down"), (F.avg("turnover") * year).alias("turnover"),
        F.avg(F.col("net") - F.col("b")).alias("a"), F.stddev_pop(F.col("net") - F.col("b")).alias("te"),
    )
    # a spread of equal returns is 0, though its sum may be a little off
    some = lambda c: F.when(F.col(c) > 1e-15, F.col(c)).otherwise(0.0)
    root = F.sqrt(year)
    cols = {
        "annual": annual(F.col("p_net"), F.col("n"), days), "before_cost": annual(F.col("p_gross"), F.col("n"), days), "bench": annual(F.col("p_b"), F.col("n"), days),
        "vol": F.col("s") * root, "sharpe": ratio((F.col("m") - each) * year, some("s") * root), "sharpe_no_rf": ratio(F.col("m") * year, some("s") * root),
        "sortino": F.when(F.col("n_down") > 1, ratio((F.col("m") - each) * year, some("down") * root)).otherwise(0.0),
        "mdd": F.col("mdd"), "turnover": F.col("turnover"), "ir": ratio(F.col("a") * year, some("te") * root),
    }
    cols["excess"] = cols["annual"] - cols["bench"]
    cols["calmar"] = F.when(F.abs("mdd") > 1e-9, cols["annual"] / F.abs("mdd")).otherwise(0.0)
    return got.select(*keys, "n", *(F.when(F.col("n") >= 2, c).alias(k) for k, c in cols.items()))


def monthly_wins(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, win_rate): the share of months that end above where they began."""
    months = daily.groupBy(*keys, F.trunc("dt", "month").alias("__m")).agg(F.product(1 + F.col("net")).alias("__p"))
    return months.groupBy(*keys).agg(F.avg(F.when(F.col("__p") > 1, 1.0).otherwise(0.0)).alias("win_rate"))


def averages(prices: DataFrame, keys: Sequence[str], x: str = "f", short: int = 20, long: int = 60) -> DataFrame:
    """prices with the means a and b of the last `short` and `long` prices, null before there are as many."""
    w = Window.partitionBy(*keys).orderBy("dt")
    mean = lambda n: F.when(F.count(x).over(w.rowsBetween(1 - n, 0)) == n, F.avg(x).over(w.rowsBetween(1 - n, 0)))
    return prices.withColumn("a", mean(short)).withColumn("b", mean(long))


def regimes(prices: DataFrame, keys: Sequence[str], x: str = "f", buffer: float = 0.02) -> DataFrame:
    """(keys, dt, label): bull or bear where the short mean is `buffer` above or below the long one, else sideways, as while warming up."""
    lead = F.try_divide("a", "b") - 1
    label = F.when(lead > buffer, "bull").when(lead < -buffer, "bear").otherwise("sideways")
    return averages(prices, keys, x).select(*keys, "dt", label.alias("label"))


def regime_report(daily: DataFrame, days: float = 252, buffer: float = 0.02) -> DataFrame:
    """One row a state of the benchmark, over one stitched path (dt, net, turnover, b): annual, excess, turnover, after_cost, n_days.

    The states are read off the benchmark's own returns, compounded over the stitched days. Its first day has no return. States
    that don't occur are rows of zeros.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("dt")
    path = daily.withColumn("f", F.product(1 + F.col("b")).over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100)
    path = path.withColumn("__b", F.coalesce(F.try_divide("f", F.lag("f").over(w)) - 1, F.lit(0.0)))
    labels = regimes(path.select(F.lit(0).alias("__one"), "dt", "f"), ["__one"], "f", buffer).select("dt", "label")
    got = path.join(labels, "dt").groupBy("label").agg(F.count("*").alias("n"), F.product(1 + F.col("net")).alias("p"), F.product(1 + F.col("__b")).alias("q"), F.avg("turnover").alias("t"))
    states = daily.sparkSession.createDataFrame([(s,) for s in STATES], "label string")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    own, market = annual(F.col("p"), F.col("n"), days), annual(F.col("q"), F.col("n"), days)
    return states.join(got, "label", "left").select(
        "label", F.coalesce("n", F.lit(0)).cast("long").alias("n_days"), zero(F.when(F.col("n") > 0, own)).alias("annual"), zero(F.when(F.col("n") > 0, own - market)).alias("excess"),
        zero(F.col("t") * days).alias("turnover"), zero(F.when(F.col("n") > 0, own)).alias("after_cost"),
    )


def stability(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a decision is made on, over the windows of `keys`: means, spread, and how many windows stand behind them."""
    share = lambda c: F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0))
    return scores.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.avg("annual").alias("mean_annual"), F.median("annual").alias("median_annual"), F.stddev_pop("annual").alias("std_annual"), F.avg("excess").alias("mean_excess"),
        F.max("annual").alias("best"), F.min("annual").alias("worst"), share("annual").alias("positive"), share("excess").alias("beats"), share("annual").alias("after_cost_positive"),
        F.min("mdd").alias("worst_drawdown"), F.avg("sharpe").alias("sharpe_mean"), F.avg("calmar").alias("calmar_mean"), F.avg("turnover").alias("turnover_mean"),
    )


def timing_luck(scores: DataFrame, keys: Sequence[str], offset: str = "off") -> DataFrame:
    """The means of every offset, then their mean and spread: what the choice of the day alone makes."""
    each = scores.groupBy(*keys, offset).agg(*(F.avg(c).alias(c) for c in ("annual", "mdd", "sharpe")))
    return each.groupBy(*keys).agg(
        F.count("*").alias("offsets"), F.avg("annual").alias("mean_annual"), F.stddev_pop("annual").alias("std_annual"), F.min("annual").alias("min_annual"), F.max("annual").alias("max_annual"),
        F.avg("mdd").alias("mean_mdd"), F.min("mdd").alias("worst_mdd"), F.stddev_pop("mdd").alias("std_mdd"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"),
    )


def continuous(daily: DataFrame, keys: Sequence[str], days: float = 252) -> DataFrame:
    """(keys, n, mdd, annual) of the paths that all windows of a run make one after another."""
    path = drops(daily, keys)
    got = path.groupBy(*keys).agg(F.count("*").alias("n"), F.min("dd").alias("mdd"), F.max_by("e", "dt").alias("e"))
    return got.select(*keys, "n", "mdd", F.when(F.col("e") > 0, F.pow("e", days / F.col("n")) - 1).alias("annual"))


def worst_path(paths: DataFrame, keys: Sequence[str], offset: str = "off") -> DataFrame:
    """Of continuous() paths the one with the deepest drawdown; of equal ones that of the smallest offset."""
    at = F.struct("mdd", offset)
    return paths.groupBy(*keys).agg(*(F.min_by(c, at).alias(c) for c in (offset, "n", "mdd", "annual")))


def cumulative_only(scores: DataFrame, days: float = 252) -> DataFrame:
    """scores with (total, annualised): under a year nothing is annualised, and `annual` becomes the total."""
    total = F.pow(1 + F.col("annual"), F.col("n") / days) - 1
    whole = F.col("n") >= days
    return scores.withColumn("total", total).withColumn("annualised", whole).withColumn("annual", F.when(whole, F.col("annual")).otherwise(total))
