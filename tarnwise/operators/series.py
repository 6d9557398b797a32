"""From a price panel (dt, code, close) to returns and growth. `by` names columns that keep panels apart, as the test year of a window does.

A step from a price of 0 is no number and so null, as any other that can't be computed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The days on which anything has a price, from one row for each panel; so they lie by panel, and windows over them need no shuffle."""
    return panel.where("close is not null and dt is not null").groupBy(*by).agg(F.collect_set("dt").alias("__d")).select(*by, F.explode("__d").alias("dt"))


def dense(panel: DataFrame, by: Sequence[str] = (), least: int = 0) -> DataFrame:
    """(by, dt, code, close) with a row for every day and instrument; no print is null. Panels of fewer than `least` days are left out.

    Days and instruments of a panel make one row (thousands of dates, and a name an instrument), which is spread out to the grid.
    Grid and prices meet by instrument in one shuffle, which the windows along an instrument go on with.
    """
    rows = panel.where("code is not null and dt is not null").select(*by, "code", "dt", "close")
    shape = rows.groupBy(*by).agg(F.collect_set(F.when(F.col("close").isNotNull(), F.col("dt"))).alias("__d"), F.collect_set("code").alias("__c")).where(F.size("__d") >= least)
    grid = shape.select(*by, F.explode("__c").alias("code"), "__d").select(*by, "code", F.explode("__d").alias("dt"), F.lit(None).cast("double").alias("close"), F.lit(True).alias("__g"))
    both = grid.unionByName(rows.withColumn("__g", F.lit(False))).repartition(*by, "code")
    met = both.groupBy(*by, "code", "dt").agg(F.max("close").alias("close"), F.max("__g").alias("__g"))
    return met.where("__g").drop("__g")


def along(by: Sequence[str] = ()) -> Window:
    return Window.partitionBy(*by, "code").orderBy("dt")


def growth(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """dense() with f (last price so far), r (return on it, null up to the first price), seen (prices before) and g (growth of 1)."""
    w = along(by)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    filled = days.withColumn("f", F.last("close", ignorenulls=True).over(upto))
    moved = filled.withColumn("r", F.try_divide("f", F.lag("f").over(w)) - 1).withColumn("seen", F.count("close").over(before))
    return moved.withColumn("g", F.product(1 + F.coalesce("r", F.lit(0.0))).over(upto))


def stepwise(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """dense() with the positional return r: null on a day without a print and on the day after."""
    return days.withColumn("r", F.try_divide("close", F.lag("close").over(along(by))) - 1)


def present(panel: DataFrame) -> DataFrame:
    """Rows with a price, with the one before (prev, prev_dt), the number of the row and the count of rows of the instrument."""
    w = along()
    rows = panel.where("close is not null")
    return rows.select("code", "dt", "close", F.lag("close").over(w).alias("prev"), F.lag("dt").over(w).alias("prev_dt"), F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("code")).alias("n"))


def windows(panel: DataFrame, first: int, last: int, lookback: int) -> DataFrame:
    """panel once for every test year `y` that a day is tested in or warms up for."""
    year = F.year("dt")
    rows = panel.where(F.col("close").isNotNull() & year.between(first - lookback, last)).withColumn("y", F.explode(F.sequence(year, year + lookback)))
    return rows.where(F.col("y").between(first, last))


def first_full_day(panel: DataFrame) -> DataFrame:
    """(dt): the first day on which every instrument has a price; null if there is none."""
    n = panel.where("close is not null").agg(F.count_distinct("code").alias("__n"))
    return panel.where("close is not null").groupBy("dt").count().crossJoin(F.broadcast(n)).where(F.col("count") == F.col("__n")).agg(F.min("dt").alias("dt"))


def annual(product: Column, n: Column, days: float) -> Column:
    """Geometric annualisation of n daily returns with the product `product`: 0 below two days, -1 when all is lost."""
    return F.when(n < 2, 0.0).when(product <= 0, -1.0).otherwise(F.pow(product, days / n) - 1)


def total_return(panel: DataFrame, payouts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(code, dt, close, tr): total-return prices that end on the last traded close.

    payouts (code, dt, cumulative): distributions per unit, added up over time, so each one is the difference to the one before.
    ratios (code, dt, ratio): declared re-denominations. On a payout's day the step is (close + payout) / close before; on a
    ratio's day it is multiplied by the ratio.
    """
    w = along()
    paid = payouts.select("code", "dt", F.coalesce(F.col("cumulative") - F.lag("cumulative").over(w), F.col("cumulative")).alias("paid"))
    rows = present(panel).join(paid, ["code", "dt"], "left").join(ratios.select("code", "dt", "ratio"), ["code", "dt"], "left")
    step = F.coalesce(F.try_divide(F.col("close") + F.coalesce("paid", F.lit(0.0)), F.col("prev")) * F.coalesce("ratio", F.lit(1.0)), F.lit(1.0))
    index = rows.withColumn("i", F.product(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return index.select("code", "dt", "close", (F.try_divide("i", F.last("i").over(whole)) * F.last("close").over(whole)).alias("tr"))


def assemble(parts: Sequence[DataFrame]) -> DataFrame:
    """One long panel of several sources' (dt, code, close): a day and instrument that more than one has comes from the first of them."""
    rows = None
    for k, part in enumerate(parts):
        part = part.select("dt", "code", "close", F.lit(k).alias("__k")).where("close is not null and not isnan(close)")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("dt", "code").agg(F.min_by("close", "__k").alias("close"))


def rescaled(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """adjusted (dt, code, close) scaled so that every instrument ends on its last raw price; without raw prices it stays as it is."""
    end = lambda df, name: df.where("close is not null").groupBy("code").agg(F.max_by("close", "dt").alias(name))
    scale = end(adjusted, "__a").join(end(raw, "__r"), "code", "left").select("code", F.coalesce(F.try_divide("__r", "__a"), F.lit(1.0)).alias("__s"))
    return adjusted.join(scale, "code").select("dt", "code", (F.col("close") * F.col("__s")).alias("close"))


def missing(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """(code): what the universe names and the panel has no price of."""
    return universe.select("code").join(panel.where("close is not null").select("code").distinct(), "code", "left_anti")
