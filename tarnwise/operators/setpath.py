"""Portfolio simulation as sets: without lag or breaker, the value between two rebalances is V(t) = 1 - sum(w) + sum(w G(t) / G(s)),
with G the growth of 1 in each instrument, so no day refers to the day before but through windows. What that can't say is
folded day by day in simulator.py.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(plan: DataFrame, targets: DataFrame, grown: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, off, dt, rebal, code, w, new, v, total): every instrument on every day of every run.

    w is the weight at the last decision before the day, v what it has become in units of the value then, total the value of the
    whole, and new the target where the day is a decision itself. plan: schedule.marked(). One window along instruments, one
    across them; no day looks anything up.
    """
    run = [*by, "off"]
    rows = grown.select(*by, "dt", "code", "g").join(plan, [*by, "dt"])
    rows = rows.join(targets.select(*run, F.col("decided").alias("dt"), "code", F.col("w").alias("new")), [*run, "dt", "code"], "left").withColumn("new", F.coalesce("new", F.lit(0.0)))
    before = Window.partitionBy(*run, "code").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("rebal"), F.struct(F.col("new").alias("w"), "g")), ignorenulls=True).over(before)
    rows = rows.withColumn("__l", last).withColumn("w", F.coalesce("__l.w", F.lit(0.0)))
    rows = rows.withColumn("v", F.coalesce(F.try_divide(F.col("w") * F.col("g"), F.col("__l.g")), F.lit(0.0)))
    day = Window.partitionBy(*run, "dt")
    return rows.select(*run, "dt", "rebal", "code", "w", "new", "v", (1 - F.sum("w").over(day) + F.sum("v").over(day)).alias("total"))


def value(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, off, dt, rebal, v, invested, turnover, gross) of held(): value since the last decision, the invested part of it before the day's trades, all weight that changes hands, and the day's gross return."""
    run = [*by, "off"]
    old = F.coalesce(F.try_divide("v", "total"), F.lit(0.0))
    moved = F.when(F.col("rebal"), F.abs(F.col("new") - old)).otherwise(0.0)
    sums = rows.groupBy(*run, "dt").agg(F.max("rebal").alias("rebal"), F.max("total").alias("v"), F.sum(old).alias("invested"), F.sum(moved).alias("turnover"))
    w = Window.partitionBy(*run).orderBy("dt")
    base = F.when(F.lag("rebal").over(w), 1.0).otherwise(F.lag("v").over(w))
    return sums.withColumn("gross", F.coalesce(F.try_divide(F.col("v"), base) - 1, F.lit(0.0)))


def trades(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, off, dt, code, new, old) of held(): weights after and before every decision; old ones have drifted."""
    old = F.coalesce(F.try_divide("v", "total"), F.lit(0.0))
    return rows.where("rebal").select(*by, "off", "dt", "code", "new", old.alias("old")).where("new > 0 or old > 0")


def net(worth: DataFrame, tiers: Sequence[tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, off, profile, dt, gross, turnover, net, invested, v): the cost tiers share one gross path."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(float(c)).alias("cost")) for p, c in tiers)))
    return worth.withColumn("__t", each).select(*by, "off", F.col("__t.profile").alias("profile"), "dt", "gross", "turnover", (F.col("gross") - F.col("__t.cost") * F.col("turnover")).alias("net"), "invested", "v")


def compounded(rows: DataFrame, keys: Sequence[str], x: Column, name: str) -> DataFrame:
    """rows with the running product of 1 + x by dt."""
    return rows.withColumn(name, F.product(1 + x).over(Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)))
