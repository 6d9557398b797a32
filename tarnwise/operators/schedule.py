"""Rebalance days, from the days of a calendar (by, dt)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def ranked(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """days with their month m, their place k in it, and its length n."""
    month = [*by, F.trunc("dt", "month")]
    return days.select(*by, "dt", F.trunc("dt", "month").alias("m"), F.row_number().over(Window.partitionBy(*month).orderBy("dt")).alias("k"), F.count("*").over(Window.partitionBy(*month)).alias("n"))


def monthly(days: DataFrame, offsets: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, off, dt): the (off + 1)-th trading day of every month, the last one in shorter months."""
    return marked(days, offsets, by, False).where("rebal").select(*by, "off", "dt")


def weekly(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, dt): the last trading day of every week and the first of every month."""
    return marked(days, None, by, False).where("rebal").select(*by, "dt")


def marked(days: DataFrame, offsets: Sequence[int] | None, by: Sequence[str] = (), later: bool = True, off: int = 0) -> DataFrame:
    """(by, off, dt, rebal): all days of every run, and whether it rebalances on them; without offsets weekly, as run `off`.

    later: nothing is known on the first day, so nothing is decided on it.
    """
    first = F.col("dt") > F.min("dt").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    known = first if later else F.lit(True)
    if offsets is None:
        edge = lambda unit, f: f("dt").over(Window.partitionBy(*by, F.trunc("dt", unit))) == F.col("dt")
        return days.select(*by, F.lit(off).alias("off"), "dt", (known & (edge("week", F.max) | edge("month", F.min))).alias("rebal"))
    rows = ranked(days, by).withColumn("__known", known).withColumn("off", F.explode(F.array(*map(F.lit, offsets))))
    return rows.select(*by, "off", "dt", (F.col("__known") & (F.col("k") == F.least(F.col("off") + 1, F.col("n")))).alias("rebal"))


def decisions(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, off, dt) of a marked() calendar."""
    return plan.where("rebal").select(*by, "off", "dt")


@udtf(returnType="y int, off int, profile string, warm_up date, test_start date, test_end date")
class WindowGrid:
    """SQL table function: a row for every test year, offset and cost tier.

    Register it as spark.udtf.register("window_grid", WindowGrid); then select * from window_grid(2015, 2024, 2, '0,5,10,15').
    """

    def eval(self, first: int, last: int, lookback: int, offsets: str) -> Iterator[tuple]:
        for y in range(first, last + 1):
            for off in offsets.split(","):
                for profile in ("single", "double"):
                    yield y, int(off), profile, dt.date(y - lookback, 1, 1), dt.date(y, 1, 1), dt.date(y, 12, 31)
