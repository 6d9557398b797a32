"""The test panel as relations: what the registered queries read, built from the operators. A relation is built when a query names it.

The panel has an instrument for each part type and its price is a volume-weighted mean of sales. It is written once for a
query, instruments x days; everything else derives from it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwise.operators import research, schedule, scores, series, setpath
from tarnwise.operators.protocol import Evaluation, Spec, walk_forward
from tarnwise.operators.strategies import passive
from tarnwise.plans.relations import COST, CUTOFF, DAYS, FIRST_YEAR, LAST_YEAR, LOOKBACK, OFFSETS, RF, STRESS
from tarnwise.sources.store import stored

SPAN = 20


def sales_panel(spark: SparkSession, sf_dir: str, price: str = "l_extendedprice") -> DataFrame:
    """(code, dt, close): mean price of a part type over its last SPAN days of sales; sums are decimals, so their order is of no matter."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_quantity", F.expr(price).alias("x"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("code"))
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    by_code = item.join(part, "l_partkey").groupBy("code", F.col("l_shipdate").cast("date").alias("dt")).agg(money("x").alias("x"), money("l_quantity").alias("q"))
    w = series.along()
    last = w.rowsBetween(1 - SPAN, 0)
    rows = by_code.select("code", "dt", (F.sum("x").over(last).cast("double") / F.sum("q").over(last).cast("double")).alias("close"), F.row_number().over(w).alias("k"))
    return rows.where(F.col("k") >= SPAN).select("code", "dt", "close")


class Market:
    """Relations over the test panel, by the names that queries use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def panel(self) -> DataFrame:
        return stored(sales_panel(self.spark, self.sf_dir))

    @cached_property
    def research_panel(self) -> DataFrame:
        return self.panel.where(F.col("dt") <= F.lit(CUTOFF).cast("date"))

    @cached_property
    def grown(self) -> DataFrame:
        return stored(series.growth(series.dense(self.panel)))

    dense = property(lambda self: series.dense(self.panel))
    filled = returns = growth = property(lambda self: self.grown)
    stepwise = property(lambda self: series.stepwise(series.dense(self.panel)))
    present = property(lambda self: series.present(self.panel))
    calendar = property(lambda self: series.calendar(self.panel))
    instruments = property(lambda self: self.panel.select("code").distinct())
    monthly = property(lambda self: schedule.monthly(self.calendar, OFFSETS))
    clamped = property(lambda self: schedule.monthly(self.calendar, (99,)))
    weekly = property(lambda self: schedule.weekly(self.calendar))
    plan = property(lambda self: schedule.marked(self.calendar, OFFSETS))
    decisions = property(lambda self: schedule.decisions(self.plan))
    targets = property(lambda self: passive(self.grown, self.decisions))
    held = property(lambda self: setpath.held(self.plan, self.targets, self.grown))
    trades = property(lambda self: setpath.trades(self.held))
    value = property(lambda self: setpath.value(self.held))
    turnover = property(lambda self: self.value.where("turnover > 0").select("off", "dt", "turnover"))
    gross = property(lambda self: self.value.select("off", "dt", "gross"))
    net = property(lambda self: setpath.net(self.value, (("single", float(COST)), ("double", float(COST) * STRESS))))
    equity = property(lambda self: setpath.compounded(self.net, ["off", "profile"], F.col("net"), "equity"))

    @cached_property
    def spec(self) -> Spec:
        return Spec(benchmark=self.first_code, offsets=OFFSETS, first_year=FIRST_YEAR, last_year=LAST_YEAR, lookback=LOOKBACK, cost=float(COST), stress=STRESS, days=DAYS, rf=float(RF))

    @cached_property
    def first_code(self) -> str:
        return self.panel.agg(F.min("code")).first()[0] or ""

    @cached_property
    def last_code(self) -> str:
        return self.panel.agg(F.max("code")).first()[0] or ""

    @cached_property
    def evaluation(self) -> Evaluation:
        return walk_forward(self.panel, self.spec)

    tested = property(lambda self: self.evaluation.daily)
    scored = wide = metrics = property(lambda self: self.evaluation.windows)
    drops = property(lambda self: scores.drops(self.evaluation.daily, ["off", "profile", "y"]))
    months = property(lambda self: scores.monthly_wins(self.evaluation.daily, ["off", "profile", "y"]))
    stability = property(lambda self: self.evaluation.stability())
    luck = property(lambda self: self.evaluation.luck())
    paths = property(lambda self: self.evaluation.paths)
    worst = property(lambda self: scores.worst_path(self.evaluation.paths, ["profile"]))
    by_offset = property(lambda self: self.evaluation.windows.groupBy("off", "profile").agg(F.avg("annual").alias("annual"), F.avg("mdd").alias("mdd"), F.avg("sharpe").alias("sharpe")))
    regime_report = property(lambda self: self.evaluation.regimes())
    averages = property(lambda self: scores.averages(self.grown.where("f is not null"), ["code"]))
    regimes = property(lambda self: scores.regimes(self.grown.where("f is not null"), ["code"]))

    @cached_property
    def corrs(self) -> DataFrame:
        return research.correlations(self.grown)

    momentum = property(lambda self: research.forecast(self.grown))
    ics = property(lambda self: research.information(research.forecast(self.grown)))
    benchmark = property(lambda self: self.grown.where(F.col("code") == self.first_code).select("dt", "f"))

    @cached_property
    def adjusted(self) -> DataFrame:
        """Prices with a distribution of 3 % a year for all but PROMO, and a factor of 5 from a day in 1998 on for the first instrument."""
        growth = F.when(F.col("code") == "PROMO", 1.0).otherwise(F.pow(F.lit(1.03), F.datediff("dt", F.lit("1995-01-01").cast("date")) / 365.25))
        step = F.when((F.col("dt") >= F.lit("1998-06-01").cast("date")) & (F.col("code") == self.first_code), 5.0).otherwise(1.0)
        return self.panel.select("code", "dt", (F.col("close") * growth * step).alias("close"))

    @cached_property
    def blend(self) -> DataFrame:
        n = Window.partitionBy(F.lit(0))
        return self.instruments.select("code", (1.0 / F.count("*").over(n)).alias("w"))

    @cached_property
    def second(self) -> DataFrame:
        """A second chain of the same instruments: prices after discount."""
        return stored(sales_panel(self.spark, self.sf_dir, "l_extendedprice * (1 - l_discount)"))
