"""Literal panels in which every check fires, and summaries in which every trigger does; relations.py has the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIVERSE = [("A", "ten", 0.03, None, None), ("B", "ten", 0.03, None, 3.0), ("C", "none", 0.03, None, None), ("D", None, 0.0, None, None), ("E", "none", 0.01, 0.2, 0.5), ("F", "none", None, None, None), ("G", "none", 0.03, None, None), ("H", "ten", 0.03, None, None), ("I", "none", 0.03, None, None)]
RULES = {"ten": 0.1, "none": None}


def raw(spark: SparkSession) -> DataFrame:
    """Eight instruments over 600 days: G is halved, stands still and has a gap; H has a price of 0 and a move beyond its limit and one just within."""
    days = spark.range(600).select(F.col("id").cast("int").alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("dt"))
    codes = F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(i).alias("i")) for i, c in enumerate("ABCDEFGH", 1))))
    base = days.withColumn("c", codes).select("c.code", "k", "dt", (100 * F.exp(0.0003 * F.col("k")) * (1 + 0.004 * F.sin(0.7 * F.col("k") + F.col("c.i")))).alias("close"))
    g, h, k, x = F.col("code") == "G", F.col("code") == "H", F.col("k"), F.col("close")
    close = F.when(g & k.between(400, 411), 50.0).when(g & (k >= 250), x / 2).when(h & (k == 100), 0.0).when(h & (k >= 160), x * 1.106 * 1.104).when(h & (k >= 150), x * 1.106).otherwise(x)
    return base.where(~(g & k.between(450, 489))).select("code", "k", "dt", close.alias("close"))


def adjusted(spark: SparkSession) -> DataFrame:
    """3 % a year on top of raw(), -2 % for D; B has a declared factor of 5 and C an undeclared one of 2."""
    years = F.col("k") / 365.25
    grow = F.when(F.col("code") == "D", F.pow(F.lit(0.98), years)).otherwise(F.pow(F.lit(1.03), years))
    step = F.when((F.col("code") == "B") & (F.col("k") >= 300), 5.0).when((F.col("code") == "C") & (F.col("k") >= 200), 2.0).otherwise(1.0)
    return raw(spark).select("code", "dt", (F.col("close") * grow * step).alias("close"))


def universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNIVERSE, "code string, limit_group string, expect_yield double, low double, high double")


def declared(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("B").alias("code"), F.date_add(F.lit("2020-01-01").cast("date"), 300).alias("dt"))


def summaries(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A stability and a timing-luck table of a result that is too good, whose cost tiers and offsets are alike."""
    stable = spark.createDataFrame([("single", 0.2, 1.8, 0.05), ("double", 0.2, 1.8, 0.05)], "profile string, mean_annual double, sharpe_mean double, mean_excess double")
    return stable, spark.createDataFrame([("single", 4, 0.0), ("double", 4, 0.0)], "profile string, offsets long, std_annual double")
