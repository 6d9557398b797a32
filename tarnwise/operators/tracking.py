"""Paper trading: dated snapshots of orders, and their reconciliation with what prices did since. "Can't be computed" is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a month, as elapsed months are counted.
MONTH = 30.4


def orders(targets: DataFrame, panel: DataFrame, capital: float = 100_000, lot: float = 1) -> DataFrame:
    """(signal, code, w, px, stale, units, amount, actual): targets (signal, code, w) in whole lots at the last close up to the signal's day.

    stale: that day itself has no print. A code without any price up to its day raises when the rows are read: an order that
    silently goes missing is cash that nobody decided on.
    """
    w = Window.partitionBy("code").orderBy("dt", "kind").rowsBetween(Window.unboundedPreceding, 0)
    asks = targets.select("code", F.col("signal").alias("dt"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("close"), "w")
    prints = panel.where("close is not null").select("code", "dt", F.lit(0).alias("kind"), "close", F.lit(None).cast("double").alias("w"))
    seen = F.last(F.when(F.col("kind") == 0, F.struct("close", "dt")), ignorenulls=True).over(w)
    rows = prints.unionByName(asks).withColumn("__s", seen).where("kind = 1")
    px = F.coalesce(F.col("__s.close"), F.raise_error(F.concat(F.col("code"), F.lit(" has no price up to "), F.col("dt").cast("string"))).cast("double"))
    units = F.floor(F.try_divide(F.col("w") * capital, F.col("px")) / lot) * lot
    rows = rows.select(F.col("dt").alias("signal"), "code", "w", px.alias("px"), (F.col("__s.dt") < F.col("dt")).alias("stale"))
    rows = rows.withColumn("units", units).withColumn("amount", F.col("units") * F.col("px"))
    return rows.withColumn("actual", F.col("amount") / capital)


def snapshots(placed: DataFrame, strategy: str, capital: float = 100_000) -> DataFrame:
    """One nested record a signal of orders(): the largest target first, and what stays in cash."""
    order = F.struct((-F.col("w")).alias("__o"), "code", F.round("w", 6).alias("target_weight"), F.round("px", 6).alias("price_at_signal"), F.col("units").cast("long").alias("units"), F.round("amount", 2).alias("amount"), F.round("actual", 6).alias("actual_weight"))
    got = placed.groupBy("signal").agg(F.sort_array(F.collect_list(order)).alias("o"), F.sum("amount").alias("invested"))
    kept = F.transform("o", lambda x: x.dropFields("__o"))
    return got.select(
        F.date_format("signal", "yyyy-MM-dd").alias("signal_date"), F.lit(strategy).alias("strategy"), F.lit(float(capital)).alias("capital"), kept.alias("orders"),
        F.round("invested", 2).alias("invested"), F.round(capital - F.col("invested"), 2).alias("cash_residual"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
        F.lit(None).cast("double").alias("actual_return"), F.lit(None).cast("double").alias("backtest_return"),
    )


def snapshot(panel: DataFrame, decide, strategy: str, capital: float = 100_000, lot: float = 1) -> DataFrame:
    """The snapshot of the panel's last day. decide(history, asof) gets the rows before that day and returns (code, w)."""
    days = [r[0] for r in panel.where("close is not null").select("dt").distinct().orderBy(F.desc("dt")).limit(2).collect()]
    if len(days) < 2:
        raise ValueError("a decision and its fill need two days")
    wanted = decide(panel.where(F.col("dt") <= F.lit(days[1])), days[0]).select(F.lit(days[0]).alias("signal"), "code", "w")
    got = snapshots(orders(wanted, panel, capital, lot), strategy, capital)
    return got.withColumn("decision_cutoff", F.lit(str(days[1])))


def exploded(records: DataFrame) -> DataFrame:
    """(signal, strategy, capital, cash, code, w, px, units) of nested records."""
    each = records.select(F.col("signal_date").cast("date").alias("signal"), "strategy", F.col("capital").cast("double").alias("capital"), F.col("cash_residual").cast("double").alias("cash"), F.explode("orders").alias("o"))
    return each.select("signal", "strategy", "capital", "cash", F.col("o.code").alias("code"), F.col("o.target_weight").cast("double").alias("w"), F.col("o.price_at_signal").cast("double").alias("px"), F.col("o.units").cast("double").alias("units"))


def data_layer(placed: DataFrame, panel: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(signal, code, status): orders whose price at the signal is MISSING from today's panel, or CHANGED by more than the tolerance; a price of 0 then always is."""
    met = placed.join(panel.where("close is not null").select("code", F.col("dt").alias("signal"), F.col("close").alias("now")), ["code", "signal"], "left")
    off = F.when(F.col("px") == 0, True).otherwise(F.abs(F.try_divide("now", "px") - 1) > tolerance)
    return met.select("signal", "code", F.when(F.col("now").isNull(), "MISSING").when(off, "CHANGED").alias("status")).where("status is not null")


def execution_layer(placed: DataFrame, capital: Column | None = None) -> DataFrame:
    """(signal, max_drift, worst, idle): how far lots pull weights from their targets, the order that is furthest, and the share in cash."""
    capital = F.col("capital") if capital is None else capital
    rows = placed.withColumn("__a", F.col("units") * F.col("px") / capital).withColumn("__d", F.abs(F.col("__a") - F.col("w")))
    got = rows.groupBy("signal").agg(F.max("__d").alias("max_drift"), F.max(F.struct("__d", "code")).getField("code").alias("worst"), (1 - F.sum("__a")).alias("idle"))
    return got


def warnings(placed: DataFrame, capital: float = 100_000, idle: float = 0.02) -> DataFrame:
    """(signal, cash, zero_orders, idle): what is left in cash, orders too small for a lot, and whether more than `idle` lies fallow."""
    got = placed.groupBy("signal").agg((capital - F.sum("amount")).alias("cash"), F.count(F.when(F.col("units") == 0, 1)).alias("zero_orders"))
    return got.withColumn("idle", F.col("cash") / capital > idle)


def intervals(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """(signal, until, open): each holding lasts to the next signal, the last one to the latest day; those of under a day are left out."""
    one = signals.select("signal").distinct()
    latest = panel.where("close is not null").agg(F.max("dt").alias("__z"))
    rows = one.withColumn("until", F.lead("signal").over(Window.partitionBy(F.lit(0)).orderBy("signal"))).crossJoin(F.broadcast(latest))
    rows = rows.select("signal", F.coalesce("until", "__z").alias("until"), F.col("until").isNull().alias("open"))
    return rows.where(F.datediff("until", "signal") >= 1)


def ends(spans: DataFrame, panel: DataFrame) -> DataFrame:
    """(signal, until, open, code, n, first_px, last_px): first and last price within each span, both ends included.

    Spans follow one another, so a day is within two at most: the one that it starts or is inside of, and the one that it ends.
    The lookup is a running maximum over the sorted days and no range join.
    """
    rows = panel.where("close is not null").select("code", "dt", "close")
    days = rows.select("dt").distinct().unionByName(spans.select(F.col("signal").alias("dt"))).distinct()
    known = days.join(F.broadcast(spans.select(F.col("signal").alias("dt"), F.struct("signal", "until", "open").alias("__s"))), "dt", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    inside = known.withColumn("__s", F.last("__s", ignorenulls=True).over(w)).where("__s is not null and dt <= __s.until").select("dt", "__s.*")
    closing = spans.select(F.col("until").alias("dt"), "signal", "until", "open")
    member = F.broadcast(inside.unionByName(closing.select("dt", "signal", "until", "open")).distinct())
    return rows.join(member, "dt").groupBy("signal", "until", "open", "code").agg(F.count("*").alias("n"), F.min_by("close", "dt").alias("first_px"), F.max_by("close", "dt").alias("last_px"))


def _whole(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, value) where every row of a book has two prices; null where one has not."""
    return rows.groupBy(*keys).agg(F.when(F.min(F.coalesce(F.col("n"), F.lit(0))) >= 2, value).alias("__v"))


def weight_return(book: DataFrame, found: DataFrame, spans: DataFrame, cost: float = 0.0006) -> DataFrame:
    """(signal, ret) of book (signal, code, w): exact weights, no lots, no idle cash; null if any instrument lacks two prices in the span."""
    met = book.join(spans.select("signal"), "signal").join(found, ["signal", "code"], "left")
    got = _whole(met, ["signal"], F.sum(F.col("w") * (F.try_divide("last_px", "first_px") - 1)) - cost * F.sum("w"))
    return got.select("signal", F.col("__v").alias("ret"))


def paper_return(placed: DataFrame, found: DataFrame, spans: DataFrame, cost: float = 0.0006) -> DataFrame:
    """(signal, ret) of placed (signal, code, units, capital, cash): whole units, and cash that earns nothing; null as in weight_return()."""
    met = placed.join(spans.select("signal"), "signal").join(found, ["signal", "code"], "left")
    start, end = F.sum(F.col("units") * F.col("first_px")), F.sum(F.col("units") * F.col("last_px"))
    got = _whole(met, ["signal"], (end + F.max("cash") - cost * start) / F.max("capital") - 1)
    return got.select("signal", F.col("__v").alias("ret"))


def strategy_layer(placed: DataFrame, panel: DataFrame, blend: DataFrame, benchmark: str, cost: float = 0.0006, alert: float = 0.002) -> DataFrame:
    """(signal, until, open, paper, backtest, gap, alert, blend, benchmark) of every holding of one strategy.

    gap is what lots and idle cash make; blend (code, w) and the benchmark are held over the same span under the same cost.
    """
    spans = intervals(placed, panel)
    found = ends(spans, panel)
    each = lambda df: spans.select("signal").crossJoin(F.broadcast(df))
    one = panel.sparkSession.createDataFrame([(benchmark, 1.0)], "code string, w double")
    parts = {
        "paper": paper_return(placed, found, spans, cost), "backtest": weight_return(placed, found, spans, cost),
        "blend": weight_return(each(blend), found, spans, cost), "benchmark": weight_return(each(one), found, spans, cost),
    }
    out = spans
    for name, df in parts.items():
        out = out.join(df.withColumnRenamed("ret", name), "signal", "left")
    gap = F.col("paper") - F.col("backtest")
    return out.select("signal", "until", "open", "paper", "backtest", gap.alias("gap"), F.coalesce(F.abs(gap) > alert, F.lit(False)).alias("alert"), "blend", "benchmark")


def written_back(records: DataFrame, layer: DataFrame) -> DataFrame:
    """records with actual_return and backtest_return from strategy_layer(), to six digits; what can't be computed leaves the old value."""
    new = layer.select(F.date_format("signal", "yyyy-MM-dd").alias("signal_date"), F.round("paper", 6).alias("__p"), F.round("backtest", 6).alias("__b"))
    met = records.join(new, "signal_date", "left")
    return met.withColumn("actual_return", F.coalesce("__p", "actual_return")).withColumn("backtest_return", F.coalesce("__b", "backtest_return")).select(*records.columns)


def registration(records: DataFrame, panel: DataFrame, minimum: float = 12) -> DataFrame:
    """(start, latest, months, in_force): whether the rules written down beforehand may speak yet. records (oos_start date)."""
    latest = panel.where("close is not null").agg(F.max("dt").alias("latest"))
    months = F.datediff("latest", "oos_start") / MONTH
    rows = records.select("oos_start", *(["minimum"] if "minimum" in records.columns else [])).crossJoin(F.broadcast(latest))
    least = F.coalesce("minimum", F.lit(minimum)) if "minimum" in records.columns else F.lit(minimum)
    return rows.select(F.col("oos_start").alias("start"), "latest", months.alias("months"), (months >= least).alias("in_force"))
