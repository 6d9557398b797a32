"""Research diagnostics over returns (dt, code, r) or daily results (keys, dt, net, b)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.operators.series import along


def correlations(returns: DataFrame, fn=F.corr, name: str = "rho") -> DataFrame:
    """(code_a, code_b, rho) of all pairs, both ways and with themselves, on days that both have.

    Only a <= b is computed, and mirrored: N (N + 1) / 2 pairs of the instruments that share a day.
    """
    x = returns.where("r is not null").select("dt", F.col("code").alias("code_a"), F.col("r").alias("__a"))
    y = x.select("dt", F.col("code_a").alias("code_b"), F.col("__a").alias("__b"))
    half = x.join(y, "dt").where("code_a <= code_b").groupBy("code_a", "code_b").agg(fn("__a", "__b").alias(name))
    mirrored = F.explode(F.when(F.col("code_a") == F.col("code_b"), F.array(F.struct("code_a", "code_b"))).otherwise(F.array(F.struct("code_a", "code_b"), F.struct(F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b")))))
    return half.select(mirrored.alias("__p"), name).select("__p.code_a", "__p.code_b", name)


def effective_count(corr: DataFrame) -> DataFrame:
    """(n, n_eff): N squared over the sum of all squared correlations."""
    n = F.count_distinct("code_a")
    return corr.agg(n.alias("n"), (F.pow(n, 2) / F.sum(F.col("rho") * F.col("rho"))).alias("n_eff"))


def exposure_corr(daily: DataFrame, a: Column, b: Column) -> DataFrame:
    """(rho, n): the correlation of two runs' returns, each divided by the part of the capital that was invested; days on which either is in cash have none."""
    per = F.when(F.col("invested") > 1e-9, F.col("net") / F.col("invested"))
    x = daily.where(a).select("dt", per.alias("__a"))
    y = daily.where(b).select("dt", per.alias("__b"))
    return x.join(y, "dt").where("__a is not null and __b is not null").agg(F.corr("__a", "__b").alias("rho"), F.count("*").alias("n"))


def drawdown_corr(dropped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rho, n): correlation with the benchmark on the days below the peak."""
    return dropped.where("dd < 0").groupBy(*keys).agg(F.corr("net", "b").alias("rho"), F.count("*").alias("n"))


def asymmetry(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, asymmetry): slope on the benchmark's rising days less that on its falling days."""
    slope = lambda on: F.regr_slope(F.when(on, F.col("net")), F.when(on, F.col("b")))
    return daily.groupBy(*keys).agg((slope(F.col("b") > 0) - slope(F.col("b") < 0)).alias("asymmetry"))


def realization(scored: DataFrame, keys: Sequence[str], split: int) -> DataFrame:
    """(keys, rate): mean annual return from year `split` on, over that before."""
    got = scored.groupBy(*keys).agg(F.avg(F.when(F.col("y") >= split, F.col("annual"))).alias("o"), F.avg(F.when(F.col("y") < split, F.col("annual"))).alias("i"))
    return got.select(*keys, F.try_divide("o", "i").alias("rate"))


def diversification(returns: DataFrame) -> DataFrame:
    """(ratio): mean volatility of the instruments over the volatility of their equal-weight mean."""
    r = returns.where("r is not null")
    own = r.groupBy("code").agg(F.stddev_pop("r").alias("v")).agg(F.avg("v").alias("v"))
    both = r.groupBy("dt").agg(F.avg("r").alias("x")).agg(F.stddev_pop("x").alias("p"))
    return own.crossJoin(F.broadcast(both)).select(F.try_divide("v", "p").alias("ratio"))


def forecast(filled: DataFrame, back: int = 60, ahead: int = 20) -> DataFrame:
    """(dt, code, signal, ahead): the change over the last `back` days and over the next `ahead`."""
    w = along()
    return filled.where("f is not null").select("dt", "code", (F.try_divide("f", F.lag("f", back).over(w)) - 1).alias("signal"), (F.try_divide(F.lead("f", ahead).over(w), F.col("f")) - 1).alias("ahead"))


def information(signals: DataFrame, least: int = 3) -> DataFrame:
    """(dt, ic): rank correlation of signal and what came after, across the instruments of each day."""
    rows = signals.where("signal is not null and ahead is not null")
    rank = lambda c: F.rank().over(Window.partitionBy("dt").orderBy(c)).cast("double")
    ranked = rows.select("dt", rank("signal").alias("a"), rank("ahead").alias("b"))
    return ranked.groupBy("dt").agg(F.count("*").alias("__n"), F.corr("a", "b").alias("ic")).where(F.col("__n") >= least).select("dt", "ic")


def ic_tstat(ics: DataFrame) -> DataFrame:
    rows = ics.where("ic is not null and not isnan(ic)")
    return rows.agg(F.count("*").alias("n"), F.avg("ic").alias("ic"), (F.avg("ic") / (F.stddev_samp("ic") / F.sqrt(F.count("*")))).alias("t"))


def exposure(daily: DataFrame, keys: Sequence[str], bear: DataFrame | None = None) -> DataFrame:
    """(keys, avg_exposure, share_zero, bear_exposure, low, mid, high): how much is invested; bear (dt) are the days that bear_exposure is of, and the last three are deciles."""
    marked = daily.withColumn("__bear", F.lit(False)) if bear is None else daily.join(F.broadcast(bear.select("dt").distinct().withColumn("__bear", F.lit(True))), "dt", "left")
    x = F.col("invested")
    return marked.groupBy(*keys).agg(
        F.avg(x).alias("avg_exposure"), F.avg(F.when(x < 1e-9, 1.0).otherwise(0.0)).alias("share_zero"), F.avg(F.when(F.col("__bear"), x)).alias("bear_exposure"),
        *(F.percentile(x, F.lit(p)).alias(n) for n, p in (("low", 0.1), ("mid", 0.5), ("high", 0.9))),
    )


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n): rank correlation of two columns; a row is a configuration, and there are as many as were tried."""
    rank = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(c)).cast("double")
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(rank(a).alias("a"), rank(b).alias("b")).agg(F.corr("a", "b").alias("rho"), F.count("*").alias("n"))


def sensitivity(rows: DataFrame, dimensions: Sequence[str], x: str = "annual") -> DataFrame:
    """(dimension, spread): how far the means of each dimension's values lie apart, the widest first."""
    out = None
    for d in dimensions:
        own = rows.groupBy(d).agg(F.avg(x).alias("__x")).agg(F.lit(d).alias("dimension"), (F.max("__x") - F.min("__x")).alias("spread"))
        out = own if out is None else out.unionByName(own)
    return out


def plateau(rows: DataFrame, at: str, step: float, x: str = "annual", noise: float = 0.01) -> DataFrame:
    """(at, delta, edge, verdict) of a swept parameter: its value less the mean of its neighbours `step` away.

    spike: above them by more than `noise`; cliff: below the best of them by more; else plateau. edge: one side was not swept.
    """
    a = rows.select(F.col(at).alias("at"), F.col(x).alias("__x"))
    b = rows.select(F.col(at).alias("__at"), F.col(x).alias("__y"))
    near = a.join(b, F.abs(F.col("at") - F.col("__at")) == step, "left").groupBy("at", "__x").agg(F.avg("__y").alias("__m"), F.max("__y").alias("__best"), F.count("__y").alias("__n"))
    delta = F.col("__x") - F.col("__m")
    verdict = F.when(F.col("__n") == 0, None).when(delta > noise, "spike").when(F.col("__best") - F.col("__x") > noise, "cliff").otherwise("plateau")
    return near.select(F.col("at").alias(at), delta.alias("delta"), (F.col("__n") < 2).alias("edge"), verdict.alias("verdict"))


def pareto(rows: DataFrame, keys: Sequence[str], more: Sequence[str]) -> DataFrame:
    """(keys) of the rows that no other is better than in one of `more` and as good in the rest; a row is a configuration."""
    other = rows.select(*(F.col(c).alias(f"__{c}") for c in more))
    no_worse = [F.col(f"__{c}") >= F.col(c) for c in more]
    better = [F.col(f"__{c}") > F.col(c) for c in more]
    both = lambda cs, op: cs[0] if len(cs) == 1 else op(cs[0], both(cs[1:], op))
    return rows.join(F.broadcast(other), both(no_worse, lambda p, q: p & q) & both(better, lambda p, q: p | q), "left_anti").select(*keys)


def rolling(series: DataFrame, days: int, own: float | None = None) -> DataFrame:
    """(lo, low, mid, high, hi, n, location): the distribution of one price series' (dt, f) change over `days`, and the share of it below `own`."""
    w = Window.partitionBy(F.lit(0)).orderBy("dt")
    x = series.where("f is not null").select((F.try_divide("f", F.lag("f", days).over(w)) - 1).alias("x")).where("x is not null")
    at = F.avg((F.col("x") < own).cast("double")) if own is not None else F.lit(None).cast("double")
    return x.agg(F.min("x").alias("lo"), F.percentile("x", F.lit(0.25)).alias("low"), F.median("x").alias("mid"), F.percentile("x", F.lit(0.75)).alias("high"), F.max("x").alias("hi"), F.count("*").alias("n"), at.alias("location"))


def staggered(daily: DataFrame, keys: Sequence[str], equity: str = "equity") -> DataFrame:
    """(keys, dt, equity, sigma): equal capital on every offset, and how far the offsets lie apart."""
    return daily.groupBy(*keys, "dt").agg(F.avg(equity).alias("equity"), F.stddev_pop(equity).alias("sigma"))


def attribution(targets: DataFrame, grown: DataFrame) -> DataFrame:
    """(off, code, contribution): the sum over holding periods of weight times what the instrument did until the next decision."""
    periods = targets.select("off", "decided").distinct().withColumn("until", F.lead("decided").over(Window.partitionBy("off").orderBy("decided")))
    at = lambda day, name: grown.select(F.col("dt").alias(day), "code", F.col("f").alias(name))
    met = targets.join(periods, ["off", "decided"]).join(at("decided", "__a"), ["decided", "code"]).join(at("until", "__z"), ["until", "code"])
    return met.groupBy("off", "code").agg(F.sum(F.col("w") * (F.try_divide("__z", "__a") - 1)).alias("contribution"))


def increments(own: DataFrame, control: DataFrame, keys: Sequence[str] = ("y",)) -> DataFrame:
    """(keys, own, control, increment, share): what a run adds to the passive control in each period, and its share of all that is added."""
    k = list(keys)
    met = own.select(*k, F.col("annual").alias("own")).join(control.select(*k, F.col("annual").alias("control")), k).withColumn("increment", F.col("own") - F.col("control"))
    return met.withColumn("share", F.try_divide(F.col("increment"), F.sum("increment").over(Window.partitionBy(F.lit(0)))))
