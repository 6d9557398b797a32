"""Strategies as relations, by name. A strategy is a function (view, chosen, by, **settings) -> (by, off, decided, code, w).

view: growth() of the panel and what history() adds to it: every column at a decision's row knows the days before it only, so no
strategy can look ahead. chosen: the decisions (by, off, dt). Weights are long-only and at most 1 in sum; the rest is cash.
Python strategies go through simulator.strategy_targets().
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.operators.series import along

Strategy = Callable[..., DataFrame]
_KNOWN: dict[str, Strategy] = {}


def register(name: str) -> Callable[[Strategy], Strategy]:
    """Makes a strategy known by name; a name that is taken is an error."""

    def put(f: Strategy) -> Strategy:
        if name in _KNOWN:
            raise ValueError(f"there is a strategy {name!r} already")
        _KNOWN[name] = f
        return f

    return put


def load(name: str) -> Strategy:
    """A registered strategy; else the attribute `strategy` of the module strategies.<name>, which a project may bring."""
    if name in _KNOWN:
        return _KNOWN[name]
    import importlib

    try:
        return importlib.import_module(f"strategies.{name}").strategy
    except ModuleNotFoundError as e:
        raise KeyError(f"no strategy {name!r}; known are {', '.join(sorted(_KNOWN))}") from e


def names() -> list[str]:
    return sorted(_KNOWN)


def history(grown: DataFrame, by: Sequence[str] = (), lookback: int = 60, skip: int = 0) -> DataFrame:
    """growth() with what is known before the day: last price p, move (its change over `lookback` days), vol and mean of the last `lookback` returns, and their number."""
    w = along(by)
    frame = w.rowsBetween(-lookback, -1)
    p = F.lag("f", 1 + skip).over(w)
    return grown.select(
        *grown.columns, p.alias("p"), (F.try_divide(p, F.lag("f", 1 + skip + lookback).over(w)) - 1).alias("move"), F.stddev_pop("r").over(frame).alias("vol"), F.avg("r").over(frame).alias("mean"),
        F.count("r").over(frame).alias("known"), F.avg("f").over(frame).alias("level"),
    )


def asked(view: DataFrame, chosen: DataFrame, by: Sequence[str], ready: Column) -> DataFrame:
    """The rows of view at the decisions, where `ready` holds."""
    return chosen.withColumnRenamed("dt", "decided").join(view.withColumnRenamed("dt", "decided"), [*by, "decided"]).where(ready)


def scaled(rows: DataFrame, by: Sequence[str], x: Column, whole: float = 1.0) -> DataFrame:
    """(by, off, decided, code, w): the positive x of every decision, scaled to the sum `whole`."""
    book = rows.withColumn("__x", x).where("__x > 0")
    total = F.sum("__x").over(Window.partitionBy(*by, "off", "decided"))
    return book.select(*by, "off", "decided", "code", (F.col("__x") / total * whole).alias("w"))


SEEN = 20


@register("s0_passive")
def passive(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), blend: dict[str, float] | None = None, **_: object) -> DataFrame:
    """A fixed blend over the members with SEEN prices, scaled to 1; equal weights over all instruments without one."""
    rows = asked(view, chosen, by, F.col("seen") >= SEEN)
    if blend is None:
        return scaled(rows, by, F.lit(1.0))
    said = F.broadcast(rows.sparkSession.createDataFrame([(str(c), float(w)) for c, w in blend.items()], "code string, __w double"))
    return scaled(rows.join(said, "code"), by, F.col("__w"))


@register("never_rebalanced")
def never(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), blend: dict[str, float] | None = None, **_: object) -> DataFrame:
    """The blend bought at the first decision that has a member, and left alone. Give simulate() only the decisions that this names."""
    first = passive(view, chosen, by, blend)
    return first.withColumn("__f", F.min("decided").over(Window.partitionBy(*by, "off"))).where("decided = __f").drop("__f")


def _best(rows: DataFrame, by: Sequence[str], score: Column, top_n: int) -> DataFrame:
    w = Window.partitionBy(*by, "off", "decided").orderBy(F.desc("__score"), "code")
    return rows.withColumn("__score", score).where("__score is not null").withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= top_n)


@register("momentum")
def momentum(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), top_n: int = 3, **_: object) -> DataFrame:
    """Equal weights in the top_n that rose most over the lookback."""
    return scaled(_best(asked(view, chosen, by, F.col("seen") >= SEEN), by, F.col("move"), top_n), by, F.lit(1.0))


@register("trend")
def trend(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), **_: object) -> DataFrame:
    """An equal share of each instrument while it is above where it was a lookback ago; the shares of the others are cash."""
    rows = asked(view, chosen, by, (F.col("seen") >= SEEN) & F.col("move").isNotNull())
    share = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*by, "off", "decided")))
    return share.where("move > 0").select(*by, "off", "decided", "code", (1.0 / F.col("__n")).alias("w"))


@register("reversion")
def reversion(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), top_n: int = 3, **_: object) -> DataFrame:
    """Equal weights in the top_n that fell most below their mean price."""
    return scaled(_best(asked(view, chosen, by, F.col("seen") >= SEEN), by, 1 - F.try_divide("p", "level"), top_n), by, F.lit(1.0))


@register("inverse_vol")
def inverse_vol(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), **_: object) -> DataFrame:
    """Weights by 1 / volatility: risk parity of uncorrelated instruments."""
    return scaled(asked(view, chosen, by, (F.col("seen") >= SEEN) & (F.col("vol") > 0)), by, 1 / F.col("vol"))


@register("vol_target")
def vol_target(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), target: float = 0.1, days: float = 252, **_: object) -> DataFrame:
    """Inverse volatility, scaled down so that its volatility (correlations taken as 1, the safe side) is `target` a year at most."""
    book = inverse_vol(view, chosen, by)
    risk = view.select(*by, F.col("dt").alias("decided"), "code", "vol")
    rows = book.join(risk, [*by, "decided", "code"])
    whole = F.sum(F.col("w") * F.col("vol")).over(Window.partitionBy(*by, "off", "decided")) * F.sqrt(F.lit(float(days)))
    return rows.select(*by, "off", "decided", "code", (F.col("w") * F.least(F.lit(1.0), F.try_divide(F.lit(float(target)), whole))).alias("w"))


@register("average_gate")
def average_gate(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), **_: object) -> DataFrame:
    """An equal share of each instrument above its mean price; the rest is cash."""
    rows = asked(view, chosen, by, F.col("seen") >= SEEN)
    share = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*by, "off", "decided")))
    return share.where("p > level").select(*by, "off", "decided", "code", (1.0 / F.col("__n")).alias("w"))


@register("hysteresis")
def hysteresis(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), band: float = 0.02, **_: object) -> DataFrame:
    """average_gate with a band: in above it, out below it, and inside it as at the last crossing, which no look ahead is needed for."""
    rows = asked(view, chosen, by, F.col("seen") >= SEEN)
    rel = F.try_divide("p", "level") - 1
    w = Window.partitionBy(*by, "off", "code").orderBy("decided").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(rel > band, True).when(rel < -band, False), ignorenulls=True).over(w)
    share = rows.withColumn("__in", state).withColumn("__n", F.count("*").over(Window.partitionBy(*by, "off", "decided")))
    return share.where("__in").select(*by, "off", "decided", "code", (1.0 / F.col("__n")).alias("w"))


@register("risk_parity")
def risk_parity(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), lookback: int = 60, rounds: int = 200, **_: object) -> DataFrame:
    """Equal risk contributions: w * (C w) the same for all, C the covariance of the last `lookback` returns. One group a decision, instruments x instruments."""
    import numpy as np
    import pandas as pd

    w = along(by).rowsBetween(-lookback, -1)
    seen = view.withColumn("__x", F.collect_list(F.coalesce("r", F.lit(0.0))).over(w))
    rows = asked(seen, chosen, by, (F.col("seen") >= SEEN) & (F.col("vol") > 0) & (F.size("__x") == lookback))
    keys = [*by, "off", "decided"]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("code", ignore_index=True)
        c = np.atleast_2d(np.cov(np.array(g["__x"].tolist()), bias=True))
        x = 1 / np.sqrt(np.diag(c))
        for _ in range(rounds):  # cyclic descent of the log-barrier problem; every step has a closed form
            for k in range(len(x)):
                rest = c[k] @ x - c[k, k] * x[k]
                x[k] = (-rest + np.sqrt(rest * rest + 4 * c[k, k] / len(x))) / (2 * c[k, k])
        return g[[*keys, "code"]].assign(w=x / x.sum())

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "code", "__x").groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", code string, w double")


@register("blend_of_two")
def blend_of_two(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), first: str = "momentum", second: str = "inverse_vol", share: float = 0.5, **settings: object) -> DataFrame:
    """Two mechanisms at a fixed ratio."""
    parts = [load(n)(view, chosen, by, **settings).withColumn("w", F.col("w") * x) for n, x in ((first, share), (second, 1 - share))]
    return parts[0].unionByName(parts[1]).groupBy(*by, "off", "decided", "code").agg(F.sum("w").alias("w"))


@register("random")
def random(view: DataFrame, chosen: DataFrame, by: Sequence[str] = (), seed: int = 0, top_n: int = 3, **_: object) -> DataFrame:
    """Random control: equal weights in top_n members that a hash of the seed picks once for each run, of those that have a price."""
    return scaled(_best(asked(view, chosen, by, F.col("seen") >= SEEN), by, F.xxhash64("code", F.lit(seed)), top_n), by, F.lit(1.0))
