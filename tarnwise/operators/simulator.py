"""Portfolio simulation day by day, for what the set form in setpath.py can't say: settlement lag, breaker, minimum holding.

Runs are independent, so Spark spreads them; inside a run a day needs the day before, so one task folds one run. A task holds
days x instruments of its run and no more. Each run's settings are a row of `runs`, so any number of variants is one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights and weight changes up to DUST count as none.
DUST = 1e-9
#: Settings of a run with their defaults. A null threshold never trips.
SETTINGS = {
    "cost": ("double", 0.0006), "lag": ("int", 0), "eval_start": ("date", None), "min_hold": ("int", 0), "penalty": ("double", 0.015),
    "soft_dd": ("double", None), "soft_scale": ("double", 0.5), "hard_dd": ("double", None), "hard_cool": ("int", 10),
    "daily_loss": ("double", None), "daily_cool": ("int", 5), "shelter": ("string", None),
}
RESULT = "run_id string, dt date, gross double, cost double, net double, turnover double, equity double, violations long, cooling int, holdings map<string,double>"


class Book:
    """Weights of one run and the day each position was opened; settles costs of moving to other weights."""

    def __init__(self, n: int, cost: float, min_hold: int, penalty: float):
        self.w, self.opened = np.zeros(n), np.full(n, np.iinfo(np.int64).min)
        self.cost, self.min_hold, self.penalty = cost, min_hold, penalty

    def earn(self, r: np.ndarray) -> float:
        """One day's return; the weights drift with it."""
        day = float(self.w @ r)
        grown = self.w * (1 + r) / (1 + day) if abs(1 + day) >= 1e-12 else np.zeros_like(self.w)
        self.w = np.where(grown > DUST, grown, 0.0)
        return day

    def charge(self, to: np.ndarray, day: int) -> tuple[float, float, int]:
        """Cost, turnover and too early sales of an order from the present weights to `to`. Adding to a position keeps its age."""
        move = to - self.w
        size, sold, bought = np.abs(move), move < -DUST, move > DUST
        known = self.opened > np.iinfo(np.int64).min
        early = sold & known & (day - np.where(known, self.opened, day) < self.min_hold)
        rate = np.where(early, self.penalty, np.where(sold | bought, self.cost, 0.0))
        self.opened[sold & (to <= DUST)] = np.iinfo(np.int64).min
        self.opened[bought & (self.w <= DUST)] = day
        return float(rate @ size), float(size.sum()), int(early.sum())


def fold(days: np.ndarray, r: np.ndarray, priced: np.ndarray, orders: dict[int, np.ndarray], run: dict, shelter: int | None = None) -> Iterator[tuple]:
    """Yields (gross, cost, turnover, violations, cooling, weights or None) for each day.

    days: integers, ascending. r: [day, instrument], 0 where there is none. orders: day index -> target weights, already long-only
    and at most 1 in sum. Events of a day: earn on yesterday's weights, drift, settle a due order, then the first of cooling down,
    breach, rebalance. The cost of an order falls on its day, also if it settles later; until then the overlap is held.
    """
    book = Book(r.shape[1], run["cost"], run["min_hold"], run["penalty"])
    armed = 0 if run["eval_start"] is None else int(np.searchsorted(days, run["eval_start"]))
    daily, hard, soft = (np.inf if run[k] is None else run[k] for k in ("daily_loss", "hard_dd", "soft_dd"))
    level = peak = 1.0
    cooling, waiting, due = 0, None, 0
    for i, day in enumerate(days.tolist()):
        if i == armed:
            level, peak, cooling = 1.0, 1.0, 0
        if i == 0:
            yield 0.0, 0.0, 0.0, 0, 0, None
            continue
        gain = book.earn(r[i])
        level *= 1 + gain
        peak = max(peak, level)
        drop = level / peak - 1 if peak > 0 else 0.0
        hold, cost, turnover, early = book.w, 0.0, 0.0, 0
        if waiting is not None and due <= i and not cooling:
            hold, waiting = waiting, None
        hit = i >= armed and (gain < -daily or drop < -hard)
        if cooling or hit:
            cooling = cooling - 1 if cooling else run["daily_cool"] if gain < -daily else run["hard_cool"]
            hold, waiting = np.zeros_like(book.w), None
            if shelter is not None and priced[i, shelter]:
                hold[shelter] = 1.0
            cost, turnover, early = book.charge(hold, day)
        elif i in orders:
            to = orders[i] * (run["soft_scale"] if i >= armed and drop < -soft else 1.0)
            cost, turnover, early = book.charge(to, day)
            hold, waiting = (to, None) if run["lag"] <= 0 else (np.minimum(book.w, to), to)
            due = i + run["lag"]
        level *= 1 - cost
        book.w = hold
        yield gain, cost, turnover, early, cooling, hold if turnover > 0 or i in orders else None


def normalize(targets: DataFrame) -> DataFrame:
    """targets (run_id, dt, code, w) long-only: negative, null and zero weights go, books over 1 are scaled to 1."""
    kept = targets.where("w > 0").groupBy("run_id", "dt", "code").agg(F.sum("w").alias("w"))
    total = kept.groupBy("run_id", "dt").agg(F.sum("w").alias("__total"))
    return kept.join(total, ["run_id", "dt"]).select("run_id", "dt", "code", (F.col("w") / F.greatest("__total", F.lit(1.0))).alias("w"))


def with_settings(runs: DataFrame) -> DataFrame:
    """runs (run_id, ...) with every setting; missing ones and nulls of those with a default take it."""
    have = set(runs.columns)
    value = lambda name, kind, default: F.coalesce(*([F.col(name).cast(kind)] if name in have else []), F.lit(default).cast(kind)).alias(name)
    return runs.select("run_id", *(value(n, k, v) for n, (k, v) in SETTINGS.items()))


def simulate(market: DataFrame, schedule: DataFrame, targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Daily results (RESULT) of every run.

    market (dt, code, close, r): one row a day and instrument, r null where there is no return. With a column `market` in both
    market and runs, each run has the days of its own market; else all runs share the one, and a run more costs its days once more. schedule (run_id, dt): rebalance
    days, also those without a target (they sell everything). targets (run_id, dt, code, w). runs (run_id and any of SETTINGS).
    Days without any price don't count. Instruments that only targets name earn nothing. Null run ids take no part; an empty
    market or no runs give no rows. Holdings are null on days without trade or rebalance.
    """
    many = ["market"] if "market" in market.columns else []
    by_day = (
        market.where("dt is not null and code is not null").groupBy(*many, "dt")
        .agg(F.collect_list(F.struct("code", F.col("close").isNotNull().alias("priced"), F.coalesce("r", F.lit(0.0)).alias("r"))).alias("x"), F.count("close").alias("n"))
        .where("n > 0").select(*many, "dt", F.col("x.code").alias("codes"), F.col("x.priced").alias("priced"), F.col("x.r").alias("r"))
    )
    book = normalize(targets).groupBy("run_id", "dt").agg(F.collect_list("code").alias("to_codes"), F.collect_list("w").alias("to_w"))
    orders = schedule.where("run_id is not null").select("run_id", "dt").distinct().join(book, ["run_id", "dt"], "left").withColumn("rebal", F.lit(True))
    settings = with_settings(runs.where("run_id is not null")).select("run_id", F.struct(*SETTINGS).alias("run"))
    if many:
        rows = by_day.join(settings.join(runs.select("run_id", "market"), "run_id"), "market").drop("market")
    else:
        rows = by_day.crossJoin(settings)
    rows = rows.join(orders, ["run_id", "dt"], "left")

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt", ignore_index=True)
        run = dict(g["run"].iloc[0])
        codes = sorted({c for x in g["codes"] for c in x} | {c for x in g["to_codes"] if x is not None for c in x})
        at = {c: k for k, c in enumerate(codes)}
        r, priced, to = np.zeros((len(g), len(codes))), np.zeros((len(g), len(codes)), bool), {}
        for i, (names, seen, gains, rebal, to_codes, to_w) in enumerate(zip(g["codes"], g["priced"], g["r"], g["rebal"], g["to_codes"], g["to_w"])):
            k = [at[c] for c in names]
            r[i, k], priced[i, k] = gains, seen
            if rebal is True:
                to[i] = np.zeros(len(codes))
                if to_codes is not None:
                    to[i][[at[c] for c in to_codes]] = to_w
        ordinal = lambda d: pd.Timestamp(d).toordinal()
        run["eval_start"] = None if pd.isna(run["eval_start"]) else ordinal(run["eval_start"])
        run |= {k: None for k in ("daily_loss", "hard_dd", "soft_dd") if pd.isna(run[k])}
        found = list(fold(np.array([ordinal(d) for d in g["dt"]], np.int64), r, priced, to, run, at.get(run["shelter"])))
        gross, cost, turnover, early, cooling, held = zip(*found)
        net = np.array(gross) - np.array(cost)
        held = [None if w is None else {codes[k]: float(w[k]) for k in np.flatnonzero(w > 0)} for w in held]
        return pd.DataFrame({"run_id": key[0], "dt": g["dt"], "gross": gross, "cost": cost, "net": net, "turnover": turnover, "equity": np.cumprod(1 + net), "violations": early, "cooling": cooling, "holdings": held})

    return rows.groupBy("run_id").applyInPandas(one, RESULT)


def strategy_targets(panel: DataFrame, schedule: DataFrame, make: Callable[[str], object]) -> DataFrame:
    """Targets (run_id, dt, code, w) from Python strategies. make(run_id) gives a fresh object for each run, whose
    target_weights(history, asof) gets the wide prices strictly before asof and returns weights by code; decisions come in order.

    panel (dt, code, close). The first day of the panel has no history and asks for nothing.
    """
    day = panel.where("dt is not null and close is not null").groupBy("dt").agg(F.map_from_entries(F.collect_list(F.struct("code", "close"))).alias("prices"))
    asked = schedule.select("run_id", "dt").distinct().withColumn("asked", F.lit(True))
    rows = day.crossJoin(asked.select("run_id").distinct()).join(asked, ["run_id", "dt"], "left")

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt", ignore_index=True)
        wide = pd.DataFrame([dict(x) for x in g["prices"]], index=pd.to_datetime(g["dt"]), dtype=float).sort_index(axis=1)
        strategy, out = make(key[0]), []
        for i in np.flatnonzero((g["asked"] == True).to_numpy()):  # noqa: E712
            if i:
                weights = strategy.target_weights(wide.iloc[:i].copy(), wide.index[i])
                out += [(key[0], g["dt"][i], str(c), float(w)) for c, w in dict(weights).items()]
        return pd.DataFrame(out, columns=["run_id", "dt", "code", "w"])

    return rows.groupBy("run_id").applyInPandas(one, "run_id string, dt date, code string, w double")


class Blend:
    """Passive control: fixed weights over the members with enough history, scaled to 1; nothing if there are none. Without weights all instruments count alike."""

    def __init__(self, weights: dict[str, float] | None = None, history: int = 20):
        self.weights, self.history = weights, history

    def target_weights(self, prices: pd.DataFrame, asof: pd.Timestamp) -> dict[str, float]:
        seen = prices.count()
        weights = dict.fromkeys(prices.columns, 1.0) if self.weights is None else self.weights
        ready = {c: w for c, w in weights.items() if seen.get(c, 0) >= self.history}
        return {c: w / sum(ready.values()) for c, w in ready.items()}
