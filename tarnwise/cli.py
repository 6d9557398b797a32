"""Command line: evaluate a strategy, check data, record a snapshot, reconcile.

python -m tarnwise.cli evaluate --config config.yaml --strategy s0_passive --out results
python -m tarnwise.cli check --config config.yaml --out results
python -m tarnwise.cli snapshot --config config.yaml --registration registration.json --table snapshots
python -m tarnwise.cli reconcile --config config.yaml --registration registration.json --table snapshots
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.operators import quality, schedule, strategies, tracking
from tarnwise.operators.protocol import Spec, walk_forward
from tarnwise.operators.series import calendar, dense, growth
from tarnwise.sinks import reports
from tarnwise.sources import panel as files

#: Breaker of --circuit-breaker where the config enables none.
BREAKER = {"daily_loss": 0.04, "daily_cool": 5, "soft_dd": 0.1, "soft_scale": 0.5, "hard_dd": 0.15, "hard_cool": 10}


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    todo = top.add_subparsers(dest="todo", required=True)
    for name in ("evaluate", "check", "snapshot", "reconcile"):
        p = todo.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--strategy", default="s0_passive")
        if name in ("evaluate", "check"):
            p.add_argument("--out", default="results")
        if name in ("snapshot", "reconcile"):
            p.add_argument("--registration", required=True)
            p.add_argument("--table", required=True)
        if name == "evaluate":
            p.add_argument("--offsets", type=lambda x: tuple(int(k) for k in x.split(",")))
            p.add_argument("--freq", choices=("monthly", "weekly"))
            for flag, kind in (("--trade-lag", int), ("--min-hold-days", int), ("--top-n", int), ("--tag", str)):
                p.add_argument(flag, type=kind)
            p.add_argument("--circuit-breaker", action="store_true")
        if name == "check":
            p.add_argument("--prices")
            p.add_argument("--live", action="store_true")
        if name == "snapshot":
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--capital", type=float)
    return top.parse_args(argv)


def spec_of(config: files.Config, args: argparse.Namespace) -> Spec:
    said = {"offsets": args.offsets, "freq": args.freq, "lag": args.trade_lag, "min_hold": args.min_hold_days, "tag": args.tag}
    spec = Spec.from_config(config.values, args.strategy, **{k: v for k, v in said.items() if v is not None})
    if args.top_n:
        spec = replace(spec, settings={**spec.settings, "top_n": args.top_n})
    return replace(spec, breaker=spec.breaker or BREAKER) if args.circuit_breaker else spec


def prices(spark: SparkSession, config: files.Config, research: bool = True, which: str = "price_file") -> DataFrame:
    data = config.values.get("data") or {}
    end = config.values.get("research_end")
    name = data.get(which, "prices.parquet")
    return files.load_prices(spark, config.path(f"{data.get('cache_dir', 'data/cache')}/{name}"), None if end is None else str(end), research)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    config = files.load_config(args.config)
    e = walk_forward(prices(spark, config), spec_of(config, args))
    reports.write(e, args.out)
    reports.pivot(e).show(100, False)
    e.stability().show(truncate=False)
    e.limitations().show(truncate=False)
    e.triggers().show(truncate=False)
    return 0


def declared(spark: SparkSession, qc: dict) -> DataFrame:
    rows = [(str(c), str(d)) for c, days in (qc.get("redenominations") or {}).items() for d in days]
    return spark.createDataFrame(rows, "code string, d string").select("code", F.col("d").cast("date").alias("dt"))


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    """The number of findings, so that any is a failure."""
    config = files.load_config(args.config)
    qc, data = config.values.get("qc") or {}, config.values.get("data") or {}
    panel = files.read_wide(spark, args.prices) if args.prices else prices(spark, config, not args.live)
    raw = prices(spark, config, not args.live, "raw_price_file") if data.get("raw_price_file") else None
    universe = config.universe(spark)
    rules = {g: None if v is None else float(v) for g, v in (qc.get("price_limits") or {"none": None}).items()}
    found = quality.findings(panel, raw, universe, declared(spark, qc), quality.limits_of(qc), rules)
    n = reports.write_findings(found, args.out)
    reports.one_json(quality.limitations(panel, raw, universe), f"{args.out.rstrip('/')}/limitations")
    found.show(100, False)
    return n


def registered(path: str) -> dict:
    """A registration without a TODO left."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    if left := files.unfilled(said):
        raise SystemExit("fill in first: " + ", ".join(left))
    return said


def snapshot(spark: SparkSession, args: argparse.Namespace) -> int:
    config = files.load_config(args.config)
    registered(args.registration)
    track, spec = config.values.get("tracking") or {}, Spec.from_config(config.values, args.strategy)
    live = prices(spark, config, research=False)

    def decide(seen: DataFrame, asof) -> DataFrame:
        """Targets from the days before asof: the day itself is added without prices, and history() looks at the days before a row only."""
        day = spark.createDataFrame([(asof,)], "dt date").crossJoin(seen.select("code").distinct()).withColumn("close", F.lit(None).cast("double"))
        grid = dense(seen).unionByName(day.select("dt", "code", "close"))
        chosen = day.select(F.lit(0).alias("off"), "dt").distinct()
        return strategies.load(args.strategy)(strategies.history(growth(grid)), chosen, **spec.settings).select("code", "w")

    new = tracking.snapshot(live, decide, args.strategy, args.capital or float(track.get("capital", 100_000)), float(track.get("lot_size", 1)))
    new.show(truncate=False)
    return 0 if args.dry_run else int(files.append_snapshots(spark, new, args.table) == 0)


def reconcile(spark: SparkSession, args: argparse.Namespace) -> int:
    config = files.load_config(args.config)
    said = registered(args.registration)
    panel = prices(spark, config, research=False)
    records = spark.read.parquet(args.table).where(F.col("strategy") == args.strategy)
    book = tracking.exploded(records)
    bench, track = config.values.get("benchmark") or {}, config.values.get("tracking") or {}
    blend = spark.createDataFrame([(str(x["code"]), float(x["weight"])) for x in bench["passive_blend"]], "code string, w double")
    tracking.data_layer(book, panel, float(track.get("price_tolerance", 0.005))).show(truncate=False)
    tracking.execution_layer(book).show(truncate=False)
    layer = tracking.strategy_layer(book, panel, blend, str(bench["primary"]), float((config.values.get("cost") or {}).get("one_way", 0.0006)), float(track.get("divergence_alert", 0.02)))
    layer.show(truncate=False)
    meta = said["meta"]
    ask = spark.createDataFrame([(meta["true_oos_start"], float(meta["prereg"].get("min_months_before_judgement", 12)))], "d string, minimum double")
    tracking.registration(ask.select(F.col("d").cast("date").alias("oos_start"), "minimum"), panel).show(truncate=False)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("tarnwise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"evaluate": evaluate, "check": check, "snapshot": snapshot, "reconcile": reconcile}[args.todo](spark, args)


if __name__ == "__main__":
    raise SystemExit(min(1, main()))
