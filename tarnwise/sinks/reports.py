"""Artifacts of an evaluation and of data checks, as files that any filesystem of Spark takes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwise.operators.protocol import Evaluation

#: Columns of a window's row, in the order that readers of the file know.
WINDOW = ("window_id", "y", "off", "profile", "annual", "excess", "mdd", "sharpe", "calmar", "turnover", "win_rate", "short_hold_violations")


def one_json(df: DataFrame, path: str) -> None:
    """The few rows of a summary as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write(e: Evaluation, folder: str) -> dict[str, str]:
    """All artifacts below folder; the paths by name. What was not checked is written beside what was, also if it is nothing."""
    name = e.spec.experiment
    at = {k: f"{folder.rstrip('/')}/{k}_{name}" for k in ("window_daily", "window_reports", "stability", "timing_luck", "regime", "limitations", "triggers", "block")}
    ident = F.concat(F.lit("W-"), F.col("y").cast("string"), F.lit("-"), F.col("profile"), F.lit("-off"), F.col("off").cast("string"))
    daily = e.daily.select(ident.alias("window_id"), "dt", F.col("net").alias("return"), F.col("b").alias("bench_return"), "turnover")
    daily.write.mode("overwrite").partitionBy("window_id").option("header", True).csv(at["window_daily"])
    e.windows.select(*WINDOW).coalesce(1).sortWithinPartitions("y", "off", "profile").write.mode("overwrite").option("header", True).csv(at["window_reports"])
    for profile in ("single", "double"):
        one_json(e.stability().where(F.col("profile") == profile), f"{at['stability']}_{profile}")
        one_json(e.luck().where(F.col("profile") == profile), f"{at['timing_luck']}_{profile}")
    one_json(e.regimes(), at["regime"])
    one_json(e.limitations(), at["limitations"])
    one_json(e.triggers(), at["triggers"])
    one_json(e.block(), at["block"])
    return at


def pivot(e: Evaluation) -> DataFrame:
    """Annual return by year and offset, at single cost, as a reader wants to see it."""
    offsets = list(e.spec.runs)
    return e.windows.where("profile = 'single'").groupBy("y").pivot("off", offsets).agg(F.avg("annual")).orderBy("y")


def write_findings(found: DataFrame, folder: str, name: str = "findings") -> int:
    """Findings as JSON, and how many there are: a gate returns 0 only for none."""
    one_json(found, f"{folder.rstrip('/')}/{name}")
    return found.sparkSession.read.schema(found.schema).json(f"{folder.rstrip('/')}/{name}").count()


def percent(x, digits: int = 2):
    """A share as text; null where there is none."""
    return F.when(x.isNotNull(), F.concat(F.format_number(x * 100, digits), F.lit("%")))


#: What a registration has to say before a result is known; every TODO must go.
REGISTRATION = {
    "meta": {"strategy": "TODO", "true_oos_start": "TODO: a date", "prereg": {"backtest_reference": {"period": "TODO", "annual_return": "TODO", "max_drawdown": "TODO"}, "min_months_before_judgement": 12, "trigger_conditions": ["TODO"], "not_failure": ["TODO"]}},
    "records": [],
}


def write_template(path: str) -> None:
    """A registration to be filled in; an existing file stays."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(REGISTRATION, f, indent=2)
