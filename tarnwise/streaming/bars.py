"""Streams that feed the panel: bars from events, and snapshots that are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwise.sources.panel import append_snapshots


def daily_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(code, dt, n, lo, hi, first, last) by event type and day, of a stream or a table of events (ts, event_type, value).

    On a stream, a day's bar is final when the watermark has passed its end; events later than `late` are dropped.
    First and last are by ts, ties by value. Rows with a null ts take no part.
    """
    order = F.struct("ts", "value")
    bars = (
        events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("code"))
        .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(order).getField("value").alias("first"), F.max(order).getField("value").alias("last"))
    )
    return bars.select("code", F.col("window.start").cast("date").alias("dt"), "n", "lo", "hi", "first", "last")


STATE = "level double, peak double, days long, cooling int"


def breaker(returns: DataFrame, daily_loss: float, hard: float, cool: int) -> DataFrame:
    """(run_id, dt, r, level, drawdown, cooling) of a stream of daily returns (run_id, dt, r): the state of a run goes from batch to batch.

    A loss beyond daily_loss or a fall beyond `hard` below the peak stops a run for `cool` days, on which it earns nothing. Days of
    a run come in order; those of one batch are sorted. A null return is 0.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts, state: GroupState):
        level, peak, days, cooling = state.get if state.exists else (1.0, 1.0, 0, 0)
        rows = pd.concat(list(parts)).sort_values("dt", ignore_index=True)
        out = []
        for day, r in zip(rows["dt"], rows["r"].fillna(0.0)):
            gain = 0.0 if cooling else float(r)
            level *= 1 + gain
            peak = max(peak, level)
            fall = level / peak - 1
            cooling = cooling - 1 if cooling else cool if gain < -daily_loss or fall < -hard else 0
            days += 1
            out.append((key[0], day, gain, level, fall, cooling))
        state.update((level, peak, days, cooling))
        yield pd.DataFrame(out, columns=["run_id", "dt", "r", "level", "drawdown", "cooling"])

    rows = returns.where("run_id is not null and dt is not null").select("run_id", "dt", "r")
    return rows.groupBy("run_id").applyInPandasWithState(step, "run_id string, dt date, r double, level double, drawdown double, cooling int", STATE, "append", GroupStateTimeout.NoTimeout)


def revised(prices: DataFrame, placed: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(signal, code, px, now) of a stream of prices (code, dt, close) that come anew: those that differ from what an order (signal, code, px) was filled at."""
    now = prices.select("code", F.col("dt").alias("signal"), F.col("close").alias("now"))
    met = now.join(placed.select("signal", "code", "px"), ["code", "signal"]).select("signal", "code", "px", "now")
    return met.where((F.col("px") == 0) | (F.abs(F.try_divide("now", "px") - 1) > tolerance))


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet event files in a folder."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def write_bars(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends final bars to a Parquet table; what is there when it starts is worked off, then it ends."""
    return bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_snapshots(snapshots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each (signal_date, strategy) of a stream once, also when a batch is run again."""
    return snapshots.writeStream.foreachBatch(lambda df, _: append_snapshots(df.sparkSession, df, path) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
