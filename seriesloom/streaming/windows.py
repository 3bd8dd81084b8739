"""Continuous rollups: range-vector aggregates over a stream of samples, with a watermark for late data.

An extension for live sources: windows of `span_ms` every `step_ms` per series, in event time. Results come once per window when
the watermark has passed it. A stream's windows are [start, end) where a query's are (t - range, t], so a sample that lies
exactly on a step counts to the next window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {
    "sum_over_time": lambda: F.sum("value"), "count_over_time": lambda: F.count(F.lit(1)).cast("double"), "min_over_time": lambda: F.min("value"),
    "max_over_time": lambda: F.max("value"), "avg_over_time": lambda: F.avg("value"), "last_over_time": lambda: F.max_by("value", "ts_ms"),
}


def rollup(samples: DataFrame, function: str, span_ms: int, step_ms: int | None = None, late_ms: int = 600_000) -> DataFrame:
    """lkey, step (the window's end in ms), value. Works on a batch of samples too."""
    timed = samples.where(~F.col("stale")).withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", f"{late_ms} milliseconds")
    window = F.window("at", f"{span_ms} milliseconds", f"{step_ms or span_ms} milliseconds")
    return timed.groupBy(window.alias("w"), "lkey").agg(AGGREGATES[function]().alias("value")).select("lkey", F.unix_millis("w.end").alias("step"), "value")
