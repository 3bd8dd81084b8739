"""Selectors: label matchers, time alignment to a grid (the as-of join) and range windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.histograms import lost_counts
from ..plans.syntax import Matcher, QueryError
from ..sources.model import Grid, label


def matches(labels: Column, m: Matcher) -> Column:
    """Whether a label set satisfies a matcher; an absent label is the empty string, regular expressions are anchored."""
    have = label(labels, m.name)
    if m.op == "=":
        return have == m.value
    if m.op == "!=":
        return have != m.value
    try:
        re.compile(m.value)
    except re.error as e:
        raise QueryError(f"bad regular expression {m.value!r}: {e}") from e
    hit = have.rlike(f"^(?s:{m.value})$")
    return hit if m.op == "=~" else ~hit


def matches_value(column: Column | None, m: Matcher) -> Column:
    """A matcher over a table's own column (None: no such label). Equality stays a bare comparison, which files can use."""
    if column is None:
        return F.lit(matches_text("", m))
    if m.op == "=" and m.value:
        return column == F.lit(m.value)
    have = F.coalesce(column.cast("string"), F.lit(""))
    if m.op in ("=", "!="):
        return (have == m.value) if m.op == "=" else (have != m.value)
    hit = have.rlike(f"^(?s:{m.value})$")
    return hit if m.op == "=~" else ~hit


def select(samples: DataFrame, matchers) -> DataFrame:
    for m in matchers:
        samples = samples.where(matches(F.col("labels"), m))
    return samples


def matches_text(value: str, m: Matcher) -> bool:
    """The same decision for a constant: what lets a planner drop a matcher or a whole source."""
    hit = value == m.value if m.op in ("=", "!=") else re.fullmatch(m.value, value, re.S) is not None
    return hit if m.op in ("=", "=~") else not hit


def seen(samples: DataFrame, grid: Grid, span: int, offset: int) -> DataFrame:
    """Each sample once for every step t with t - span < ts + offset <= t. Bounds on ts_ms reach the scan."""
    moved = F.col("ts_ms") + F.lit(offset)
    near = samples.where((F.col("ts_ms") > F.lit(grid.start - offset - span)) & (F.col("ts_ms") <= F.lit(grid.last - offset)))
    if grid.n == 1:
        return near.withColumn("step", F.lit(grid.start).cast("bigint"))
    low = F.greatest(F.lit(0), F.ceil((moved - grid.start) / F.lit(grid.step)).cast("bigint"))
    high = F.least(F.lit(grid.n - 1), F.floor((moved + (span - 1) - grid.start) / F.lit(grid.step)).cast("bigint"))
    placed = near.withColumn("low", low).withColumn("high", high).where(F.col("low") <= F.col("high"))
    return placed.withColumn("step", F.explode(F.sequence("low", "high"))).withColumn("step", F.col("step") * grid.step + grid.start).drop("low", "high")


def instant(samples: DataFrame, grid: Grid, lookback: int, offset: int = 0) -> DataFrame:
    """Newest sample of each series at each step, none if it is stale: lkey, step, value, ts[, hist]."""
    rows = seen(samples, grid, lookback, offset).groupBy("lkey", "step")
    if "hist" in samples.columns:
        newest = rows.agg(F.max_by(F.struct("value", "stale", F.col("ts_ms").alias("ts"), "hist"), "ts_ms").alias("s")).where(~F.col("s.stale"))
        return newest.select("lkey", "step", "s.value", "s.ts", "s.hist")
    newest = rows.agg(F.max_by("value", "ts_ms").alias("value"), F.max_by("stale", "ts_ms").alias("stale"), F.max("ts_ms").alias("ts"))  # plain types: hash aggregation
    return newest.where(~F.col("stale")).select("lkey", "step", "value", "ts")


def windows(samples: DataFrame, grid: Grid, span: int, offset: int = 0, previous: bool = False, native: bool = False) -> DataFrame:
    """Samples in each left-open window: lkey, step, ts, ets (on the steps' clock), value[, pv, pts: the sample before, where
    it is in the window too]. previous adds a sort by series; the aggregation that follows reuses its partitioning. With native
    the windows hold histograms as well: hist, and of the series' next histogram its time and whether it lost counts (nets,
    nlost); without it, or where the samples have none, floats only."""
    live = samples.where(~F.col("stale"))
    native = native and "hist" in live.columns
    if "hist" in live.columns and not native:
        live = live.where(F.col("hist").isNull())
    live = live.where((F.col("ts_ms") > F.lit(grid.start - offset - span)) & (F.col("ts_ms") <= F.lit(grid.last - offset)))
    cols = [F.col("lkey"), F.col("ts_ms"), F.col("value")]
    w = Window.partitionBy("lkey", F.col("hist").isNull()).orderBy("ts_ms") if native else Window.partitionBy("lkey").orderBy("ts_ms")
    if native:
        following = F.lead("hist").over(w)
        lost = F.when(F.col("hist").isNotNull() & following.isNotNull(), lost_counts(F.col("hist"), following))
        cols += [F.col("hist"), (F.lead("ts_ms").over(w) + F.lit(offset)).alias("nets"), F.coalesce(lost, F.lit(False)).alias("nlost")]
    if previous:
        cols += [F.lag("value").over(w).alias("pv"), F.lag("ts_ms").over(w).alias("pts")]
    rows = seen(live.select(*cols), grid, span, offset).withColumn("ets", F.col("ts_ms") + F.lit(offset)).withColumnRenamed("ts_ms", "ts")
    if previous:
        inside = F.col("pts") + F.lit(offset) > F.col("step") - F.lit(span)
        rows = rows.withColumn("pv", F.when(inside, F.col("pv"))).withColumn("pts", F.when(inside, F.col("pts")))
    return rows
