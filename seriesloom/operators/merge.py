"""Merging sources: replicas of one group (anti-affinity), the same series across groups (priority dedup), and gap filling.

All of it is windows over one partitioning by series. Gaps are handed from filler to filler by one pass of windows for each filler,
over what the passes before have left open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.model import key_of, without


# ------------------------------------------------------------------------------------------------- replicas (one group)
def merge_replicas(samples: DataFrame, replicas: list[int], buffer_ms: int = 10_000, dynamic: bool = False, prefer_max: bool = False) -> DataFrame:
    """Folds the replicas in order. Of two sides the one with more samples is the base; a sample of the other side is taken only
    before the base's start, after its end or in a gap of more than two buffers, more than a buffer away from the base."""
    parts = [samples.where(F.col("replica") == r) for r in replicas]
    return reduce(lambda a, b: _merge_two(a, b, buffer_ms, dynamic, prefer_max), parts)


def _merge_two(a: DataFrame, b: DataFrame, buffer_ms: int, dynamic: bool, prefer_max: bool) -> DataFrame:
    names = a.columns
    hist = F.col("hist").isNotNull() if "hist" in names else F.lit(False)
    rows = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1))).withColumn("_h", hist)
    series = Window.partitionBy("lkey", "_h")
    both = rows.withColumn("_na", F.sum(F.when(F.col("_side") == 0, 1).otherwise(0)).over(series)).withColumn("_nb", F.sum("_side").over(series))
    both = both.withColumn("_base", F.col("_side") == F.when(F.col("_nb") > F.col("_na"), 1).otherwise(0)).withColumn("_d", F.lit(buffer_ms).cast("bigint"))
    if dynamic:
        both = both.drop("_d").join(_half_medians(both, buffer_ms), ["lkey", "_h"])
    base_ts = F.when(F.col("_base"), F.col("ts_ms"))
    up = series.orderBy("ts_ms", F.desc("_base")).rowsBetween(Window.unboundedPreceding, 0)
    down = series.orderBy(F.desc("ts_ms"), F.desc("_base")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_prev", F.last(base_ts, True).over(up)).withColumn("_next", F.last(base_ts, True).over(down))
    t, d, p, n = F.col("ts_ms"), F.col("_d"), F.col("_prev"), F.col("_next")
    fits = F.when(p.isNull() & n.isNull(), F.lit(True)).when(p.isNull(), t < n - d).when(n.isNull(), t > p + d).otherwise((n - p > 2 * d) & (t > p + d) & (t < n - d))
    if prefer_max:
        # the first sample of the other side after ts - buffer, seen from rows sorted backwards by their search key
        moved = both.withColumn("_key", F.when(F.col("_base"), t - d).otherwise(t)).withColumn("_tie", F.when(~F.col("_base"), 1).when(d > 0, 2).otherwise(0))
        back = Window.partitionBy("lkey", "_h").orderBy(F.desc("_key"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, -1)
        both = moved.withColumn("_other", F.last(F.when(~F.col("_base"), F.struct("ts_ms", "value")), True).over(back)).drop("_key", "_tie")
        near = (F.col("_other.ts_ms") < t + d) | (F.col("_other.ts_ms") == t)
        first = F.col("_base") & F.col("_prev").isNotNull() & (F.min(base_ts).over(series) == t) & (F.min("ts_ms").over(series) >= t - d)
        larger = F.col("_base") & ~first & near & (F.col("_other.value") > F.col("value")) & ~F.isnan("_other.value")
        both = both.withColumn("value", F.when(larger, F.col("_other.value")).otherwise(F.col("value")))
    return both.where(F.col("_base") | fits).select(*names)


def _upper_median(value: str) -> Column:
    """The element in the middle, the upper of two. A group holds its distinct values only."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def _half_medians(both: DataFrame, buffer_ms: int) -> DataFrame:
    """(lkey, _h, _d): half the median interval of the base where it has three intervals, else of both sides, else the buffer."""
    lag = F.lag("ts_ms").over(Window.partitionBy("lkey", "_h", "_base").orderBy("ts_ms"))
    gaps = both.select("lkey", "_h", "_base", (F.col("ts_ms") - lag).alias("gap")).withColumn("gap", F.when(F.col("gap") > 0, F.col("gap"))).withColumn("own", F.when(F.col("_base"), F.col("gap")))
    found = gaps.groupBy("lkey", "_h").agg(F.count("own").alias("n_own"), F.count("gap").alias("n"), _upper_median("own").alias("own"), _upper_median("gap").alias("gap"))
    median = F.when(F.col("n_own") >= 3, F.col("own")).when(F.col("n") >= 3, F.col("gap"))
    return found.select("lkey", "_h", F.coalesce(F.floor(median / 2), F.lit(buffer_ms)).cast("bigint").alias("_d"))


def merge_vectors(vectors: list[DataFrame], prefer_max: bool = False) -> DataFrame:
    """Evaluated vectors (lkey, step, value) of several replicas as one: per series and step the first value that is not zero, in
    the order given, or the largest with prefer_max."""
    every = reduce(lambda a, b: a.unionByName(b), [v.select("lkey", "step", "value", F.lit(i).alias("_i")) for i, v in enumerate(vectors)])
    if prefer_max:
        return every.groupBy("lkey", "step").agg(F.max("value").alias("value"))
    first = F.min_by("value", F.when(F.col("value") == 0, F.col("_i") + len(vectors)).otherwise(F.col("_i")))
    return every.groupBy("lkey", "step").agg(first.alias("value"))


# -------------------------------------------------------------------------------------------- the same series, many groups
def union(groups: list[DataFrame]) -> DataFrame:
    """Side by side; a label set that several groups have is merged with no buffer, the lowest ordinal first."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    if len(groups) == 1:
        return every
    order = Window.partitionBy("lkey", "ts_ms").orderBy("group_ord")
    return every.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def reduced_key(ignore) -> Column:
    return key_of(without(F.col("labels"), sorted(ignore)))


def priority(samples: DataFrame, ignore) -> DataFrame:
    """Series (lkey, group_ord, labels, rkey, place): place 0 is the winner of its bucket, the lowest (ordinal, label set);
    an exact duplicate of the winner has place -1 and gives nothing. Catalog-sized: one row per series and group."""
    # grouped by lkey; a MAP is not grouped here but rebuilt from its key where it is needed
    series = samples.select("lkey", "group_ord", reduced_key(ignore).alias("rkey")).distinct()
    bucket = Window.partitionBy("rkey").orderBy("group_ord", "lkey")
    ranked = series.withColumn("winner", F.first(F.struct("group_ord", "lkey")).over(bucket)).withColumn("place", F.row_number().over(bucket) - 1)
    return ranked.withColumn("place", F.when((F.col("place") > 0) & (F.col("lkey") == F.col("winner.lkey")), -1).otherwise(F.col("place")))


def dedup(groups: list[DataFrame], ignore, fill: bool = True, gap_ms: int = 0) -> DataFrame:
    """One series per bucket of label sets equal but for `ignore`: the winner's labels and samples, its gaps filled from the
    others in order of priority. A single group passes through."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    if len(groups) == 1:
        return every
    every = every.withColumn("rkey", reduced_key(ignore))
    order = Window.partitionBy("rkey").orderBy("group_ord", "lkey")
    placed = every.withColumn("winner", F.first(F.struct("group_ord", "lkey")).over(order))
    copy = (F.col("lkey") == F.col("winner.lkey")) & (F.col("group_ord") != F.col("winner.group_ord"))
    rows = placed.where(~copy).withColumn("place", F.dense_rank().over(order) - 1).withColumn("wkey", F.col("winner.lkey")).drop("winner")
    if not fill:
        return rows.where("place = 0").drop("rkey", "place", "wkey")
    members = priority(every, ignore).where("place >= 0").groupBy("rkey").count().agg(F.max("count")).first()[0] or 1  # reads labels only
    return fill_gaps(rows, members, gap_ms)


def collisions(groups: list[DataFrame], ignore) -> DataFrame:
    """(winner, loser, n): how many series of group `loser` lost to group `winner`."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    lost = priority(every, ignore).where("place > 0")
    return lost.groupBy(F.col("winner.group_ord").alias("winner"), F.col("group_ord").alias("loser")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------------------ gap filling
def _thresholds(rows: DataFrame) -> DataFrame:
    """(rkey, _gap): twice the median interval of the base, else of the first filler, else 1 ms."""
    lag = F.lag("ts_ms").over(Window.partitionBy("rkey", "place").orderBy("ts_ms"))
    steps = rows.where("place < 2").select("rkey", "place", (F.col("ts_ms") - lag).alias("step")).where("step > 0")
    found = steps.groupBy("rkey").agg(*(_upper_median(f"CASE WHEN place = {p} THEN step END").alias(n) for p, n in ((0, "own"), (1, "other"))))
    return found.select("rkey", (2 * F.coalesce("own", "other")).cast("bigint").alias("_gap"))


def fill_gaps(rows: DataFrame, members: int, gap_ms: int = 0) -> DataFrame:
    """rows: samples with rkey, place (0 the base, then the fillers, `members` in all) and wkey.

    Every sample carries the span (_low, _high) that is open for its source. Pass by pass, the samples of one place that lie in
    their span, a quarter of the gap clear of its ends, cut it for the places that follow: the piece between two neighbours (cuts
    or ends of the span) is a gap if it has no low or no high end, if the cut at its low end is a stale marker, or if its length is
    the gap's at least. Samples of later places outside any gap are done with. A filler's stale marker stays only after a
    sample of its own in the span."""
    names = [c for c in rows.columns if c not in ("rkey", "place", "wkey")]
    none = F.lit(None).cast("bigint")
    rows = rows.withColumn("_gap", F.lit(gap_ms).cast("bigint")) if gap_ms > 0 else rows.join(_thresholds(rows), "rkey", "left").withColumn("_gap", F.coalesce("_gap", F.lit(1).cast("bigint")))
    rows = rows.withColumns({"_low": none, "_high": none, "_keep": F.col("place") == 0})
    t, place, gap, margin = F.col("ts_ms"), F.col("place"), F.col("_gap"), F.floor(F.col("_gap") / 4)
    span = Window.partitionBy("rkey", "_low", "_high")
    for level in range(members):
        if level:
            clear = (F.col("_low").isNull() | (t > F.col("_low") + margin)) & (F.col("_high").isNull() | (t < F.col("_high") - margin))
            before = F.lag("stale").over(Window.partitionBy("rkey", "_low", "_high", "place").orderBy("ts_ms"))
            rows = rows.where((place != level) | clear).withColumn("_before", before)
            rows = rows.withColumn("_keep", F.when(place == level, ~F.col("stale") | F.coalesce(~F.col("_before"), F.lit(False))).otherwise(F.col("_keep"))).drop("_before")
        if level + 1 < members:
            cut = F.when(place == level, F.struct("ts_ms", "stale"))
            below = F.last(cut, True).over(span.orderBy("ts_ms", "place").rowsBetween(Window.unboundedPreceding, 0))
            above = F.last(cut, True).over(span.orderBy(F.desc("ts_ms"), "place").rowsBetween(Window.unboundedPreceding, 0))
            rows = rows.withColumns({"_below": below, "_above": above})
            low, high, later = F.coalesce("_below.ts_ms", "_low"), F.coalesce("_above.ts_ms", "_high"), place > level
            is_gap = low.isNull() | high.isNull() | F.coalesce(F.col("_below.stale"), F.lit(False)) | (high - low >= gap)
            rows = rows.where(~later | is_gap).withColumns({"_low": F.when(later, low).otherwise(F.col("_low")), "_high": F.when(later, high).otherwise(F.col("_high"))}).drop("_below", "_above")
    from ..sources.model import labels_of

    kept = F.when(F.col("lkey") == F.col("wkey"), F.col("labels")).otherwise(labels_of(F.col("wkey")))
    hist = [c for c in ("hist",) if c in names]
    return rows.where("_keep").withColumn("labels", kept).withColumn("lkey", F.col("wkey")).select(*[c for c in names if c not in hist], *hist)
