"""Metadata queries: label names and values, series, metric metadata, exemplars, cardinality, federation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.selectors import select
from .model import NAME, key_of, label, labels_of, without


def label_names(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode(F.map_keys("labels")).alias("name")).distinct().orderBy("name")


def label_values(samples: DataFrame, name: str) -> DataFrame:
    return samples.select(label(F.col("labels"), name).alias("value")).where("value <> ''").distinct().orderBy("value")


def series(samples: DataFrame) -> DataFrame:
    return samples.select("lkey").distinct().orderBy("lkey").withColumn("labels", labels_of(F.col("lkey")))


def deduped_series(samples: DataFrame, ignore) -> DataFrame:
    """One label set per bucket, of the lowest ordinal."""
    found = samples.select("lkey", "group_ord", key_of(without(F.col("labels"), sorted(ignore))).alias("rkey"))
    best = found.groupBy("rkey").agg(F.min(F.struct("group_ord", "lkey")).alias("best"))
    return best.select(F.col("best.lkey").alias("lkey")).distinct().orderBy("lkey").withColumn("labels", labels_of(F.col("lkey")))


def metric_metadata(metadata: DataFrame, limit: int = 0, metric: str | None = None) -> DataFrame:
    """metadata(group_ord, metric, type, help, unit): the entries of the lowest group that has the metric; limit trims metrics."""
    rows = metadata.where(F.col("metric") == metric) if metric else metadata
    first = rows.groupBy("metric").agg(F.min("group_ord").alias("group_ord"))
    if limit > 0:
        first = first.orderBy("metric").limit(limit)
    return rows.join(first, ["metric", "group_ord"]).select("metric", "type", "help", "unit").distinct().orderBy("metric", "type", "help", "unit")


def exemplars(rows: DataFrame, matchers, start: int, end: int) -> DataFrame:
    """rows(series_labels, ex_labels, value, ts_ms): of each series that matches, its exemplars in time order. The list is bounded
    by the time range asked for."""
    own = rows.withColumn("labels", F.col("series_labels"))
    hit = select(own, matchers).where(F.col("ts_ms").between(start, end))
    keyed = hit.select(key_of(F.col("labels")).alias("lkey"), F.struct(F.col("ts_ms"), F.col("value"), key_of(F.col("ex_labels")).alias("ex_key")).alias("e"))
    out = keyed.groupBy("lkey").agg(F.array_sort(F.collect_set("e")).alias("exemplars"))
    return out.orderBy("lkey").withColumn("labels", labels_of(F.col("lkey")))


def cardinality(samples: DataFrame, top: int = 10, focus: str | None = None) -> dict[str, DataFrame]:
    """Per group: totals, and the `top` largest of series by metric, series by label pair, values by label name and, for a focus
    label, series by its values. Groups are never added up."""
    if not 1 <= top <= 1000:
        raise ValueError("top must be 1 to 1000")
    own = samples.select("group_ord", "lkey").distinct()
    pairs = own.select("group_ord", "lkey", F.explode(labels_of(F.col("lkey"))).alias("name", "value"))

    def largest(rows: DataFrame, name: Column, count: Column) -> DataFrame:
        found = rows.groupBy("group_ord", name.alias("name")).agg(count.alias("n"))
        place = F.row_number().over(Window.partitionBy("group_ord").orderBy(F.desc("n"), "name"))
        return found.withColumn("place", place).where(F.col("place") <= top).drop("place").orderBy("group_ord", F.desc("n"), "name")

    n = F.count(F.lit(1))
    out = {
        "totals": own.groupBy("group_ord").agg(n.alias("series")).join(pairs.groupBy("group_ord").agg(F.countDistinct("name", "value").alias("label_pairs")), "group_ord").orderBy("group_ord"),
        "series_by_metric": largest(pairs.where(F.col("name") == NAME), F.col("value"), n),
        "series_by_pair": largest(pairs, F.concat_ws("=", "name", "value"), n),
        "values_by_label": largest(pairs, F.col("name"), F.countDistinct("value")),
    }
    if focus:
        out["series_by_focus"] = largest(pairs.where(F.col("name") == focus), F.col("value"), n)
    return out


def federate(samples: DataFrame, selectors, now: int, lookback: int = 300_000, external: dict[str, str] | None = None) -> DataFrame:
    """Newest sample of each series that any selector matches, unless stale; external labels added where a series has none of
    that name, an empty `instance` where it has none; sorted by metric, then labels."""
    near = samples.where((F.col("ts_ms") > now - lookback) & (F.col("ts_ms") <= now))
    if "hist" in near.columns:
        near = near.where(F.col("hist").isNull())
    hits = [select(near, m) for m in selectors]
    rows = hits[0]
    for h in hits[1:]:
        rows = rows.unionByName(h)
    latest = rows.groupBy("lkey").agg(F.max_by(F.struct("value", "stale", "ts_ms"), "ts_ms").alias("s")).where(~F.col("s.stale"))
    labels = labels_of(F.col("lkey"))
    if external:
        extra = F.create_map(*[F.lit(x) for kv in external.items() for x in kv])
        labels = F.map_concat(F.map_filter(extra, lambda k, v: F.try_element_at(labels_of(F.col("lkey")), k).isNull()), labels)
    return latest.select(labels.alias("labels"), F.col("s.value").alias("value"), F.col("s.ts_ms").alias("ts_ms")).withColumn("lkey", key_of(F.col("labels"))).orderBy(label(F.col("labels"), NAME), "lkey")


def capped(df: DataFrame, max_series: int, max_samples: int) -> tuple[DataFrame, DataFrame]:
    """At most so many series, and samples of them, in key order, and (series, samples, shown_series, shown_samples) as one row."""
    kept = df.select("lkey").distinct().orderBy("lkey").limit(max_series)
    order = [c for c in ("step", "ts_ms") if c in df.columns]
    shown = df.join(F.broadcast(kept), "lkey", "left_semi").orderBy("lkey", *order).limit(max_samples)
    n = lambda x, name: x.agg(F.countDistinct("lkey").alias(f"{name}series"), F.count(F.lit(1)).alias(f"{name}samples"))
    return shown, n(df, "").crossJoin(n(shown, "shown_"))  # one row beside one row


def truncate(df: DataFrame, max_series: int, max_samples: int) -> tuple[DataFrame, dict[str, int]]:
    """At most so many series, and samples of them, in key order, and how many there were: the caps of an interactive tool."""
    keys = df.select("lkey").distinct()
    n_series, n_samples = keys.count(), df.count()
    kept = keys.orderBy("lkey").limit(max_series)
    order = "step" if "step" in df.columns else "ts_ms"
    return df.join(kept, "lkey", "left_semi").orderBy("lkey", order).limit(max_samples), {"series": n_series, "samples": n_samples, "shown_series": min(n_series, max_series), "shown_samples": min(n_samples, max_samples)}


