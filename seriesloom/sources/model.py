"""The data model: samples, vectors and step grids as DataFrames.

samples: group_ord, replica, labels MAP, lkey, ts_ms, value, stale[, hist]; one row per sample.
vector:  lkey, step, value[, hist]; one row per series and step. lkey is the exact label set as JSON of its sorted entries,
because a MAP can be neither a join key nor a window partition; labels come back from it where they are needed.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "__name__"
_ENTRIES = "array<struct<key:string,value:string>>"
HIST = "struct<schema:int,count:double,sum:double,zero_threshold:double,zero_count:double,buckets:array<struct<lower:double,upper:double,count:double>>>"
SAMPLES = f"group_ord int, replica int, labels map<string,string>, lkey string, ts_ms bigint, value double, stale boolean, hist {HIST}"
#: Points per query; also what makes a grid small enough to send to every task.
MAX_POINTS = 11_000


def key_of(labels: Column) -> Column:
    """Exact identity of a label set; an empty value is an absent label."""
    return F.to_json(F.array_sort(F.filter(F.map_entries(labels), lambda e: e["value"] != "")))


def labels_of(lkey: Column) -> Column:
    return F.map_from_entries(F.from_json(lkey, _ENTRIES))


#: A JSON string's inside, without backtracking.
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'


def _entry(names) -> str:
    """Pattern of the entries of these labels in a key. A quote inside a value is escaped, so nothing else matches."""
    names = "|".join(re.sub(r"([^\w])", r"\\\1", json.dumps(n, ensure_ascii=False)[1:-1]) for n in names)
    return rf'\{{"key":"(?:{names})","value":"{_INSIDE}"\}}'


def key_without(lkey: Column, names) -> Column:
    """The key of a label set without these labels, cut out of the text: keys are made for every series and step."""
    names = list(dict.fromkeys(names))
    return F.regexp_replace(F.regexp_replace(lkey, _entry(names) + ",?", ""), r",\]$", "]") if names else lkey


def key_only(lkey: Column, names) -> Column:
    """The key of these labels of a label set alone."""
    names = list(dict.fromkeys(names))
    return F.concat(F.lit("["), F.concat_ws(",", F.regexp_extract_all(lkey, F.lit(_entry(names)), F.lit(0))), F.lit("]")) if names else F.lit("[]")


def only(labels: Column, names) -> Column:
    names = list(names)
    return F.map_filter(labels, lambda k, v: k.isin(names)) if names else F.map_filter(labels, lambda k, v: F.lit(False))


def without(labels: Column, names) -> Column:
    names = list(names)
    return F.map_filter(labels, lambda k, v: ~k.isin(names)) if names else labels


def with_labels(labels: Column, added: dict[str, Column]) -> Column:
    """labels with these set; an empty value removes one."""
    new = F.create_map(*[x for k, v in added.items() for x in (F.lit(k), v)])
    return F.map_filter(F.map_concat(without(labels, added), new), lambda k, v: v != "")


def label(labels: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


@dataclass(frozen=True)
class Grid:
    """Evaluation times in ms: start, start + step, ... up to end."""

    start: int
    end: int
    step: int

    def __post_init__(self):
        if self.step <= 0 or self.end < self.start:
            raise ValueError("a grid needs a positive step and an end that is not before its start")
        if self.n > MAX_POINTS:
            raise ValueError(f"exceeded maximum resolution of {MAX_POINTS} points per series")

    @property
    def n(self) -> int:
        return (self.end - self.start) // self.step + 1

    @property
    def last(self) -> int:
        return self.start + (self.n - 1) * self.step

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n, numPartitions=1).select((F.lit(self.start) + F.col("id") * self.step).alias("step"))


def samples(df: DataFrame, labels: dict[str, Column], ts_ms: Column, value: Column, group_ord: int = 0, replica: int = 0) -> DataFrame:
    """Canonical samples from any table; null and empty label values are absent labels."""
    own = F.map_filter(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]), lambda k, v: v != "")
    out = df.select(F.lit(group_ord).alias("group_ord"), F.lit(replica).alias("replica"), own.alias("labels"), ts_ms.cast("bigint").alias("ts_ms"), value.cast("double").alias("value"), F.lit(False).alias("stale"))
    return out.withColumn("lkey", key_of(F.col("labels")))


def epoch_ms(df: DataFrame, name: str) -> Column:
    """A timestamp column as ms, floored. One without time zone is read as UTC, whatever the session's zone is."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_millis(c)
    seconds = F.floor(F.extract(F.lit("SECOND"), c) * 1000)
    return (F.unix_date(c.cast("date")) * F.lit(86_400_000).cast("bigint") + F.hour(c) * 3_600_000 + F.minute(c) * 60_000 + seconds).cast("bigint")


@dataclass(frozen=True)
class TableSource:
    """A table as samples: which columns are labels, time and value. Matchers and time bounds become predicates on the table's own
    columns, so the file scan takes them (and reads no other column) before any label map is built."""

    df: DataFrame
    labels: dict[str, Column]
    ts: str
    value: Column

    def scan(self, matchers=(), low: int | None = None, high: int | None = None) -> DataFrame:
        """Samples with low < ts_ms <= high that match; a matcher on a label the table does not have sees an empty value."""
        from ..operators.selectors import matches_value

        rows = self.df
        if low is not None:
            at = dict(rows.dtypes)[self.ts]
            bound = lambda ms: F.lit(str(datetime(1970, 1, 1) + timedelta(milliseconds=ms))) if at == "timestamp_ntz" else F.timestamp_millis(F.lit(ms))
            rows = rows.where((F.col(self.ts) >= bound(low + 1).cast(at)) & (F.col(self.ts) < bound(high + 1).cast(at)))
        for m in matchers:
            rows = rows.where(matches_value(self.labels.get(m.name), m))
        return samples(rows, self.labels, epoch_ms(rows, self.ts), self.value)


def events_source(spark: SparkSession, sf_dir: str, metric: str = "events_value") -> TableSource:
    """events as series {__name__, event_type, user_id}."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return TableSource(ev, {NAME: F.lit(metric), "event_type": F.col("event_type"), "user_id": F.col("user_id")}, "ts", F.col("value"))


def events_samples(spark: SparkSession, sf_dir: str, metric: str = "events_value") -> DataFrame:
    return events_source(spark, sf_dir, metric).scan()
