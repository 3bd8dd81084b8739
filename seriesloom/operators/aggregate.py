"""Aggregation over series: by / without, per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import num
from ..functions.histograms import native_mean, native_sum
from ..plans.syntax import Aggregate
from ..sources.model import NAME, key_of, key_only, key_without, labels_of, only, with_labels, without


def group_key(node: Aggregate) -> Column:
    """Key of the labels that a group keeps. `by ()` and no clause at all keep none, without reading the labels."""
    if node.without:
        return key_without(F.col("lkey"), (*node.labels, NAME))
    return key_only(F.col("lkey"), node.labels)


def _aggregates(op: str) -> Column:
    v = F.col("value")
    return {
        "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "count": lambda: F.count(F.lit(1)).cast("double"), "min": lambda: F.min(v), "max": lambda: num.nan_max(v),
        "group": lambda: F.max(num.lit(1)), "stddev": lambda: F.stddev_pop(v), "stdvar": lambda: F.var_pop(v),
    }[op]()


def aggregate(node: Aggregate, vector: DataFrame, param: float | str | Column | None) -> DataFrame:
    """param is a constant, or a column of the vector where it differs by step."""
    op, hist = node.op, "hist" in vector.columns
    key = group_key(node)
    if op == "count_values":
        labels = with_labels(only(labels_of(F.col("lkey")), node.labels) if not node.without else without(labels_of(F.col("lkey")), (*node.labels, NAME)), {param: num.sample_text(F.col("value"))})
        return vector.select(key_of(labels).alias("lkey"), "step").groupBy("lkey", "step").agg(F.count(F.lit(1)).cast("double").alias("value"))
    if op in ("topk", "bottomk", "limitk", "limit_ratio"):
        return _picked(op, vector.withColumn("gkey", key), param).drop("gkey")
    if hist and op in ("sum", "avg"):
        rows = vector.select(key.alias("lkey"), "step", "value", "hist")
        floats = rows.where(F.col("hist").isNull()).groupBy("lkey", "step").agg(_aggregates(op).alias("value"))
        return floats.withColumn("hist", F.lit(None).cast(vector.schema["hist"].dataType)).unionByName(native_mean(rows) if op == "avg" else native_sum(rows))
    if hist and op not in ("count", "group"):
        vector = vector.where(F.col("hist").isNull())
    if op == "quantile":
        return _quantile(vector.select(key.alias("lkey"), "step", "value", (param if isinstance(param, Column) else num.lit(float(param))).alias("q")))
    rows = vector.select(key.alias("lkey"), "step", "value")
    return rows.groupBy("lkey", "step").agg(_aggregates(op).alias("value"))


def _quantile(rows: DataFrame) -> DataFrame:
    """Linear interpolation between the two ranks, by sorting each group; NaN sorts first. No task holds a group."""
    group = Window.partitionBy("lkey", "step")
    order = group.orderBy(F.desc(F.isnan("value")), "value")
    placed = rows.withColumn("n", F.count(F.lit(1)).over(group)).withColumn("place", F.row_number().over(order) - 1)
    rank = F.greatest(F.least(F.col("q"), num.lit(1)), num.lit(0)) * (F.col("n") - 1)
    low = F.floor(rank)
    found = placed.withColumn("weight", rank - low).withColumn("low", low).where((F.col("place") == F.col("low")) | (F.col("place") == F.least(F.col("low") + 1, F.col("n") - 1)) | (F.col("place") == 0))
    ends = found.groupBy("lkey", "step").agg(
        F.max("q").alias("q"), F.max("weight").alias("weight"), F.max(F.when(F.col("place") == F.col("low"), F.col("value"))).alias("a"), F.max(F.when(F.col("place") == F.least(F.col("low") + 1, F.col("n") - 1), F.col("value"))).alias("b")
    )
    inside = F.when(F.col("weight") == 0, F.col("a")).otherwise(F.col("a") * (1 - F.col("weight")) + F.col("b") * F.col("weight"))
    return ends.select("lkey", "step", F.when(F.isnan("q"), num.lit(num.NAN)).when(F.col("q") < 0, num.lit(-num.INF)).when(F.col("q") > 1, num.lit(num.INF)).otherwise(inside).alias("value"))


def _picked(op: str, rows: DataFrame, param) -> DataFrame:
    """Rows that stay, with all their labels. Limits that are constant are pruned in each task before the shuffle."""
    if op == "limit_ratio":
        share = F.pmod(F.xxhash64("lkey"), F.lit(1 << 32)) / float(1 << 32)
        r = F.greatest(F.least(param if isinstance(param, Column) else num.lit(float(param)), num.lit(1)), num.lit(-1))
        return rows.where(F.when(r >= 0, share < r).otherwise(share >= 1 + r))
    if isinstance(param, Column):
        k = F.when(F.isnan(param), F.lit(0)).otherwise(F.least(F.greatest(param, num.lit(0)), num.lit(2**31 - 1)).cast("int"))
        rows = rows.where(k >= 1)
    else:
        k = int(min(float(param), 2**31 - 1)) if float(param) == float(param) else 0
        if k < 1:
            return rows.limit(0)
    order = {
        "topk": (F.isnan("value"), F.desc("value"), "lkey"), "bottomk": (F.isnan("value"), F.asc("value"), "lkey"), "limitk": (F.xxhash64("lkey"), "lkey"),
    }[op]
    if op != "limitk" and "hist" in rows.columns:
        rows = rows.where(F.col("hist").isNull())
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("gkey", "step").orderBy(*order))).where(F.col("place") <= k).drop("place")
