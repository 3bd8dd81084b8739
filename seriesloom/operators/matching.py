"""Binary operators: scalars with vectors, and vectors with vectors as equi-joins on (matching labels, step)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import num
from ..plans.syntax import COMPARISONS, SETS, Matching
from ..sources.model import NAME, key_of, key_only, key_without, label, labels_of, with_labels


def arithmetic(op: str, a: Column, b: Column) -> Column:
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: num.div(a, b), "%": lambda: num.mod(a, b), "^": lambda: num.power(a, b), "atan2": lambda: F.atan2(a, b)}[op]()


def nameless(lkey: Column) -> Column:
    """The key without the metric's name; `__name__` sorts before lower-case labels but is taken out wherever it stands."""
    return key_without(lkey, [NAME])


def with_scalar(op: str, vector: DataFrame, scalar: Column, swapped: bool, bool_: bool) -> DataFrame:
    """vector OP scalar, or scalar OP vector if swapped. The scalar is an expression over the row (constant, step or joined)."""
    a, b = (scalar, F.col("value")) if swapped else (F.col("value"), scalar)
    hist = "hist" in vector.columns
    if op in COMPARISONS:
        vector = vector.where(F.col("hist").isNull()) if hist else vector
        hit = num.compare(op, a, b)
        return vector.select(nameless(F.col("lkey")).alias("lkey"), "step", hit.cast("double").alias("value")) if bool_ else vector.where(hit)
    out = [nameless(F.col("lkey")).alias("lkey"), "step", arithmetic(op, a, b).alias("value")]
    if hist and op in ("*", "/") and not (swapped and op == "/"):
        h = F.col("hist")
        f = (lambda x: x * scalar) if op == "*" else (lambda x: num.div(x, scalar))
        return vector.select(*out, F.when(h.isNotNull(), scaled(h, f)).alias("hist"))
    return (vector.where(F.col("hist").isNull()) if hist else vector).select(*out)


def scaled(h: Column, f) -> Column:
    """A native histogram with f applied to all its counts and its sum."""
    buckets = F.transform(h["buckets"], lambda x: F.struct(x["lower"].alias("lower"), x["upper"].alias("upper"), f(x["count"]).alias("count")))
    return F.struct(h["schema"].alias("schema"), f(h["count"]).alias("count"), f(h["sum"]).alias("sum"), h["zero_threshold"].alias("zero_threshold"), f(h["zero_count"]).alias("zero_count"), buckets.alias("buckets"))


def match_key(m: Matching) -> Column:
    return key_only(F.col("lkey"), m.labels) if m.on else key_without(F.col("lkey"), (*m.labels, NAME))


def _floats(v: DataFrame) -> DataFrame:
    return v.where(F.col("hist").isNull()).drop("hist") if "hist" in v.columns else v


def vectors(op: str, left: DataFrame, right: DataFrame, matching: Matching | None, bool_: bool) -> DataFrame:
    m = matching or Matching()
    left, right = _floats(left).select("lkey", "step", "value"), _floats(right).select("lkey", "step", "value")
    left, right = left.withColumn("mkey", match_key(m)), right.withColumn("mkey", match_key(m))
    on = ["mkey", "step"]
    if op in SETS:
        if op == "and":
            return left.join(right.select(*on), on, "left_semi").select("lkey", "step", "value")
        if op == "unless":
            return left.join(right.select(*on), on, "left_anti").select("lkey", "step", "value")
        return left.unionByName(right.join(left.select(*on), on, "left_anti").select(*left.columns)).select("lkey", "step", "value")
    if m.card == "one-to-many":
        left, right = right, left
    one_to_one = m.card == "one-to-one"
    many = _single(left, "left" if m.card != "one-to-many" else "right") if one_to_one else left
    one = _single(right, "right" if m.card != "one-to-many" else "left").select(*on, F.col("lkey").alias("okey"), F.col("value").alias("ovalue"))
    both = many.join(one, on)
    a, b = (F.col("ovalue"), F.col("value")) if m.card == "one-to-many" else (F.col("value"), F.col("ovalue"))
    drops = op not in COMPARISONS or bool_
    dropped = [NAME] if drops else []
    if one_to_one:
        key = F.col("mkey") if m.on else key_without(F.col("lkey"), (*m.labels, *dropped))
    elif m.include:
        other = labels_of(F.col("okey"))
        key = key_of(with_labels(labels_of(key_without(F.col("lkey"), dropped)), {x: label(other, x) for x in m.include}))
    else:
        key = key_without(F.col("lkey"), dropped)
    if op in COMPARISONS:
        hit = num.compare(op, a, b)
        if bool_:
            return both.select(key.alias("lkey"), "step", hit.cast("double").alias("value"))
        return both.where(hit).select(key.alias("lkey"), "step", a.alias("value"))
    return both.select(key.alias("lkey"), "step", arithmetic(op, a, b).alias("value"))


def _single(side: DataFrame, name: str) -> DataFrame:
    """One row per (mkey, step), or an error when the plan runs. The join that follows reuses the grouping's partitioning."""
    rows = side.groupBy("mkey", "step").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("lkey", "value")).alias("r"))
    message = F.concat(F.lit(f"found duplicate series for the match group on the {name} side of the operation: many-to-many matching not allowed: "), F.col("mkey"))
    checked = F.when(F.col("n") > 1, F.raise_error(message).cast("double")).otherwise(F.col("r.value"))  # on the value: no plan prunes it
    return rows.select("mkey", "step", F.col("r.lkey").alias("lkey"), checked.alias("value"))
