"""Histogram functions: classic buckets (series with an `le` label) and native histograms (a struct column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.model import NAME, key_without, label, labels_of
from . import num


def classic_groups(vector: DataFrame) -> DataFrame:
    """lkey (labels without le and name), step, b: buckets ascending, equal bounds added, counts made monotone."""
    labels = labels_of(F.col("lkey"))
    rows = vector.where(F.col("value").isNotNull()).withColumn("le", _bound(label(labels, "le")))
    rows = rows.where(F.col("le").isNotNull()).select(key_without(F.col("lkey"), ["le", NAME]).alias("lkey"), "step", "le", "value")
    sums = rows.groupBy("lkey", "step", "le").agg(F.sum("value").alias("c"))
    b = F.array_sort(F.collect_list(F.struct("le", "c")))
    grouped = sums.groupBy("lkey", "step").agg(b.alias("b"))
    return grouped.withColumn("b", F.transform("b", lambda x, i: F.struct(x["le"].alias("le"), F.array_max(F.transform(F.slice(F.col("b"), 1, i + 1), lambda y: y["c"])).alias("c"))))


def _bound(text: Column) -> Column:
    return F.when(text.isin("+Inf", "Inf", "inf"), num.lit(num.INF)).otherwise(text.try_cast("double"))


def classic_quantile(q: Column) -> Column:
    b = F.col("b")
    n = F.size(b)
    total = F.element_at(b, -1)["c"]
    rank = q * total
    at = F.size(F.filter(b, lambda x: x["c"] < rank))
    upper, below = F.get(b, at), F.get(b, at - 1)
    start = F.when(at == 0, num.lit(0)).otherwise(below["le"])
    under = F.when(at == 0, num.lit(0)).otherwise(below["c"])
    value = (
        F.when(at >= n - 1, F.get(b, n - 2)["le"]).when((at == 0) & (upper["le"] <= 0), upper["le"])
        .otherwise(start + (upper["le"] - start) * F.coalesce(F.try_divide(rank - under, upper["c"] - under), num.lit(num.NAN)))
    )
    return (
        F.when(F.isnan(q) | (n < 2) | (F.element_at(b, -1)["le"] != num.INF) | (total == 0) | F.isnan(total), num.lit(num.NAN))
        .when(q < 0, num.lit(-num.INF)).when(q > 1, num.lit(num.INF)).otherwise(value)
    )


def classic_fraction(low: Column, high: Column) -> Column:
    b = F.col("b")
    n = F.size(b)
    total = F.element_at(b, -1)["c"]

    def rank(x: Column) -> Column:
        at = F.size(F.filter(b, lambda e: e["le"] <= x))  # buckets wholly at or below x
        start = F.when(at == 0, F.least(num.lit(0), F.get(b, F.lit(0))["le"])).otherwise(F.get(b, at - 1)["le"])
        under = F.when(at == 0, num.lit(0)).otherwise(F.get(b, at - 1)["c"])
        upper = F.get(b, at)
        part = F.when(x <= start, num.lit(0)).when(upper["le"] == num.INF, num.lit(0)).otherwise(F.coalesce(F.try_divide(x - start, upper["le"] - start), num.lit(0)))
        return F.when(at >= n, total).otherwise(under + (upper["c"] - under) * part)

    return F.when(F.isnan(low) | F.isnan(high) | (n < 2) | (F.element_at(b, -1)["le"] != num.INF) | (total == 0), num.lit(num.NAN)).when(low >= high, num.lit(0)).otherwise((rank(high) - rank(low)) / total)


# ------------------------------------------------------------------------------------------------------------ native
def _middle(h: Column, x: Column) -> Column:
    product = F.sqrt(F.abs(x["lower"] * x["upper"]))
    linear = (x["lower"] + x["upper"]) / 2
    return F.when((x["lower"] <= 0) & (x["upper"] >= 0), num.lit(0)).when(h["schema"] == -53, linear).when(x["upper"] < 0, -product).otherwise(product)


def _all_buckets(h: Column) -> Column:
    zero = F.struct((-h["zero_threshold"]).alias("lower"), h["zero_threshold"].alias("upper"), h["zero_count"].alias("count"))
    full = F.when(h["zero_count"] > 0, F.concat(h["buckets"], F.array(zero))).otherwise(h["buckets"])
    return F.array_sort(F.filter(full, lambda x: x["count"] > 0))


def native_variance(h: Column) -> Column:
    mean = num.div(h["sum"], h["count"])
    total = F.aggregate(_all_buckets(h), num.lit(0), lambda a, x: a + x["count"] * F.pow(_middle(h, x) - mean, 2))
    return num.div(total, h["count"])


def native_quantile(q: Column, h: Column) -> Column:
    b = _all_buckets(h)
    rank = q * h["count"]
    state = F.struct(num.lit(0).alias("under"), num.lit(num.NAN).alias("value"), F.lit(False).alias("done"))

    def fold(a, x):
        here = ~a["done"] & (a["under"] + x["count"] >= rank)
        part = num.div(rank - a["under"], x["count"])
        linear = (h["schema"] == -53) | ((x["lower"] <= 0) & (x["upper"] >= 0))
        low = F.when((x["lower"] < 0) & (x["upper"] > 0) & (F.size(F.filter(h["buckets"], lambda y: y["upper"] <= 0)) == 0), num.lit(0)).otherwise(x["lower"])
        inside = F.when(linear, low + (x["upper"] - low) * part).when(x["lower"] > 0, x["lower"] * F.pow(x["upper"] / x["lower"], part)).otherwise(-F.abs(x["lower"]) * F.pow(x["upper"] / x["lower"], part))
        return F.struct((a["under"] + x["count"]).alias("under"), F.when(here, inside).otherwise(a["value"]).alias("value"), (a["done"] | here).alias("done"))

    return F.when(F.isnan(q) | (h["count"] == 0), num.lit(num.NAN)).when(q < 0, num.lit(-num.INF)).when(q > 1, num.lit(num.INF)).otherwise(F.aggregate(b, state, fold)["value"])


def native_fraction(low: Column, high: Column, h: Column) -> Column:
    """Inside a bucket linear for custom bounds and around zero, else on the logarithm, as bounds grow exponentially."""

    def share(x):
        a, b = F.greatest(x["lower"], low), F.least(x["upper"], high)
        linear = (h["schema"] == -53) | ((x["lower"] <= 0) & (x["upper"] >= 0))
        on_line = F.coalesce(F.try_divide(b - a, x["upper"] - x["lower"]), num.lit(1))
        on_log = F.coalesce(F.try_divide(F.log2(b / a), F.log2(x["upper"] / x["lower"])), num.lit(1))
        return F.when(b <= a, num.lit(0)).when(linear, x["count"] * on_line).otherwise(x["count"] * on_log)

    total = F.aggregate(_all_buckets(h), num.lit(0), lambda s, x: s + share(x))
    return F.when(F.isnan(low) | F.isnan(high) | (h["count"] == 0), num.lit(num.NAN)).when(low >= high, num.lit(0)).otherwise(total / h["count"])


NATIVE = {
    "histogram_count": lambda h: h["count"], "histogram_sum": lambda h: h["sum"], "histogram_avg": lambda h: num.div(h["sum"], h["count"]),
    "histogram_stdvar": native_variance, "histogram_stddev": lambda h: F.sqrt(native_variance(h)),
}


def native_sum(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Weighted sum of the histograms of each (lkey, step). Those of one schema and zero threshold are added first, bucket by
    bucket, with partial sums; what is left meets on the coarsest schema and the widest zero bucket, which takes in the buckets it
    reaches into. Custom bounds (schema -53) meet where they are equal; with exponential ones they give no result."""
    rows = rows.where(F.col("hist").isNotNull()).select("lkey", "step", "hist", (num.lit(1) if weight is None else weight).alias("w"))
    kind = ["lkey", "step", F.col("hist.schema").alias("schema"), F.col("hist.zero_threshold").alias("zero_threshold")]
    names = ["lkey", "step", "schema", "zero_threshold"]
    heads = rows.groupBy(*kind).agg(*(F.sum(F.col(f"hist.{x}") * F.col("w")).alias(x) for x in ("count", "sum", "zero_count")))
    none = F.lit(None).cast("double")
    parts = rows.select(*kind, "w", F.explode("hist.buckets").alias("b")).groupBy(*names, F.col("b.lower").alias("lower"), F.col("b.upper").alias("upper")).agg(F.sum(F.col("b.count") * F.col("w")).alias("n"))
    both = heads.select(*names, "count", "sum", "zero_count", none.alias("lower"), none.alias("upper"), none.alias("n")).unionByName(parts.select(*names, none.alias("count"), none.alias("sum"), none.alias("zero_count"), "lower", "upper", "n"))
    group = Window.partitionBy("lkey", "step")
    near, far = F.least(F.abs("lower"), F.abs("upper")), F.greatest(F.abs("lower"), F.abs("upper"))
    both = both.withColumn("coarse", F.min("schema").over(group)).withColumn("fine", F.max("schema").over(group)).withColumn("zt", F.max("zero_threshold").over(group))
    both = both.where(~((F.col("coarse") == -53) & (F.col("fine") != -53)))
    index = F.ceil(F.round(F.log2(far) * F.pow(num.lit(2), F.col("schema"))) / F.pow(num.lit(2), F.col("schema") - F.col("coarse")))
    moved = (F.col("coarse") != F.col("fine")) & F.col("n").isNotNull()
    size = F.pow(num.lit(2), F.col("coarse"))
    both = both.withColumn("far", F.when(moved, F.pow(num.lit(2), index / size)).otherwise(far)).withColumn("near", F.when(moved, F.pow(num.lit(2), (index - 1) / size)).otherwise(near))
    both = both.withColumn("zt", F.greatest("zt", F.coalesce(F.max(F.when((F.col("coarse") != -53) & (F.col("near") < F.col("zt")) & (F.col("n") != 0), F.col("far"))).over(group), F.col("zt"))))
    in_zero = (F.col("coarse") != -53) & (F.col("far") <= F.col("zt"))
    below = F.col("upper") <= 0
    plain = (F.col("coarse") == -53) | ~moved
    both = both.withColumn("lower", F.when(plain, F.col("lower")).when(below, -F.col("far")).otherwise(F.col("near"))).withColumn("upper", F.when(plain, F.col("upper")).when(below, -F.col("near")).otherwise(F.col("far")))
    both = both.withColumn("zero_count", F.when(F.col("n").isNotNull() & in_zero, F.col("n")).otherwise(F.col("zero_count"))).withColumn("in", F.col("n").isNotNull() & ~in_zero)
    merged = both.groupBy("lkey", "step", F.when(F.col("in"), F.col("lower")).alias("lower"), F.when(F.col("in"), F.col("upper")).alias("upper")).agg(
        *(F.sum(x).alias(x) for x in ("count", "sum", "zero_count")), F.sum(F.when(F.col("in"), F.col("n"))).alias("n"), F.max("coarse").alias("schema"), F.max("zt").alias("zero_threshold")
    )
    bucket = F.struct("lower", "upper", F.col("n").alias("count"))
    whole = merged.groupBy("lkey", "step").agg(
        *(F.sum(x).alias(x) for x in ("count", "sum")), F.coalesce(F.sum("zero_count"), num.lit(0)).alias("zero_count"), F.max("schema").alias("schema"), F.max("zero_threshold").alias("zero_threshold"),
        F.array_sort(F.collect_list(F.when(F.col("lower").isNotNull() & (F.col("n") != 0), bucket))).alias("buckets"),
    )
    return whole.select("lkey", "step", F.lit(None).cast("double").alias("value"), F.struct("schema", "count", "sum", "zero_threshold", "zero_count", "buckets").alias("hist"))


def native_mean(rows: DataFrame) -> DataFrame:
    """Mean of the histograms of each (lkey, step)."""
    from ..operators.matching import scaled

    n = rows.where(F.col("hist").isNotNull()).groupBy("lkey", "step").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return native_sum(rows).join(n, ["lkey", "step"]).select("lkey", "step", "value", scaled(F.col("hist"), lambda x: x / F.col("n")).alias("hist"))


def lost_counts(before: Column, now: Column) -> Column:
    """Whether a histogram has less than the one before in any of its counts: a counter reset. Of unlike schemas the totals tell."""
    counts = F.map_from_entries(F.transform(now["buckets"], lambda x: F.struct(x["lower"], x["count"])))
    fewer = F.exists(before["buckets"], lambda x: x["count"] > F.coalesce(F.try_element_at(counts, x["lower"]), num.lit(0)))
    return (now["count"] < before["count"]) | (now["zero_count"] < before["zero_count"]) | ((now["schema"] == before["schema"]) & fewer)


#: Functions of windows of histograms; those in ALONE give nothing for a window that holds floats as well.
ALONE = {"rate", "increase", "delta", "irate", "idelta", "sum_over_time", "avg_over_time"}
RANGED = ALONE | {"count_over_time", "present_over_time", "last_over_time", "first_over_time"}


def over_windows(name: str, rows: DataFrame, span: int) -> DataFrame:
    """A function of RANGED over windows of histograms (lkey, step, ets, hist, nets, nlost: the next sample's time, and whether it
    lost counts): each is a weighted sum of the window's samples. An increase takes the last, gives back the first and adds the
    sample before every reset, times the factor that extrapolates to the window's ends."""
    window = Window.partitionBy("lkey", "step")
    rows = rows.withColumns({"ft": F.min("ets").over(window), "lt": F.max("ets").over(window), "n": F.count(F.lit(1)).over(window)})
    ets, step = F.col("ets"), F.col("step")
    first, last = (ets == F.col("ft")).cast("double"), (ets == F.col("lt")).cast("double")
    inside = F.coalesce(F.col("nets") <= step, F.lit(False))
    reset = F.when(inside & F.col("nlost"), num.lit(1)).otherwise(num.lit(0))
    if name in ("last_over_time", "first_over_time"):
        return native_sum(rows.where(last == 1 if name == "last_over_time" else first == 1))
    if name == "sum_over_time":
        return native_sum(rows)
    if name == "avg_over_time":
        return native_mean(rows)
    rows = rows.where("n > 1")
    if name in ("irate", "idelta"):
        before = inside & (F.col("nets") == F.col("lt"))
        lost = F.col("nlost") if name == "irate" else F.lit(False)
        gap = (F.col("nets") - ets) / 1000.0 if name == "irate" else num.lit(1)
        latest = rows.withColumn("gap", F.max(F.when(before, gap)).over(window))
        return native_sum(latest, (last - F.when(before & ~lost, num.lit(1)).otherwise(num.lit(0))) / F.col("gap"))
    sampled = ((F.col("lt") - F.col("ft")) / 1000.0).cast("double")
    mean = sampled / (F.col("n") - 1)
    ends = ((F.col("ft") - step + span) / 1000.0, (step - F.col("lt")) / 1000.0)
    factor = F.try_divide(sampled + sum((F.when(e >= mean * 1.1, mean / 2).otherwise(e) for e in ends), num.lit(0)), sampled) / (span / 1000.0 if name == "rate" else 1.0)
    weight = (last - first + (reset if name != "delta" else num.lit(0))) * factor
    return native_sum(rows.withColumn("weight", weight).where("weight <> 0 OR ets = lt"), F.col("weight"))
