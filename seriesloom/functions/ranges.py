"""Functions over range vectors: one aggregate per series and step.

Each takes the window frame's columns (value, ts, ets, step and, for those in PREVIOUS, pv and pts) and returns named aggregates
and an expression over them; the planner runs a single groupBy. All but quantile, deviation and smoothing, which hold one
window's values, combine partially.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import num

PREVIOUS = {"rate", "increase", "irate", "idelta", "changes", "resets"}
EXPERIMENTAL = {"mad_over_time", "double_exponential_smoothing", "ts_of_last_over_time", "ts_of_max_over_time", "ts_of_min_over_time", "ts_of_first_over_time", "first_over_time"}
KEEPS_NAME = {"last_over_time", "first_over_time"}


def functions() -> dict:
    """Built anew for each plan: columns need a running session."""
    v, ts, ets, step = F.col("value"), F.col("ts"), F.col("ets"), F.col("step")
    pv, pts = F.col("pv"), F.col("pts")

    def _simple(agg: Column):
        return lambda span, *a: ({"x": agg}, F.col("x"))

    def _extrapolated(counter: bool, per_second: bool):
        def f(span, *a):
            aggs = {"fv": F.min_by("value", ets), "ft": F.min(ets), "lv": F.max_by("value", ets), "lt": F.max(ets), "n": F.count(F.lit(1))}  # plain types: hash aggregation
            if counter:
                aggs["r"] = F.coalesce(F.sum(F.when(v < pv, pv)), num.lit(0))
            res = F.col("lv") - F.col("fv") + (F.col("r") if counter else 0)
            sampled = ((F.col("lt") - F.col("ft")) / 1000.0).cast("double")
            mean = F.try_divide(sampled, F.col("n") - 1)
            before, after = (F.col("ft") - F.col("step") + span) / 1000.0, (F.col("step") - F.col("lt")) / 1000.0
            head = F.when(before >= mean * 1.1, mean / 2).otherwise(before)
            if counter:
                zero = F.when((res > 0) & (F.col("fv") >= 0), F.try_divide(sampled * F.col("fv"), res))
                head = F.least(head, F.coalesce(zero, head))
            tail = F.when(after >= mean * 1.1, mean / 2).otherwise(after)
            out = res * F.try_divide(sampled + head + tail, sampled)
            return aggs, F.when((F.col("n") >= 2) & (sampled > 0), out / (span / 1000.0) if per_second else out)

        return f

    def _last_two(rate: bool):
        def f(span, *a):
            a, b = F.col("lv"), F.col("lp")
            diff = F.when(a < b, a).otherwise(a - b) if rate else a - b
            gap = (F.col("lt") - F.col("lpt")) / 1000.0
            aggs = {"lv": F.max_by("value", ts), "lp": F.max_by("pv", ts), "lt": F.max(ts), "lpt": F.max_by("pts", ts)}
            return aggs, F.when(F.col("lpt").isNotNull() & (gap > 0), F.try_divide(diff, gap) if rate else diff)

        return f

    def _line(ahead):
        """Least squares, by Spark's numerically stable regression aggregates; a constant series has slope 0 exactly."""
        t = (ts - step) / 1000.0
        aggs = {"n": F.count(F.lit(1)), "m": F.regr_slope(v, t), "c": F.regr_intercept(v, t), "lo": F.min("value"), "hi": F.max("value")}
        flat = (F.col("lo") == F.col("hi")) & ~F.isnan("lo")
        slope = F.when(flat, num.lit(0)).otherwise(F.col("m"))
        out = slope if ahead is None else F.when(flat, F.col("lo")).otherwise(F.col("c")) + slope * ahead
        return aggs, F.when(F.col("n") >= 2, out)

    def _mad(span, *a):
        return {"x": F.collect_list("value")}, num.let(num.quantile(0.5, F.col("x")), lambda m: num.quantile(0.5, F.transform(F.col("x"), lambda y: F.abs(y - m))))

    def _smoothed(span, sf: Column, tf: Column):
        """Holt's double smoothing, in time order: s = sf x + (1 - sf)(s + b), b = tf (s - s') + (1 - tf) b, started with the first
        value and the first difference."""
        x = F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda e: e["value"])
        start = F.struct(F.get("x", F.lit(0)).alias("s"), (F.get("x", F.lit(1)) - F.get("x", F.lit(0))).alias("b"))

        def fold(acc, y):
            s = sf * y + (1 - sf) * (acc["s"] + acc["b"])
            return F.struct(s.alias("s"), (tf * (s - acc["s"]) + (1 - tf) * acc["b"]).alias("b"))

        return {"x": x}, F.when(F.size("x") >= 2, F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), start, fold)["s"])

    return {
        "rate": _extrapolated(True, True),
        "increase": _extrapolated(True, False),
        "delta": _extrapolated(False, False),
        "irate": _last_two(True),
        "idelta": _last_two(False),
        "deriv": lambda span, *a: _line(None),
        "predict_linear": lambda span, ahead: _line(ahead),
        "avg_over_time": _simple(F.avg("value")),
        "sum_over_time": _simple(F.sum("value")),
        "min_over_time": _simple(F.min("value")),
        "max_over_time": _simple(num.nan_max(v)),
        "count_over_time": _simple(F.count(F.lit(1)).cast("double")),
        "last_over_time": _simple(F.max_by("value", ts)),
        "first_over_time": _simple(F.min_by("value", ts)),
        "present_over_time": _simple(F.max(num.lit(1))),
        "quantile_over_time": lambda span, q: ({"x": F.collect_list("value")}, num.quantile(q, F.col("x"))),
        "stddev_over_time": _simple(F.stddev_pop("value")),
        "stdvar_over_time": _simple(F.var_pop("value")),
        "mad_over_time": _mad,
        "changes": _simple(F.sum(F.when(pv.isNotNull() & (v != pv) & ~(F.isnan(v) & F.isnan(pv)), 1.0).otherwise(0.0))),
        "resets": _simple(F.sum(F.when(v < pv, 1.0).otherwise(0.0))),
        "double_exponential_smoothing": _smoothed,
        "ts_of_last_over_time": _simple(F.max(ts) / 1000.0),
        "ts_of_first_over_time": _simple(F.min(ts) / 1000.0),
        "ts_of_max_over_time": _simple(F.max(F.struct(F.when(F.isnan(v), num.lit(-num.INF)).otherwise(v), ts))["ts"] / 1000.0),
        "ts_of_min_over_time": _simple(-F.min(F.struct(v, (-ts).alias("t")))["t"] / 1000.0),
    }
