"""IEEE-754 arithmetic and comparison over DOUBLE columns.

Spark raises on division by zero in ANSI mode, gives NULL for logarithms of non-positive numbers and orders NaN as the largest
value, equal to itself; the query language wants plain floating-point behaviour.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def lit(x: float) -> Column:
    return F.lit(float(x))


def div(a: Column, b: Column) -> Column:
    zero = F.when(a.isNull() | F.isnan(a) | (a == 0), lit(NAN)).otherwise(F.signum(a) * F.when(is_negative_zero(b), lit(-INF)).otherwise(lit(INF)))
    return F.when(F.isnan(b), lit(NAN)).when(b == 0, zero).otherwise(F.try_divide(a, b))


def is_negative_zero(c: Column) -> Column:
    return (c == 0) & c.cast("string").startswith("-")


def mod(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == INF), lit(NAN)).when(F.abs(b) == INF, a).otherwise(F.try_mod(a, b))


def power(a: Column, b: Column) -> Column:
    return F.when(b == 0, lit(1.0)).otherwise(F.pow(a, b))


def compare(op: str, a: Column, b: Column) -> Column:
    """BOOLEAN; NaN is unequal to everything and unordered."""
    nan = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return nan | (a != b)
    plain = {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return ~nan & plain


def nan_max(c: Column) -> Column:
    """Aggregate: largest value, NaN only if all are."""
    return F.coalesce(F.max(F.when(~F.isnan(c), c)), lit(NAN))


def log(c: Column, base: str = "e") -> Column:
    f = {"e": F.log, "2": F.log2, "10": F.log10}[base]
    return F.when(F.isnan(c) | (c < 0), lit(NAN)).when(c == 0, lit(-INF)).otherwise(f(c))


def whole(c: Column, f) -> Column:
    """floor or ceil that leaves NaN, infinities and numbers beyond BIGINT alone."""
    return F.when(F.isnan(c) | (F.abs(c) >= 2.0**62), c).otherwise(f(c).cast("double"))


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero on the scaled value, as DuckDB rounds: F.round goes by a number's shortest decimal text, which makes
    another choice for ties such as 0.41 / 6.4 = 0.0640625. NaN, infinities and what the scale overflows stay."""
    scale = lit(10.0**digits)
    near = F.round(c * scale) / scale
    return F.when(F.abs(near) < INF, near).otherwise(c)


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row: a lambda's argument is not inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quantile(q: float | Column, values: Column) -> Column:
    """Linear interpolation over an array of values; NaN sorts first, as the smallest."""
    q = q if isinstance(q, Column) else lit(q)

    def of(ordered: Column) -> Column:
        n = F.size(ordered)
        rank = q * (n - 1)
        low = F.greatest(F.lit(0), F.floor(rank).cast("int"))
        weight = rank - F.floor(rank)
        a, b = F.get(ordered, low), F.get(ordered, F.least(n - 1, low + 1))
        inside = F.when(weight == 0, a).otherwise(a * (1 - weight) + b * weight)
        return F.when(F.isnan(q) | (n == 0), lit(NAN)).when(q < 0, lit(-INF)).when(q > 1, lit(INF)).otherwise(inside)

    nans = F.filter(values, lambda x: F.isnan(x))
    return let(F.concat(nans, F.array_sort(F.filter(values, lambda x: ~F.isnan(x)))), of)


def sample_text(c: Column) -> Column:
    """A value as the query language prints it: 6, 0.5, 1e+21, NaN, +Inf."""
    s = c.cast("string")
    mantissa, exponent = F.split_part(s, F.lit("E"), F.lit(1)), F.split_part(s, F.lit("E"), F.lit(2))
    mantissa = F.regexp_replace(mantissa, r"\.0$", "")
    e = exponent.cast("int")
    science = F.concat(mantissa, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    return (
        F.when(F.isnan(c), "NaN").when(c == INF, "+Inf").when(c == -INF, "-Inf").when((c == 0) & ~s.startswith("-"), "0")
        .when((F.abs(c) >= 1e7) & (F.abs(c) < 1e21) & (c == F.floor(c)), c.cast("decimal(38,0)").cast("string"))
        .when(s.contains("E") & (e < -4) | s.contains("E") & (e >= 21), science)
        .when(s.contains("E"), F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"\.?0+$", ""))
        .otherwise(mantissa)
    )


PI = math.pi
