"""Functions over instant vectors: value -> value, and the calendar (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import num


def _guarded(f):
    return lambda c, *a: F.when(F.isnan(c), c).otherwise(f(c, *a))


def _round(c: Column, to: Column) -> Column:
    inverse = num.div(num.lit(1), to)
    return num.div(num.whole(c * inverse + 0.5, F.floor), inverse)


def _time(f):
    """f(days since the epoch as a DATE, seconds of the day); dates have no time zone, so the session's does not matter."""

    def of(c: Column) -> Column:
        s = F.floor(c).cast("bigint")
        return F.when(F.isnan(c) | (F.abs(c) > 2e11), num.lit(num.NAN)).otherwise(f(F.date_from_unix_date(F.floor(s / 86400).cast("int")), F.pmod(s, F.lit(86400))).cast("double"))

    return of


MATH = {
    "abs": F.abs, "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh,
    "ceil": lambda c: num.whole(c, F.ceil), "floor": lambda c: num.whole(c, F.floor),
    "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh,
    "deg": F.degrees, "rad": F.radians, "exp": F.exp, "sqrt": F.sqrt, "sgn": lambda c: F.when(F.isnan(c), c).otherwise(F.signum(c)),
    "ln": num.log, "log2": lambda c: num.log(c, "2"), "log10": lambda c: num.log(c, "10"),
}
#: With scalar arguments.
BOUNDED = {
    "clamp": lambda c, low, high: F.when(F.isnan(c) | F.isnan(low) | F.isnan(high), num.lit(num.NAN)).otherwise(F.greatest(F.least(c, high), low)),
    "clamp_max": lambda c, high: F.when(F.isnan(c) | F.isnan(high), num.lit(num.NAN)).otherwise(F.least(c, high)),
    "clamp_min": lambda c, low: F.when(F.isnan(c) | F.isnan(low), num.lit(num.NAN)).otherwise(F.greatest(c, low)),
    "round": _round,
}
CALENDAR = {
    "day_of_month": _time(lambda d, s: F.dayofmonth(d)), "day_of_week": _time(lambda d, s: F.dayofweek(d) - 1), "day_of_year": _time(lambda d, s: F.dayofyear(d)),
    "days_in_month": _time(lambda d, s: F.dayofmonth(F.last_day(d))), "month": _time(lambda d, s: F.month(d)), "year": _time(lambda d, s: F.year(d)),
    "hour": _time(lambda d, s: F.floor(s / 3600)), "minute": _time(lambda d, s: F.floor(s / 60) % 60),
}
