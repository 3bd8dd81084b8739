"""Syntax tree and step grid to a DataFrame. Every node becomes DataFrame expressions; Catalyst plans them as one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import histograms, instant, num, ranges
from ..operators import matching, selectors
from ..operators.aggregate import aggregate
from ..sources.model import NAME, Grid, key_of, label, labels_of, with_labels, without
from . import syntax as s

VECTOR_FUNCTIONS = {"absent", "absent_over_time", "histogram_quantile", "histogram_fraction", "histogram_avg", "histogram_count", "histogram_sum", "histogram_stddev", "histogram_stdvar", "label_replace", "label_join", "sort", "sort_desc", "sort_by_label", "sort_by_label_desc", "info", "scalar", "vector", "time", "timestamp", "pi"}
EXPERIMENTAL = ranges.EXPERIMENTAL | {"sort_by_label", "sort_by_label_desc", "info", "limitk", "limit_ratio"}


@dataclass
class Scalar:
    """One value per step: a constant or an expression over `step`, or a small DataFrame (step, value)."""

    column: Column | None = None
    frame: DataFrame | None = None
    constant: float | None = None


@dataclass
class Vector:
    df: DataFrame
    order: tuple = ()


def single_name(node) -> bool:
    """Whether the series of a node's result stay apart without the metric's name, by the query alone: they have one name, or none."""
    if isinstance(node, s.Selector):
        return any(m.name == NAME and m.op == "=" and m.value for m in node.matchers)
    if isinstance(node, s.Subquery):
        return single_name(node.expr)
    if isinstance(node, s.Aggregate):
        return single_name(node.expr) if node.op in ("topk", "bottomk", "limitk", "limit_ratio") else node.without or NAME not in node.labels
    if isinstance(node, s.Unary):
        return node.op == "-" or single_name(node.expr)
    if isinstance(node, s.Binary):
        if node.op == "or":
            return False
        keeps = node.op in s.SETS or node.op in s.COMPARISONS and not node.bool_
        return not keeps or (single_name(node.left) and single_name(node.right))
    if isinstance(node, s.Call):
        if node.name in ("label_replace", "label_join"):
            return len(node.args) > 1 and getattr(node.args[1], "value", None) != NAME and single_name(node.args[0])
        if node.name in ranges.KEEPS_NAME | {"sort", "sort_desc", "sort_by_label", "sort_by_label_desc", "info"}:
            return bool(node.args) and single_name(node.args[0])
    return True


class Planner:
    """samples(matchers, low, high) gives the raw samples that a selector sees, with ts_ms in (low, high]."""

    def __init__(self, spark: SparkSession, samples: Callable, lookback: int = 300_000, evaluation_interval: int = 60_000, experimental: bool = False):
        self.spark, self.samples, self.lookback, self.interval, self.experimental = spark, samples, lookback, evaluation_interval, experimental

    # ---------------------------------------------------------------------------------------------------------- entry
    def run(self, query: str, grid: Grid):
        """Scalar, Vector, or str."""
        self.outer = grid
        return self.eval(s.parse(query), grid)

    def eval(self, node, grid: Grid):
        return getattr(self, f"_{type(node).__name__.lower()}")(node, grid)

    def vector(self, node, grid: Grid, what: str) -> DataFrame:
        out = self.eval(node, grid)
        if not isinstance(out, Vector):
            raise s.QueryError(f"expected an instant vector in {what}")
        return out.df

    def scalar(self, node, grid: Grid, what: str) -> Scalar:
        out = self.eval(node, grid)
        if not isinstance(out, Scalar):
            raise s.QueryError(f"expected a scalar in {what}")
        return out

    # --------------------------------------------------------------------------------------------------------- leaves
    def _number(self, node, grid):
        return Scalar(num.lit(node.value), constant=node.value)

    def _text(self, node, grid):
        return node.value

    def _pinned(self, shift: s.Shift) -> int | None:
        return {None: None, "start": self.outer.start, "end": self.outer.last}.get(shift.at, shift.at) if not isinstance(shift.at, float) else round(shift.at)

    def _held(self, shift: s.Shift, grid: Grid, plan) -> DataFrame:
        """plan(grid, offset), evaluated once and repeated over the grid if the time is pinned."""
        at = self._pinned(shift)
        if at is None:
            return plan(grid, shift.offset)
        once = plan(Grid(at, at, 1), shift.offset)
        steps = F.explode(F.sequence(F.lit(grid.start).cast("bigint"), F.lit(grid.last).cast("bigint"), F.lit(grid.step).cast("bigint"))) if grid.n > 1 else F.lit(grid.start).cast("bigint")
        return once.withColumn("step", steps)

    def _selector(self, node: s.Selector, grid: Grid):
        if node.range_ms is not None:
            raise s.QueryError("a range vector must be the argument of a function")
        return Vector(self._instant(node, grid).drop("ts"))

    def _instant(self, node: s.Selector, grid: Grid) -> DataFrame:
        return self._held(node.shift, grid, lambda g, off: selectors.instant(self.samples(node.matchers, g.start - off - self.lookback, g.last - off), g, self.lookback, off))

    def matrix(self, node, grid: Grid, previous: bool, then, native: bool = False) -> DataFrame:
        """then(windows) for a range selector or subquery, on the pinned time if there is one."""
        if isinstance(node, s.Selector) and node.range_ms is not None:
            return self._held(node.shift, grid, lambda g, off: then(selectors.windows(self.samples(node.matchers, g.start - off - node.range_ms, g.last - off), g, node.range_ms, off, previous, native)))
        if isinstance(node, s.Subquery):
            return self._held(node.shift, grid, lambda g, off: then(selectors.windows(self._subsamples(node, g, off), g, node.range_ms, off, previous, native)))
        raise s.QueryError("expected a range vector")

    def _subsamples(self, node: s.Subquery, grid: Grid, offset: int) -> DataFrame:
        step = node.step_ms or self.interval
        low = grid.start - offset - node.range_ms
        first = (low // step + 1) * step  # multiples of the step inside (low, end]
        last = grid.last - offset
        inner = Grid(first, max(first, last), step)
        out = self.eval(node.expr, inner)
        df = self._as_vector(out, inner)
        hist = ["hist"] if "hist" in df.columns else []
        return df.where(F.col("step") <= last).select("lkey", F.col("step").alias("ts_ms"), "value", F.lit(False).alias("stale"), *hist)

    def _as_vector(self, out, grid: Grid) -> DataFrame:
        if isinstance(out, Vector):
            return out.df
        df = out.frame if out.frame is not None else grid.frame(self.spark).withColumn("value", out.column)
        return df.select(F.lit("[]").alias("lkey"), "step", "value")

    def _subquery(self, node, grid):
        raise s.QueryError("a subquery must be the argument of a function")

    # ------------------------------------------------------------------------------------------------------ operators
    def _unary(self, node, grid):
        out = self.eval(node.expr, grid)
        if node.op == "+":
            return out
        if isinstance(out, Scalar):
            return Scalar(-out.column if out.column is not None else None, None if out.frame is None else out.frame.withColumn("value", -F.col("value")), None if out.constant is None else -out.constant)
        return Vector(self._unique(matching.with_scalar("*", out.df, num.lit(-1), False, False), node.expr))

    def _binary(self, node: s.Binary, grid: Grid):
        left, right = self.eval(node.left, grid), self.eval(node.right, grid)
        scalars = isinstance(left, Scalar), isinstance(right, Scalar)
        if isinstance(left, str) or isinstance(right, str):
            raise s.QueryError("binary expression must contain only scalar and instant vector types")
        if node.op in s.SETS and any(scalars):
            raise s.QueryError(f"set operator {node.op!r} not allowed in binary scalar expression")
        if all(scalars):
            if node.op in s.COMPARISONS and not node.bool_:
                raise s.QueryError("comparisons between scalars must use bool modifier")
            f = lambda a, b: num.compare(node.op, a, b).cast("double") if node.op in s.COMPARISONS else matching.arithmetic(node.op, a, b)
            if left.frame is None and right.frame is None:
                return Scalar(f(left.column, right.column))
            a, b = (self._as_vector(x, grid).select("step", F.col("value").alias(n)) for x, n in ((left, "a"), (right, "b")))
            return Scalar(frame=a.join(F.broadcast(b), "step").select("step", f(F.col("a"), F.col("b")).alias("value")))
        if any(scalars):
            scalar, vector = (left, right.df) if scalars[0] else (right, left.df)
            with_it, column = self._joined(vector, scalar)
            out = matching.with_scalar(node.op, with_it, column, scalars[0], node.bool_)
            named = node.op in s.COMPARISONS and not node.bool_
            return Vector(out.drop("__s") if named else self._unique(out.drop("__s"), node.right if scalars[0] else node.left))
        m = node.matching or s.Matching()
        out = matching.vectors(node.op, left.df, right.df, m, node.bool_)
        if m.card == "one-to-one" or node.op in s.SETS:
            return Vector(out)
        many = node.left if m.card == "many-to-one" else node.right
        if not m.include and (single_name(many) or node.op in s.COMPARISONS and not node.bool_):
            return Vector(out)
        return Vector(self._checked(out, "multiple matches for labels: grouping labels must ensure unique matches"))

    def _unique(self, df: DataFrame, node) -> DataFrame:
        """df, whose names were dropped from node's result; an error where that makes two series of a step alike."""
        return df if single_name(node) else self._checked(df, "vector cannot contain metrics with the same labelset")

    @staticmethod
    def _checked(df: DataFrame, message: str) -> DataFrame:
        hist = ["hist"] if "hist" in df.columns else []
        rows = df.groupBy("lkey", "step").agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct("value", *hist)).alias("r"))
        ok = F.when(F.col("n") > 1, F.raise_error(F.lit(message)).cast("double")).otherwise(F.col("r.value"))
        return rows.select("lkey", "step", ok.alias("value"), *(["r.hist"] if hist else []))

    @staticmethod
    def _joined(vector: DataFrame, scalar: Scalar, name: str = "__s") -> tuple[DataFrame, Column]:
        """The vector with the scalar's value at its step; a grid has at most MAX_POINTS rows, so it may go to every task."""
        if scalar.frame is None:
            return vector, scalar.column
        return vector.join(F.broadcast(scalar.frame.select("step", F.col("value").alias(name))), "step"), F.col(name)

    def _aggregate(self, node: s.Aggregate, grid: Grid):
        if node.op in EXPERIMENTAL and not self.experimental:
            raise s.QueryError(f"{node.op} is experimental")
        df, param = self.vector(node.expr, grid, node.op), None
        if node.param is not None:
            param = self.eval(node.param, grid)
            if isinstance(param, str) != (node.op == "count_values") or isinstance(param, Vector):
                raise s.QueryError(f"wrong kind of parameter in aggregation {node.op}")
            if isinstance(param, Scalar):
                if param.constant is not None:
                    param = param.constant
                else:
                    df, param = self._joined(df, param, "__p")
        return Vector(aggregate(node, df, param).drop("__p"))

    # ------------------------------------------------------------------------------------------------------ functions
    def _call(self, node: s.Call, grid: Grid):
        name, args = node.name, node.args
        if name in EXPERIMENTAL and not self.experimental:
            raise s.QueryError(f"{name} is experimental")
        if name in ranges.PREVIOUS or name.endswith("_over_time") and name != "absent_over_time" or name in ("delta", "deriv", "predict_linear", "double_exponential_smoothing"):
            return self._ranged(name, args, grid)
        if name in instant.MATH:
            return Vector(self._mapped(self._arg(args, 0, name), grid, name, instant.MATH[name]))
        if name in instant.BOUNDED:
            return self._bounded(name, args, grid)
        if name in instant.CALENDAR:
            df = self._mapped(args[0], grid, name, instant.CALENDAR[name]) if args else grid.frame(self.spark).select(F.lit("[]").alias("lkey"), "step", instant.CALENDAR[name](F.col("step") / 1000.0).alias("value"))
            return Vector(df)
        if name in histograms.NATIVE:
            df = self.vector(self._arg(args, 0, name), grid, name)
            df = df.where(F.col("hist").isNotNull()) if "hist" in df.columns else df.limit(0).withColumn("hist", F.lit(None).cast(_hist()))
            return Vector(self._unique(df.select(matching.nameless(F.col("lkey")).alias("lkey"), "step", histograms.NATIVE[name](F.col("hist")).alias("value")), args[0]))
        method = getattr(self, f"_f_{name}", None)
        if method is None:
            raise s.QueryError(f"unknown function {name!r}")
        return method(args, grid)

    @staticmethod
    def _arg(args, i: int, name: str):
        if len(args) <= i:
            raise s.QueryError(f"expected more arguments in call to {name}")
        return args[i]

    def _mapped(self, node, grid, name, f) -> DataFrame:
        df = self.vector(node, grid, name)
        df = df.where(F.col("hist").isNull()) if "hist" in df.columns else df
        return self._unique(df.select(matching.nameless(F.col("lkey")).alias("lkey"), "step", f(F.col("value")).alias("value")), node)

    def _ranged(self, name: str, args, grid: Grid):
        table = ranges.functions()
        if name not in table:
            raise s.QueryError(f"unknown function {name!r}")
        scalars, matrix = {"quantile_over_time": (args[:1], args[-1]), "predict_linear": (args[1:], args[0]), "double_exponential_smoothing": (args[1:], args[0])}.get(name, ((), self._arg(args, 0, name)))
        values = [self.scalar(a, grid, name) for a in scalars]
        span = getattr(matrix, "range_ms", None)
        if span is None:
            raise s.QueryError(f"expected a range vector in call to {name}")
        aggs, out = table[name](span, *(F.col(f"__s{i}") if v.frame is not None else v.column for i, v in enumerate(values)))
        named = name in ranges.KEEPS_NAME

        def then(rows: DataFrame) -> DataFrame:
            if "hist" not in rows.columns or name in ("count_over_time", "present_over_time"):
                return floats(rows)
            of_floats, own = rows.where(F.col("hist").isNull()), histograms.over_windows(name, rows.where(F.col("hist").isNotNull()), span)
            key = F.col("lkey") if named else matching.nameless(F.col("lkey"))
            if name in histograms.ALONE:  # a window of both gives nothing
                kinds = rows.groupBy("lkey", "step").agg(F.min(F.col("hist").isNull()).alias("f"), F.max(F.col("hist").isNull()).alias("t")).where("f <> t").select("lkey", "step")
                own, of_floats = (x.join(kinds, ["lkey", "step"], "left_anti") for x in (own, of_floats))
            else:  # first or last, whichever kind it is
                at = (F.max if name == "last_over_time" else F.min)("ts")
                ends = rows.groupBy("lkey", "step").agg(at.alias("at"))
                picked = rows.join(ends, ["lkey", "step"]).where("ts = at")
                of_floats, own = picked.where(F.col("hist").isNull()), histograms.over_windows(name, picked.where(F.col("hist").isNotNull()), span)
            return floats(of_floats).withColumn("hist", F.lit(None).cast(_hist())).unionByName(own.select(key.alias("lkey"), "step", "value", "hist"))

        def floats(rows: DataFrame) -> DataFrame:
            found = rows.groupBy("lkey", "step").agg(*(c.alias(k) for k, c in aggs.items()))
            for i, v in enumerate(values):  # one by step, used after the aggregation
                found, _ = self._joined(found, v, f"__s{i}")
            key = F.col("lkey") if named else matching.nameless(F.col("lkey"))
            return found.select(key.alias("lkey"), "step", out.cast("double").alias("value")).where(F.col("value").isNotNull())

        df = self.matrix(matrix, grid, name in ranges.PREVIOUS, then, name in histograms.RANGED)
        return Vector(df if named else self._unique(df, matrix))

    def _bounded(self, name, args, grid):
        df = self.vector(self._arg(args, 0, name), grid, name)
        df = df.where(F.col("hist").isNull()) if "hist" in df.columns else df
        values = [self.scalar(a, grid, name) for a in args[1:]] or [Scalar(num.lit(1), constant=1.0)]
        columns = []
        for i, v in enumerate(values):
            df, c = self._joined(df, v, f"__s{i}")
            columns.append(c)
        if name == "clamp":
            df = df.where(~(columns[0] > columns[1]) | F.isnan(columns[0]) | F.isnan(columns[1]))
        return Vector(self._unique(df.select(matching.nameless(F.col("lkey")).alias("lkey"), "step", instant.BOUNDED[name](F.col("value"), *columns).alias("value")), args[0]))

    def _f_time(self, args, grid):
        return Scalar(F.col("step") / 1000.0)

    def _f_pi(self, args, grid):
        return Scalar(num.lit(num.PI), constant=num.PI)

    def _f_vector(self, args, grid):
        return Vector(self._as_vector(self.scalar(self._arg(args, 0, "vector"), grid, "vector"), grid))

    def _f_scalar(self, args, grid):
        df = self.vector(self._arg(args, 0, "scalar"), grid, "scalar")
        df = df.where(F.col("hist").isNull()) if "hist" in df.columns else df
        single = df.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v")).where("n = 1")
        return Scalar(frame=grid.frame(self.spark).join(single, "step", "left").select("step", F.coalesce("v", num.lit(num.NAN)).alias("value")))

    def _f_timestamp(self, args, grid):
        node = self._arg(args, 0, "timestamp")
        if isinstance(node, s.Selector) and node.range_ms is None:
            df = self._instant(node, grid).withColumn("value", F.col("ts") / 1000.0)
        else:
            df = self.vector(node, grid, "timestamp").withColumn("value", F.col("step") / 1000.0)
        return Vector(self._unique(df.select(matching.nameless(F.col("lkey")).alias("lkey"), "step", "value"), node))

    def _absent(self, node, steps: DataFrame, grid: Grid):
        labels = {}
        if isinstance(node, s.Selector):
            seen: dict[str, int] = {}
            for m in node.matchers:
                seen[m.name] = seen.get(m.name, 0) + 1
            labels = {m.name: m.value for m in node.matchers if m.op == "=" and seen[m.name] == 1 and m.name != NAME and m.value}
        key = key_of(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])) if labels else F.lit("[]")
        missing = grid.frame(self.spark).join(F.broadcast(steps.select("step").distinct()), "step", "left_anti")
        return Vector(missing.select(key.alias("lkey"), "step", num.lit(1).alias("value")))

    def _f_absent(self, args, grid):
        return self._absent(args[0], self.vector(self._arg(args, 0, "absent"), grid, "absent"), grid)

    def _f_absent_over_time(self, args, grid):
        node = self._arg(args, 0, "absent_over_time")
        return self._absent(node, self.matrix(node, grid, False, lambda rows: rows.select("step").distinct()), grid)

    def _relabelled(self, df: DataFrame, labels: Column, check: str) -> Vector:
        """New labels, or an error when two series of a step come to share them."""
        hist = ["hist"] if "hist" in df.columns else []
        return Vector(self._checked(df.select(key_of(labels).alias("lkey"), "step", "value", *hist), f"{check}: vector cannot contain metrics with the same labelset"))

    def _texts(self, args, name) -> list[str]:
        if not all(isinstance(a, s.Text) for a in args):
            raise s.QueryError(f"expected strings in call to {name}")
        return [a.value for a in args]

    def _f_label_replace(self, args, grid):
        if len(args) != 5:
            raise s.QueryError("label_replace takes five arguments")
        dst, repl, src, regex = self._texts(args[1:], "label_replace")
        labels = labels_of(F.col("lkey"))
        have, full = label(labels, src), f"^(?s:{regex})$"
        new = F.regexp_replace(have, F.lit(full), F.lit(repl))
        df = self.vector(args[0], grid, "label_replace")
        return self._relabelled(df, F.when(have.rlike(full), with_labels(labels, {dst: new})).otherwise(labels), "label_replace")

    def _f_label_join(self, args, grid):
        if len(args) < 3:
            raise s.QueryError("label_join takes three arguments or more")
        dst, sep, *src = self._texts(args[1:], "label_join")
        labels = labels_of(F.col("lkey"))
        joined = F.concat_ws(sep, *[label(labels, x) for x in src]) if src else F.lit("")
        return self._relabelled(self.vector(args[0], grid, "label_join"), with_labels(labels, {dst: joined}), "label_join")

    def _sorted(self, args, grid, name, order):
        return Vector(self.vector(self._arg(args, 0, name), grid, name), order)

    def _f_sort(self, args, grid):
        return self._sorted(args, grid, "sort", (F.isnan("value"), F.asc("value"), "lkey"))

    def _f_sort_desc(self, args, grid):
        return self._sorted(args, grid, "sort_desc", (F.isnan("value"), F.desc("value"), "lkey"))

    def _f_sort_by_label(self, args, grid):
        return self._sorted(args, grid, "sort_by_label", (*[label(labels_of(F.col("lkey")), x) for x in self._texts(args[1:], "sort_by_label")], F.col("lkey")))

    def _f_sort_by_label_desc(self, args, grid):
        return self._sorted(args, grid, "sort_by_label_desc", (*[label(labels_of(F.col("lkey")), x).desc() for x in self._texts(args[1:], "sort_by_label_desc")], F.col("lkey").desc()))

    def _f_info(self, args, grid):
        """Labels of the info series (target_info unless a selector says otherwise) with the same instance and job."""
        df = self.vector(self._arg(args, 0, "info"), grid, "info")
        ask = args[1] if len(args) > 1 else s.Selector(())
        matchers = ask.matchers if any(m.name == NAME for m in ask.matchers) else (*ask.matchers, s.Matcher(NAME, "=", "target_info"))
        wanted = [m.name for m in ask.matchers if m.name != NAME]
        side = self.vector(s.Selector(tuple(matchers)), grid, "info")
        labels = labels_of(F.col("lkey"))
        identity = key_of(F.map_filter(labels, lambda k, v: k.isin("instance", "job")))
        info = side.select(identity.alias("mkey"), "step", F.col("lkey").alias("ikey")).groupBy("mkey", "step").agg(F.max("ikey").alias("ikey"))
        both = df.withColumn("mkey", identity).join(info, ["mkey", "step"], "left")
        have = labels_of(F.col("lkey"))
        extra = F.map_filter(F.coalesce(labels_of(F.col("ikey")), F.create_map().cast("map<string,string>")), lambda k, v: (k != NAME) & (k.isin(wanted) if wanted else F.lit(True)) & F.try_element_at(have, k).isNull())
        return Vector(both.select(key_of(F.map_concat(have, extra)).alias("lkey"), "step", "value"))

    def _f_histogram_quantile(self, args, grid):
        q = self.scalar(self._arg(args, 0, "histogram_quantile"), grid, "histogram_quantile")
        return self._histogram(self._arg(args, 1, "histogram_quantile"), grid, [q], histograms.classic_quantile, histograms.native_quantile)

    def _f_histogram_fraction(self, args, grid):
        bounds = [self.scalar(self._arg(args, i, "histogram_fraction"), grid, "histogram_fraction") for i in (0, 1)]
        return self._histogram(self._arg(args, 2, "histogram_fraction"), grid, bounds, histograms.classic_fraction, histograms.native_fraction)

    def _histogram(self, node, grid, scalars, classic, native):
        df = self.vector(node, grid, "a histogram function")
        floats = df.where(F.col("hist").isNull()) if "hist" in df.columns else df

        def out(rows, f):
            columns = []
            for i, v in enumerate(scalars):
                rows, c = self._joined(rows, v, f"__s{i}")
                columns.append(c)
            return rows.select("lkey", "step", f(*columns).alias("value"))

        result = out(histograms.classic_groups(floats), classic)
        if "hist" in df.columns:
            rows = df.where(F.col("hist").isNotNull()).withColumn("lkey", matching.nameless(F.col("lkey")))
            result = result.unionByName(out(rows, lambda *c: native(*c, F.col("hist"))))
        return Vector(result)


def _hist():
    from ..sources.model import HIST

    return HIST
