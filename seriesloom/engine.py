"""The engine: groups of sources, a mode, and queries over them.

    from seriesloom.engine import Engine
    engine = Engine(spark, [SourceGroup([samples], labels={"backend": "a"})])
    engine.query_range('sum by (job) (rate(requests_total[5m]))', start, end, step)

Modes: `exact` (default) dedups and gap-fills raw samples first and evaluates everything over them; `dedup` does so for raw
selectors but evaluates aggregations of a single selector over the union of the groups, which counts a series once for
each group that has it; `union` leaves the groups side by side.
"""

from __future__ import annotations

import re
import tempfile
import time
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import merge
from .plans import syntax
from .plans.planner import Planner, Scalar, Vector
from .sources import catalog
from .sources.groups import BrokenSource, ConfigError, SourceGroup, check_groups, check_ignore
from .sources.model import SAMPLES, Grid, labels_of

#: Requests of a query's statistics that are kept one by one.
MOST_REQUESTS = 100
PUSHED = ("sum", "min", "max", "topk", "bottomk", "group", "avg", "count", "count_values")


class SourceError(RuntimeError):
    """A group could not be read. Its subclasses say why; of a bad query or a failed evaluation the message is the cause's own, as
    every group would give it."""

    kind = "unavailable"


class BadData(SourceError):
    kind = "bad_data"


class ExecutionFailed(SourceError):
    kind = "execution"


class TimedOut(SourceError):
    kind = "timeout"


class Canceled(SourceError):
    kind = "canceled"


def source_error(name: str, e: Exception) -> SourceError:
    text = str(e)
    if isinstance(e, syntax.QueryError | ConfigError):
        return BadData(text)
    if re.search(r"cancell?ed|interrupt", text, re.I):
        return Canceled(f"{name}: {text}")
    if re.search(r"timed? ?out|timeout", text, re.I):
        return TimedOut(f"{name}: {text}")
    if isinstance(e, PySparkException) and not re.search(r"file|path|read|parquet|connect", text, re.I):
        return ExecutionFailed(text)
    return SourceError(f"{name}: {text}")


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder that spark.checkpoint.dir names: a source that may fail does so here."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ConfigError("sources that may fail need spark.checkpoint.dir, a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="seriesloom-"))
    return df.checkpoint()


@dataclass
class Options:
    mode: str = "exact"
    dedup_metadata: bool = False
    partial_response: bool = False
    ignore_labels: tuple[str, ...] = ()
    fill_gaps: bool = True
    gap_ms: int = 0
    lookback_ms: int = 300_000
    evaluation_interval_ms: int = 60_000
    experimental: bool = False
    strict_labels: bool = True

    def __post_init__(self):
        if self.mode not in ("exact", "dedup", "union"):
            raise ConfigError(f"unknown mode {self.mode!r}")
        if self.mode == "union" and (self.dedup_metadata or self.partial_response):
            raise ConfigError("dedup_metadata and partial_response need dedup")
        if self.gap_ms < 0 or (self.gap_ms and not self.fill_gaps):
            raise ConfigError("gap_ms must not be negative and needs fill_gaps")
        check_ignore(self.ignore_labels)


@dataclass
class Engine:
    spark: SparkSession
    groups: list[SourceGroup]
    options: Options = field(default_factory=Options)
    now_ms: int | None = None

    def __post_init__(self):
        self._shift = 0  # start mod step of the range query at hand, for groups that answer on multiples of the step
        for i, g in enumerate(self.groups):
            g.ordinal = i
            g.name = g.name if g.name and not g.name.startswith("sg-") else f"sg-{i}"
        self.warnings = check_groups(self.groups, self.options.mode != "union" and self.options.strict_labels)

    # ------------------------------------------------------------------------------------------------------- sources
    @property
    def ignored(self) -> set[str]:
        return {k for g in self.groups for k in g.labels} | set(self.options.ignore_labels)

    def _parts(self, matchers, low: int | None = None, high: int | None = None) -> list[DataFrame]:
        """What each group that can match contributes; groups that constants, label filters or time ranges rule out are not in
        the plan. A group whose errors are to be ignored or downgraded, or any with partial_response, is read at once, so that
        failures while planning and while reading follow the options."""
        out, failed = [], []
        now = self.now_ms if self.now_ms is not None else int(time.time() * 1000)
        for g in self.groups:
            try:
                if not g.may_match(matchers):
                    continue
                shift = self._shift if g.align_with_step else 0
                window = (None, None) if low is None else g.window(low - shift, high - shift, now)
                if window is not None:
                    rows = g.samples(matchers, *window)
                    if g.ignore_error or g.downgrade_error or self.options.partial_response:
                        rows = settled(rows)
                    out.append(rows.withColumn("ts_ms", F.col("ts_ms") + F.lit(shift)) if shift else rows)
            except (PySparkException, Py4JJavaError, BrokenSource) as e:
                if g.ignore_error:
                    continue
                if g.downgrade_error or self.options.partial_response:
                    self.warnings.append(f"{g.name}: {e}")
                    failed.append(g)
                    continue
                raise source_error(g.name, e) from e
        if failed and not out and len(failed) == len(self.groups):
            raise SourceError("no group could be read")
        return out

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], SAMPLES).drop("hist")

    def samples(self, matchers, low: int | None = None, high: int | None = None, union: bool = False) -> DataFrame:
        parts = self._parts(matchers, low, high)
        if not parts:
            return self._empty()
        if union or self.options.mode == "union":
            return merge.union(parts)
        return merge.dedup(parts, self.ignored, self.options.fill_gaps, self.options.gap_ms)

    # ------------------------------------------------------------------------------------------------------- queries
    def _planner(self) -> Planner:
        o = self.options
        kind = _Pushing if o.mode == "dedup" and len(self.groups) > 1 else Planner
        return kind(self.spark, self.samples, o.lookback_ms, o.evaluation_interval_ms, o.experimental)

    def _frame(self, query: str, grid: Grid):
        out = self._planner().run(query, grid)
        if isinstance(out, str):
            return out, ()
        if isinstance(out, Scalar):
            df = out.frame if out.frame is not None else grid.frame(self.spark).withColumn("value", out.column)
            return df.select(F.lit("[]").alias("lkey"), "step", "value"), ()
        assert isinstance(out, Vector)
        return out.df, out.order

    def query(self, query: str, at: int) -> DataFrame | str:
        """At one time (ms): lkey, labels, step, value[, hist]; ordered where the query sorts. A bare range selector gives its
        raw samples; a string literal its text."""
        node = syntax.parse(query)
        if isinstance(node, syntax.Selector) and node.range_ms is not None:
            end = at - node.shift.offset if node.shift.at is None else (at if isinstance(node.shift.at, str) else round(node.shift.at)) - node.shift.offset
            rows = self.samples(node.matchers, end - node.range_ms, end)
            return rows.where((F.col("ts_ms") > end - node.range_ms) & (F.col("ts_ms") <= end) & ~F.col("stale")).select("lkey", "labels", F.col("ts_ms").alias("step"), "value")
        df, order = self._frame(query, Grid(at, at, 1))
        if isinstance(df, str):
            return df
        df = df.orderBy(*order) if order else df
        return df.withColumn("labels", labels_of(F.col("lkey")))

    def query_range(self, query: str, start: int, end: int, step: int) -> DataFrame:
        self._shift = start % step
        try:
            df, _ = self._frame(query, Grid(start, end, step))
        finally:
            self._shift = 0
        if isinstance(df, str):
            raise syntax.QueryError("invalid expression type string for range query")
        return df.withColumn("labels", labels_of(F.col("lkey")))

    # ------------------------------------------------------------------------------------------------------ metadata
    def _matching(self, selectors: tuple[str, ...], start: int | None, end: int | None) -> DataFrame:
        sets = [syntax.parse(x).matchers for x in selectors] or [()]
        parts = [p for m in sets for p in self._parts(m, None if start is None else start - 1, end)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else self._empty()

    def label_names(self, *selectors: str, start=None, end=None) -> DataFrame:
        return catalog.label_names(self._matching(selectors, start, end))

    def label_values(self, name: str, *selectors: str, start=None, end=None) -> DataFrame:
        return catalog.label_values(self._matching(selectors, start, end), name)

    def series(self, *selectors: str, start=None, end=None) -> DataFrame:
        rows = self._matching(selectors, start, end)
        return catalog.deduped_series(rows, self.ignored) if self.options.dedup_metadata else catalog.series(rows)

    def cardinality(self, top: int = 10, focus: str | None = None) -> dict[str, DataFrame]:
        return catalog.cardinality(self._matching((), None, None), top, focus)

    def federate(self, selectors: list[str], at: int, external: dict[str, str] | None = None) -> DataFrame:
        sets = [syntax.parse(x).matchers for x in selectors]
        low = at - self.options.lookback_ms
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.samples(m, low, at) for m in sets])
        return catalog.federate(rows, [()], at, self.options.lookback_ms, external)

    def stats(self, query: str, start: int, end: int, step: int) -> DataFrame:
        """Per group: requests (selectors it was asked for), errors, and the series and samples read. `requests` then holds the
        first MOST_REQUESTS with their seconds."""
        self.requests, rows = [], []
        for g in self.groups:
            parts, asked, errors = [], 0, 0
            for node in _selectors(syntax.parse(query)):
                if not g.may_match(node.matchers):
                    continue
                began, asked, failure = time.time(), asked + 1, None
                try:
                    window = g.window(start - self.options.lookback_ms, end, self.now_ms if self.now_ms is not None else int(time.time() * 1000))
                    if window is not None:
                        found = g.samples(node.matchers, *window).groupBy("lkey").count()
                        parts.append(settled(found) if g.ignore_error or g.downgrade_error or self.options.partial_response else found)
                except (PySparkException, Py4JJavaError, BrokenSource) as e:
                    errors, failure = errors + 1, source_error(g.name, e)
                    if not (g.ignore_error or g.downgrade_error or self.options.partial_response):
                        raise failure from e
                if len(self.requests) < MOST_REQUESTS:
                    self.requests.append({"group": g.name, "matchers": node.matchers, "seconds": time.time() - began, "error": failure and failure.kind})
            every = reduce(lambda a, b: a.unionByName(b), parts) if parts else self._empty().groupBy("lkey").count()
            total = every.agg(F.countDistinct("lkey").alias("series"), F.coalesce(F.sum("count"), F.lit(0)).alias("samples"))
            rows.append(total.select(F.lit(g.ordinal).alias("group_ord"), F.lit(asked).cast("bigint").alias("requests"), F.lit(errors).cast("bigint").alias("errors"), "series", "samples"))
        return reduce(lambda a, b: a.unionByName(b), rows).orderBy("group_ord")

    # -------------------------------------------------------------------------------------------- for interactive tools
    def capped_range(self, query: str, start: int, end: int, step: int | None = None, max_series: int = 100, max_samples: int = 10_000) -> tuple[DataFrame, DataFrame]:
        """A range query cut to so many series and samples, in key order, and one row that tells what was found and what is shown.
        An open step gives about 250 points."""
        return catalog.capped(self.query_range(query, start, end, step or default_step(start, end)), max_series, max_samples)

    def capped_series(self, *selectors: str, start=None, end=None, max_series: int = 100) -> tuple[DataFrame, DataFrame]:
        return catalog.capped(self.series(*selectors, start=start, end=end), max_series, max_series)


def default_step(start: int, end: int, points: int = 250) -> int:
    """A step in ms, whole seconds, that gives about so many points: for callers that leave it open."""
    return max(1000, -(-(end - start) // points // 1000) * 1000)


def _selectors(node) -> list:
    if isinstance(node, syntax.Selector):
        return [node]
    children = [getattr(node, k, None) for k in ("expr", "left", "right", "param")] + list(getattr(node, "args", ()))
    return [s for c in children if c is not None and not isinstance(c, str) for s in _selectors(c)]


class _Pushing(Planner):
    """Aggregations of one selector, not under a subquery, see the groups side by side."""

    def _aggregate(self, node, grid):
        if node.op in PUSHED and len(_selectors(node)) == 1 and not getattr(self, "pushing", False):
            own, self.pushing = self.samples, True
            self.samples = lambda *a: own(*a, union=True)
            try:
                return super()._aggregate(node, grid)
            finally:
                self.samples, self.pushing = own, False
        return super()._aggregate(node, grid)
