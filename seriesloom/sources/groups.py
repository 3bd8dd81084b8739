"""Source groups: the replicas of one data source and what scopes them (labels, matchers, relabelling, time bounds)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import merge_replicas
from ..operators.selectors import matches, matches_text, select
from ..plans.syntax import Matcher
from .model import NAME, TableSource, key_of, label, with_labels


class ConfigError(ValueError):
    """The configuration is not valid."""


class BrokenSource(RuntimeError):
    """A source does not have what samples need."""


@dataclass(frozen=True)
class Relabel:
    """replace (source labels joined, anchored regex, replacement to target), labeldrop, lowercase, uppercase."""

    action: str = "replace"
    source_labels: tuple[str, ...] = ()
    target_label: str = ""
    regex: str = "(.*)"
    replacement: str = "$1"
    separator: str = ";"


@dataclass(frozen=True)
class LabelFilter:
    """Which values of labels a source can have: those it has now (dynamic) and `include`, without `exclude`."""

    dynamic: tuple[str, ...] = ()
    include: dict[str, tuple[str, ...]] = field(default_factory=dict)
    exclude: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class TimeRange:
    """Bounds in ms, absolute or relative to now; without truncate a query partly outside skips the source."""

    start: int | None = None
    end: int | None = None
    relative: bool = False
    truncate: bool = False

    def __post_init__(self):
        if self.start is not None and self.end is not None and self.end < self.start:
            raise ConfigError("a time range must not end before it starts")

    def bounds(self, now: int) -> tuple[int | None, int | None]:
        base = now if self.relative else 0
        return (None if self.start is None else base + self.start), (None if self.end is None else base + self.end)


@dataclass
class SourceGroup:
    """replicas: DataFrames of canonical samples, or tables, that hold the same data; labels: set on every series of the group."""

    replicas: list[DataFrame | TableSource]
    labels: dict[str, str] = field(default_factory=dict)
    name: str = ""
    ordinal: int = 0
    inject: tuple[Matcher, ...] = ()
    relabel: tuple[Relabel, ...] = ()
    label_filter: LabelFilter | None = None
    time_range: TimeRange | None = None
    anti_affinity_ms: int = 10_000
    anti_affinity_dynamic: bool = False
    prefer_max: bool = False
    ignore_error: bool = False
    downgrade_error: bool = False
    align_with_step: bool = False
    extra_filters: tuple[tuple[Matcher, ...], ...] = ()

    def __post_init__(self):
        self.name = self.name or f"sg-{self.ordinal}"
        self.anti_affinity_ms = self.anti_affinity_ms // 1000 * 1000  # whole seconds
        self._found: dict[Matcher, bool] = {}

    # ---------------------------------------------------------------------------------------------------- pruning
    def may_match(self, matchers) -> bool:
        """False if constants alone show that no series can match: a label of the group (unless relabelled afterwards), or the
        label filter. The group is then left out of the plan."""
        moved = {r.target_label for r in self.relabel} | ({*self.labels} if any(r.action == "labeldrop" for r in self.relabel) else set())
        for m in matchers:
            if m.name in self.labels and m.name not in moved and not matches_text(self.labels[m.name], m):
                return False
        f = self.label_filter
        if f is None:
            return True
        for m in matchers:
            if m.name in f.dynamic or m.name in f.include:
                without = f.exclude.get(m.name, ())
                listed = any(matches_text(v, m) for v in set(f.include.get(m.name, ())) - set(without))
                if not listed and not (m.name in f.dynamic and self._has(m, without)):
                    return False
        return True

    def _has(self, m: Matcher, without: tuple[str, ...]) -> bool:
        """Whether the source has a series that matches, looked up once: the scan takes the matcher and ends at the first row."""
        if m not in self._found:
            rows = self._unioned((*self.inject, m))
            self._found[m] = bool(rows.where(~label(F.col("labels"), m.name).isin(list(without))).limit(1).count()) if without else bool(rows.limit(1).count())
        return self._found[m]

    def window(self, low: int, high: int, now: int) -> tuple[int, int] | None:
        """(low, high] cut to the group's time range, or None if the group is to be skipped."""
        if self.time_range is None:
            return low, high
        start, end = self.time_range.bounds(now)
        if (start is not None and high < start) or (end is not None and low > end):
            return None
        if self.time_range.truncate:
            low, high = (low if start is None else max(low, start - 1)), (high if end is None else min(high, end))
            return (low, high) if high > low else None
        outside = (start is not None and low + 1 < start) or (end is not None and high > end)
        return None if outside else (low, high)

    # ------------------------------------------------------------------------------------------------------- scan
    def _unioned(self, matchers=(), low: int | None = None, high: int | None = None) -> DataFrame:
        """All replicas' samples. Tables take matchers and bounds into their scans, DataFrames here."""
        parts = []
        for i, r in enumerate(self.replicas):
            if isinstance(r, TableSource):
                rows = r.scan(matchers, low, high)
            else:
                if missing := {"labels", "lkey", "ts_ms", "value", "stale"} - {*r.columns}:
                    raise BrokenSource(f"columns are missing: {sorted(missing)}")
                rows = r.where((F.col("ts_ms") > F.lit(low)) & (F.col("ts_ms") <= F.lit(high))) if low is not None else r
                rows = select(rows, matchers)
            parts.append(rows.withColumn("replica", F.lit(i)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def samples(self, matchers=(), low: int | None = None, high: int | None = None) -> DataFrame:
        """Merged samples of the series that match, with the group's labels. Time bounds and the matchers of labels that no
        relabelling changes stand directly on the scan."""
        early = [m for m in matchers if m.name not in self.labels and not any(changes(r, m.name) for r in self.relabel)]
        rows = self._unioned((*self.inject, *early), low, high)
        if self.extra_filters:
            any_of = F.lit(False)
            for one in self.extra_filters:
                every = F.lit(True)
                for m in one:
                    every = every & matches(F.col("labels"), m)
                any_of = any_of | every
            rows = rows.where(any_of)
        if len(self.replicas) > 1:
            rows = merge_replicas(rows, list(range(len(self.replicas))), self.anti_affinity_ms, self.anti_affinity_dynamic, self.prefer_max)
        labels = F.col("labels")
        if self.labels:
            labels = with_labels(labels, {k: F.lit(v) for k, v in self.labels.items()})
        for r in self.relabel:
            labels = relabelled(labels, r)
        if self.labels or self.relabel:
            rows = rows.withColumn("labels", labels).withColumn("lkey", key_of(F.col("labels")))
        if self.relabel:
            rows = select(rows, matchers)
        return rows.withColumn("group_ord", F.lit(self.ordinal))


def changes(r: Relabel, name: str) -> bool:
    """Whether a rule can change a label."""
    return bool(re.fullmatch(r.regex, name)) if r.action == "labeldrop" else r.target_label == name


def relabel_targets(targets: list[dict[str, str]], rules: tuple[Relabel, ...]) -> list[dict[str, str]]:
    """The targets of a static list after keep, drop, replace, lowercase, uppercase, labeldrop, labelkeep and labelmap rules. One
    without an address is an error."""
    out = []
    for target in targets:
        own: dict[str, str] | None = dict(target)
        for r in rules:
            text, full = r.separator.join(own.get(x, "") for x in r.source_labels), re.compile(r.regex, re.S)
            hit, new = full.fullmatch(text), re.sub(r"\$\{?(\w+)\}?", r"\\g<\1>", r.replacement)
            if r.action in ("keep", "drop"):
                if bool(hit) != (r.action == "keep"):
                    own = None
                    break
            elif r.action == "replace":
                own |= {r.target_label: hit.expand(new)} if hit else {}
            elif r.action in ("lowercase", "uppercase"):
                own[r.target_label] = text.lower() if r.action == "lowercase" else text.upper()
            elif r.action in ("labeldrop", "labelkeep"):
                own = {k: v for k, v in own.items() if bool(full.fullmatch(k)) != (r.action == "labeldrop")}
            elif r.action == "labelmap":
                own |= {m.expand(new): v for k, v in own.items() if (m := full.fullmatch(k))}
            else:
                raise ConfigError(f"relabel action {r.action!r} is not supported on targets")
        if own is not None:
            if not own.get("__address__"):
                raise ConfigError(f"target {target} has no address")
            out.append(own)
    return out


def group_of_targets(spark, targets: list[dict[str, str]], rules: tuple[Relabel, ...] = (), format: str = "parquet", options: dict[str, str] | None = None, **group) -> SourceGroup:
    """A group whose replicas are tables of samples at the targets' addresses; format and options are those of the reader."""
    kept = dict.fromkeys(t["__address__"] for t in relabel_targets(targets, rules))
    return SourceGroup([spark.read.format(format).options(**(options or {})).load(a) for a in kept], **group)


def relabelled(labels, r: Relabel):
    if r.action == "labeldrop":
        return F.map_filter(labels, lambda k, v: ~k.rlike(f"^(?:{r.regex})$"))
    joined = F.concat_ws(r.separator, *[label(labels, x) for x in r.source_labels])
    if r.action in ("lowercase", "uppercase"):
        return with_labels(labels, {r.target_label: F.lower(joined) if r.action == "lowercase" else F.upper(joined)})
    if r.action == "replace":
        full = f"^(?s:{r.regex})$"
        return F.when(joined.rlike(full), with_labels(labels, {r.target_label: F.regexp_replace(joined, full, r.replacement)})).otherwise(labels)
    raise ConfigError(f"relabel action {r.action!r} is not supported on series")


_LABEL = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def check_groups(groups: list[SourceGroup], dedup: bool) -> list[str]:
    """Warnings; with dedup, groups that their labels do not tell apart are an error. A single group is exempt."""
    if len(groups) < 2:
        return []
    seen: dict[tuple, str] = {}
    problems = []
    for g in groups:
        key = tuple(sorted(g.labels.items()))
        if not key or key in seen:
            problems.append(f"group {g.name} has no labels of its own" if not key else f"groups {seen[key]} and {g.name} have the same labels")
        seen.setdefault(key, g.name)
    if problems and dedup:
        raise ConfigError("; ".join(problems))
    return problems


def check_ignore(names) -> None:
    seen = set()
    for n in names:
        if not n or n == NAME or not _LABEL.fullmatch(n) or n in seen:
            raise ConfigError(f"bad ignore label {n!r}")
        seen.add(n)


