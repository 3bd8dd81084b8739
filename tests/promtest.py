"""A small load / eval notation for tests: series text to samples, and results as {label text: value}."""

import math
import re

from seriesloom.engine import Engine, Options
from seriesloom.plans.syntax import duration
from seriesloom.sources.groups import SourceGroup
from seriesloom.sources.model import HIST

SCHEMA = f"labels map<string,string>, ts_ms long, value double, stale boolean, hist {HIST}"


def points(text: str):
    """`a+bxn`, `axn`, `_`, `_xn`, `NaN`, `stale`, numbers."""
    out = []
    for part in text.split():
        if m := re.fullmatch(r"(-?[\d.]+)([+-][\d.]+)x(\d+)", part):
            out += [float(m[1]) + float(m[2]) * i for i in range(int(m[3]) + 1)]
        elif m := re.fullmatch(r"_x(\d+)", part):
            out += [None] * int(m[1])
        elif m := re.fullmatch(r"(-?[\d.]+|NaN)x(\d+)", part):
            out += [float(m[1])] * (int(m[2]) + 1)
        else:
            out.append(None if part == "_" else part if part == "stale" else float(part))
    return out


def labels_from(text: str) -> dict:
    name, _, rest = text.partition("{")
    out = {k: v for k, v in re.findall(r'(\w+)="([^"]*)"', rest)}
    return ({"__name__": name} if name else {}) | out


def load(spark, interval: str, script: str, hist: bool = False):
    from pyspark.sql import functions as F

    from seriesloom.sources.model import key_of

    step, rows = duration(interval), []
    for line in filter(None, map(str.strip, script.strip().splitlines())):
        m = re.fullmatch(r"(\S*?(?:\{[^}]*\})?)\s+(.*)", line)
        for i, v in enumerate(points(m[2])):
            if v is not None:
                rows.append((labels_from(m[1]), i * step, math.nan if v == "stale" else v, v == "stale", None))
    df = spark.createDataFrame(rows, SCHEMA)
    if not hist:
        df = df.drop("hist")
    return df.select(F.lit(0).alias("group_ord"), F.lit(0).alias("replica"), "*", key_of(F.col("labels")).alias("lkey"))


def engine(spark, *groups, **options) -> Engine:
    made = [g if isinstance(g, SourceGroup) else SourceGroup([g]) for g in groups]
    return Engine(spark, made, Options(**{"experimental": True, "strict_labels": False} | options))


def text(labels: dict) -> str:
    name = labels.get("__name__", "")
    rest = ",".join(f'{k}="{v}"' for k, v in sorted(labels.items()) if k != "__name__")
    return name + (f"{{{rest}}}" if rest else "")


def at(eng: Engine, query: str, when: str = "0s") -> dict:
    out = eng.query(query, duration(when))
    found = {}
    for r in out.collect():
        assert text(r["labels"]) not in found, "two results of one label set"
        found[text(r["labels"])] = r["value"]
    return found


def over(eng: Engine, query: str, start: str, end: str, step: str) -> dict:
    found: dict = {}
    for r in eng.query_range(query, duration(start), duration(end), duration(step)).orderBy("step").collect():
        found.setdefault(text(r["labels"]), []).append((r["step"] // 1000, r["value"]))
    return found


def same(a: dict, b: dict) -> None:
    assert sorted(a) == sorted(b), (a, b)
    for k in b:
        assert a[k] == b[k] or (math.isnan(a[k]) and math.isnan(b[k])) or math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12), (k, a[k], b[k])
