"""Replica merging, priority dedup and gap filling against plain Python versions and literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from promtest import SCHEMA, engine, load
from seriesloom.operators import merge
from seriesloom.sources.groups import SourceGroup
from seriesloom.sources.model import key_of


def make(spark, rows, labels=None, ord_=0):
    """rows: (ts, value or None for a stale marker[, labels])."""
    data = [((r[2] if len(r) > 2 else labels) or {"__name__": "m"}, r[0], float("nan") if r[1] is None else float(r[1]), r[1] is None, None) for r in rows]
    return spark.createDataFrame(data, SCHEMA).drop("hist").select(F.lit(ord_).alias("group_ord"), F.lit(0).alias("replica"), "*", key_of(F.col("labels")).alias("lkey"))


def pairs(df):
    return sorted((r["ts_ms"], None if r["stale"] else r["value"]) for r in df.collect())


def ha(spark, parts, buffer, dynamic=False, prefer_max=False):
    every = [make(spark, p).withColumn("replica", F.lit(i)) for i, p in enumerate(parts)]
    df = every[0]
    for x in every[1:]:
        df = df.unionByName(x)
    return pairs(merge.merge_replicas(df, list(range(len(parts))), buffer, dynamic, prefer_max))


def slow_merge(a, b, d, prefer_max):
    """Every sample on its own: does the rule let it in, and at what value."""
    base, other = (b, a) if len(b) > len(a) else (a, b)
    times = [t for t, _ in base]

    def enters(t):
        before, after = [x for x in times if x <= t], [x for x in times if x >= t]
        if not before or not after:
            return all(abs(t - x) > d for x in before[-1:] + after[:1])
        return after[0] - before[-1] > 2 * d and before[-1] + d < t < after[0] - d

    def value(t, v):
        inside = [x for x in other if t - d < x[0] < t + d or x[0] == t]
        leads = t == times[0] and not any(x[0] < t - d for x in other)
        return v if leads or not inside else max(v, min(inside)[1])

    if not base or not other:
        return sorted(base or other)
    return sorted([(t, value(t, v) if prefer_max else v) for t, v in base] + [x for x in other if enters(x[0])])


def test_interleaved_hosts(spark):
    assert ha(spark, [[(200, 10), (400, 10)], [(100, 10), (300, 10)]], 100) == [(200, 10.0), (400, 10.0)]


@pytest.mark.parametrize("prefer_max", [False, True])
def test_merge_random(spark, prefer_max):
    rnd = random.Random(5)
    for _ in range(4):
        a, b = (sorted({rnd.randrange(0, 60) * 10: rnd.randrange(100) for _ in range(rnd.randrange(1, 25))}.items()) for _ in range(2))
        d = rnd.choice([0, 10, 25, 40])
        assert ha(spark, [a, b], d, prefer_max=prefer_max) == [(t, float(v)) for t, v in slow_merge(a, b, d, prefer_max)], (a, b, d)


def test_dynamic_buffer(spark):
    a = [(i * 60_000, 1) for i in range(8) if i != 4]
    b = [(i * 60_000 + 20_000, 2) for i in range(8)]
    got = ha(spark, [a, b], 1000, dynamic=True)  # b is longer: half the median gap of 60 s; a's samples are 20 s off
    assert got == [(t, 2.0) for t, _ in b]
    assert ha(spark, [[(0, 1), (10_000, 1)], [(5_000, 2)]], 1000, dynamic=True) == [(0, 1.0), (5_000, 2.0), (10_000, 1.0)]


FILL = [
    ([(0, 1), (10, 2), (20, 3)], [(0, 100), (10, 101), (20, 102)], 15, [(0, 1), (10, 2), (20, 3)]),
    ([(0, 1), (10, 2), (40, 5)], [(0, 100), (10, 101), (20, 102), (30, 103), (40, 104)], 15, [(0, 1), (10, 2), (20, 102), (30, 103), (40, 5)]),
    ([(20, 1), (30, 2)], [(0, 100), (10, 101), (40, 104), (50, 105)], 8, [(0, 100), (10, 101), (20, 1), (30, 2), (40, 104), (50, 105)]),
    ([(0, 1), (10, None), (12, 3)], [(11, 9)], 15, [(0, 1), (10, None), (12, 3)]),
    ([(0, 1), (10, None), (40, 3)], [(20, 9), (25, None), (30, None)], 15, [(0, 1), (10, None), (20, 9), (25, None), (40, 3)]),
]


@pytest.mark.parametrize("base,filler,gap,expected", FILL)
def test_fill_from_one(spark, base, filler, gap, expected):
    groups = [make(spark, base, {"__name__": "m", "g": "a"}), make(spark, filler, {"__name__": "m", "g": "b"}, 1)]
    got = merge.dedup(groups, {"g"}, True, gap)
    assert pairs(got) == [(t, None if v is None else float(v)) for t, v in expected]
    assert {r["labels"]["g"] for r in got.collect()} == {"a"}


def filled(seqs, gap):
    """The rule over whole spans: the samples of a source that are clear of a span's ends cut it, and pairs of neighbours that are a
    gap are the next source's spans."""
    kept, spans = [], [(float("-inf"), float("inf"))]
    for level, seq in enumerate(seqs):
        pieces = []
        for low, high in spans:
            cuts = [x for x in seq if low + gap // 4 < x[0] < high - gap // 4]
            markers = {t for t, v in cuts if v is None}
            first = [None, *(v for _, v in cuts)]  # what stands before each sample in the span
            kept += [x for x, before in zip(cuts, first) if level == 0 or x[1] is not None or before is not None]
            edges = [low, *(t for t, _ in cuts), high]
            pieces += [(p, q) for p, q in zip(edges, edges[1:]) if p in markers or q - p >= gap]
        spans = pieces
    return sorted(kept, key=lambda x: x[0])


@pytest.mark.parametrize("members", [2, 3, 4])
def test_fill_random(spark, members):
    rnd = random.Random(members)
    for _ in range(3):
        seqs = [sorted({rnd.randrange(0, 80) * 5: (None if rnd.random() < 0.15 else rnd.randrange(100)) for _ in range(rnd.randrange(2, 22))}.items()) for _ in range(members)]
        groups = [make(spark, s, {"__name__": "m", "g": str(i)}, i) for i, s in enumerate(seqs)]
        assert pairs(merge.dedup(groups, {"g"}, True, 20)) == [(t, None if v is None else float(v)) for t, v in filled(seqs, 20)]


def test_auto_threshold(spark):
    groups = [make(spark, [(0, 1), (10, 1), (20, 1), (60, 1)], {"__name__": "m", "g": "a"}), make(spark, [(i, 2) for i in range(0, 70, 5)], {"__name__": "m", "g": "b"}, 1)]
    # median interval 10, so gaps from 20 on; a filler stays more than 5 away from the base, whose end at 60 leaves 65 out
    assert [t for t, _ in pairs(merge.dedup(groups, {"g"}))] == [0, 10, 20, 30, 35, 40, 45, 50, 60]


def test_automatic_threshold_of_many_sources(spark):
    """The base has one sample only, so the first filler's median counts; a bucket without an interval has a gap of 1 ms."""
    seqs = [[(500, 1)], [(i, 2) for i in range(0, 1000, 40) if not 200 < i < 400], [(i, 3) for i in range(0, 1000, 30)]]
    groups = [make(spark, s, {"__name__": "m", "g": str(i)}, i) for i, s in enumerate(seqs)]
    assert pairs(merge.dedup(groups, {"g"})) == [(t, float(v)) for t, v in filled(seqs, 80)]
    single = [make(spark, [(10 * i, i)], {"__name__": "m", "g": str(i)}, i) for i in range(3)]
    assert [t for t, _ in pairs(merge.dedup(single, {"g"}))] == [0, 10, 20]


def test_filling_takes_time_in_proportion(spark):
    """No array of a series' intervals on every row: ten times the samples, far from a hundred times the time."""
    import time

    took = []
    for n in (2_000, 20_000):
        base = spark.range(n).where("id % 50 < 40").select(F.lit(0).alias("group_ord"), F.lit(0).alias("replica"), F.create_map(F.lit("__name__"), F.lit("m"), F.lit("g"), F.lit("a")).alias("labels"), (F.col("id") * 1000).alias("ts_ms"), F.col("id").cast("double").alias("value"), F.lit(False).alias("stale"))
        other = spark.range(n).select(F.lit(1).alias("group_ord"), F.lit(0).alias("replica"), F.create_map(F.lit("__name__"), F.lit("m"), F.lit("g"), F.lit("b")).alias("labels"), (F.col("id") * 1000).alias("ts_ms"), F.lit(-1.0).alias("value"), F.lit(False).alias("stale"))
        groups = [x.withColumn("lkey", key_of(F.col("labels"))) for x in (base, other)]
        began = time.time()
        assert merge.dedup(groups, {"g"}).count() == n  # every gap is filled, but for the margin, which is a quarter of 2 s
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 4


def test_dedup_rules(spark):
    cpu = lambda g, o, v: make(spark, [(0, v)], {"__name__": "cpu", "backend": g}, o)
    mem = make(spark, [(0, 7)], {"__name__": "mem", "backend": "sg0"}, 0)
    groups = [mem, cpu("sg1", 1, 1), cpu("sg2", 2, 2)]
    got = {(r["labels"]["__name__"], r["labels"]["backend"]) for r in merge.dedup(groups, {"backend"}, False).collect()}
    assert got == {("mem", "sg0"), ("cpu", "sg1")}
    assert [tuple(r) for r in merge.collisions(groups, {"backend"}).collect()] == [(1, 2, 1)]
    one = merge.dedup([cpu("a", 0, 1).unionByName(cpu("b", 0, 2))], {"backend"})
    assert one.count() == 2  # a single group passes through
    same = [make(spark, [(0, 1)], {"__name__": "x"}, 0), make(spark, [(0, 2)], {"__name__": "x"}, 1)]
    assert [r["value"] for r in merge.dedup(same, set()).collect()] == [1.0]
    assert merge.collisions(same, set()).count() == 0


def test_modes(spark):
    a, b = load(spark, "1m", 'up{i="0"} 1x10\nup{i="1"} 1x10\n'), load(spark, "1m", 'up{i="0"} 1x10\n')
    groups = lambda: [SourceGroup([a], {"az": "a"}), SourceGroup([b], {"az": "b"})]
    count = lambda **o: [r["value"] for r in engine(spark, *groups(), **o).query("count(up)", 300_000).collect()]
    assert count() == [2.0] and count(mode="union") == [3.0] and count(mode="dedup") == [3.0]
    raw = engine(spark, *groups(), mode="dedup").query("up", 300_000).collect()
    assert len(raw) == 2


def test_exact_equals_one_store(spark):
    """Groups cut from a store, with gaps and overlap, answer as the store does."""
    whole = load(spark, "1m", 'foo{id="a"} 0+60x20\nfoo{id="b"} 0+30x20\n')
    early, late = whole.where("ts_ms <= 600000"), whole.where("ts_ms >= 480000")
    e = engine(spark, SourceGroup([early], {"g": "1"}), SourceGroup([late], {"g": "2"}))
    ref = engine(spark, whole)
    for q in ("sum(rate(foo[5m]))", "sum by (id) (foo)", "max_over_time(sum(foo)[5m:1m])", "topk(1, foo)", "count(foo) / 2"):
        got, want = (sorted((r["step"], round(r["value"], 9)) for r in x.query_range(q, 300_000, 1_200_000, 60_000).collect()) for x in (e, ref))
        assert got == want, q


def test_merge_vectors(spark):
    v = lambda *rows: spark.createDataFrame(rows, "lkey string, step long, value double")
    a, b = v(("x", 0, 0.0), ("y", 0, 2.0)), v(("x", 0, 5.0), ("y", 0, 7.0), ("z", 0, 0.0))
    rows = lambda df: sorted((r["lkey"], r["value"]) for r in df.collect())
    assert rows(merge.merge_vectors([a, b])) == [("x", 5.0), ("y", 2.0), ("z", 0.0)]
    assert rows(merge.merge_vectors([a, b], True)) == [("x", 5.0), ("y", 7.0), ("z", 0.0)]


def test_step_alignment(spark):
    g = SourceGroup([load(spark, "1m", "m 1x3\n")], align_with_step=True)
    got = engine(spark, g, lookback_ms=60_000).query_range("m", 15_000, 255_000, 60_000).orderBy("step").collect()
    assert [r["step"] for r in got] == [15_000, 75_000, 135_000, 195_000]
