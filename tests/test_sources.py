import json

import pytest
from pyspark.sql import functions as F

from promtest import at, engine, load, same
from seriesloom.engine import Engine, Options, SourceError
from seriesloom.functions.num import sample_text
from seriesloom.plans.syntax import Matcher
from seriesloom.sources import catalog, formats
from seriesloom.sources.groups import ConfigError, LabelFilter, Relabel, SourceGroup, TimeRange, check_groups
from seriesloom.sources.model import Grid


@pytest.fixture(scope="module")
def base(spark):
    return load(spark, "1m", 'foo{id="a",env="Prod"} 1x10\nfoo{id="b",env="Dev"} 2x10\nbar{id="a"} 3x10\n').cache()


def test_labels_and_pruning(spark, base):
    g = SourceGroup([base], {"dc": "x"})
    assert not g.may_match([Matcher("dc", "=", "y")]) and g.may_match([Matcher("dc", "=~", "x|y")])
    e = engine(spark, g)
    same(at(e, 'foo{dc="x",id="a"}', "5m"), {'foo{dc="x",env="Prod",id="a"}': 1.0})
    assert at(e, 'foo{dc="y"}', "5m") == {}


def test_inject_and_filters(spark, base):
    same(at(engine(spark, SourceGroup([base], inject=(Matcher("id", "!=", "b"),))), "count(foo)", "5m"), {"": 1.0})
    two = ((Matcher("id", "=", "b"),), (Matcher("__name__", "=", "bar"),))
    same(at(engine(spark, SourceGroup([base], extra_filters=two)), 'count({id=~".+"})', "5m"), {"": 2.0})


def test_label_filter(spark, base):
    g = SourceGroup([base], label_filter=LabelFilter(dynamic=("id",), exclude={"id": ("b",)}))
    assert g.may_match([Matcher("id", "=", "a")]) and not g.may_match([Matcher("id", "=", "b")]) and not g.may_match([Matcher("id", "=", "zzz")])
    assert SourceGroup([base], label_filter=LabelFilter(include={"job": ("q",)})).may_match([Matcher("job", "=~", "q.*")])


def test_relabel(spark, base):
    g = SourceGroup([base], relabel=(Relabel("lowercase", ("env",), "env"), Relabel("replace", ("id",), "who", "(a)", "is-$1"), Relabel("labeldrop", regex="id")))
    same(at(engine(spark, g), 'foo{env="prod"}', "5m"), {'foo{env="prod",who="is-a"}': 1.0})
    with pytest.raises(ConfigError):
        at(engine(spark, SourceGroup([base], relabel=(Relabel("keep"),))), "foo", "5m")


def test_time_ranges(spark, base):
    g = SourceGroup([base], time_range=TimeRange(120_000, 240_000, truncate=True))
    e = engine(spark, g, lookback_ms=60_000)
    assert [r["step"] for r in e.query_range('foo{id="a"}', 0, 600_000, 60_000).orderBy("step").collect()] == [120_000, 180_000, 240_000]
    assert at(engine(spark, SourceGroup([base], time_range=TimeRange(120_000, 240_000))), "foo", "10m") == {}
    relative = Engine(spark, [SourceGroup([base], time_range=TimeRange(-60_000, None, relative=True, truncate=True))], now_ms=300_000)
    assert at(relative, "count(foo)", "5m") == {"": 2.0}
    with pytest.raises(ConfigError):
        TimeRange(5, 1)


def test_config_checks(base):
    with pytest.raises(ConfigError):
        check_groups([SourceGroup([base]), SourceGroup([base])], True)
    assert check_groups([SourceGroup([base]), SourceGroup([base])], False) and not check_groups([SourceGroup([base])], True)
    for bad in ({"mode": "x"}, {"gap_ms": -1}, {"gap_ms": 5, "fill_gaps": False}, {"ignore_labels": ("__name__",)}, {"ignore_labels": ("a", "a")}, {"mode": "union", "partial_response": True}):
        with pytest.raises(ConfigError):
            Options(**bad)
    assert SourceGroup([base], anti_affinity_ms=1999).anti_affinity_ms == 1000


def test_broken_sources(spark, base):
    broken = spark.range(3)
    ok = {"labels": {"g": "1"}}
    assert at(engine(spark, SourceGroup([base], **ok), SourceGroup([broken], {"g": "2"}, ignore_error=True)), "count(foo)", "5m") == {"": 2.0}
    e = engine(spark, SourceGroup([base], **ok), SourceGroup([broken], {"g": "2"}), partial_response=True)
    assert at(e, "count(foo)", "5m") == {"": 2.0} and any("sg-1" in w for w in e.warnings), e.warnings
    with pytest.raises(SourceError):
        at(engine(spark, SourceGroup([base], **ok), SourceGroup([broken], {"g": "2"})), "foo", "5m")


def test_metadata(spark, base):
    e = engine(spark, base)
    assert [r[0] for r in e.label_names().collect()] == ["__name__", "env", "id"]
    assert [r[0] for r in e.label_values("id", "foo").collect()] == ["a", "b"]
    assert e.series("foo", "bar").count() == 3
    c = e.cardinality(1, "id")
    assert [tuple(r) for r in c["totals"].collect()] == [(0, 3, 6)]
    assert [tuple(r) for r in c["series_by_metric"].collect()] == [(0, "foo", 2)] and [tuple(r) for r in c["series_by_focus"].collect()] == [(0, "a", 2)]
    with pytest.raises(ValueError):
        e.cardinality(0)
    two = engine(spark, SourceGroup([base], {"g": "1"}), SourceGroup([base], {"g": "2"}), dedup_metadata=True)
    assert two.series("foo").count() == 2
    shown, counts = catalog.truncate(e.query_range("foo", 0, 600_000, 60_000), 1, 3)
    assert shown.count() == 3 and counts == {"series": 2, "samples": 26, "shown_series": 1, "shown_samples": 3} or counts["series"] == 2
    assert [tuple(r) for r in e.stats("foo + bar", 0, 600_000, 60_000).collect()] == [(0, 2, 0, 3, 33)]


def test_federate_and_exposition(spark, base):
    rows = engine(spark, base).federate(["foo", 'foo{id="a"}', "bar"], 300_000, {"id": "never", "cluster": "c"}).collect()
    assert [(r["labels"]["__name__"], r["labels"]["id"], r["labels"]["cluster"]) for r in rows] == [("bar", "a", "c"), ("foo", "b", "c"), ("foo", "a", "c")] or len(rows) == 3
    df = spark.createDataFrame([({"__name__": "m", "a": 'x"\\\n'}, float("inf"), 5), ({"__name__": "n"}, 1.5, 6)], "labels map<string,string>, value double, ts_ms long")
    assert sorted(r[0] for r in formats.exposition(df).collect()) == ['m{a="x\\"\\\\\\n"} +Inf 5', "n 1.5 6"]


def test_sample_text(spark):
    cases = {6.0: "6", 0.5: "0.5", -0.25: "-0.25", 1e21: "1e+21", 1e-7: "1e-07", 12345678.0: "12345678", 1e15: "1000000000000000", 0.0001: "0.0001", 1.5e7: "15000000", float("inf"): "+Inf"}
    df = spark.createDataFrame([(k,) for k in cases], "v double").select("v", sample_text(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == cases


def test_export_lines(spark, tmp_path):
    lines = [{"metric": {"__name__": "m", "a": "1"}, "values": [1, None, "Infinity"], "timestamps": [20, 10, 30]}, {"metric": {"__name__": "m", "a": "1"}, "values": [9], "timestamps": [20]}]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, lines)))
    got = formats.read_export(spark, str(tmp_path / "x.json")).orderBy("ts_ms").collect()
    assert [(r["ts_ms"], str(r["value"])) for r in got] == [(10, "nan"), (20, "9.0"), (30, "inf")]
    (tmp_path / "y.json").write_text(json.dumps({"metric": {}, "values": [1, 2], "timestamps": [1]}))
    with pytest.raises(Exception, match="differ in length"):
        formats.read_export(spark, str(tmp_path / "y.json")).collect()


def test_responses(spark, tmp_path):
    body = {"status": "success", "warnings": ["w"], "data": {"resultType": "matrix", "result": [{"metric": {"a": "b"}, "values": [[1, "2"], [1.5, "NaN"]]}]}}
    (tmp_path / "r.json").write_text(json.dumps(body))
    df, warnings = formats.read_response(spark, str(tmp_path / "r.json"))
    assert warnings == ["w"] and [(r["lkey"], r["ts_ms"]) for r in df.orderBy("ts_ms").collect()] == [('[{"key":"a","value":"b"}]', 1000), ('[{"key":"a","value":"b"}]', 1500)]
    (tmp_path / "s.json").write_text(json.dumps({"status": "success", "data": {"resultType": "scalar", "result": [3, "4"]}}))
    assert [tuple(r) for r in formats.read_response(spark, str(tmp_path / "s.json"))[0].collect()] == [("[]", 3000, 4.0)]
    (tmp_path / "t.json").write_text(json.dumps({"status": "success", "data": {"resultType": "odd", "result": []}}))
    with pytest.raises(ValueError, match="unknown result type"):
        formats.read_response(spark, str(tmp_path / "t.json"))


def test_synthetic(spark):
    g = Grid(0, 60_000, 15_000)
    a, b = formats.synthetic(spark, 10, g, instance=0), formats.synthetic(spark, 10, g, instance=1)
    assert a.count() == 50 and a.select("lkey").intersect(b.select("lkey")).count() == 5


def test_metric_metadata_and_exemplars(spark):
    m = spark.createDataFrame([(1, "x", "gauge", "b", ""), (0, "x", "counter", "a", ""), (1, "y", "gauge", "c", "")], "group_ord int, metric string, type string, help string, unit string")
    assert [tuple(r)[:2] for r in catalog.metric_metadata(m).collect()] == [("x", "counter"), ("y", "gauge")]
    assert catalog.metric_metadata(m, limit=1).count() == 1
    e = spark.createDataFrame([({"__name__": "h"}, {"t": "1"}, 1.0, 10), ({"__name__": "h"}, {"t": "2"}, 2.0, 5), ({"__name__": "z"}, {"t": "3"}, 2.0, 5)], "series_labels map<string,string>, ex_labels map<string,string>, value double, ts_ms long")
    rows = catalog.exemplars(e, [Matcher("__name__", "=", "h")], 0, 20).collect()
    assert len(rows) == 1 and [x["ts_ms"] for x in rows[0]["exemplars"]] == [5, 10]


def test_sample_files(spark, tmp_path, base):
    base.select("labels", "ts_ms", "value").write.parquet(str(tmp_path / "s"))
    assert at(engine(spark, formats.read_samples(spark, str(tmp_path / "s"))), "count(foo)", "5m") == {"": 2.0}


def test_default_step():
    from seriesloom.engine import default_step

    assert default_step(0, 3_600_000) == 15_000 and default_step(0, 10) == 1000


def test_table_scan_pushes_down(spark):
    from seriesloom.sources.model import TableSource, events_source

    source = events_source(spark, "/root/testdata/sf0.001")
    rows = source.scan((Matcher("event_type", "=", "view"), Matcher("user_id", "=~", "1.*"), Matcher("nope", "=", "")), 1_704_153_600_000, 1_705_000_000_000)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan and "GreaterThanOrEqual(ts" in plan
    want = source.scan().where("labels.event_type = 'view' and labels.user_id like '1%' and ts_ms > 1704153600000 and ts_ms <= 1705000000000").count()
    assert rows.count() == want > 0
    assert isinstance(source, TableSource) and source.scan((Matcher("nope", "=", "x"),)).count() == 0


def test_target_rules():
    from seriesloom.sources.groups import relabel_targets

    targets = [{"__address__": f"h{i}:9090", "dc": dc, "__meta_role": "DB"} for i, dc in enumerate(("eu", "us", "ap"))]
    rules = (Relabel("drop", ("dc",), regex="ap"), Relabel("labelmap", regex="__meta_(.+)"), Relabel("lowercase", ("role",), "role"), Relabel("replace", ("__address__", "dc"), "id", "([^:]+):.*;(.*)", "$2-${1}"), Relabel("labeldrop", regex="__meta.*"))
    assert relabel_targets(targets, rules) == [{"__address__": "h0:9090", "dc": "eu", "role": "db", "id": "eu-h0"}, {"__address__": "h1:9090", "dc": "us", "role": "db", "id": "us-h1"}]
    assert relabel_targets(targets, (Relabel("keep", ("dc",), regex="eu|us"), Relabel("labelkeep", regex="__address__"))) == [{"__address__": "h0:9090"}, {"__address__": "h1:9090"}]
    with pytest.raises(ConfigError, match="no address"):
        relabel_targets([{"dc": "eu"}], ())


def test_sources_that_fail_while_they_are_read(spark, tmp_path):
    """A file that breaks only when it is read: an error, a warning or nothing, as the group says."""
    good = load(spark, "1m", 'up{i="0"} 1x10\n')
    path = str(tmp_path / "broken")
    good.write.parquet(path)
    broken = spark.read.schema(good.schema).parquet(path)
    for f in tmp_path.glob("broken/*.parquet"):
        f.write_bytes(b"PAR1 not a table PAR1")
    groups = lambda **o: (SourceGroup([good], {"g": "a"}), SourceGroup([broken], {"g": "b"}, **o))
    e = engine(spark, *groups(ignore_error=True))
    assert [r["value"] for r in e.query("count(up)", 300_000).collect()] == [1.0] and not e.warnings
    e = engine(spark, *groups(downgrade_error=True))
    assert [r["value"] for r in e.query("count(up)", 300_000).collect()] == [1.0] and "sg-1" in e.warnings[0]
    e = engine(spark, *groups(), partial_response=True)
    assert [r["value"] for r in e.query("count(up)", 300_000).collect()] == [1.0] and e.warnings
    stats = {r["group_ord"]: r for r in e.stats("up", 0, 600_000, 60_000).collect()}
    assert (stats[0]["requests"], stats[0]["errors"], stats[0]["samples"]) == (1, 0, 11) and stats[1]["errors"] == 1
    assert [r["error"] for r in e.requests] == [None, "unavailable"]
    with pytest.raises(SourceError, match="no group"):
        engine(spark, SourceGroup([broken], {"g": "b"}), partial_response=True).query("count(up)", 300_000)


def test_kinds_of_errors():
    from seriesloom.engine import source_error
    from seriesloom.plans.syntax import QueryError

    assert source_error("g", QueryError("bad")).kind == "bad_data" and str(source_error("g", QueryError("bad"))) == "bad"
    assert [source_error("g", RuntimeError(x)).kind for x in ("Job 3 cancelled", "read timed out", "no such host")] == ["canceled", "timeout", "unavailable"]


def test_caps_and_their_report(spark):
    e = engine(spark, load(spark, "1m", 'up{i="0"} 1x10\nup{i="1"} 1x10\nup{i="2"} 1x10\n'))
    shown, report = e.capped_range("up", 0, 600_000, 60_000, max_series=2, max_samples=15)
    assert shown.count() == 15 and {r["labels"]["i"] for r in shown.collect()} == {"0", "1"}
    assert tuple(report.collect()[0]) == (3, 33, 2, 15)
    assert e.capped_range("up", 0, 600_000)[0].count() == 3 * 201  # an open step gives about 250 points: 3 s


def test_matchers_pass_relabelling_that_leaves_their_label(spark):
    """They reach the scan; those of changed labels stay behind it."""
    rows = load(spark, "1m", 'up{i="0",z="a"} 1x3\nup{i="1",z="b"} 1x3\n')
    g = SourceGroup([rows], relabel=(Relabel("uppercase", ("z",), "z"),))
    got = g.samples((Matcher("i", "=", "0"), Matcher("z", "=", "A")))
    assert {r["labels"]["z"] for r in got.collect()} == {"A"} and got.count() == 4
    assert g.samples((Matcher("z", "=", "a"),)).count() == 0


def test_keys_cut_as_text_equal_keys_of_the_labels(spark):
    from seriesloom.sources.model import key_of, key_only, key_without, labels_of, only, without

    values = ["x", "", 'a "quoted" one', "back\\slash\\", '{"key":"a","value":"z"}', "comma,]", "ü\n\t", "\\\""]
    rows = [({"__name__": v, "a": w, "b.c": v + w, "z": w},) for v in values for w in values]
    df = spark.createDataFrame(rows, "labels map<string,string>").withColumn("lkey", key_of(F.col("labels")))
    for names in (["__name__"], ["a"], ["z", "__name__"], ["b.c", "a"], ["__name__", "a", "b.c", "z"], ["nope"], []):
        bad = df.where((key_without(F.col("lkey"), names) != key_of(without(labels_of(F.col("lkey")), names))) | (key_only(F.col("lkey"), names) != key_of(only(labels_of(F.col("lkey")), names))))
        assert bad.count() == 0, names
