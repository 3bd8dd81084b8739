import math

import pytest

from promtest import at, engine, load, over, same
from seriesloom.plans.syntax import QueryError, parse

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def http(spark):
    df = load(spark, "5m", """
        http_requests{job="api",instance="0",group="prod"} 0+10x10
        http_requests{job="api",instance="1",group="prod"} 0+20x10
        http_requests{job="api",instance="0",group="canary"} 0+30x10
        http_requests{job="api",instance="1",group="canary"} 0+40x10
        http_requests{job="app",instance="0",group="prod"} 0+50x10
        http_requests{job="app",instance="1",group="prod"} 0+60x10
        http_requests{job="app",instance="0",group="canary"} 0+70x10
        http_requests{job="app",instance="1",group="canary"} 0+80x10
        meta{job="api",team="red"} 1x10
        meta{job="app",team="blue"} 1x10
        other{x="NaN"} NaN NaN NaN NaN NaN NaN NaN NaN NaN NaN NaN
    """).cache()  # fmt: skip
    return engine(spark, df)


CASES = [
    ('sum by (group) (http_requests{job="api"})', {'{group="canary"}': 700.0, '{group="prod"}': 300.0}),
    ('sum without (instance) (http_requests{job="api"})', {'{group="canary",job="api"}': 700.0, '{group="prod",job="api"}': 300.0}),
    ("sum(http_requests)", {"": 3600.0}),
    ('avg by (group) (http_requests{job="api"})', {'{group="canary"}': 350.0, '{group="prod"}': 150.0}),
    ('count by (group) (http_requests{job="api"})', {'{group="canary"}': 2.0, '{group="prod"}': 2.0}),
    ("min(http_requests)", {"": 100.0}),
    ("max(http_requests)", {"": 800.0}),
    ("group(http_requests)", {"": 1.0}),
    ("stddev(http_requests)", {"": 229.12878474779},),
    ('stdvar by (job) (http_requests)', {'{job="api"}': 12500.0, '{job="app"}': 12500.0}),
    ("max(other)", {"": NAN}),
    ("topk(2, http_requests)", {'http_requests{group="canary",instance="1",job="app"}': 800.0, 'http_requests{group="canary",instance="0",job="app"}': 700.0}),
    ('bottomk by (job) (1, http_requests)', {'http_requests{group="prod",instance="0",job="api"}': 100.0, 'http_requests{group="prod",instance="0",job="app"}': 500.0}),
    ("quantile(0.5, http_requests)", {"": 450.0}),
    ("quantile(2, http_requests)", {"": INF}),
    ('count_values("v", http_requests{instance="0"})', {f'{{v="{v}"}}': 1.0 for v in (100, 300, 500, 700)}),
    ('count_values by (job) ("job", meta)', {'{job="1"}': 2.0}),
    ("count(limitk(3, http_requests))", {"": 3.0}),
    ("count(limit_ratio(1, http_requests))", {"": 8.0}),
    ('http_requests{job=~"a.i",instance!="0",group!~"can.*"}', {'http_requests{group="prod",instance="1",job="api"}': 200.0}),
    ('http_requests{group="prod",job="api"} * on(job) group_left(team) meta', {'{group="prod",instance="0",job="api",team="red"}': 100.0, '{group="prod",instance="1",job="api",team="red"}': 200.0}),
    ('meta{job="api"} * on(job) group_right() http_requests{job="api",group="prod"}', {'{group="prod",instance="0",job="api"}': 100.0, '{group="prod",instance="1",job="api"}': 200.0}),
    ('http_requests{group="prod",job="api"} / ignoring(group) http_requests{group="canary",job="api"}', {'{instance="0",job="api"}': 1 / 3, '{instance="1",job="api"}': 0.5}),
    ("http_requests > 650", {'http_requests{group="canary",instance="1",job="app"}': 800.0, 'http_requests{group="canary",instance="0",job="app"}': 700.0}),
    ('http_requests{instance="0",group="prod"} > bool 300', {'{group="prod",instance="0",job="api"}': 0.0, '{group="prod",instance="0",job="app"}': 1.0}),
    ('http_requests{instance="0"} and http_requests{group="prod"}', {'http_requests{group="prod",instance="0",job="api"}': 100.0, 'http_requests{group="prod",instance="0",job="app"}': 500.0}),
    ('http_requests{instance="0",job="api"} unless http_requests{group="prod"}', {'http_requests{group="canary",instance="0",job="api"}': 300.0}),
    ('meta{job="api"} or on(job) http_requests{group="prod",instance="0"}', {'meta{job="api",team="red"}': 1.0, 'http_requests{group="prod",instance="0",job="app"}': 500.0}),
    ("-meta", {'{job="api",team="red"}': -1.0, '{job="app",team="blue"}': -1.0}),
    ("1 + 2 * 3 ^ 2", {"": 19.0}), ("-2 ^ 2", {"": -4.0}), ("1 / 0", {"": INF}), ("-1 / 0", {"": -INF}), ("0 / 0", {"": NAN}), ("5 % 0", {"": NAN}), ("-7 % 3", {"": -1.0}), ("1 < bool 2", {"": 1.0}), ("0x1F", {"": 31.0}), ("5m", {"": 300.0}),
    ("vector(1) == bool vector(1)", {"": 1.0}), ("vector(NaN) == vector(NaN)", {}), ("vector(NaN) != bool 1", {"": 1.0}),
    ("scalar(meta)", {"": NAN}), ('scalar(meta{job="api"})', {"": 1.0}), ("time()", {"": 3000.0}), ("pi()", {"": math.pi}),
    ("absent(nothing{a=\"b\"})", {'{a="b"}': 1.0}), ("absent(meta)", {}), ('absent_over_time(nothing{a="b",c=~"d"}[5m])', {'{a="b"}': 1.0}), ("absent_over_time(meta[5m])", {}),
    ('label_replace(meta{job="api"}, "who", "$1-x", "team", "(r.)d")', {'meta{job="api",team="red",who="re-x"}': 1.0}),
    ('label_replace(meta{job="api"}, "who", "$1", "team", "nomatch")', {'meta{job="api",team="red"}': 1.0}),
    ('label_join(meta{job="api"}, "all", "-", "job", "team")', {'meta{all="api-red",job="api",team="red"}': 1.0}),
    ('clamp(http_requests{job="api",group="prod"}, 120, 150)', {'{group="prod",instance="0",job="api"}': 120.0, '{group="prod",instance="1",job="api"}': 150.0}),
    ("clamp(meta, 5, 1)", {}), ("round(vector(2.5))", {"": 3.0}), ("round(vector(7.3), 0.5)", {"": 7.5}), ("sgn(vector(-3))", {"": -1.0}), ("ln(vector(0))", {"": -INF}), ("log2(vector(8))", {"": 3.0}), ("log10(vector(-1))", {"": NAN}), ("sqrt(vector(-1))", {"": NAN}), ("ceil(vector(Inf))", {"": INF}), ("floor(vector(-1.5))", {"": -2.0}), ("deg(vector(pi()))", {"": 180.0}),
    ("day_of_week(vector(0))", {"": 4.0}), ("days_in_month(vector(5000000))", {"": 28.0}), ("hour(vector(7200))", {"": 2.0}), ("year(vector(0))", {"": 1970.0}), ("month(vector(5000000))", {"": 2.0}), ("day_of_year(vector(86400))", {"": 2.0}), ("minute()", {"": 50.0}),
    ('rate(http_requests{job="api",group="prod",instance="0"}[10m])', {'{group="prod",instance="0",job="api"}': 10 / 300}),
    ('increase(http_requests{job="api",group="prod",instance="0"}[50m])', {'{group="prod",instance="0",job="api"}': 100.0}),
    ('delta(http_requests{job="api",group="prod",instance="0"}[10m])', {'{group="prod",instance="0",job="api"}': 20.0}),
    ('irate(http_requests{job="api",group="prod",instance="0"}[50m])', {'{group="prod",instance="0",job="api"}': 10 / 300}),
    ('idelta(http_requests{job="api",group="prod",instance="0"}[50m])', {'{group="prod",instance="0",job="api"}': 10.0}),
    ('deriv(http_requests{job="api",group="prod",instance="0"}[50m])', {'{group="prod",instance="0",job="api"}': 10 / 300}),
    ('predict_linear(http_requests{job="api",group="prod",instance="0"}[50m], 3600)', {'{group="prod",instance="0",job="api"}': 220.0}),
    ('avg_over_time(http_requests{job="api",group="prod",instance="0"}[10m])', {'{group="prod",instance="0",job="api"}': 95.0}),
    ('quantile_over_time(0.5, http_requests{job="api",group="prod",instance="0"}[15m])', {'{group="prod",instance="0",job="api"}': 90.0}),
    ('last_over_time(http_requests{job="api",group="prod",instance="0"}[10m])', {'http_requests{group="prod",instance="0",job="api"}': 100.0}),
    ("count_over_time(other[10m])", {'{x="NaN"}': 2.0}), ("max_over_time(other[10m])", {'{x="NaN"}': NAN}), ("changes(other[50m])", {'{x="NaN"}': 0.0}), ("present_over_time(other[10m])", {'{x="NaN"}': 1.0}),
    ('ts_of_max_over_time(http_requests{job="api",group="prod",instance="0"}[50m])', {'{group="prod",instance="0",job="api"}': 3000.0}),
    ('ts_of_min_over_time(http_requests{job="api",group="prod",instance="0"}[40m])', {'{group="prod",instance="0",job="api"}': 900.0}),
    ('mad_over_time(http_requests{job="api",group="prod",instance="0"}[15m])', {'{group="prod",instance="0",job="api"}': 10.0}),
    ('stddev_over_time(http_requests{job="api",group="prod",instance="0"}[10m])', {'{group="prod",instance="0",job="api"}': 5.0}),
    ('double_exponential_smoothing(http_requests{job="api",group="prod",instance="0"}[50m], 0.5, 0.5)', {'{group="prod",instance="0",job="api"}': 100.0}),
    ('http_requests{job="api",group="prod",instance="0"} offset 10m', {'http_requests{group="prod",instance="0",job="api"}': 80.0}),
    ('http_requests{job="api",group="prod",instance="0"} @ 600', {'http_requests{group="prod",instance="0",job="api"}': 20.0}),
    ('timestamp(http_requests{job="api",group="prod",instance="0"} @ 650)', {'{group="prod",instance="0",job="api"}': 600.0}),
    ('max_over_time(sum(http_requests)[20m:10m])', {"": 3600.0}), ('sum_over_time(vector(1)[10m:1m])', {"": 10.0}),
    ('sum(info(http_requests{group="prod",instance="0",job="api"}))', {"": 100.0}),
]


@pytest.mark.parametrize("query,expected", CASES, ids=[c[0] for c in CASES])
def test_instant(http, query, expected):
    same(at(http, query, "50m"), expected)


def test_range_and_pins(http):
    q = 'http_requests{job="api",group="prod",instance="0"}'
    assert over(http, q, "0s", "10m", "5m") == {'http_requests{group="prod",instance="0",job="api"}': [(0, 0.0), (300, 10.0), (600, 20.0)]}
    assert over(http, f"{q} @ end()", "0s", "10m", "5m") == {'http_requests{group="prod",instance="0",job="api"}': [(0, 20.0), (300, 20.0), (600, 20.0)]}
    assert over(http, f"rate({q}[10m] @ start()) * 300", "10m", "15m", "5m") == {'{group="prod",instance="0",job="api"}': [(600, 10.0), (900, 10.0)]}
    assert over(http, "time()", "0s", "10s", "5s") == {"": [(0, 0.0), (5, 5.0), (10, 10.0)]}
    assert over(http, f"{q} offset -5m", "0s", "0s", "5m") == {'http_requests{group="prod",instance="0",job="api"}': [(0, 10.0)]}
    assert [s for s, _ in over(http, q, "50m", "60m", "1m")['http_requests{group="prod",instance="0",job="api"}']] == [3000, 3060, 3120, 3180, 3240]


def test_counter_resets_and_staleness(spark):
    e = engine(spark, load(spark, "10s", "c 0 10 20 5 15\ng 1 2 stale 4 _ 6\n"))
    # 10, 20, 5, 15 in the window; 25 in all with the reset, 10 s before its start where the first value allows 12 s
    same(at(e, "increase(c[40s])", "40s"), {"": 25 * 40 / 30})
    same(at(e, "resets(c[50s])", "40s"), {"": 1.0})
    same(at(e, "changes(c[50s])", "40s"), {"": 4.0})
    assert at(e, "g", "25s") == {} and at(e, "g", "35s") == {"g": 4.0}
    same(at(e, "count_over_time(g[1m])", "50s"), {"": 4.0})
    same(at(e, "irate(c[20s])", "30s"), {"": 0.5})


def test_extrapolation(spark):
    e = engine(spark, load(spark, "10s", "r 0+10x1000 100+30x1000\n"))
    same(at(e, "rate(r[1m])", "8000s"), {"": 1.0})
    same(at(e, "rate(r[1m])", "18000s"), {"": 3.0})


def test_grouping_key_is_exact(spark):
    e = engine(spark, load(spark, "5m", 't{a="aa",b="bb"} 1\nt{a="a",b="abb"} 2\n'))
    same(at(e, "sum by (a, b) (t)"), {'{a="aa",b="bb"}': 1.0, '{a="a",b="abb"}': 2.0})


def test_nan_order(spark):
    e = engine(spark, load(spark, "5m", 'm{i="0"} 1\nm{i="1"} NaN\nm{i="2"} 3\n'))
    same(at(e, "topk(3, m)"), {'m{i="0"}': 1.0, 'm{i="1"}': NAN, 'm{i="2"}': 3.0})
    same(at(e, "max(m)"), {"": 3.0})
    same(at(e, "min(m)"), {"": 1.0})
    assert [r["value"] for r in e.query("sort(m)", 0).collect()][:2] == [1.0, 3.0]
    assert [r["value"] for r in e.query("sort_desc(m)", 0).collect()][:2] == [3.0, 1.0]
    assert [r["labels"]["i"] for r in e.query('sort_by_label_desc(m, "i")', 0).collect()] == ["2", "1", "0"]


def test_classic_histogram(spark):
    e = engine(spark, load(spark, "5m", 'h_bucket{le="0.1"} 5\nh_bucket{le="0.2"} 12\nh_bucket{le="+Inf"} 20\nh_bucket{le="1"} 18\n'))
    same(at(e, "histogram_quantile(0.5, h_bucket)"), {"": 0.1 + 0.1 * 5 / 7})
    same(at(e, "histogram_quantile(0.2, h_bucket)"), {"": 0.08})
    same(at(e, "histogram_quantile(0.99, h_bucket)"), {"": 1.0})
    same(at(e, "histogram_quantile(2, h_bucket)"), {"": INF})
    same(at(e, "histogram_fraction(0, 0.2, h_bucket)"), {"": 0.6})


def test_native_histogram(spark):
    from pyspark.sql import functions as F

    df = load(spark, "5m", 'h{i="0"} 1\nh{i="1"} 1\n', hist=True)
    b = "array(named_struct('lower', 1.0D, 'upper', 2.0D, 'count', 2.0D), named_struct('lower', 2.0D, 'upper', 4.0D, 'count', 2.0D))"
    df = df.withColumn("hist", F.expr(f"named_struct('schema', 0, 'count', 4.0D, 'sum', 9.0D, 'zero_threshold', 0.001D, 'zero_count', 0.0D, 'buckets', {b})")).withColumn("value", F.lit(None).cast("double"))
    e = engine(spark, df)
    same(at(e, "histogram_count(sum(h))"), {"": 8.0})
    same(at(e, 'histogram_avg(h{i="0"})'), {'{i="0"}': 2.25})
    same(at(e, "histogram_sum(avg(h))"), {"": 9.0})
    same(at(e, "histogram_quantile(0.5, sum(h))"), {"": 2.0})
    same(at(e, "histogram_fraction(1, 2, sum(h))"), {"": 0.5})
    same(at(e, "histogram_count(sum(h) * 2)"), {"": 16.0})
    assert at(e, "histogram_stddev(sum(h))")[""] > 0
    same(at(e, "count(h)"), {"": 2.0})


def test_matching_errors(spark, http):
    with pytest.raises(Exception, match="many-to-many"):
        at(http, "http_requests + on(job) meta", "50m")
    with pytest.raises(Exception, match="same labelset"):
        at(http, 'label_replace(http_requests, "instance", "x", "job", ".*")', "50m")


@pytest.mark.parametrize("bad", ["sum(", "foo[5m", '{a=""}', "1 < 2", "foo and 1", "foo[5m]", "nope(foo)", "rate(foo)", "topk(foo)", "foo offset", "a + bool b", "sum by (a (b)"])
def test_bad_queries(spark, http, bad):
    with pytest.raises((QueryError, ValueError)):
        http.query_range(bad, 0, 1000, 1000)


def test_parse_precedence():
    assert parse("a + b * c").right.op == "*" and parse("a ^ b ^ c").right.op == "^" and parse("a or b and c").right.op == "and"
    assert parse("sum(rate(x[5m] offset 1h)) by (l)").labels == ("l",)


TWO = 'a_total{x="1"} 1+1x10\nb_total{x="1"} 2+2x10\na_total{x="2"} 5+1x10\n'


@pytest.mark.parametrize("query", [
    'rate({__name__=~"a_total|b_total"}[5m])', 'abs({__name__=~"a_total|b_total"})', '-{__name__=~"a_total|b_total"}', '{__name__=~".*_total"} * 2', '2 < bool {__name__=~".*_total"}',
    'clamp({__name__=~".*_total"}, 1, 2)', 'timestamp({__name__=~".*_total"})', 'max_over_time({__name__=~".*_total"}[5m:1m])', 'day_of_week(a_total or on (__name__) b_total)',
    '{__name__=~".*_total"} * on (x) group_left () sum by (x) (a_total)', 'a_total * on () group_left (x) label_replace(sum(a_total), "x", "1", "", "")',
])
def test_series_that_become_alike_are_an_error(spark, query):
    e = engine(spark, load(spark, "1m", TWO))
    with pytest.raises(Exception, match="same labelset|unique matches"):
        at(e, query, "5m")


def test_names_that_stay_or_are_single_are_no_error(spark):
    e = engine(spark, load(spark, "1m", TWO))
    assert len(at(e, '{__name__=~"a_total|b_total"} > 0', "5m")) == 3
    assert len(at(e, 'last_over_time({__name__=~"a_total|b_total"}[5m])', "5m")) == 3
    assert len(at(e, 'abs(a_total)', "5m")) == 2 and len(at(e, 'abs({__name__=~"a_.*"})', "5m")) == 2
    assert len(at(e, 'sum by (x) ({__name__=~"a_total|b_total"}) * 2', "5m")) == 2


def test_parameters_that_depend_on_data(spark):
    e = engine(spark, load(spark, "1m", 'm{i="1"} 1x20\nm{i="2"} 2x20\nm{i="3"} 3x20\nm{i="4"} NaNx20\nk 1 1 1 1 1 2x20\nq 0x4 0.5x20\n'))
    steps = ("0s", "10m", "5m")
    assert {k: [t for t, _ in v] for k, v in over(e, "topk(scalar(k), m)", *steps).items()} == {'m{i="3"}': [0, 300, 600], 'm{i="2"}': [300, 600]}
    assert {k: [t for t, _ in v] for k, v in over(e, "bottomk(scalar(k), m)", *steps).items()} == {'m{i="1"}': [0, 300, 600], 'm{i="2"}': [300, 600]}
    assert {t: n for t, n in over(e, "count(limitk(scalar(k), m))", *steps)[""]} == {0: 1.0, 300: 2.0, 600: 2.0}
    assert over(e, 'quantile(scalar(q), m{i!="4"})', *steps)[""] == [(0, 1.0), (300, 2.0), (600, 2.0)]
    assert over(e, "quantile_over_time(scalar(q), m{i=\"1\"}[5m])", *steps) == {'{i="1"}': [(0, 1.0), (300, 1.0), (600, 1.0)]}
    assert over(e, "predict_linear(m{i=\"2\"}[5m], scalar(k))", *steps) == {'{i="2"}': [(300, 2.0), (600, 2.0)]}
    assert over(e, "limit_ratio(scalar(q) * 2, m)", *steps).keys() == {f'm{{i="{i}"}}' for i in range(1, 5)}


def test_quantile_of_series(spark):
    e = engine(spark, load(spark, "1m", "\n".join(f'm{{i="{i}"}} {v}' for i, v in enumerate((4, 1, "NaN", 9, 2)))))
    for q, want in ((0.5, 2.0), (0.75, 4.0), (1, 9.0), (0.6, 2.8), (-1, -float("inf")), (2, float("inf"))):
        assert at(e, f"quantile({q}, m)")[""] == pytest.approx(want)
    assert at(e, "quantile(0.1, m)")[""] != at(e, "quantile(0.1, m)")[""]  # NaN sorts first


def hist(count, total, buckets, schema=0, zero=(0.001, 0.0)):
    """A native histogram from (lower, upper, count) triples, as SQL."""
    inner = ", ".join(f"named_struct('lower', {a}D, 'upper', {b}D, 'count', {n}D)" for a, b, n in buckets)
    typed = f"array({inner})" if inner else "cast(array() as array<struct<lower:double,upper:double,count:double>>)"
    return f"named_struct('schema', {schema}, 'count', {count}D, 'sum', {total}D, 'zero_threshold', {zero[0]}D, 'zero_count', {zero[1]}D, 'buckets', {typed})"


def native(spark, series):
    """{labels text: [(minute, SQL of a histogram or a float)]} as samples."""
    from functools import reduce

    from pyspark.sql import functions as F

    from seriesloom.sources.model import HIST

    parts = []
    for name, points in series.items():
        for minute, h in points:
            df = load(spark, "1m", f"{name} {'_ ' * minute}{h if isinstance(h, (int, float)) else 1}", hist=True)
            if isinstance(h, str):
                df = df.withColumn("hist", F.expr(h).cast(HIST)).withColumn("value", F.lit(None).cast("double"))
            parts.append(df)
    return reduce(lambda a, b: a.unionByName(b), parts)


def test_ranges_over_native_histograms(spark):
    grow = [(0, hist(2, 2, [(1, 2, 2)])), (1, hist(5, 8, [(1, 2, 3), (2, 4, 2)])), (2, hist(1, 1, [(1, 2, 1)])), (3, hist(4, 9, [(1, 2, 1), (2, 4, 3)]))]
    e = engine(spark, native(spark, {'h{i="0"}': grow}))
    # from 2, reset after 5, at the end 4: 5 - 2 + 4 = 7 over 180 s, extrapolated to the left edge and the window of 240 s
    factor = (180 + 60) / 180
    same(at(e, "histogram_count(increase(h[4m]))", "3m"), {'{i="0"}': 7 * factor})
    same(at(e, "histogram_count(rate(h[4m]))", "3m"), {'{i="0"}': 7 * factor / 240})
    same(at(e, "histogram_sum(delta(h[4m]))", "3m"), {'{i="0"}': 7 * factor})
    same(at(e, "histogram_count(irate(h[4m]))", "3m"), {'{i="0"}': 3 / 60})
    same(at(e, "histogram_count(irate(h[4m]))", "2m"), {'{i="0"}': 1 / 60})
    same(at(e, "histogram_count(idelta(h[4m]))", "2m"), {'{i="0"}': -4.0})
    same(at(e, "histogram_count(sum_over_time(h[4m]))", "3m"), {'{i="0"}': 12.0})
    same(at(e, "histogram_sum(avg_over_time(h[4m]))", "3m"), {'{i="0"}': 5.0})
    same(at(e, "count_over_time(h[4m])", "3m"), {'{i="0"}': 4.0})
    same(at(e, "histogram_count(last_over_time(h[4m]))", "3m"), {'{i="0"}': 4.0})
    same(at(e, "histogram_quantile(0.5, increase(h[4m]))", "3m"), {'{i="0"}': 2 * 2 ** ((3.5 - 2) / 5)})
    assert at(e, "max_over_time(h[4m])", "3m") == {}
    assert len(over(e, "histogram_count(rate(h[2m]))", "1m", "3m", "1m")['{i="0"}']) == 3


def test_windows_of_floats_and_histograms(spark):
    e = engine(spark, native(spark, {'h{i="0"}': [(0, 1), (1, hist(3, 3, [(1, 2, 3)])), (2, hist(6, 6, [(1, 2, 6)]))], 'h{i="1"}': [(0, 1), (2, 5)]}))
    assert at(e, "sum_over_time(h[5m])", "2m") == {'{i="1"}': 6.0}
    assert at(e, "count_over_time(h[5m])", "2m") == {'{i="0"}': 3.0, '{i="1"}': 2.0}
    assert at(e, "first_over_time(h[5m])", "2m") == {'h{i="0"}': 1.0, 'h{i="1"}': 1.0}
    same(at(e, "histogram_count(last_over_time(h[5m]))", "2m"), {'{i="0"}': 6.0})


def test_sums_of_unlike_histograms(spark):
    r = 2**0.5
    fine = hist(6, 9, [(1, r, 1), (r, 2, 2), (2, 2 * r, 3)], schema=1)
    coarse = hist(5, 8, [(1, 2, 1), (2, 4, 4)], schema=0)
    e = engine(spark, native(spark, {'h{i="0"}': [(0, fine)], 'h{i="1"}': [(0, coarse)], 'w{i="0"}': [(0, hist(4, 4, [(0.5, 1, 2), (1, 2, 2)]))], 'w{i="1"}': [(0, hist(5, 5, [(2, 4, 2)], zero=(0.75, 3.0)))]}))
    rows = e.query("sum(h)", 0).collect()
    assert [(round(b["lower"], 9), round(b["upper"], 9), b["count"]) for b in rows[0]["hist"]["buckets"]] == [(1.0, 2.0, 4.0), (2.0, 4.0, 7.0)]
    assert (rows[0]["hist"]["schema"], rows[0]["hist"]["count"]) == (0, 11.0)
    h = e.query("sum(w)", 0).collect()[0]["hist"]  # the wider zero bucket reaches into (0.5, 1] and takes it in
    assert (h["zero_threshold"], h["zero_count"], [tuple(b) for b in h["buckets"]]) == (1.0, 5.0, [(1.0, 2.0, 2.0), (2.0, 4.0, 2.0)])
    same(at(e, "histogram_fraction(1, 1.4142135623730951, h{i=\"1\"})"), {'{i="1"}': 0.1})


def test_quotients_at_a_tie_round_as_in_sql(spark, tmp_path):
    import datetime as dt

    import duckdb

    from seriesloom.queries import oracle_sql, queries

    pairs = [(0.41, 6.4), (3.23, 6.4), (32.29, 6.4), (0.43, 6.4), (0.0, 6.4), (6.4, 0.0), (0.0, 0.0), (1.0, 3.0)]
    rows = [(dt.datetime(2024, 1, 5 + late, 12), user, "view", (old, new)[late]) for user, (new, old) in enumerate(pairs) for late in (0, 1)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW events AS SELECT ts::TIMESTAMP AS ts, * EXCLUDE (ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {tuple(r[:-1]): r[-1] for r in db.execute(oracle_sql()["join_one_to_one"]).fetchall()}
    got = {tuple(r)[:-1]: r[-1] for r in queries()["join_one_to_one"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(want) >= len(pairs)
    assert {math.isnan(x) or x for x in want.values()} >= {0.064062, INF, True}
    assert [k for k in want if repr(got[k]) != repr(want[k])] == []
