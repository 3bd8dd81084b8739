"""One query per operator over the driver's tables, each with equivalent SQL for DuckDB.

events gives the series events_value{event_type, user_id}; ranges and steps are of days because its samples are days apart.
Labels come out as flat columns and values rounded, so both sides compare by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine, Options
from .functions import num
from .plans.syntax import Matcher
from .sources import catalog
from .sources.groups import SourceGroup, TimeRange
from .sources.model import epoch_ms, events_samples, events_source, label, labels_of

DAY = 86_400_000
START, END = 1_704_153_600_000, 1_706_659_200_000  # 2024-01-02 and 2024-01-31, UTC: the events' days end there
LOOKBACK = 2 * DAY


def _engine(spark, sf_dir: str, groups=None, **options) -> Engine:
    own = groups or [SourceGroup([events_source(spark, sf_dir)])]
    return Engine(spark, own, Options(**{"lookback_ms": LOOKBACK, "experimental": True, "evaluation_interval_ms": DAY} | options))


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Label columns, step and rounded value."""
    labels = labels_of(F.col("lkey"))
    return df.select(*[label(labels, n).alias(n if n != "__name__" else "metric") for n in names], F.col("step").cast("bigint").alias("step"), num.rounded(F.col("value"), 6).alias("value"))


def promql(query: str, *names: str, start: int = START, end: int = END, step: int = DAY):
    def run(spark, sf_dir: str) -> DataFrame:
        return flat(_engine(spark, sf_dir).query_range(query, start, end, step), *names)

    return run


# ------------------------------------------------------------------------------------------------------- SQL fragments
GRID = f"g AS (SELECT unnest(range({START}, {END} + 1, {DAY}))::BIGINT step)"
EV = "e AS (SELECT event_type, user_id::VARCHAR user_id, (epoch_us(ts) // 1000)::BIGINT ts, value v FROM events)"
#: The newest sample of each series in the lookback at each step.
INST = f"{GRID}, {EV}, i AS (SELECT event_type, user_id, step, arg_max(v, ts) v, max(ts) ts FROM g JOIN e ON ts > step - {LOOKBACK} AND ts <= step GROUP BY ALL)"


def window(days: int, offset: int = 0) -> str:
    return f"{GRID}, {EV}, w AS (SELECT *, step - ts rel FROM g JOIN (SELECT *, lag(v) OVER s pv, lag(ts) OVER s pts FROM e WINDOW s AS (PARTITION BY event_type, user_id ORDER BY ts)) ON ts > step - {offset} - {days * DAY} AND ts <= step - {offset})"


def over(expr: str, days: int = 7, having: str = "true") -> str:
    return f"WITH {window(days)} SELECT event_type, user_id, step, round(({expr})::DOUBLE, 6) AS value FROM w GROUP BY event_type, user_id, step HAVING {having}"


def inst(select: str) -> str:
    return f"WITH {INST} {select}"


_EX = f"""WITH {window(7)}, a AS (SELECT event_type, user_id, step, count(*) n, arg_min(v, ts) f, arg_max(v, ts) l, min(ts) ft, max(ts) lt,
  coalesce(sum(CASE WHEN v < pv AND pts > step - {7 * DAY} THEN pv END), 0) r FROM w GROUP BY ALL HAVING count(*) >= 2 AND max(ts) > min(ts)),
b AS (SELECT *, (lt - ft) / 1000.0::DOUBLE s, (lt - ft) / 1000.0::DOUBLE / (n - 1) m, (ft - step + {7 * DAY}) / 1000.0::DOUBLE h, (step - lt) / 1000.0::DOUBLE t, l - f + CASE WHEN {{counter}} THEN r ELSE 0 END res FROM a),
c AS (SELECT *, CASE WHEN h >= m * 1.1 THEN m / 2 ELSE h END h1, CASE WHEN t >= m * 1.1 THEN m / 2 ELSE t END t1 FROM b),
d AS (SELECT *, CASE WHEN {{counter}} AND res > 0 AND f >= 0 THEN least(h1, s * f / res) ELSE h1 END h2 FROM c)
SELECT event_type, user_id, step, round(res * ((s + h2 + t1) / s) / {{div}}, 6) AS value FROM d"""


def extrapolated(counter: bool, div: str = "1.0") -> str:
    return _EX.format(counter=str(counter).lower(), div=div)


SEL = "events_value"
UT = ("event_type", "user_id")
_LAST_TWO = f"arg_max(CASE WHEN pts > step - {7 * DAY} THEN %s END, ts)"
_RATE2 = "CASE WHEN v < pv THEN v ELSE v - pv END / ((ts - pts) / 1000.0)"


def _pairs(fn: str, sql: str, arg: str = SEL) -> tuple:
    return promql(f"{fn}({arg})", *UT), inst(f"SELECT event_type, user_id, step, round(({sql})::DOUBLE, 6) AS value FROM i")


def info_join(spark, sf_dir: str) -> DataFrame:
    """A label that only the info series has, by instance and job."""
    from .sources.model import NAME, TableSource

    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = {"job": F.col("event_type"), "instance": F.col("user_id")}
    v = TableSource(ev, {NAME: F.lit("v"), **own}, "ts", F.col("value"))
    info = TableSource(ev, {NAME: F.lit("target_info"), **own, "tier": F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))}, "ts", F.lit(1.0))
    return flat(_engine(spark, sf_dir, [SourceGroup([v]), SourceGroup([info])], mode="union").query_range("sum by (tier) (info(v))", START, END, DAY), "tier")


TABLE: dict[str, tuple] = {
    # selectors
    "promql_sum_count_over_time": (
        promql("sum by (event_type) (count_over_time(events_value[1d]))", "event_type"),
        f"WITH {GRID}, {EV} SELECT event_type, step, count(*)::DOUBLE AS value FROM g JOIN e ON ts > step - {DAY} AND ts <= step GROUP BY ALL",
    ),
    "sel_instant": (promql(SEL, "__name__", *UT), inst("SELECT 'events_value' AS metric, event_type, user_id, step, round(v, 6) AS value FROM i")),
    "sel_regex": (promql('events_value{event_type=~"p.*|click",user_id!="3",user_id!~"1.*"}', *UT), inst("SELECT event_type, user_id, step, round(v, 6) AS value FROM i WHERE (event_type LIKE 'p%' OR event_type = 'click') AND user_id <> '3' AND user_id NOT LIKE '1%'")),
    "offset_positive": (promql("events_value offset 3d", *UT), f"WITH {GRID}, {EV} SELECT event_type, user_id, step, round(arg_max(v, ts), 6) AS value FROM g JOIN e ON ts > step - {3 * DAY} - {LOOKBACK} AND ts <= step - {3 * DAY} GROUP BY ALL"),
    "offset_negative": (promql("events_value offset -3d", *UT), f"WITH {GRID}, {EV} SELECT event_type, user_id, step, round(arg_max(v, ts), 6) AS value FROM g JOIN e ON ts > step + {3 * DAY} - {LOOKBACK} AND ts <= step + {3 * DAY} GROUP BY ALL"),
    "at_modifier": (promql("sum by (event_type) (events_value @ 1705000000)", "event_type"), f"WITH {GRID}, {EV}, p AS (SELECT event_type, user_id, arg_max(v, ts) v FROM e WHERE ts > 1705000000000 - {LOOKBACK} AND ts <= 1705000000000 GROUP BY ALL) SELECT event_type, step, round(sum(v), 6) AS value FROM p, g GROUP BY ALL"),
    "at_end": (promql("count(events_value @ end())"), f"WITH {GRID}, {EV} SELECT step, (SELECT count(DISTINCT (event_type, user_id)) FROM e WHERE ts > {END} - {LOOKBACK} AND ts <= {END})::DOUBLE AS value FROM g"),
    "subquery_max": (promql("max_over_time(sum by (event_type) (events_value)[5d:1d])", "event_type"), f"""WITH {EV}, h AS (SELECT unnest(range({START} - {5 * DAY}, {END} + 1, {DAY}))::BIGINT t), x AS (SELECT event_type, user_id, t, arg_max(v, ts) v FROM h JOIN e ON ts > t - {LOOKBACK} AND ts <= t GROUP BY ALL),
      y AS (SELECT event_type, t, sum(v) v FROM x GROUP BY ALL), {GRID} SELECT event_type, step, round(max(v), 6) AS value FROM g JOIN y ON t > step - {5 * DAY} AND t <= step GROUP BY ALL"""),
    "matrix_raw": (lambda spark, d: flat(_engine(spark, d).query("events_value[2d]", END), *UT), f"WITH {EV} SELECT event_type, user_id, ts AS step, round(v, 6) AS value FROM e WHERE ts > {END} - {2 * DAY} AND ts <= {END}"),
    # range functions
    "range_rate": (promql("rate(events_value[7d])", *UT), extrapolated(True, str(7 * 86400.0) + "::DOUBLE")),
    "range_increase": (promql("increase(events_value[7d])", *UT), extrapolated(True)),
    "range_delta": (promql("delta(events_value[7d])", *UT), extrapolated(False)),
    "range_irate": (promql("irate(events_value[7d]) * 1000000", *UT), over("1000000 * " + _LAST_TWO % f"({_RATE2})", having=f"max(CASE WHEN pts > step - {7 * DAY} THEN 1 ELSE 0 END) = 1")),
    "range_idelta": (promql("idelta(events_value[7d])", *UT), over(_LAST_TWO % "(v - pv)", having=f"max(CASE WHEN pts > step - {7 * DAY} THEN 1 ELSE 0 END) = 1")),
    "range_deriv": (promql("round(deriv(events_value[7d]), 0.000001)", *UT), over("floor(1 / 0.000001 * regr_slope(v, (ts - step) / 1000.0) + 0.5) / 1000000", having="count(*) >= 2")),
    "range_predict_linear": (promql("round(predict_linear(events_value[7d], 3600), 0.01)", *UT), over("floor(100 * (regr_intercept(v, (ts - step) / 1000.0) + 3600 * regr_slope(v, (ts - step) / 1000.0)) + 0.5) / 100", having="count(*) >= 2")),
    "range_avg": (promql("avg_over_time(events_value[7d])", *UT), over("avg(v)")),
    "range_sum": (promql("sum_over_time(events_value[7d])", *UT), over("sum(v)")),
    "range_min": (promql("min_over_time(events_value[7d])", *UT), over("min(v)")),
    "range_max": (promql("max_over_time(events_value[7d])", *UT), over("max(v)")),
    "range_count": (promql("count_over_time(events_value[7d])", *UT), over("count(*)")),
    "range_last": (promql("last_over_time(events_value[7d])", "__name__", *UT), over("arg_max(v, ts)").replace("SELECT event_type, user_id, step, round", "SELECT 'events_value' AS metric, event_type, user_id, step, round")),
    "range_first": (promql("first_over_time(events_value[7d])", *UT), over("arg_min(v, ts)")),
    "range_present": (promql("present_over_time(events_value[7d])", *UT), over("1.0")),
    "range_quantile": (promql("quantile_over_time(0.9, events_value[7d])", *UT), over("quantile_cont(v, 0.9)")),
    "range_stddev": (promql("stddev_over_time(events_value[7d])", *UT), over("stddev_pop(v)")),
    "range_stdvar": (promql("stdvar_over_time(events_value[7d])", *UT), over("var_pop(v)")),
    "range_mad": (promql("mad_over_time(events_value[7d])", *UT), over("mad(v)")),
    "range_changes": (promql("changes(events_value[7d])", *UT), over(f"sum(CASE WHEN pts > step - {7 * DAY} AND v <> pv THEN 1 ELSE 0 END)")),
    "range_resets": (promql("resets(events_value[7d])", *UT), over(f"sum(CASE WHEN pts > step - {7 * DAY} AND v < pv THEN 1 ELSE 0 END)")),
    "range_ts_of_last": (promql("ts_of_last_over_time(events_value[7d])", *UT), over("max(ts) / 1000.0")),
    "range_ts_of_max": (promql("ts_of_max_over_time(events_value[7d])", *UT), over("max((v, ts))[2] / 1000.0")),
    "range_ts_of_min": (promql("ts_of_min_over_time(events_value[7d])", *UT), over("-min((v, -ts))[2] / 1000.0")),
    "range_smoothing": (promql("double_exponential_smoothing(events_value[14d], 0.5, 0.3)", *UT), f"""WITH RECURSIVE {window(14)}, o AS (SELECT event_type, user_id, step, v, row_number() OVER (PARTITION BY event_type, user_id, step ORDER BY ts) n, count(*) OVER (PARTITION BY event_type, user_id, step) m FROM w),
      f AS (SELECT a.event_type, a.user_id, a.step, a.m, 1::BIGINT n, a.v s, b.v - a.v b FROM o a JOIN o b USING (event_type, user_id, step) WHERE a.n = 1 AND b.n = 2
        UNION ALL SELECT f.event_type, f.user_id, f.step, f.m, o.n, 0.5 * o.v + 0.5 * (f.s + f.b), 0.3 * (0.5 * o.v + 0.5 * (f.s + f.b) - f.s) + 0.7 * f.b FROM f JOIN o ON o.event_type = f.event_type AND o.user_id = f.user_id AND o.step = f.step AND o.n = f.n + 1)
      SELECT event_type, user_id, step, round(s, 6) AS value FROM f WHERE n = m"""),
    "absent_over_time": (promql('absent_over_time(events_value{event_type="error",user_id="1"}[1d])', *UT), f"WITH {GRID}, {EV} SELECT 'error' AS event_type, '1' AS user_id, step, 1.0::DOUBLE AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE event_type = 'error' AND user_id = '1' AND ts > step - {DAY} AND ts <= step)"),
    # aggregations
    **{f"agg_{op}_by": (promql(f"{op} by (event_type) (events_value)", "event_type"), inst(f"SELECT event_type, step, round(({sql})::DOUBLE, 6) AS value FROM i GROUP BY ALL")) for op, sql in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items()},
    "agg_group": (promql("group by (event_type) (events_value)", "event_type"), inst("SELECT DISTINCT event_type, step, 1.0::DOUBLE AS value FROM i")),
    "agg_without": (promql("sum without (user_id) (events_value)", "__name__", "event_type"), inst("SELECT '' AS metric, event_type, step, round(sum(v), 6) AS value FROM i GROUP BY ALL")),
    "agg_all": (promql("sum(events_value)"), inst("SELECT step, round(sum(v), 6) AS value FROM i GROUP BY ALL")),
    "agg_by_name": (promql("avg by (__name__) (events_value)", "__name__"), inst("SELECT 'events_value' AS metric, step, round(avg(v), 6) AS value FROM i GROUP BY ALL")),
    "agg_topk": (promql("topk by (event_type) (3, events_value)", *UT), inst("SELECT event_type, user_id, step, round(v, 6) AS value FROM i QUALIFY row_number() OVER (PARTITION BY event_type, step ORDER BY v DESC, '[{\"key\":\"__name__\",\"value\":\"events_value\"},{\"key\":\"event_type\",\"value\":\"' || event_type || '\"},{\"key\":\"user_id\",\"value\":\"' || user_id || '\"}]') <= 3")),
    "agg_bottomk": (promql("bottomk by (event_type) (3, events_value)", *UT), inst("SELECT event_type, user_id, step, round(v, 6) AS value FROM i QUALIFY row_number() OVER (PARTITION BY event_type, step ORDER BY v, '\"' || event_type || '\"},{\"key\":\"user_id\",\"value\":\"' || user_id || '\"}]') <= 3")),
    "agg_quantile": (promql("quantile by (event_type) (0.9, events_value)", "event_type"), inst("SELECT event_type, step, round(quantile_cont(v, 0.9), 6) AS value FROM i GROUP BY ALL")),
    "agg_count_values": (promql('count_values by (event_type) ("v", floor(events_value / 10))', "event_type", "v"), inst("SELECT event_type, floor(v / 10)::BIGINT::VARCHAR AS v, step, count(*)::DOUBLE AS value FROM i GROUP BY event_type, floor(v / 10)::BIGINT::VARCHAR, step")),
    "agg_count_distinct": (promql("count(count by (user_id) (events_value))"), inst("SELECT step, count(DISTINCT user_id)::DOUBLE AS value FROM i GROUP BY ALL")),
    "agg_limitk": (promql("count by (event_type) (limitk by (event_type) (4, events_value))", "event_type"), inst("SELECT event_type, step, least(count(*), 4)::DOUBLE AS value FROM i GROUP BY ALL")),
    "agg_limit_ratio": (promql("count(limit_ratio(0.4, events_value)) + count(limit_ratio(-0.6, events_value))"), inst("SELECT step, count(*)::DOUBLE AS value FROM i GROUP BY ALL")),  # a share and its complement
    "agg_limit_ratio_share": (promql("abs(count(limit_ratio(0.4, events_value)) / count(events_value) - 0.4) < bool 0.15"), inst("SELECT DISTINCT step, 1.0::DOUBLE AS value FROM i")),
    "agg_bottomk_scalar": (promql('bottomk by (event_type) (scalar(count(events_value)) % 3 + 1, events_value)', *UT), inst("SELECT event_type, user_id, step, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, step ORDER BY v, '\"' || event_type || '\"},{\"key\":\"user_id\",\"value\":\"' || user_id || '\"') r, count(*) OVER (PARTITION BY step) n FROM i) WHERE r <= n % 3 + 1")),
    "agg_quantile_scalar": (promql('quantile by (event_type) (scalar(count(events_value{event_type="view"}) / count(events_value)), events_value)', "event_type"), inst("""SELECT event_type, step, round(l[floor(r)::INT + 1] * (1 - (r - floor(r))) + l[least(len(l), floor(r)::INT + 2)] * (r - floor(r)), 6) AS value FROM (SELECT *, q * (len(l) - 1) r
      FROM (SELECT event_type, step, list_sort(list(v)) l FROM i GROUP BY ALL) JOIN (SELECT step, count(*) FILTER (event_type = 'view') / count(*)::DOUBLE q FROM i GROUP BY ALL) USING (step))""")),
    # operators
    "op_arithmetic": (promql("(events_value + 1) * 2 - 3 / 4", *UT), inst("SELECT event_type, user_id, step, round((v + 1) * 2 - 0.75, 6) AS value FROM i")),
    "op_modulo_power": (promql("events_value % 7 + events_value ^ 2", *UT), inst("SELECT event_type, user_id, step, round(v % 7 + v ^ 2, 6) AS value FROM i")),
    "op_divide_by_zero": (promql("(events_value - events_value) / 0 == bool 0", *UT), inst("SELECT event_type, user_id, step, 0.0::DOUBLE AS value FROM i")),
    "op_comparison": (promql("events_value > 50", "__name__", *UT), inst("SELECT 'events_value' AS metric, event_type, user_id, step, round(v, 6) AS value FROM i WHERE v > 50")),
    "op_bool": (promql("events_value > bool 50", *UT), inst("SELECT event_type, user_id, step, (v > 50)::INT::DOUBLE AS value FROM i")),
    "op_unary": (promql("-events_value", *UT), inst("SELECT event_type, user_id, step, round(-v, 6) AS value FROM i")),
    "op_atan2": (promql("events_value atan2 10", *UT), inst("SELECT event_type, user_id, step, round(atan2(v, 10), 6) AS value FROM i")),
    "op_scalar_scalar": (promql("time() / 86400 > bool 19730"), f"WITH {GRID} SELECT step, (step / 86400000.0 > 19730)::INT::DOUBLE AS value FROM g"),
    # joins
    "join_one_to_one": (promql("events_value / (events_value offset 1d)", *UT), f"WITH {INST}, o AS (SELECT event_type, user_id, step, arg_max(v, ts) ov FROM g JOIN e ON ts > step - {DAY} - {LOOKBACK} AND ts <= step - {DAY} GROUP BY ALL) SELECT event_type, user_id, step, round(CASE WHEN ov = 0 THEN CASE WHEN v = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE * sign(v) END ELSE v / ov END, 6) AS value FROM i JOIN o USING (event_type, user_id, step)"),
    "join_on": (promql('events_value{event_type="view"} + on(user_id) events_value{event_type="click"}', "user_id"), inst("SELECT a.user_id, step, round(a.v + b.v, 6) AS value FROM i a JOIN i b USING (user_id, step) WHERE a.event_type = 'view' AND b.event_type = 'click'")),
    "join_ignoring": (promql('events_value{event_type="view"} - ignoring(event_type) events_value{event_type="click"}', "user_id"), inst("SELECT a.user_id, step, round(a.v - b.v, 6) AS value FROM i a JOIN i b USING (user_id, step) WHERE a.event_type = 'view' AND b.event_type = 'click'")),
    "join_group_left": (promql("events_value / on(event_type) group_left() sum by (event_type) (events_value)", *UT), inst("SELECT i.event_type, user_id, i.step, round(v / s, 6) AS value FROM i JOIN (SELECT event_type, step, sum(v) s FROM i GROUP BY ALL) t ON t.event_type = i.event_type AND t.step = i.step")),
    "join_group_left_label": (promql('events_value{event_type="view"} * on(user_id) group_left(kind) label_replace(events_value{event_type="click"}, "kind", "k$1", "user_id", "(.).*")', *UT, "kind"), inst("SELECT 'view' AS event_type, a.user_id, 'k' || a.user_id[1:1] AS kind, a.step, round(a.v * b.v, 6) AS value FROM i a JOIN i b USING (user_id, step) WHERE a.event_type = 'view' AND b.event_type = 'click'")),
    "join_group_right": (promql("count by (event_type) (events_value) * on(event_type) group_right() events_value", *UT), inst("SELECT i.event_type, user_id, i.step, round(v * n, 6) AS value FROM i JOIN (SELECT event_type, step, count(*) n FROM i GROUP BY ALL) t ON t.event_type = i.event_type AND t.step = i.step")),
    "set_and": (promql('events_value and on(user_id) events_value{event_type="error"}', *UT), inst("SELECT event_type, user_id, step, round(v, 6) AS value FROM i WHERE EXISTS (SELECT 1 FROM i b WHERE b.event_type = 'error' AND b.user_id = i.user_id AND b.step = i.step)")),
    "set_unless": (promql('events_value unless on(user_id) events_value{event_type="error"}', *UT), inst("SELECT event_type, user_id, step, round(v, 6) AS value FROM i WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.event_type = 'error' AND b.user_id = i.user_id AND b.step = i.step)")),
    "set_or": (promql('events_value{event_type="view"} or on(user_id) events_value{event_type="click"}', *UT), inst("SELECT event_type, user_id, step, round(v, 6) AS value FROM i WHERE event_type = 'view' OR event_type = 'click' AND NOT EXISTS (SELECT 1 FROM i b WHERE b.event_type = 'view' AND b.user_id = i.user_id AND b.step = i.step)")),
    "info_join": (info_join, inst("SELECT 't' || (user_id::BIGINT % 3) AS tier, step, round(sum(v), 6) AS value FROM i GROUP BY ALL")),
    # instant functions
    **{f"fn_{f}": _pairs(f, sql) for f, sql in {"abs": "abs(v)", "ceil": "ceil(v)", "floor": "floor(v)", "sqrt": "CASE WHEN v < 0 THEN 'nan'::DOUBLE ELSE sqrt(v) END", "ln": "CASE WHEN v > 0 THEN ln(v) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "log2": "CASE WHEN v > 0 THEN log2(v) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "log10": "CASE WHEN v > 0 THEN log10(v) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "sgn": "sign(v)", "deg": "degrees(v)", "rad": "radians(v)", "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "atan": "atan(v)", "asinh": "asinh(v)"}.items()},
    **{f"fn_{f}": _pairs(f, sql, "events_value / 1000") for f, sql in {"exp": "exp(v / 1000)", "sinh": "sinh(v / 1000)", "cosh": "cosh(v / 1000)", "tanh": "tanh(v / 1000)", "atanh": "CASE WHEN abs(v / 1000) < 1 THEN atanh(v / 1000) WHEN v = 1000 THEN 'inf'::DOUBLE WHEN v = -1000 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "acos": "CASE WHEN abs(v / 1000) <= 1 THEN acos(v / 1000) ELSE 'nan'::DOUBLE END", "asin": "CASE WHEN abs(v / 1000) <= 1 THEN asin(v / 1000) ELSE 'nan'::DOUBLE END"}.items()},
    "fn_acosh": _pairs("acosh", "CASE WHEN v + 1 >= 1 THEN acosh(v + 1) ELSE 'nan'::DOUBLE END", "events_value + 1"),
    "fn_round": (promql("round(events_value, 5)", *UT), inst("SELECT event_type, user_id, step, round(floor(v * 0.2 + 0.5) / 0.2, 6) AS value FROM i")),
    "fn_clamp": (promql("clamp(events_value, 20, 60)", *UT), inst("SELECT event_type, user_id, step, round(greatest(least(v, 60), 20), 6) AS value FROM i")),
    "fn_clamp_min": (promql("clamp_min(events_value, 20)", *UT), inst("SELECT event_type, user_id, step, round(greatest(v, 20), 6) AS value FROM i")),
    "fn_clamp_max": (promql("clamp_max(events_value, 60)", *UT), inst("SELECT event_type, user_id, step, round(least(v, 60), 6) AS value FROM i")),
    "fn_timestamp": (promql("timestamp(events_value)", *UT), inst("SELECT event_type, user_id, step, round(ts / 1000.0, 6) AS value FROM i")),
    "fn_time": (promql("time()"), f"WITH {GRID} SELECT step, (step / 1000)::DOUBLE AS value FROM g"),
    "fn_pi": (promql("pi()"), f"WITH {GRID} SELECT step, round(pi(), 6) AS value FROM g"),
    **{f"fn_{f}": (promql(f"{f}(timestamp(events_value))", *UT), inst(f"SELECT event_type, user_id, step, ({sql})::DOUBLE AS value FROM (SELECT *, make_timestamp((ts // 1000) * 1000000) t FROM i)")) for f, sql in {"day_of_month": "day(t)", "day_of_week": "dayofweek(t)", "day_of_year": "dayofyear(t)", "days_in_month": "day(last_day(t))", "hour": "hour(t)", "minute": "minute(t)", "month": "month(t)", "year": "year(t)"}.items()},
    "fn_label_replace": (promql('label_replace(events_value, "kind", "$1-$2", "event_type", "(.)(.*)")', *UT, "kind"), inst("SELECT event_type, user_id, event_type[1:1] || '-' || event_type[2:] AS kind, step, round(v, 6) AS value FROM i")),
    "fn_label_join": (promql('label_join(events_value, "both", "/", "event_type", "user_id")', *UT, "both"), inst("SELECT event_type, user_id, event_type || '/' || user_id AS both, step, round(v, 6) AS value FROM i")),
    "fn_absent": (promql('absent(events_value{event_type="error",user_id="1"})', *UT), inst("SELECT 'error' AS event_type, '1' AS user_id, step, 1.0::DOUBLE AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM i WHERE event_type = 'error' AND user_id = '1' AND i.step = g.step)")),
    "fn_scalar": (promql('scalar(events_value{event_type="view",user_id="1"}) + 1'), inst("SELECT g.step, round(CASE WHEN count(v) = 1 THEN max(v) + 1 ELSE 'nan'::DOUBLE END, 6) AS value FROM g LEFT JOIN (SELECT * FROM i WHERE event_type = 'view' AND user_id = '1') x ON x.step = g.step GROUP BY g.step")),
    "fn_vector": (promql("vector(time() / 100)"), f"WITH {GRID} SELECT step, round(step / 100000.0, 6) AS value FROM g"),
    "fn_sort": (lambda spark, d: flat(_engine(spark, d).query("sort(events_value)", END), *UT), inst(f"SELECT event_type, user_id, step, round(v, 6) AS value FROM i WHERE step = {END} ORDER BY v")),
    "fn_sort_desc": (lambda spark, d: flat(_engine(spark, d).query("sort_desc(events_value)", END), *UT), inst(f"SELECT event_type, user_id, step, round(v, 6) AS value FROM i WHERE step = {END} ORDER BY v DESC")),
    "fn_sort_by_label": (lambda spark, d: flat(_engine(spark, d).query('sort_by_label(events_value, "user_id")', END), *UT), inst(f"SELECT event_type, user_id, step, round(v, 6) AS value FROM i WHERE step = {END}")),
    "fn_sort_by_label_desc": (lambda spark, d: flat(_engine(spark, d).query('sort_by_label_desc(events_value, "user_id")', END), *UT), inst(f"SELECT event_type, user_id, step, round(v, 6) AS value FROM i WHERE step = {END}")),
}


# --------------------------------------------------------------------------------------- federation, metadata, histograms
def split(spark, sf_dir: str, labels: bool = True) -> list[SourceGroup]:
    """Two groups cut from events: a lacks every fifth event, b has every third with its value raised by one."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    from .sources.model import NAME, TableSource

    def part(rows, value):
        return TableSource(rows, {NAME: F.lit("events_value"), "event_type": F.col("event_type"), "user_id": F.col("user_id")}, "ts", value)

    a = part(ev.where(F.col("event_id") % 5 != 0), F.col("value"))
    b = part(ev.where(F.col("event_id") % 3 == 0), F.col("value") + 1)
    return [SourceGroup([a], {"backend": "a"} if labels else {}), SourceGroup([b], {"backend": "b"} if labels else {})]


_AB = "a AS (SELECT event_type, user_id::VARCHAR user_id, (epoch_us(ts) // 1000)::BIGINT ts, value v FROM events WHERE event_id % 5 <> 0), b AS (SELECT event_type, user_id::VARCHAR user_id, (epoch_us(ts) // 1000)::BIGINT ts, value + 1 v FROM events WHERE event_id % 3 = 0)"


def _raw(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[label(F.col("labels"), n).alias(n) for n in names], F.col("ts_ms").alias("ts"), F.round("value", 6).alias("value"))


def dedup_groups(spark, sf_dir):
    return _raw(_engine(spark, sf_dir, split(spark, sf_dir), fill_gaps=False).samples(()), "backend", *UT)


def gap_fill(spark, sf_dir):
    return _raw(_engine(spark, sf_dir, split(spark, sf_dir), gap_ms=3 * DAY).samples(()), "backend", *UT)


def gap_fill_auto(spark, sf_dir):
    """With the automatic threshold: twice the median interval of the winner, else of the filler."""
    return _raw(_engine(spark, sf_dir, split(spark, sf_dir)).samples(()), "backend", *UT)


def exact_mode_filled(spark, sf_dir):
    return flat(_engine(spark, sf_dir, split(spark, sf_dir), gap_ms=_GAP).query_range("sum by (event_type) (events_value)", START, END, DAY), "event_type")


def ha_merge_dynamic(spark, sf_dir):
    a, b = (g.replicas[0] for g in split(spark, sf_dir, labels=False))
    return _raw(SourceGroup([a, b], anti_affinity_ms=6 * 3_600_000, anti_affinity_dynamic=True).samples(), *UT)


def ha_merge(spark, sf_dir):
    a, b = (g.replicas[0] for g in split(spark, sf_dir, labels=False))
    return _raw(SourceGroup([a, b], anti_affinity_ms=6 * 3_600_000).samples(), *UT)


def union_groups(spark, sf_dir):
    return flat(_engine(spark, sf_dir, split(spark, sf_dir), mode="union").query_range("sum by (backend) (events_value)", START, END, DAY), "backend")


def exact_mode(spark, sf_dir):
    return flat(_engine(spark, sf_dir, split(spark, sf_dir), fill_gaps=False).query_range("sum by (event_type) (events_value)", START, END, DAY), "event_type")


def dedup_mode(spark, sf_dir):
    return flat(_engine(spark, sf_dir, split(spark, sf_dir), mode="dedup", fill_gaps=False).query_range("count by (event_type) (events_value)", START, END, DAY), "event_type")


def collision_stats(spark, sf_dir):
    from .operators.merge import collisions

    return collisions([g.samples() for g in _engine(spark, sf_dir, split(spark, sf_dir)).groups], {"backend"})


def source_scoped(spark, sf_dir):
    """Group labels, an injected matcher and a truncating time range."""
    g = SourceGroup([events_source(spark, sf_dir)], {"dc": "x"}, inject=(Matcher("event_type", "!=", "error"),), time_range=TimeRange(START, START + 10 * DAY, truncate=True))
    return flat(_engine(spark, sf_dir, [g]).query_range('count by (dc, event_type) (events_value{dc="x"})', START, END, DAY), "dc", "event_type")


def relabelled_source(spark, sf_dir):
    from .sources.groups import Relabel

    g = SourceGroup([events_source(spark, sf_dir)], relabel=(Relabel("uppercase", ("event_type",), "kind"), Relabel("labeldrop", regex="event_type")))
    return flat(_engine(spark, sf_dir, [g]).query_range('sum by (kind) (events_value{kind="VIEW"})', START, END, DAY), "kind")


def hist_quantile(spark, sf_dir):
    """Buckets of l_extendedprice by return flag, as one classic histogram per flag."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    from .sources.model import NAME, samples

    bounds = (1000, 5000, 10000, 25000, 50000, 100000)
    agg = rows.groupBy("l_returnflag").agg(*[F.count(F.when(F.col("l_extendedprice") <= b, 1)).alias(str(b)) for b in bounds], F.count(F.lit(1)).alias("+Inf"))
    long = agg.select("l_returnflag", F.explode(F.create_map(*[x for b in (*map(str, bounds), "+Inf") for x in (F.lit(b), F.col(f"`{b}`"))])).alias("le", "n"))
    s = samples(long, {NAME: F.lit("price_bucket"), "flag": F.col("l_returnflag"), "le": F.col("le")}, F.lit(START), F.col("n"))
    return flat(_engine(spark, sf_dir, [SourceGroup([s])]).query("histogram_quantile(0.5, price_bucket)", START), "flag")


_HQ = f"""WITH b AS (SELECT l_returnflag flag, le, count(*) FILTER (l_extendedprice <= le)::DOUBLE c, count(*)::DOUBLE n FROM lineitem, (SELECT unnest([1000, 5000, 10000, 25000, 50000, 100000])::DOUBLE le) GROUP BY ALL),
p AS (SELECT *, lag(le, 1, 0) OVER s pl, lag(c, 1, 0) OVER s pc FROM b WINDOW s AS (PARTITION BY flag ORDER BY le)),
f AS (SELECT * FROM p WHERE c >= 0.5 * n QUALIFY row_number() OVER (PARTITION BY flag ORDER BY le) = 1),
a AS (SELECT DISTINCT flag FROM b)
SELECT a.flag, {START}::BIGINT AS step, round(coalesce(pl + (le - pl) * (0.5 * n - pc) / (c - pc), 100000), 6) AS value FROM a LEFT JOIN f USING (flag)"""


def hist_fraction(spark, sf_dir):
    from .sources.model import NAME, samples

    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    agg = ev.groupBy("event_type").agg(*[F.count(F.when(F.col("value") <= b, 1)).alias(str(b)) for b in (10, 50, 100)], F.count(F.lit(1)).alias("+Inf"))
    long = agg.select("event_type", F.explode(F.create_map(*[x for b in ("10", "50", "100", "+Inf") for x in (F.lit(b), F.col(f"`{b}`"))])).alias("le", "n"))
    s = samples(long, {NAME: F.lit("v_bucket"), "event_type": F.col("event_type"), "le": F.col("le")}, F.lit(START), F.col("n"))
    return flat(_engine(spark, sf_dir, [SourceGroup([s])]).query("histogram_fraction(10, 50, v_bucket)", START), "event_type")


def native(fn: str):
    """fn over native histograms of events by type: custom buckets 20 wide, of which one sample per type is made."""

    def run(spark, sf_dir: str) -> DataFrame:
        from .sources.model import HIST, NAME, key_of

        ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("low", F.floor(F.col("value") / 20) * 20.0)
        buckets = ev.groupBy("event_type", "low").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("s"))
        one = F.struct(F.col("low").alias("lower"), (F.col("low") + 20.0).alias("upper"), F.col("n").alias("count"))
        by_type = buckets.groupBy("event_type").agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), F.array_sort(F.collect_list(one)).alias("buckets"))
        hist = F.struct(F.lit(-53).alias("schema"), "count", "sum", F.lit(0.0).alias("zero_threshold"), F.lit(0.0).alias("zero_count"), "buckets").cast(HIST)
        labels = F.create_map(F.lit(NAME), F.lit("v"), F.lit("event_type"), F.col("event_type"))
        rows = by_type.select(F.lit(0).alias("group_ord"), F.lit(0).alias("replica"), labels.alias("labels"), F.lit(START).alias("ts_ms"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("stale"), hist.alias("hist"))
        return flat(_engine(spark, sf_dir, [SourceGroup([rows.withColumn("lkey", key_of(F.col("labels")))])]).query(fn, START), "event_type")

    return run


def native_days(query: str):
    """query over native histograms h of each type's events up to the end of each day, and d of each day's own."""

    def run(spark, sf_dir: str) -> DataFrame:
        from pyspark.sql import Window

        from .sources.model import HIST, NAME, key_of

        ev = spark.read.parquet(f"{sf_dir}/events.parquet")
        ev = ev.select("event_type", (F.floor(epoch_ms(ev, "ts") / DAY) * DAY + DAY).cast("bigint").alias("ts_ms"), (F.floor(F.col("value") / 20) * 20.0).alias("low"), "value")
        days = ev.select("event_type", "ts_ms").distinct()
        own = ev.groupBy("event_type", "ts_ms", "low").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("s"))
        every = days.join(ev.select("event_type", "low").distinct(), "event_type").join(own, ["event_type", "ts_ms", "low"], "left")
        sofar = Window.partitionBy("event_type", "low").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
        grown = every.select("event_type", "ts_ms", "low", F.sum("n").over(sofar).alias("n"), F.sum("s").over(sofar).alias("s")).where("n IS NOT NULL")

        def samples_of(rows: DataFrame, name: str) -> DataFrame:
            one = F.struct(F.col("low").alias("lower"), (F.col("low") + 20.0).alias("upper"), F.col("n").alias("count"))
            by = rows.groupBy("event_type", "ts_ms").agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), F.array_sort(F.collect_list(one)).alias("buckets"))
            hist = F.struct(F.lit(-53).alias("schema"), "count", "sum", F.lit(0.0).alias("zero_threshold"), F.lit(0.0).alias("zero_count"), "buckets").cast(HIST)
            labels = F.create_map(F.lit(NAME), F.lit(name), F.lit("event_type"), F.col("event_type"))
            out = by.select(F.lit(0).alias("group_ord"), F.lit(0).alias("replica"), labels.alias("labels"), "ts_ms", F.lit(None).cast("double").alias("value"), F.lit(False).alias("stale"), hist.alias("hist"))
            return out.withColumn("lkey", key_of(F.col("labels")))

        source = samples_of(grown, "h").unionByName(samples_of(own, "d"))
        return flat(_engine(spark, sf_dir, [SourceGroup([source])]).query_range(query, START, END, DAY), "event_type")

    return run


_NDAYS = f"""WITH {GRID}, o AS (SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} + {DAY} ts, count(*)::DOUBLE n, sum(value) s FROM events GROUP BY ALL),
c AS (SELECT event_type, ts, sum(n) OVER (PARTITION BY event_type ORDER BY ts) n, sum(s) OVER (PARTITION BY event_type ORDER BY ts) s FROM o)"""


def synthetic_source(spark, sf_dir):
    from .sources.formats import synthetic
    from .sources.model import Grid

    rows = synthetic(spark, 200, Grid(START, START + 600_000, 15_000))
    return flat(_engine(spark, sf_dir, [SourceGroup([rows])], lookback_ms=60_000).query_range("sum by (region) (fake_metric)", START, START + 600_000, 60_000), "region")


def meta_names(spark, sf_dir):
    return _engine(spark, sf_dir).label_names()


def meta_values(spark, sf_dir):
    return _engine(spark, sf_dir).label_values("event_type", 'events_value{user_id=~"1.*"}')


def meta_series(spark, sf_dir):
    out = _engine(spark, sf_dir).series('events_value{event_type="view"}')
    return out.select(label(F.col("labels"), "user_id").alias("user_id"))


def cardinality_tables(spark, sf_dir):
    """All five tables, one under another."""
    found = _engine(spark, sf_dir).cardinality(10, "event_type")
    totals = found.pop("totals").select("group_ord", F.explode(F.create_map(F.lit("series"), F.col("series"), F.lit("label_pairs"), F.col("label_pairs"))).alias("name", "n"))
    parts = [t.select(F.lit(k).alias("what"), "group_ord", "name", F.col("n").cast("bigint").alias("n")) for k, t in {"totals": totals, **found}.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cardinality_top(spark, sf_dir):
    return _engine(spark, sf_dir).cardinality(10)["series_by_pair"]


def federate_latest(spark, sf_dir):
    out = _engine(spark, sf_dir).federate(['events_value{event_type="view"}', 'events_value{event_type="click"}'], END, {"cluster": "c1"})
    return out.select(label(F.col("labels"), "event_type").alias("event_type"), label(F.col("labels"), "user_id").alias("user_id"), label(F.col("labels"), "cluster").alias("cluster"), F.col("ts_ms").alias("ts"), F.round("value", 6).alias("value"))


def exposition_lines(spark, sf_dir):
    from .sources.formats import exposition

    ev = events_samples(spark, sf_dir).withColumn("value", F.floor("value").cast("double"))
    return exposition(ev).withColumnRenamed("value", "line")


def metadata_first(spark, sf_dir):
    """Metric metadata of two groups made from nation: the lower group's entry wins."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    a = n.where("n_nationkey % 2 = 0").select(F.lit(0).alias("group_ord"), F.col("n_name").alias("metric"), F.lit("counter").alias("type"), F.lit("first").alias("help"), F.lit("").alias("unit"))
    b = n.select(F.lit(1).alias("group_ord"), F.col("n_name").alias("metric"), F.lit("gauge").alias("type"), F.lit("second").alias("help"), F.lit("").alias("unit"))
    return catalog.metric_metadata(a.unionByName(b))


def exemplars_by_series(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = ev.select(F.create_map(F.lit("__name__"), F.lit("events_value"), F.lit("event_type"), F.col("event_type")).alias("series_labels"), F.create_map(F.lit("trace"), F.col("event_id").cast("string")).alias("ex_labels"), "value", epoch_ms(ev, "ts").alias("ts_ms"))
    out = catalog.exemplars(rows, [Matcher("event_type", "=~", "view|error")], START, START + DAY)
    return out.select(label(F.col("labels"), "event_type").alias("event_type"), F.explode("exemplars").alias("x")).select("event_type", F.col("x.ts_ms").alias("ts"), F.round("x.value", 6).alias("value"))


def capped_report(spark, sf_dir):
    """What an interactive tool says of a range query that it cuts to 20 series, with all their samples."""
    return _engine(spark, sf_dir).capped_range(SEL, START, END, DAY, 20, 100_000)[1]


def targets_kept(spark, sf_dir):
    """Two of three targets pass the rules; each is the same table, read once."""
    from .sources.groups import Relabel, relabel_targets

    targets = [{"__address__": f"{sf_dir}/events.parquet", "kind": k} for k in ("View", "Click", "Error")]
    kept = relabel_targets(targets, (Relabel("drop", ("kind",), regex="Err.*"), Relabel("lowercase", ("kind",), "kind")))
    rows = [spark.read.parquet(t["__address__"]).where(F.col("event_type") == t["kind"]) for t in kept]
    return reduce(lambda a, b: a.unionByName(b), rows).groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))


def source_stats(spark, sf_dir):
    return _engine(spark, sf_dir, split(spark, sf_dir)).stats("sum(events_value)", START, END, DAY)


_DEDUP = f"WITH {_AB}, ka AS (SELECT DISTINCT event_type, user_id FROM a), d AS (SELECT 'a' backend, * FROM a UNION ALL SELECT 'b', b.* FROM b ANTI JOIN ka USING (event_type, user_id))"
_INST_D = f"{GRID}, i AS (SELECT backend, event_type, user_id, step, arg_max(v, ts) v FROM g JOIN d ON ts > step - {LOOKBACK} AND ts <= step GROUP BY ALL)"
_GAP = 3 * DAY
#: Samples of b beside a's of the same series, with a's neighbours.
_FILLED = f"""{_DEDUP}, n AS (SELECT b.*, (SELECT max(ts) FROM a WHERE a.event_type = b.event_type AND a.user_id = b.user_id AND a.ts <= b.ts) lo, (SELECT min(ts) FROM a WHERE a.event_type = b.event_type AND a.user_id = b.user_id AND a.ts >= b.ts) hi FROM b SEMI JOIN ka USING (event_type, user_id))"""
_MEDIANS = ", ".join(f"m{t} AS (SELECT event_type, user_id, list_sort(list(g))[count(*) // 2 + 1] g FROM (SELECT event_type, user_id, ts - lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) g FROM {t}) WHERE g > 0 GROUP BY ALL)" for t in "ab")
OTHERS: dict[str, tuple] = {
    "dedup_groups": (dedup_groups, f"{_DEDUP} SELECT backend, event_type, user_id, ts, round(v, 6) AS value FROM d"),
    "gap_fill": (gap_fill, f"""{_FILLED}
      SELECT backend, event_type, user_id, ts, round(v, 6) AS value FROM d UNION ALL SELECT 'a', event_type, user_id, ts, round(v, 6) FROM n WHERE (lo IS NULL OR hi IS NULL OR hi - lo >= {_GAP}) AND (lo IS NULL OR ts > lo + {_GAP // 4}) AND (hi IS NULL OR ts < hi - {_GAP // 4})"""),
    "gap_fill_auto": (gap_fill_auto, f"""{_FILLED}, {_MEDIANS}, t AS (SELECT n.*, coalesce(2 * ma.g, 2 * mb.g, 1) gap FROM n LEFT JOIN ma USING (event_type, user_id) LEFT JOIN mb USING (event_type, user_id))
      SELECT backend, event_type, user_id, ts, round(v, 6) AS value FROM d UNION ALL SELECT 'a', event_type, user_id, ts, round(v, 6) FROM t WHERE (lo IS NULL OR hi IS NULL OR hi - lo >= gap) AND (lo IS NULL OR ts > lo + gap // 4) AND (hi IS NULL OR ts < hi - gap // 4)"""),
    "exact_mode_filled": (exact_mode_filled, f"""{_FILLED}, x AS (SELECT * FROM d UNION ALL SELECT 'a', event_type, user_id, ts, v FROM n WHERE (lo IS NULL OR hi IS NULL OR hi - lo >= {_GAP}) AND (lo IS NULL OR ts > lo + {_GAP // 4}) AND (hi IS NULL OR ts < hi - {_GAP // 4})),
      {_INST_D.replace("JOIN d ON", "JOIN x ON")} SELECT event_type, step, round(sum(v), 6) AS value FROM i GROUP BY ALL"""),
    "ha_merge_dynamic": (ha_merge_dynamic, f"""WITH {_AB}, u AS (SELECT 0 s, * FROM a UNION ALL SELECT 1, * FROM b), c AS (SELECT *, sum(1 - s) OVER w na, sum(s) OVER w nb FROM u WINDOW w AS (PARTITION BY event_type, user_id)), k AS (SELECT *, s = CASE WHEN nb > na THEN 1 ELSE 0 END base FROM c),
      q AS (SELECT event_type, user_id, base, ts - lag(ts) OVER (PARTITION BY event_type, user_id, base ORDER BY ts) g FROM k), z AS (SELECT event_type, user_id, list_sort(coalesce(list(g) FILTER (base AND g > 0), [])) own, list_sort(coalesce(list(g) FILTER (g > 0), [])) every FROM q GROUP BY ALL),
      y AS (SELECT event_type, user_id, CASE WHEN len(own) >= 3 THEN own[len(own) // 2 + 1] // 2 WHEN len(every) >= 3 THEN every[len(every) // 2 + 1] // 2 ELSE 21600000 END dd FROM z),
      x AS (SELECT *, max(CASE WHEN base THEN ts END) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) p, min(CASE WHEN base THEN ts END) OVER (PARTITION BY event_type, user_id ORDER BY ts DESC RANGE UNBOUNDED PRECEDING) n FROM k JOIN y USING (event_type, user_id))
      SELECT event_type, user_id, ts, round(v, 6) AS value FROM x WHERE base OR CASE WHEN p IS NULL AND n IS NULL THEN true WHEN p IS NULL THEN ts < n - dd WHEN n IS NULL THEN ts > p + dd ELSE n - p > 2 * dd AND ts > p + dd AND ts < n - dd END"""),
    "ha_merge": (ha_merge, f"""WITH {_AB}, u AS (SELECT 0 s, * FROM a UNION ALL SELECT 1, * FROM b), c AS (SELECT *, sum(1 - s) OVER w na, sum(s) OVER w nb FROM u WINDOW w AS (PARTITION BY event_type, user_id)), k AS (SELECT *, s = CASE WHEN nb > na THEN 1 ELSE 0 END base FROM c),
      x AS (SELECT *, max(CASE WHEN base THEN ts END) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) p, min(CASE WHEN base THEN ts END) OVER (PARTITION BY event_type, user_id ORDER BY ts DESC RANGE UNBOUNDED PRECEDING) n FROM k)
      SELECT event_type, user_id, ts, round(v, 6) AS value FROM x WHERE base OR CASE WHEN p IS NULL AND n IS NULL THEN true WHEN p IS NULL THEN ts < n - 21600000 WHEN n IS NULL THEN ts > p + 21600000 ELSE n - p > 43200000 AND ts > p + 21600000 AND ts < n - 21600000 END"""),
    "union_groups": (union_groups, f"WITH {_AB}, d AS (SELECT 'a' backend, * FROM a UNION ALL SELECT 'b', * FROM b), {_INST_D} SELECT backend, step, round(sum(v), 6) AS value FROM i GROUP BY ALL"),
    "exact_mode": (exact_mode, f"{_DEDUP}, {_INST_D} SELECT event_type, step, round(sum(v), 6) AS value FROM i GROUP BY ALL"),
    "dedup_mode": (dedup_mode, f"WITH {_AB}, d AS (SELECT 'a' backend, * FROM a UNION ALL SELECT 'b', * FROM b), {_INST_D} SELECT event_type, step, count(*)::DOUBLE AS value FROM i GROUP BY ALL"),
    "collision_stats": (collision_stats, f"WITH {_AB} SELECT 0 AS winner, 1 AS loser, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM a) JOIN (SELECT DISTINCT event_type, user_id FROM b) USING (event_type, user_id)"),
    "source_scoped": (source_scoped, f"WITH {GRID}, {EV}, i AS (SELECT event_type, user_id, step FROM g JOIN e ON ts > step - {LOOKBACK} AND ts <= step WHERE ts >= {START} AND ts <= {START + 10 * DAY} AND event_type <> 'error' GROUP BY ALL) SELECT 'x' AS dc, event_type, step, count(*)::DOUBLE AS value FROM i GROUP BY ALL"),
    "relabelled_source": (relabelled_source, inst("SELECT 'VIEW' AS kind, step, round(sum(v), 6) AS value FROM i WHERE event_type = 'view' GROUP BY ALL")),
    "hist_quantile": (hist_quantile, _HQ),
    "hist_fraction": (hist_fraction, f"SELECT event_type, {START}::BIGINT AS step, round(count(*) FILTER (value > 10 AND value <= 50) / count(*), 6) AS value FROM events GROUP BY event_type"),
    "hist_native_count": (native("histogram_count(v)"), f"SELECT event_type, {START}::BIGINT AS step, count(*)::DOUBLE AS value FROM events GROUP BY event_type"),
    "hist_native_sum": (native("histogram_sum(sum(v))"), f"SELECT '' AS event_type, {START}::BIGINT AS step, round(sum(value), 6) AS value FROM events"),
    "hist_native_avg": (native("histogram_avg(v)"), f"SELECT event_type, {START}::BIGINT AS step, round(avg(value), 6) AS value FROM events GROUP BY event_type"),
    "hist_native_stdvar": (native("histogram_stdvar(v)"), f"""WITH b AS (SELECT event_type, floor(value / 20) * 20 lo, count(*) n FROM events GROUP BY ALL), m AS (SELECT event_type, avg(value) mean, count(*) c FROM events GROUP BY ALL)
      SELECT event_type, {START}::BIGINT AS step, round(sum(n * pow(CASE WHEN lo <= 0 AND lo + 20 >= 0 THEN 0 ELSE lo + 10 END - mean, 2)) / any_value(c), 6) AS value FROM b JOIN m USING (event_type) GROUP BY event_type"""),
    "hist_native_stddev": (native("histogram_stddev(v)"), f"""WITH b AS (SELECT event_type, floor(value / 20) * 20 lo, count(*) n FROM events GROUP BY ALL), m AS (SELECT event_type, avg(value) mean, count(*) c FROM events GROUP BY ALL)
      SELECT event_type, {START}::BIGINT AS step, round(sqrt(sum(n * pow(CASE WHEN lo <= 0 AND lo + 20 >= 0 THEN 0 ELSE lo + 10 END - mean, 2)) / any_value(c)), 6) AS value FROM b JOIN m USING (event_type) GROUP BY event_type"""),
    "hist_native_fraction": (native("histogram_fraction(20, 60, v)"), f"SELECT event_type, {START}::BIGINT AS step, round(count(*) FILTER (value >= 20 AND value < 60) / count(*), 6) AS value FROM events GROUP BY event_type"),
    "hist_native_quantile": (native("histogram_quantile(0.5, v)"), f"""WITH b AS (SELECT event_type, floor(value / 20) * 20 lo, count(*) n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY lo) u, sum(n) OVER (PARTITION BY event_type) t FROM b)
      SELECT event_type, {START}::BIGINT AS step, round(lo + 20 * (0.5 * t - (u - n)) / n, 6) AS value FROM c WHERE u >= 0.5 * t QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY lo) = 1"""),
    "hist_native_increase": (native_days("histogram_count(increase(h[7d]))"), f"""{_NDAYS}, w AS (SELECT event_type, step, arg_max(n, ts) - arg_min(n, ts) d, (max(ts) - min(ts))::DOUBLE s, (max(ts) - min(ts)) / (count(*) - 1)::DOUBLE m, min(ts) - step + {7 * DAY} h, step - max(ts) t FROM g JOIN c ON ts > step - {7 * DAY} AND ts <= step GROUP BY event_type, step HAVING count(*) > 1)
      SELECT event_type, step, round(d * (s + CASE WHEN h >= m * 1.1 THEN m / 2 ELSE h END + CASE WHEN t >= m * 1.1 THEN m / 2 ELSE t END) / s, 6) AS value FROM w"""),
    "hist_native_sum_over_time": (native_days("histogram_sum(sum_over_time(d[7d]))"), f"{_NDAYS} SELECT event_type, step, round(sum(s), 6) AS value FROM g JOIN o ON ts > step - {7 * DAY} AND ts <= step GROUP BY ALL"),
    "hist_native_avg_over_time": (native_days("histogram_count(avg_over_time(d[7d]))"), f"{_NDAYS} SELECT event_type, step, round(avg(n), 6) AS value FROM g JOIN o ON ts > step - {7 * DAY} AND ts <= step GROUP BY ALL"),
    "hist_native_idelta": (native_days("histogram_count(idelta(d[7d]))"), f"{_NDAYS} SELECT event_type, step, round(list(n ORDER BY ts DESC)[1] - list(n ORDER BY ts DESC)[2], 6) AS value FROM g JOIN o ON ts > step - {7 * DAY} AND ts <= step GROUP BY ALL HAVING count(*) > 1"),
    "synthetic_source": (synthetic_source, f"SELECT 'r-' || (i % 4) AS region, t::BIGINT AS step, round(sum(i % 1000 + ((t // 1000) % 60) / 4.0), 6)::DOUBLE AS value FROM range(200) s(i), range({START}, {START} + 600001, 60000) g(t) GROUP BY ALL"),
    "meta_names": (meta_names, "SELECT unnest(['__name__', 'event_type', 'user_id']) AS name"),
    "meta_values": (meta_values, "SELECT DISTINCT event_type AS value FROM events WHERE user_id::VARCHAR LIKE '1%'"),
    "meta_series": (meta_series, "SELECT DISTINCT user_id::VARCHAR AS user_id FROM events WHERE event_type = 'view'"),
    "cardinality_top": (cardinality_top, "WITH s AS (SELECT DISTINCT event_type, user_id::VARCHAR u FROM events), p AS (SELECT '__name__=events_value' AS name FROM s UNION ALL SELECT 'event_type=' || event_type FROM s UNION ALL SELECT 'user_id=' || u FROM s) SELECT 0 AS group_ord, name, count(*) AS n FROM p GROUP BY name ORDER BY n DESC, name LIMIT 10"),
    "cardinality_tables": (cardinality_tables, """WITH s AS (SELECT DISTINCT event_type, user_id::VARCHAR u FROM events), p AS (SELECT '__name__' k, 'events_value' v, event_type, u FROM s UNION ALL SELECT 'event_type', event_type, event_type, u FROM s UNION ALL SELECT 'user_id', u, event_type, u FROM s),
      f AS (SELECT 'totals' what, 'series' AS name, count(*) n FROM s UNION ALL SELECT 'totals', 'label_pairs', count(DISTINCT (k, v)) FROM p UNION ALL SELECT 'series_by_metric', 'events_value', count(*) FROM s UNION ALL SELECT 'values_by_label', k, count(DISTINCT v) FROM p GROUP BY k
        UNION ALL SELECT 'series_by_focus', event_type, count(*) FROM s GROUP BY event_type UNION ALL (SELECT 'series_by_pair', k || '=' || v AS name, count(*) n FROM p GROUP BY 2 ORDER BY n DESC, name LIMIT 10))
      SELECT what, 0 AS group_ord, name, n FROM f"""),
    "federate_latest": (federate_latest, f"WITH {EV} SELECT event_type, user_id, 'c1' AS cluster, max(ts) AS ts, round(arg_max(v, ts), 6) AS value FROM e WHERE ts > {END} - {LOOKBACK} AND ts <= {END} AND event_type IN ('view', 'click') GROUP BY event_type, user_id"),
    "exposition_lines": (exposition_lines, "SELECT 'events_value{event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"} ' || floor(value)::BIGINT || ' ' || (epoch_us(ts) // 1000) AS line FROM events"),
    "metadata_first": (metadata_first, "SELECT n_name AS metric, CASE WHEN n_nationkey % 2 = 0 THEN 'counter' ELSE 'gauge' END AS type, CASE WHEN n_nationkey % 2 = 0 THEN 'first' ELSE 'second' END AS help, '' AS unit FROM nation"),
    "exemplars_by_series": (exemplars_by_series, f"SELECT event_type, (epoch_us(ts) // 1000)::BIGINT AS ts, round(value, 6) AS value FROM events WHERE event_type IN ('view', 'error') AND (epoch_us(ts) // 1000) BETWEEN {START} AND {START + DAY}"),
    "source_stats": (source_stats, f"WITH {_AB} SELECT 0 AS group_ord, 1 AS requests, 0 AS errors, count(DISTINCT (event_type, user_id)) AS series, count(*) AS samples FROM a WHERE ts > {START} - {LOOKBACK} - 1 AND ts <= {END} AND ts > {START} - {LOOKBACK} UNION ALL SELECT 1, 1, 0, count(DISTINCT (event_type, user_id)), count(*) FROM b WHERE ts > {START} - {LOOKBACK} AND ts <= {END}"),
    "capped_report": (capped_report, inst("SELECT count(DISTINCT (event_type, user_id)) AS series, count(*) AS samples, 20 AS shown_series, least(100000, (SELECT count(*) FROM (SELECT *, dense_rank() OVER (ORDER BY '\"' || event_type || '\"},{\"key\":\"user_id\",\"value\":\"' || user_id || '\"') r FROM i) WHERE r <= 20)) AS shown_samples FROM i")),
    "targets_kept": (targets_kept, "SELECT event_type, count(*)::DOUBLE AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type"),
}


def queries() -> dict:
    return {k: v[0] for k, v in (TABLE | OTHERS).items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in (TABLE | OTHERS).items() if v[1] is not None}
