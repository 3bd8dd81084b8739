"""File formats: NDJSON export, captured API responses, the text exposition sink, a synthetic source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import num
from .model import NAME, Grid, key_of, label

_FLOAT = {"NaN": "NaN", "Infinity": "Infinity", "-Infinity": "-Infinity", "+Inf": "Infinity", "Inf": "Infinity", "-Inf": "-Infinity"}


def parse_value(text: Column) -> Column:
    """A sample's value as JSON carries it: a number, null or "NaN" for NaN, infinities by name."""
    out = text
    for k, v in _FLOAT.items():
        out = F.when(text == k, F.lit(v)).otherwise(out)
    return F.coalesce(out.try_cast("double"), num.lit(num.NAN))


def read_export(spark: SparkSession, path: str, group_ord: int = 0) -> DataFrame:
    """Lines {"metric": {}, "values": [], "timestamps": []}. Of a time that comes twice the last value wins; sorted on demand."""
    lines = spark.read.schema("metric map<string,string>, values array<string>, timestamps array<bigint>, _corrupt_record string").json(path)
    bad = F.size("values") != F.size("timestamps")
    checked = F.when(bad, F.raise_error(F.lit("values and timestamps differ in length")).cast("array<string>")).otherwise(F.col("values"))
    rows = lines.where(F.col("metric").isNotNull()).select(F.col("metric").alias("labels"), F.posexplode(F.arrays_zip(checked.alias("v"), F.col("timestamps").alias("t"))).alias("pos", "s"), F.monotonically_increasing_id().alias("line"))
    rows = rows.select("labels", key_of(F.col("labels")).alias("lkey"), F.col("s.t").alias("ts_ms"), parse_value(F.col("s.v")).alias("value"), F.struct("line", "pos").alias("at"))
    last = rows.groupBy("lkey", "ts_ms").agg(F.max_by("value", "at").alias("value"))
    from .model import labels_of

    return last.select(F.lit(group_ord).alias("group_ord"), F.lit(0).alias("replica"), labels_of(F.col("lkey")).alias("labels"), "ts_ms", "value", F.lit(False).alias("stale"), "lkey")


_RESPONSE = "status string, errorType string, error string, warnings array<string>, infos array<string>, data struct<resultType:string,result:string>"


def read_response(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A captured API response, one JSON object a file: (samples lkey, ts_ms, value; warnings). A scalar is one series without
    labels, a string none; an unknown type or an error status raises."""
    text = spark.read.option("wholetext", True).text(path)
    head = text.select(F.from_json("value", _RESPONSE).alias("r"))
    notes = head.select("r.status", "r.error", "r.data.resultType", F.concat(F.coalesce("r.warnings", F.array().cast("array<string>")), F.coalesce("r.infos", F.array().cast("array<string>"))).alias("w")).collect()
    warnings = [w for n in notes for w in n["w"]]
    for n in notes:
        if n["status"] != "success":
            raise ValueError(f"response failed: {n['error']}")
        if n["resultType"] not in ("vector", "matrix", "scalar", "string"):
            raise ValueError(f"unknown result type {n['resultType']!r}")
    kind, result = F.col("r.data.resultType"), F.col("r.data.result")
    rows = head.where(kind.isin("vector", "matrix")).select(F.explode(F.from_json(result, "array<struct<metric:map<string,string>,value:array<string>,values:array<array<string>>>>")).alias("s"))
    points = rows.select(key_of(F.col("s.metric")).alias("lkey"), F.explode(F.coalesce(F.col("s.values"), F.array("s.value"))).alias("p"))
    scalars = head.where(kind == "scalar").select(F.lit("[]").alias("lkey"), F.from_json(result, "array<string>").alias("p"))
    both = points.unionByName(scalars).where(F.col("p").isNotNull())
    return both.select("lkey", F.round(F.get("p", F.lit(0)).cast("double") * 1000).cast("bigint").alias("ts_ms"), parse_value(F.get("p", F.lit(1))).alias("value")), warnings


def exposition(vector: DataFrame) -> DataFrame:
    """labels, value, ts_ms as lines of the text exposition format: name{a="b"} value ts."""
    def escaped(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))

    entries = F.array_sort(F.map_entries(F.map_filter("labels", lambda k, v: k != NAME)))
    pairs = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    body = F.when(F.size(entries) > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise("")
    return vector.select(F.concat(label(F.col("labels"), NAME), body, F.lit(" "), num.sample_text(F.col("value")), F.lit(" "), F.col("ts_ms").cast("string")).alias("value"))


def read_samples(spark: SparkSession, *paths: str) -> DataFrame:
    """Canonical samples from Parquet files: labels, ts_ms and value, and stale, hist and lkey where they are stored."""
    df = spark.read.parquet(*paths)
    have = {*df.columns}
    if "stale" not in have:
        df = df.withColumn("stale", F.lit(False))
    if "lkey" not in have:
        df = df.withColumn("lkey", key_of(F.col("labels")))
    return df.withColumn("group_ord", F.lit(0)).withColumn("replica", F.lit(0))


def write_exposition(vector: DataFrame, path: str) -> None:
    exposition(vector).write.mode("overwrite").text(path)


def synthetic(spark: SparkSession, n_series: int, grid: Grid, metric: str = "fake_metric", overlap: float = 0.5, instance: int = 0, group_ord: int = 0) -> DataFrame:
    """Deterministic series for benchmarks: the first share of them has the same labels in every instance."""
    shared = int(n_series * overlap)
    i = F.col("id")
    who = F.when(i < shared, F.concat(F.lit("i-"), i)).otherwise(F.concat(F.lit(f"i-{instance}-"), i))
    labels = F.create_map(*[x for k, v in {NAME: F.lit(metric), "env": F.lit("prod"), "instance": who, "job": F.lit("fake"), "region": F.concat(F.lit("r-"), i % 4), "shard": (i % 16).cast("string")}.items() for x in (F.lit(k), v)])
    rows = spark.range(n_series).select(labels.alias("labels"), i.alias("i"), F.explode(F.sequence(F.lit(grid.start).cast("bigint"), F.lit(grid.last).cast("bigint"), F.lit(grid.step).cast("bigint"))).alias("ts_ms"))
    value = (F.col("i") % 1000) + (F.floor(F.col("ts_ms") / 1000) % 60) / 4
    return rows.select(F.lit(group_ord).alias("group_ord"), F.lit(0).alias("replica"), "labels", "ts_ms", value.cast("double").alias("value"), F.lit(False).alias("stale"), key_of(F.col("labels")).alias("lkey"))
