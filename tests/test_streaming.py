from promtest import load
from seriesloom.streaming.windows import rollup


def test_stream_equals_batch(spark, tmp_path):
    df = load(spark, "1m", 'm{i="0"} 1+1x20\nm{i="1"} 5x20\n').select("lkey", "ts_ms", "value", "stale")
    df.where("ts_ms < 600000").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("ts_ms >= 600000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = rollup(stream, "sum_over_time", 300_000, late_ms=60_000).writeStream.format("memory").queryName("rolled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r[0], r[1]): r[2] for r in spark.sql("select * from rolled").collect()}
    want = {(r[0], r[1]): r[2] for r in rollup(df, "sum_over_time", 300_000).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(got) >= 6
