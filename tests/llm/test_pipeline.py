"""The pipeline's stages one after another on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import mixing, shared
from util import SCHEMA, empty, messy, words


def test_stages(spark, tmp_path):
    rnd = random.Random(8)
    good = [" ".join(words(rnd, 120, 3000)) for _ in range(60)]
    junk = [" ".join(x + "###" for x in words(rnd, 60, 3000)) for _ in range(25)]
    item = "a question about trains that leave at 40 km per hour and meet another train from the south before noon"
    near = good[3].split()
    near[50] = "changed"
    texts = good + junk + [good[0], " ".join(near), " ".join(words(rnd, 100, 3000)) + " " + item]
    labels = [(i, int(i < 60), 0) for i in range(85)]
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before_mix = docs
        docs = shared.table(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        kept.append({r[0] for r in docs.select("doc_id").collect()})
    assert kept[0] == set(range(60)) | {85, 86, 87}
    assert kept[1] == set(range(60)) | {87}
    assert kept[2] == set(range(60))
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2 and 60 < docs.count() <= 120
    trained = [r["doc_id"] for r in mixing.curriculum(before_mix).select("doc_id").collect()]
    assert trained != sorted(trained)
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = sorted(out.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == trained
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))


def _write(df, labels, bench, folder, spark):
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_messy_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and clashing columns go through all stages."""
    df = messy(spark)
    _write(df, [(0, 1, 0), (None, None, None)], [(0, None), (None, "same row twice again")], tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.table(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() > 0 and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    assert {None, 3} <= {r["doc_id"] for r in rows}


def test_empty_tables(spark, tmp_path):
    _write(empty(spark), [], [], tmp_path, spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
