"""The corpus pipeline, stage by stage, on a small table."""

import corpus_pipeline
from pyspark.sql import functions as F

TEXT = "the thing that we saw there was only one of many others which people would have liked to see again after that first day"


def test_stages(spark, tmp_path):
    item = "benchmark question about the seven wonders and where each of them once stood in the old world"
    rows = [
        (1, TEXT, "en", "a", 0),
        (2, TEXT + " x", "en", "a", 0),
        (3, "avec les autres nous sommes dans cette maison pour faire une chose comme " + "bien " * 3, "fr", "a", 0),
        (4, "12 34", None, "b", 0),
        (5, None, "en", "b", 0),
        (6, "people said that " + item + " and so on", "en", "c", 0),
        (7, "please write to someone@example.com about the thing", "en", "c", 51),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, function in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.stage(function(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == before
            kept.append(sorted(r["doc_id"] for r in docs.collect()))
        if name == "personal_data":
            seven = docs.filter("doc_id = 7").first()
            assert "[EMAIL]" in seven["text"] and seven["n_chars"] == len(seven["text"])
    assert kept == [[1, 2, 3, 6, 7], [1, 3, 6, 7], [1, 3, 7], [1, 3, 7]]
    assert {r["doc_id"] for r in docs.collect()} == {1, 3, 7}
    assert corpus_pipeline.ORACLE_SQL is None
    assert docs.agg(F.max("length")).first()[0] <= 2048


def test_repeated_and_null_ids(spark):
    rows = [(1, TEXT), (1, TEXT), (2, "other words here"), (2, "another text"), (None, TEXT), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __place string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, TEXT), (2, "another text"), (None, TEXT), (None, None)], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.personal_data(spark, docs, "").columns == docs.columns
