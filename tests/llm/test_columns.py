"""Stages of the pipeline keep columns of any name and kind; letters decide what has a language."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm.common import row_hash
from codestrata.llm.language import NONE, identify, words_of

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return docs.withColumns({"a.b": F.col("doc_id") * 2, "m": F.create_map(F.lit("k"), "source"), "s": F.struct(F.create_map(F.lit("x"), "doc_id").alias("y")), "t ick;": F.lit(1), "root": F.lit("r"), "mark": F.lit("m"), "key": F.lit("k"), "lang_pred": F.lit("l"), "mix_id": F.lit(0)})


def test_stages_keep_odd_columns(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == odd.columns, name
    rows = docs.collect()
    assert rows and all(r["a.b"] == 2 * r["doc_id"] and r["m"] == {"k": r["source"]} and r["s"]["y"] == {"x": r["doc_id"]} and r["key"] == "k" for r in rows)
    plain = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, plain, DATA)
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() > 0


def test_rows_with_maps_have_a_hash(odd):
    assert odd.select(row_hash(odd).alias("h")).distinct().count() == odd.count()


def test_only_letters_are_words(spark):
    assert words_of("½ ② ² 3 _ a²b Ünï٣x ⅷ") == ["a", "b", "ünï", "x"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    some = spark.createDataFrame([(-1, "½ ② ²", None), (-2, "٣ 3 !", None), (-3, "", None), (-4, None, None)], docs.schema)
    assert [(r.lang_pred, r.score) for r in identify(docs.union(some)).filter("doc_id < 0").collect()] == [(NONE, 0.0)] * 4
