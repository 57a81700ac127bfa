"""The stored index: files by bytes of text, pruned reads, versions, swaps."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from codestrata.functions.text import tokens
from codestrata.operators import index as ix
from codestrata.plans.index import body_index, index_snippets
from codestrata.sources.files import publish, version_of

DATA = "/root/testdata/sf0.001"


def parquet_files(folder):
    return [x for x in os.listdir(folder) if x.endswith(".parquet")]


def rows(spark, n=400):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.col("id").cast("string"), F.lit(" word word")).alias("body"), F.when(F.col("id") % 3 == 0, "x y").alias("title"))


def test_one_file_for_so_many_bytes(spark, tmp_path, monkeypatch):
    df = rows(spark)
    assert ix.index_files(df, ["body", "title"]) == 1
    assert ix.index_files(df.limit(0), ["body"]) == 1
    # A join's estimate is the product of both sides; what is measured isn't.
    joined = df.join(df.select("doc_id", F.lit(1).alias("z")), "doc_id")
    ix.write_index(joined, f"{tmp_path}/one", key="doc_id", columns=["body", "title"])
    assert len(parquet_files(tmp_path / "one/postings")) == 1
    size = df.agg(F.sum(F.octet_length("body"))).first()[0]
    monkeypatch.setattr(ix, "FILE_BYTES", size // 4)
    assert ix.index_files(df, ["body"]) == 5
    ix.write_index(df, f"{tmp_path}/more", key="doc_id", columns=["body", "title"])
    assert 1 < len(parquet_files(tmp_path / "more/postings")) <= 6
    one, more = (ix.Index(spark, f"{tmp_path}/{x}") for x in ("one", "more"))
    for text in ("word", "common 39*", "x_y", "common word"):
        assert sorted(map(tuple, one.scores(text).collect())) == sorted(map(tuple, more.scores(text).collect())), text


def test_filters_reach_the_scan(spark):
    plan = body_index(spark, DATA).scores("general pub*")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = {x.strip() for x in plan.split("\n") if "PushedFilters" in x}
    assert any("EqualTo(token,general)" in x and "StringStartsWith(token,pub)" in x for x in pushed) and any("EqualTo(token,)" in x for x in pushed) and len(pushed) == 2, pushed


def test_row_groups_skip_tokens(spark, tmp_path, monkeypatch):
    """Postings lie sorted, so the bounds of most row groups exclude a token."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(ix, "GROUP_BYTES", 64 << 10)
    ix.write_index(rows(spark, 60_000), f"{tmp_path}/i", key="doc_id", columns=["body", "title"])
    (name,) = parquet_files(tmp_path / "i/postings")
    meta = pq.ParquetFile(tmp_path / "i/postings" / name).metadata
    at = meta.schema.to_arrow_schema().names.index("token")
    bounds = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
    assert len(bounds) > 4 and sum(b.min <= "59999" <= b.max for b in bounds) <= 2
    assert ix.Index(spark, f"{tmp_path}/i").scores("59999").count() == 1


def test_index_is_swapped_as_a_whole(spark, tmp_path):
    folder = f"{tmp_path}/i"
    ix.write_index(rows(spark, 10), folder, key="doc_id", columns=["body"])
    ix.write_index(rows(spark, 20), folder, key="doc_id", columns=["body"])
    assert ix.Index(spark, folder).n == 20 and os.listdir(tmp_path) == ["i"]
    broken = rows(spark, 5).withColumn("body", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        ix.write_index(broken, folder, key="doc_id", columns=["body"], files=1)
    assert ix.Index(spark, folder).n == 20
    with pytest.raises(Exception):
        publish(spark, f"{tmp_path}/nothing", folder)
    assert ix.Index(spark, folder).n == 20


def test_tables_that_change_get_a_new_index(spark, tmp_path):
    shutil.copy(f"{DATA}/documents.parquet", tmp_path / "documents.parquet")
    before = version_of(spark, f"{tmp_path}/documents.parquet")
    first = body_index(spark, str(tmp_path))
    assert body_index(spark, str(tmp_path)) is first and first.n == 200
    os.remove(tmp_path / "documents.parquet")
    spark.read.parquet(f"{DATA}/documents.parquet").limit(50).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert version_of(spark, f"{tmp_path}/documents.parquet") != before
    assert body_index(spark, str(tmp_path)).n == 50


def test_like_documents_have_the_very_same_score(spark, tmp_path, monkeypatch):
    """Parts are added phrase by phrase: sums in the order of arrival differ in the last bit and turn ties around."""
    text = F.concat_ws(" ", *[F.repeat(F.lit(f"{w} "), (F.floor(F.col("id") / 2) % n + 1).cast("int")) for w, n in (("alpha", 2), ("beta", 3), ("gamma", 5), ("delta", 7))])
    df = spark.range(60).select(F.col("id").alias("doc_id"), text.alias("body"), F.lit("PARTIAL").alias("kind"))
    other = spark.range(60, 300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("zeta"), *[F.when(F.col("id") % n == 0, w) for n, w in ((7, "alpha"), (5, "beta"), (11, "gamma"), (3, "delta"))]).alias("body"), F.lit("FULL").alias("kind"))
    ix.write_index(df.union(other), f"{tmp_path}/i", key="doc_id", columns=["body"], facets=["kind"])
    matches = ix.Index.matches
    order = F.when(F.col("doc") % 2 == 0, F.col("phrase")).otherwise(-F.col("phrase"))
    monkeypatch.setattr(ix.Index, "matches", lambda self, *a: matches(self, *a).repartitionByRange(1, order).sortWithinPartitions(order))
    found = ix.Index(spark, f"{tmp_path}/i").scores("alpha beta gamma delta", facets=(("kind", "PARTIAL"),)).collect()
    score = dict((r.doc, r.score) for r in found)
    assert len(score) == 60 and all(score[i] == score[i + 1] for i in range(0, 60, 2))


def test_texts_are_cut_to_tokens_once(spark, tmp_path):
    """Ranges and totals come from what was written, so each row is cut by one task once."""
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    df = rows(spark).withColumn("title", F.udf(count, "string")("title"))
    ix.write_index(df, f"{tmp_path}/i", key="doc_id", columns=["body", "title"], files=3)
    assert seen.value == 400
    i = ix.Index(spark, f"{tmp_path}/i")
    assert i.n == 400 and i.mean == (400 * 4 + 134 * 2) / 400
    ix.write_index(rows(spark).limit(0), f"{tmp_path}/none", key="doc_id", columns=["body"])
    assert ix.Index(spark, f"{tmp_path}/none").n == 0


def test_words_are_numbered_where_texts_are_read(spark, tmp_path):
    """Texts reach the workers whole, not as lists of words, and give the tokens of the native expression in their places."""
    texts = ["Éa_b-c1 日本", None, "", "ÅNGSTRÖM \u0301 e\u0301\u0301x İ ΟΔΟΣ ǅ x\u00b2 \U00010400b \ue000 𝟘 a\u0301\u0302", "the The THE ٣ \u1e9e ﬁ", "plain " * 50]
    df = spark.createDataFrame([(i, t, "k" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, body string, kind string")
    ix.write_index(df, f"{tmp_path}/i", key="doc_id", columns=["kind", "body"], facets=["kind"], files=2)
    own = ix.Index(spark, f"{tmp_path}/i").each().select("token", "doc", F.explode("entries").alias("e"), "length")
    found = {(r.token, r.doc, r.e // ix.PLACES, r.e % ix.PLACES) for r in own.collect()}
    lists = df.select("doc_id", *[tokens(F.coalesce(c, F.lit(""))).alias(c) for c in ("kind", "body")]).collect()
    wanted = {(t, r.doc_id, i, at) for r in lists for i in range(2) for at, t in enumerate(r[i + 1])} | {("kind=k", i, ix.FACETS, 0) for i in (1, 3, 5)}
    assert found == wanted
    assert {r.doc: r.length for r in own.collect()} == {r.doc_id: sum(w[1] == r.doc_id for w in wanted) for r in lists if any(w[1] == r.doc_id for w in wanted)}
    few = ix._postings(2, 60)  # two rows a block, and fewer where they have over 60 tokens
    ix_rows = df.repartition(1).sortWithinPartitions("doc_id").select("doc_id", "body", F.array().cast("array<string>").alias("told"))
    made = ix_rows.mapInArrow(few, "token string, block long, rows array<smallint>, ends array<int>, entries array<int>, docs array<long>, lengths array<int>")
    blocks = [list(r.docs) for r in made.filter("token = ''").collect()]
    assert blocks == [[0, 1], [2, 3], [4, 5]]


def test_snippets_are_made_for_the_page_only(spark):
    plan = index_snippets(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert r"(\S+)" in plan[: plan.index("Join")] and r"(\S+)" not in plan[plan.index("Join") :]
