"""Search queries: BM25, filters, vectors, relevance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators.search import dot, merged_topk, normalised, snippet, vector_topk
from codestrata.plans.index import body_index
from codestrata.plans.registry import query
from codestrata.sources.adapters import DELETIONS, deletions, table

_TOKENS = "list_filter(regexp_extract_all(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_INDEX = f", ix AS (SELECT id, doc_id, {_TOKENS.format('repo')} AS r, {_TOKENS.format('body')} AS b FROM deletions)"


def _bm25_sql(counts: str) -> str:
    return f"""{_INDEX}, f AS (SELECT id, len(r) + len(b) AS length, {counts} FROM ix), s AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (f0 > 0) AS n0 FROM f),
    w AS (SELECT *, CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) > 0 THEN ln((n - n0 + 0.5) / (n0 + 0.5)) ELSE 1e-6 END AS idf FROM s)
    SELECT id, round(-(idf * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM f, w WHERE f0 > 0"""


_BODY_WEIGHTS = (10.0, 2.0)


def _scored(frame):
    return frame.select(F.col("doc").cast("string").alias("id"), F.round("score", 6).alias("score"))


@query(_bm25_sql("10 * len(list_filter(r, lambda x: x = 'worthless'))::DOUBLE + 2 * len(list_filter(b, lambda x: x = 'worthless'))::DOUBLE AS f0"), (DELETIONS,))
def search_bm25(spark, d):
    return _scored(body_index(spark, d).scores("worthless", _BODY_WEIGHTS))


@query(_bm25_sql("10 * len(list_filter(r, lambda x: starts_with(x, 'wor')))::DOUBLE + 2 * len(list_filter(b, lambda x: starts_with(x, 'wor')))::DOUBLE AS f0"), (DELETIONS,))
def search_prefix(spark, d):
    return _scored(body_index(spark, d).scores("wor*", _BODY_WEIGHTS))


@query(_bm25_sql("2 * len(list_filter(range(1, len(b)), lambda i: b[i] = 'general' AND b[i + 1] = 'public'))::DOUBLE AS f0"), (DELETIONS,))
def search_phrase(spark, d):
    return _scored(body_index(spark, d).scores("General_Public", _BODY_WEIGHTS))


@query("SELECT token, count(*) AS places, count(DISTINCT id) AS docs FROM (SELECT id, unnest(b) AS token FROM ix) GROUP BY 1 HAVING count(DISTINCT id) >= 20".replace("SELECT token", _INDEX + " SELECT token", 1), (DELETIONS,))
def search_posting_counts(spark, d):
    index = body_index(spark, d)
    own = index.each().select("token", F.size(index.within("entries", [1])).alias("n")).filter("n > 0")
    return own.groupBy("token").agg(F.sum("n").alias("places"), F.count("*").alias("docs")).filter("docs >= 20")


@query("SELECT id, repo, author_year FROM deletions WHERE repo = 'src3' AND author_year BETWEEN 2012 AND 2018 AND deletion_kind = 'PARTIAL' ORDER BY doc_id LIMIT 20", (DELETIONS,))
def search_filter_only(spark, d):
    found = deletions(spark, d).filter((F.col("repo") == "src3") & F.col("author_year").between(2012, 2018) & (F.col("deletion_kind") == "PARTIAL"))
    return found.orderBy("doc_id").limit(20).select("id", "repo", "author_year")


@query("SELECT min(author_year) AS first_year, max(author_year) AS last_year, list_sort(list(DISTINCT repo)) AS repos, list_sort(list(DISTINCT reason)) AS reasons FROM deletions", (DELETIONS,))
def search_meta(spark, d):
    return deletions(spark, d).agg(F.min("author_year").alias("first_year"), F.max("author_year").alias("last_year"), F.array_sort(F.collect_set("repo")).alias("repos"), F.array_sort(F.collect_set("reason")).alias("reasons"))


@query("SELECT id, repo, reason, grade FROM deletions WHERE id = '42'", (DELETIONS,))
def search_record_detail(spark, d):
    return deletions(spark, d).filter("id = '42'").select("id", "repo", "reason", "grade")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"


@query(f"SELECT e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_DOT} DESC, e.vec_id LIMIT 10")
def search_semantic_topk(spark, d):
    own = table(spark, d, "embeddings")
    asked = own.filter("vec_id = 0").select("embedding").first()
    return vector_topk(own, "vec_id", "embedding", asked[0], 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 1 AND e.label = 3 ORDER BY {_DOT} DESC, e.vec_id LIMIT 10")
def search_semantic_filtered(spark, d):
    own = table(spark, d, "embeddings")
    asked = own.filter("vec_id = 1").select("embedding").first()
    return vector_topk(own, "vec_id", "embedding", asked[0], 10, F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))


_COARSE = "list_transform({}, lambda x: round(x::DOUBLE * 10))"
_TIED = "list_sum(list_transform(range(1, 65), lambda i: v.c[i] * q.c[i]))"


@query(f"WITH v AS (SELECT vec_id, {_COARSE.format('embedding')} AS c FROM embeddings), s AS (SELECT vec_id, {_TIED} AS score FROM v, (SELECT c FROM v WHERE vec_id = 0) q WHERE vec_id <> 0) SELECT vec_id, score FROM s WHERE score >= (SELECT min(score) FROM (SELECT score FROM s ORDER BY score DESC LIMIT 25))")
def search_topk_ties(spark, d):
    """The 25 nearest by coarse vectors and all that tie with the last, chunk by chunk."""
    own = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 10)).alias("coarse"))
    asked = own.filter("vec_id = 0").select("coarse").first()
    return merged_topk(own, "vec_id", "coarse", asked[0], 25, F.col("vec_id") != 0)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square FROM embeddings")
def search_unit_vectors(spark, d):
    unit = normalised(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(dot(unit, unit), 6).alias("square"))


@query(
    f""", s AS (SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id, e.label, {_DOT} AS score FROM embeddings e JOIN embeddings q ON q.vec_id < 10 AND e.vec_id <> q.vec_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s QUALIFY place <= 10)
    SELECT query_id, round(count(*) FILTER (ql = label) / 10, 6) AS p_at_10, round(coalesce(max(CASE WHEN ql = label THEN 1 / place END), 0), 6) AS rr FROM t GROUP BY 1""".replace(", s AS", "WITH s AS", 1)
)
def agg_p_at_k(spark, d):
    """Precision at 10 and reciprocal rank of ten queries; a hit has the query's label."""
    own = table(spark, d, "embeddings")
    asked = own.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"), F.col("embedding").alias("q"))  # ten rows
    scored = own.join(F.broadcast(asked), F.col("vec_id") != F.col("query_id")).select("query_id", "wanted", "vec_id", "label", dot(F.col("embedding"), F.col("q")).alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = scored.withColumn("place", place).filter("place <= 10")
    hit = F.col("wanted") == F.col("label")
    return best.groupBy("query_id").agg(F.round(F.count_if(hit) / 10, 6).alias("p_at_10"), F.round(F.coalesce(F.max(F.when(hit, 1 / F.col("place"))), F.lit(0.0)), 6).alias("rr"))


@query()
def search_snippet(spark, d):
    """Snippets of one page of results only."""
    shown = body_index(spark, d).page("worthless", 20, weights=_BODY_WEIGHTS)
    return shown.join(deletions(spark, d).select(F.col("doc_id").alias("doc"), "id", "body"), "doc").select("id", snippet(F.col("body"), "worthless").alias("snippet"))
