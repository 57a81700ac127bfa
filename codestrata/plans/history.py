"""Commit log, selection, replacement and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators.history import candidate_score, commit_pairs, exclusion, parse_log, scale_score, size_bounded_shards
from codestrata.operators.joins import with_next
from codestrata.operators.mining import token_similarity
from codestrata.operators.search import hashed_embeddings, normalised
from codestrata.plans.registry import query
from codestrata.sources.adapters import DELETIONS, deletions, table
from codestrata.sources.files import work_folder


def _logs(spark, d):
    """A raw log for each customer: one entry for each order, the parent being the order's key less one; some are merges."""
    o = table(spark, d, "orders")
    parents = F.when(F.col("o_orderkey") % 7 == 0, F.concat_ws(" ", (F.col("o_orderkey") - 1).cast("string"), F.lit("m"))).otherwise((F.col("o_orderkey") - 1).cast("string"))
    entry = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), parents, (F.col("o_orderkey") * 60).cast("string"), F.lit("me"), F.concat(F.lit("fix #"), F.col("o_custkey").cast("string"), F.lit("\x1fmore\n")))
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"]), "\x00").alias("raw"))


@query("SELECT o_custkey, o_orderkey::VARCHAR AS sha, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS parents, o_orderkey * 60 AS time, 'fix #' || o_custkey || chr(31) || 'more' || chr(10) AS message FROM orders")
def src_parse_log(spark, d):
    found = _logs(spark, d).select("o_custkey", F.explode(parse_log(F.col("raw"))).alias("x"))
    return found.select("o_custkey", "x.sha", F.size("x.parents").alias("parents"), "x.time", "x.message")


@query("SELECT o_orderkey::VARCHAR AS sha, (o_orderkey - 1)::VARCHAR AS parent FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey * 60 >= 3000")
def src_commit_pairs(spark, d):
    entries = _logs(spark, d).select(F.explode(parse_log(F.col("raw"))).alias("x")).select("x.*").filter("time >= 3000")
    return commit_pairs(entries).select("sha", "parent")


_SEL = "s AS (SELECT c_custkey AS repo, c_acctbal, c_mktsegment, (c_acctbal + 1000) / 11000 AS a, c_custkey % 10 / 10.0::DOUBLE AS b, greatest(c_custkey * 40, 1) AS n FROM customer)"


@query("SELECT repo, round(0.5 * a + 0.3 * b + 0.2 * least(1.0, log10(n) / log10(50000)), 4) AS score, CASE WHEN c_acctbal < 0 THEN 'ARCHIVED' WHEN c_mktsegment = 'MACHINERY' THEN 'LANGUAGE' WHEN n < 1000 THEN 'COMMITS' END AS excluded, CASE WHEN n >= 20000 THEN 'XL' WHEN n >= 5000 THEN 'L' END AS scale FROM s", (_SEL,))
def sel_candidates(spark, d):
    c = table(spark, d, "customer")
    n = F.greatest(F.col("c_custkey") * 40, F.lit(1))
    score = candidate_score((F.col("c_acctbal") + 1000) / 11000, F.col("c_custkey") % 10 / 10, scale_score(n))
    out = exclusion([("ARCHIVED", F.col("c_acctbal") < 0), ("LANGUAGE", F.col("c_mktsegment") == "MACHINERY"), ("COMMITS", n < 1000)])
    return c.select(F.col("c_custkey").alias("repo"), score.alias("score"), out.alias("excluded"), F.when(n >= 20000, "XL").when(n >= 5000, "L").alias("scale"))


@query("SELECT host AS repo, count(*) AS n FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) GROUP BY 1 ORDER BY n DESC, repo LIMIT 10")
def sel_top_sources(spark, d):
    own = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo"))
    return own.groupBy("repo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo").limit(10)


@query("SELECT doc_id, coalesce(try_cast(substring(d, 1, 4) AS INTEGER), -1) AS vector_year, coalesce(try_cast(substring(d, 1, 4) AS INTEGER)::VARCHAR, 'unknown') AS stats_year FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE author_year || '-01-02' END AS d FROM deletions)", (DELETIONS,))
def dat_years(spark, d):
    """The year of an ISO date by the two conventions for an absent one."""
    date = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.col("author_year").cast("string"), F.lit("-01-02")))
    year = F.expr("try_cast(substring(d, 1, 4) AS INT)")
    return deletions(spark, d).select("doc_id", date.alias("d")).select("doc_id", F.coalesce(year, F.lit(-1)).alias("vector_year"), F.coalesce(year.cast("string"), F.lit("unknown")).alias("stats_year"))


@query("SELECT page_id, lower(regexp_extract(url, '^(https?)', 1)) AS scheme, regexp_replace(url, '[?#].*$', '') AS bare FROM pages")
def str_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^(https?)", 1)).alias("scheme"), F.regexp_replace("url", "[?#].*$", "").alias("bare"))


_SHARD = 1_000_000


@query(
    f"""WITH RECURSIVE sized AS (SELECT source AS repo, doc_id, strlen(coalesce(text, '')) + 100 AS n_bytes FROM documents), cums AS (SELECT *, sum(n_bytes) OVER (PARTITION BY repo ORDER BY doc_id) AS c FROM sized),
    cuts AS (SELECT repo, 0 AS shard, 0::HUGEINT AS base, max(c) AS total FROM cums GROUP BY repo UNION ALL SELECT r.repo, r.shard + 1, (SELECT max(c) FROM cums x WHERE x.repo = r.repo AND x.c <= r.base + {_SHARD}), r.total FROM cuts r WHERE (SELECT max(c) FROM cums x WHERE x.repo = r.repo AND x.c <= r.base + {_SHARD}) < r.total)
    SELECT c.repo, c.doc_id, c.n_bytes, max(t.shard)::INT AS shard FROM cums c JOIN cuts t ON c.repo = t.repo AND t.base < c.c GROUP BY ALL"""
)
def export_size_shards(spark, d):
    """Records cut into shards of a megabyte by repository, in order of their numbers; a record has a hundred bytes besides its text."""
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 100).cast("long")
    work_folder(spark)
    own = table(spark, d, "documents").select(F.col("source").alias("repo"), "doc_id", size.alias("n_bytes")).checkpoint()
    return size_bounded_shards(own, "repo", "doc_id", F.col("n_bytes"), _SHARD)


@query()
def rpl_token_similarity(spark, d):
    """Each document against the next one: likeness of their words in order."""
    both = with_next(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", "added").filter("added IS NOT NULL")
    return both.select("doc_id", F.round(token_similarity(F.col("text"), F.col("added")), 6).alias("similarity"))


@query()
def search_embed(spark, d):
    own = hashed_embeddings(deletions(spark, d).select("id", F.concat_ws("\n", "repo", "body").alias("text")), "id", "text", 64)
    return own.select("id", normalised(F.col("vector")).alias("vector"))
