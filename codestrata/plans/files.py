"""Record files with what they must satisfy, reports, judges' files, prompts and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import exporting as X
from codestrata.operators.search import dot
from codestrata.plans.registry import query
from codestrata.sources.adapters import CASES, DELETIONS, REASONS, cases, deletions, table
from codestrata.sources.domain import COMMITS_SQL, RATINGS_SQL, commits, ratings
from codestrata.sources.files import read_csv, read_jsonl, work_folder


def _csv(df, schema, **options):
    def write(rows, folder):
        rows.coalesce(1).write.option("header", True).option("encoding", "UTF-8").csv(folder)

    return X.round_trip(df, write, lambda s, f: read_csv(s, f, schema, **options))


@query("SELECT c_custkey AS repo, c_name AS path FROM customer")
def src_jobs(spark, d):
    """Jobs of a CSV with its columns checked; a repository is there once."""
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_name").alias("path"))
    return _csv(own, "repo long, path string", required=("repo", "path"), unique="repo")


@query("SELECT n_nationkey AS rule_order, n_name AS repo, coalesce(NULLIF(lower(n_name)[1:n_nationkey % 4], ''), '') AS prefix FROM nation")
def src_overrides(spark, d):
    """Rules of a CSV in their order; an empty prefix stays an empty text."""
    own = table(spark, d, "nation").select(F.col("n_nationkey").alias("rule_order"), F.col("n_name").alias("repo"), F.substring(F.lower("n_name"), F.lit(1), F.col("n_nationkey") % 4).alias("prefix"))
    back = _csv(own, "rule_order int, repo string, prefix string", required=("rule_order", "repo"), unique="rule_order")
    return back.select("rule_order", "repo", F.coalesce("prefix", F.lit("")).alias("prefix"))


@query("SELECT record_id, reason, grade FROM ratings WHERE rater = 'ann' AND reason <> 'ODD'", (RATINGS_SQL,))
def src_human(spark, d):
    """Settled labels of people; a row without one is an error."""
    own = ratings(spark, d).filter("rater = 'ann' AND reason <> 'ODD'").select("record_id", "reason", "grade")
    kept = own.withColumn("reason", F.when(F.col("reason").isNull(), F.raise_error(F.lit("an unsettled label"))).otherwise(F.col("reason")))
    return X.unique(kept, "record_id", "a label")


@query("SELECT doc_id, pr_title FROM commits WHERE pr_number IS NOT NULL", (COMMITS_SQL,))
def src_contexts(spark, d):
    """Contexts of several folders of JSON lines; an id is in one of them only."""
    own = commits(spark, d).filter("pr_number IS NOT NULL").select("doc_id", "pr_title")
    folder = f"{work_folder(spark)}/contexts-{uuid.uuid4().hex}"
    for i in range(2):
        own.filter(F.col("doc_id") % 2 == i).write.json(f"{folder}/part={i}")
    return X.unique(read_jsonl(spark, f"{folder}/part=*", own.schema, strict=True, glob="*.json"), "doc_id", "a context")


@query("SELECT doc_id, repo FROM commits WHERE repo IS NOT NULL", (COMMITS_SQL,))
def src_shards(spark, d):
    """Shards are found by their names; a copy of the first rows beside them is none."""
    own = commits(spark, d).filter("repo IS NOT NULL").select("doc_id", "repo")
    folder = f"{work_folder(spark)}/shards-{uuid.uuid4().hex}"
    named = own.withColumn("shard", F.concat(F.lit("s-"), (F.col("doc_id") % 3).cast("string"), F.lit("-of-3")))
    named.write.partitionBy("shard").option("compression", "gzip").json(folder)
    own.limit(50).write.option("compression", "gzip").json(f"{folder}/shard=sample")
    return spark.read.schema(own.schema).option("lineSep", "\n").json(f"{folder}/shard=*-of-*")


_RUNS = "SELECT user_id AS repo, arg_max(event_type, (ts, event_id)) AS last, count(*) AS records FROM events GROUP BY 1"


@query(f"SELECT repo, CASE WHEN last = 'signup' THEN 'running' WHEN repo % 7 = 0 THEN 'no rows' ELSE 'ok' END AS problem FROM ({_RUNS}) UNION ALL SELECT DISTINCT 900000 + user_id, 'orphan' FROM events WHERE user_id % 13 = 0")
def src_run_records(spark, d):
    """Runs of several folders and their files: those still running, without a file, and files without a run."""
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("repo")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    listed = last.filter("repo % 7 <> 0").select("repo").union(last.filter("repo % 13 = 0").select(F.col("repo") + 900_000)).withColumn("file", F.lit(True))
    both = last.join(listed, "repo", "full_outer")
    return both.select("repo", F.when(F.col("last").isNull(), "orphan").when(F.col("last") == "signup", "running").when(F.col("file").isNull(), "no rows").otherwise("ok").alias("problem"))


@query("SELECT s_suppkey AS repo, s_acctbal AS stars FROM supplier ORDER BY stars DESC, repo LIMIT 25")
def src_search_snapshot(spark, d):
    """The most starred repositories of a search's snapshot."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("repo"), F.col("s_acctbal").alias("stars")).orderBy(F.desc("stars"), "repo").limit(25)


@query("SELECT count(*) AS rows, sum(n_chars)::BIGINT AS chars, count(DISTINCT repo) AS repos FROM deletions", (DELETIONS,))
def snk_report(spark, d):
    """A report of one row, written to a new place and read back."""
    one = deletions(spark, d).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"), F.count_distinct("repo").alias("repos"))
    return X.round_trip(one, lambda df, f: df.coalesce(1).write.json(f), lambda s, f: s.read.schema(one.schema).json(f))


@query("SELECT c_custkey AS repo, c_name AS name, round(c_acctbal, 2) AS score FROM customer WHERE c_acctbal > 5000")
def snk_candidates(spark, d):
    """Candidates as one CSV with a header."""
    own = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("repo"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("score"))
    return _csv(own, "repo long, name string, score double", required=("repo",), unique="repo")


@query("SELECT rater, problem, count(*) AS n FROM (SELECT rater, CASE WHEN record_id % 21 = 0 THEN 'unknown sample' WHEN record_id % 10 = 0 THEN 'other record' WHEN reason = 'ODD' THEN 'no verdict' END AS problem FROM ratings) WHERE problem IS NOT NULL GROUP BY ALL", (RATINGS_SQL,))
def int_judgments(spark, d):
    """A judge's file against the samples: known samples, their records, and a verdict for each."""
    own = ratings(spark, d)
    samples = own.filter("record_id % 21 <> 0").select("record_id", F.when(F.col("record_id") % 10 == 0, F.col("record_id") + 1).otherwise(F.col("record_id")).alias("of")).distinct()
    met = own.join(samples, "record_id", "left")
    problem = F.when(F.col("of").isNull(), "unknown sample").when(F.col("of") != F.col("record_id"), "other record").when(F.col("reason") == "ODD", "no verdict")
    return met.withColumn("problem", problem).filter("problem IS NOT NULL").groupBy("rater", "problem").agg(F.count("*").alias("n"))


@query(", p AS (SELECT a.record_id, ntile(3) OVER (ORDER BY a.record_id) AS block, a.reason <> b.reason OR a.grade <> b.grade AS differs FROM ratings a JOIN ratings b ON a.record_id = b.record_id AND a.rater = 'ann' AND b.rater = 'bob') SELECT block, count(*) FILTER (differs) AS targets, count(*) AS n FROM p GROUP BY 1", (RATINGS_SQL,))
def int_targets(spark, d):
    """Records that a third rater must settle, by block of the assignment."""
    both = ratings(spark, d).groupBy("record_id").agg(F.count_distinct("reason", "grade").alias("k"), F.count("*").alias("n")).filter("n = 2")
    placed = both.withColumn("block", F.ntile(3).over(W.orderBy("record_id")))  # a labelling sample, small by design
    return placed.groupBy("block").agg(F.count_if(F.col("k") > 1).alias("targets"), F.count("*").alias("n"))


@query("SELECT record_id, rater, CASE WHEN record_id % 6 = 0 AND rater = 'bob' THEN NULL ELSE reason END AS reason, record_id % 6 = 0 AND rater = 'bob' AS cleared FROM ratings", (RATINGS_SQL,))
def int_rejudge(spark, d):
    """Labels of one rater's targets are blanked, all others stay as they were."""
    target = (F.col("record_id") % 6 == 0) & (F.col("rater") == "bob")
    return ratings(spark, d).select("record_id", "rater", F.when(~target, F.col("reason")).alias("reason"), target.alias("cleared"))


@query(f"SELECT doc_id, k AS label, CASE WHEN k = guess THEN 0.65 ELSE 0.05 END::DOUBLE AS p FROM cases, (SELECT unnest({REASONS}) AS k) WHERE split = 'test'", (DELETIONS, CASES))
def cls_probabilities(spark, d):
    """Probabilities by class, all classes present."""
    keys = F.array(*[F.lit(k) for k in REASONS])
    p = F.transform(keys, lambda k: F.when(k == F.col("guess"), 0.65).otherwise(0.05))
    return cases(spark, d).filter("split = 'test'").select("doc_id", F.explode(F.map_from_arrays(keys, p)).alias("label", "p"))


_BUDGET = 120
_RUN = "list_filter(list_transform(range(1, len(l) + 1), lambda i: {'t': l[i], 'n': list_sum(list_transform(l[1:i], lambda x: length(x) + 1))}), lambda x: x.n <= 120)"


@query(f", s AS (SELECT doc_id, string_split(message, ' ') AS l FROM commits) SELECT doc_id, 'Context:' || chr(10) || array_to_string(list_transform({_RUN}, lambda x: x.t), ' ') AS prompt FROM s", (COMMITS_SQL,))
def cls_prompt(spark, d):
    """A prompt that takes pieces of its context in order as long as their running length keeps a budget."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("l"))
    taken = F.aggregate(F.split("message", " "), start, lambda a, x: F.struct((a["n"] + F.char_length(x) + 1).alias("n"), F.when(a["n"] + F.char_length(x) + 1 <= _BUDGET, F.concat(a["l"], F.array(x))).otherwise(a["l"]).alias("l")), lambda a: a["l"])
    return commits(spark, d).select("doc_id", F.concat(F.lit("Context:\n"), F.array_join(taken, " ")).alias("prompt"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"


@query(f"SELECT count(*) AS total, max(score) AS best FROM (SELECT round({_DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 2 AND e.label IN (1, 2))")
def search_vector_total(spark, d):
    """How many rows a vector search with a filter ranks, and its best score; an unknown value matches no row."""
    own = table(spark, d, "embeddings")
    asked = own.filter("vec_id = 2").select("embedding").first()
    wanted = F.array(*[F.lit(float(v)) for v in asked[0]])
    return own.filter(F.col("label").isin(1, 2)).select(F.round(dot(F.col("embedding"), wanted), 6).alias("score")).agg(F.count("*").alias("total"), F.max("score").alias("best"))


@query(
    f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS score FROM embeddings e JOIN embeddings q ON q.vec_id < 8 AND e.vec_id <> q.vec_id), t AS (SELECT query_id, score FROM s WHERE vec_id = query_id + 100), r AS (SELECT t.query_id, count(*) FILTER (s.score > t.score OR s.score = t.score AND s.vec_id < t.query_id + 100) + 1 AS rank FROM t JOIN s ON t.query_id = s.query_id GROUP BY 1)"
    " SELECT count(*) AS n, avg(1 / rank) AS mrr, avg((rank = 1)::INT) AS top1, avg((rank <= 5)::INT) AS top5, max(rank) AS worst FROM r"
)
def search_target_rank(spark, d):
    """Where known targets stand among all rows, counted and not sorted."""
    own = table(spark, d, "embeddings")
    asked = own.filter("vec_id < 8").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))  # eight rows
    targets = own.filter("vec_id BETWEEN 100 AND 107").select((F.col("vec_id") - 100).alias("query_id"), F.col("vec_id").alias("target"), F.col("embedding").alias("t"))
    both = asked.join(targets, "query_id").withColumn("aim", dot(F.col("t"), F.col("q"))).select("query_id", "q", "target", "aim")
    score = dot(F.col("embedding"), F.col("q"))
    ahead = own.join(F.broadcast(both), F.col("vec_id") != F.col("query_id")).select("query_id", ((score > F.col("aim")) | (score == F.col("aim")) & (F.col("vec_id") < F.col("target"))).alias("before"))
    rank = ahead.groupBy("query_id").agg((F.count_if("before") + 1).alias("rank"))
    share = lambda c: F.avg(c.cast("int"))
    return rank.agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), share(F.col("rank") == 1).alias("top1"), share(F.col("rank") <= 5).alias("top5"), F.max("rank").alias("worst"))
