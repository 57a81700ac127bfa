"""Quotas, splits and batches of samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators.ranking import balanced_splits, hash_sample, quota_sample, ranked, run_batches, water_filled
from codestrata.plans.registry import query
from codestrata.sources.adapters import CASES, DELETIONS, cases, deletions
from codestrata.sources.domain import COMMITS_SQL, commits

_HASH = "sha256('{}:' || id)"
_SIZES = "k AS (SELECT repo, count(*) AS n FROM deletions WHERE filter_status = 'KEPT' AND deletion_kind = 'FULL_FUNCTION' GROUP BY 1)"
#: Seats of sources dealt one at a time to the least served one that has rows left: the plain rule of equal shares.
_EQUAL = "q AS (SELECT repo, n, unnest(range(n)) AS turn FROM k), seats AS (SELECT repo, n, count(*) FILTER (place <= {0}) AS seats FROM (SELECT *, row_number() OVER (ORDER BY turn, repo) AS place FROM q) GROUP BY ALL)"


def _eligible(spark, d):
    return deletions(spark, d).filter("filter_status = 'KEPT' AND deletion_kind = 'FULL_FUNCTION'")


@query(f", {_SIZES}, {_EQUAL.format(120)} SELECT repo, n, seats FROM seats", (DELETIONS,))
def top_equal_quota(spark, d):
    """Equal seats of 120 for each repository, none above its rows; what small ones leave goes to the others."""
    return water_filled(_eligible(spark, d).groupBy("repo").agg(F.count("*").alias("n")), "repo", "n", 120)


@query(f", {_SIZES}, {_EQUAL.format(120)}, r AS (SELECT d.repo, d.id, row_number() OVER (PARTITION BY d.repo ORDER BY {_HASH.format('eq')}, d.id) AS place FROM deletions d WHERE filter_status = 'KEPT' AND deletion_kind = 'FULL_FUNCTION') SELECT r.repo, r.id, r.place FROM r JOIN seats s ON r.repo = s.repo WHERE place <= seats", (DELETIONS,))
def top_equal_sample(spark, d):
    own = _eligible(spark, d).select("repo", "id")
    return quota_sample(own, top_equal_quota(spark, d), "repo", "id", "eq")


_SHARES = f"""{_SIZES}, p AS (SELECT *, greatest(1, (n * 90) // sum(n) OVER ()) AS base FROM k), c AS (SELECT *, least(n, base) AS seats0, 90 - sum(least(n, base)) OVER () AS rest, row_number() OVER (ORDER BY n DESC, repo) AS turn FROM p),
  seats AS (SELECT repo, n, (seats0 + CASE WHEN turn <= rest AND seats0 < n THEN 1 ELSE 0 END)::BIGINT AS seats FROM c)"""


@query(f", {_SHARES} SELECT repo, n, seats FROM seats", (DELETIONS,))
def top_proportional_quota(spark, d):
    """Seats in proportion to rows, one at least, the rest to the largest repositories."""
    counts = _eligible(spark, d).groupBy("repo").agg(F.count("*").alias("n"))  # a row for each repository
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = counts.withColumn("_total", F.sum("n").over(every)).withColumn("_seats", F.least("n", F.greatest(F.lit(1), F.expr("n * 90 div _total"))))
    left, turn = F.lit(90) - F.sum("_seats").over(every), F.row_number().over(W.orderBy(F.desc("n"), "repo"))
    return base.select("repo", "n", (F.col("_seats") + F.when((turn <= left) & (F.col("_seats") < F.col("n")), 1).otherwise(0)).alias("seats"))


@query(f", {_SHARES}, r AS (SELECT d.repo, d.id, row_number() OVER (PARTITION BY d.repo ORDER BY {_HASH.format('st')}, d.id) AS place FROM deletions d WHERE filter_status = 'KEPT' AND deletion_kind = 'FULL_FUNCTION') SELECT r.repo, r.id, row_number() OVER (ORDER BY {_HASH.format('shuffle').replace('id', 'r.id')}, r.id) AS place FROM r JOIN seats s ON r.repo = s.repo WHERE place <= seats", (DELETIONS,))
def top_stratified_sample(spark, d):
    """A sample by proportional quotas, put in an order that tells nothing of repositories."""
    drawn = quota_sample(_eligible(spark, d).select("repo", "id"), top_proportional_quota(spark, d), "repo", "id", "st").drop("place")
    return ranked(drawn, F.sha2(F.concat(F.lit("shuffle:"), "id"), 256), F.col("id")).select("repo", "id", (F.col("place") + 1).alias("place"))


_CYCLE = "['test', 'train', 'val', 'train', 'train']"


@query(
    f""", g0 AS (SELECT repo, deletion_kind, count(*) AS n FROM deletions GROUP BY ALL), g AS (SELECT repo, deletion_kind, sum(n) OVER (ORDER BY repo, deletion_kind) - n AS first FROM g0),
    r AS (SELECT d.repo, d.deletion_kind, d.id, row_number() OVER (PARTITION BY d.repo, d.deletion_kind ORDER BY {_HASH.format('sp')}, d.id) - 1 AS place FROM deletions d)
    SELECT r.id, {_CYCLE}[((first + place) % 5 + 1)::INT] AS split FROM r JOIN g ON r.repo = g.repo AND r.deletion_kind = g.deletion_kind""",
    (DELETIONS,),
)
def top_balanced_splits(spark, d):
    """Test, validation and training rows in fixed shares within each repository and kind."""
    own = deletions(spark, d).select("repo", "deletion_kind", "id")
    return balanced_splits(own, ["repo", "deletion_kind"], "id", "sp", (("test", 1), ("val", 1), ("train", 3))).select("id", "split")


@query(", t AS (SELECT repo, file_path, count(*) AS n, min((repo, file_path)) AS pos FROM commits GROUP BY ALL), u AS (SELECT repo, file_path, (sum(n) OVER (ORDER BY pos) - n) // 25 AS batch FROM t) SELECT c.doc_id, u.batch::BIGINT AS batch FROM commits c JOIN u ON c.repo = u.repo AND c.file_path = u.file_path", (COMMITS_SQL,))
def top_run_batches(spark, d):
    """Batches of about 25 rows that never part the rows of a repository's file."""
    return run_batches(commits(spark, d).filter("repo IS NOT NULL"), ["repo", "file_path"], ["repo", "file_path"], 25).select("doc_id", "batch")


@query("SELECT repo, id, truth, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY n_chars, doc_id) AS place FROM (SELECT * FROM cases WHERE split = 'train' AND grade = 'EXPLICIT' QUALIFY row_number() OVER (PARTITION BY repo, truth ORDER BY n_chars, doc_id) = 1)) WHERE place <= 2", (DELETIONS, CASES))
def top_few_shots(spark, d):
    """Two examples of each reason, the shortest first, of different repositories."""
    own = cases(spark, d).filter("split = 'train' AND grade = 'EXPLICIT'")
    once = own.withColumn("_t", F.row_number().over(W.partitionBy("repo", "truth").orderBy("n_chars", "doc_id"))).filter("_t = 1")
    return once.withColumn("_p", F.row_number().over(W.partitionBy("truth").orderBy("n_chars", "doc_id"))).filter("_p <= 2").select("repo", "id", "truth", "n_chars")


@query(f"SELECT repo, id FROM deletions WHERE n_chars > 0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY {_HASH.format('bench')}, id) <= 7", (DELETIONS,))
def top_bench_sample(spark, d):
    """The same rows of each repository for any partitioning: a hash stands for a reservoir's dice."""
    return hash_sample(deletions(spark, d).filter("n_chars > 0").select("repo", "id"), ["repo"], "id", 7, "bench").select("repo", "id")


@query("SELECT repo, n, rate FROM (SELECT repo, count(*) AS n, avg((truth = guess)::INT) AS rate FROM cases GROUP BY 1 HAVING count(*) >= 15) ORDER BY rate DESC, n DESC, repo LIMIT 5", (DELETIONS, CASES))
def top_headlines(spark, d):
    """The best five groups with enough cases."""
    by = cases(spark, d).groupBy("repo").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("guess")).cast("int")).alias("rate")).filter("n >= 15")
    return by.orderBy(F.desc("rate"), F.desc("n"), "repo").limit(5)


@query(", m AS (SELECT *, CASE WHEN truth IN ('SEC', 'BUG') THEN 'SB' ELSE truth END AS tb, CASE WHEN guess IN ('SEC', 'BUG') THEN 'SB' ELSE guess END AS gb FROM cases) SELECT count(*) AS n, count(*) FILTER (tb = gb) AS hits, count(*) FILTER (tb = 'UNK') AS floor, round(100.0 * (count(*) FILTER (tb = gb) - count(*) FILTER (tb = 'UNK')) / count(*), 4) AS delta_pp FROM m", (DELETIONS, CASES))
def agg_configuration_row(spark, d):
    """One grouping's hits against answering unknown to all, in points of a hundred."""
    block = lambda c: F.when(F.col(c).isin("SEC", "BUG"), "SB").otherwise(F.col(c))
    one = cases(spark, d).select(block("truth").alias("t"), block("guess").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("t") == F.col("g")).alias("hits"), F.count_if(F.col("t") == "UNK").alias("floor"))
    return one.withColumn("delta_pp", F.round(100.0 * (F.col("hits") - F.col("floor")) / F.col("n"), 4))


_RULES = ("guess", "CASE WHEN guess = 'UNK' THEN reason2 ELSE guess END", "CASE WHEN confidence >= 0.5 THEN guess ELSE reason2 END", "CASE WHEN guess = reason2 THEN guess ELSE 'UNK' END")


@query("SELECT rule, count(*) FILTER (label = truth) AS strict, count(*) FILTER (label = truth OR label = 'UNK') AS lenient FROM (" + " UNION ALL ".join(f"SELECT {i} AS rule, truth, {r} AS label FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN truth ELSE 'DEAD' END AS reason2 FROM cases)" for i, r in enumerate(_RULES)) + ") GROUP BY 1", (DELETIONS, CASES))
def agg_blend_rules(spark, d):
    """Ways to blend two labels of a record, each scored over all records in one pass."""
    own = cases(spark, d).withColumn("reason2", F.when(F.col("doc_id") % 3 == 0, F.col("truth")).otherwise("DEAD"))
    told = own.select("truth", F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.expr(r).alias("label")) for i, r in enumerate(_RULES)])).alias("x"))
    return told.groupBy("x.rule").agg(F.count_if(F.col("x.label") == F.col("truth")).alias("strict"), F.count_if((F.col("x.label") == F.col("truth")) | (F.col("x.label") == "UNK")).alias("lenient"))


@query("SELECT coalesce(event_type, 'all') AS kind, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS most, arg_min(value, event_id) AS first_call FROM events GROUP BY GROUPING SETS ((event_type), ())")
def agg_latency_summary(spark, d):
    """Latencies by type and over all, with that of the first call."""
    from codestrata.sources.adapters import table

    own = table(spark, d, "events").select("event_id", "event_type", "value")
    by = own.rollup("event_type").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"), F.max("value").alias("most"), F.min_by("value", "event_id").alias("first_call"))
    return by.select(F.coalesce("event_type", F.lit("all")).alias("kind"), "n", "p50", "p95", "most", "first_call")


@query("SELECT count(*) AS n, avg((a = b)::INT) AS agreement, CASE WHEN e >= 1 THEN 1.0 ELSE (avg((a = b)::INT) - e) / (1 - e) END AS kappa FROM (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels), (SELECT avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS e FROM labels) GROUP BY e")
def agg_judges(spark, d):
    """Two judges' agreement; kappa is 1 where chance alone agrees always."""
    from codestrata.sources.adapters import table

    a, b = F.col("quality") == 1, F.col("toxic") == 1
    share = lambda c: F.avg(c.cast("int"))
    one = table(spark, d, "labels").agg(F.count("*").alias("n"), share(a == b).alias("agreement"), (share(a) * share(b) + (1 - share(a)) * (1 - share(b))).alias("e"))
    return one.select("n", "agreement", F.when(F.col("e") >= 1, 1.0).otherwise((F.col("agreement") - F.col("e")) / (1 - F.col("e"))).alias("kappa"))
