"""Yearly commits, draws with exclusions, votes by stratum, label counts by model, and labels from personal and merged files."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.ids import stable_key
from codestrata.plans.registry import query
from codestrata.sources.adapters import CASES, DELETIONS, RATERS, cases, deletions, raters
from codestrata.sources.domain import COMMITS_SQL, RATINGS_SQL, commits, ratings

#: Files that make a commit a bulk one, and positions that count for the interim.
BULK, INTERIM = 50, 50


@query(
    f"""SELECT repo, substr(author_date, 1, 4)::INT AS year, count(*) AS sampled, sum(additions + deletions)::BIGINT AS churn, count(*) FILTER (changed_files >= {BULK}) AS bulk, count(DISTINCT pr_number) AS pulls, min(pr_number) AS first_pull,
    count(*) FILTER (pr_number IS NOT NULL) AS linked FROM commits WHERE parents = 1 GROUP BY 1, 2""",
    (COMMITS_SQL,),
)
def agg_year_commits(spark, d):
    """Commits by repository and year, merges left out: churn, bulk commits, and pull requests, each once."""
    own = commits(spark, d).filter("parents = 1").withColumn("year", F.substring("author_date", 1, 4).cast("int"))
    return own.groupBy("repo", "year").agg(
        F.count("*").alias("sampled"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"), F.count_if(F.col("changed_files") >= BULK).alias("bulk"), F.count_distinct("pr_number").alias("pulls"), F.min("pr_number").alias("first_pull"), F.count("pr_number").alias("linked"),
    )


_SIZES = {"KEPT": 40, "NOISE_TRIVIAL": 10, "NOISE_FORMAT": 10, "NOISE_MOVE": 10}
_SEATS = "CASE filter_status " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in _SIZES.items()) + " END"


@query(
    f"""SELECT 'fp2-' || lpad(place::VARCHAR, 3, '0') AS sample_id, doc_id AS record_id, filter_status, size, place <= {INTERIM} AS interim FROM (
      SELECT *, row_number() OVER (ORDER BY sha256('order:' || doc_id), doc_id) AS place FROM (
        SELECT doc_id, filter_status, count(*) OVER (PARTITION BY filter_status) AS size, row_number() OVER (PARTITION BY filter_status ORDER BY sha256('draw:' || doc_id), doc_id) AS turn FROM commits WHERE doc_id % 9 <> 4) WHERE turn <= {_SEATS})""",
    (COMMITS_SQL,),
)
def top_draw(spark, d):
    """A sample of each stratum without the records of earlier rounds, in an order that tells no stratum, with numbers and the interim's part."""
    own = commits(spark, d).select("doc_id", "filter_status")
    before = own.filter("doc_id % 9 = 4").select("doc_id")
    rest = own.join(before, "doc_id", "left_anti")
    sizes = rest.groupBy("filter_status").agg(F.count("*").alias("size"))  # a row for each stratum
    turn = F.row_number().over(W.partitionBy("filter_status").orderBy(stable_key("draw", F.col("doc_id")), "doc_id"))
    most = max(_SIZES.values())
    drawn = rest.withColumn("turn", turn).filter(F.col("turn") <= most).filter(F.expr(f"turn <= {_SEATS}")).join(F.broadcast(sizes), "filter_status")
    # As many rows as the strata's sizes say, whatever the input.
    placed = drawn.withColumn("place", F.row_number().over(W.orderBy(stable_key("order", F.col("doc_id")), "doc_id")))
    return placed.select(F.concat(F.lit("fp2-"), F.lpad(F.col("place").cast("string"), 3, "0")).alias("sample_id"), F.col("doc_id").alias("record_id"), "filter_status", "size", (F.col("place") <= INTERIM).alias("interim"))


@query(
    """, v AS (SELECT doc_id, sum(label) AS yes, count(*) AS votes FROM raters GROUP BY 1), s AS (SELECT d.filter_status AS stratum, v.yes * 2 > v.votes AS yes, v.yes IN (0, v.votes) AS unanimous, d.filter_status <> 'KEPT' AS noise FROM v JOIN deletions d ON v.doc_id = d.doc_id)
    SELECT stratum, count(*) AS n, count(*) FILTER (yes) AS yes, count(*) FILTER (unanimous) AS unanimous, round(count(*) FILTER (yes) / count(*), 6) AS yes_rate, count(*) FILTER (yes AND noise) AS true_noise, count(*) FILTER (NOT yes AND noise) AS false_noise, count(*) FILTER (yes AND NOT noise) AS missed FROM s GROUP BY 1""",
    (DELETIONS, RATERS),
)
def agg_stratum_votes(spark, d):
    """Majorities by stratum against what the filter said: right, wrong and missed, unanimous votes, and the share of yes."""
    votes = raters(spark, d).groupBy("doc_id").agg(F.sum("label").alias("_yes"), F.count("*").alias("_votes"))
    met = votes.join(deletions(spark, d).select("doc_id", F.col("filter_status").alias("stratum")), "doc_id")
    yes, noise = F.col("_yes") * 2 > F.col("_votes"), F.col("stratum") != "KEPT"
    return met.groupBy("stratum").agg(
        F.count("*").alias("n"), F.count_if(yes).alias("yes"), F.count_if((F.col("_yes") == 0) | (F.col("_yes") == F.col("_votes"))).alias("unanimous"), F.round(F.count_if(yes) / F.count("*"), 6).alias("yes_rate"),
        F.count_if(yes & noise).alias("true_noise"), F.count_if(~yes & noise).alias("false_noise"), F.count_if(yes & ~noise).alias("missed"),
    )


@query("SELECT model, label, split, count(*) AS n FROM (SELECT unnest(['rule', 'vote']) AS model, unnest([guess, CASE WHEN doc_id % 2 = 0 THEN truth ELSE 'UNK' END]) AS label, split FROM cases) GROUP BY ALL", (DELETIONS, CASES))
def agg_label_counts(spark, d):
    """How often each model gives each label, by split."""
    own = cases(spark, d)
    vote = F.when(F.col("doc_id") % 2 == 0, F.col("truth")).otherwise("UNK")
    told = own.select("split", F.explode(F.array(F.struct(F.lit("rule").alias("model"), F.col("guess").alias("label")), F.struct(F.lit("vote").alias("model"), vote.alias("label")))).alias("x"))
    return told.groupBy("x.model", "x.label", "split").agg(F.count("*").alias("n"))


_FILES = """files AS (SELECT record_id, rater, reason, grade FROM ratings UNION ALL SELECT record_id, rater, reason, grade FROM ratings WHERE record_id % 31 = 0 AND rater = 'ann'),
  merged AS (SELECT record_id, 'merged' AS rater, reason, grade FROM ratings WHERE rater = 'bob' AND record_id % 2 = 0 UNION ALL SELECT DISTINCT -1 - record_id, 'merged', 'UNK', 'UNKNOWN' FROM ratings WHERE record_id % 4 = 0)"""


@query(f", {_FILES}, c AS (SELECT record_id, rater, count(*) AS n FROM files GROUP BY ALL) SELECT record_id, rater, CASE WHEN n > 1 THEN 'repeated' ELSE 'personal' END AS source FROM c UNION ALL SELECT record_id, rater, 'merged' FROM merged m WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.record_id = m.record_id)", (RATINGS_SQL,))
def lbl_mixed_input(spark, d):
    """Personal labels and, for records that have none, merged ones; a rater who labels a record twice is told."""
    own = ratings(spark, d).select("record_id", "rater", "reason", "grade")
    files = own.unionByName(own.filter("record_id % 31 = 0 AND rater = 'ann'"))
    unseen = own.filter("record_id % 4 = 0").select((-1 - F.col("record_id")).alias("record_id")).distinct().select("record_id", F.lit("merged").alias("rater"))
    merged = own.filter("rater = 'bob' AND record_id % 2 = 0").select("record_id", F.lit("merged").alias("rater")).unionByName(unseen)
    counted = files.groupBy("record_id", "rater").agg(F.count("*").alias("n"))
    personal = counted.select("record_id", "rater", F.when(F.col("n") > 1, "repeated").otherwise("personal").alias("source"))
    return personal.unionByName(merged.join(files.select("record_id").distinct(), "record_id", "left_anti").withColumn("source", F.lit("merged")))
