"""Samples, quotas, ranks and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators.ranking import hash_sample, largest_remainder, page, spread, top_share
from codestrata.plans.registry import query
from codestrata.sources.adapters import CASES, DELETIONS, cases, deletions, table


@query("SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY sha256('s1:' || id), id) AS place FROM deletions QUALIFY place <= 5", (DELETIONS,))
def top_hash_sample(spark, d):
    return hash_sample(deletions(spark, d).select("repo", "id"), ["repo"], "id", 5, "s1")


@query("SELECT filter_status, deletion_kind, id, 'fp-' || lpad(row_number() OVER (PARTITION BY filter_status, deletion_kind ORDER BY sha256('s2:' || id), id)::VARCHAR, 3, '0') AS sample_id FROM deletions QUALIFY row_number() OVER (PARTITION BY filter_status, deletion_kind ORDER BY sha256('s2:' || id), id) <= 10", (DELETIONS,))
def top_stratified_draw(spark, d):
    drawn = hash_sample(deletions(spark, d).select("filter_status", "deletion_kind", "id"), ["filter_status", "deletion_kind"], "id", 10, "s2")
    return drawn.select("filter_status", "deletion_kind", "id", F.format_string("fp-%03d", "place").alias("sample_id"))


@query(
    """, c AS (SELECT lang AS stratum, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY 1), s AS (SELECT *, (n * 97) // total AS whole, (n * 97) % total AS rest FROM c)
    SELECT stratum, n, (whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= 97 - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS seats FROM s""".replace(", c AS", "WITH c AS", 1)
)
def top_largest_remainder(spark, d):
    counts = table(spark, d, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n"))
    return largest_remainder(counts, "stratum", "n", 97)


@query("SELECT doc_id, confidence FROM cases QUALIFY row_number() OVER (ORDER BY confidence DESC, doc_id) <= ceil(count(*) OVER () * 15 / 100.0)", (DELETIONS, CASES))
def top_percent(spark, d):
    return top_share(cases(spark, d).select("doc_id", "confidence"), 15, F.desc("confidence"), F.asc("doc_id"))


@query("SELECT doc_id, ntile(3) OVER (ORDER BY doc_id) AS block, row_number() OVER (ORDER BY doc_id) AS position, row_number() OVER (ORDER BY doc_id) <= 50 AS interim FROM labels")
def top_ntile_blocks(spark, d):
    """Blocks of a labelling sample, which is small by design: one task orders it."""
    order = W.orderBy("doc_id")
    place = F.row_number().over(order)
    return table(spark, d, "labels").select("doc_id", F.ntile(3).over(order).alias("block"), place.alias("position"), (place <= 50).alias("interim"))


@query("SELECT repo, id, n_chars FROM deletions WHERE n_chars >= 50 QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 ORDER BY n_chars DESC, doc_id LIMIT 5", (DELETIONS,))
def top_headline_pick(spark, d):
    once = deletions(spark, d).filter("n_chars >= 50").withColumn("_turn", F.row_number().over(W.partitionBy("body").orderBy("doc_id"))).filter("_turn = 1")
    return once.orderBy(F.desc("n_chars"), "doc_id").limit(5).select("repo", "id", "n_chars")


@query(
    """SELECT repo, id FROM (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY repo) AS n FROM deletions)
    WHERE n <= 5 OR list_contains(list_transform([0, 1, 2, 3, 4], lambda i: round_even(i * (n - 1) / 4.0, 0)::BIGINT), place)""",
    (DELETIONS,),
)
def top_even_spread(spark, d):
    return spread(deletions(spark, d).select("repo", "id", "doc_id"), ["repo"], F.col("doc_id"), 5).select("repo", "id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def top_page(spark, d):
    return page(table(spark, d, "documents").select("doc_id", "n_chars"), 40, 20, F.desc("n_chars"), F.asc("doc_id"))


@query("SELECT least(count(*), 300) AS shown, count(*) > 300 AS more FROM documents WHERE lang = 'en'")
def search_capped_count(spark, d):
    """A count that stops at its cap: a limit ends the scan early."""
    found = table(spark, d, "documents").filter("lang = 'en'").select("doc_id").limit(301)
    return found.agg(F.least(F.count("*"), F.lit(300)).alias("shown"), (F.count("*") > 300).alias("more"))


@query("SELECT doc_id, confidence, quality = 1 AS selected FROM cases ORDER BY selected DESC, CASE WHEN quality = 1 THEN -confidence END, repo, doc_id LIMIT 50", (DELETIONS, CASES))
def top_candidate_sort(spark, d):
    chosen = F.col("quality") == 1
    return cases(spark, d).orderBy(F.desc(chosen), F.when(chosen, -F.col("confidence")), "repo", "doc_id").limit(50).select("doc_id", "confidence", chosen.alias("selected"))


@query("SELECT doc_id, CASE WHEN instr('13579bdf', sha256(id)[2:2]) > 0 THEN 'b' ELSE 'a' END AS first_shown FROM deletions", (DELETIONS,))
def top_display_order(spark, d):
    """Two labels are shown in reverse where the first byte of the id's hash is odd."""
    odd = F.instr(F.lit("13579bdf"), F.substring(F.sha2("id", 256), 2, 1)) > 0
    return deletions(spark, d).select("doc_id", F.when(odd, "b").otherwise("a").alias("first_shown"))
