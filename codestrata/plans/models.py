"""Identifiers, coarser labels and the text classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions.ids import uuid5
from codestrata.operators.classify import train_text_classifier
from codestrata.operators.partitions import partition_accuracy
from codestrata.plans.registry import query
from codestrata.sources.adapters import CASES, DELETIONS, REASONS, cases, deletions

_SPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@query(
    f"""SELECT id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:20], h[21:32]) AS record_id
    FROM (SELECT id, sha1(unhex('{_SPACE.replace("-", "")}') || encode(repo || ':' || id)) AS h FROM deletions)""",
    (DELETIONS,),
)
def id_records(spark, d):
    return deletions(spark, d).select("id", uuid5(_SPACE, F.concat_ws(":", "repo", "id")).alias("record_id"))


@query(
    """SELECT 7 AS labels, count(*) AS n, count(*) FILTER (truth = guess) AS strict_hits, count(*) FILTER (truth = guess OR truth IN ('SEC', 'LIB') AND guess IN ('SEC', 'LIB')) AS merged_hits FROM cases""",
    (DELETIONS, CASES),
)
def lbl_merged_accuracy(spark, d):
    same, merged = F.col("truth") == F.col("guess"), F.col("truth").isin("SEC", "LIB") & F.col("guess").isin("SEC", "LIB")
    return cases(spark, d).agg(F.lit(7).alias("labels"), F.count("*").alias("n"), F.count_if(same).alias("strict_hits"), F.count_if(same | merged).alias("merged_hits"))


_CODES = """codes AS (WITH RECURSIVE r AS (SELECT 1 AS i, [0] AS c, 0 AS m UNION ALL SELECT i + 1, list_append(c, b), greatest(m, b) FROM r, (SELECT unnest(range(4))::INT AS b) WHERE i < 7 AND b <= m + 1) SELECT c, m + 1 AS blocks FROM r WHERE i = 7 AND m + 1 IN (3, 4))"""
_NAMES = "['SEC', 'LIB', 'DEAD', 'FEAT', 'BUG', 'PERF', 'DESIGN']"


@query(
    f""", {_CODES}, named AS (SELECT c, blocks, array_to_string(list_transform(range(blocks), lambda b: array_to_string(list_filter({_NAMES}, lambda x, i: c[i] = b), '+')), '|') AS partition FROM codes),
    p AS (SELECT truth, guess, list_position({_NAMES}, truth) AS t, list_position({_NAMES}, guess) AS g, count(*) AS n FROM cases GROUP BY ALL)
    SELECT blocks::INT AS blocks, partition, sum(n)::BIGINT AS n, sum(CASE WHEN truth = guess OR c[t] = c[g] THEN n ELSE 0 END)::BIGINT AS hits FROM named, p GROUP BY ALL ORDER BY hits DESC, blocks DESC, partition LIMIT 1""",
    (DELETIONS, CASES),
)
def lbl_best_partition(spark, d):
    """The best of the 651 ways to merge seven reasons into three or four blocks; ties to more blocks, then by name."""
    scored = partition_accuracy(cases(spark, d), REASONS[:-1], (3, 4), "truth", "guess")
    return scored.orderBy(F.desc("hits"), F.desc("blocks"), "partition").limit(1)


@query()
def cls_tfidf_lr(spark, d):
    """A classifier of languages by TF-IDF and logistic regression, trained on one split and told for the rest."""
    own = cases(spark, d).select("doc_id", "split", F.col("body").alias("text"), F.col("lang"))
    model = train_text_classifier(own.filter("split = 'train'"), "text", "lang", 1 << 12)
    told = model.transform(own.filter("split <> 'train'"))
    return told.select("doc_id", (F.col("prediction") == F.col("_label")).alias("right"))
