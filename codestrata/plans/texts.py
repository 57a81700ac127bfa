"""Text rules, references, sentences, keyword classification, label handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions.text import issue_numbers, sentences
from codestrata.operators.classify import decide, grade, weaker_grade
from codestrata.operators.rules import REASON_RULES, reason_keywords, reason_of
from codestrata.plans.registry import query
from codestrata.sources.adapters import CASES, DELETIONS, GRADES, RATERS, REASONS, cases, deletions, raters, table

_LABEL_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){'|'.join(p)}') THEN '{k}'" for k, p in REASON_RULES.items()) + " ELSE 'UNK' END"


@query(f"SELECT conv_id, turn, {_LABEL_SQL} AS label FROM conversations")
def cls_keyword(spark, d):
    """The baseline over prose: the first label with a rule that a text meets."""
    return table(spark, d, "conversations").select("conv_id", "turn", reason_of(F.col("text")).alias("label"))


@query(
    "SELECT conv_id, turn, " + ", ".join(f"list_filter([{', '.join(f"regexp_extract(text, '(?i){p}')" for p in ps)}], lambda x: x <> '') AS {k.lower()}" for k, ps in REASON_RULES.items()) + " FROM conversations"
)
def cls_keyword_evidence(spark, d):
    """The first match of each rule, by label."""
    return table(spark, d, "conversations").select("conv_id", "turn", *[reason_keywords(F.col("text"), F.lit(k)).alias(k.lower()) for k in REASON_RULES])


@query(
    """SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g'), '(?s)```.*?```', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(regexp_replace(x, '^[\\s>*#-]+', ''))), lambda x: length(x) >= 8) AS sentences
    FROM documents"""
)
def cls_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", sentences(F.col("text")).alias("sentences"))


@query("SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`\\n]*`', ' ', 'g'), '#([0-9]{1,9})', 1), lambda x: x::INT))) AS issues FROM documents")
def issue_refs(spark, d):
    return table(spark, d, "documents").select("doc_id", issue_numbers(F.col("text")).alias("issues"))


@query(
    """SELECT doc_id, score, CASE WHEN score <= 0 THEN 'UNK' ELSE truth END AS label, CASE WHEN score <= 0 THEN 'UNKNOWN' WHEN grade = 'EXPLICIT' THEN 'EXPLICIT' ELSE 'INFERRED' END AS grade,
    CASE WHEN score <= 0 THEN 0.0 WHEN grade = 'EXPLICIT' THEN 1.0 WHEN quality = 1 THEN 0.6 WHEN confidence >= 0.5 THEN least(0.9, confidence) ELSE 0.5 END::DOUBLE AS confidence
    FROM (SELECT *, CASE WHEN truth = 'UNK' THEN 0.0 ELSE confidence + CASE WHEN truth = guess THEN 0.5 ELSE 0 END END::DOUBLE AS score FROM cases)""",
    (DELETIONS, CASES),
)
def cls_grade(spark, d):
    """Score, decision and the cascade of evidence grades."""
    score = F.when(F.col("truth") == "UNK", 0.0).otherwise(F.col("confidence") + F.when(F.col("truth") == F.col("guess"), 0.5).otherwise(0.0))
    scored = cases(spark, d).withColumn("score", score)
    graded = grade(F.col("score") > 0, F.col("grade") == "EXPLICIT", F.col("quality") == 1, F.col("confidence"))
    return scored.select("doc_id", "score", F.when(F.col("score") <= 0, "UNK").otherwise(F.col("truth")).alias("label"), graded["grade"].alias("grade"), graded["confidence"].alias("confidence"))


@query(
    """, s AS (SELECT doc_id, unnest(['SEC', 'LIB', 'DEAD', 'FEAT', 'BUG', 'PERF', 'DESIGN']) AS label, unnest(range(7)) AS place, confidence, truth, guess FROM cases),
    t AS (SELECT doc_id, label, place, CASE WHEN label = truth THEN confidence ELSE 0 END + CASE WHEN label = guess THEN 0.5 ELSE 0 END AS score FROM s)
    SELECT doc_id, CASE WHEN max(score) <= 0 THEN 'UNK' ELSE arg_max(label, (score, -place)) END AS label, max(score)::DOUBLE AS score FROM t GROUP BY 1""",
    (DELETIONS, CASES),
)
def cls_decision(spark, d):
    """The label with the greatest score; on a tie the one first in priority; none without a positive score."""
    scores = F.array(*[F.struct((F.when(F.col("truth") == k, F.col("confidence")).otherwise(0.0) + F.when(F.col("guess") == k, 0.5).otherwise(0.0)).alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("label")) for i, k in enumerate(REASONS[:-1])])
    best = decide(scores)
    return cases(spark, d).select("doc_id", best["label"].alias("label"), best["score"].alias("score"))


@query("SELECT doc_id, count(DISTINCT label) = 1 AS agreed, CASE WHEN count(DISTINCT label) = 1 THEN any_value(label) END AS final FROM raters WHERE rater IN ('a', 'b') GROUP BY 1", (RATERS,))
def lbl_merge(spark, d):
    """Two raters' labels: final where they agree."""
    both = raters(spark, d).filter(F.col("rater").isin("a", "b")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rater", "label"))).alias("labels"))
    agreed = F.size(F.array_distinct(F.transform("labels", lambda x: x["label"]))) == 1
    return both.select("doc_id", agreed.alias("agreed"), F.when(agreed, F.get("labels", F.lit(0))["label"]).alias("final"))


@query("SELECT r.doc_id, CASE WHEN count(*) = 1 THEN any_value(r.rater) END AS chosen FROM raters r JOIN labels l ON r.doc_id = l.doc_id AND r.label = l.quality GROUP BY 1", (RATERS,))
def lbl_chosen(spark, d):
    """The rater whose label alone equals the final one."""
    final = table(spark, d, "labels").select("doc_id", F.col("quality").alias("final"))
    met = raters(spark, d).join(final, "doc_id").filter("label = final").groupBy("doc_id").agg(F.collect_list("rater").alias("r"))
    return met.select("doc_id", F.when(F.size("r") == 1, F.get("r", F.lit(0))).alias("chosen"))


@query("SELECT doc_id, CASE WHEN grade = 'UNKNOWN' OR toxic = 1 THEN 'UNKNOWN' WHEN grade = 'INFERRED' OR quality = 0 THEN 'INFERRED' ELSE 'EXPLICIT' END AS grade FROM cases", (DELETIONS, CASES))
def lbl_weaker_grade(spark, d):
    other = F.when(F.col("toxic") == 1, "UNKNOWN").when(F.col("quality") == 0, "INFERRED").otherwise("EXPLICIT")
    return cases(spark, d).select("doc_id", weaker_grade(F.array(F.col("grade"), other), GRADES).alias("grade"))


@query(
    """SELECT doc_id, unnest(list_filter([CASE WHEN (truth = 'UNK') <> (grade = 'UNKNOWN') THEN 'unknown mismatch' END, CASE WHEN grade = 'INFERRED' AND confidence < 0.2 THEN 'weak' END, CASE WHEN guess = 'UNK' THEN 'no guess' END], lambda x: x IS NOT NULL)) AS problem FROM cases""",
    (DELETIONS, CASES),
)
def lbl_problems(spark, d):
    checks = [F.when((F.col("truth") == "UNK") != (F.col("grade") == "UNKNOWN"), "unknown mismatch"), F.when((F.col("grade") == "INFERRED") & (F.col("confidence") < 0.2), "weak"), F.when(F.col("guess") == "UNK", "no guess")]
    return cases(spark, d).select("doc_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


@query("SELECT id, reason, string_agg(repo, '>' ORDER BY repo) AS path FROM deletions GROUP BY ALL", (DELETIONS,))
def lbl_group_map(spark, d):
    return deletions(spark, d).groupBy("id", "reason").agg(F.array_join(F.array_sort(F.collect_list("repo")), ">").alias("path"))
