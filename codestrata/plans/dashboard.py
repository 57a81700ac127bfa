"""Dashboard, run summaries and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions.stats import frechet, ratio, sign_test
from codestrata.operators.aggregates import agreement, class_scores, dense_counts, duplicates, fleiss_kappa, grouping_counts, latest, majority, rate_with_bounds
from codestrata.operators.ranking import ranked
from codestrata.plans.registry import query
from codestrata.sources.adapters import CASES, DELETIONS, GRADES, KINDS, RATERS, REASONS, RUNS, SOURCES, STATUSES, cases, deletions, raters, runs, table

_values = lambda values: ", ".join(f"({i}, '{v}')" for i, v in enumerate(values))


@query("SELECT deletion_kind, class_source, author_year, repo, count(*) AS n FROM deletions GROUP BY GROUPING SETS ((deletion_kind), (class_source), (author_year, deletion_kind), (repo))", (DELETIONS,))
def dash_by_kind(spark, d):
    return grouping_counts(deletions(spark, d), [["deletion_kind"], ["class_source"], ["author_year", "deletion_kind"], ["repo"]])


@query("SELECT count(*) AS n_rows, count(DISTINCT repo) AS repos, min(author_year) AS first_year, max(author_year) AS last_year, count(*) FILTER (class_source IN ('HUMAN', 'MODEL_LLM')) AS classified, round(avg((filter_status = 'KEPT')::INT), 6) AS kept_rate FROM deletions", (DELETIONS,))
def dash_headline(spark, d):
    return deletions(spark, d).agg(
        F.count("*").alias("n_rows"), F.countDistinct("repo").alias("repos"), F.min("author_year").alias("first_year"), F.max("author_year").alias("last_year"), F.count_if(F.col("class_source").isin("HUMAN", "MODEL_LLM")).alias("classified"), F.round(F.avg((F.col("filter_status") == "KEPT").cast("int")), 6).alias("kept_rate")
    )


@query(f"SELECT position, value, (SELECT count(*) FROM deletions WHERE class_source = value) AS n FROM (VALUES {_values(SOURCES)}) v(position, value)", (DELETIONS,))
def dash_by_source(spark, d):
    return dense_counts(deletions(spark, d), "class_source", SOURCES)


@query(f"SELECT position, value, (SELECT count(*) FROM deletions WHERE reason = value AND class_source IN ('HUMAN', 'MODEL_LLM')) AS n FROM (VALUES {_values(REASONS)}) v(position, value)", (DELETIONS,))
def dash_reason_distribution(spark, d):
    return dense_counts(deletions(spark, d).filter(F.col("class_source").isin("HUMAN", "MODEL_LLM")), "reason", REASONS)


@query("SELECT author_year, count(*) FILTER (deletion_kind = 'FULL_FUNCTION') AS full_function, count(*) FILTER (deletion_kind = 'PARTIAL') AS partial FROM deletions GROUP BY 1", (DELETIONS,))
def dash_year_pivot(spark, d):
    wide = deletions(spark, d).groupBy("author_year").pivot("deletion_kind", KINDS).count().na.fill(0)
    return wide.select("author_year", F.col("FULL_FUNCTION").alias("full_function"), F.col("PARTIAL").alias("partial"))


@query("SELECT repo, count(*) AS records, count(*) FILTER (filter_status <> 'KEPT') AS noise_rows, round(count(*) FILTER (class_source IN ('HUMAN', 'MODEL_LLM')) / count(*), 6) AS classified_rate FROM deletions GROUP BY repo", (DELETIONS,))
def dash_repo_rows(spark, d):
    return deletions(spark, d).groupBy("repo").agg(F.count("*").alias("records"), F.count_if(F.col("filter_status") != "KEPT").alias("noise_rows"), F.round(F.count_if(F.col("class_source").isin("HUMAN", "MODEL_LLM")) / F.count("*"), 6).alias("classified_rate"))


@query("SELECT reason, grade, grouping(reason)::INT AS all_reasons, grouping(grade)::INT AS all_grades, count(*) AS n FROM deletions GROUP BY CUBE (reason, grade)", (DELETIONS,))
def agg_reason_grade_crosstab(spark, d):
    return deletions(spark, d).cube("reason", "grade").agg(F.grouping("reason").cast("int").alias("all_reasons"), F.grouping("grade").cast("int").alias("all_grades"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (author_year BETWEEN 2010 AND 2024) AS years_ok, count(*) FILTER (deletion_kind IN ('FULL_FUNCTION', 'PARTIAL')) AS kinds_ok, count(DISTINCT id) = count(*) AS ids_unique, count(*) FILTER (reason = 'UNK') = count(*) FILTER (grade = 'UNKNOWN') AS grades_ok FROM deletions", (DELETIONS,))
def dash_checks(spark, d):
    return deletions(spark, d).agg(
        F.count("*").alias("n"), F.count_if(F.col("author_year").between(2010, 2024)).alias("years_ok"), F.count_if(F.col("deletion_kind").isin(KINDS)).alias("kinds_ok"), (F.countDistinct("id") == F.count("*")).alias("ids_unique"), (F.count_if(F.col("reason") == "UNK") == F.count_if(F.col("grade") == "UNKNOWN")).alias("grades_ok")
    )


@query("SELECT repo, filter_status, count(*) AS n FROM deletions GROUP BY GROUPING SETS ((repo, filter_status), (filter_status))", (DELETIONS,))
def agg_status_counts(spark, d):
    return grouping_counts(deletions(spark, d), [["repo", "filter_status"], ["filter_status"]])


@query(f"SELECT position, value, (SELECT count(*) FROM deletions WHERE filter_status = value) AS n FROM (VALUES {_values(STATUSES)}) v(position, value)", (DELETIONS,))
def agg_noise_split(spark, d):
    return dense_counts(deletions(spark, d), "filter_status", STATUSES)


@query("SELECT count(*) AS n_runs, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (attempts > 1) AS retried, round(sum(elapsed), 3) AS total_s, median(elapsed) AS median_s, max(elapsed) AS max_s FROM runs", (RUNS,))
def run_summary(spark, d):
    return runs(spark, d).agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("attempts") > 1).alias("retried"), F.round(F.sum("elapsed"), 3).alias("total_s"), F.median("elapsed").alias("median_s"), F.max("elapsed").alias("max_s"))


@query("SELECT repo, event_id, status, attempts FROM runs QUALIFY row_number() OVER (PARTITION BY repo ORDER BY finished_at DESC, event_id) = 1", (RUNS,))
def runs_latest(spark, d):
    return latest(runs(spark, d), ["repo"], F.desc("finished_at"), F.asc("event_id")).select("repo", "event_id", "status", "attempts")


@query("SELECT event_type, count(elapsed) AS n, quantile_cont(elapsed, 0.5) AS p50, quantile_cont(elapsed, 0.95) AS p95, max(elapsed) AS longest FROM runs GROUP BY GROUPING SETS ((event_type), ())", (RUNS,))
def agg_latency_percentiles(spark, d):
    return runs(spark, d).groupingSets([[F.col("event_type")], []], "event_type").agg(F.count("elapsed").alias("n"), F.percentile("elapsed", 0.5).alias("p50"), F.percentile("elapsed", 0.95).alias("p95"), F.max("elapsed").alias("longest"))


@query("SELECT count(*) AS n, round(avg((truth = guess)::INT), 6) AS accuracy, round(avg((truth = 'UNK')::INT), 6) AS all_unknown FROM cases", (DELETIONS, CASES))
def eval_accuracy(spark, d):
    return cases(spark, d).agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("guess")).cast("int")), 6).alias("accuracy"), F.round(F.avg((F.col("truth") == "UNK").cast("int")), 6).alias("all_unknown"))


@query("SELECT grade, count(*) AS n, round(avg((truth = guess)::INT), 6) AS accuracy FROM cases GROUP BY grade", (DELETIONS, CASES))
def eval_grade_accuracy(spark, d):
    return cases(spark, d).groupBy("grade").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("guess")).cast("int")), 6).alias("accuracy"))


@query(
    """SELECT label, support, predicted, hits, round(hits / nullif(predicted, 0), 6) AS precision, round(hits / nullif(support, 0), 6) AS recall, round(2 * hits / nullif(support + predicted, 0), 6) AS f1 FROM
    (SELECT coalesce(a.label, b.label) AS label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits FROM (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = guess) AS hits FROM cases GROUP BY 1) a
    FULL JOIN (SELECT guess AS label, count(*) AS predicted FROM cases GROUP BY 1) b ON a.label = b.label)""",
    (DELETIONS, CASES),
)
def eval_class_scores(spark, d):
    out = class_scores(cases(spark, d), "truth", "guess")
    return out.select("label", "support", "predicted", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT truth, guess, count(*) AS n FROM cases GROUP BY 1, 2", (DELETIONS, CASES))
def eval_confusion(spark, d):
    return cases(spark, d).groupBy("truth", "guess").agg(F.count("*").alias("n"))


@query("SELECT truth = 'UNK' AS truly_unknown, guess = 'UNK' AS told_unknown, count(*) AS n FROM cases GROUP BY 1, 2", (DELETIONS, CASES))
def eval_unknown_confusion(spark, d):
    return cases(spark, d).groupBy((F.col("truth") == "UNK").alias("truly_unknown"), (F.col("guess") == "UNK").alias("told_unknown")).agg(F.count("*").alias("n"))


@query("SELECT split, grade, repo, guess, count(*) AS n FROM cases GROUP BY GROUPING SETS ((split, guess), (grade, guess), (repo, guess), (guess))", (DELETIONS, CASES))
def agg_label_distribution(spark, d):
    return grouping_counts(cases(spark, d), [["split", "guess"], ["grade", "guess"], ["repo", "guess"], ["guess"]])


_KAPPA = """SELECT total, same, round(same / total, 6) AS observed, round(together / (total * total), 6) AS expected, round((same / total - together / (total * total)) / (1 - together / (total * total)), 6) AS kappa FROM
  (SELECT count(*)::DOUBLE AS total, count(*) FILTER (quality = toxic)::DOUBLE AS same, (count(*) FILTER (quality = 1) * count(*) FILTER (toxic = 1) + count(*) FILTER (quality = 0) * count(*) FILTER (toxic = 0))::DOUBLE AS together FROM labels)"""


@query(f"SELECT total::BIGINT AS total, same::BIGINT AS same, observed, expected, kappa FROM ({_KAPPA})")
def agg_cohen_kappa(spark, d):
    return agreement(table(spark, d, "labels"), "quality", "toxic").select("total", "same", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query(
    """, cells AS (SELECT doc_id, label, count(*) AS n FROM raters GROUP BY 1, 2), items AS (SELECT doc_id, (sum(n * n) - sum(n)) / (sum(n) * (sum(n) - 1)) AS p FROM cells GROUP BY 1),
    shares AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS e FROM (SELECT label, sum(n)::DOUBLE AS c FROM cells GROUP BY 1))
    SELECT count(*) AS items, round(avg(p), 6) AS observed, round(any_value(e), 6) AS expected, round((avg(p) - any_value(e)) / (1 - any_value(e)), 6) AS kappa FROM items, shares""",
    (RATERS,),
)
def agg_fleiss_kappa(spark, d):
    return fleiss_kappa(raters(spark, d), "doc_id", "label").select("items", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("SELECT doc_id, count(*) AS votes, CASE WHEN 2 * sum(label) > count(*) THEN 1 WHEN 2 * sum(1 - label) > count(*) THEN 0 ELSE -1 END AS majority, min(label) = max(label) AS unanimous FROM raters GROUP BY 1", (RATERS,))
def agg_majority_vote(spark, d):
    return majority(raters(spark, d), "doc_id", "label", F.lit(-1))


@query(
    """SELECT repo, k, n, round(k / n, 6) AS rate, round(greatest(0, (k / n + 3.841458881296 / (2 * n) - 1.959964 * sqrt(k / n * (1 - k / n) / n + 3.841458881296 / (4 * n * n))) / (1 + 3.841458881296 / n)), 6) AS low,
    round(least(1, (k / n + 3.841458881296 / (2 * n) + 1.959964 * sqrt(k / n * (1 - k / n) / n + 3.841458881296 / (4 * n * n))) / (1 + 3.841458881296 / n)), 6) AS high
    FROM (SELECT repo, count(*) FILTER (truth = guess) AS k, count(*) AS n FROM cases GROUP BY 1)""",
    (DELETIONS, CASES),
)
def agg_wilson_by_repo(spark, d):
    out = rate_with_bounds(cases(spark, d), ["repo"], F.col("truth") == F.col("guess"))
    return out.select("repo", "k", "n", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


@query("SELECT round(sum(n_chars * y) FILTER (filter_status = 'KEPT') / sum(n_chars * y), 6) AS recall FROM (SELECT n_chars, filter_status, (truth <> 'UNK')::INT AS y FROM cases)", (DELETIONS, CASES))
def agg_recall_weighted(spark, d):
    y = F.col("n_chars") * (F.col("truth") != "UNK").cast("int")
    return cases(spark, d).agg(F.round(F.sum(F.when(F.col("filter_status") == "KEPT", y)) / F.sum(y), 6).alias("recall"))


@query("SELECT round(sum(size * rate) / sum(size), 6) AS weighted, count(*) AS repos FROM (SELECT repo, sum(n_chars) AS size, avg((truth = guess)::INT) AS rate FROM cases GROUP BY 1)", (DELETIONS, CASES))
def agg_repo_weighted_rate(spark, d):
    by = cases(spark, d).groupBy("repo").agg(F.sum("n_chars").alias("size"), F.avg((F.col("truth") == F.col("guess")).cast("int")).alias("rate"))
    return by.agg(F.round(F.sum(F.col("size") * F.col("rate")) / F.sum("size"), 6).alias("weighted"), F.count("*").alias("repos"))


@query(
    """SELECT repo, n, strict, wide, round(strict / n, 6) AS strict_rate, round(wide / n, 6) AS wide_rate, CASE WHEN strict * 10 >= n * 3 AND wide * 10 >= n * 3 THEN 'PASS' WHEN strict * 10 < n * 3 AND wide * 10 < n * 3 THEN 'FAIL' ELSE 'SPLIT' END AS verdict
    FROM (SELECT repo, count(*) AS n, count(*) FILTER (grade = 'EXPLICIT') AS strict, count(*) FILTER (grade = 'EXPLICIT' OR grade = 'INFERRED' AND confidence >= 0.5) AS wide FROM cases GROUP BY ROLLUP (repo))""",
    (DELETIONS, CASES),
)
def agg_recovery_tiers(spark, d):
    wide = (F.col("grade") == "EXPLICIT") | ((F.col("grade") == "INFERRED") & (F.col("confidence") >= 0.5))
    by = cases(spark, d).rollup("repo").agg(F.count("*").alias("n"), F.count_if(F.col("grade") == "EXPLICIT").alias("strict"), F.count_if(wide).alias("wide"))
    met = [F.col(c) * 10 >= F.col("n") * 3 for c in ("strict", "wide")]
    verdict = F.when(met[0] & met[1], "PASS").when(~met[0] & ~met[1], "FAIL").otherwise("SPLIT")
    return by.select("repo", "n", "strict", "wide", *[F.round(F.col(c) / F.col("n"), 6).alias(f"{c}_rate") for c in ("strict", "wide")], verdict.alias("verdict"))


@query(
    """SELECT split, wins, losses, round(least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM range(0, least(wins, losses) + 1) r(i))), 6) AS p
    FROM (SELECT split, count(*) FILTER (truth = guess AND truth <> 'UNK') AS wins, count(*) FILTER (truth <> guess AND truth = 'UNK') AS losses FROM cases GROUP BY 1)""",
    (DELETIONS, CASES),
)
def agg_paired_binomial(spark, d):
    hit, floor = F.col("truth") == F.col("guess"), F.col("truth") == "UNK"
    by = cases(spark, d).groupBy("split").agg(F.count_if(hit & ~floor).alias("wins"), F.count_if(~hit & floor).alias("losses"))
    return by.select("split", "wins", "losses", F.round(sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


@query("SELECT p, a, round(greatest(0, p + a - 1), 6) AS low, round(least(p, a), 6) AS high FROM (SELECT round(avg(quality), 6) AS p, round(avg((truth = guess)::INT), 6) AS a FROM cases)", (DELETIONS, CASES))
def agg_frechet_bounds(spark, d):
    rates = cases(spark, d).agg(F.round(F.avg("quality"), 6).alias("p"), F.round(F.avg((F.col("truth") == F.col("guess")).cast("int")), 6).alias("a"))
    low, high = frechet(F.col("p"), F.col("a"))
    return rates.select("p", "a", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_GRID_SQL = """, grid AS (SELECT * FROM (VALUES ('all'), ('no_unknown'), ('explicit'), ('explicit_inferred')) s(subset), (VALUES (10), (20), (50), (80), (100)) t(top)),
  ranked AS (SELECT subset, truth = guess AS hit, row_number() OVER (PARTITION BY subset ORDER BY confidence DESC, doc_id) AS place, count(*) OVER (PARTITION BY subset) AS n FROM cases, (SELECT DISTINCT subset FROM grid) s
  WHERE CASE subset WHEN 'all' THEN true WHEN 'no_unknown' THEN truth <> 'UNK' WHEN 'explicit' THEN grade = 'EXPLICIT' ELSE grade IN ('EXPLICIT', 'INFERRED') END)
  SELECT g.subset, top, count(*) AS n, count(*) FILTER (hit) AS hits FROM grid g JOIN ranked r ON g.subset = r.subset AND place <= ceil(r.n * top / 100) GROUP BY 1, 2"""


@query(_GRID_SQL, (DELETIONS, CASES))
def agg_configuration_grid(spark, d):
    """Accuracy over subset and top share: each case goes to its subsets, is ranked there once, and counts for each share."""
    own = cases(spark, d)
    subsets = {"all": F.lit(True), "no_unknown": F.col("truth") != "UNK", "explicit": F.col("grade") == "EXPLICIT", "explicit_inferred": F.col("grade").isin(GRADES[:2])}
    each = own.select("doc_id", "confidence", (F.col("truth") == F.col("guess")).alias("hit"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in subsets.items()]))).alias("subset"))
    placed = ranked(each, "subset", F.desc("confidence"), "doc_id")
    # Four rows: where a subset begins, and its size.
    sizes = placed.groupBy("subset").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    placed = placed.join(F.broadcast(sizes), "subset").withColumn("place", F.col("place") - F.col("first") + 1)
    tops = F.explode(F.filter(F.array(*[F.lit(t) for t in (10, 20, 50, 80, 100)]), lambda t: F.col("place") <= F.ceil(F.col("n") * t / 100)))
    return placed.select("subset", "hit", tops.alias("top")).groupBy("subset", "top").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("SELECT text AS body, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg_duplicate_bodies(spark, d):
    return duplicates(table(spark, d, "documents").select(F.col("text").alias("body")), "body")


@query("SELECT count(DISTINCT text) AS distinct_bodies, count(*) AS bodies, count(DISTINCT source) AS repos FROM documents")
def agg_distinct_counts(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct("text").alias("distinct_bodies"), F.count("*").alias("bodies"), F.countDistinct("source").alias("repos"))


@query("SELECT repo, author_year, count(*) AS sampled, sum(n_chars) AS churn, count(*) FILTER (n_chars >= 5000) AS bulk FROM deletions WHERE filter_status = 'KEPT' GROUP BY 1, 2", (DELETIONS,))
def agg_year_summary(spark, d):
    return deletions(spark, d).filter("filter_status = 'KEPT'").groupBy("repo", "author_year").agg(F.count("*").alias("sampled"), F.sum("n_chars").alias("churn"), F.count_if(F.col("n_chars") >= 5000).alias("bulk"))


@query("SELECT repo, string_agg(author_year || ':' || n, '|' ORDER BY author_year) AS years FROM (SELECT repo, author_year, count(*) AS n FROM deletions GROUP BY 1, 2) GROUP BY 1", (DELETIONS,))
def agg_year_string(spark, d):
    by = deletions(spark, d).groupBy("repo", "author_year").agg(F.count("*").alias("n"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("author_year", "n"))), lambda x: F.concat_ws(":", x["author_year"].cast("string"), x["n"].cast("string")))
    return by.groupBy("repo").agg(F.array_join(told, "|").alias("years"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN truth = 'UNK' AND guess <> 'UNK' THEN ['cause', 'wrong'] WHEN truth = 'UNK' THEN ['cause'] WHEN truth <> guess THEN ['wrong'] ELSE ['no tag'] END) AS tag FROM cases) GROUP BY 1", (DELETIONS, CASES))
def agg_unknown_tags(spark, d):
    found = F.array_compact(F.array(F.when(F.col("truth") == "UNK", F.lit("cause")), F.when(F.col("truth") != F.col("guess"), F.lit("wrong"))))
    return cases(spark, d).select(F.explode(F.when(F.size(found) == 0, F.array(F.lit("no tag"))).otherwise(found)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT truth, count(*) FILTER (guess = truth) AS agree, count(*) AS appear, round(count(*) FILTER (guess = truth) / count(*), 6) AS rate FROM cases WHERE truth NOT IN ('UNK', 'DESIGN') GROUP BY 1", (DELETIONS, CASES))
def agg_pair_agreement(spark, d):
    by = cases(spark, d).filter(~F.col("truth").isin("UNK", "DESIGN")).groupBy("truth").agg(F.count_if(F.col("guess") == F.col("truth")).alias("agree"), F.count("*").alias("appear"))
    return by.select("truth", "agree", "appear", F.round(ratio(F.col("agree"), F.col("appear")), 6).alias("rate"))
