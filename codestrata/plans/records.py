"""Queries over stored vectors, raw record lines, settled labels, dates and weighted samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codestrata.operators.partitions import supported_partitions
from codestrata.operators.ranking import weighted_reservoir
from codestrata.operators.records import assert_disjoint, aware_problem, kept_records, scan_status, verify_labels
from codestrata.operators.vectors import merged_vectors, write_vectors
from codestrata.plans.models import _CODES, _NAMES
from codestrata.plans.registry import query
from codestrata.sources.adapters import CASES, DELETIONS, REASONS, cases, table
from codestrata.sources.domain import COMMITS_SQL, RATINGS_SQL, commits, ratings
from codestrata.sources.files import numbered_objects, work_folder

_LATE = "coalesce(source, '') IN ('src1', 'src3') AND doc_id % 2 = 0"


@query(f"SELECT coalesce(source, '') AS repo, (dense_rank() OVER (ORDER BY coalesce(source, '')) - 1)::INT AS code, count(*) AS n, bool_or({_LATE}) AS fresh FROM documents GROUP BY 1")
def vec_incremental(spark, d):
    """Vectors of all documents, made in two runs: the second makes anew the parts of two repositories that got rows, and no other."""
    folder = f"{work_folder(spark)}/vectors-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    write_vectors(docs.filter(f"NOT ({_LATE})"), folder, key="doc_id", repo="source", text="text")
    told = write_vectors(docs, folder, key="doc_id", repo="source", text="text")
    merged = merged_vectors(spark, folder).groupBy("repo", "code").agg(F.count("*").alias("n"))
    return merged.join(told.select("repo", "fresh"), "repo").select("repo", "code", "n", "fresh")


def _raw_lines(own):
    """One line for each commit: ``repo`` first, but for one of 11; two statuses in one of 13; look-alikes inside of every text."""
    quoted = lambda c: F.expr(f"substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6)")
    repo, status = quoted("coalesce(repo, 'none')"), quoted("filter_status")
    body = quoted("concat('\"filter_status\": \"KEPT\", ', coalesce(body, ''))")
    at = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    first, ident, text, last = at("repo", repo), at("id", F.col("doc_id").cast("string")), at("body", body), at("filter_status", status)
    parts = F.when(F.col("doc_id") % 11 == 0, F.concat_ws(", ", ident, first, text, last)).when(F.col("doc_id") % 13 == 0, F.concat_ws(", ", first, ident, text, at("filter_status", F.lit('"NOISE_OLD"')), last)).otherwise(F.concat_ws(", ", first, ident, text, last))
    return own.select("doc_id", F.concat(F.lit("{"), parts, F.lit("}")).alias("value"))


def _written(spark, d):
    """The lines as text files below the shared folder, read as they are."""
    folder = f"{work_folder(spark)}/lines-{uuid.uuid4().hex}"
    _raw_lines(commits(spark, d)).select("value").write.text(folder)
    return spark.read.option("lineSep", "\n").text(folder)


_STATED = "doc_id % 11 <> 0 AND doc_id % 13 <> 0"


@query(f"SELECT CASE WHEN {_STATED} THEN coalesce(repo, 'none') END AS repo, CASE WHEN {_STATED} THEN filter_status END AS status, count(*) AS n FROM commits GROUP BY 1, 2", (COMMITS_SQL,))
def src_status_scan(spark, d):
    """Statuses of raw record lines without decoding them; what patterns can't tell has none."""
    told = _written(spark, d).select(scan_status(F.col("value")).alias("x"))
    return told.groupBy("x.repo", "x.status").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, coalesce(repo, 'none') AS repo, md5('\"filter_status\": \"KEPT\", ' || coalesce(body, '')) AS body FROM commits WHERE filter_status = 'KEPT'", (COMMITS_SQL,))
def src_kept_records(spark, d):
    """Records of one status: other lines are never decoded."""
    found = kept_records(_written(spark, d), "repo string, id long, body string, filter_status string")
    return found.select("id", "repo", F.md5("body").alias("body"))


@query("SELECT doc_id, CASE WHEN regexp_matches(author_date, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN NULL ELSE 'naive' END AS problem FROM commits", (COMMITS_SQL,))
def dat_aware(spark, d):
    """Dates that can't be taken for instants, and why."""
    return commits(spark, d).select("doc_id", aware_problem(F.col("author_date")).alias("problem"))


_WEIGHT = "(CASE WHEN doc_id % 10 = 0 THEN 0.0 ELSE coalesce(n_chars, 0) END)::DOUBLE"
_UNIT = "((('0x' || md5('reservoir:' || doc_id)[1:13])::BIGINT + 0.5) / 4503599627370496.0)"


@query(f"SELECT coalesce(source, '') AS source, doc_id, (row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY e, doc_id))::INT AS place FROM (SELECT source, doc_id, -ln({_UNIT}) / {_WEIGHT} AS e FROM documents WHERE {_WEIGHT} > 0) QUALIFY place <= 5")
def top_reservoir(spark, d):
    """Five documents of each source, drawn by their lengths; those without weight are never drawn."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.when(F.col("doc_id") % 10 == 0, 0.0).otherwise(F.coalesce("n_chars", F.lit(0))).cast("double").alias("w"))
    return weighted_reservoir(docs, ["source"], "doc_id", F.col("w"), 5, "reservoir").select("source", "doc_id", "place")


@query(
    f""", {_CODES}, supported AS (SELECT DISTINCT list_position({_NAMES}, truth) AS t FROM cases WHERE truth <> 'UNK' AND doc_id % 5 < 2 AND split = 'test')
    SELECT blocks::INT AS blocks, count(*) AS partitions, count(*) FILTER (len(list_filter(range(blocks), lambda b: NOT list_contains(list_transform(s.ts, lambda t: c[t]), b))) = 0) AS supported
    FROM codes, (SELECT list(t) AS ts FROM supported) s GROUP BY 1""",
    (DELETIONS, CASES),
)
def lbl_supported(spark, d):
    """Ways to merge reasons into three or four blocks, and how many of them have a case in every block."""
    own = cases(spark, d).filter("truth <> 'UNK' AND doc_id % 5 < 2 AND split = 'test'")
    return supported_partitions(own, REASONS[:-1], (3, 4), "truth").groupBy("blocks").agg(F.count("*").alias("partitions"), F.count_if("supported").alias("supported"))


@query(
    "SELECT r.record_id AS id, CASE WHEN r.record_id % 29 = 0 THEN 'missing' WHEN r.record_id % 23 = 0 OR r.record_id % 7 = 0 AND r.record_id % 3 = 0 THEN 'changed' ELSE 'same' END AS found FROM ratings r WHERE rater = 'bob'",
    (RATINGS_SQL,),
)
def agg_verify_labels(spark, d):
    """Settled labels against what was exported: some rows are missing, some have another grade, some should have lost their evidence."""
    i = F.col("id")
    labels = ratings(spark, d).filter("rater = 'bob'").select(F.col("record_id").alias("id"), "reason", "grade", "confidence", F.concat(F.lit("because "), F.col("record_id").cast("string")).alias("evidence_text"))
    policy = F.when(i % 7 == 0, "LINK_ONLY").otherwise("INCLUDED")
    rows = labels.filter(i % 29 != 0).withColumn("code_policy", policy).withColumn("grade", F.when(i % 23 == 0, "OTHER").otherwise(F.col("grade")))
    rows = rows.withColumn("evidence_text", F.when((i % 7 == 0) & (i % 3 != 0), None).otherwise(F.col("evidence_text")))
    return verify_labels(rows, labels, ("reason", "grade", "confidence", "evidence_text"))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS one, count(*) FILTER (toxic = 1) AS other FROM labels")
def set_disjoint(spark, d):
    """Two samples that must have nothing in common, once that is so."""
    labels = table(spark, d, "labels")
    one, other = labels.filter("quality = 1 AND toxic = 0"), labels.filter("toxic = 1")
    assert_disjoint(one, other, "doc_id", "samples")
    return labels.agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("one"), F.count_if(F.col("toxic") == 1).alias("other"))


@query("SELECT coalesce(source, '') AS repo, 2 * row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1 AS line, doc_id, md5(coalesce(text, '')) AS body FROM documents")
def src_numbered(spark, d):
    """Records of a file for each source with their line numbers; every other line is blank."""
    folder = f"{work_folder(spark)}/numbered-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("repo"), "doc_id", F.coalesce("text", F.lit("")).alias("body"))
    line = F.to_json(F.struct("doc_id", "body", "repo"))
    own = docs.select("doc_id", F.concat(line, F.lit("\n")).alias("value"), F.concat(F.lit("r"), F.md5("repo")).alias("_part"))
    # Sorted by the writer's own partition first: else the writer sorts anew, by that alone, and rows lose their order.
    own.repartition("_part").sortWithinPartitions("_part", "doc_id").select("value", "_part").write.partitionBy("_part").text(folder)
    found = numbered_objects(spark, f"{folder}/*", "doc_id long, body string, repo string")
    return found.select("repo", "line", "doc_id", F.md5("body").alias("body"))
