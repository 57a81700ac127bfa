"""Views of the engine's data model over star-schema and text tables.

Each view is a DataFrame function and, for checking, the same rule as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the data model.
KINDS = ["FULL_FUNCTION", "PARTIAL"]
REASONS = ["SEC", "LIB", "DEAD", "FEAT", "BUG", "PERF", "DESIGN", "UNK"]
GRADES = ["EXPLICIT", "INFERRED", "UNKNOWN"]
SOURCES = ["HUMAN", "MODEL_LLM", "MODEL_ONLY", "UNDISTINGUISHED", "NOT_CLASSIFIED"]
STATUSES = ["KEPT", "NOISE_TRIVIAL", "NOISE_FORMAT", "NOISE_GENERATED"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion records: documents with their labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    joined = docs.join(labels, "doc_id", "left")
    source = F.when(F.col("quality").isNull(), F.when(i % 5 == 0, "UNDISTINGUISHED").otherwise("NOT_CLASSIFIED")).when(F.col("toxic") == 1, "HUMAN").when(F.col("quality") == 1, "MODEL_LLM").otherwise("MODEL_ONLY")
    reason = pick(REASONS, i % 8)
    return joined.select(
        i.alias("doc_id"), i.cast("string").alias("id"), F.col("source").alias("repo"), F.when(F.col("n_chars") >= 1500, "FULL_FUNCTION").otherwise("PARTIAL").alias("deletion_kind"), (2010 + i % 15).cast("int").alias("author_year"),
        F.col("text").alias("body"), "n_chars", "lang", source.alias("class_source"), reason.alias("reason"), F.when(reason == "UNK", "UNKNOWN").when(i % 3 == 0, "EXPLICIT").otherwise("INFERRED").alias("grade"),
        F.when(i % 10 < 7, "KEPT").otherwise(pick(STATUSES, F.greatest(i % 10 - 6, F.lit(0)))).alias("filter_status"), ((i % 10) / 10).alias("confidence"),
    )


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

DELETIONS = f"""deletions AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, d.source AS repo, CASE WHEN d.n_chars >= 1500 THEN 'FULL_FUNCTION' ELSE 'PARTIAL' END AS deletion_kind,
  CAST(2010 + d.doc_id % 15 AS INTEGER) AS author_year, d.text AS body, d.n_chars, d.lang,
  CASE WHEN l.quality IS NULL THEN CASE WHEN d.doc_id % 5 = 0 THEN 'UNDISTINGUISHED' ELSE 'NOT_CLASSIFIED' END WHEN l.toxic = 1 THEN 'HUMAN' WHEN l.quality = 1 THEN 'MODEL_LLM' ELSE 'MODEL_ONLY' END AS class_source,
  {_LIST(REASONS)}[CAST(d.doc_id % 8 + 1 AS INTEGER)] AS reason,
  CASE WHEN d.doc_id % 8 = 7 THEN 'UNKNOWN' WHEN d.doc_id % 3 = 0 THEN 'EXPLICIT' ELSE 'INFERRED' END AS grade,
  CASE WHEN d.doc_id % 10 < 7 THEN 'KEPT' ELSE {_LIST(STATUSES)}[CAST(d.doc_id % 10 - 5 AS INTEGER)] END AS filter_status, (d.doc_id % 10) / 10.0::DOUBLE AS confidence
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths: the path part of page addresses."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)(/[^?#]*)", 1).alias("host"), F.regexp_extract("url", r"^https?://([^/]+)(/[^?#]*)", 2).alias("file_path"), "url")


PATHS = """paths AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)(/[^?#]*)', 1) AS host, regexp_extract(url, '^https?://([^/]+)(/[^?#]*)', 2) AS file_path, url FROM pages)"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters' labels of each labelled document, in long form."""
    labels = table(spark, sf_dir, "labels")
    third = F.when(F.col("doc_id") % 4 == 0, F.col("toxic")).otherwise(F.col("quality"))
    return labels.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("rater"), v.cast("int").alias("label")) for n, v in (("a", F.col("quality")), ("b", F.col("toxic")), ("c", third))])).alias("r")).select("doc_id", "r.*")


RATERS = """raters AS (SELECT doc_id, 'a' AS rater, quality::INT AS label FROM labels UNION ALL SELECT doc_id, 'b', toxic::INT FROM labels
  UNION ALL SELECT doc_id, 'c', CASE WHEN doc_id % 4 = 0 THEN toxic ELSE quality END::INT FROM labels)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold reason, predicted reason, grade and split of each labelled document."""
    d = deletions(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    guess = F.when(F.col("quality") == 1, F.col("reason")).when(F.col("toxic") == 1, F.lit("UNK")).otherwise(pick(REASONS, (F.col("doc_id") + 3) % 8))
    return d.withColumn("guess", F.when(F.col("doc_id") % 7 == 0, F.lit("BUG")).otherwise(guess)).withColumn("split", pick(["train", "val", "test"], F.col("doc_id") % 3)).withColumnRenamed("reason", "truth")


CASES = f"""cases AS (SELECT x.* EXCLUDE (reason), x.reason AS truth, l.quality, l.toxic, CASE WHEN x.doc_id % 7 = 0 THEN 'BUG' WHEN l.quality = 1 THEN x.reason WHEN l.toxic = 1 THEN 'UNK'
  ELSE {_LIST(REASONS)}[CAST((x.doc_id + 3) % 8 + 1 AS INTEGER)] END AS guess, ['train', 'val', 'test'][CAST(x.doc_id % 3 + 1 AS INTEGER)] AS split FROM deletions x JOIN labels l ON x.doc_id = l.doc_id)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records: one for each event, by user."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("repo"), F.when(F.col("event_type") == "error", "FAILED").otherwise("DONE").alias("status"), F.when(F.col("event_type") != "signup", F.col("value")).alias("elapsed"), F.col("ts").alias("finished_at"), (1 + F.col("event_id") % 3).cast("int").alias("attempts"), "event_type")


RUNS = """runs AS (SELECT event_id, user_id AS repo, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN event_type <> 'signup' THEN value END AS elapsed,
  ts AS finished_at, CAST(1 + event_id % 3 AS INTEGER) AS attempts, event_type FROM events)"""
