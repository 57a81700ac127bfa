"""Tables of the domain over the text tables: commits with their context, label files, histories.

Each view is one SQL text that Spark and DuckDB read alike, so a query and its equivalent start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.sources.adapters import table

_A, _B, _C = "CAST(doc_id % 97 + 1 AS STRING)", "CAST(doc_id % 31 + 100 AS STRING)", "CAST(doc_id % 13 + 200 AS STRING)"
_BODY = "coalesce(text, '')"

#: Messages show every form of reference, marker and reason that the rules know, most of them before a whole text.
COMMITS = f"""SELECT doc_id, CAST(doc_id AS STRING) AS id, source AS repo, coalesce(n_chars, 0) AS n_chars, text AS body,
  CASE doc_id % 14
    WHEN 0 THEN 'Fixes #' || {_A} || ', closes: #' || {_B} || chr(10) || 'see `#99` and' || chr(10) || '```' || chr(10) || '#77 fix it' || chr(10) || '```' || chr(10) || {_BODY}
    WHEN 1 THEN 'Merge pull request #' || {_A} || ' from x/y' || chr(10) || chr(10) || 'Refs GH-' || {_B} || ' and resolves GH-' || {_C} || chr(10) || {_BODY}
    WHEN 2 THEN 'Run black and isort, Black again (#' || {_A} || ')' || chr(10) || {_BODY}
    WHEN 3 THEN 'See https://github.com/org/' || coalesce(source, 'x') || '/issues/' || {_A} || ' and https://github.com/other/x/issues/5. Closed org/' || coalesce(source, 'x') || '#' || {_B} || ', not a/b#3' || chr(10) || {_BODY}
    WHEN 4 THEN 'Remove unused helper `old_fn`. It was never used (#' || {_A} || ')' || chr(10) || {_BODY}
    WHEN 5 THEN 'Drop support for py2! Use the standard queue instead of our loop' || chr(10) || {_BODY}
    WHEN 6 THEN 'Security: sanitize input. CVE-2020-' || {_A} || ' in old_fn' || chr(10) || {_BODY}
    WHEN 7 THEN 'Speed up the parser? refactor make_thing() today <!-- say which, as in fix #1 -->' || chr(10) || {_BODY}
    WHEN 8 THEN 'Reformat with yapf, re-wrap' || chr(10) || 'black is the style' || chr(10) || {_BODY}
    WHEN 9 THEN '* Clean up the style guide (PEP8)' || chr(10) || '- ' || {_BODY}
    WHEN 10 THEN 'Follow-up to #' || {_B} || ' and ##' || {_C} || ' x#5 resolved #' || {_A} || ' gh ' || {_C} || chr(10) || {_BODY}
    WHEN 11 THEN 'Fix a crash in update and `update`: wrong exception' || chr(10) || {_BODY}
    WHEN 12 THEN ''
    ELSE {_BODY} END AS message,
  CASE doc_id % 5 WHEN 0 THEN 'old_fn' WHEN 1 THEN 'update' WHEN 2 THEN 'make_thing' WHEN 3 THEN '__init__' ELSE 'run' END AS function_name,
  CASE doc_id % 16 WHEN 0 THEN 'src/pkg/mod.py' WHEN 1 THEN 'vendor/lib/x.py' WHEN 2 THEN 'pkg/tests/test_a.py' WHEN 3 THEN 'env/lib/python3.11/site-packages/x/y.py'
    WHEN 4 THEN 'app/venv/bin/tool.py' WHEN 5 THEN 'proto/api_pb2.py' WHEN 6 THEN 'proto/api_pb2_grpc.py' WHEN 7 THEN 'tests.py' WHEN 8 THEN 'pkg/venv/core.py' WHEN 9 THEN 'a/Lib64/Python3.9/b.py'
    WHEN 10 THEN 'x/_Vendored/y.py' WHEN 11 THEN '.venv/z.py' WHEN 12 THEN 'vendor.py' WHEN 13 THEN 'x/lib/pythonx/y.py' WHEN 14 THEN '' ELSE 'mytests/a.py' END AS file_path,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 97 + 1 END AS pr_number,
  CASE WHEN doc_id % 6 = 1 THEN NULL ELSE '2020-01-0' || CAST(doc_id % 9 + 1 AS STRING) END AS merged_at,
  'Fix #' || {_C} || ' and #' || {_A} AS pr_title, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {_BODY} || ' closes #' || {_B} END AS pr_body,
  CASE WHEN doc_id % 11 = 0 THEN 'Bot' ELSE 'User' END AS author_type, CASE WHEN doc_id % 7 = 0 THEN 'renovate[bot]' WHEN doc_id % 7 = 1 THEN NULL ELSE 'ann' END AS login,
  1 + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS parents,
  CAST(2010 + doc_id % 15 AS STRING) || CASE doc_id % 6 WHEN 0 THEN '-03-01T10:00:00+09:00' WHEN 1 THEN '-12-31T23:30:00-05:00' WHEN 2 THEN '-06-15T00:00:00Z' WHEN 3 THEN '-06-15T00:00:00' ELSE '-01-01T00:00:00+00:00' END AS author_date,
  CASE WHEN doc_id % 10 < 7 THEN 'KEPT' WHEN doc_id % 10 = 7 THEN 'NOISE_TRIVIAL' WHEN doc_id % 10 = 8 THEN 'NOISE_FORMAT' ELSE 'NOISE_MOVE' END AS filter_status,
  CASE WHEN coalesce(n_chars, 0) >= 1500 THEN 'FULL_FUNCTION' ELSE 'PARTIAL' END AS deletion_kind,
  doc_id % 40 + 1 AS start_line, doc_id % 40 + 1 + doc_id % 9 AS end_line, doc_id % 45 + 1 AS old_start, doc_id % 4 AS old_count, doc_id % 45 + 3 AS new_start, doc_id % 5 AS new_count,
  doc_id % 120 AS changed_files, doc_id % 500 AS additions, doc_id % 300 AS deletions
  FROM {{documents}}"""

#: Labels of two raters for each labelled document, with what can be wrong with them, and the rater that settled it.
RATINGS = """SELECT doc_id AS record_id, rater, reason, grade, confidence, note, anchored FROM (
  SELECT doc_id, 'ann' AS rater, CASE doc_id % 9 WHEN 0 THEN 'SEC' WHEN 1 THEN 'LIB' WHEN 2 THEN 'DEAD' WHEN 3 THEN 'FEAT' WHEN 4 THEN 'BUG' WHEN 5 THEN 'PERF' WHEN 6 THEN 'DESIGN' WHEN 7 THEN 'UNK' ELSE 'ODD' END AS reason,
    CASE WHEN doc_id % 9 = 7 THEN 'UNKNOWN' WHEN doc_id % 2 = 0 THEN 'EXPLICIT' ELSE 'INFERRED' END AS grade, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 11 AS DOUBLE) / 10.0 END AS confidence,
    CASE doc_id % 5 WHEN 0 THEN 'filter-miss' WHEN 1 THEN 'no-context, see notes' WHEN 2 THEN 'x-filter-miss' WHEN 3 THEN 'vague-message filter-miss' ELSE NULL END AS note, doc_id % 17 = 0 AS anchored FROM {labels}
  UNION ALL
  SELECT doc_id, 'bob', CASE WHEN toxic = 1 THEN 'BUG' WHEN quality = 0 THEN 'UNK' ELSE CASE doc_id % 9 WHEN 0 THEN 'SEC' WHEN 1 THEN 'LIB' WHEN 2 THEN 'DEAD' WHEN 3 THEN 'FEAT' WHEN 4 THEN 'BUG' WHEN 5 THEN 'PERF' WHEN 6 THEN 'DESIGN' ELSE 'UNK' END END,
    CASE WHEN quality = 0 THEN 'UNKNOWN' WHEN doc_id % 3 = 0 THEN 'EXPLICIT' ELSE 'INFERRED' END, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST(doc_id % 7 AS DOUBLE) / 6.0 END,
    CASE doc_id % 4 WHEN 0 THEN 'filter-miss' WHEN 1 THEN 'no-context' ELSE '' END, FALSE FROM {labels}) AS r"""


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def commits(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Deletion records with their commit, pull request and place; only those of ``known`` (doc_id), if given, joined before texts are multiplied."""
    docs = table(spark, sf_dir, "documents")
    return spark.sql(COMMITS, documents=docs if known is None else docs.join(known, "doc_id"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record and rater."""
    return _view(spark, sf_dir, RATINGS, "labels")


COMMITS_SQL = f"commits AS ({COMMITS.format(documents='documents')})"
RATINGS_SQL = f"ratings AS ({RATINGS.format(labels='labels')})"
