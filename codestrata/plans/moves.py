"""Mining and move-detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators.mining import added_functions, added_ranges, added_text, attributed_deletions, body_lines, commit_moves, extract_functions, extract_spans, find_moved, match_replacement, move_matches, normalise_body, parse_deleted, parse_diff, parse_hunks, parse_places, partition_moved, same_path_hunks, without_moved
from codestrata.plans.registry import query
from codestrata.sources.adapters import table
from codestrata.sources.code import DIFFS_SQL, FUNCTIONS_SQL, code_diffs, code_files, code_moves
from codestrata.sources.files import work_folder


_CUT = "array_to_string(list_slice(string_split(source, chr(10)), {}, {}), chr(10))"


@query(f"SELECT path, name, signature, start_line, end_line, md5({_CUT.format('start_line', 'end_line')}) AS body FROM functions", (FUNCTIONS_SQL,))
def mine_functions(spark, d):
    """Functions of all files: decorated, old, nested, beside errors, with whole texts in comments, docstrings and signatures."""
    found = code_files(spark, d).select("path", F.explode(extract_functions(F.col("source"))).alias("f"))
    return found.select("path", "f.name", "f.signature", "f.start_line", "f.end_line", F.md5("f.body").alias("body"))


@query("SELECT path, name, plain AS lines FROM functions", (FUNCTIONS_SQL,))
def mov_normalise(spark, d):
    """The normal form of each function: its text is a comment or a docstring and leaves no trace."""
    found = code_files(spark, d).select("path", F.explode(extract_functions(F.col("source"))).alias("f"))
    return found.select("path", "f.name", normalise_body(F.col("f.body")).alias("lines"))


_LINES = """SELECT doc_id, path, kind, line + unnest(range(len(texts))) AS line, unnest(texts) AS text FROM (
  SELECT doc_id, path, 'deleted' AS kind, d0 AS line, list_slice(string_split(source, chr(10)), d0, m) AS texts FROM diffs
  UNION ALL SELECT doc_id, path, 'added', d0, string_split(body, chr(10)) FROM diffs
  UNION ALL SELECT doc_id, CASE k WHEN 0 THEN 'old.py' WHEN 2 THEN 'gone.py' ELSE 'x.py' END, 'deleted', CASE k WHEN 2 THEN 1 ELSE 2 END, CASE k WHEN 0 THEN ['a'] ELSE string_split(body, chr(10)) END FROM diffs WHERE k <> 1
  UNION ALL SELECT doc_id, CASE k WHEN 0 THEN 'néw.py' WHEN 1 THEN 'made.py' ELSE 'x.py' END, 'added', CASE k WHEN 1 THEN 1 ELSE 2 END, CASE k WHEN 1 THEN string_split(body, chr(10)) ELSE ['--- b'] END FROM diffs WHERE k <> 2)"""


@query(f"SELECT doc_id, path, kind, line::INT AS line, text FROM ({_LINES})", (DIFFS_SQL,))
def diff_parse(spark, d):
    """All removed and added lines with their numbers: a file's own lines against a whole text, and a second file."""
    found = code_diffs(spark, d).select("doc_id", F.explode(parse_diff(F.col("diff"))).alias("x"))
    path = F.when(F.col("x.kind") == "deleted", F.col("x.old_path")).otherwise(F.col("x.new_path"))
    return found.select("doc_id", path.alias("path"), "x.kind", "x.line", "x.text")


@query(f"SELECT path, name, start_line, end_line, CASE WHEN start_line >= d0 THEN 'FULL_FUNCTION' ELSE 'PARTIAL' END AS deletion_kind, md5({_CUT.format('greatest(start_line, d0)', 'end_line')}) AS deleted_body FROM (SELECT *, (1 + doc_id % 2)::INT AS d0 FROM functions)", (FUNCTIONS_SQL,))
def mine_deletions(spark, d):
    """Deleted lines of the diffs attributed to the functions of the old files: those without their first line are partial."""
    lines = code_diffs(spark, d).select("path", F.explode(parse_diff(F.col("diff"))).alias("x")).filter("x.kind = 'deleted' AND x.old_path = path").select("path", "x.line", "x.text")
    found = attributed_deletions(mine_functions(spark, d).select("path", "name", "start_line", "end_line"), lines)
    return found.withColumn("deleted_body", F.md5("deleted_body"))


@query("SELECT sha256(text) AS body_hash, count(*) FILTER (doc_id % 2 = 0) AS deleted, count(*) FILTER (doc_id % 2 = 1) AS added FROM documents GROUP BY 1 HAVING count(*) FILTER (doc_id % 2 = 0) > 0 AND count(*) FILTER (doc_id % 2 = 1) > 0")
def mov_exact_hash(spark, d):
    """Bodies that were both deleted and added, by hash: classes, not pairs."""
    by = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("body_hash")).agg(F.count_if(F.col("doc_id") % 2 == 0).alias("deleted"), F.count_if(F.col("doc_id") % 2 == 1).alias("added"))
    return by.filter("deleted > 0 AND added > 0")


@query()
def mov_greedy(spark, d):
    """One-to-one moves between even (deleted) and odd (added) documents of a commit, which is a language."""
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("commit"), F.col("doc_id").alias("id"), body_lines(F.col("text")).alias("lines"))
    return move_matches(docs.filter("id % 2 = 0"), docs.filter("id % 2 = 1"))


def _hunks(spark, d):
    return code_diffs(spark, d).select("doc_id", parse_hunks(F.col("diff")).alias("hunks"))


@query("SELECT doc_id, path, min(line)::INT AS low, max(line)::INT AS high FROM lines WHERE kind = 'added' GROUP BY doc_id, path", (DIFFS_SQL, f"lines AS ({_LINES})"))
def mine_added_ranges(spark, d):
    """Lines that are added, by new path; quoted paths are read."""
    return _hunks(spark, d).select("doc_id", F.explode(added_ranges(F.col("hunks"))).alias("r")).select("doc_id", "r.path", "r.low", "r.high")


@query("SELECT doc_id, path, d0 AS new_start, body AS added_body FROM diffs UNION ALL SELECT doc_id, 'x.py', 2, '--- b' FROM diffs WHERE k = 3", (DIFFS_SQL,))
def mine_same_path_hunks(spark, d):
    """Hunks of files that keep their path; what looks like a header inside a hunk is content."""
    found = _hunks(spark, d).select("doc_id", F.explode(same_path_hunks(F.col("hunks"))).alias("h"))
    return found.select("doc_id", F.col("h.new_path").alias("path"), "h.new_start", "h.added_body")


_CASES = 7


def _replaced(spark, d):
    """Deleted functions with hunks of every kind: not read, empty, at the place, elsewhere, cut short, two of a name, whole in the new file.

    Their code holds a document's whole text as comments.
    """
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("    # "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n    # ")), F.lit("\n")).alias("note"))
    i, n = F.col("doc_id") % _CASES, F.col("doc_id").cast("string")
    whole = F.concat(F.lit("def f(a):\n"), "note", F.lit("    return a + "), n, F.lit("\n"))
    hunk = lambda start, count, new, body: F.struct(F.lit(start).alias("old_start"), F.lit(count).alias("old_count"), F.lit(new).alias("new_start"), body.alias("added_body"))
    ended = F.concat(whole, F.lit("x = 1"))
    kind = "array<struct<old_start:int,old_count:int,new_start:int,added_body:string>>"
    hunks = (
        F.when(i == 0, F.lit(None).cast(kind)).when(i == 1, F.array(hunk(10, 2, 10, F.lit("  ")))).when(i == 2, F.array(hunk(10, 2, 10, ended), hunk(900, 1, 900, ended)))
        .when(i == 3, F.array(hunk(900, 1, 900, ended))).when(i == 4, F.array(hunk(11, 1, 11, whole))).when(i == 5, F.array(hunk(300, 1, 300, F.lit("def f(z):\n    pass\ny = 2")), hunk(400, 1, 400, ended)))
        .otherwise(F.array(hunk(12, 0, 2, F.lit("def f(a):\n    b = 1"))))
    )
    child = F.when(i == 6, F.concat(F.lit("import os\ndef f(a):\n    b = 1\n"), "note", F.lit("    return b + "), n))
    return docs.select("doc_id", F.struct(F.lit("f").alias("name"), F.concat(F.lit("def f(a):\n"), "note", F.lit("    return a * "), n).alias("deleted"), F.lit(10).alias("start_line"), F.lit(11).alias("end_line"), hunks.alias("hunks"), child.alias("child")).alias("record"))


_M = f"doc_id % {_CASES}"
_NOTED = "(SELECT *, 'def f(a):' || chr(10) || note || '    return a + ' || doc_id AS w FROM (SELECT doc_id, '    # ' || replace(coalesce(text, ''), chr(10), chr(10) || '    # ') || chr(10) AS note FROM documents))"


@query(
    f"""SELECT doc_id, md5(CASE {_M} WHEN 2 THEN w WHEN 3 THEN w WHEN 5 THEN w WHEN 6 THEN 'def f(a):' || chr(10) || '    b = 1' || chr(10) || note || '    return b + ' || doc_id END) AS code, CASE {_M} WHEN 0 THEN NULL WHEN 1 THEN 'NONE' ELSE 'SAME_LOCATION' END AS match_method,
    CASE WHEN {_M} IN (0, 1) THEN 0.0 WHEN {_M} IN (2, 4, 6) THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM {_NOTED}"""
)
def rpl_matches(spark, d):
    """What took a deleted function's place, from hunks at it, hunks elsewhere, pieces that end too early, and the new file."""
    return _replaced(spark, d).select("doc_id", match_replacement(F.col("record")).alias("r")).select("doc_id", F.md5("r.code").alias("code"), "r.match_method", "r.confidence")


@query(f"SELECT doc_id, CASE {_M} WHEN 0 THEN 'flat' WHEN 1 THEN '  ' WHEN 2 THEN w || chr(10) || 'x = 1' || chr(10) || w || chr(10) || 'x = 1' WHEN 3 THEN w || chr(10) || 'x = 1' WHEN 4 THEN w || chr(10) WHEN 5 THEN 'def f(z):' || chr(10) || '    pass' || chr(10) || 'y = 2' || chr(10) || w || chr(10) || 'x = 1' ELSE 'def f(a):' || chr(10) || '    b = 1' END AS added FROM {_NOTED}")
def rpl_added_text(spark, d):
    """Added lines of all hunks, or the flat field of older rows."""
    return _replaced(spark, d).select("doc_id", added_text(F.col("record.hunks"), F.lit("flat")).alias("added"))


def _moves(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("commit"), F.col("doc_id").alias("id"), body_lines(F.col("text")).alias("lines"))
    deleted, added = docs.filter("id % 2 = 0"), docs.filter("id % 2 = 1")
    return deleted, move_matches(deleted, added)


@query()
def mov_partition(spark, d):
    """Deleted documents as kept or moved, with where they went."""
    deleted, matches = _moves(spark, d)
    found = partition_moved(deleted.select("commit", "id"), matches)
    return found.select("commit", "id", "filter_status", "filter_evidence.destination", F.round("filter_evidence.similarity", 6).alias("similarity"))


@query()
def mov_sides(spark, d):
    """How many deleted documents moved and how many stay, by commit."""
    deleted, matches = _moves(spark, d)
    moved, kept = find_moved(deleted.select("commit", "id"), matches), without_moved(deleted.select("commit", "id"), matches)
    return moved.select("commit", F.lit(1).alias("m")).union(kept.select("commit", F.lit(0))).groupBy("commit").agg(F.sum("m").alias("moved"), F.sum(1 - F.col("m")).alias("kept"))


_SPAN = "array_to_string(list_slice(string_split(source, chr(10)), start_line, end_line), chr(10))"


@query(
    f"""SELECT doc_id, path, name, start_line, CASE WHEN k IN (0, 2) THEN 'NOISE_MOVE' ELSE 'KEPT' END AS filter_status,
    CASE k WHEN 0 THEN CASE WHEN contains({_SPAN}, '# ') THEN 'moved/b.py' ELSE 'moved/a.py' END WHEN 2 THEN path END AS destination, CASE k WHEN 0 THEN start_line WHEN 2 THEN start_line + 50 END AS line, CASE WHEN k IN (0, 2) THEN 1.0 END::DOUBLE AS similarity FROM (SELECT *, doc_id % 4 AS k FROM functions)""",
    (FUNCTIONS_SQL,),
)
def mine_commits(spark, d):
    """From diffs and files to judged deletions: one diff of each commit serves lines, added ranges and hunks of a file.

    Functions that moved say where to; of two like places the one that is written alike counts, and what is edited in
    place has not moved.
    """
    own = code_moves(spark, d)
    key = lambda path: F.concat_ws("\x1f", F.col("doc_id").cast("string"), path)
    split = lambda df: df.withColumn("commit", F.split("path", "\x1f")[0]).withColumn("path", F.split("path", "\x1f")[1])
    functions = lambda rows, read: rows.select("path", F.explode(read(F.col("source"))).alias("f")).select("path", "f.name", "f.start_line", "f.end_line", "f.body")
    old = functions(own.select(key(F.col("path")).alias("path"), F.col("old").alias("source")), extract_spans).drop("body")
    new = functions(own.select(key(F.col("new_path")).alias("path"), F.col("new").alias("source")).union(own.filter("more IS NOT NULL").select(key(F.lit("moved/b.py")), "more")), extract_functions)
    lines = own.select("doc_id", F.explode(parse_deleted(F.col("diff"))).alias("x")).select(key(F.col("x.old_path")).alias("path"), "x.line", "x.text")
    work_folder(spark)
    hunks = own.select("doc_id", parse_places(F.col("diff")).alias("hunks")).checkpoint()
    ranges = hunks.select("doc_id", F.explode(added_ranges(F.col("hunks"))).alias("r")).select(key(F.col("r.path")).alias("path"), "r.low", "r.high")
    kept_path = hunks.select(F.col("doc_id").cast("string").alias("commit"), F.explode(same_path_hunks(F.col("hunks"))).alias("h")).groupBy("commit", F.col("h.new_path").alias("path")).agg(F.collect_list("h").alias("hunks"))
    gone = split(attributed_deletions(old, lines)).withColumnRenamed("deleted_body", "body")
    judged = commit_moves(gone, split(added_functions(new, ranges)), kept_path)
    to = F.col("filter_evidence.destination")
    return judged.select(F.col("commit").cast("long").alias("doc_id"), "path", "name", "start_line", "filter_status", to["path"].alias("destination"), to["start_line"].alias("line"), F.col("filter_evidence.similarity").alias("similarity"))
