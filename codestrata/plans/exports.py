"""Joins, counters, checks and files of an export, and control of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import exporting as X
from codestrata.operators.selection import permissive
from codestrata.plans.registry import query
from codestrata.sources.adapters import CASES, DELETIONS, cases, deletions, table
from codestrata.sources.domain import COMMITS_SQL, commits
from codestrata.sources.files import file_hashes, read_csv, read_jsonl, work_folder

_LICENSES = "licenses AS (SELECT DISTINCT repo, CASE length(repo) % 3 WHEN 0 THEN ' MIT ' WHEN 1 THEN 'GPL-3.0' ELSE 'bsd-3-clause' END AS license, length(repo) % 2 = 0 AS training FROM commits WHERE repo IS NOT NULL)"


def _licenses(spark, d):
    n = F.length("repo")
    return commits(spark, d).filter("repo IS NOT NULL").select("repo", F.when(n % 3 == 0, " MIT ").when(n % 3 == 1, "GPL-3.0").otherwise("bsd-3-clause").alias("license"), (n % 2 == 0).alias("training")).distinct()


def _rows(spark, d):
    """Records with license, policy and training membership: every repository must have a license."""
    met = X.required(commits(spark, d).filter("repo IS NOT NULL"), _licenses(spark, d), "repo", ("license", "training"), "license")
    return met.withColumn("policy", F.when(permissive(F.col("license")), "OPEN").otherwise("LINK_ONLY"))


_ROWS = f"{_LICENSES}, rows AS (SELECT c.*, l.license, l.training, CASE WHEN lower(trim(l.license)) IN ('mit', 'bsd-3-clause') THEN 'OPEN' ELSE 'LINK_ONLY' END AS policy FROM commits c JOIN licenses l ON c.repo = l.repo)"


@query(f", {_ROWS} SELECT doc_id, license, training, policy FROM rows", (COMMITS_SQL,))
def exp_licensed(spark, d):
    return _rows(spark, d).select("doc_id", "license", "training", "policy")


@query(
    f", {_ROWS} SELECT repo, count(*) AS n, count(*) FILTER (deletion_kind = 'FULL_FUNCTION') AS whole, count(*) FILTER (policy = 'LINK_ONLY') AS link_only, count(*) FILTER (pr_number IS NOT NULL) AS with_context, count(*) FILTER (filter_status <> 'KEPT') AS noise, sum(n_chars)::BIGINT AS chars FROM rows GROUP BY 1",
    (COMMITS_SQL,),
)
def exp_counters(spark, d):
    """Counters of each repository in one pass."""
    return _rows(spark, d).groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.col("deletion_kind") == "FULL_FUNCTION").alias("whole"), F.count_if(F.col("policy") == "LINK_ONLY").alias("link_only"), F.count_if(F.col("pr_number").isNotNull()).alias("with_context"), F.count_if(F.col("filter_status") != "KEPT").alias("noise"), F.sum("n_chars").alias("chars"))


@query(
    f", {_ROWS}, t AS (SELECT count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (policy = 'LINK_ONLY') AS link, count(*) FILTER (policy = 'OPEN') AS open, count(*) FILTER (filter_status = 'KEPT') AS kept, count(*) FILTER (file_path = '') AS no_path FROM rows),"
    " c AS (SELECT unnest(['ids', 'policies', 'kept', 'paths']) AS \"check\", unnest([n = ids, n = link + open, kept <= n, no_path = 0]) AS ok FROM t) SELECT * FROM c UNION ALL SELECT 'all', bool_and(ok) FROM c",
    (COMMITS_SQL,),
)
def exp_checks(spark, d):
    """Invariants over the totals of an export, and whether all hold."""
    one = _rows(spark, d).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("policy") == "LINK_ONLY").alias("link"), F.count_if(F.col("policy") == "OPEN").alias("open"), F.count_if(F.col("filter_status") == "KEPT").alias("kept"), F.count_if(F.col("file_path") == "").alias("no_path"))
    n = F.col("n")
    return X.checks(one, {"ids": n == F.col("ids"), "policies": n == F.col("link") + F.col("open"), "kept": F.col("kept") <= n, "paths": F.col("no_path") == 0})


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE [pr_title] END END AS titles, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE [login] END AS logins FROM commits", (COMMITS_SQL,))
def exp_context_lists(spark, d):
    """Lists are null where no context was joined, and empty where it has none."""
    context = F.when(F.col("doc_id") % 4 != 0, F.struct(F.when(F.col("doc_id") % 3 != 0, F.array("pr_title")).alias("titles"), F.array("login").alias("logins")))
    own = commits(spark, d).select("doc_id", context.alias("context"))
    return own.select("doc_id", *X.context_lists(F.col("context"), ("titles", "logins")))


_STATUS = """CASE WHEN c.doc_id IS NULL THEN 'orphan' WHEN c.filter_status <> 'KEPT' THEN 'excluded' WHEN c.deletion_kind <> 'FULL_FUNCTION' THEN 'partial_kept' WHEN x.doc_id IS NULL THEN 'missing' WHEN x.changed THEN 'stale' ELSE 'attached' END"""


@query(
    f", x AS (SELECT doc_id, doc_id % 11 = 0 AS changed FROM commits WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id + 5000000, false FROM commits WHERE doc_id % 90 = 0) SELECT coalesce(c.doc_id, x.doc_id) AS doc_id, {_STATUS} AS status FROM commits c FULL JOIN x ON c.doc_id = x.doc_id",
    (COMMITS_SQL,),
)
def exp_attach(spark, d):
    """Contexts are attached by id and fingerprint; what doesn't fit is told by kind."""
    own = commits(spark, d)
    marked = own.withColumn("mark", X.fingerprint(own.select("doc_id", "body", "message")))
    given = marked.filter("doc_id % 6 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("mark")).alias("mark"))
    orphans = marked.filter("doc_id % 90 = 0").select((F.col("doc_id") + 5_000_000).alias("doc_id"), "mark")
    return X.attach_status(marked, given.union(orphans), "doc_id")


@query("SELECT doc_id, function_name, file_path, body, pr_title, n_chars AS n_lines FROM commits WHERE filter_status = 'KEPT'", (COMMITS_SQL,))
def prj_labeler(spark, d):
    """What a rater sees: listed fields only, so nothing of the filter; the length is derived."""
    allowed = ("doc_id", "function_name", "file_path", "body", "pr_title")
    return commits(spark, d).filter("filter_status = 'KEPT'").select(*allowed, F.col("n_chars").alias("n_lines"))


@query("SELECT 'kept' AS part, doc_id, repo FROM commits WHERE filter_status = 'KEPT' UNION ALL SELECT filter_status, doc_id, repo FROM commits WHERE filter_status <> 'KEPT'", (COMMITS_SQL,))
def snk_publish(spark, d):
    """Kept and excluded rows are published together, and read back from where the pointer says."""
    root = f"{work_folder(spark)}/publish-{uuid.uuid4().hex}"
    own = commits(spark, d).select("doc_id", "repo", "filter_status")
    X.publish({"kept": own.filter("filter_status = 'KEPT'"), "excluded": own.filter("filter_status <> 'KEPT'")}, root)
    kept, excluded = (X.published(spark, root, n) for n in ("kept", "excluded"))
    return kept.select(F.lit("kept").alias("part"), "doc_id", "repo").union(excluded.select("filter_status", "doc_id", "repo"))


@query("SELECT doc_id, message, function_name FROM commits", (COMMITS_SQL,))
def src_jsonl(spark, d):
    """Rows with every kind of line separator in a text, as gzipped JSON lines and back: only a line feed ends a record."""
    own = commits(spark, d).select("doc_id", "message", "function_name")
    schema = own.schema
    return X.round_trip(own, lambda df, f: df.write.option("ignoreNullFields", False).option("compression", "gzip").json(f), lambda s, f: read_jsonl(s, f, schema, strict=True, glob="*.json.gz"))


@query(f", {_LICENSES} SELECT repo, license, training FROM licenses", (COMMITS_SQL,))
def src_licenses(spark, d):
    """A CSV of licenses by repository: columns that must be there, and no repository twice."""
    own = _licenses(spark, d)
    back = X.round_trip(own, lambda df, f: df.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f), lambda s, f: read_csv(s, f, "repo string, license string, training boolean", required=("repo", "license"), unique="repo"))
    return back.select("repo", "license", "training")


@query("SELECT id, reason, confidence FROM deletions WHERE class_source = 'MODEL_ONLY'", (DELETIONS,))
def src_classified(spark, d):
    """Results of a classifier: a record that is there twice is an error."""
    return X.unique(deletions(spark, d).filter("class_source = 'MODEL_ONLY'").select("id", "reason", "confidence"), "id", "a record")


@query("SELECT 4 AS files, true AS hashed")
def snk_manifest(spark, d):
    """Hashes of the files of a table."""
    folder = f"{work_folder(spark)}/files-{uuid.uuid4().hex}"
    table(spark, d, "documents").select("doc_id").repartition(4).write.parquet(folder)
    found = file_hashes(spark, f"{folder}/*.parquet")
    return found.agg(F.count("*").cast("int").alias("files"), F.every(F.length("sha256") == 64).alias("hashed"))


@query("SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second")
def snk_same_rows(spark, d):
    """Two formats of the same rows hold the same, copies counted."""
    own = commits(spark, d).select("doc_id", "repo", "message")
    back = X.round_trip(own, lambda df, f: df.write.option("compression", "zstd").parquet(f), lambda s, f: s.read.parquet(f))
    other = X.round_trip(own, lambda df, f: df.write.option("ignoreNullFields", False).json(f), lambda s, f: s.read.schema(own.schema).option("lineSep", "\n").json(f))
    return X.same_rows(back, other)


@query("SELECT doc_id, 'o__' || repo || '-' || lpad((doc_id % 3)::VARCHAR, 5, '0') || '-of-00003.parquet' AS name FROM commits WHERE repo IS NOT NULL", (COMMITS_SQL,))
def snk_shard_names(spark, d):
    own = commits(spark, d).filter("repo IS NOT NULL")
    return own.select("doc_id", X.shard_name(F.concat(F.lit("o/"), "repo"), (F.col("doc_id") % 3).cast("int"), F.lit(3), ".parquet").alias("name"))


@query(
    """SELECT c.doc_id, c.truth, coalesce(c.guess, 'none') AS guess FROM cases c WHERE split = 'test'""",
    (DELETIONS, CASES),
)
def join_predictions(spark, d):
    """Gold labels with their predictions; one that is missing is an error and not a wrong answer."""
    gold = cases(spark, d).filter("split = 'test'").select("doc_id", "truth")
    return X.required(gold, cases(spark, d).select("doc_id", "guess"), "doc_id", ("guess",), "prediction").select("doc_id", "truth", "guess")


@query(", v AS (SELECT a.doc_id, a.guess AS model, b.truth AS llm FROM cases a JOIN cases b ON a.doc_id = b.doc_id WHERE a.doc_id % 2 = 0) SELECT llm, count(*) AS n, count(*) FILTER (model = llm) AS agree, llm NOT IN ('UNK', 'DESIGN') AS clear FROM v GROUP BY 1", (DELETIONS, CASES))
def join_model_comparison(spark, d):
    """Two versions of labels joined by record, and their agreement by the second one's label."""
    own = cases(spark, d)
    both = X.required(own.filter("doc_id % 2 = 0").select("doc_id", F.col("guess").alias("model")), own.select("doc_id", F.col("truth").alias("llm")), "doc_id", ("llm",), "label")
    return both.groupBy("llm").agg(F.count("*").alias("n"), F.count_if(F.col("model") == F.col("llm")).alias("agree")).withColumn("clear", ~F.col("llm").isin("UNK", "DESIGN"))


@query("SELECT repo, filter_status, count(*) AS n, count(*) = max(CASE WHEN repo = 'src1' THEN 0 ELSE 1 END) * count(*) AS fits FROM commits WHERE repo IS NOT NULL GROUP BY ALL", (COMMITS_SQL,))
def run_assembly(spark, d):
    """Rows by repository and status against what the run's record promises (one run's record is wrong here)."""
    counts = commits(spark, d).filter("repo IS NOT NULL").groupBy("repo", "filter_status").agg(F.count("*").alias("n"))
    promised = counts.select("repo", "filter_status", F.when(F.col("repo") == "src1", 0).otherwise(F.col("n")).alias("promised"))
    return counts.join(promised, ["repo", "filter_status"]).select("repo", "filter_status", "n", (F.col("n") == F.col("promised")).alias("fits"))


_MANIFEST = "m AS (SELECT user_id AS repo, max(ts) AS finished, arg_max(event_type, (ts, event_id)) AS last, count(*) AS rows FROM events GROUP BY 1), w AS (SELECT o_custkey AS repo, count(*) AS lines FROM orders GROUP BY 1)"


@query(f"WITH {_MANIFEST} SELECT m.repo, CASE WHEN last = 'error' THEN 'failed' WHEN lines IS NULL THEN 'no output' WHEN rows <> lines THEN 'incomplete' ELSE 'done' END AS state FROM m LEFT JOIN w ON m.repo = w.repo")
def run_completed(spark, d):
    """Which jobs are done: the last attempt succeeded and its files have as many rows as the manifest says; others run again."""
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("repo")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("rows"))
    lines = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.count("*").alias("lines"))
    state = F.when(F.col("last") == "error", "failed").when(F.col("lines").isNull(), "no output").when(F.col("rows") != F.col("lines"), "incomplete").otherwise("done")
    return last.join(lines, "repo", "left").select("repo", state.alias("state"))


@query("SELECT event_id % 50 AS shard, count(*) AS n, event_id % 50 IN (SELECT event_id % 50 FROM events WHERE event_type = 'click' AND event_id < 40) AS known FROM events GROUP BY 1, 3")
def run_incremental(spark, d):
    """Shards whose content is on the manifest are skipped, the others are work."""
    own = table(spark, d, "events").withColumn("shard", F.col("event_id") % 50)
    known = own.filter("event_type = 'click' AND event_id < 40").select("shard", F.lit(True).alias("known")).distinct()
    return own.groupBy("shard").agg(F.count("*").alias("n")).join(known, "shard", "left").select("shard", "n", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(CAST(doc_id AS VARCHAR), '')) <> '' THEN trim(id) ELSE 'none' END AS record_id, CASE WHEN message <> '' THEN message ELSE coalesce(pr_title, '') END AS message, 'https://github.com/org/' || coalesce(repo, 'x') || '/commit/' || sha256(id)[1:40] AS url FROM commits", (COMMITS_SQL,))
def str_record_fields(spark, d):
    """Ids, messages and addresses with what stands in for an absent one."""
    sha = F.substring(F.sha2("id", 256), 1, 40)
    url = F.concat(F.lit("https://github.com/org/"), F.coalesce("repo", F.lit("x")), F.lit("/commit/"), sha)
    return commits(spark, d).select("doc_id", F.trim(F.coalesce(F.nullif(F.col("id"), F.lit("")), F.lit("none"))).alias("record_id"), F.coalesce(F.nullif("message", F.lit("")), "pr_title", F.lit("")).alias("message"), url.alias("url"))


@query("SELECT doc_id, sha256(id)[1:40] AS sha FROM commits", (COMMITS_SQL,))
def str_commit_of(spark, d):
    """The commit at the end of an address."""
    return str_record_fields(spark, d).select("doc_id", F.element_at(F.split("url", "/"), -1).alias("sha"))


@query("SELECT doc_id, array_to_string(list_transform([pr_title, message], lambda b, i: '[' || i || '/2] ' || (new_start + i) || chr(10) || coalesce(b, '')), chr(10))[1:3000] AS shown, array_to_string(string_split(coalesce(body, ''), chr(10))[1:2], chr(10))[1:300] || CASE WHEN len(string_split(coalesce(body, ''), chr(10))) > 2 OR length(array_to_string(string_split(coalesce(body, ''), chr(10))[1:2], chr(10))) > 300 THEN ' …' ELSE '' END AS cell FROM commits", (COMMITS_SQL,))
def str_shown_code(spark, d):
    """Added hunks with their numbers, and the beginning of a body for a cell."""
    hunks = F.array("pr_title", "message")
    shown = F.transform(hunks, lambda b, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("/2] "), (F.col("new_start") + i + 1).cast("string"), F.lit("\n"), F.coalesce(b, F.lit(""))))
    lines = F.split(F.coalesce("body", F.lit("")), "\n")
    head = F.array_join(F.slice(lines, 1, 2), "\n")
    cell = F.concat(F.substring(head, 1, 300), F.when((F.size(lines) > 2) | (F.char_length(head) > 300), " …").otherwise(""))
    return commits(spark, d).select("doc_id", F.substring(F.array_join(shown, "\n"), 1, 3000).alias("shown"), cell.alias("cell"))


@query(
    "SELECT doc_id, len(p) > 0 AND (len(list_filter(p, lambda x: contains(m, x))) = len(p) OR len(list_filter(p, lambda x: contains(t, x))) = len(p)) AS found FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(left(pr_title, 5) || '...' || message[6:12], '\\.\\.\\.|…'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p, regexp_replace(message, '\\s+', ' ', 'g') AS m, regexp_replace(pr_title, '\\s+', ' ', 'g') AS t FROM commits)",
    (COMMITS_SQL,),
)
def str_evidence_found(spark, d):
    """Whether all pieces of a quotation with gaps stand in one and the same source."""
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    quoted = F.concat(F.substring("pr_title", 1, 5), F.lit("..."), F.substring("message", 6, 7))
    pieces = F.filter(F.transform(F.split(quoted, r"\.\.\.|…"), lambda x: F.trim(flat(x))), lambda x: x != "")
    sources = F.array(flat(F.col("message")), flat(F.col("pr_title")))
    return commits(spark, d).select("doc_id", ((F.size(pieces) > 0) & F.exists(sources, lambda s: F.forall(pieces, lambda p: F.contains(s, p)))).alias("found"))


@query("SELECT doc_id, upper(substr(label, 1, 3)) AS label, problem FROM (SELECT doc_id, regexp_extract(answer, '(?m)^\\s*([A-Z]+)\\s*\\|', 1) AS label, CASE WHEN regexp_matches(answer, '(?m)^\\s*[A-Z]+\\s*\\|') THEN NULL ELSE 'no answer' END AS problem FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Well,' || chr(10) || 'BUG | ' || pr_title WHEN 1 THEN ' SEC|x' ELSE 'bug: yes' END AS answer FROM commits))", (COMMITS_SQL,))
def cls_answers(spark, d):
    """The first line of a model's answer that has a label and a bar."""
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Well,\nBUG | "), "pr_title")).when(F.col("doc_id") % 3 == 1, " SEC|x").otherwise("bug: yes")
    label = F.regexp_extract(answer, r"(?m)^\s*([A-Z]+)\s*\|", 1)
    return commits(spark, d).select("doc_id", F.upper(F.substring(label, 1, 3)).alias("label"), F.when(label == "", "no answer").alias("problem"))


@query("SELECT doc_id, substr(sha256('v1|model|' || prompt), 1, 32) AS key, CASE WHEN doc_id % 4 = 0 THEN 'BUG' END AS answer FROM (SELECT doc_id, 'Message: ' || substr(message, 1, 200) || chr(10) || 'Code: ' || substr(coalesce(body, ''), 1, 400) AS prompt FROM commits)", (COMMITS_SQL,))
def cls_cached_answers(spark, d):
    """Prompts with a budget for each part, and answers of a cache by the prompt's hash; what isn't there stays null."""
    prompt = F.concat(F.lit("Message: "), F.substring("message", 1, 200), F.lit("\nCode: "), F.substring(F.coalesce("body", F.lit("")), 1, 400))
    own = commits(spark, d).select("doc_id", F.substring(F.sha2(F.concat(F.lit("v1|model|"), prompt), 256), 1, 32).alias("key"))
    cache = own.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("asked"), F.lit("BUG").alias("answer"))
    return own.join(cache, own["doc_id"] == cache["asked"], "left").select("doc_id", "key", "answer")


@query("SELECT day, n, sum(n) OVER (ORDER BY day) AS total FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 14 DAY GROUP BY 1)")
def dat_since(spark, d):
    """Days since a number of days before a date's midnight."""
    since = F.lit("2024-01-15").cast("timestamp") - F.expr("INTERVAL '14' DAY")
    own = table(spark, d, "events").filter(F.col("ts") >= since).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    return own.withColumn("total", F.sum("n").over(W.orderBy("day")))  # a row for each day
