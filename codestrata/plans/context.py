"""Context of a commit: references, pull requests, issues, review comments; selection of repositories by samples of commits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.refs import bare_message, merged_references, pull_number, references, simple_references
from codestrata.operators.joins import same_file_comments
from codestrata.operators.selection import commit_count, excluded_by, is_bot, mining_window, sample_ratios, saturated_scale, spread_by, api_calls
from codestrata.plans.registry import query
from codestrata.sources.adapters import table
from codestrata.sources.domain import COMMITS_SQL, commits

_CLOSING = r"(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)"
_URL = r"https?://github\.com/[\w.-]+/[\w.-]+/(?:issues|pull)/[0-9]+"
_CROSS = r"[\w.-]+/[\w.-]+#[0-9]+\b"
_START = r"(?:^|[^\p{L}\p{N}_])"


def _clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), '`[^`\n]*`', ' ', 'g')"


def _bare(x: str) -> str:
    first = f"regexp_replace(regexp_replace(split_part({x}, chr(10), 1), '(?i)Merge (?:pull request|PR) #[0-9]+', '', 'g'), '\\(#[0-9]+\\)\\s*$', '')"
    return f"rtrim({first}) || CASE WHEN contains({x}, chr(10)) THEN chr(10) || rtrim(substr({x}, strpos({x}, chr(10)) + 1), chr(10)) ELSE '' END"


def _ints(x: str) -> str:
    return f"list_transform({x}, lambda n: n::BIGINT)"


def _refs_sql(text: str, own: str, exclude: str, source: str, name: str) -> str:
    """CTEs that end in one of that name with (doc_id, closing, plain), step by step as the rules say."""
    named = lambda x, pattern, at: f"list_filter(regexp_extract_all({x}, '{pattern}'), lambda m: lower(regexp_extract(m, '{at}', 1)) = lower(own))"
    number = lambda x: f"list_transform({x}, lambda m: regexp_extract(m, '([0-9]+)$', 1)::BIGINT)"
    url_at, cross_at = r"github\.com/([\w.-]+/[\w.-]+)/(?:issues|pull)", r"([\w.-]+/[\w.-]+)#"
    return rf"""{name}0 AS (SELECT doc_id, {own} AS own, {exclude} AS gone, {text} AS t FROM {source}), {name}1 AS (SELECT *, {_clean('t')} AS c FROM {name}0), {name}2 AS (SELECT *, regexp_replace(c, '{_URL}', ' ', 'g') AS u FROM {name}1),
    {name}3 AS (SELECT *, regexp_replace(u, '{_CROSS}', ' ', 'g') AS r FROM {name}2), {name}4 AS (SELECT doc_id, gone,
      list_concat(list_concat({number(named('c', rf'(?i){_START}{_CLOSING}\s*:?\s+{_URL}', url_at))}, {number(named('u', rf'(?i){_START}{_CLOSING}\s*:?\s+{_CROSS}', cross_at))}),
        list_concat({_ints(rf"regexp_extract_all(r, '(?i){_START}{_CLOSING}\s*:?\s+#([0-9]+)\b', 1)")}, {_ints(rf"regexp_extract_all(r, '(?i){_START}{_CLOSING}\s*:?\s+GH[-#]?\s?([0-9]+)\b', 1)")})) AS closing,
      list_concat(list_concat({number(named('c', _URL, url_at))}, {number(named('u', _CROSS, cross_at))}),
        list_concat({_ints(r"regexp_extract_all(r, '(?:^|[^\p{L}\p{N}_/#-])#([0-9]+)\b', 1)")}, {_ints(rf"regexp_extract_all(r, '(?i){_START}GH[-#]?\s?([0-9]+)\b', 1)")})) AS plain FROM {name}3),
    {name} AS (SELECT doc_id, list_sort(list_distinct(list_filter(closing, lambda n: NOT list_contains(gone, n)))) AS closing, list_sort(list_distinct(list_filter(plain, lambda n: NOT list_contains(gone, n) AND NOT list_contains(closing, n)))) AS plain FROM {name}4)"""


_SHOW = "list_concat(list_transform(closing, lambda n: 'closes ' || n), list_transform(plain, lambda n: 'names ' || n))"
_NONE = "[]::BIGINT[]"
_OWN = "'org/' || coalesce(repo, 'x')"
_PULL = "CASE WHEN pr_number IS NULL THEN []::BIGINT[] ELSE [pr_number::BIGINT] END"


def _own():
    return F.concat(F.lit("org/"), F.coalesce("repo", F.lit("x")))


def _shown(refs):
    return F.transform(refs, lambda x: F.concat(F.when(x["closing"], "closes ").otherwise("names "), x["number"].cast("string")))


def _pull_numbers():
    return F.when(F.col("pr_number").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(F.col("pr_number").cast("bigint")))


def _message_refs():
    return references(F.col("message"), _own(), _pull_numbers(), message=True)


@query(f", {_refs_sql(_bare('message'), _OWN, _PULL, 'commits', 'm')} SELECT doc_id, {_SHOW} AS refs FROM m", (COMMITS_SQL,))
def ref_issues(spark, d):
    """Issues that a commit message refers to, in all forms; code, other repositories and the own pull request don't count."""
    return commits(spark, d).select("doc_id", _shown(_message_refs()).alias("refs"))


@query(
    f", {_refs_sql(_bare('message'), _OWN, _PULL, 'commits', 'm')}, {_refs_sql('pr_title', _OWN, _PULL, 'commits', 'p')}, {_refs_sql(chr(39) * 2 + ' || coalesce(pr_body, ' + chr(39) * 2 + ')', _OWN, _PULL, 'commits', 'b')},"
    f" x AS (SELECT m.doc_id, list_concat(list_concat(m.closing, p.closing), b.closing) AS c, list_concat(list_concat(m.plain, p.plain), b.plain) AS q FROM m JOIN p ON m.doc_id = p.doc_id JOIN b ON m.doc_id = b.doc_id),"
    f" y AS (SELECT doc_id, list_sort(list_distinct(c)) AS closing, list_sort(list_distinct(list_filter(q, lambda n: NOT list_contains(c, n)))) AS plain FROM x) SELECT doc_id, {_SHOW} AS refs FROM y",
    (COMMITS_SQL,),
)
def ref_merged(spark, d):
    """References of message, title and body together: closed somewhere is closed."""
    title, body = (references(F.col(c), _own(), _pull_numbers()) for c in ("pr_title", "pr_body"))
    return commits(spark, d).select("doc_id", _shown(merged_references(_message_refs(), title, body)).alias("refs"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(split_part(message, chr(10), 1), '(?i)Merge (?:pull request|PR) #([0-9]+)', 1), ''), nullif(regexp_extract(split_part(message, chr(10), 1), '\\(#([0-9]+)\\)\\s*$', 1), ''))::BIGINT AS pull FROM commits", (COMMITS_SQL,))
def ref_pull_number(spark, d):
    return commits(spark, d).select("doc_id", pull_number(F.col("message")).alias("pull"))


@query(f"SELECT doc_id, {_bare('message')} AS bare FROM commits", (COMMITS_SQL,))
def ref_bare_message(spark, d):
    return commits(spark, d).select("doc_id", bare_message(F.col("message")).alias("bare"))


@query(f"SELECT doc_id, list_sort(list_distinct(list_filter({_ints('regexp_extract_all(' + _bare('message') + chr(44) + chr(39) + '#([0-9]+)' + chr(39) + ', 1)')}, lambda n: NOT list_contains({_PULL}, n)))) AS refs FROM commits", (COMMITS_SQL,))
def ref_simple(spark, d):
    return commits(spark, d).select("doc_id", simple_references(F.col("message"), _pull_numbers()).alias("refs"))


_ISSUES = "issues AS (SELECT s_suppkey AS number, s_name AS title, s_suppkey % 7 = 0 AS is_pull FROM supplier)"


@query(
    f", {_refs_sql(_bare('message'), _OWN, _PULL, 'commits', 'm')}, {_ISSUES}, f AS (SELECT doc_id, list_concat(closing, plain)[1:5] AS refs FROM m), e AS (SELECT doc_id, unnest(refs) AS number, unnest(range(len(refs))) AS place FROM f)"
    " SELECT e.doc_id, list(i.number ORDER BY place) AS numbers, list(i.title ORDER BY place) AS titles FROM e JOIN issues i ON e.number = i.number WHERE NOT i.is_pull GROUP BY 1",
    (COMMITS_SQL,),
)
def ctx_issues(spark, d):
    """The first five references, closing ones first, with the issues found; pull requests among them are dropped."""
    issues = table(spark, d, "supplier").select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("title")).filter("number % 7 <> 0")
    refs = commits(spark, d).select("doc_id", F.posexplode(F.slice(_message_refs(), 1, 5)).alias("place", "ref")).select("doc_id", "place", F.col("ref.number").alias("number"))
    met = refs.join(issues, "number").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "number", "title"))).alias("x"))
    return met.select("doc_id", F.transform("x", lambda v: v["number"]).alias("numbers"), F.transform("x", lambda v: v["title"]).alias("titles"))


_COMMENTS = """comments AS (SELECT conv_id AS pull, turn AS comment_id, 'f' || (turn % 3) || '.py' AS path, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn END AS line, turn + 100 AS original_line, text AS body FROM conversations)"""


def _comments(spark, d):
    t = F.col("turn")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("pull"), t.alias("comment_id"), F.concat(F.lit("f"), (t % 3).cast("string"), F.lit(".py")).alias("path"), F.when(t % 4 == 0, None).otherwise(t).alias("line"), (t + 100).alias("original_line"), F.col("text").alias("body"))


@query(f"WITH {_COMMENTS} SELECT pull, comment_id, coalesce(line, original_line) AS line, line IS NULL AND original_line IS NOT NULL AS outdated FROM comments")
def ref_review_comments(spark, d):
    """A comment's line is the original one where the file moved on, and it is outdated then."""
    return _comments(spark, d).select("pull", "comment_id", F.coalesce("line", "original_line").alias("line"), (F.col("line").isNull() & F.col("original_line").isNotNull()).alias("outdated"))


@query(
    f"WITH {_COMMENTS}, a AS (SELECT *, path = 'f1.py' AS here, max(CASE WHEN path = 'f1.py' THEN 1 ELSE 0 END) OVER (PARTITION BY pull) AS met FROM comments), b AS (SELECT *, row_number() OVER (PARTITION BY pull ORDER BY comment_id) AS place FROM a WHERE here OR met = 0)"
    " SELECT pull, list(comment_id ORDER BY place) AS comments FROM b WHERE place <= 50 GROUP BY 1"
)
def ctx_reviews(spark, d):
    """A pull request's comments on a file, or all of them where none is on it; the first 50 by id."""
    return same_file_comments(_comments(spark, d), "pull", "path", F.lit("f1.py"), "comment_id", 50)


_WINDOW = "(CASE WHEN min(yr) < 2015 THEN 2015 ELSE min(yr) END)"
_SAMPLES = """samples AS (SELECT doc_id, repo, substr(author_date, 1, 4)::INT AS yr, CASE WHEN author_type = 'Bot' OR coalesce(login, '') LIKE '%[bot]' THEN TRUE ELSE FALSE END AS bot, parents, merged_at IS NOT NULL AND pr_number IS NOT NULL AS via_pr,
  len(regexp_extract_all(message, '#[0-9]+')) > 0 AS refs FROM commits)"""


def _samples(spark, d):
    own = commits(spark, d)
    return own.select("doc_id", "repo", F.substring("author_date", 1, 4).cast("int").alias("yr"), is_bot(F.col("author_type"), F.col("login")).alias("bot"), "parents", (F.col("merged_at").isNotNull() & F.col("pr_number").isNotNull()).alias("via_pr"), (F.size(F.regexp_extract_all("message", F.lit("#([0-9]+)"), F.lit(1))) > 0).alias("refs"))


@query(f", {_SAMPLES} SELECT doc_id, bot FROM samples", (COMMITS_SQL,))
def flt_bot_commits(spark, d):
    return _samples(spark, d).select("doc_id", "bot")


@query(
    f", {_SAMPLES}, p AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS place FROM samples QUALIFY place <= 5 * 6), q AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS n FROM p WHERE NOT bot AND parents = 1 QUALIFY n <= 6)"
    " SELECT repo, count(*) AS n, avg(via_pr::INT) AS pr_ratio, avg(refs::INT) AS ref_ratio FROM q GROUP BY 1",
    (COMMITS_SQL,),
)
def sel_recent_sample(spark, d):
    """The first six human commits with one parent among at most thirty of each repository, and their ratios."""
    first = lambda df, k: df.withColumn("_n", F.row_number().over(W.partitionBy("repo").orderBy("doc_id"))).filter(F.col("_n") <= k).drop("_n")
    taken = first(first(_samples(spark, d), 30).filter("NOT bot AND parents = 1"), 6)
    return sample_ratios(taken, ["repo"], F.col("via_pr"), F.col("refs"))


@query(
    f", {_SAMPLES}, h AS (SELECT *, row_number() OVER (PARTITION BY repo, yr ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY repo, yr) AS n FROM samples WHERE NOT bot AND parents = 1),"
    " y AS (SELECT * FROM h WHERE n <= 3 OR i IN (0, round_even((n - 1) / 2.0, 0), n - 1)), w AS (SELECT repo, CASE WHEN min(yr) < 2015 THEN 2015 ELSE min(yr) END AS since, min(yr) < 2015 AS recent_only FROM samples GROUP BY 1),"
    " t AS (SELECT y.repo, yr, count(*) AS n, count(*) FILTER (via_pr) AS linked FROM y GROUP BY ALL)"
    " SELECT w.repo, w.since, w.recent_only, sum(n)::BIGINT AS all_n, coalesce(sum(n) FILTER (yr >= since), 0)::BIGINT AS window_n, sum(linked) / sum(n) AS all_ratio, sum(linked) FILTER (yr >= since) / sum(n) FILTER (yr >= since) AS window_ratio,"
    " string_agg(yr || ':' || linked || '/' || n, '|' ORDER BY yr) AS by_year FROM w JOIN t ON w.repo IS NOT DISTINCT FROM t.repo GROUP BY ALL",
    (COMMITS_SQL,),
)
def sel_history(spark, d):
    """Mining window by the first commit's year, and ratios of pull requests of a spread sample of each year."""
    own = _samples(spark, d)
    recent, since = mining_window(F.min("yr"))
    windows = own.groupBy("repo").agg(since.alias("since"), recent.alias("recent_only"))
    years = spread_by(own.filter("NOT bot AND parents = 1"), ["repo", "yr"], F.col("doc_id"), 3).groupBy("repo", "yr").agg(F.count("*").alias("n"), F.count_if("via_pr").alias("linked"))
    met = years.join(windows.withColumnRenamed("repo", "r"), F.col("repo").eqNullSafe(F.col("r")))
    inside = lambda c: F.sum(F.when(F.col("yr") >= F.col("since"), F.col(c)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("yr", "linked", "n"))), lambda x: F.concat(x["yr"].cast("string"), F.lit(":"), x["linked"].cast("string"), F.lit("/"), x["n"].cast("string"))), "|")
    return met.groupBy("repo", "since", "recent_only").agg(F.sum("n").alias("all_n"), F.coalesce(inside("n"), F.lit(0)).alias("window_n"), (F.sum("linked") / F.sum("n")).alias("all_ratio"), (inside("linked") / inside("n")).alias("window_ratio"), text.alias("by_year"))


@query(
    """, r AS (SELECT c_custkey AS repo, c_custkey % 5 = 0 AS archived, c_custkey % 7 = 0 AS fork, CASE WHEN c_custkey % 3 = 0 THEN 'Go' WHEN c_custkey % 11 = 0 THEN NULL ELSE 'PYTHON' END AS language, CASE WHEN c_custkey % 4 = 0 THEN 'GPL-3.0' WHEN c_custkey % 13 = 0 THEN NULL ELSE ' mit ' END AS license,
    '<https://x?page=2>; rel="next", <https://x?per_page=1&page=' || (c_custkey * 9) || '>; rel="last"' AS link, c_custkey % 23 AS sampled FROM customer), n AS (SELECT *, regexp_extract(link, '[?&]page=([0-9]+)>;\\s*rel="last"', 1)::INT AS commits FROM r)
    SELECT repo, commits, CASE WHEN archived THEN 'ARCHIVED' WHEN fork THEN 'FORK' WHEN lower(coalesce(language, '')) <> 'python' THEN 'LANGUAGE_NOT_PYTHON:' || coalesce(language, 'unknown') WHEN license IS NULL OR lower(trim(license)) NOT IN ('mit', 'apache-2.0') THEN 'LICENSE_NOT_PERMISSIVE:' || coalesce(license, 'none')
    WHEN commits < 1000 THEN 'COMMITS_BELOW_1000:' || commits WHEN sampled = 0 THEN 'NO_RECENT_COMMITS' END AS excluded, CASE WHEN commits <= 1000 THEN 0.0 ELSE least(1.0, log10(commits / 1000.0) / log10(50.0)) END::DOUBLE AS scale FROM n""".replace(", r AS", "WITH r AS", 1)
)
def sel_exclusion(spark, d):
    """Why a repository is left out, by the first rule that holds; its commits come from a paging header."""
    k = F.col("c_custkey")
    language, license = F.when(k % 3 == 0, "Go").when(k % 11 == 0, None).otherwise("PYTHON"), F.when(k % 4 == 0, "GPL-3.0").when(k % 13 == 0, None).otherwise(" mit ")
    link = F.concat(F.lit('<https://x?page=2>; rel="next", <https://x?per_page=1&page='), (k * 9).cast("string"), F.lit('>; rel="last"'))
    own = table(spark, d, "customer").select(k.alias("repo"), commit_count(link, F.lit(0)).alias("commits"), language.alias("language"), license.alias("license"))
    k = F.col("repo")
    return own.select("repo", "commits", excluded_by(k % 5 == 0, k % 7 == 0, F.col("language"), F.col("license"), F.col("commits"), k % 23).alias("excluded"), saturated_scale(F.col("commits")).alias("scale"))


@query(
    """, y AS (SELECT repo, substr(author_date, 1, 4)::INT AS yr, count(*) AS sampled, count(*) * 7 AS total, count(*) FILTER (parents = 1) AS nonmerge, coalesce(sum(additions + deletions) FILTER (parents = 1), 0)::BIGINT AS churn, count(*) FILTER (parents = 1 AND changed_files >= 50) AS bulk,
    coalesce(sum(additions + deletions) FILTER (parents = 1 AND changed_files >= 50), 0)::BIGINT AS bulk_churn, count(*) FILTER (parents = 1 AND pr_number IS NOT NULL AND merged_at IS NOT NULL) AS linked, count(DISTINCT CASE WHEN parents = 1 AND merged_at IS NOT NULL THEN pr_number END) AS prs FROM commits GROUP BY ALL)
    SELECT repo, sum(total)::BIGINT AS commits_all, sum(nonmerge)::BIGINT AS sampled, sum(total * nonmerge / sampled) AS walk, sum(total * bulk / sampled) / sum(total * nonmerge / sampled) AS bulk_share, sum(bulk_churn) / sum(churn) AS bulk_churn_share, sum(churn) / sum(nonmerge) AS churn_mean,
    sum(total * linked / sampled) / sum(total * nonmerge / sampled) AS linked_share, CASE WHEN sum(linked) > 0 THEN sum(prs) / sum(linked) END AS prs_per_linked, round(sum(total * nonmerge / sampled) * 0.3 * (1 + sum(total * linked / sampled) / sum(total * nonmerge / sampled) + 0.25))::BIGINT AS calls FROM y GROUP BY 1""",
    (COMMITS_SQL,),
)
def sel_window_estimate(spark, d):
    """Yearly samples of commits, merges left out, weighed up to all commits of their years; calls that they would cost."""
    one, linked = F.col("parents") == 1, F.col("pr_number").isNotNull() & F.col("merged_at").isNotNull()
    churn, bulk = F.col("additions") + F.col("deletions"), F.col("changed_files") >= 50
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    years = commits(spark, d).groupBy("repo", F.substring("author_date", 1, 4).alias("yr")).agg(
        F.count("*").alias("sampled"), (F.count("*") * 7).alias("total"), F.count_if(one).alias("nonmerge"), total(one, churn).alias("churn"), F.count_if(one & bulk).alias("bulk"), total(one & bulk, churn).alias("bulk_churn"), F.count_if(one & linked).alias("linked"), F.count_distinct(F.when(one & F.col("merged_at").isNotNull(), F.col("pr_number"))).alias("prs"),
    )
    weighed = lambda c: F.sum(F.col("total") * F.col(c) / F.col("sampled"))
    ratio = lambda a, b: F.when(b != 0, a / b)
    found = years.groupBy("repo").agg(F.sum("total").alias("commits_all"), F.sum("nonmerge").alias("sampled"), weighed("nonmerge").alias("walk"), ratio(weighed("bulk"), weighed("nonmerge")).alias("bulk_share"), ratio(F.sum("bulk_churn"), F.sum("churn")).alias("bulk_churn_share"), ratio(F.sum("churn"), F.sum("nonmerge")).alias("churn_mean"), ratio(weighed("linked"), weighed("nonmerge")).alias("linked_share"), ratio(F.sum("prs"), F.sum("linked")).alias("prs_per_linked"))
    return found.select("*", api_calls(F.col("walk"), F.col("linked_share"), F.lit(0.25), 0.3).alias("calls"))


@query("SELECT repo, count(*) FILTER (file_path LIKE '%.py') AS files, coalesce(sum(n_chars) FILTER (file_path LIKE '%.py'), 0)::BIGINT AS bytes, coalesce(max(n_chars) FILTER (file_path LIKE '%.py'), 0) AS largest FROM commits GROUP BY 1", (COMMITS_SQL,))
def sel_tree_summary(spark, d):
    own = F.when(F.endswith("file_path", F.lit(".py")), F.col("n_chars"))
    return commits(spark, d).groupBy("repo").agg(F.count(own).alias("files"), F.coalesce(F.sum(own), F.lit(0)).alias("bytes"), F.coalesce(F.max(own), F.lit(0)).alias("largest"))


@query(
    "SELECT count(*) FILTER (pr_number IS NOT NULL) / count(*) AS pull, count(*) FILTER (len(regexp_extract_all(message, '#[0-9]+')) > 0) / count(*) AS issue, count(*) FILTER (pr_body IS NOT NULL) / count(*) AS review, count(*) FILTER (pr_number IS NOT NULL OR pr_body IS NOT NULL OR len(regexp_extract_all(message, '#[0-9]+')) > 0) / count(*) AS some FROM commits",
    (COMMITS_SQL,),
)
def agg_context_rates(spark, d):
    """Shares of records with a pull request, an issue, a review, and any of them."""
    pull, issue, review = F.col("pr_number").isNotNull(), F.size(F.regexp_extract_all("message", F.lit("#([0-9]+)"), F.lit(1))) > 0, F.col("pr_body").isNotNull()
    rate = lambda c: F.count_if(c) / F.count("*")
    return commits(spark, d).agg(rate(pull).alias("pull"), rate(issue).alias("issue"), rate(review).alias("review"), rate(pull | issue | review).alias("some"))
