"""Keyword search over a stored index: six weighted columns, facets, pages, snippets, counts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.text import first_line
from codestrata.operators.index import COUNT_CAP, Index, best_snippet, check_filters, compile_query, hits, write_index
from codestrata.plans.registry import query
from codestrata.sources.adapters import table
from codestrata.sources.domain import COMMITS_SQL, commits
from codestrata.sources.files import exists, version_of, work_folder

COLUMNS = ("function_name", "file_path", "message", "pr_title", "pr_body", "body")
FACET_FIELDS = ("repo", "deletion_kind", "filter_status", "year")
_OPEN: dict[tuple[str, str], Index] = {}


def _stored(spark, d: str, name: str, tables: tuple[str, ...], rows, **options) -> Index:
    """The index of that name over a directory's tables, below the shared folder, whichever application wrote it.

    Its folder is named after the tables' files and their times, so tables that are written anew get a new index.
    """
    folder = f"{work_folder(spark)}/index-{name}-{version_of(spark, *(f'{d}/{t}.parquet' for t in tables))}"
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        if not exists(spark, folder):
            write_index(rows, folder, **options)
        _OPEN[key] = Index(spark, folder)
    return _OPEN[key]


def record_index(spark, d: str) -> Index:
    """The six columns and the facets of all records."""
    rows = commits(spark, d).withColumn("year", F.expr("try_cast(substring(author_date, 1, 4) AS INT)"))
    return _stored(spark, d, "records", ("documents",), rows, key="doc_id", columns=COLUMNS, facets=FACET_FIELDS)


def body_index(spark, d: str) -> Index:
    """Repositories and bodies of deletions; what their labels add isn't searched, so nothing is joined."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("repo"), F.col("text").alias("body"))
    return _stored(spark, d, "bodies", ("documents",), rows, key="doc_id", columns=("repo", "body"))


_TOKENS = "list_filter(regexp_extract_all(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_WEIGHTS = (10, 4, 3, 3, 2, 1)


def _records_sql() -> str:
    lists = ", ".join(_TOKENS.format(f"coalesce({c}, '')") + f" AS t{i}" for i, c in enumerate(COLUMNS))
    return f""", ix AS (SELECT doc_id, repo, deletion_kind, filter_status, substr(author_date, 1, 4)::INT AS yr, {lists} FROM commits),
    il AS (SELECT *, {' + '.join(f'len(t{i})' for i in range(6))} + (repo IS NOT NULL)::INT + 3 AS length FROM ix), s AS (SELECT count(*) AS n, avg(length) AS mean FROM il)"""


def _count(words: list[str], prefix: bool) -> str:
    parts = []
    for i, w in enumerate(_WEIGHTS):
        test = " AND ".join(f"t{i}[p + {j}] = '{x}'" if not (prefix and j == len(words) - 1) else f"starts_with(t{i}[p + {j}], '{x}')" for j, x in enumerate(words))
        parts.append(f"{w} * len(list_filter(range(1, len(t{i}) + 1), lambda p: coalesce({test}, false)))")
    return "(" + " + ".join(parts) + ")::DOUBLE"


def _scored_sql(text: str, facets: dict[str, str] | None = None, years: tuple[int, int] | None = None) -> str:
    """Scores by the closed form, phrase by phrase, over whole rows."""
    phrases = compile_query(text)
    counts = [_count(w, p) for w, p in phrases] + [f"({f} = '{v}')::INT::DOUBLE" for f, v in (facets or {}).items()]
    cols = ", ".join(f"{c} AS f{i}" for i, c in enumerate(counts))
    idf = "CASE WHEN ln((n - {m} + 0.5) / ({m} + 0.5)) > 0 THEN ln((n - {m} + 0.5) / ({m} + 0.5)) ELSE 1e-6 END"
    part = "({i}) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * length / mean))"
    found = ", ".join(f"count(*) FILTER (f{i} > 0) AS m{i}" for i in range(len(counts)))
    sums = " + ".join(part.format(i=idf.format(m=f"m{i}"), f=f"f{i}") for i in range(len(counts)))
    year = ", y AS (SELECT yr, count(*) AS my FROM il GROUP BY 1)" if years else ""
    if years:
        sums += " + " + part.format(i=idf.format(m="my"), f="1.0")
    met = " AND ".join(f"f{i} > 0" for i in range(len(counts))) or "true"
    return f"{_records_sql()}, f AS (SELECT *, {cols} FROM il), g AS (SELECT {found} FROM f){year}, scored AS (SELECT doc_id, -({sums}) AS score FROM f, g, s{', y' if years else ''} WHERE {met}{f' AND f.yr = y.yr AND f.yr BETWEEN {years[0]} AND {years[1]}' if years else ''})"


_TEXT = "crash fix*"


@query(f"{_scored_sql(_TEXT)} SELECT row_number() OVER (ORDER BY score, doc_id) AS rank, doc_id AS doc, round(score, 6) AS score FROM scored QUALIFY rank > 5 AND rank <= 25", (COMMITS_SQL,))
def index_page(spark, d):
    """A page of hits: all phrases match, the last one is a prefix."""
    return record_index(spark, d).page(_TEXT, 20, 5).withColumn("score", F.round("score", 6))


@query(f"{_scored_sql('make_thing')} SELECT row_number() OVER (ORDER BY score, doc_id) AS rank, doc_id AS doc, round(score, 6) AS score FROM scored QUALIFY rank <= 30", (COMMITS_SQL,))
def index_phrase(spark, d):
    """A name of two tokens is a phrase."""
    return record_index(spark, d).page("make_thing", 30).withColumn("score", F.round("score", 6))


@query(f"{_scored_sql('unused', {'deletion_kind': 'PARTIAL', 'filter_status': 'KEPT'}, (2011, 2018))} SELECT doc_id AS doc, round(score, 6) AS score FROM scored ORDER BY scored.score, doc_id LIMIT 20", (COMMITS_SQL,))
def index_facets(spark, d):
    """Facets and a range of years weigh in as phrases do; years are ORed."""
    found = record_index(spark, d).scores("unused", facets=(("deletion_kind", "PARTIAL"), ("filter_status", "KEPT")), years=(2011, 2018))
    return found.orderBy("score", "doc").limit(20).select("doc", F.round("score", 6).alias("score"))


@query(f"{_scored_sql('fix')} SELECT least(count(*), 50) AS n, count(*) > 50 AS capped FROM scored", (COMMITS_SQL,))
def index_capped_count(spark, d):
    """A count that stops at a cap, and whether it did (the cap of a service is 10,000)."""
    return record_index(spark, d).capped_count("fix", 50)


@query(f"{_scored_sql('prose OR fix')} SELECT least(count(*), {COUNT_CAP}) AS n, count(*) > {COUNT_CAP} AS capped FROM scored", (COMMITS_SQL,))
def index_count(spark, d):
    """Syntax of other engines is plain words here: all three must match."""
    return record_index(spark, d).capped_count("prose OR fix")


@query(
    f"{_scored_sql('security sanitize')}, p AS (SELECT row_number() OVER (ORDER BY score, doc_id) AS rank, doc_id, score FROM scored QUALIFY rank <= 10) SELECT p.rank, p.doc_id AS doc, c.repo, c.function_name, c.file_path, CASE WHEN trim(c.message) <> '' THEN split_part(trim(c.message), chr(10), 1) END AS subject FROM p JOIN commits c ON p.doc_id = c.doc_id",
    (COMMITS_SQL,),
)
def index_hits(spark, d):
    """Hits with their records' columns, by rank."""
    index = record_index(spark, d)
    rows = commits(spark, d).select("doc_id", "repo", "function_name", "file_path", first_line(F.col("message")).alias("subject"))
    return hits(index.page("security sanitize", 10), rows, "doc_id", ("repo", "function_name", "file_path", "subject")).select("rank", "doc", "repo", "function_name", "file_path", "subject")


@query()
def index_snippets(spark, d):
    """Snippets of a page's hits: the first column that has a word of the query, marked."""
    phrases = compile_query("unused helper")
    page = record_index(spark, d).page("unused helper", 20)
    # The page's 20 rows go to the records, and only what they meet is cut to words.
    met = commits(spark, d).select(F.col("doc_id").alias("doc"), *COLUMNS).join(F.broadcast(page), "doc")
    return met.select("rank", "doc", best_snippet([F.col(c) for c in COLUMNS], phrases).alias("snippet"))


@query("SELECT doc_id, repo FROM commits ORDER BY doc_id LIMIT 20 OFFSET 40", (COMMITS_SQL,))
def index_listing(spark, d):
    """Without a query and filters: records by number."""
    return commits(spark, d).select("doc_id", "repo").orderBy("doc_id").offset(40).limit(20)


@query("SELECT doc_id, CASE WHEN pr_number IS NULL THEN NULL ELSE (SELECT count(*) FROM conversations v WHERE v.conv_id = c.doc_id) END AS comments FROM commits c WHERE doc_id < 60", (COMMITS_SQL,))
def index_detail(spark, d):
    """Records with their number of comments: null where the context was never joined, 0 where none was found."""
    counts = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    own = commits(spark, d).filter("doc_id < 60").join(counts, "doc_id", "left")
    return own.select("doc_id", F.when(F.col("pr_number").isNotNull(), F.coalesce("n", F.lit(0))).alias("comments"))


@query("SELECT list_sort(list(DISTINCT repo)) AS repos, list_sort(list(DISTINCT deletion_kind)) AS kinds, min(substr(author_date, 1, 4)::INT) AS first_year FROM commits", (COMMITS_SQL,))
def index_choices(spark, d):
    """What filters may ask for; a value that isn't there is an error and no empty page."""
    one = commits(spark, d).agg(F.array_sort(F.collect_set("repo")).alias("repos"), F.array_sort(F.collect_set("deletion_kind")).alias("kinds"), F.min(F.substring("author_date", 1, 4).cast("int")).alias("first_year"))
    row = one.first()
    check_filters({"kind": row.kinds}, {"kind": row.kinds[0]})
    return one


@query(
    f"{_scored_sql('unused')}, k AS (SELECT doc_id, 'keyword' AS mode, row_number() OVER (ORDER BY score, doc_id) AS rank FROM scored QUALIFY rank <= 10), v AS (SELECT doc_id, 'filter' AS mode, row_number() OVER (ORDER BY doc_id) AS rank FROM commits WHERE message LIKE '%unused%' QUALIFY rank <= 10),"
    " u AS (SELECT doc_id, min(CASE WHEN mode = 'keyword' THEN rank END) AS keyword_rank, min(CASE WHEN mode = 'filter' THEN rank END) AS filter_rank FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY 1) SELECT doc_id, keyword_rank, filter_rank, row_number() OVER (ORDER BY sha256('blind:' || doc_id), doc_id) AS place FROM u",
    (COMMITS_SQL,),
)
def index_blind_sheet(spark, d):
    """The first ten hits of two modes together, each once, in an order that tells nothing of the modes."""
    one = record_index(spark, d).page("unused", 10).select(F.col("doc").alias("doc_id"), F.col("rank").alias("keyword_rank"))
    other = commits(spark, d).filter(F.contains("message", F.lit("unused"))).select("doc_id").orderBy("doc_id").limit(10).withColumn("filter_rank", F.row_number().over(W.orderBy("doc_id")))
    both = one.join(other, "doc_id", "full_outer")
    return both.withColumn("place", F.row_number().over(W.orderBy(F.sha2(F.concat(F.lit("blind:"), F.col("doc_id").cast("string")), 256), "doc_id")))
