"""A stored inverted index: built once, ranged by token, read by queries in the files and row groups of their tokens only."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.text import FOLDED, bind, plain
from codestrata.sources.files import publish, remove

#: Fixed values of the ranking function, weights of six columns in their order, and the most hits that are counted.
K1, B, FLOOR = 1.2, 0.75, 1e-6
WEIGHTS = (10.0, 4.0, 3.0, 3.0, 2.0, 1.0)
COUNT_CAP = 10_000
#: Marks around what was found, and words of a snippet.
OPEN, CLOSE, CUT, WINDOW = "\x02", "\x03", "…", 16
#: Bytes of text for each file of an index, and bytes of a row group, within which pages have bounds of their own.
FILE_BYTES, GROUP_BYTES = 32 << 20, 8 << 20
#: The column of facet tokens comes after the others; a column has less than PLACES tokens.
FACETS, PLACES = 6, 1 << 28


class FilterError(ValueError):
    """A filter asks for a value that the index doesn't have: an error, not an empty result."""


def compile_query(text: str) -> list[tuple[list[str], bool]]:
    """Phrases (tokens; whether the last one is a prefix), one for each chunk with a letter or digit; all must match."""
    out = []
    for chunk in text.split():
        words = re.findall(r"[^\W_]+", chunk.rstrip("*").lower())
        if words:
            out.append((words, chunk.endswith("*")))
    return out


def facet(field: str, value) -> str:
    """One token for a field's value; years stay readable, so ranges can be listed."""
    return f"year{int(value)}" if field == "year" else f"{field}={value}"


def index_files(df: DataFrame, columns: Sequence[str]) -> int:
    """How many files an index of these columns should have: one for each FILE_BYTES of text, as measured."""
    size = df.agg(sum((F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in columns), F.lit(0))).first()[0]
    return max(1, -(-size // FILE_BYTES))


def _class(kinds: str, end: int) -> str:
    """A class of a pattern: all characters from 0x80 to below ``end`` whose category begins with one of ``kinds``."""
    out, start = [], None
    for i in range(0x80, end + 1):
        # Surrogates are no text, and one more place ends the last range.
        there = i < end and not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)).startswith(tuple(kinds.split()))
        if there and start is None:
            start = i
        elif not there and start is not None:
            out.append(f"{chr(start)}-{chr(i - 1)}" if i - 1 > start else chr(start))
            start = None
    return "".join(out)


class _Tokens(dict):
    """Numbers of a block's tokens by their words; marks over letters go once for each different word."""

    words, far = re.compile(r"[a-z0-9]+"), re.compile("[\U00010000-\U0010ffff]")
    # A set within 16 bits is a table, a wider one has ranges that are tried one by one.
    near, wide = ((re.compile(f"[a-z0-9{_class('L N Co', end)}]+"), re.compile(f"[{_class('Mn', end)}]+")) for end in (0x10000, 0x110000))
    letters = str.maketrans(FOLDED)

    def __init__(self):
        super().__init__()
        self.names: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        self[word] = found = self.names.setdefault(word if word.isascii() else word.translate(self.letters), len(self.names))
        return found

    @classmethod
    def cut(cls, text: str | None) -> list[str]:
        """What ``tokens`` gives, but for the marks that are part of a letter."""
        if not text:
            return []
        if text.isascii():
            return cls.words.findall(text.lower())
        words, marks = cls.wide if cls.far.search(text) else cls.near
        return words.findall(marks.sub("", text.lower()))


def _postings(rows: int = 4096, most: int = 2_000_000) -> Callable:
    """A task's part of an index: for each token of a block of rows those that have it, by their numbers, with their places.

    Rows have a document, its texts and a list of its facet tokens.  Texts come whole and are cut to words here, and all
    that is kept of a word is its number in the block, so neither words nor their places pass between Spark and Python.
    ``entries`` has a row's places (column * PLACES + place) up to its number in ``ends``.  A row without a token tells the
    documents of a block and their lengths: flat arrays of small numbers keep what is dealt small.  A block ends after
    ``rows`` rows or before ``most`` tokens (a longer row is one by itself), which bounds a worker's memory.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, told, stop, ahead = batch.columns[1:-1], batch.column(batch.num_columns - 1), 0, None
            while stop < len(batch):
                start, known, codes, sizes, of = stop, _Tokens(), [], [], []
                total = 0
                while stop < len(batch) and stop - start < rows:
                    own = ahead or [_Tokens.cut(t[stop].as_py()) for t in texts]
                    facets = [known.names.setdefault(x, len(known.names)) for x in told[stop].as_py() or ()]
                    n, ahead = sum(map(len, own)) + len(facets), None
                    if total + n > most and stop > start:
                        ahead = own
                        break
                    for i, words in enumerate(own):
                        if words:
                            codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                            sizes.append(len(words))
                            of.append((stop - start, i))
                    if facets:
                        codes.append(np.array(facets, np.int32))
                        sizes.append(len(facets))
                        of.append((stop - start, FACETS))
                    total, stop = total + n, stop + 1
                doc, size = batch.column(0).slice(start, stop - start), np.array(sizes, np.int64)
                at, column = np.array(of, np.int64).reshape(-1, 2).T
                code = np.concatenate([*codes, np.zeros(0, np.int32)])
                entry = (np.repeat(column * PLACES - (np.cumsum(size) - size), size) + np.arange(len(code))).astype(np.int32)
                row = np.repeat(at, size)
                length = np.bincount(row, minlength=len(doc)).astype(np.int32)
                order = np.argsort(code, kind="stable")  # rows and places stay in order within a token
                row, code, entry = row[order], code[order], entry[order]
                new_token = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
                heads = np.flatnonzero(new_token | np.r_[True, row[1:] != row[:-1]]) if len(code) else np.zeros(0, np.int64)
                tokens_at = np.flatnonzero(new_token[heads])  # of postings
                bounds = np.r_[tokens_at, len(heads)].astype(np.int32)
                ends = (np.r_[heads[1:], len(code)] - np.repeat(heads[tokens_at], np.diff(bounds))).astype(np.int32)
                n = len(tokens_at)
                listed = lambda at, values: pa.ListArray.from_arrays(pa.array(np.asarray(at, np.int32)), values)
                found = [pa.array(known.names, pa.string()).take(pa.array(code[heads[tokens_at]])), pa.array(np.full(n, block)), listed(bounds, pa.array(row[heads].astype(np.int16))), listed(bounds, pa.array(ends)), listed(np.r_[heads[tokens_at], len(code)], pa.array(entry))]
                names = ["token", "block", "rows", "ends", "entries", "docs", "lengths"]
                none = lambda kind: pa.nulls(n, pa.list_(kind))
                yield pa.RecordBatch.from_arrays([*found, none(doc.type), none(pa.int32())], names)
                yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([block]), *[pa.nulls(1, x.type) for x in found[2:]], listed([0, len(doc)], doc), listed([0, len(doc)], pa.array(length))], names)
                block += 1

    return group


def write_index(df: DataFrame, folder: str, *, key: str, columns: Sequence[str], facets: Sequence[str] = (), files: int | None = None) -> None:
    """Postings of the columns (weights go by their place) and of facet tokens, and a row of totals.

    A row has a token's documents of one block and their places, so a token is dealt once a block.  Rows are ranged by
    token and block and lie sorted in small row groups and pages with their bounds, so a token, or a prefix, is found by
    skipping, and a frequent token is spread over several files.  Blocks' own rows come first.  Everything is built aside
    and then put in place as a whole.
    """
    told = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.concat(F.lit("year" if f == "year" else f"{f}="), F.col(f).cast("string"))) for f in facets])) if facets else F.array().cast("array<string>")
    each = df.select(F.col(key).alias("doc"), *[F.make_valid_utf8(F.col(c).cast("string")).alias(f"text{i}") for i, c in enumerate(columns)], told.alias("told"))
    kind = dict(each.dtypes)["doc"]
    postings = each.mapInArrow(_postings(), f"token string, block long, rows array<smallint>, ends array<int>, entries array<int>, docs array<{kind}>, lengths array<int>")
    aside = f"{folder}.{uuid.uuid4().hex}"
    # Written before they are dealt: ranges are sampled and totals added up from there, so texts are cut to tokens once.
    spark, blocks = df.sparkSession, f"{aside}.blocks"
    try:
        postings.write.option("compression", "zstd").parquet(blocks)
        made = spark.read.parquet(blocks)
        dealt = made.repartitionByRange(files or index_files(df, columns), "token", "block").sortWithinPartitions("token", "block")
        dealt.write.option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(f"{aside}/postings")
        lengths = F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x))
        totals = made.filter("token = ''").agg(F.coalesce(F.sum(F.size("docs").cast("long")), F.lit(0)).alias("n"), lengths.alias("length"))
        totals.select("n", F.when(F.col("n") > 0, F.col("length") / F.col("n")).alias("mean")).write.parquet(f"{aside}/totals")
    finally:
        remove(spark, blocks)
    publish(spark, aside, folder)


class Index:
    """An index to search; its totals, one row, are read once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.postings = spark.read.parquet(f"{folder}/postings")
        self.n, self.mean = spark.read.parquet(f"{folder}/totals").select("n", "mean").first()

    def matches(self, phrases: Sequence[tuple[Sequence[str], bool]], weights: Sequence[float], within: Sequence[int] | None = None) -> DataFrame:
        """(doc, phrase, length, f): weighted counts of each phrase in each document that has it.

        A phrase matches where its tokens stand at consecutive places of one column: each token votes for the phrase's
        start, and a start needs all votes.
        """
        tests, wanted = [], []
        for i, (words, prefix) in enumerate(phrases):
            for j, word in enumerate(words):
                hit = F.startswith("token", F.lit(word)) if prefix and j == len(words) - 1 else F.col("token") == word
                tests.append(hit)
                wanted.append(F.when(hit, F.struct(F.lit(i).alias("phrase"), F.lit(j).alias("at"), F.lit(len(words)).alias("size"))))
        own = self.each(reduce(or_, tests)).withColumn("entries", self.within("entries", within))
        table = F.array(*[F.lit(float(w)) for w in (*weights, *[1.0] * (FACETS + 1 - len(weights)))])
        weight = lambda e: F.get(table, F.floor(e / PLACES).cast("int"))
        if all(len(words) == 1 for words, _ in phrases):
            w = F.aggregate("entries", F.lit(0.0), lambda x, e: x + weight(e))
            votes = own.filter(F.size("entries") > 0).select("doc", "length", w.alias("w"), F.explode(F.array_compact(F.array(*wanted))).alias("v"))
            return votes.groupBy("doc", F.col("v.phrase").alias("phrase")).agg(F.first("length").alias("length"), F.sum("w").alias("f"))
        votes = own.select("doc", "length", "entries", F.explode(F.array_compact(F.array(*wanted))).alias("v")).select("doc", "length", "v", F.explode("entries").alias("e"))
        # A place less its place in the phrase is the phrase's start, in the same column or, before its begin, nowhere.
        starts = votes.groupBy("doc", "v.phrase", "v.size", F.floor(F.col("e") / PLACES).alias("column"), (F.col("e") - F.col("v.at")).alias("start")).agg(F.count("*").alias("votes"), F.first("length").alias("length"))
        return starts.filter("votes = size").withColumn("w", F.get(table, F.col("column").cast("int"))).groupBy("doc", "phrase").agg(F.first("length").alias("length"), F.sum("w").alias("f"))

    def each(self, condition: Column | None = None) -> DataFrame:
        """(token, doc, length, entries) of the tokens that meet a condition: a row for each document.

        A block's documents, some thousand, are joined to what was found in it.
        """
        own = self.postings.filter(F.col("token") != "") if condition is None else self.postings.filter(condition)
        blocks = self.postings.filter(F.col("token") == "").select("block", "docs", "lengths")
        met = own.select("token", "block", "rows", "ends", "entries").join(blocks, "block")
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
        posting = F.transform("rows", lambda r, i: F.struct(F.get("docs", r.cast("int")).alias("doc"), F.get("lengths", r.cast("int")).alias("length"), F.slice("entries", begin(i) + 1, F.get("ends", i) - begin(i)).alias("entries")))
        return met.select("token", F.explode(posting).alias("x")).select("token", "x.doc", "x.length", "x.entries")

    @staticmethod
    def within(entries: str, columns: Sequence[int] | None) -> Column:
        """The entries of some columns."""
        return F.col(entries) if columns is None else F.filter(entries, lambda e: F.floor(e / PLACES).isin(*columns))

    def scores(self, text: str, weights: Sequence[float] = WEIGHTS, *, facets: Sequence[tuple[str, object]] = (), years: tuple[int, int] | None = None, facet_scoring: bool = True) -> DataFrame:
        """(doc, score) of the documents with all phrases, facets and a year of the range; less is better.

        With ``facet_scoring`` facets weigh in like phrases of weight 1, as in an index that has them in its text.
        """
        phrases = compile_query(text)
        found = self.matches(phrases, weights, range(FACETS)) if phrases else None
        terms = [[facet(f, v)] for f, v in facets] + ([[facet("year", y) for y in range(years[0], years[1] + 1)] or ["year0"]] if years else [])
        if terms:
            listed = [(i, t) for i, group in enumerate(terms, len(phrases)) for t in group]
            number = reduce(lambda c, x: c.when(F.col("token") == x[1], x[0]), listed[1:], F.when(F.col("token") == listed[0][1], listed[0][0]))
            own = self.each(F.col("token").isin(*[t for _, t in listed])).filter(F.size(self.within("entries", [FACETS])) > 0)
            # Years of a range are one condition, but each has its own rarity.
            by_facet = own.select("doc", number.alias("phrase"), "length", F.lit(1.0).alias("f"), "token")
            found = by_facet if found is None else found.withColumn("token", F.col("phrase").cast("string")).select("doc", "phrase", "length", "f", "token").unionByName(by_facet)
        else:
            found = found.withColumn("token", F.col("phrase").cast("string"))
        # One row for each phrase or facet value that is asked for.
        rarity = found.groupBy("token").agg(F.count("*").alias("m"))
        each = found.join(F.broadcast(rarity), "token")
        rare = F.log((F.lit(self.n) - F.col("m") + 0.5) / (F.col("m") + 0.5))
        part = F.when(rare > 0, rare).otherwise(FLOOR) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.lit(self.mean)))
        counted = part if facet_scoring else F.when(F.col("phrase") < len(phrases), part).otherwise(0.0)
        asked = len(phrases) + len(terms)
        # Added phrase by phrase, so that documents alike have the very same score, however rows arrive.
        parts = each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("phrase", "token", counted.alias("part")))).alias("parts"))
        met = parts.filter(F.size(F.array_distinct(F.col("parts.phrase"))) == asked)
        return met.select("doc", (-F.aggregate("parts", F.lit(0.0), lambda x, p: x + p["part"])).alias("score"))

    def page(self, text: str, limit: int, offset: int = 0, **options) -> DataFrame:
        """(rank, doc, score): one page of hits, the best first, ties by document."""
        best = self.scores(text, **options).orderBy("score", "doc").limit(offset + limit)  # a page's worth of rows
        ranked = best.withColumn("rank", F.row_number().over(W.orderBy("score", "doc")))
        return ranked.filter(F.col("rank") > offset).select("rank", "doc", "score")

    def capped_count(self, text: str, cap: int = COUNT_CAP, **options) -> DataFrame:
        """(n, capped): the number of hits up to a cap, and whether there are more."""
        some = self.scores(text, **options).limit(cap + 1).agg(F.count("*").alias("c"))
        return some.select(F.least("c", F.lit(cap)).alias("n"), (F.col("c") > cap).alias("capped"))


def check_filters(choices: dict[str, Sequence[str]], asked: dict[str, str | None]) -> None:
    for name, value in asked.items():
        if value and name in choices and value not in choices[name]:
            raise FilterError(f"{name}={value!r} isn't one of {len(choices[name])} choices")


def hits(page: DataFrame, records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The page's records with their ranks; a hit without a record is an error."""
    met = page.join(records.select(F.col(key).alias("doc"), F.lit(True).alias("_there"), *columns), "doc", "left")
    return met.withColumn("doc", F.when(F.col("_there").isNull(), F.raise_error(F.lit("a hit has no record"))).otherwise(F.col("doc"))).drop("_there")


def best_snippet(texts: Sequence[Column], phrases: Sequence[tuple[Sequence[str], bool]], window: int = WINDOW) -> Column:
    """Up to ``window`` words of the first text that has a phrase's first word, with marks around what matches.

    Meant for a page of hits: words are compared one by one.
    """
    heads = [(words[0], prefix and len(words) == 1) for words, prefix in phrases]

    def matched(w: Column) -> Column:
        parts = F.split(plain(w), r"[^\p{L}\p{N}]+")
        whole, begun = [h for h, prefix in heads if not prefix], [h for h, prefix in heads if prefix]
        return F.exists(parts, lambda t: reduce(or_, [t.isin(*whole)] * bool(whole) + [F.startswith(t, F.lit(h)) for h in begun]))

    def of(text: Column) -> Column:
        words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))

        def shown(pair: Column) -> Column:
            at = F.array_position(pair["m"], True)
            start = F.greatest(F.lit(1), F.least(at - window // 2, F.size(pair["w"]) - window + 1)).cast("int")
            marked = F.zip_with(F.slice(pair["w"], start, F.lit(window)), F.slice(pair["m"], start, F.lit(window)), lambda w, m: F.when(m, F.concat(F.lit(OPEN), w, F.lit(CLOSE))).otherwise(w))
            told = F.concat(F.when(start > 1, CUT).otherwise(""), F.array_join(marked, " "), F.when(start + window <= F.size(pair["w"]), CUT).otherwise(""))
            return F.when(at > 0, told)

        return bind(words, lambda w: bind(F.struct(w.alias("w"), F.transform(w, matched).alias("m")), shown))

    return F.coalesce(*[of(t) for t in texts])
