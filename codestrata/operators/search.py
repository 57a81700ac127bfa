"""Keyword search by BM25 and vector search, as plans over postings and arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import plain, tokens
from codestrata.sources.files import work_folder

#: Fixed values of the ranking function and the weights of the indexed columns.
K1, B, FLOOR = 1.2, 0.75, 1e-6
WEIGHTS = {"repo": 10.0, "body": 2.0}


def compile_query(text: str) -> list[tuple[list[str], bool]]:
    """Phrases (tokens, last one is a prefix) of a query: one for each chunk that has a letter or digit; all must match."""
    out = []
    for chunk in text.split():
        words = re.findall(r"[^\W_]+", chunk.lower())
        if words:
            out.append((words, chunk.endswith("*")))
    return out


def bm25(df: DataFrame, key: str, text: str, columns: dict[str, float] | None = None) -> DataFrame:
    """Scores of the rows in which all phrases of a query match; less is better.

    Postings are cut to the query's tokens before anything is dealt.  A phrase matches where its tokens stand at
    consecutive places of one column: each token votes for the phrase's start, and a start needs all votes.
    """
    columns = columns or WEIGHTS
    phrases = compile_query(text)
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(w).alias("weight"), tokens(F.col(c)).alias("tokens")) for c, w in columns.items()])
    own = df.select(key, F.explode(listed).alias("x")).select(key, "x.column", "x.weight", F.posexplode("x.tokens").alias("place", "token"))
    wanted = []
    for i, (words, prefix) in enumerate(phrases):
        for j, word in enumerate(words):
            hit = F.startswith("token", F.lit(word)) if prefix and j == len(words) - 1 else F.col("token") == word
            wanted.append(F.when(hit, F.struct(F.lit(i).alias("phrase"), F.lit(j).alias("at"), F.lit(len(words)).alias("size"))))
    votes = own.select(key, "column", "weight", "place", F.explode(F.array_compact(F.array(*wanted))).alias("v"))
    starts = votes.groupBy(key, "column", "weight", "v.phrase", "v.size", (F.col("place") - F.col("v.at")).alias("start")).agg(F.count("*").alias("votes")).filter("votes = size")
    found = starts.groupBy(key, "phrase").agg(F.sum("weight").alias("f"))
    length = df.select(key, sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0)).alias("length"))
    # One row for all, and one for each phrase.
    totals = length.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    spread = found.groupBy("phrase").agg(F.count("*").alias("m"))
    each = found.join(F.broadcast(spread), "phrase").join(length, key).join(F.broadcast(totals), F.lit(True))
    rare = F.log((F.col("n") - F.col("m") + 0.5) / (F.col("m") + 0.5))
    part = F.when(rare > 0, rare).otherwise(FLOOR) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return each.groupBy(key).agg(F.count("*").alias("met"), (-F.sum(part)).alias("score")).filter(F.col("met") == len(phrases)).select(key, "score")


def postings(df: DataFrame, key: str, column: str) -> DataFrame:
    """Inverted index: one row for each place of a token."""
    return df.select(key, F.posexplode(tokens(F.col(column))).alias("place", "token"))


def snippet(text: Column, phrase: str, width: int = 16) -> Column:
    """Up to ``width`` words around the first word that has the phrase, which is put between marks."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))
    hit = F.array_position(F.transform(words, lambda w: F.contains(plain(w), F.lit(phrase.lower()))), True)
    start = F.greatest(F.lit(1), hit - width // 2).cast("int")
    shown = F.slice(F.transform(words, lambda w: F.when(F.contains(plain(w), F.lit(phrase.lower())), F.concat(F.lit("\x02"), w, F.lit("\x03"))).otherwise(w)), start, F.lit(width))
    return F.array_join(shown, " ")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(x: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(x, x))
    return F.when(norm > 0, F.transform(x, lambda v: v / norm)).otherwise(F.transform(x, lambda v: v.cast("double")))


def vector_topk(df: DataFrame, key: str, vector: str, query: list[float], k: int, condition: Column | None = None) -> DataFrame:
    """The k rows with the greatest dot product with a query vector, ties to the smaller key: a filter, a scan, a top-k."""
    own = df if condition is None else df.filter(condition)
    wanted = F.array(*[F.lit(float(v)) for v in query])
    return own.select(key, dot(F.col(vector), wanted).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hashed_embeddings(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, vector): counts of a text's tokens by hash, the offline encoder; a text without tokens has a zero vector."""
    own = df.select(key, F.explode_outer(tokens(F.col(text))).alias("token")).select(key, F.pmod(F.xxhash64("token"), F.lit(width)).cast("int").alias("slot"), F.col("token").isNotNull().cast("int").alias("there"))
    counts = own.groupBy(key, "slot").agg(F.sum("there").cast("double").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    return counts.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def merged_topk(df: DataFrame, key: str, vector: str, query: list[float], k: int, condition: Column | None = None, chunk: int = 8192) -> DataFrame:
    """(key, score) of the k rows with the greatest dot product and of all rows that tie with the k-th.

    Tasks go through their rows by chunks and keep the k best so far with their ties; the k-th score of what they kept
    decides.  Nothing is sorted but k rows a task.  A vector that is null or of another length takes no part.
    """
    kind = dict(df.dtypes)[key]
    asked = np.array(query, float)
    own = df if condition is None else df.filter(condition)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kept, schema = None, np.zeros(0), None
        for batch in batches:
            schema = batch.schema
            for at in range(0, len(batch), chunk):
                part = batch.slice(at, chunk)
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(asked)).astype(float)
                scores = np.zeros(len(rows))
                for i, q in enumerate(asked):  # in order, so equal vectors have equal scores in every chunk
                    scores += rows[:, i] * q
                told = part.column(0) if names is None else pa.concat_arrays([names, part.column(0)])
                scores = np.concatenate([kept, scores])
                least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
                names, kept = told.filter(pa.array(scores >= least)), scores[scores >= least]
        if schema is not None:
            yield pa.RecordBatch.from_arrays([names, pa.array(kept)], ["key", "score"])

    whole = own.filter(F.size(vector) == len(asked)).select(F.col(key).alias("key"), vector)
    work_folder(df.sparkSession)
    found = whole.mapInArrow(best, f"key {kind}, score double").checkpoint()
    last = found.select("score").orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("last"))  # one row
    return found.join(F.broadcast(last), F.col("score") >= F.col("last")).select(F.col("key").alias(key), "score")
