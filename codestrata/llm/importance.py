"""Importance resampling towards a target: hashed n-grams of words, a gain per bucket, noise, the best part drawn.

A block of texts maps its distinct words to ids.  An n-gram is a pair of ids (that of the n-gram without its last word,
that of the word), so comparing n-grams is comparing integers; each distinct one's bytes are put together and hashed
once, and its bucket and count go back to where it stands.  Dictionaries belong to blocks: one of the whole input would
send every word of every text through a shuffle, for the same sums.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut, partitions, spare

BUCKETS, LONGEST, SEED = 10_000, 2, 7
#: Documents with fewer words aren't drawn, and so many of a hundred of the others are.
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of text that share a dictionary (a longer text has its own), and rows of a range when ranks are given.
BLOCK, RANGE_ROWS = 8 << 20, 4_000_000

#: Bytes of words as they are or in lower case, all others 0: words are runs of digits, ASCII letters and what isn't ASCII.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256))


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """(offsets of the texts, their bytes) of stretches of rows with about BLOCK bytes."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        own = offsets[at : end + 1]
        yield own - own[0], data[int(own[0]) : int(own[-1])].to_pybytes() if own[-1] > own[0] else b""
        at = end


def _words(offsets: np.ndarray, data: bytes) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and the text that each is in."""
    told = np.frombuffer(data.translate(_BYTES), np.uint8)
    inside = told != 0
    before = np.zeros(len(told), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(told)]] = False  # no word goes on into the next text
    starts = np.flatnonzero(inside & ~before)
    ends = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(told[inside].tobytes())])
    return words, np.searchsorted(offsets, starts, "right") - 1


def _grams(offsets: np.ndarray, data: bytes, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: the text of each, and its bucket."""
    words, owner = _words(offsets, data)
    coded = words.dictionary_encode()
    distinct, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    known, own, place = distinct, ids, np.arange(len(ids))  # n-grams: their bytes, their ids, where their last words are
    for n in range(1, longest + 1):
        if n > 1:
            go_on = place[:-1] + 1 == place[1:] if n > 2 else np.ones(max(len(place) - 1, 0), bool)
            go_on &= owner[place[:-1]] == owner[place[1:]]
            pairs = pa.array(own[:-1][go_on] * max(len(distinct), 1) + ids[place[1:][go_on]]).dictionary_encode()
            keys = pairs.dictionary.to_numpy()
            known = pc.binary_join_element_wise(known.take(pa.array(keys // max(len(distinct), 1))), distinct.take(pa.array(keys % max(len(distinct), 1))), pa.scalar(b" ", pa.large_binary()))
            own, place = pairs.indices.to_numpy().astype(np.int64), place[1:][go_on]
        hashed = np.fromiter((zlib.crc32(x) % buckets for x in known.to_pylist()), np.int64, len(known))
        yield owner[place], hashed[own]


def bucket_counts(df: DataFrame, text_col: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts a bucket has; buckets without any have no row.  A task sends each bucket once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in _blocks(batch.column(0)):
                for _, hashed in _grams(*block, longest, buckets):
                    total += np.bincount(hashed, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(df: DataFrame, target: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """What an n-gram of each bucket is worth: thousandths of the log of how much likelier the target is to have it.

    The driver gets a number for each bucket, a parameter, whatever the input's size.
    """
    has, wants = (dict(map(tuple, bucket_counts(x, text_col, longest, buckets).collect())) for x in (df, target))
    every, wanted = sum(has.values()), sum(wants.values())
    return [math.floor(1000 * math.log((wants.get(b, 0) + 1) * (every + buckets) / ((has.get(b, 0) + 1) * (wanted + buckets)))) for b in range(buckets)]


def weighed(text: Column, worth: list[int], longest: int = LONGEST) -> Column:
    """(n_words, n_features, weight) of a text; the weight is the mean of its n-grams' gains, rounded down."""
    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.array(worth, np.int64)
        for column in texts:
            parts = []
            for offsets, data in _blocks(column):
                rows = len(offsets) - 1
                words, features, sums = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for n, (owner, hashed) in enumerate(_grams(offsets, data, longest, len(table))):
                    own = np.bincount(owner, minlength=rows)
                    words += own if n == 0 else 0
                    features += own
                    np.add.at(sums, owner, table[hashed])
                parts.append((words, features, sums // np.maximum(features, 1)))
            columns = [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)) for i in range(3)]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))

    return F.arrow_udf(weigh, "struct<n_words:long,n_features:long,weight:long>")(text)


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that a key alone decides, rounded down; a null key counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance(df: DataFrame, target: DataFrame, *, key: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, n_features, weight, score, rank) of each row: ``percent`` of a hundred of the rows with words enough are drawn.

    Rows go by their scores, ties by key (null last); rank is null for rows that aren't drawn.  Ranks are given by
    ranges: rows are dealt and sorted by score, and a row's rank is its place in its range after all ranges before.

    Nulls: a null or wordless text has no features and the weight 0 and isn't drawn; a null key is a key.  Repeated rows
    are rows of their own.  An empty table gives no rows, and an empty target makes every n-gram worth what its rarity
    says.  Other columns, whatever their names, aren't read.
    """
    worth = gains(df, target, text_col)
    own = df.select(F.col(f"`{key}`").alias("_key"), weighed(F.col(f"`{text_col}`").cast("string"), worth).alias("x"))
    scored = cut(own.select("_key", "x.*", (F.col("x.weight") + noise(F.col("_key"))).alias("score")))
    enough = F.col("n_words") >= least_words
    every, eligible = scored.agg(F.count("*"), F.count_if(enough)).first()
    ranges = max(partitions(df), every // RANGE_ROWS + 1)
    order = [F.when(enough, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("_key")]
    placed = cut(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33)
    before, sizes = 0, placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each range
    starts = []
    for row in sizes:
        starts.append((row.part, before))
        before += row.n
    offsets = df.sparkSession.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    told = placed.withColumn("part", part).join(F.broadcast(offsets), "part", "left")
    return told.select(F.col("_key").alias(key), "n_features", "weight", "score", F.when(rank <= eligible * percent // 100, rank).cast("long").alias("rank"))


def resampled(df: DataFrame, target: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that are drawn, with all their columns; keys must be distinct, and a row with a null key stays out."""
    (own,) = spare(df, "key")
    drawn = importance(df, target, key=key, **options).filter("rank IS NOT NULL").select(F.col(f"`{key}`").alias(own))
    return df.join(drawn, F.col(f"`{key}`") == F.col(own), "left_semi")
