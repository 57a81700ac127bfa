"""Importance resampling against a plain version, n-gram by n-gram."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codestrata.llm import importance as im

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    has, wants = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([t for _, t in docs], target))
    every, wanted = sum(has.values()), sum(wants.values())
    gain = [math.floor(1000 * math.log((wants[b] + 1) * (every + 10_000) / ((has[b] + 1) * (wanted + 10_000)))) for b in range(10_000)]
    rows = []
    for key, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = drawn[: percent * len(drawn) // 100]
    place = {id(r): i for i, r in enumerate(drawn, 1)}
    return [(r[0], r[2], r[3], r[4], place.get(id(r))) for r in rows]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


DOCS = [
    *[(i, f"The quick brown fox nr {i % 7} jumps over lazy dogs " * (1 + i % 5) + "Ünïcode, ÀB") for i in range(60)],
    (60, None), (61, ""), (62, "  \x00 \n ..."), (63, "é" * 50), (64, "word " * 30_000), (65, "A-b_c\x7fd\x80e"), (None, "the quick " * 20), (7, "twice there " * 12), (7, "twice there " * 12),
]
TARGET = ["the lazy dogs jump", "quick brown fox", None, "", "twice there"]


@pytest.mark.parametrize("block", [8 << 20, 100, 1])
def test_equals_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(im, "BLOCK", block)
    # Columns that other steps use as names are in the way of nothing.
    df = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, score int, rank string").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert order(map(tuple, im.importance(df, target).collect())) == order(plain(DOCS, TARGET))


def test_empty_tables(spark):
    df, target = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert im.importance(df.limit(0), target).collect() == []
    assert order(map(tuple, im.importance(df, target).collect())) == order(plain(DOCS, []))


def test_rows_that_are_drawn(spark):
    docs = [d for d in DOCS if d[0] is not None and d[0] != 7]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1))
    wanted = {r[0] for r in plain(docs, TARGET) if r[4] is not None}
    found = im.resampled(df, spark.createDataFrame([(t,) for t in TARGET], "text string"))
    assert found.columns == ["doc_id", "text", "key"] and {r.doc_id for r in found.collect()} == wanted


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(im, "RANGE_ROWS", 5)
    df = spark.createDataFrame([(i, "same words " * 20) for i in range(200)], "doc_id long, text string")
    target = spark.createDataFrame([("same",)], "text string")
    assert order(map(tuple, im.importance(df, target).collect())) == order(plain([(i, "same words " * 20) for i in range(200)], ["same"]))


def test_longer_runs(spark):
    got = [(n, set(zip(owner.tolist(), hashed.tolist(), strict=True))) for n, (owner, hashed) in enumerate(im._grams(__import__("numpy").array([0, 7, 7, 12]), b"a b c da b c", 3, 1 << 32), 1)]
    text = lambda *words: zlib.crc32(" ".join(words).encode())
    assert got[2] == (3, {(0, text("a", "b", "c")), (0, text("b", "c", "d")), (2, text("a", "b", "c"))})
