"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut, pieces

#: Samples in a fingerprint and hexadecimal digits for each.
SAMPLES, DIGITS = 64, 4
#: Characters of text worked on at once: bounds a worker's memory.
AT_ONCE = 2_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-32


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def log_hash_values(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """ln a for each (term hash, weight) and sample: the sample's term is the one with the least.

    r and c are Gamma(2, 1) and b uniform, all functions of the term alone.  With t = floor(ln w / r + b) and
    y = exp(r (t - b)), a = c / (y exp(r)).  Two weights of a term with the same t have the same a.
    """
    keys = terms[:, None] + _GOLDEN * np.arange(1, SAMPLES + 1, dtype=np.uint64)[None, :]
    first, second, third = (_mix(keys * _GOLDEN + np.uint64(s)) for s in (0x51, 0xA3, 0xF7))
    high = lambda x: ((x >> np.uint64(32)).astype(np.float64) + 0.5) * _UNIT
    low = lambda x: ((x & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * _UNIT
    r = -np.log(high(first) * low(first))
    c = -np.log(high(second) * low(second))
    b = high(third)
    t = np.floor(np.log(weights)[:, None] / r + b)
    return np.log(c) - r * (t - b + 1)


def signatures(texts: Sequence[str]) -> np.ndarray:
    """SAMPLES 16-bit values for each text.

    Terms are lower-cased words and weights their counts.  The least ln a stands for its (term, t), so a value of a
    signature is 16 bits of it.  A text without words has its own signature.
    """
    words = [t.lower().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), SAMPLES), np.inf, np.float32)
    if lengths.sum():
        codes: dict[str, int] = {}
        flat = np.fromiter((codes.setdefault(w, len(codes)) for w in chain.from_iterable(words)), np.int64, int(lengths.sum()))
        pairs, counts = np.unique(np.repeat(np.arange(len(words)), lengths) * len(codes) + flat, return_counts=True)
        doc, term = np.divmod(pairs, len(codes))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in codes), np.uint64, len(codes))
        weighted, row = np.unique(term * (int(counts.max()) + 1) + counts, return_inverse=True)
        term, weight = np.divmod(weighted, int(counts.max()) + 1)
        values = np.empty((len(weighted), SAMPLES), np.float32)
        for i in range(0, len(weighted), 4096):
            values[i : i + 4096] = log_hash_values(hashes[term[i : i + 4096]], weight[i : i + 4096].astype(np.float64))
        some = np.flatnonzero(lengths)
        starts = np.searchsorted(doc, some)
        for i in range(0, len(some), 512):
            low, high = starts[i], starts[i + 512] if i + 512 < len(some) else len(doc)
            out[some[i : i + 512]] = np.minimum.reduceat(values[row[low:high]], starts[i : i + 512] - low, axis=0)
    bits = out.view(np.uint32).astype(np.uint64)
    return (_mix(bits) >> np.uint64(48)).astype(">u2")


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as much of the beginning of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_pairs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprint each text and its edit, whose end comes from the next text in descending order of id.

    Rows are dealt by ranges of ids and sorted, so all successors but those of the ranges' last rows are at hand, and a
    task streams through its range.  The first and last text of each range are kept beside the results and meet those of
    the next range at the end: texts are shuffled once, and the driver knows the ranges' numbers alone.

    Nulls: a null text is empty; rows with a null id come last, and the first row follows the last.  Rows with equal
    ids go by text, so reruns agree; equal rows follow each other.  A single row follows itself; an empty table
    gives no rows.  A text without words is like another of its kind (1) and unlike all else (0).

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    least = -(2**63)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = pieces(df, piece_bytes, text_col)
    # Many rows of one id, or without one, go by the beginnings of their texts.
    dealt = rows.withColumn("t", F.substring("text", 1, 64)).repartitionByRange(n, F.desc("k"), F.desc("t")).sortWithinPartitions(F.desc("k"), F.desc("text"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def work(texts: list[str], ids: list) -> pa.RecordBatch:
        """texts has one more than ids: the last one only follows."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        found = signatures(texts + changed)
        own, other = found[: len(texts)], found[len(texts) :]
        here = own[:-1]
        told = lambda x: [r.tobytes().hex() for r in x]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(told(here), pa.string()), pa.array(told(other), pa.string()), pa.array((here == other).mean(axis=1), pa.float64()), pa.array((here == own[1:]).mean(axis=1), pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    border = ["part", "first", "last"]

    def bordered(batch: pa.RecordBatch, part: int | None = None, first: str | None = None, last: str | None = None) -> pa.RecordBatch:
        more = [pa.array([x] * len(batch), kind) for x, kind in ((part, pa.int32()), (first, pa.string()), (last, pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *border])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        ids: list = []
        size, first = 0, None
        for batch in batches:
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                first = text.as_py() if first is None else first
                texts.append(text.as_py())
                ids.append(i.as_py())
                size += len(texts[-1])
                if size > AT_ONCE and len(texts) > 1:
                    yield bordered(work(texts, ids[:-1]))
                    texts, ids, size = texts[-1:], ids[-1:], len(texts[-1])
        if len(texts) > 1:
            yield bordered(work(texts, ids[:-1]))
        if texts:
            yield bordered(work(texts[-1:] * 2, ids[-1:]), TaskContext.get().partitionId(), first, texts[-1])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, following in zip(*(batch.column(c).to_pylist() for c in ("id", "last", "following")), strict=True):
                yield work([text, following], [i])

    found = cut(dealt.select("id", "text").mapInArrow(walk, f"{schema}, part int, first string, last string"))
    ends = found.filter("part IS NOT NULL")
    parts = sorted(r.part for r in ends.select("part").toLocalIterator())  # one number for each range
    links = df.sparkSession.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next int")
    following = ends.select(F.col("part").alias("next"), F.col("first").alias("following"))
    closed = ends.select("part", "id", "last").join(links, "part").join(following, "next").select("id", "last", "following").mapInArrow(close, schema)
    return found.filter("part IS NULL").drop(*border).unionByName(closed).withColumnRenamed("id", id_col)
