"""SimHash fingerprints linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import cut, partitions
from codestrata.llm.components import connected_components, keep_one

SEED, SHINGLE, RADIUS = 42, 3, 3
#: A variant shared by more fingerprints than this is not paired off but hashed by whole balls.
PAIRED = 32


def fingerprint(text: str | None) -> int:
    """64 majority bits over the XXH64 values of all word shingles, as a signed number; 0 for no words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n < 2:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    values = np.array(hashes, np.uint64).astype("<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), 65536):
        counts += np.unpackbits(values[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark_col: str | None = None) -> DataFrame:
    """(id_col, mark, fp) of each row; mark is null unless a column is named."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "mark", "fp"])

    mark = F.lit(None) if mark_col is None else F.col(mark_col)
    own = df.select(F.col(id_col).cast("long").alias("id"), mark.cast("long").alias("mark"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(of, "id long, mark long, fp long").withColumnRenamed("id", id_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(str(_signed(b)) for b in bits) + "]"), "array<bigint>")


def _variants(fp: Column) -> Column:
    """All variants within one bit of a fingerprint, for each of three ways to erase about a third of its bits.

    Two fingerprints that differ in 1 to 3 bits have a differing bit in some third.  With that third erased at most 2
    bits differ, and half of that is 1: both reach a common variant.  The erased bits hold the third's number, so a
    variant is one long.
    """
    parts = []
    for number, (low, high) in enumerate(((0, 21), (21, 42), (42, 64)), 1):
        erased = ((1 << (high - low)) - 1) << low
        kept = [0, *(1 << i for i in range(64) if not low <= i < high)]
        core = fp.bitwiseAND(F.lit(_signed(~erased & (2**64 - 1)))).bitwiseOR(F.lit(_signed(number << low)))
        parts.append(_flipped(core, kept))
    return F.concat(*parts)


def _flipped(value: Column, bits: list[int]) -> Column:
    return F.transform(_masks(bits), lambda m: value.bitwiseXOR(m))


def _ball_links(hot: DataFrame) -> DataFrame:
    """Links among fingerprints that share crowded variants, by whole balls.

    All emit the 65 variants within one bit, those of odd parity also the 2,016 at two bits.  Of two fingerprints at
    distance 3 one is odd, and they meet; at distance 1 or 2 they meet within one bit.  Whoever meets one that came
    by one bit is within 3 bits of it by construction, so linking all to the least of these loses no connection and
    makes no pairs.
    """
    one = [0, *(1 << i for i in range(64))]
    two = [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    fp = F.col("fp")
    close = hot.select("fp", F.explode(_flipped(fp, one)).alias("v"), F.lit(1).alias("by"))
    wide = hot.filter(F.bit_count("fp") % 2 == 1).select("fp", F.explode(_flipped(fp, two)).alias("v"), F.lit(2).alias("by"))
    least = F.min(F.when(F.col("by") == 1, F.col("fp"))).over(W.partitionBy("v"))
    return close.union(wide).withColumn("b", least).filter("b <> fp").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all within RADIUS bits of each other.

    Rows grow in proportion to the fingerprints: 131 variants each, pairs only inside variants shared by at most
    PAIRED of them, whole balls for members of more crowded ones.
    """
    # A fingerprint is 8 bytes and makes 131 variants, so it is dealt by their number and not by its own size.
    some = fps.select("fp").distinct().repartition(partitions(fps), "fp")
    spread = some.select("fp", F.explode(_variants(F.col("fp"))).alias("v"))
    shared = cut(spread.withColumn("n", F.count("*").over(W.partitionBy("v"))).filter("n > 1"))
    pairs = F.expr(
        f"""flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, {PAIRED}), y -> bit_count(x ^ y) <= {RADIUS}),
        y -> struct(greatest(x, y) AS a, least(x, y) AS b))))"""
    )
    few = shared.filter(F.col("n") <= PAIRED).groupBy("v").agg(F.collect_list("fp").alias("l")).select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    return few.union(_ball_links(shared.filter(F.col("n") > PAIRED).select("fp").distinct())).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark_col: str | None = None) -> DataFrame:
    """(id_col, mark, fp, root, component_id) of each row.

    Rows whose fingerprints differ in at most 3 bits are linked; component_id is the least id reachable and root the
    component's least fingerprint.  Texts are turned to fingerprints where they are read, and equal fingerprints
    count once afterwards, so copies cost nothing further.

    Nulls: a null or wordless text has fingerprint 0, linked like any other; a row with a null id is linked too and
    never is the least.  Repeated rows are kept.  An empty table gives no rows.
    """
    own = cut(fingerprints(df, id_col, text_col, mark_col))
    roots = connected_components(links(own))
    rooted = own.join(roots, own["fp"] == roots["node"], "left").select(id_col, "mark", "fp", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min(id_col).alias("component_id"))
    return rooted.join(least, "root").select(id_col, "mark", "fp", "root", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(df: DataFrame) -> DataFrame:
    """The row with the least id of each component, all columns as they are."""
    return keep_one(df, near_duplicates)
