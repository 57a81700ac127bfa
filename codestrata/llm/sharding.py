"""Sharding by sampled splitters, in DataFrame operations only."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import cut, uniform


def _array(values: list, kind: str) -> Column:
    return F.from_json(F.lit("[" + ",".join("null" if v is None else str(v) for v in values) + "]"), f"array<{kind}>")


def _range_of(keys: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below a row's (key, tie), looked for in two steps of about sqrt(n) comparisons."""
    if not keys:
        return F.lit(0)
    step = math.isqrt(len(keys) - 1) + 1
    splits = F.arrays_zip(_array([k for k, _ in keys], "bigint").alias("k"), _array([t for _, t in keys], "bigint").alias("t"))
    heads = keys[::step]
    coarse = F.arrays_zip(_array([k for k, _ in heads], "bigint").alias("k"), _array([t for _, t in heads], "bigint").alias("t"))

    def below(s: Column) -> Column:
        return (s["k"] < F.col("_key")) | ((s["k"] == F.col("_key")) & (s["t"] <= F.col("_tie")))

    block = F.size(F.filter(coarse, below)) - 1
    inside = F.size(F.filter(F.slice(splits, block * step + 1, F.lit(step)), below))
    return F.when(block < 0, 0).otherwise(block * step + inside)


def shard_by_splitters(
    df: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, samples: int = 16384, ranges_per_shard: int = 8, rows_per_range: int = 500_000, together: int = 16, seed: str = "shard"
) -> DataFrame:
    """Deal rows to ``shards`` shards of near equal bytes; rows of equal text lie next to each other.

    Keys are (60 bits of the text's MD5 digest, id).  A sample of about ``samples`` keys, drawn with probability in
    proportion to size, gives splitters at its quantiles, and rows are range-partitioned by them.  A key with several
    splitters (a text with very many copies) is an overfull range and is subdivided by id.  Sizes are then summed
    exactly within each range, and shard limits are laid at exact shares of all bytes: sampling decides only how the
    work is dealt, never the result.  Equal texts stay in one shard unless they weigh over 1/``together`` of it.

    Law ``bytes``: a shard differs from the mean by at most 1/``together`` of it, plus one row.

    Nulls: a null text has no bytes and counts as equal to an empty one; rows with a null id come first among
    equal texts.  Repeated rows are dealt like others, each with its own slot.  An empty table gives no rows.
    Other columns of ``df`` are ignored, whatever their names.

    Returns id_col, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(
        F.col(id_col).cast("long").alias("_id"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("_key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_tie"),
        (F.octet_length(text) + overhead).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"),
    )
    base = cut(base)
    n, total = base.agg(F.count("*"), F.sum("_size")).first()
    n, total = n or 0, total or 1
    chance = F.least(F.lit(1.0), F.col("_size") * F.lit(samples / total))
    drawn = sorted(
        (r["_key"], r["_tie"], r["w"])
        for r in base.withColumn("w", F.col("_size") / chance).filter(uniform(F.concat_ws(":", "_key", "_tie"), seed) < chance).select("_key", "_tie", "w").toLocalIterator()
    )
    keys: list[tuple[int, int]] = []
    if drawn:
        sums, run = [], 0.0
        for *_, w in drawn:
            sums.append(run := run + w)
        wanted = shards * max(ranges_per_shard, math.ceil(n / (shards * rows_per_range)))
        wanted = min(wanted, len(drawn))
        found = sorted({drawn[min(bisect.bisect_left(sums, run * i / wanted), len(drawn) - 1)][:2] for i in range(1, wanted)})
        often = {k for i, (k, _) in enumerate(found) if i and found[i - 1][0] == k}
        keys = sorted({(k, t) if k in often else (k, -(2**63)) for k, t in found})
    ranged = base.withColumn("_range", _range_of(keys))
    per_range = ranged.groupBy("_range").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # One row for each range, whose number is a parameter: small enough for one task and for a broadcast.
    offsets = per_range.select("_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_from"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    in_order = W.partitionBy("_range").orderBy("_key", "_tie", "_size")
    same = W.partitionBy("_range", "_key")
    split = F.lit(False) if not keys else F.array_contains(_array(sorted({k for i, (k, _) in enumerate(keys) if i and keys[i - 1][0] == k}), "bigint"), F.col("_key"))
    placed = (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn("_at", F.col("_from") + F.sum("_size").over(in_order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size"))
        .withColumn("_rank", F.col("_first") + F.row_number().over(in_order) - 1)
        .withColumn("_group", F.sum("_size").over(same))
        .withColumn("_group_at", F.min("_at").over(same))
        .withColumn("_whole", ~split & (F.col("_group") * (shards * together) <= F.lit(total)))
        .withColumn("_twice", F.when(F.col("_whole"), 2 * F.col("_group_at") + F.col("_group")).otherwise(2 * F.col("_at") + F.col("_size")))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.expr(f"_twice * {shards} div {2 * total}")).cast("int")))
    )
    starts = placed.groupBy("shard").agg(F.min("_rank").alias("_start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
