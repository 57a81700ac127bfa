"""Samples, quotas and ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.ids import stable_key
from codestrata.sources.files import work_folder


def hash_sample(df: DataFrame, keys: Sequence[str], ident: str, k: int, seed: str) -> DataFrame:
    """The k rows of each key with the smallest stable hash: the same for any order or partitioning of the input."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(stable_key(seed, F.col(ident)), ident))
    return df.withColumn("place", place).filter(F.col("place") <= k)


def weighted_reservoir(df: DataFrame, keys: Sequence[str], ident: str, weight: Column, k: int, seed: str) -> DataFrame:
    """At most k rows of each key, drawn without replacement by weight: ``df`` with ``place`` from 1, in the order they would be drawn.

    Each row has an exponential number scaled by its weight, made of a hash of seed and ident, and the least ones stay:
    reservoirs of parts merge by taking the least again, so tasks keep k rows a key and reruns agree.  Rows whose weight
    is null, not positive or not finite are never drawn; equal idents count as one number, ties go by ident.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    sound = (weight > 0) & ~F.isnan(weight) & (weight < float("inf"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_e", ident))
    return df.filter(sound).withColumn("_e", -F.log(unit) / weight).withColumn("place", place).filter(F.col("place") <= k).drop("_e")


def largest_remainder(counts: DataFrame, key: str, weight: str, seats: int) -> DataFrame:
    """Seats in proportion to weights: whole shares first, the rest by the largest fraction, ties by key.

    ``counts`` has a row for each key, few enough for one task.
    """
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # Whole-number arithmetic: shares are exact.
    total = F.sum(weight).over(every)
    whole = F.expr(f"{weight} * {seats} div _total")
    rest = F.col(weight) * seats % F.col("_total")
    shared = counts.withColumn("_total", total).withColumn("_whole", whole).withColumn("_rest", rest)
    left = F.lit(seats) - F.sum("_whole").over(every)
    place = F.row_number().over(W.orderBy(F.desc("_rest"), key))
    return shared.withColumn("seats", F.col("_whole") + F.when(place <= left, 1).otherwise(0)).select(key, weight, "seats")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, from 0, in an order over all rows: a sort by ranges, and counts of the ranges before.

    The sorted rows are written to the shared folder, so places don't depend on how a range is computed again.
    """
    work_folder(df.sparkSession)
    numbered = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_m", 33)
    # A row for each range, of which there are as many as shuffle partitions.
    counts = numbered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    first = counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_first"))
    met = numbered.withColumn("_p", part).join(F.broadcast(first), "_p")
    return met.withColumn("place", F.col("_first") + F.col("_m") - F.shiftleft(F.col("_p"), 33)).drop("_p", "_m", "_first")


def top_share(df: DataFrame, percent: int, *order: Column) -> DataFrame:
    """The first ceil(n * percent / 100) rows in an order, however many these are."""
    placed = ranked(df, *order)
    total = placed.agg(F.count("*").alias("_n"))  # one row
    return placed.join(F.broadcast(total), F.col("place") < F.ceil(F.col("_n") * percent / 100)).drop("place", "_n")


def spread(df: DataFrame, keys: Sequence[str], order: Column, k: int) -> DataFrame:
    """k evenly spread rows of each key: the first, the last, and steps between, rounded half to even; for k = 1 the middle."""
    by = W.partitionBy(*keys)
    placed = df.withColumn("_place", F.row_number().over(by.orderBy(order)) - 1).withColumn("_n", F.count("*").over(by))
    step = (lambda i: F.floor(F.col("_n") / 2)) if k == 1 else (lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(max(k, 1) - 1)), lambda i: F.when(F.col("_n") <= k, F.col("_place")).otherwise(step(i).cast("int")))
    return placed.filter(F.array_contains(wanted, F.col("_place")) & F.lit(k > 0)).drop("_place", "_n")


def water_filled(counts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Equal seats for each key, none above its size; what a small key leaves goes to the others, the rest in order of keys.

    ``counts`` has a row for each key, few enough for one task: the level is found by running sums over sizes.
    """
    by_size = W.orderBy(size, key)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = counts.withColumn("_i", F.row_number().over(by_size)).withColumn("_k", F.count("*").over(every)).withColumn("_before", F.coalesce(F.sum(size).over(by_size.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_level", F.expr(f"({total} - _before) div (_k - _i + 1)")).withColumn("_full", F.col(size) <= F.col("_level"))
    own = own.withColumn("_common", F.min_by(F.when(~F.col("_full"), F.col("_level")), F.when(~F.col("_full"), F.col("_i"))).over(every))
    own = own.withColumn("_seats", F.when(F.col("_full"), F.col(size)).otherwise(F.col("_common")))
    left = F.lit(total) - F.sum("_seats").over(every)
    turn = F.sum(F.when(F.col("_seats") < F.col(size), 1).otherwise(0)).over(W.orderBy(key))
    return own.select(key, size, (F.col("_seats") + F.when((F.col("_seats") < F.col(size)) & (turn <= left), 1).otherwise(0)).cast("bigint").alias("seats"))


def quota_sample(df: DataFrame, quotas: DataFrame, key: str, ident: str, seed: str) -> DataFrame:
    """As many rows of each key as its seats, by the least stable hash."""
    place = F.row_number().over(W.partitionBy(key).orderBy(stable_key(seed, F.col(ident)), ident))
    return df.join(quotas.select(key, "seats"), key).withColumn("place", place).filter(F.col("place") <= F.col("seats")).drop("seats")


def balanced_splits(df: DataFrame, keys: Sequence[str], ident: str, seed: str, shares: Sequence[tuple[str, int]]) -> DataFrame:
    """A split for each row, so that each group of ``keys`` has splits in the shares given, which are parts of their sum.

    Rows of a group are dealt in hash order, and groups begin where the ones before stopped, so small groups don't all
    give their first row to one split.
    """
    total = sum(n for _, n in shares)
    cycle = [name for name, n in shares for _ in range(n)]
    order = [cycle[i * _coprime(total) % total] for i in range(total)]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_first", F.sum("_n").over(W.orderBy(*keys)) - F.col("_n")).drop("_n")  # a row for each group
    place = F.row_number().over(W.partitionBy(*keys).orderBy(stable_key(seed, F.col(ident)), ident)) - 1
    return df.join(before, list(keys)).withColumn("split", F.get(F.array(*[F.lit(x) for x in order]), ((F.col("_first") + place) % total).cast("int"))).drop("_first")


def _coprime(n: int) -> int:
    return next(i for i in range(max(2, round(n * 0.618)), 2 * n + 3) if math.gcd(i, n) == 1)


def run_batches(df: DataFrame, run: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Batch numbers over runs of rows that belong together: a batch begins with the run in which the last one is full."""
    runs = df.groupBy(*run).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_at"))
    start = F.sum("_n").over(W.orderBy("_at")) - F.col("_n")
    return df.join(runs.select(*run, F.floor(start / size).cast("bigint").alias("batch")), list(run))


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
