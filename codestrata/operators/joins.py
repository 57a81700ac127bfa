"""Joins of the data model: priorities, override rules, attachment, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_source(df: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, value: str, otherwise: str) -> DataFrame:
    """Left-join each (name, table) in turn; a row takes the value of the first that has its key, and its name."""
    names, values = [], []
    for i, (name, other) in enumerate(sources):
        df = df.join(other.select(F.col(key), F.col(value).alias(f"_v{i}"), F.lit(True).alias(f"_h{i}")), key, "left")
        names.append(F.when(F.col(f"_h{i}"), F.lit(name)))
        values.append(F.when(F.col(f"_h{i}"), F.col(f"_v{i}")))
    out = df.withColumn("class_source", F.coalesce(*names, F.lit(otherwise))).withColumn(value, F.coalesce(*values))
    return out.drop(*[f"_{c}{i}" for c in "vh" for i in range(len(sources))])


def first_rule(df: DataFrame, rules: DataFrame, keys: Sequence[str], condition: Column, row_id: str, order: str, value: str) -> DataFrame:
    """The value of the first rule, by ``order``, whose keys agree with a row's and for which the condition holds.

    Candidates meet on the keys, so only rules of the same keys are tried; a row without a rule has a null.
    """
    tried = df.join(rules, list(keys)).filter(condition).groupBy(row_id).agg(F.min_by(value, order).alias(value))
    return df.join(tried, row_id, "left")


def attach(left: DataFrame, right: DataFrame, key: str, mark: str) -> DataFrame:
    """How each key of either side is attached: the marks of the two sides agree, differ, or one side is absent."""
    both = left.select(key, F.col(mark).alias("_l")).join(right.select(key, F.col(mark).alias("_r")), key, "full_outer")
    return both.select(key, F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "orphan").when(F.col("_l") == F.col("_r"), "attached").otherwise("stale").alias("status"))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], low: str, high: str, other_low: str, other_high: str) -> DataFrame:
    """Rows of the left whose interval meets one of the right with the same keys."""
    return left.join(right, [*[left[k] == right[k] for k in keys], left[low] <= right[other_high], right[other_low] <= left[high]], "left_semi")


def same_file_comments(comments: DataFrame, key: str, path: str, file: Column, order: str, most: int) -> DataFrame:
    """(key, comments): ids of the first ``most`` comments on a file, or of all comments where none is on it.

    Comments are ranked before they are gathered, so a key with very many keeps ``most`` of each kind in a list.
    """
    here = F.col(path) == file
    ranked = comments.select(key, order, here.alias("_here")).withColumn("_place", F.row_number().over(W.partitionBy(key, "_here").orderBy(order))).filter(F.col("_place") <= most)
    first = ranked.groupBy(key, "_here").agg(F.array_sort(F.collect_list(order)).alias("own")).groupBy(key).agg(F.max_by("own", "_here").alias("own"), F.max("_here").alias("some"), F.array_sort(F.flatten(F.collect_list("own"))).alias("every"))
    return first.select(key, F.when(F.col("some"), F.col("own")).otherwise(F.slice("every", 1, most)).alias("comments"))


def with_next(df: DataFrame, key: str, value: str, name: str, width: int = 1000) -> DataFrame:
    """``df`` with ``name``: the value of the row whose whole-number key is one more; null without one.

    Rows are dealt to blocks of ``width`` keys, the first row of a block to the block before it as well, so values are
    shuffled once and no block outgrows a task.  Keys are unique.
    """
    block = F.floor(F.col(key) / width)
    first = F.pmod(F.col(key), F.lit(width)) == 0
    dealt = df.withColumn("_b", F.explode(F.when(first, F.array(block, block - 1)).otherwise(F.array(block))))
    order = W.partitionBy("_b").orderBy(key)
    met = dealt.withColumn("_next", F.lead(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).over(order))
    own = met.filter(F.col("_b") == block)
    return own.withColumn(name, F.when(F.col("_next.k") == F.col(key) + 1, F.col("_next.v"))).drop("_b", "_next")
