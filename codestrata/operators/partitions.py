"""Coarser labels: all ways to merge labels into blocks, scored by accuracy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_partitions(labels: Sequence[str], sizes: Sequence[int]) -> list[list[list[str]]]:
    """All partitions of labels into as many blocks as one of ``sizes`` says, each block and the list in label order.

    A partition is a row of block numbers in which a new number is one more than the greatest before it.
    """
    codes = np.zeros((1, min(len(labels), 1)), np.int64)
    for _ in labels[1:]:
        greatest = codes.max(axis=1)
        codes = np.concatenate([np.column_stack([codes[greatest >= b - 1], np.full((greatest >= b - 1).sum(), b)]) for b in range(max(sizes))])
    wanted = codes[np.isin(codes.max(axis=1, initial=-1) + 1, list(sizes))]
    return [[[x for x, c in zip(labels, row, strict=True) if c == b] for b in range(row.max() + 1)] for row in wanted]


def partition_accuracy(pairs: DataFrame, labels: Sequence[str], sizes: Sequence[int], truth: str, guess: str) -> DataFrame:
    """(blocks, partition, n, hits) of each partition; a hit puts truth and guess in one block, and other labels only hit themselves.

    ``pairs`` is summed by (truth, guess) first; it then meets the partitions' few thousand label rows.
    """
    spark = pairs.sparkSession
    counts = pairs.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    every = set_partitions(labels, sizes)
    rows = [(i, len(p), "|".join("+".join(b) for b in p), {x: k for k, b in enumerate(p) for x in b}) for i, p in enumerate(every)]
    parts = spark.createDataFrame(rows, "i int, blocks int, partition string, block map<string,int>")
    # The number of partitions depends on the label list alone.
    met = counts.join(F.broadcast(parts), F.lit(True))
    hit = (F.col("t") == F.col("g")) | (F.try_element_at("block", F.col("t")) == F.try_element_at("block", F.col("g")))
    return met.groupBy("blocks", "partition").agg(F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"))


def supported_partitions(cases: DataFrame, labels: Sequence[str], sizes: Sequence[int], truth: str) -> DataFrame:
    """(blocks, partition, supported) of each partition: whether every block has a label that some case has."""
    spark = cases.sparkSession
    rows = [(len(p), "|".join("+".join(b) for b in p), p) for p in set_partitions(labels, sizes)]
    parts = spark.createDataFrame(rows, "blocks int, partition string, members array<array<string>>")
    seen = cases.agg(F.collect_set(truth).alias("seen"))  # one row of labels
    met = parts.join(F.broadcast(seen), F.lit(True))
    return met.select("blocks", "partition", F.forall("members", lambda b: F.arrays_overlap(b, F.col("seen"))).alias("supported"))
