"""Connected components by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut, quoted, row_hash, spare


#: Distinct edges that are joined in one task: some 16 MB there, against dozens of shuffles by rounds.
AT_ONCE = 1_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        if not parts:
            return
        nodes, place = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        x, y = place.reshape(2, -1)
        root = np.arange(len(nodes))
        while True:
            # The least root of both ends goes to the roots of either, then to all below.
            least = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], least)
            np.minimum.at(new, root[y], least)
            while (new[new] != new).any():
                new = new[new]
            new = new[root]
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(join, "node long, root long")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the least node reachable.

    Up to AT_ONCE distinct edges, 16 bytes each, are joined in one task.  Beyond that each round links every neighbour
    to the least one, first among larger nodes and then among smaller ones, and writes the edges to the checkpoint
    folder, so plans stay short and a lost executor costs one round.  The number of rounds is about the logarithm of the
    longest path.  Both ways give the same rows; nodes without an edge other than to themselves are absent.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _state(now)
    if seen[0] <= AT_ONCE:
        return cut(_in_one_task(now))
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        was, seen = seen, _state(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def keep_one(df: DataFrame, components: Callable[..., DataFrame], id_col: str = "doc_id") -> DataFrame:
    """One row of each component: the one with the least id, null ids last; of rows with one id that of the least hash.

    ``components`` gives (mark, root) among others for each row; rows are known by their id and a hash of all their columns, so
    reruns agree and rows that share an id but not their text are told apart.
    """
    mark, root, key = spare(df, "mark", "root", "key")
    own = df.withColumn(mark, row_hash(df))
    found = components(own, mark_col=mark).select(F.col(id_col).alias("id"), "mark", "root")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("m"))
    kept = first.select(F.col("m.mark").alias("_mark"), F.col("m.id").alias(key), F.col("root").alias(root))
    both = own.join(kept, (F.col(mark) == F.col("_mark")) & quoted(id_col).eqNullSafe(F.col(key)))
    return both.dropDuplicates([root]).select(*map(quoted, df.columns))
