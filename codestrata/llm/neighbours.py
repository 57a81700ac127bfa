"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

The tables hold sketches of a byte for each component, with the exact length of what the sketch leaves out.  That bounds
each distance from both sides, so inside a bucket only rows that can't be among the k nearest are left behind, and only
what is left is compared with the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import cut


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def signed_axes(x: np.ndarray, table: int, number: int, seed: int, axes: int) -> np.ndarray:
    """How near each row of unit vectors is, after a pseudo-rotation, to each of some signed axes (+0, -0, +1, -1, ...)."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, x.shape[1], table, number]).choice([-1.0, 1.0], (3, width))
    y = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for s in signs:
        y = hadamard(y * s)
    return np.stack([y, -y], axis=2).reshape(len(y), 2 * width)[:, :axes]


def shape(dim: int, rows: int, target: int) -> list[int]:
    """Signed axes of each hash of a table: all of them for the first, more hashes until ``target`` rows or fewer share a bucket."""
    whole = 2 << max(0, (dim - 1).bit_length())
    left, out = -(-max(1, rows // target) // whole), [whole]
    while left > 1 and len(out) < 4:
        out.append(min(whole, 1 << (left - 1).bit_length()))
        left = -(-left // out[-1])
    return out


def buckets(x: np.ndarray, table: int, axes: list[int], probes: int, seed: int) -> np.ndarray:
    """The ``probes`` most likely buckets of each row, the nearest first; a bucket is one signed axis per hash."""
    code, worth = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for i, n in enumerate(axes):
        near = signed_axes(x, table, i, seed, n)
        best = np.argsort(-near, axis=1, kind="stable")[:, : min(probes, n)]
        worth = (worth[:, :, None] + np.take_along_axis(near, best, 1)[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * n + best[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-worth, axis=1, kind="stable")[:, :probes]
        code, worth = np.take_along_axis(code, order, 1), np.take_along_axis(worth, order, 1)
    return code


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows from a vector; components as large or small as a double may be are scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = np.abs(x - one)
        most = apart.max(axis=1, initial=0.0)
        plain = np.sqrt((apart**2).sum(axis=1))
        odd = ((most > 1e150) | (most < 1e-150)) & (most > 0)
        if odd.any():
            scaled = np.where(np.isfinite(most[odd]), most[odd], 1.0)
            plain[odd] = np.where(np.isfinite(most[odd]), scaled * np.sqrt(((apart[odd] / scaled[:, None]) ** 2).sum(axis=1)), np.inf)
    return plain


def sketches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, step, rest): a row is about its bytes times its step, and ``rest`` bounds the length of the difference."""
    step = np.abs(x).max(axis=1) / 127
    step = np.where(step > 0, step, np.finfo(float).tiny)
    codes = np.clip(np.rint(x / step[:, None]), -127, 127).astype(np.int8)
    rest = step * np.sqrt(((x / step[:, None] - codes) ** 2).sum(axis=1)) * (1 + 1e-9)
    return codes, step, rest


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def usable(vector: str) -> Column:
    return F.expr(f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vector}, x -> x <> 0)")


_FOUND = "query_id long, vec_id long, low double, high double"


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)


def _bounded(own: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """All rows that may be among the k nearest of a query within a group, with bounds of their distances."""
    out: list[list] = [[], [], [], []]
    if own.num_rows and asked.num_rows:
        x, q = _codes(own["codes"]).astype(np.float64), _codes(asked["codes"]).astype(np.float64)
        ids, names = own["id"].to_numpy(), asked["id"].to_numpy()
        (xs, xr), (qs, qr) = ((t["step"].to_numpy(), t["rest"].to_numpy()) for t in (own, asked))
        once = len(np.unique(ids)) == len(ids)
        xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
        for i in range(0, len(q), 256):
            inner = x @ q[i : i + 256].T
            for j in range(inner.shape[1]):
                n = i + j
                # In units of the larger step, so that nothing overflows.
                most = np.maximum(xs, qs[n])
                a, b = xs / most, qs[n] / most
                square = a * a * xx + b * b * qq[n] - 2 * a * b * inner[:, j]
                with np.errstate(over="ignore"):
                    middle = most * np.sqrt(np.maximum(square, 0))
                    slack = xr + qr[n] + 1e-6 * most * np.sqrt(a * a * xx + b * b * qq[n])
                    low, high = np.maximum(middle - slack, 0), middle + slack
                others = np.flatnonzero(ids != names[n])
                if not once and len(others):
                    # Of rows with one id the nearest counts, before the k-th.
                    others = others[np.lexsort((high[others], ids[others]))]
                    least = others[np.unique(ids[others], return_index=True)[1]]
                else:
                    least = others
                if len(least) > k:
                    others = others[low[others] <= np.partition(high[least], k - 1)[k - 1]]
                out[0] += [names[n]] * len(others)
                out[1] += ids[others].tolist()
                out[2] += low[others].tolist()
                out[3] += high[others].tolist()
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], names=["query_id", "vec_id", "low", "high"])


def near(rows: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, low, high) of what may be among the k nearest of a query among the rows that share ``keys``.

    rows and queries have id, codes, step, rest and the keys, of which the first is the dimension.
    """
    rows, queries = (df.select(*[F.col(c).alias(c) for c in ("id", "codes", "step", "rest", *keys)]) for df in (rows, queries))
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(lambda own, asked: _bounded(own, asked, k), _FOUND)


def possible(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id) of what may be among all its query's k nearest: nearer at best than the k-th at worst."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("high", "vec_id"))
    limit = once.withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("high").alias("limit"))
    return once.join(limit, "query_id", "left").filter("limit IS NULL OR low <= limit").select("query_id", "vec_id")


def _exact(pairs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): pairs ranked by the distance of the vectors themselves; the nearest row of an id counts."""
    one, other = vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("a")), vectors.select(F.col("id").alias("vec_id"), F.col("vector").alias("b"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = batch.column(2), batch.column(3)
                same = np.array([len(x) == len(y) for x, y in zip(a, b, strict=True)])
                part = batch.filter(pa.array(same))
                score = np.array([distances(np.array([x.as_py()]), np.array(y.as_py()))[0] for x, y in zip(part.column(3), part.column(2), strict=True)], float)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])

    told = pairs.join(other, "vec_id").join(one, "query_id").select("query_id", "vec_id", "a", "b").mapInArrow(of, "query_id long, vec_id long, score double")
    once = told.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def tuned(vectors: DataFrame, queries: DataFrame, dim: int, axes: list[int], *, k: int, tables: int, asked: int, recall: float, seed: int) -> int:
    """The fewest probes with which a sample of queries meets ``recall`` of its true neighbours.

    At most ``asked`` queries, the first by a hash of their id, are compared with all rows in one scan that keeps k
    rows for each query and task; the rest is arithmetic on asked * k pairs.
    """
    taken = queries.orderBy(F.xxhash64("id"), "id").limit(asked).select("id", "vector").collect()
    q, names = np.array([r.vector for r in taken], float).reshape(len(taken), dim), np.array([r.id for r in taken], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple[float, list[float]]]] = [{} for _ in names]
        for batch in batches:
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for i, one in enumerate(q):
                apart = distances(x, one)
                some = np.flatnonzero(ids != names[i])
                some = some[np.argsort(apart[some], kind="stable")[: 2 * k]]
                for j in some:
                    if ids[j] not in best[i] or apart[j] < best[i][ids[j]][0]:
                        best[i][int(ids[j])] = (float(apart[j]), x[j].tolist())
                best[i] = dict(sorted(best[i].items(), key=lambda e: (e[1][0], e[0]))[:k])
        rows = [(i, v, d, x) for i, found in enumerate(best) for v, (d, x) in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.list_(pa.float64()))], names=["i", "v", "d", "x"])

    told = vectors.select("id", "vector").mapInArrow(scan, "i int, v long, d double, x array<double>")
    place = F.row_number().over(W.partitionBy("i").orderBy("d", "v"))
    truth = told.dropDuplicates(["i", "v"]).withColumn("place", place).filter(F.col("place") <= k).select("i", "x").collect()
    if not truth:
        return 1
    most = min(int(np.prod(axes)), 512)
    need = np.full(len(truth), most)
    other, of = unit(np.array([r.x for r in truth], float)), np.array([r.i for r in truth])
    for t in range(tables):
        seen = buckets(unit(q), t, axes, most, seed)[of]
        hit = seen == buckets(other, t, axes, 1, seed)
        need = np.minimum(need, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, most))
    return int(np.sort(need)[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)])


def search(
    df: DataFrame, asked: Column, *, k: int = 10, tables: int = 10, target: int = 512, probes: int | None = None, sample: int = 64, recall: float = 0.97, block: int = 4096, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k nearest other rows found for each row for which ``asked`` holds, by Euclidean distance.

    Unit vectors are turned by fast Hadamard pseudo-rotations and assigned to the nearest of all signed axes; the number
    of hashes follows the rows, so that at most about ``target`` of them share a bucket at any size.  Each row lies in
    one bucket of each table, a query looks into its ``probes`` nearest ones.  Unless given, that number is the least
    with which a sample of at most ``sample`` queries meets ``recall`` of its true neighbours: data that cluster cost few
    probes, and the share of rows a query meets falls with the table's size.

    Sketches of a byte for each component are met in the buckets, and what may be among the k nearest by the bounds
    that they give is ranked by exact distance in double precision.  A bucket with more than ``block`` rows is dealt to
    several groups, each of which its queries visit, so no group outgrows memory and no candidate is dropped.  A query
    that meets fewer than k rows is compared with all rows in blocks.

    Vectors that are null, empty, zero or have null or non-finite components take no part, neither as queries nor as
    candidates; nor do rows with a null id.  Vectors of different dimensions aren't compared.  Rows with the query's
    id are never its neighbours; repeated rows count once.  Components may be as large or small as a double; a distance
    beyond the largest double is infinite.  An empty table gives no rows.  Other columns are ignored.

    Returns query_id, rank, vec_id, score.
    """
    numbers = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked")).filter(F.col("id").isNotNull() & usable("vector"))
    numbers = numbers.withColumn("dim", F.size("vector"))
    # A row for each dimension: lengths of vectors, of which a table has one or a few.
    sizes = {r.dim: (r.n, r.m) for r in numbers.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("m")).toLocalIterator()}
    plans = {}
    for dim, (n, m) in sizes.items():
        axes = shape(dim, n, target)
        own = numbers.filter(F.col("dim") == dim)
        few = 1 if not m else probes or tuned(own, own.filter("asked"), dim, axes, k=k, tables=tables, asked=sample, recall=recall, seed=seed)
        plans[dim] = (axes, few)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dim").to_numpy()
            for d in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == d)))
                axes, few = plans[int(d)]
                x = _matrix(part.column("vector"))
                codes, step, rest = sketches(x)
                x = unit(x)
                asks = part.column("asked").to_numpy(zero_copy_only=False)
                homes = np.stack([(np.int64(t) << 48) + buckets(x, t, axes, 1, seed)[:, 0] for t in range(tables)], axis=1)
                visits: list = [None] * len(x)
                if asks.any():
                    found = np.concatenate([(np.int64(t) << 48) + buckets(x[asks], t, axes, few, seed) for t in range(tables)], axis=1)
                    for i, v in zip(np.flatnonzero(asks), found, strict=True):
                        visits[i] = v.tolist()
                arrays = [part.column("id"), part.column("dim"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), pa.array(rest), pa.array(homes.tolist(), pa.list_(pa.int64())), pa.array(visits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "dim", "codes", "step", "rest", "homes", "visits"])

    index = cut(numbers.mapInArrow(hashed, "id long, dim int, codes binary, step double, rest double, homes array<long>, visits array<long>"))
    sketch = ("id", "codes", "step", "rest", "dim")
    homes = index.select(*sketch, F.explode("homes").alias("bucket"))
    # One row for each crowded bucket only; joined, not broadcast, as their number grows with the rows.
    split = index.select("dim", F.explode("homes").alias("bucket")).groupBy("dim", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).filter("parts > 1")
    rows = homes.join(split, ["dim", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    visits = index.filter("visits IS NOT NULL").select(*sketch, F.explode("visits").alias("bucket"))
    queries = visits.join(split, ["dim", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    vectors = numbers.select("id", "vector")
    best = cut(_exact(possible(near(rows, queries, ["dim", "bucket", "part"], k), k), vectors, k))
    full = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = index.filter("visits IS NOT NULL").select(*sketch).join(full, "id", "left_anti")
    if short.isEmpty():
        return best
    n = max(1, sum(n for n, _ in sizes.values()) // (16 * block))
    everything = index.select(*sketch, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"))
    rest = _exact(possible(near(everything, short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["dim", "part"], k), k), vectors, k)
    return best.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select("query_id", "rank", "vec_id", "score").union(rest)
