"""Checks of an export: sources, contexts, counters, invariants, publication."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.sources.files import remove, work_folder


def fingerprint(df: DataFrame, drop: Sequence[str] = ()) -> Column:
    """SHA-256 of a row's JSON, keys sorted, without some columns: equal rows have equal fingerprints in any column order."""
    kept = sorted(c for c in df.columns if c not in drop)
    return F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256)


def unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df``, which fails when it is read if a key is there twice."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    met = df.join(counts, key)
    told = F.concat(F.lit(f"{what} is repeated: "), F.col(key).cast("string"))
    return met.withColumn(key, F.when(F.col("_n") > 1, F.raise_error(told)).otherwise(F.col(key))).drop("_n")


def required(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str], what: str) -> DataFrame:
    """``df`` with the columns of the other's row; a key without one is an error."""
    met = df.join(other.select(key, *columns, F.lit(True).alias("_there")), key, "left")
    told = F.concat(F.lit(f"no {what} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return met.withColumn(key, F.when(F.col("_there").isNull(), F.raise_error(told)).otherwise(F.col(key))).drop("_there")


def attach_status(rows: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """(key, status) of both sides: attached, stale (another fingerprint), missing, partial_kept, excluded or orphan.

    rows has filter_status, deletion_kind and mark; only kept whole functions ask for a context.
    """
    both = rows.select(key, "filter_status", "deletion_kind", F.col("mark").alias("_l"), F.lit(True).alias("_a")).join(contexts.select(key, F.col("mark").alias("_r"), F.lit(True).alias("_b")), key, "full_outer")
    status = (
        F.when(F.col("_a").isNull(), "orphan")
        .when(F.col("filter_status") != "KEPT", "excluded")
        .when(F.col("deletion_kind") != "FULL_FUNCTION", "partial_kept")
        .when(F.col("_b").isNull(), "missing")
        .when(F.col("_l") == F.col("_r"), "attached")
        .otherwise("stale")
    )
    return both.select(key, status.alias("status"))


def context_lists(context: Column, fields: Sequence[str]) -> list[Column]:
    """Lists of a context: null where it was never joined, empty where nothing was found."""
    return [F.when(context.isNull(), F.lit(None)).otherwise(F.coalesce(context[f], F.array())).alias(f) for f in fields]


def checks(one: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(check, ok) for each condition over a row of totals, and ``all``."""
    told = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in conditions.items()])
    with_all = F.concat(told, F.array(F.struct(F.lit("all").alias("check"), F.forall(told, lambda x: x["ok"]).alias("ok"))))
    return one.select(F.explode(with_all).alias("x")).select("x.check", "x.ok")


def shard_name(repo: Column, index: Column, count: Column, suffix: str) -> Column:
    """``owner__name-00001-of-00003`` and a suffix; a repository is an owner and a name."""
    slug = F.when(repo.rlike(r"^[\w.-]+/[\w.-]+$"), F.replace(repo, F.lit("/"), F.lit("__"))).otherwise(F.raise_error(F.concat(F.lit("no repository: "), F.coalesce(repo, F.lit("null")))))
    return F.format_string("%s-%05d-of-%05d%s", slug, index, count, F.lit(suffix))


def publish(frames: dict[str, DataFrame], root: str) -> str:
    """Write several tables under a new version and point to it last: readers see all of them or none.

    Returns the version's folder; if a write fails, what was written of it is removed and the pointer stays.
    """
    spark = next(iter(frames.values())).sparkSession
    at = f"{root}/version-{uuid.uuid4().hex}"
    try:
        for name, df in frames.items():
            df.write.parquet(f"{at}/{name}")
    except Exception:
        remove(spark, at)
        raise
    spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return at


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    at = spark.read.schema("at string").json(f"{root}/current").first().at
    return spark.read.parquet(f"{at}/{name}")


def round_trip(df: DataFrame, write, read) -> DataFrame:
    """What comes back of ``df``: ``write(df, folder)`` below the shared folder, then ``read(spark, folder)``."""
    spark = df.sparkSession
    folder = f"{work_folder(spark)}/sink-{uuid.uuid4().hex}"
    write(df, folder)
    return read(spark, folder)


def same_rows(one: DataFrame, other: DataFrame) -> DataFrame:
    """(only_first, only_second): rows of either side that the other lacks, counted with their copies."""
    columns = sorted(one.columns)
    marks = [F.xxhash64(*columns).alias("_h"), F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("_s")]
    sides = [df.select(*marks).groupBy("_h", "_s").agg(F.count("*").alias(n)) for df, n in ((one, "a"), (other, "b"))]
    both = sides[0].join(sides[1], ["_h", "_s"], "full_outer").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.agg(F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("only_second"))
