"""Stored vectors of records: a part for each repository, a manifest of what each part was made of, and only stale parts made anew."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.text import tokens
from codestrata.sources.files import exists, publish, remove, work_folder

#: Version of a part's columns: parts of another one are stale.
LAYOUT = 1


class Encoder(NamedTuple):
    """An offline encoder: signed counts of a text's first tokens by hash, of unit length; its name tells its kind."""

    name: str = "token-hash"
    width: int = 64
    most_tokens: int = 256


def encoded(text: Column, encoder: Encoder = Encoder()) -> Column:
    """The vector of a text; one without tokens has a zero vector."""
    width = encoder.width

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, int]] = {}
        for column in batches:
            out = np.zeros((len(column), width), np.float32)
            for i, row in enumerate(column):
                for t in row.as_py() or ():
                    if t not in known:
                        h = zlib.crc32(t.encode())
                        known[t] = (h % width, 1 if h >> 31 else -1)
                        if len(known) > 100_000:
                            known = {t: known[t]}
                    at, sign = known[t]
                    out[i, at] += sign
            length = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out /= np.where(length > 0, length, 1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return F.arrow_udf(encode, "array<float>")(F.slice(tokens(F.coalesce(text, F.lit(""))), 1, encoder.most_tokens))


def content_of(*columns: Column) -> list[Column]:
    """(count, digest) of a group's rows, whatever their order: sums of a hash in two parts, so equal rows don't cancel out."""
    h = F.xxhash64(*columns)
    parts = [F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))]
    return [F.count("*").alias("n"), F.md5(F.concat_ws(":", F.count("*").cast("string"), *[p.cast("string") for p in parts])).alias("digest")]


def _manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    return spark.read.parquet(f"{folder}/manifest") if exists(spark, f"{folder}/manifest") else None


def write_vectors(df: DataFrame, folder: str, *, key: str, repo: str, text: str, encoder: Encoder = Encoder()) -> DataFrame:
    """Bring the parts below ``folder`` up to date with the rows: (repo, n, digest, fresh) of each repository.

    A part is made anew if its rows, the encoder or the layout differ from what the manifest says; others aren't
    touched, and those of repositories that are gone are removed.  The manifest is put in place last, so a run that was
    broken off is made up for by the next one.  A null repository counts as one without a name.

    Texts are encoded in order of their lengths within a task, so batches hold texts of like lengths.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"), F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    work_folder(spark)
    made_of = F.concat_ws(":", F.lit(encoder.name), F.lit(str(encoder.width)), F.lit(str(encoder.most_tokens)), F.lit(str(LAYOUT)))
    now = rows.groupBy("repo").agg(*content_of(F.col("key"), F.col("text"))).withColumn("made_of", made_of).checkpoint()
    was = _manifest(spark, folder)
    stale = now if was is None else now.join(was, ["repo", "digest", "made_of"], "left_anti")
    stale = stale.select("repo").checkpoint()
    if not stale.isEmpty():
        own = rows.join(stale, "repo").sortWithinPartitions(F.char_length("text")).select("repo", "key", encoded(F.col("text"), encoder).alias("vector"))
        own.withColumn("_part", F.concat(F.lit("r"), F.md5("repo"))).write.partitionBy("_part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/parts")
    if was is not None:
        for row in was.join(now, "repo", "left_anti").select(F.md5("repo").alias("p")).toLocalIterator():  # repositories that are gone
            remove(spark, f"{folder}/parts/_part=r{row.p}")
    told = now.join(stale.withColumn("fresh", F.lit(True)), "repo", "left").select("repo", "n", "digest", F.coalesce("fresh", F.lit(False)).alias("fresh"), "made_of").checkpoint()
    aside = f"{folder}/manifest.{uuid.uuid4().hex}"
    told.drop("fresh").coalesce(1).write.parquet(aside)  # a row for each repository
    publish(spark, aside, f"{folder}/manifest")
    return told.drop("made_of")


class StaleError(ValueError):
    """The parts aren't those that the manifest speaks of."""


def merged_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, code, key, vector) of all parts; codes number the repositories by name.

    A part whose rows aren't as many as the manifest says is an error: it must be made again.
    """
    parts = spark.read.parquet(f"{folder}/parts").drop("_part")
    manifest = _manifest(spark, folder)
    codes = manifest.select("repo", F.col("n").alias("_n"), (F.row_number().over(W.orderBy("repo")) - 1).alias("code"))  # a row for each repository
    seen = parts.groupBy("repo").agg(F.count("*").alias("_seen"))
    odd = seen.join(codes, "repo", "full_outer").filter(~F.col("_seen").eqNullSafe(F.col("_n"))).select("repo").limit(1).collect()
    if odd:
        raise StaleError(f"the part of {odd[0].repo!r} isn't what the manifest says")
    return parts.join(codes.drop("_n"), "repo").select("repo", "code", "key", "vector")
