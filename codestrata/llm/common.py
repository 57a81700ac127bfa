"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Only a session whose executors are threads of the driver may do without: it gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder, so that its size is known to plans, and read it again."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; those of kinds that Spark doesn't hash, such as maps, count by their JSON text."""
    odd = [c for c, kind in df.dtypes if "map<" in kind or "variant" in kind]
    return F.xxhash64(*[F.to_json(F.struct(quoted(c).alias("x"))) if c in odd else quoted(c) for c in df.columns])


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pieces(df: DataFrame, piece_bytes: int, text_col: str) -> int:
    """Number of pieces of about ``piece_bytes`` that the input asks for; at least the shuffle partitions.

    Spark's own estimate (files below a scan) costs no job.  Where it has none, as for rows from the driver, the
    texts are measured.
    """
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if estimate >= 1 << 60:
        estimate = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(partitions(df), estimate // piece_bytes + 1)


def uniform(column: Column, seed: str) -> Column:
    """A repeatable number in (0, 1) for each value: 52 bits of an MD5 digest, the same in every SQL engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
