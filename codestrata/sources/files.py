"""Readers and writers of record files."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Only a session whose executors are threads of the driver may do without: it gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="work-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whichever file system holds it."""
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _file_system(spark, folder)
    return fs.exists(path)


def version_of(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of the files below the paths: another one when any file is written anew."""
    told = []
    for p in paths:
        fs, path = _file_system(spark, p)
        found = fs.listFiles(path, True)
        while found.hasNext():
            one = found.next()
            told.append(f"{one.getPath().toString()} {one.getLen()} {one.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()[:32]


def publish(spark: SparkSession, built: str, folder: str) -> None:
    """Put a folder that was built aside in place of ``folder``: readers see the old one or the new one as a whole.

    If the new one can't be moved, the old one comes back.
    """
    (fs, new), (_, place), (_, old) = (_file_system(spark, x) for x in (built, folder, f"{folder}.old"))
    if not fs.exists(new):
        raise FileNotFoundError(built)
    if fs.exists(place):
        fs.delete(old, True)
        if not fs.rename(place, old):
            raise OSError(f"{folder} can't be moved aside")
    if not fs.rename(new, place):
        if fs.exists(old):
            fs.rename(old, place)
        raise OSError(f"{built} can't be moved to {folder}")
    fs.delete(old, True)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, *, strict: bool = False, glob: str | None = None) -> DataFrame:
    """JSON lines, gzipped or not; only a line feed ends a record.  ``strict`` fails on a broken line."""
    reader = spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines of text files, numbered from 1 within each file, however files are split.

    A split tells how many lines it has, and a line's number is its place in its split after all splits before.
    """
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("file", "block", "first", before.alias("before"))
    return rows.join(placed, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def numbered_objects(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line, and the schema's columns) of JSON lines; blank lines are passed by, a line that is no object is an error that names it."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    place = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" is no object"))
    read = F.from_json("value", schema)
    sound = F.rlike("value", F.lit(r"^\s*\{")) & F.try_parse_json("value").isNotNull()
    return lines.select("file", "line", F.when(sound, read).otherwise(F.raise_error(place)).alias("_x")).select("file", "line", "_x.*")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, required: Sequence[str] = (), unique: str | None = None) -> DataFrame:
    """CSV with a header; a null in a required column is an error, and so is a repeated key."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    if unique and not df.groupBy(unique).count().filter("count > 1").isEmpty():
        raise ValueError(f"{unique} is repeated in {path}")
    return df


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, SHA-256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def export_dataset(df: DataFrame, folder: str, by: str = "repo") -> None:
    """The same rows as zstd Parquet and as gzipped JSON lines, partitioned alike."""
    df.write.partitionBy(by).option("compression", "zstd").parquet(f"{folder}/parquet")
    df.withColumn("_by", F.col(by)).write.partitionBy("_by").option("ignoreNullFields", False).option("compression", "gzip").json(f"{folder}/jsonl")


def verify_export(spark: SparkSession, folder: str, by: str = "repo") -> DataFrame:
    """Rows of each partition, and whether both formats hold the same: counts and sums of row hashes agree."""
    one = spark.read.parquet(f"{folder}/parquet")
    two = spark.read.schema(one.schema).json(f"{folder}/jsonl")
    columns = sorted(one.columns)
    digest = F.sum((F.xxhash64(*columns) % 1_000_000_007).cast("long"))
    sums = [x.groupBy(by).agg(F.count("*").alias(f"n{i}"), digest.alias(f"h{i}")) for i, x in enumerate((one, two))]
    both = sums[0].join(sums[1], by, "full_outer")
    return both.select(by, F.col("n0").alias("n"), F.coalesce((F.col("n0") == F.col("n1")) & (F.col("h0") == F.col("h1")), F.lit(False)).alias("same"))
