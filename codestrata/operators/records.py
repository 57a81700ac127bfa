"""Checks of records against each other and against raw lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a line of a record file begins with, and the field that tells its status.  Inside of a text quotes
#: are escaped, so a text that looks like these fields doesn't match.
REPO_AT_START = r'^\{"repo": "([^"\\]+)"'
STATUS = r'(?<!\\)"filter_status": "([A-Z_]+)"'


class OverlapError(ValueError):
    """Two sets that must have nothing in common do."""


def scan_status(line: Column) -> Column:
    """(repo, status) of a raw line by patterns alone; null where the repository isn't first or there isn't exactly one status."""
    found = F.regexp_extract_all(line, F.lit(STATUS), F.lit(1))
    repo = F.nullif(F.regexp_extract(line, REPO_AT_START, 1), F.lit(""))
    return F.when(repo.isNotNull() & (F.size(found) == 1), F.struct(repo.alias("repo"), F.get(found, F.lit(0)).alias("status")))


def kept_records(lines: DataFrame, schema: str, column: str = "value", status: str = "KEPT") -> DataFrame:
    """Records of one status: only its lines, and those that patterns can't tell, are decoded, and what is decoded decides.

    A line that is no object is an error.
    """
    told = scan_status(F.col(column))
    asked = lines.filter(told.isNull() | (told["status"] == status))
    record = F.from_json(column, schema, {"mode": "FAILFAST"})
    return asked.select(F.when(F.col(column).rlike(r"^\s*\{"), record).otherwise(F.raise_error(F.lit("a line is no object"))).alias("x")).select("x.*").filter(F.col("filter_status") == status)


def assert_disjoint(one: DataFrame, other: DataFrame, key: str, what: str = "sets") -> None:
    """An error that names a few keys that both have."""
    both = one.select(key).join(other.select(key), key, "left_semi").distinct().orderBy(key).limit(5).collect()
    if both:
        raise OverlapError(f"{what} have {key} in common: {[r[0] for r in both]}")


def aware_problem(value: Column) -> Column:
    """Why a date can't be taken for an instant: null, unreadable, or naive (without an offset); null if it can."""
    read = F.try_to_timestamp(value)
    return F.when(value.isNull(), "null").when(read.isNull(), "unreadable").when(~value.rlike(r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"), "naive")


def aware_instant(value: Column) -> Column:
    """The instant of a date with an offset; one that is naive or unreadable is an error and isn't guessed at."""
    problem = aware_problem(value)
    return F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("author_date is "), problem)).cast("timestamp")).otherwise(F.try_to_timestamp(value))


def verify_labels(rows: DataFrame, labels: DataFrame, fields: tuple[str, ...], key: str = "id", policy: str = "code_policy", evidence: str = "evidence_text") -> DataFrame:
    """(key, found) of settled labels against exported rows: missing, changed, or the same.

    Of rows that only link to their code the evidence must be gone, as it may quote code; all else must be equal.
    """
    own = labels.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    met = own.join(rows.withColumn("_there", F.lit(True)), F.col("_key") == F.col(key), "left")
    wanted = {f: F.when(F.col(policy) == "LINK_ONLY", None).otherwise(F.col(f"_{f}")) if f == evidence else F.col(f"_{f}") for f in fields}
    same = F.lit(True)
    for f, value in wanted.items():
        same = same & F.col(f).eqNullSafe(value)
    return met.select(F.col("_key").alias(key), F.when(F.col("_there").isNull(), "missing").when(~same, "changed").otherwise("same").alias("found"))
