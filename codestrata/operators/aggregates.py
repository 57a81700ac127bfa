"""Aggregations: distributions, agreement, accuracy, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.stats import kappa, ratio, wilson


def dense_counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A count for each listed value, zero where it is absent; any other value is an error."""
    spark = df.sparkSession
    known = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "position int, value string")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    both = counts.join(F.broadcast(known), "value", "full_outer")
    checked = F.when(F.col("position").isNull(), F.raise_error(F.concat(F.lit(f"{column} out of range: "), F.col("value")))).otherwise(F.col("value"))
    return both.select("position", checked.alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


def grouping_counts(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts by several column lists in one pass; columns outside a list are null there."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, one: str, other: str) -> DataFrame:
    """Items, agreement, chance agreement and Cohen's kappa of two label columns."""
    pairs = df.groupBy(F.col(one).alias("x"), F.col(other).alias("y")).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    first = pairs.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("a"))
    second = pairs.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("b"))
    chance = first.join(second, "v").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("both"))
    out = total.join(F.broadcast(chance), F.lit(True)).withColumn("observed", F.col("same") / F.col("total")).withColumn("expected", F.col("both") / (F.col("total") * F.col("total")))
    return out.select("total", "same", "observed", "expected", kappa(F.col("observed"), F.col("expected")).alias("kappa"))


def fleiss_kappa(df: DataFrame, item: str, label: str) -> DataFrame:
    """Fleiss' kappa over items that all have the same number of labels."""
    cells = df.groupBy(item, label).agg(F.count("*").alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("q"))
    shares = cells.groupBy(label).agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("c").alias("all"))
    mean = items.agg(F.avg((F.col("q") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("observed"), F.count("*").alias("items"))
    out = mean.join(F.broadcast(shares), F.lit(True)).withColumn("expected", F.col("cc") / (F.col("all") * F.col("all")))
    return out.select("items", "observed", "expected", kappa(F.col("observed"), F.col("expected")).alias("kappa"))


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Support, predictions, hits, precision, recall and F1 by class.

    A ratio without a base is null; F1 is null for a class that is neither there nor predicted, and 0 without a hit.
    """
    real = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(guess)).alias("hits"))
    told = df.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("predicted"))
    both = real.join(told, "label", "full_outer").na.fill(0, ["support", "hits", "predicted"])
    return both.select("label", "support", "predicted", "hits", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


def majority(df: DataFrame, item: str, label: str, otherwise: Column | None = None) -> DataFrame:
    """The label that more than half of an item's votes have, or ``otherwise``; and if all agree."""
    votes = df.groupBy(item, label).agg(F.count("*").alias("n"))
    best = votes.groupBy(item).agg(F.sum("n").alias("votes"), F.max_by(label, F.struct("n", label)).alias("top"), F.max("n").alias("most"))
    fallback = F.lit(None) if otherwise is None else otherwise
    return best.select(item, "votes", F.when(2 * F.col("most") > F.col("votes"), F.col("top")).otherwise(fallback).alias("majority"), (F.col("most") == F.col("votes")).alias("unanimous"))


def rate_with_bounds(df: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    """Hits, items, rate and its Wilson bounds by key."""
    counts = df.groupBy(*keys).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counts.select(*keys, "k", "n", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_turn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_turn = 1").drop("_turn")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
