"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import WORD, cut, spare, uniform


def quality(text: Column) -> Column:
    """Weight of a document: 0.05 plus the share of letters among its characters."""
    return F.lit(0.05) + F.char_length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.char_length(text), F.lit(1))


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float, share: float) -> DataFrame:
    """Targets from one row (source, source_size) for each source.

    Sources in code-point order, null last, take the weights in turn.  A target stops at ``cap`` times its source's
    size; what it leaves goes to the others by weight.  Sources fill up in the order of size over weight, so the
    common level is found by one pass of running sums over that order.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    listed = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_fill = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = (
        sizes.withColumn("weight", listed)
        .withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("full", F.col("level") > F.col("ratio"))
        .withColumn("rank", F.row_number().over(by_fill))
        .withColumn("common", F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("rank"))).over(every))
    )
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def mix_sources(
    df: DataFrame, *, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bands: int = 256, seed: str = "mix", keep: dict[str, Column] | None = None
) -> DataFrame:
    """How many words of each row a mix takes whose sources meet target sizes.

    A source whose target is e times its size gives all its rows floor(e) times; the rest is drawn without
    replacement: each row has the key -ln(u) / quality, u being repeatable, and rows are taken in key order until
    the running sum of sizes meets the budget, the last one in part.

    The running sum is exact at any size: keys are cut into ``bands`` bands, band totals are summed within a source
    (one row each), and rows are put in order only inside a band, so a source with most rows is dealt to many tasks.

    Nulls: a null text has size 0, a null source is a source of its own, a null id draws one common key.  Equal keys
    go in order of id and size; repeated rows are taken one by one.  An empty table gives no rows.  Other columns of
    ``df`` are ignored; ``keep`` names expressions over it to carry along.

    Returns id_col, size, source_size, target, taken and what ``keep`` names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = keep or {}
    rows = df.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), quality(text).alias("_w"), *[v.alias(k) for k, v in keep.items()]
    ).withColumn("_exp", -F.log(uniform(F.col("_id"), seed)) / F.col("_w"))
    rows = rows.drop("_w").withColumn("_band", F.floor((1 - F.exp(-F.col("_exp"))) * bands).cast("int")).withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    rows = cut(rows)
    per_band = rows.groupBy("_source", "_band").agg(F.first("source").alias("source"), F.sum("size").alias("_words"))
    targets = source_targets(per_band.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, cap, share)
    targets = targets.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    before = W.partitionBy("_source").orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        per_band.select("_source", "_band", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_from"))
        .join(targets, "_source")
        .withColumn("_epochs", epochs.cast("long"))
        .withColumn("_rest", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size") + F.lit(0.5)).cast("long"))
    )
    inside = W.partitionBy("_source", "_band").orderBy("_exp", "_id", "size").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("_from") + F.sum("size").over(inside) - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_start")))
    return (
        rows.join(offsets, ["_source", "_band"])
        .withColumn("_start", start)
        .select(F.col("_id").alias(id_col), F.col("size").cast("long"), F.col("source_size").cast("long"), F.col("target").cast("double"), (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"), *keep)
    )


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``df`` as often as taken, the last document of a source cut after its last taken word.

    Rows that agree in id, source and text count as one document whose copies add up.  A document without words is
    never taken.  Other columns go along, whatever their names; an empty table gives no rows.
    """
    columns = df.columns
    ident, digest, part = spare(df, "mix_id", "mix_hash", "mix_part")
    known = {"mix_id": F.col("doc_id"), "mix_hash": F.xxhash64("text", "source")}
    taken = mix_sources(df, keep=known, **options).filter("taken > 0").groupBy("mix_id", "mix_hash").agg(F.sum("taken").alias("mix_taken"), F.first("size").alias("mix_size"))
    taken = taken.select(F.col("mix_id").alias("_i"), F.col("mix_hash").alias("_h"), F.struct("mix_taken", "mix_size").alias("_t"))
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias(ident), F.xxhash64("text", "source").alias(digest)).dropDuplicates([ident, digest])
    joined = own.join(taken, own[ident].eqNullSafe(taken["_i"]) & (own[digest] == taken["_h"]))
    words, size = F.col("_t.mix_taken"), F.col("_t.mix_size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(words / size).cast("int")), F.when(words % size > 0, F.array(words % size)).otherwise(F.array().cast("array<bigint>")))
    given = joined.select("row", F.explode(copies).alias(part))
    text = F.col("row").getField("text")
    cut_text = F.when(F.col(part) == 0, text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col(part).cast("int")), " "))
    return given.select(*[cut_text.alias("text") if c == "text" else F.char_length(cut_text).cast("long").alias("n_chars") if c == "n_chars" else F.col("row").getField(c).alias(c) for c in columns])
