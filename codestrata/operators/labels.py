"""Labels of two raters: agreement, settled labels, constraints, recovery by tiers.

``labels`` is an array of (rater, reason, grade, confidence, note, anchored) in order of the raters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.stats import kappa, wilson
from codestrata.functions.text import bind
from codestrata.sources.adapters import GRADES, REASONS

#: Tags that say why a reason is unknown, and the one for records that no filter should have passed.
CAUSES = ("no-context", "vague-message", "no-replacement", "no-caller-info")
FILTER_MISS = "filter-miss"
#: Least confidence of inferred grades that count, by tier (None: none counts); limits of the gate's verdicts.
TIERS = {"explicit_only": None, "inferred_min": 0.5, "inferred_strong": 0.8}
PROCEED, TIGHTEN = (3, 5), (2, 5)
#: Agreement below which labels are a risk, and the accuracy that is asked for at most.
KAPPA_RISK, TOLERANCE, ACCURACY = 0.60, 1e-9, 0.80
RANKED = ("UNKNOWN", "INFERRED", "EXPLICIT")


def gathered(ratings: DataFrame) -> DataFrame:
    """(record_id, labels): a record has one row for each of its few raters."""
    columns = ("rater", "reason", "grade", "confidence", "note", "anchored")
    return ratings.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("labels"))


def all_same(labels: Column, field: str) -> Column:
    return (F.size(labels) >= 2) & (F.size(F.array_distinct(F.transform(labels, lambda x: x[field]))) == 1)


def agreed_label(labels: Column) -> Column:
    """The first rater's label where reasons and grades are the same, with a note of whose it is; null otherwise."""
    first = F.get(labels, F.lit(0))
    others = F.array_join(F.transform(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x["rater"]), ", ")
    told = F.struct(first["reason"].alias("reason"), first["grade"].alias("grade"), first["confidence"].alias("confidence"), F.lit("AGREED").alias("method"), F.concat(first["rater"], F.lit(" before "), others).alias("note"))
    return F.when(all_same(labels, "reason") & all_same(labels, "grade"), told)


#: What a ruling takes over from one label as a whole.
TAKEN_OVER = ("reason", "grade", "evidence_text", "evidence_source", "evidence_locator", "confidence")


def chosen_rater(labels: Column, final: Column, fields: Sequence[str] = TAKEN_OVER) -> Column:
    """The one rater whose label equals a final one in all ``fields``; null if there isn't exactly one."""
    met = F.filter(labels, lambda x: reduce(and_, [x[f].eqNullSafe(final[f]) for f in fields]))
    return F.when(F.size(met) == 1, F.get(met, F.lit(0))["rater"])


def has_tag(note: Column, tag: str) -> Column:
    """Whether a note holds a tag as a word of its own."""
    return F.coalesce(note, F.lit("")).rlike(rf"(?<![A-Za-z0-9_-])\Q{tag}\E(?![A-Za-z0-9_-])")


def label_problems(reason: Column, grade: Column, confidence: Column, note: Column) -> Column:
    """What is wrong with a label, as an array of names."""
    known, graded = F.coalesce(reason.isin(*REASONS), F.lit(False)), F.coalesce(grade.isin(*GRADES), F.lit(False))
    cause = has_tag(note, FILTER_MISS)
    for tag in CAUSES:
        cause = cause | has_tag(note, tag)
    checks = {
        "reason": ~known,
        "grade": ~graded,
        "unknown": known & graded & ((reason == "UNK") != (grade == "UNKNOWN")),
        "confidence": (grade == "INFERRED") & (confidence.isNull() | F.isnan(confidence) | ~confidence.between(0, 1)),
        "cause": (grade == "UNKNOWN") & ~cause,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))


def resolved(labels: Column, final: Column) -> Column:
    """(reason, grade, confidence) as settled: by a person's final label, else where raters agree, with the least confidence."""
    settled = F.struct(final["reason"].alias("reason"), final["grade"].alias("grade"), final["confidence"].cast("double").alias("confidence"))
    grade = F.when(all_same(labels, "grade"), F.get(labels, F.lit(0))["grade"])
    sure = F.when(grade.isNotNull() & F.forall(labels, lambda x: x["confidence"].isNotNull()), F.array_min(F.transform(labels, lambda x: x["confidence"])))
    own = F.struct(F.when(all_same(labels, "reason"), F.get(labels, F.lit(0))["reason"]).alias("reason"), grade.alias("grade"), sure.alias("confidence"))
    return F.when(final["grade"].isNotNull() & (final["method"] != "AGREED"), settled).otherwise(own)


def recovered(grade: Column, confidence: Column, least: float | None) -> Column:
    """Whether a tier counts a record: explicit ones always, inferred ones from its confidence on."""
    if least is None:
        return F.coalesce(grade == "EXPLICIT", F.lit(False))
    return F.coalesce((grade == "EXPLICIT") | (grade == "INFERRED") & (confidence.cast("decimal(38,18)") >= F.lit(str(least)).cast("decimal(38,18)")), F.lit(False))


def verdict(met: Column, of: Column) -> Column:
    """The gate's verdict by whole numbers, so that a rate of exactly 3/5 or 2/5 is on the right side."""
    return F.when(of <= 0, "UNDECIDABLE").when(met * PROCEED[1] >= of * PROCEED[0], "PROCEED").when(met * TIGHTEN[1] >= of * TIGHTEN[0], "TIGHTEN").otherwise("PIVOT")


def recovery(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and verdict of each tier, and one decision: the common verdict, or that they are split."""
    decided = F.col("grade").isNotNull()
    found = df.groupBy(*keys).agg(F.count_if(decided).alias("resolved"), F.count_if(~decided).alias("unresolved"), *[F.count_if(recovered(F.col("grade"), F.col("confidence"), least)).alias(name) for name, least in TIERS.items()])
    told = F.array(*[verdict(F.col(name), F.col("resolved")) for name in TIERS])
    return found.withColumn("verdicts", told).withColumn("decision", F.when(F.array_contains("verdicts", "UNDECIDABLE"), "UNDECIDABLE").when(F.size(F.array_distinct("verdicts")) == 1, F.get("verdicts", F.lit(0))).otherwise("SPLIT"))


def _rank(grade: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in RANKED]), grade)


def bounds(labels: Column) -> Column:
    """(low, low_confidence, high, high_confidence, kind): the weakest and strongest reading of a record's labels."""
    own = F.filter(labels, lambda x: F.coalesce(x["grade"].isin(*RANKED), F.lit(False)))
    ranks = F.transform(own, lambda x: _rank(x["grade"]))
    names = F.array(*[F.lit(g) for g in RANKED])
    at = lambda r: F.get(names, (r - 1).cast("int"))
    least, most = F.array_min(ranks), F.array_max(ranks)
    every = F.transform(own, lambda x: x["confidence"])
    strong = F.array_compact(F.transform(F.filter(own, lambda x: _rank(x["grade"]) == most), lambda x: x["confidence"]))
    short = lambda r: F.substring(at(r), 1, 1)
    kind = F.when(least == most, F.concat(short(least), F.lit("-"), short(least), F.lit(" confidence"))).otherwise(F.concat(short(most), F.lit("-"), short(least)))
    told = F.struct(at(least).alias("low"), F.when(F.forall(every, lambda c: c.isNotNull()), F.array_min(every)).alias("low_confidence"), at(most).alias("high"), F.array_max(strong).alias("high_confidence"), kind.alias("kind"))
    return F.when(F.size(own) > 0, told)


def not_meaningful(labels: Column, final: Column, fields: Sequence[str] = TAKEN_OVER) -> Column:
    """Whether people settled that a record is none: the chosen rater's tag, or everyone's."""
    chosen = chosen_rater(labels, final, fields)
    tagged = lambda x: has_tag(x["note"], FILTER_MISS)
    return F.when(final["method"] == "THIRD_PARTY", bind(chosen, lambda c: F.exists(labels, lambda x: (x["rater"] == c) & tagged(x)))).otherwise((F.size(labels) > 0) & F.forall(labels, tagged))


def unknown_causes(note: Column) -> Column:
    """Tags of an unknown label: causes, else the filter's, else none."""
    causes = F.array_compact(F.array(*[F.when(has_tag(note, t), F.lit(t)) for t in CAUSES]))
    return F.when(F.size(causes) > 0, causes).when(has_tag(note, FILTER_MISS), F.array(F.lit(FILTER_MISS))).otherwise(F.array(F.lit("none")))


def pairs_of(gathered_labels: DataFrame, field: str) -> DataFrame:
    """(first, second, a, b): the values of exactly two raters who weren't led by something, in order of their names."""
    own = F.filter("labels", lambda x: ~F.coalesce(x["anchored"], F.lit(False)))
    two = gathered_labels.select("record_id", own.alias("l")).filter(F.size("l") == 2)
    return two.select("record_id", *[F.get("l", F.lit(i))[f].alias(n) for i, f, n in ((0, "rater", "first"), (1, "rater", "second"), (0, field, "a"), (1, field, "b"))])


def agreement(pairs: DataFrame) -> DataFrame:
    """Observed and chance agreement of each pair of raters over counts of (a, b); no row but counts is shuffled."""
    keys = ["first", "second"]
    counts = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agreed"))
    side = lambda c: counts.groupBy(*keys, F.col(c).alias("v")).agg(F.sum("n").alias(f"n_{c}"))
    chance = side("a").join(side("b"), [*keys, "v"]).groupBy(*keys).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("products"))
    found = total.join(chance, keys, "left").withColumn("observed", F.col("agreed") / F.col("total")).withColumn("expected", F.coalesce("products", F.lit(0)) / (F.col("total") * F.col("total")))
    low, high = wilson(F.col("agreed"), F.col("total"))
    return found.select(*keys, "total", "agreed", "observed", "expected", kappa(F.col("observed"), F.col("expected")).alias("kappa"), low.alias("low"), high.alias("high"))


def product_interval(x1: Column, n1: Column, x2: Column, n2: Column, z: float = 1.959964) -> Column:
    """(low, high) of the product of two independent shares, by the delta method on a logarithmic scale; null with a zero."""
    p1, p2 = x1 / n1, x2 / n2
    error = F.sqrt((1 - p1) / (n1 * p1) + (1 - p2) / (n2 * p2))
    return F.when((x1 > 0) & (x1 <= n1) & (x2 > 0) & (x2 <= n2), F.struct((p1 * p2 * F.exp(-z * error)).alias("low"), (p1 * p2 * F.exp(z * error)).alias("high")))


def majority(votes: Column) -> Column:
    """The value that more than half of the votes have, else UNK."""
    return F.coalesce(F.get(F.filter(F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda x: x == v)) * 2 > F.size(votes)), F.lit(0)), F.lit("UNK"))
