"""Keyword labels, decisions, grades, and a text classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def decide(scores: Column) -> Column:
    """The best of (score, place, label) entries; UNK if none is positive."""
    best = F.array_max(scores)
    return F.struct(F.when(best["score"] > 0, best["label"]).otherwise("UNK").alias("label"), best["score"].alias("score"))


def grade(known: Column, named: Column, told: Column, replacement: Column) -> Column:
    """Grade and confidence by the strongest evidence there is."""
    level = F.when(~known, "UNKNOWN").when(named, "EXPLICIT").otherwise("INFERRED")
    sure = F.when(~known, 0.0).when(named, 1.0).when(told, 0.6).when(replacement >= 0.5, F.least(F.lit(0.9), replacement)).otherwise(0.5)
    return F.struct(level.alias("grade"), sure.alias("confidence"))


def weaker_grade(grades: Column, order: Sequence[str]) -> Column:
    """The grade that comes last in ``order``."""
    names = F.array(*[F.lit(g) for g in order])
    return F.get(names, (F.array_max(F.transform(grades, lambda g: F.array_position(names, g))) - 1).cast("int"))


def train_text_classifier(df: DataFrame, text: str, label: str, features: int = 1 << 16):
    """TF-IDF over words and word pairs with a logistic regression; returns a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False),
            NGram(inputCol="_words", outputCol="_pairs", n=2),
            SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
            HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=features),
            IDF(inputCol="_counts", outputCol="_weighed"),
            Normalizer(inputCol="_weighed", outputCol="features"),
            StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip"),
            LogisticRegression(featuresCol="features", labelCol="_label", regParam=0.001, maxIter=30),
        ]
    ).fit(df)
