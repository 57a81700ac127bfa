"""Statistical expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959964


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, kept in [0, 1]; null without observations."""
    p = k / n
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    low, high = ((p + F.lit(z * z) / (2 * n) + sign * spread) / (1 + F.lit(z * z) / n) for sign in (-1, 1))
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def kappa(observed: Column, expected: Column) -> Column:
    """Chance-corrected agreement; null when chance alone would agree."""
    return F.when(F.abs(1 - expected) > 1e-12, (observed - expected) / (1 - expected))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial p value of unequal pairs: the tail up to the smaller side, doubled.

    The tail's last and largest term is taken by logarithms, the others as shares of it, so nothing overflows however
    many pairs there are; a p value below the least double is 0.
    """
    n, k = wins + losses, F.least(wins, losses)
    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    largest = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i)) - n * F.log(F.lit(2.0))
    start = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s"))
    # From the term of k down to that of 0.
    shares = F.aggregate(steps, start, lambda a, i: F.struct((a["c"] * (k - i + 1) / (n - k + i)).alias("c"), (a["s"] + a["c"] * (k - i + 1) / (n - k + i)).alias("s")), lambda a: a["s"])
    return F.least(F.lit(1.0), 2 * F.exp(largest) * shares)


def frechet(p: Column, a: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), p + a - 1), F.least(p, a)
