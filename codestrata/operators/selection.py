"""Selection of repositories: samples of commits, mining windows, exclusion, cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.ranking import spread

#: Licenses that permit the use of code, limits of size, and the year from which old histories are mined.
PERMISSIVE = ("mit", "mit-0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-3-clause-clear", "bsd-4-clause", "0bsd")
LEAST_COMMITS, SATURATION, RECENT = 1000, 50_000, 2015


def is_bot(kind: Column, login: Column) -> Column:
    """A commit by a bot: by its account's kind or by the end of its name."""
    return F.coalesce(kind == "Bot", F.lit(False)) | F.coalesce(F.endswith(login, F.lit("[bot]")), F.lit(False))


def commit_count(link: Column, items: Column) -> Column:
    """Commits by the last page that a paging header names, else by the items of the one page."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(link, F.lit("")), r'[?&]page=(\d+)>;\s*rel="last"', 1), F.lit("")).cast("int"), items)


def permissive(license: Column) -> Column:
    return F.coalesce(F.lower(F.trim(license)).isin(*PERMISSIVE), F.lit(False))


def excluded_by(archived: Column, fork: Column, language: Column, license: Column, commits: Column, sampled: Column) -> Column:
    """The first rule that leaves a repository out, with the value it met; null if none does."""
    other = F.lower(F.coalesce(language, F.lit(""))) != "python"
    return (
        F.when(archived, "ARCHIVED")
        .when(fork, "FORK")
        .when(other, F.concat(F.lit("LANGUAGE_NOT_PYTHON:"), F.coalesce(language, F.lit("unknown"))))
        .when(~permissive(license), F.concat(F.lit("LICENSE_NOT_PERMISSIVE:"), F.coalesce(license, F.lit("none"))))
        .when(commits < LEAST_COMMITS, F.concat(F.lit(f"COMMITS_BELOW_{LEAST_COMMITS}:"), commits.cast("string")))
        .when(sampled == 0, "NO_RECENT_COMMITS")
    )


def saturated_scale(commits: Column) -> Column:
    """0 up to the least size, 1 from the saturation on, by logarithms between."""
    share = F.log10(commits / F.lit(float(LEAST_COMMITS))) / F.log10(F.lit(SATURATION / LEAST_COMMITS))
    return F.when(commits <= LEAST_COMMITS, 0.0).otherwise(F.least(F.lit(1.0), share))


def mining_window(first_year: Column) -> tuple[Column, Column]:
    """(only recent commits?, first year to mine)."""
    return first_year < RECENT, F.greatest(first_year, F.lit(RECENT))


def sample_ratios(df: DataFrame, keys: Sequence[str], via_pull: Column, refers: Column) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), share(via_pull).alias("pr_ratio"), share(refers).alias("ref_ratio"))


def spread_by(df: DataFrame, keys: Sequence[str], order: Column, k: int) -> DataFrame:
    return spread(df, keys, order, k)


def api_calls(commits: Column, linked: Column, refers: Column, share: float) -> Column:
    """Calls for the context of a share of all commits: one each, and one more for each link and reference."""
    return F.round(commits * F.lit(share) * (1 + F.coalesce(linked, F.lit(0.0)) + F.coalesce(refers, F.lit(0.0)))).cast("bigint")
