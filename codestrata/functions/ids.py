"""Hashes and stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(seed: str, ident: Column) -> Column:
    """Sort key of repeatable samples: 64 hexadecimal digits."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256)


def shard_of(ident: Column, shards: int) -> Column:
    """SHA-256 of the id as one number, modulo ``shards``: digits are folded in one by one."""
    digest = F.sha2(ident, 256)
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0), lambda a, i: (a * 16 + F.instr(F.lit("0123456789abcdef"), F.substring(digest, i, F.lit(1))) - 1) % shards)


def repo_slug(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("__"))


def shard_name(repo: Column, index: Column, count: Column, suffix: str) -> Column:
    return F.format_string("%s-%05d-of-%05d" + suffix, repo_slug(repo), index, count)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) of a name in a namespace given as a UUID."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    part = lambda start, n: F.substring(digest, start, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
