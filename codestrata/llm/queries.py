"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import conversations, credentials, oracles
from codestrata.llm.common import table
from codestrata.llm.importance import importance
from codestrata.llm.language import held_out, identify
from codestrata.llm.mixing import mix_sources
from codestrata.llm.neighbours import search
from codestrata.llm.packing import pack
from codestrata.llm.pages import extract_main_text
from codestrata.llm.pii import BASE, digest, find_pii, scores
from codestrata.llm.repeats import remove_repeats
from codestrata.llm.sharding import shard_by_splitters
from codestrata.llm.simhash import hexadecimal, near_duplicates
from codestrata.llm.weighted import fingerprint_pairs


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_splitters(table(spark, sf_dir, "documents"), 24)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), scores(F.col("spans")).alias("scores"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["k"] < len(credentials.BASE))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in credentials.BASE]
    told = [F.col(f"spans.{c}").alias(c) for c in ("guesses", "segments")]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), *told)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(*conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neighbours, op2_simhash, op3_main_text, op4_language, op5_shard, op6_pii, op7_mix, op8_fingerprint, op9_repeats, op10_pack, op11_secrets, op12_repair, op13_resample)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mix": oracles.MIX}
