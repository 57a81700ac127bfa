"""A corpus pipeline: language, near-duplicates, personal data, source mix, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codestrata.llm.common import shared_folder, table
from codestrata.llm.language import known_language
from codestrata.llm.mixing import mixed_documents
from codestrata.llm.nearcopies import one_of_each
from codestrata.llm.packing import pack
from codestrata.llm.pii import redact
from codestrata.sources.files import remove

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no learned language has half of the letters, go.

    Null and empty texts go; repeated rows are judged each; without labelled rows no language is known and all go.
    """
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near copies stays: five-word shingles, similarity 0.8 or more.

    Null and wordless texts are copies of each other; a null id comes last; rows that share an id are settled by a hash
    of the whole row, so reruns agree.
    """
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; null texts stay null, all rows stay."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their targets: documents are left out, or there more than once.

    Null and wordless texts are never taken; equal keys go in order of id and size; a null source is a source.
    """
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths of each row; a null text is the end token alone, repeated rows are packed each."""
    return pack(docs, TOKENIZER)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", packed)]

#: SQL has no conditional random field and no tokenizer; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder, and the next one reads that.

    Columns other than those a stage works on go along to the last one, whatever their names; an empty table gives no
    rows.  A stage's folder goes when the next one has been written.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if number:
            remove(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
