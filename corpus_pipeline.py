"""The corpus pipeline: five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last give whole rows of documents, with
their columns, also such as operators use names of.

What holds for all: nulls in any column but doc_id and text only pass through; very long texts are
read whole; an empty table gives an empty one; steps that a stage starts from run when it is called.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.bpe import encode_documents
from basketry.llm.common import forget, saved
from basketry.llm.decontaminate import drop_contaminated
from basketry.llm.exact_dedup import drop_copies
from basketry.llm.language_id import keep_identified
from basketry.llm.ngram_join import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that ``docs`` teach: null and empty texts, texts without letters, and those whose words speak for no language go.

    Repeated rows all stay or go; null ids are kept; ties between languages don't matter here.
    """
    return keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal texts, null and empty ones being equal.

    Null ids lose; of rows equal in id and text one stays.
    """
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies: Jaccard similarity of 0.8 and more over five words, and what that leads to.

    Documents without words, null and empty ones too, are alone and stay. Null ids lose; of rows equal in id and text one stays.
    """
    return drop_near_duplicates(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with the benchmark; those without words, null and empty ones too, aren't.

    Repeated rows all stay or go; null ids are kept.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document left; a null text counts as empty and has no ids.

    Repeated rows give repeated results; null ids are kept; other columns are left out.
    """
    encoded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontaminate", contamination),
    ("bpe", tokens),
]

#: Learning, MinHash and tokens have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
