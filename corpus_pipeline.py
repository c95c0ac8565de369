"""A training-data pipeline of four stages, from ``documents`` to token ids.

1. quality: documents that a weakly supervised classifier, fitted on the stage's own input, rejects go;
2. near_duplicates: one document of each group linked by SimHash fingerprints stays;
3. mix: sources are weighed 3, 1, 2; documents come as often as their share of the mix holds them;
4. encode: every text becomes BPE ids, with the text decoded from these checked by its digest.

Each stage but the last returns the columns of its input. Rows without text, repeated rows and other columns
pass as each operator's module defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import bpe, mixing, quality, simhash
from trackloom.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_and_back(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]
#: No SQL: the classifier's training and the tokenizer's merges are beyond it. tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
