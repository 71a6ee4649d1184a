"""Training corpus from ``documents``: the operators of ``tablepact.llm`` as stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of documents; the last returns
the stored documents' places and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm import decontaminate, language_id, simhash_anchor, source_mix, token_orc
from tablepact.llm.common import DOC_COLUMNS, id_remainder, long_texts, materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; the model learns from two thirds of ``docs``."""
    long_texts(spark)
    model = language_id.train(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    return language_id.keep_identified(docs, model).select(*DOC_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    long_texts(spark)
    return simhash_anchor.keep_one(docs).select(*DOC_COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    long_texts(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*DOC_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each document that the mix takes, a row for each pass over its source."""
    long_texts(spark)
    return source_mix.Mix(docs).documents().select(*DOC_COLUMNS)


def store_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC, read back: (doc_id, start, n_tokens, ids_crc32)."""
    long_texts(spark)
    return token_orc.token_digests(docs, word_store=(40_000, 100_000))  # executors also hold what the stages before left in their heap


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("source_mix", mix_sources),
    ("token_orc", store_token_ids),
]

#: Trained models, fingerprints, alignments and tokenisers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
