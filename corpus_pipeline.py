"""The corpus pipeline: quality, exact and near duplicates, benchmark passages, tokens.

Each stage reads all that the one before it kept, written as Parquet in the shared folder. The first four
return rows of documents, unchanged and with all columns; the last returns tokens. What a stage itself wrote on
the way, and the stage before it, is deleted once the stage is written. Counted with lakeloom.llm.

Defined cases: null and empty texts have no words, so the quality stage rejects them; after that (each stage also
takes any table) they are equal texts to the exact and the near stage, hold no item and have no tokens. Rows without
a doc_id are one document to the exact stage, are kept by the near stage, and are dropped together by the benchmark
stage if one of them holds an item. Rows that repeat a doc_id are kept or dropped together by all stages but the
first, which looks at each text. Of ties the smallest doc_id stays. Very long texts are read whole. Empty tables give
empty tables. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import bpe, decontamination, exact_dedup, quality, simhash
from lakeloom.llm.common import read, removed, swept, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.tokenized(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("tokens", token_stage),
]

#: Its first stage is a fitted classifier, which SQL can't express; tests/llm holds it against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with swept(spark, keep=1):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
