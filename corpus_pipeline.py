"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; `run` writes
each stage's rows as Parquet and reads them again for the next. All stages but the last return the columns of documents,
whatever others there are beside doc_id, text, lang and source. Null texts have no letter and go in the first stage; an empty
table gives no rows; repeated rows are near-duplicates, of which one stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, language, mixing, simhash, tokens
from tracemill.llm.common import shared_folder

VOCABULARY = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network puts in a language that the labelled ones teach; others, and those without any letter, go."""
    return language.in_a_language(docs, language.fit(docs, ~language.held_out(F.col("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled by output shard."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.tokenized(docs, public_tokenizers.path(VOCABULARY), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: A byte network, SimHash groups and a tokenizer cannot be expressed in SQL; tests/llm/test_pipeline.py holds each stage
#: against plain Python on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
