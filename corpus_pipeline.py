"""A corpus from raw documents to token ids: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.bpe import encode
from quarryline.llm.leaks import keep_clean
from quarryline.llm.neardup import keep_one
from quarryline.llm.rules import keep_good
from quarryline.llm.secrets import redact_secrets
from quarryline.registry.base import Check, table
from quarryline.session import workspace

#: Bytes of text in a block of the last stage: half the usual, since the workers of earlier stages hold memory beside it.
BLOCK_BYTES = 8 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes. A null or empty text has no words and goes; a row without host
    is judged by itself; repeated rows are judged each."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id. A text without words has no copies; rows without id
    all stay; of rows that repeat an id and its words one stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``. Empty items are held by none, and null texts hold none."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values masked and ``n_chars`` counted again. Null texts stay null; no row is added or lost."""
    return redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, how many they are, and the digests of ids and of the bytes they stand for. Masked texts are what
    ``decode`` makes of the ids. Nulls, empty texts and repeated rows as in ``encode``."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(docs, ranks, public_tokenizers.PATTERN, with_ids=True, block_bytes=BLOCK_BYTES)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("byte_bpe", tokenize),
]

#: Masking by the lexer and tokens cannot be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet below ``spark.checkpoint.dir`` and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = workspace(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


CHECKS = {"pipeline": Check(run, ORACLE_SQL)}
