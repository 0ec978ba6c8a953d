"""Corpus preparation: five stages over ``documents``, each working on all that its predecessor kept.

1. language_id: rows whose language can't be told go.
2. near_dedup: of each class of near copies the row with the smallest id stays.
3. decontaminate: rows that contain a benchmark item go.
4. secret_scan: secrets are replaced by a mark; no row goes.
5. byte_bpe: the texts are encoded and decoded; digests of both are returned.

All stages but the last return the columns of ``documents``, in their order and with their types; further columns
pass through unchanged. Every stage gives an empty table for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, langid, minhash, secrets
from graphloom.llm.frames import table, write_shared


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    A text that is null, empty or without letters goes, and one that no known language explains. A null ``lang`` or
    ``source`` is no evidence. Rows that repeat an id are judged each by itself, equal rows alike; long texts whole.
    """
    return langid.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id.

    Rows that repeat an id are one document and stay or go together. Rows without an id, null texts and texts without
    words are no copies of anything and stay. A tie of similarity at exactly 0.8 is a copy.
    """
    return minhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``.

    Null and empty texts contain nothing and stay; items that are null or without words are found nowhere; repeated rows
    stay or go together; a share of exactly 0.8 of an item's shingles is a find. Long texts are searched whole.
    """
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by a mark and ``n_chars``, if it is there, counted again.

    Null texts stay null, with null characters; empty ones stay empty; equal rows are changed alike; of overlapping
    secrets the whole stretch is replaced once.
    """
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, offsets_sha256)`` of each row; a null text counts as empty.

    Rows without an id, and rows that repeat one, have a row each.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontamination), ("secret_scan", secret_scan), ("byte_bpe", byte_bpe)]

#: SQL can't express the merges of a tokenizer, BagMinHash or compressed novelty.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = write_shared(docs)
    return docs
