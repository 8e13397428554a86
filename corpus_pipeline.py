"""Corpus pipeline: language, repeated lines, near copies, benchmark passages, token ids.

Each stage takes the documents that the one before it kept, works on all of them, and is written as Parquet before the
next one starts. All but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import bytebpe, langid, linededup, nearcopies, winnow
from tagmill.llm.common import discard, materialise, read_table, without, workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: texts without a letter, and those nearer to random letters than to any
    learned language."""
    return langid.accepted(docs, langid.train(langid.sample(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five or more documents hold stay in the last of them only; n_chars follows the text."""
    kept = linededup.LineIndex.build(docs).rewrite(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Documents without an id or words stay."""
    classes = nearcopies.near_copies(docs)
    return without(docs, materialise(classes.filter("doc_id <> keep_id").select("doc_id"), "copies"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Documents without an id stay."""
    hits = winnow.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return without(docs, materialise(hits.filter("contaminated").select("doc_id"), "contaminated"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, with digests of the ids and of the text they decode to."""
    return bytebpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: Language models and SimHash can't be expressed in SQL; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written for itself goes when its result is written, and that result when the
    next one is."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with workspace(spark):
            docs = materialise(stage(spark, before, sf_dir), name, keep=True)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
