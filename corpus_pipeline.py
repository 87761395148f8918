"""A corpus pipeline: language identification, near-duplicates, repeated passages, packing.

Each stage takes the documents its predecessor kept and returns the columns of ``documents``; the
last returns where every piece of every document lies in the training sequences.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.language import UNKNOWN, identify, learn, letter_share, letters_of
from tonearm.llm.near_dedup import near_duplicates
from tonearm.llm.pack import pack_documents
from tonearm.llm.repeats import remove_repeats
from tonearm.session import written

# Least share of letters of the learned languages among the characters of a document, without blanks.
# It does not depend on how many languages there are, as the score does.
LEAST_LETTERS = 0.4
# Documents sent to a Python worker at once: texts are long, so the usual 10,000 rows would take tens
# of megabytes in the JVM and again in the worker.
ROWS_PER_BATCH = 2000


def _small_batches(stage):
    """The stage with batches of ``ROWS_PER_BATCH`` rows between Spark and its Python workers."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
        return stage(spark, docs, sf_dir)

    return run


@_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (``und``) and those of mostly other characters than letters of
    the learned languages: numbers, symbols, code, texts in other scripts."""
    model = learn(docs)
    letters = letters_of(docs, model)
    found = identify(docs, model)
    return found.where((F.col("lang_pred") != UNKNOWN)
                       & (letter_share("text", letters) >= LEAST_LETTERS)).select(*docs.columns)


@_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Documents without words are copies of nothing and stay; rows that repeat a kept id stay too.
    """
    copies = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


@_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words and more that a document of smaller id has too.

    Texts that lose nothing stay as they are, the others are their remaining words with single
    blanks; ``n_chars`` follows the text. No row goes.
    """
    found = remove_repeats(docs)
    cut = F.col("n_removed") > 0
    return found.select(*[
        F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text") if c == "text"
        else F.when(cut, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias(c)
        if c == "n_chars" else F.col(c) for c in docs.columns])


@_small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

# Trained languages, hashed similarity and a tokenizer's ids are beyond SQL; tests/llm compares
# run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
