"""Registered queries of the corpus operators: each applies one to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import codes, hamming, licenses
from tonearm.llm.chat import format_chats, read_back, with_probe
from tonearm.llm.common import table
from tonearm.llm.imatch import fingerprint_documents
from tonearm.llm.language import held_out, identify, learn
from tonearm.llm.line_dedup import dedup_lines
from tonearm.llm.near_dedup import near_duplicates
from tonearm.llm.oracle import ORACLE
from tonearm.llm.pack import pack_documents
from tonearm.llm.periods import periodic_runs, with_echoes
from tonearm.llm.pieces import decode_documents, encode_documents
from tonearm.llm.repeats import remove_repeats
from tonearm.llm.warc import archive_folder, read_archives, write_archives


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed",
                        F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = archive_folder(pages)
    found = read_archives(write_archives(pages, folder), folder, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                        "verified")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = with_probe(table(spark, sf_dir, "conversations"))
    return read_back(format_chats(chats, public_tokenizers.path("byte_bpe_50k.json")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = decode_documents(encode_documents(table(spark, sf_dir, "documents"), model), model)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                        F.xxhash64("ids").alias("ids_xxhash64"), "score",
                        F.sha2("text", 256).alias("decoded_sha256"))


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_echoes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs)
    run = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    said = F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise("")
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), run.alias("run"),
                        F.sha2(said, 256).alias("runs_sha256"),
                        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    return best.select(
        "doc_id", "n_runs", (-F.col("run.start")).alias("start"), F.col("run.length").alias("length"),
        (-F.col("run.period")).alias("period"),
        F.expr("run.length * 1000 div -run.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = codes.train_codebooks(vectors)
    found = codes.with_label_error(codes.compress_vectors(vectors, books))
    return found.select("vec_id", "code", "error", "label_error",
                        F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))


__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_multi_index_hashing": op7_multi_index_hashing,
    "op8_imatch_fingerprints": op8_imatch_fingerprints,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}
