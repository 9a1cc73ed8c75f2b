"""The operators' queries over the supplied tables, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, html, jaccard, language, lattice, periods, pii, quality, spans, toxicity, variants, vectors
from quillon.llm.common import crc_mod, doc_texts
from quillon.llm.oracles import ORACLES as ORACLES  # those of the queries below that SQL can express


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir)).drop("text_hash")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(doc_texts(_documents(spark, sf_dir)))
    counts = [pii.count(F.col("pii"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    base = pii.written(F.filter("pii", lambda x: x["base"]))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.written(F.col("pii")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = language.Ppm(language.sample_by_language(docs, ~held_out))
    found = language.identify(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    docs = _documents(spark, sf_dir)
    ranker = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return quality.score(docs, ranker).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.remove_repeated(_documents(spark, sf_dir))
    return found.select("doc_id", "n_sentences", "n_removed", "removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_chars"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    scored = lattice.score(_documents(spark, sf_dir), ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", F.col("fitted_score").alias("score"), F.col("score").alias("plain_score"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_documents(spark, sf_dir), slips=199)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(_documents(spark, sf_dir), plant=True).drop("n_words")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    docs = _documents(spark, sf_dir)
    judge = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return toxicity.score(docs, judge).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_jaccard_join, op3_pii, op4_quality, op5_decontamination, op6_html_extraction, op7_language_id, op8_repeated_spans, op9_embedding_near_dedup, op10_lm_scoring, op11_spelling_variants, op12_periodic_runs, op13_toxicity)
}
