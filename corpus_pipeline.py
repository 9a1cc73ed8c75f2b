"""A corpus pipeline: five of the corpus operators in a row over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents (the last one returns token digests). run() writes each stage's rows as Parquet in the shared folder and reads
them again for the next.

- language: texts whose language the operator does not tell (null or without a letter) go; a missing lang is filled with the predicted one.
- near_duplicates: of each group of linked documents one row stays, of those with the smallest doc_id. Of rows that agree
  in doc_id and text one stays (the least by all columns). Documents without words are in no group, and a row without a
  doc_id is no other's link; they stay.
- decontamination: rows whose text holds a benchmark item's question and answer go.
- pii: personal data is replaced by its kind in brackets; n_chars follows the new text.
- tokens: the texts are encoded and decoded again; digests of both are returned.

Stages decide by row: of two texts under one doc_id each has its own fate. Other columns are carried along, whatever their
names; a null text goes in the first stage; empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, jaccard, language, pii
from quillon.llm.common import crc_mod, materialize


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that no operator's columns have, and the new name of each column."""
    names = {c: f"_{i}_" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(new).alias(old) for old, new in names.items()))


def _by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.Ppm(language.sample_by_language(docs, crc_mod(F.col("doc_id"), 4) != 2))
    rows, names = _renamed(docs)
    found = language.identify(rows, model, text_col=names["text"], keep=rows.columns)
    known = F.col("lang_pred") != language.UNKNOWN
    # without a training language the operator tells nothing
    kept = found.where(known if model.languages else F.col(names["text"]).rlike(r"\p{L}"))
    return _restored(kept.withColumn(names["lang"], F.coalesce(names["lang"], F.when(known, F.col("lang_pred")))), names)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _renamed(docs)
    doc_id, text_hash = F.col(names["doc_id"]).alias("doc_id"), F.xxhash64(names["text"]).alias("text_hash")
    decided = materialize(jaccard.near_duplicates(rows, id_col=names["doc_id"], text_col=names["text"]), "decided")
    keys = ["doc_id", "text_hash"]
    gone = decided.where("not kept").select(*keys).distinct()
    kept = rows.select("*", doc_id, text_hash).join(gone, keys, "left_anti")
    repeated = materialize(decided.where("kept and n_shingles > 0 and doc_id is not null").groupBy(*keys).count().where("count > 1").select(*keys), "repeated")
    if not repeated.limit(1).count():
        return _restored(kept, names)
    least = kept.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
    return _restored(kept.join(repeated, keys, "left_anti").select(*rows.columns).unionByName(least), names)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _renamed(docs)
    rows = rows.withColumn("row", F.xxhash64(names["doc_id"], names["text"]))
    hits = decontaminate.find(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row", text_col=names["text"])
    gone = materialize(hits.select(F.col("doc_id").alias("row")).distinct(), "gone")
    return _restored(rows.join(gone, "row", "left_anti"), names)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _renamed(docs)
    clean = pii.redact(rows, names["text"], names["text"])
    return _restored(clean.withColumn(names["n_chars"], F.char_length(names["text"]).cast("long")), names)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    digests = coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return materialize(digests, "tokens")


STAGES = [("language", _by_language), ("near_duplicates", _near_duplicates), ("decontamination", _decontamination), ("pii", _pii), ("tokens", _tokens)]
#: Subword merges and n-gram groups are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
