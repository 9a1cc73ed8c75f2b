"""Logs as streams (T1, T4, T5): a folder of files is read once as far as it goes, and resumes where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest(stream: DataFrame, key: str, seq: list[str], fields: list[str]) -> DataFrame:
    """The running state of each key, whatever the order in which records arrive."""
    order = F.struct(*seq)
    return stream.groupBy(key).agg(*(F.max_by(f, order).alias(f) for f in fields), F.count("*").alias("n_records"))


def distinct_records(stream: DataFrame, keys: list[str]) -> DataFrame:
    return stream.dropDuplicates(keys)


def windows(stream: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by time window; records later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).count()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Runs until all that is there now is processed. Each batch's changed rows go to a folder of its own, which a batch
    that runs again replaces; the driver holds none of them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str, key: str = "user_id") -> DataFrame:
    """What drain() has written: the last batch's row of each key."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("_r")).select(key, "_r.*")
