"""Metrics over score and label columns, percentiles, sweeps and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.blocks import running_sums
from quillon.operators.matching import metric_columns, ratio
from quillon.operators.quantiles import interpolated, picked


def auroc(df: DataFrame, score: str = "s", truth: str = "y") -> DataFrame:
    """Rank-sum AUROC with mid-ranks for ties (G21). Counts per distinct score are summed before anything is ordered, and
    the order is by ranges with carried sums."""
    by = df.groupBy(score).agg(F.sum(truth).alias("p"), F.count("*").alias("n"))
    by = running_sums(by, [F.col(score)], {"below": F.col("n")}).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    t = by.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(F.round(ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auroc"))


def average_precision(df: DataFrame, score: str = "s", truth: str = "y") -> DataFrame:
    """Step-wise: the sum of recall gains times precision over falling distinct scores."""
    by = df.groupBy(score).agg(F.sum(truth).alias("p"), F.count("*").alias("n"))
    by = running_sums(by, [F.desc(score)], {"tp": F.col("p"), "k": F.col("n")}).withColumns({"tp": F.col("tp") + F.col("p"), "k": F.col("k") + F.col("n")})
    t = by.agg(F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("a"), F.sum("p").alias("p"))
    return t.select(F.round(ratio(F.col("a"), F.col("p")), 6).alias("average_precision"))


def threshold_grid(spark, start: float = 0.05, step: float = 0.05, n: int = 19) -> DataFrame:
    """Doubles start + i * step, as a loop would make them."""
    return spark.range(n).select((F.lit(start) + F.col("id") * F.lit(step)).alias("threshold"))


def sweep(df: DataFrame, grid: DataFrame, score: str = "s", truth: str = "y") -> DataFrame:
    """Counts and metrics at each threshold (J13, M8): score >= threshold, both as floats. Scores are counted first, so
    that the grid (a few rows) meets distinct scores and not rows."""
    by = df.groupBy(F.col(score).cast("float").alias("s")).agg(F.sum(truth).alias("p"), F.count("*").alias("n"))
    at = by.join(F.broadcast(grid)).withColumn("keep", F.col("s") >= F.col("threshold").cast("float"))
    counted = at.groupBy("threshold").agg(
        F.sum(F.when(F.col("keep"), F.col("p")).otherwise(0)).cast("long").alias("tp"), F.sum(F.when(F.col("keep"), F.col("n") - F.col("p")).otherwise(0)).cast("long").alias("fp"), F.sum(F.when(~F.col("keep"), F.col("p")).otherwise(0)).cast("long").alias("fn")
    )
    return counted.withColumn("sum_iou", F.lit(0.0)).select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", *metric_columns()[:3])


def best(swept: DataFrame, min_recall: float = 0.2) -> DataFrame:
    """The highest f1 among thresholds that keep the recall, else among all; the smaller threshold on a tie."""
    order = swept.withColumn("eligible", F.col("recall") >= min_recall)
    return order.orderBy(F.desc("eligible"), F.desc("f1"), "threshold").limit(1).select("threshold", "f1", "recall", "eligible")


def percentile_nearest(df: DataFrame, value: str, by: str, q: float) -> DataFrame:
    """sorted[ceil(q n) - 1]."""
    return picked(df, [by], value, {"p_nearest": F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))}).drop("n")


def percentile_floor(df: DataFrame, value: str, by: str, q: float) -> DataFrame:
    """sorted[max(0, int(q n) - 1)], sorted[n div 2] and the median."""
    n = F.col("n")
    got = picked(df, [by], value, {"p_floor": F.greatest(F.lit(1), F.floor(q * n)), "p50_upper": F.floor(n / 2) + 1, "_lower": F.floor((n + 1) / 2)})
    return got.select(by, "p_floor", "p50_upper", F.when(n % 2 == 1, F.col("p50_upper").cast("double")).otherwise((F.col("_lower") + F.col("p50_upper")) / 2).alias("median"))


def gates(values: DataFrame, floors: dict[str, float]) -> DataFrame:
    """metric, value, floor, passed (O9) of one row of metrics."""
    each = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("floor")) for k, v in sorted(floors.items())))
    return values.select(F.explode(each).alias("g")).select("g.*").withColumn("passed", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)))


def percentile_features(df: DataFrame, value: str, by: str) -> DataFrame:
    """p10, p50, p90 and the interquartile range, linearly interpolated."""
    got = interpolated(df, [by], value, {"p10": 0.1, "p50": 0.5, "p90": 0.9, "q1": 0.25, "q3": 0.75})
    return got.select(by, *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")), F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"))
