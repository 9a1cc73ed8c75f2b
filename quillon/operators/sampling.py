"""Splits, samples and feature aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.blocks import numbered


def stratified_split(df: DataFrame, id_col: str, stratum: str, seed: str = "seed", train: int = 70, val: int = 15) -> DataFrame:
    """id, stratum, split (E1): within a stratum in hash order the first int(.70 n) train, the next int(.15 n) val. Places
    are by a scan over ranges, so that a stratum of any size is in many tasks."""
    ranked = df.select(F.col(id_col).alias("id"), F.col(stratum).alias("stratum"), F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256).alias("h"))
    sizes = ranked.groupBy(F.col("stratum").alias("s")).agg(F.count("*").alias("n"))
    ranked = numbered(ranked, ["stratum"], [F.col("h"), F.col("id")]).join(sizes, F.col("stratum").eqNullSafe(F.col("s")))
    t, v = F.floor(F.col("n") * train / 100), F.floor(F.col("n") * val / 100)
    return ranked.select("id", "stratum", F.when(F.col("k") <= t, "train").when(F.col("k") <= t + v, "val").otherwise("test").alias("split"))


def coverage_sample(df: DataFrame, id_col: str, cls: str, least: int = 16, total: int = 128) -> DataFrame:
    """id, chosen_for (W8): the first `least` ids of each class, filled to `total` with the lowest other ids. Spark limits
    each class before the shuffle."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy(id_col))).where(F.col("_r") <= least).select(F.col(id_col).alias("id")).distinct()
    n = first.count()
    rest = df.select(F.col(id_col).alias("id")).distinct().join(first, "id", "left_anti").orderBy("id").limit(max(0, total - n))
    return first.withColumn("chosen_for", F.lit("class")).unionByName(rest.withColumn("chosen_for", F.lit("fill")))


def pooled(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and clamped population deviation of each value per group, and log1p(n)/10."""
    out = [F.count("*").alias("n"), F.round(F.log1p(F.count("*")) / 10, 6).alias("log_area")]
    for v in values:
        out += [F.round(F.avg(v), 6).alias(f"{v}_mean"), F.round(F.sqrt(F.greatest(F.avg(F.col(v) * F.col(v)) - F.avg(v) * F.avg(v), F.lit(0.0))), 5).alias(f"{v}_std")]
    return df.groupBy(*keys).agg(*out)


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """n / (k n_c)."""
    counts = df.groupBy(cls).agg(F.count("*").alias("n_c"))
    whole = counts.agg(F.sum("n_c").alias("n"), F.count("*").alias("k"))
    return counts.join(F.broadcast(whole)).select(cls, "n_c", F.round(F.col("n") / (F.col("k") * F.col("n_c")), 6).alias("weight"))


def logistic_head(df: DataFrame, features: str, label: str, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), seed: str = "head") -> DataFrame:
    """c, macro_f1 on a held-out tenth for each regularisation (E3, E4): balanced weights, population standardiser."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64(F.col("x"), F.lit(seed)), F.lit(10)) == 0)
    train = rows.where("not held")
    weights = class_weights(train, "y").select("y", "weight")
    width = train.select(F.size("x")).first()[0]
    moments = train.agg(*(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean, scale = [moments[f"m{i}"] for i in range(width)], [moments[f"s{i}"] or 1.0 for i in range(width)]
    standard = F.zip_with(F.zip_with("x", F.lit(mean), lambda a, b: a - b), F.lit(scale), lambda a, b: a / b)
    ready = lambda d: d.withColumn("features", array_to_vector(standard))
    fit_on, n, out = ready(train).join(F.broadcast(weights), "y").cache(), train.count(), []
    held = ready(rows.where("held")).cache()
    for c in grid:
        model = LogisticRegression(labelCol="y", weightCol="weight", regParam=1 / (c * n), standardization=False, maxIter=60).fit(fit_on)
        scored = model.transform(held).groupBy("y", "prediction").count()
        per = scored.groupBy("y").agg(F.sum("count").alias("support"), F.sum(F.when(F.col("y") == F.col("prediction"), F.col("count")).otherwise(0)).alias("tp"))
        guess = scored.groupBy(F.col("prediction").alias("y")).agg(F.sum("count").alias("guessed"))
        f1 = per.join(guess, "y", "full").select((2 * F.coalesce("tp", F.lit(0)) / (F.coalesce("support", F.lit(0)) + F.coalesce("guessed", F.lit(0)))).alias("f1"))
        out.append((c, f1.agg(F.avg("f1")).first()[0] or 0.0))
    return df.sparkSession.createDataFrame(out, "c double, macro_f1 double")
