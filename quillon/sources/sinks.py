"""Publication: new folders only, the manifest last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import files


def publish(df: DataFrame, path: str, shard: int | None = None, key: str | None = None) -> None:
    """Writes once and never over anything (K1-K7); with a shard size, partitions by key div shard (K5)."""
    out = df if shard is None else df.withColumn("shard", F.floor(F.col(key) / shard))
    writer = out.write.mode("errorifexists")
    (writer if shard is None else writer.partitionBy("shard")).parquet(path)


def manifest(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, digest: an order-free digest of each table's rows."""
    out = None
    for name, df in sorted(tables.items()):
        digest = df.select(F.xxhash64(*sorted(df.columns)).alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("d")).select(F.lit(name).alias("name"), "rows", F.col("d").cast("string").alias("digest"))
        out = digest if out is None else out.unionByName(digest)
    return out


def append_events(df: DataFrame, path: str, allowed: list[str], column: str = "event") -> None:
    """Appends log records whose names are all allowed (K9)."""
    if df.where(~F.col(column).isin(allowed) | F.col(column).isNull()).limit(1).count():
        raise ValueError("an event isn't on the list")
    df.write.mode("append").json(path)


# ---- batches and caches ---------------------------------------------------------------------------------------------
def batch_problems(batches: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """problem, n: what keeps batches of embeddings from being published (K4, A2, A4). batches (batch, idx, embedding, sha),
    source (idx, sha), indices from 0 without gaps."""
    size = source.agg(F.count("*").alias("size"))
    v = F.col("embedding")
    rows = batches.join(source.select("idx", F.col("sha").alias("s")), "idx", "left")
    rules = {
        "outside the source": F.col("s").isNull(), "other content": F.col("s") != F.col("sha"), "width": F.size(v) != width,
        "not finite": F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
    }
    each = F.array(*(F.struct(F.lit(k).alias("problem"), F.coalesce(c, F.lit(True)).cast("long").alias("bad")) for k, c in rules.items()))
    found = [rows.select(F.explode(each).alias("e")).groupBy("e.problem").agg(F.sum("e.bad").alias("n"))]
    found.append(batches.groupBy("idx").count().where("count > 1").agg(F.lit("overlap").alias("problem"), F.count("*").alias("n")))
    found.append(source.join(batches.select("idx").distinct(), "idx", "left_anti").agg(F.lit("missing").alias("problem"), F.count("*").alias("n")))
    spans = batches.groupBy("batch").agg((F.max("idx") - F.min("idx") + 1 != F.count_distinct("idx")).alias("gap"))
    found.append(spans.agg(F.lit("gap in a batch").alias("problem"), F.count_if("gap").alias("n")))
    out_of_range = source.join(F.broadcast(size)).where("idx < 0 or idx >= size")
    found.append(out_of_range.agg(F.lit("source index").alias("problem"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, found)


def publish_batches(batches: DataFrame, source: DataFrame, width: int, path: str) -> None:
    """Publishes whole batches, the manifest last (K4): without it nothing counts as published."""
    bad = [(r["problem"], r["n"]) for r in batch_problems(batches, source, width).where("n > 0").collect()]
    if bad:
        raise ValueError(f"not published: {bad}")
    spark = batches.sparkSession
    publish(batches, f"{path}/rows")
    _seal(spark, path, spark.read.parquet(f"{path}/rows"))


def _seal(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """The manifest of the rows, and last the names and sizes of their files."""
    publish(manifest(spark, {"rows": rows}), f"{path}/manifest")
    files.write_once(spark, f"{path}/files.json", {"rows": [list(f[:2]) for f in files.listing(spark, f"{path}/rows")]})


def read_published(spark: SparkSession, path: str, order: list[str] | None = None, deep: bool = False) -> DataFrame:
    """What publish_batches() or publish_detections() wrote, if it is whole and unchanged (S7, S8, S9, T2, T10): its files
    have the names and sizes that were written down last, which reads no row; `deep` also compares the rows' digest."""
    told = f"{path}/files.json"
    if not files.exists(spark, told) or files.read_json(spark, told)["rows"] != [list(f[:2]) for f in files.listing(spark, f"{path}/rows")]:
        raise ValueError("the files are not those that were published")
    rows = spark.read.parquet(f"{path}/rows")
    if deep:
        want = {r["name"]: (r["rows"], r["digest"]) for r in spark.read.parquet(f"{path}/manifest").collect()}
        if {r["name"]: (r["rows"], r["digest"]) for r in manifest(spark, {"rows": rows}).collect()} != want:
            raise ValueError("the rows are not those of the manifest")
    return rows if order is None else rows.orderBy(*order)


def uncommitted(spark: SparkSession, paths: list[str]) -> list[str]:
    """Folders with rows but without a manifest (T2): remains of runs that broke off."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)
    return [p for p in paths if there(f"{p}/rows") and not there(f"{p}/manifest/_SUCCESS")]


def detection_problems(det: DataFrame, images: DataFrame, classes: int = 3, most: int = 300) -> DataFrame:
    """problem, n of a detection cache (K6): det (image, boxes array<struct<box array, cls, conf>>), images (image)."""
    one = F.exists("boxes", lambda b: (F.size(b["box"]) != 4) | (b["box"][2] <= b["box"][0]) | (b["box"][3] <= b["box"][1]) | F.exists(b["box"], lambda x: x.isNull() | F.isnan(x)))
    rules = {
        "box": one, "class": F.exists("boxes", lambda b: ~b["cls"].between(0, classes - 1)), "confidence": F.exists("boxes", lambda b: F.isnan(b["conf"]) | (b["conf"] < 0)),
        "too many": F.size("boxes") > most, "no list": F.col("boxes").isNull(),
    }
    each = F.array(*(F.struct(F.lit(k).alias("problem"), F.coalesce(c, F.lit(False)).cast("long").alias("bad")) for k, c in rules.items()))
    found = det.select(F.explode(each).alias("e")).groupBy("e.problem").agg(F.sum("e.bad").alias("n"))
    twice = det.groupBy("image").count().where("count > 1").agg(F.lit("repeated image").alias("problem"), F.count("*").alias("n"))
    lost = images.join(det, "image", "left_anti").agg(F.lit("missing image").alias("problem"), F.count("*").alias("n"))
    return found.unionByName(twice).unionByName(lost)


def publish_detections(det: DataFrame, images: DataFrame, path: str) -> None:
    """K6: once, and only if nothing is wrong."""
    bad = [(r["problem"], r["n"]) for r in detection_problems(det, images).where("n > 0").collect()]
    if bad:
        raise ValueError(f"not published: {bad}")
    spark = det.sparkSession
    publish(det, f"{path}/rows")
    _seal(spark, path, spark.read.parquet(f"{path}/rows"))


def publish_embeddings(df: DataFrame, key: str, vector: str, content: list[str], path: str, tolerance: float = 2e-5) -> None:
    """Rows with the digest of what they were made from (K3, X19), if all vectors are finite and of unit length (K7)."""
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    if df.where(~F.coalesce(F.abs(norm - 1) <= tolerance, F.lit(False))).limit(1).count():
        raise ValueError("a vector is not of unit length")
    publish(df.select(key, vector, F.sha2(F.to_json(F.struct(*sorted(content))), 256).alias("sha")), path)


def publish_ontology(spark: SparkSession, relations: dict[str, DataFrame], path: str) -> None:
    """The relations terms, synonyms, aliases, redirects, edges, and the manifest last (K1). Edges and synonyms must be of
    terms, ids unique."""
    terms = relations["terms"].select("id")
    problems = {
        "repeated term": terms.groupBy("id").count().where("count > 1"), "edge": relations["edges"].join(terms.withColumnRenamed("id", "parent"), "parent", "left_anti"),
        "edge's child": relations["edges"].join(terms.withColumnRenamed("id", "child"), "child", "left_anti"), "synonym": relations["synonyms"].join(terms, "id", "left_anti"),
    }
    bad = [name for name, df in problems.items() if df.limit(1).count()]
    if bad:
        raise ValueError(f"not published: {bad}")
    for name, df in relations.items():
        publish(df, f"{path}/{name}")
    publish(manifest(spark, {name: spark.read.parquet(f"{path}/{name}") for name in relations}), f"{path}/manifest")


# ---- markers --------------------------------------------------------------------------------------------------------
def stage_manifest(spark: SparkSession, stage: str, config: dict[str, str], inputs: dict[str, str]) -> DataFrame:
    """One row with its own digest."""
    if not stage:
        raise ValueError("a stage has a name")
    row = spark.createDataFrame([(stage, config, inputs)], "stage string, config map<string,string>, inputs map<string,string>")
    entries = lambda c: F.array_sort(F.map_entries(c))
    return row.withColumn("digest", F.sha2(F.to_json(F.struct(entries("config").alias("config"), entries("inputs").alias("inputs"), "stage")), 256))


def mark_exposed(spark: SparkSession, path: str, digest: str) -> None:
    """A marker that can be set once (K10, T9); a second time is an error."""
    publish(spark.createDataFrame([(digest, True)], "digest string, exposed boolean").coalesce(1), path)


def require_unexposed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise ValueError(f"exposed already: {path}")
