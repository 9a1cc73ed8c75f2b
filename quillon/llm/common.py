"""What the corpus operators share: written intermediate tables, Arrow maps, hash samples and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the session is local and names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return context.getCheckpointDir()


#: How much Spark sends to a Python worker at once while an operator writes an intermediate table.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it the session's jobs send Arrow batches of at most BATCH_BYTES; then its setting is as it was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by materialize() that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


ArrowStep = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def arrow_map(df: DataFrame, fn: ArrowStep, schema: str | T.StructType, rows: int = 256, size: int = 1 << 20) -> DataFrame:
    """mapInArrow whose function sees slices of at most `rows` rows and about `size` bytes (a longer row comes alone, or
    with few others). What Spark sends at once is bounded by spark.sql.execution.arrow.maxBytesPerBatch, which this leaves
    alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(cut(batches))

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Of batches sorted by some columns, the rows of each run of equal values there, as one table."""
    held: list[pa.RecordBatch] = []
    now: tuple = ()
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        borders = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(borders, borders[1:], strict=False):
            if lo == hi:
                continue
            if held and keys[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def doc_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, whatever others there are."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a number's decimal text, modulo n; a null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def hash_share(column: Column, share: float) -> Column:
    """True for about that share of rows, the same ones in every run."""
    scale = 1 << 24
    return F.pmod(F.xxhash64(column), F.lit(scale)) < F.lit(int(round(share * scale)))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph.

    edges(a long, b long) -> (node long, component long): the smallest node that links reach. Labels spread to
    neighbours and jump to their own label's label, so that rounds grow with the logarithm of a path's length. No edge
    or label is collected; each round's labels are written to the shared folder. Nulls and loops make no link.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        # the old label's node also takes the new label, so that whole trees hook onto smaller ones
        hooks = spread.where("new < label").groupBy(F.col("label").alias("node")).agg(F.min("new").alias("hook"))
        hooked = spread.join(hooks, "node", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("hook", "new")).alias("label"))
        hooked = materialize(hooked, "labels")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(up, "label", "left").select("node", "old", F.coalesce("up", "label").alias("label"))
        jumped = materialize(jumped, "labels")
        changed = jumped.where("old <> label").limit(1).count()
        discard(labels, hooked)
        labels = jumped.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    discard(both)
    return labels.select("node", F.col("label").alias("component"))


#: Bits of the map by which a large table's rows are filtered before they are joined with fewer keys.
MAP_BITS = 1 << 23


def maybe_among(big: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Adds `maybe`: false only where `column` is surely not among `keys` (one column of that name).

    The test is a bit map of the keys' hashes, 1 MB whatever the input; as the map fills, more rows are a maybe.
    """
    place = f"pmod(xxhash64({column}), {MAP_BITS}L)"
    bits = keys.select(F.expr(place).alias("_p")).groupBy(F.expr("bitmap_bucket_number(_p)").alias("_b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_p))").alias("_m"))
    byte = "cast(conv(hex(substring(_m, cast(bitmap_bit_position(_p) div 8 + 1 as int), 1)), 16, 10) as int)"
    marked = big.withColumn("_p", F.expr(place)).withColumn("_b", F.expr("bitmap_bucket_number(_p)")).join(F.broadcast(bits), "_b", "left")
    return marked.withColumn("maybe", F.expr(f"_m is not null and shiftright({byte}, cast(bitmap_bit_position(_p) % 8 as int)) & 1 = 1")).drop("_p", "_b", "_m")


def with_keys(big: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of `big` whose `column` is in `keys` (distinct, one column of that name); most others are not shuffled."""
    return maybe_among(big, keys, column).where("maybe").drop("maybe").join(keys, column)
