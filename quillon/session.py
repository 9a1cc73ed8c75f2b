"""Sessions: settings the library is tested under, and shipping of its code to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A local session; on a cluster the caller's own session serves as it is."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(master).appName("quillon").config(map=settings | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="quillon-code-"), "quillon.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the session is local and names none."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(df):
    """The same rows without their lineage: written once to the folder that the session shares, compressed by columns, and
    read from there. (A checkpoint computes its rows twice and writes them as they are in memory.)"""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    return kept


def uncut(*frames) -> None:
    """Deletes what cut() wrote for frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
