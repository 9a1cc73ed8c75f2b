"""Small files and listings by Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name below path, bytes, time of change) of all data files of a file or folder, in order; hidden ones are left out."""
    fs, place = _at(spark, path)
    top = fs.getFileStatus(place).getPath().toString()
    found, it = [], fs.listFiles(place, True)
    while it.hasNext():
        s = it.next()
        name = s.getPath().toString().removeprefix(top).lstrip("/")
        if not name.rpartition("/")[2].startswith(("_", ".")):
            found.append((name, s.getLen(), s.getModificationTime()))
    return sorted(found)


def source_digest(spark: SparkSession, paths: Iterable[str]) -> str:
    """Of the files that tables are made of: their places, sizes and times. No row is read."""
    told = [[p, *f] for p in paths for f in listing(spark, p)]
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def read_json(spark: SparkSession, path: str) -> dict:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, content: dict) -> None:
    """A file that is there whole or not at all, and is never written over."""
    fs, place = _at(spark, path)
    if fs.exists(place):
        raise FileExistsError(path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.writing")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()
    if not fs.rename(aside, place):
        raise FileExistsError(path)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, place = _at(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(place, to):
        raise FileExistsError(target)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)
