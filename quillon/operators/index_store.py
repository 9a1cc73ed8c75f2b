"""A retrieval index that outlives its queries: segments on disk, merged when they are read, refused when they are stale.

A version of the index is a manifest: the digest of the source it was made from and the segments it is made of, in order.
The first segment holds the whole index, later ones what was added, changed or withdrawn since. Each segment lists the ids
it touches; a row of an earlier segment is alive if no later one touches its id. So an update writes what it changes (and
the places of the current ids, which all move), and reading joins each segment once with the ids that later ones touch.

Tables are bucketed and sorted by the key that queries join with (aliases by alias, grams by gram, names by token, terms
and vectors by id), so that the index's side of a join isn't shuffled. A manifest is written last and never over another;
a segment without one is a remain, which nothing reads and sweep() deletes. Opening compares the files with the manifest
by name and size, and the source's digest with the one expected, and reads no row.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import engine
from quillon.operators.blocks import numbered
from quillon.sources import files

#: The tables of a segment and the key of each.
KEYS = {"terms": "id", "redirects": "id", "aliases": "alias", "grams": "gram", "gram_counts": "gram", "names": "token", "vectors": "id", "touched": "id"}


class StaleIndex(ValueError):
    """The index isn't that of the source, or its files aren't those of its manifest."""


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[1:-5]) for n in files.children(spark, f"{path}/versions") if n.startswith("v") and n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    there = versions(spark, path)
    if not there:
        raise FileNotFoundError(path)
    return files.read_json(spark, f"{path}/versions/v{version or there[-1]:06d}.json")


def _table_name(path: str) -> str:
    return f"quillon_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _write(df: DataFrame, path: str, key: str, buckets: int) -> dict:
    """Writes a bucketed table and tells what it is made of."""
    spark = df.sparkSession
    name = _table_name(path)
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "key": key, "buckets": buckets, "files": [f[:2] for f in files.listing(spark, path)]}


def _read(spark: SparkSession, path: str, told: dict) -> DataFrame:
    """The table with its buckets; a session that hasn't seen it learns of it here."""
    if [list(f[:2]) for f in files.listing(spark, path)] != [list(f) for f in told["files"]]:
        raise StaleIndex(f"{path} has other files than its manifest")
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        spark.sql(f"create table {name} ({told['schema']}) using parquet options (path '{path}') clustered by ({told['key']}) sorted by ({told['key']}) into {told['buckets']} buckets")
    return spark.table(name)


def _segment(spark: SparkSession, path: str, index: engine.Index, touched: DataFrame, redirects: DataFrame, buckets: int) -> dict:
    name = f"seg-{uuid.uuid4().hex}"
    parts = {f: getattr(index, f) for f in KEYS if f not in ("touched", "redirects")} | {"touched": touched, "redirects": redirects}
    tables = {t: _write(df, f"{path}/{name}/{t}", KEYS[t], buckets) for t, df in parts.items() if df is not None}
    return {"name": name, "tables": tables}


def _commit(spark: SparkSession, path: str, segments: list[dict], source: str, buckets: int, version: int) -> int:
    """Numbers the current ids of the segments and writes the manifest."""
    current = _merged(spark, path, segments, "terms").where("not obsolete").select("id")
    place = f"order-{uuid.uuid4().hex}"
    order = _write(numbered(current, [], [F.col("id")], "pos"), f"{path}/{place}", "id", buckets)
    files.write_once(spark, f"{path}/versions/v{version:06d}.json", {"version": version, "source": source, "segments": segments, "order": {"name": place, "table": order}})
    return version


def create(path: str, source: str, terms: DataFrame, synonyms: DataFrame, redirects: DataFrame, vectors: DataFrame | None = None, buckets: int | None = None) -> int:
    """Version 1 of an index, from whole tables (see engine.build). An index that is there already is an error."""
    spark = terms.sparkSession
    if versions(spark, path):
        raise FileExistsError(path)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = _segment(spark, path, engine.build(terms, synonyms, redirects, vectors), terms.select("id").limit(0), redirects.select("id", "kind", "target"), buckets)
    return _commit(spark, path, [base], source, buckets, 1)


def update(path: str, source: str, terms: DataFrame, synonyms: DataFrame, redirects: DataFrame, vectors: DataFrame | None = None, withdrawn: DataFrame | None = None) -> int:
    """The next version: `terms` with their synonyms, redirects and vectors are added or stand in place of those of their
    ids, `withdrawn` (id) are gone. Redirects go by the id they lead from: those of touched ids are replaced."""
    spark = terms.sparkSession
    now = manifest(spark, path)
    buckets = now["order"]["table"]["buckets"]
    touched = terms.select("id").union(redirects.select("id"))
    touched = (touched if withdrawn is None else touched.union(withdrawn.select("id"))).distinct()
    delta = _segment(spark, path, engine.build(terms, synonyms, redirects, vectors), touched, redirects.select("id", "kind", "target"), buckets)
    return _commit(spark, path, [*now["segments"], delta], source, buckets, now["version"] + 1)


def _merged(spark: SparkSession, path: str, segments: list[dict], table: str) -> DataFrame | None:
    """A table's rows of all segments whose id no later segment touches."""
    parts = []
    for i, s in enumerate(segments):
        if table not in s["tables"]:
            continue
        rows = _read(spark, f"{path}/{s['name']}/{table}", s["tables"][table])
        later = [_read(spark, f"{path}/{x['name']}/touched", x["tables"]["touched"]) for x in segments[i + 1 :]]
        if later and "id" in rows.columns:
            rows = rows.join(reduce(DataFrame.union, later).distinct(), "id", "left_anti").select(*rows.columns)
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts) if parts else None


def load(spark: SparkSession, path: str, source: str | None = None, version: int | None = None) -> engine.Index:
    """An index as of a version, the last one if none is named. With `source`, an index of another source is refused."""
    told = manifest(spark, path, version)
    if source is not None and told["source"] != source:
        raise StaleIndex(f"{path} was made from another source")
    merged = lambda table: _merged(spark, path, told["segments"], table)
    terms = merged("terms")
    redirects = merged("redirects").join(terms.select(F.col("id").alias("target")).hint("merge"), "target", "left_semi").select("id", "kind", "target")
    counts = merged("gram_counts").groupBy("gram").agg(F.sum("n").alias("n")) if len(told["segments"]) > 1 else merged("gram_counts")
    order = _read(spark, f"{path}/{told['order']['name']}", told["order"]["table"])
    return engine.Index(terms, redirects, merged("aliases"), merged("grams"), counts, merged("names"), order, merged("vectors"))


def compact(spark: SparkSession, path: str) -> int:
    """The next version, of one segment that holds what is alive now."""
    told = manifest(spark, path)
    now = load(spark, path)
    buckets = told["order"]["table"]["buckets"]
    redirects = _merged(spark, path, told["segments"], "redirects")
    # of grams the live ones: their aliases tell
    live = engine.Index(now.terms, now.redirects, now.aliases, now.grams.join(now.aliases.select("alias_id"), "alias_id", "left_semi").select("gram", "alias_id"), None, now.names, now.order, now.vectors)
    live = live.counted()
    base = _segment(spark, path, live, now.terms.select("id").limit(0), redirects, buckets)
    return _commit(spark, path, [base], told["source"], buckets, told["version"] + 1)


def sweep(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes manifests but the last `keep`, and segments that no manifest names (remains of updates that broke off among
    them); returns what went."""
    there = versions(spark, path)
    for v in there[: max(0, len(there) - keep)]:
        files.remove(spark, f"{path}/versions/v{v:06d}.json")
    told = [manifest(spark, path, v) for v in versions(spark, path)]
    named = {s["name"] for t in told for s in t["segments"]} | {t["order"]["name"] for t in told}
    gone = [n for n in files.children(spark, path) if n.startswith(("seg-", "order-")) and n not in named]
    for n in gone:
        for table in files.children(spark, f"{path}/{n}"):
            spark.sql(f"drop table if exists {_table_name(f'{path}/{n}/{table}')}")
        spark.sql(f"drop table if exists {_table_name(f'{path}/{n}')}")
        files.remove(spark, f"{path}/{n}")
    return gone


def opened(spark: SparkSession, path: str, paths: list[str], make) -> engine.Index:
    """The index of some source files, built once and opened from then on; make() gives the tables that create() takes.
    When the source has changed the index is built anew, under the digest of what it is made from."""
    source = files.source_digest(spark, paths)
    place = f"{path}/{source[:16]}"
    if not versions(spark, place):
        create(place, source, *make())
    return load(spark, place, source)
