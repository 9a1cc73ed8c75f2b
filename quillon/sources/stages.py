"""Long work in shards that survives being broken off: what is committed stays, what isn't is rolled back and done again.

A run is a folder with a plan, written once: a name, the configuration and the digest of the inputs; another plan under
the same folder is refused. Each shard is written aside, moved to its place, and committed by a manifest of its files,
rows and an order-free digest, which is written last. What is to be done is an anti-join of the shards with the valid
ones; a manifest whose files have other names or sizes isn't valid, and neither rows nor shards without a manifest count.

The run's state goes forward only, along EDGES, each step a file that is written once and carries the number of the step;
a step that isn't an edge, or that two writers take at once, is refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import files

#: The states of a run and where each may lead.
EDGES: Mapping[str, tuple[str, ...]] = {"": ("planned",), "planned": ("running",), "running": ("frozen",), "frozen": ("complete",), "complete": ()}


class Refused(ValueError):
    """A step that may not be taken."""


@dataclass(frozen=True)
class Run:
    spark: SparkSession
    path: str

    # ---- plan and state ------------------------------------------------------------------------------------------------
    def plan(self, name: str, config: Mapping[str, object], inputs: list[str]) -> dict:
        """Writes the plan, or finds the same one; another plan, or inputs that have changed since, are refused."""
        told = {"name": name, "config": dict(config), "source": files.source_digest(self.spark, inputs)}
        told["digest"] = hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()
        place = f"{self.path}/plan.json"
        if not files.exists(self.spark, place):
            files.write_once(self.spark, place, told)
            self.step("planned")
        elif files.read_json(self.spark, place) != told:
            raise Refused(f"{self.path} holds another plan")
        return told

    def states(self) -> list[str]:
        return [files.read_json(self.spark, f"{self.path}/states/{n}")["state"] for n in files.children(self.spark, f"{self.path}/states") if n.endswith(".json")]

    def state(self) -> str:
        return (self.states() or [""])[-1]

    def step(self, to: str, guard: Callable[[], bool] = lambda: True) -> None:
        """Goes on to a state, if there is an edge and the guard holds."""
        taken = self.states()
        now = (taken or [""])[-1]
        if to not in EDGES.get(now, ()):
            raise Refused(f"{now or 'nothing'} does not lead to {to}")
        if not guard():
            raise Refused(f"the guard of {to} does not hold")
        try:
            files.write_once(self.spark, f"{self.path}/states/{len(taken):04d}.json", {"state": to})
        except FileExistsError as e:
            raise Refused(f"another writer took step {len(taken)}") from e

    # ---- shards --------------------------------------------------------------------------------------------------------
    def _manifest(self, shard: str) -> str:
        return f"{self.path}/committed/{shard}.json"

    def valid(self, shard: str) -> bool:
        """Whether a shard is committed and its files are those of its manifest."""
        place = self._manifest(shard)
        if not files.exists(self.spark, place):
            return False
        told = files.read_json(self.spark, place)["files"]
        return files.exists(self.spark, f"{self.path}/shards/{shard}") and [list(f[:2]) for f in files.listing(self.spark, f"{self.path}/shards/{shard}")] == told

    def committed(self) -> list[str]:
        return [n[:-5] for n in files.children(self.spark, f"{self.path}/committed") if n.endswith(".json") and self.valid(n[:-5])]

    def roll_back(self) -> list[str]:
        """Deletes what isn't committed: work aside, shards without a valid manifest, and such manifests. Returns it."""
        gone = [f"aside/{n}" for n in files.children(self.spark, f"{self.path}/aside")]
        keep = set(self.committed())
        gone += [f"shards/{n}" for n in files.children(self.spark, f"{self.path}/shards") if n not in keep]
        gone += [f"committed/{n}" for n in files.children(self.spark, f"{self.path}/committed") if n.removesuffix(".json") not in keep]
        for n in gone:
            files.remove(self.spark, f"{self.path}/{n}")
        return gone

    def pending(self, source: DataFrame, shard: Column) -> list[str]:
        """Shards of the source that aren't committed, in order; shards are a listing's worth of names, rows aren't."""
        every = source.select(shard.cast("string").alias("shard")).distinct()
        done = self.spark.createDataFrame([(s,) for s in self.committed()], "shard string")
        return sorted(r[0] for r in every.where("shard is not null").join(F.broadcast(done), "shard", "left_anti").collect())

    def run(self, source: DataFrame, shard: Column, work: Callable[[DataFrame], DataFrame], at_once: int = 16) -> list[str]:
        """Does what is left: `at_once` shards of the source at a time, each of their results committed by itself. work()
        takes source rows with a column `shard` and keeps it. Returns the shards done in this call."""
        if self.state() == "planned":
            self.step("running")
        if self.state() != "running":
            raise Refused(f"a run that is {self.state() or 'not planned'} takes no work")
        self.roll_back()
        todo = self.pending(source, shard)
        rows = source.withColumn("shard", shard.cast("string"))
        for at in range(0, len(todo), at_once):
            self._commit(todo[at : at + at_once], work(rows.where(F.col("shard").isin(todo[at : at + at_once]))))
        return todo

    def _commit(self, shards: list[str], result: DataFrame) -> None:
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        columns = sorted(c for c in result.columns if c != "shard")
        result.repartition("shard").withColumn("_shard", F.col("shard")).write.partitionBy("_shard").parquet(aside)
        written = self.spark.read.parquet(aside) if files.listing(self.spark, aside) else result.limit(0)
        digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
        told = {r["shard"]: (r["n"], r["digest"]) for r in written.groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count("*").alias("n"), digest.alias("digest")).collect()}
        for name in shards:
            place = f"{self.path}/shards/{name}"
            if name in told:
                files.move(self.spark, f"{aside}/_shard={name}", place)
            else:  # a shard whose result is empty is done all the same
                result.limit(0).write.parquet(place)
            n, d = told.get(name, (0, None))
            files.write_once(self.spark, self._manifest(name), {"shard": name, "rows": n, "digest": d, "files": [list(f[:2]) for f in files.listing(self.spark, place)]})
        files.remove(self.spark, aside)

    def freeze(self, source: DataFrame, shard: Column) -> None:
        """No more work: every shard of the source is there and valid."""
        self.step("frozen", lambda: not self.pending(source, shard))

    def complete(self) -> None:
        """The end, if the rows still have the digests of their manifests (they are read once more)."""
        self.step("complete", lambda: not self.problems().take(1))

    def result(self) -> DataFrame:
        """The rows of the committed shards."""
        paths = [f"{self.path}/shards/{s}" for s in self.committed()]
        return self.spark.read.parquet(*paths)

    def problems(self) -> DataFrame:
        """shard, problem of committed shards whose rows are not those of their manifest."""
        told = [(m["shard"], m["rows"], m["digest"]) for m in (files.read_json(self.spark, self._manifest(s)) for s in self.committed())]
        want = self.spark.createDataFrame(told, "shard string, n long, digest string")
        rows = self.result()
        columns = sorted(c for c in rows.columns if c != "shard")
        now = rows.groupBy("shard").agg(F.count("*").alias("n2"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("d2"))
        kind = F.when(F.coalesce("n2", F.lit(0)) != F.col("n"), "rows").when(~F.col("digest").eqNullSafe(F.col("d2")), "digest")
        return want.join(now, "shard", "left").select("shard", kind.alias("problem")).where("problem is not null")
