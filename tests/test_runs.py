"""Runs in shards that are broken off and taken up again, and streams with keyed state that are restarted."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import audit, evaluation, lifecycle
from quillon.sources import arrays, files, stages
from quillon.streaming import logs, state


@pytest.fixture
def source(spark, tmp_path):
    path = f"{tmp_path}/source"
    spark.range(100).withColumn("x", F.col("id") * 3).write.parquet(path)
    return path


def shard():
    return F.floor(F.col("id") / 10)


def doubled(df):
    return df.select("shard", "id", (F.col("x") * 2).alias("y"))


class Broken(Exception):
    pass


def test_a_run_is_taken_up_where_it_broke_off(spark, tmp_path, source):
    run = stages.Run(spark, f"{tmp_path}/run")
    df = spark.read.parquet(source)
    run.plan("double", {"factor": 2}, [source])
    seen = []

    def breaks(part):
        seen.append(sorted(r[0] for r in part.select("shard").distinct().collect()))
        if len(seen) == 3:
            raise Broken
        return doubled(part)

    with pytest.raises(Broken):
        run.run(df, shard(), breaks, at_once=2)
    assert run.committed() == ["0", "1", "2", "3"]
    # remains of a writer that died: work aside, and rows that were moved but not committed
    doubled(df.withColumn("shard", F.lit("4"))).limit(3).write.parquet(f"{tmp_path}/run/aside/dead/_shard=4")
    doubled(df.withColumn("shard", F.lit("5"))).limit(3).write.parquet(f"{tmp_path}/run/shards/5")
    assert stages.Run(spark, f"{tmp_path}/run").run(df, shard(), doubled, at_once=3) == ["4", "5", "6", "7", "8", "9"]
    got = sorted((r["id"], r["y"]) for r in run.result().collect())
    assert got == [(i, 6 * i) for i in range(100)]
    assert run.run(df, shard(), doubled) == []  # nothing is left
    run.freeze(df, shard())
    with pytest.raises(stages.Refused):
        run.run(df, shard(), doubled)
    run.complete()
    assert run.states() == ["planned", "running", "frozen", "complete"]


def test_only_what_is_not_committed_is_rolled_back(spark, tmp_path, source):
    run, df = stages.Run(spark, f"{tmp_path}/run"), spark.read.parquet(source)
    run.plan("double", {}, [source])
    run.run(df.where("id < 30"), shard(), doubled)
    # a file of shard 1 is gone: it isn't valid any more, and is all that is done again
    place = f"{tmp_path}/run/shards/1"
    files.remove(spark, f"{place}/{files.listing(spark, place)[0][0]}")
    assert run.committed() == ["0", "2"] and run.pending(df.where("id < 30"), shard()) == ["1"]
    assert set(run.roll_back()) == {"shards/1", "committed/1.json"}
    assert run.run(df.where("id < 30"), shard(), doubled) == ["1"]
    assert run.result().count() == 30 and run.problems().count() == 0
    # a shard whose result is empty is committed too
    assert run.run(df.where("id < 40"), shard(), lambda d: doubled(d).where("id < 0")) == ["3"] and run.pending(df.where("id < 40"), shard()) == []


def test_steps_that_are_refused(spark, tmp_path, source):
    run, df = stages.Run(spark, f"{tmp_path}/run"), spark.read.parquet(source)
    with pytest.raises(stages.Refused):
        run.run(df, shard(), doubled)  # nothing is planned
    told = run.plan("double", {"factor": 2}, [source])
    assert run.plan("double", {"factor": 2}, [source]) == told
    with pytest.raises(stages.Refused):
        run.plan("double", {"factor": 3}, [source])
    with pytest.raises(stages.Refused):
        run.step("frozen")
    run.run(df.where("id < 20"), shard(), doubled)
    with pytest.raises(stages.Refused):
        run.freeze(df, shard())  # shards are missing
    assert run.state() == "running"
    run.freeze(df.where("id < 20"), shard())
    # rows that were changed under the same name and size are found when the run is to be complete
    place = f"{tmp_path}/run/committed/0.json"
    told = files.read_json(spark, place)
    files.remove(spark, place)
    files.write_once(spark, place, told | {"digest": "0"})
    with pytest.raises(stages.Refused):
        run.complete()
    assert [tuple(r) for r in run.problems().collect()] == [("0", "digest")]
    spark.range(1).write.mode("append").parquet(source)
    with pytest.raises(stages.Refused):
        run.plan("double", {"factor": 2}, [source])  # the inputs are others


START = datetime(2024, 1, 1)


def records(n, seed):
    rng = random.Random(seed)
    return [(rng.randint(1, 12), START + timedelta(minutes=rng.randint(0, 90)), i, rng.choice(["queued", "running", "running", "done", "failed"])) for i in range(n)]


SCHEMA = "job long, at timestamp, seq long, status string"


def put(spark, path, name, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def test_jobs_stream_restarted_in_the_middle(spark, tmp_path):
    data = records(240, 4)
    random.Random(2).shuffle(data)
    for i in range(6):
        put(spark, f"{tmp_path}/in", f"f{i}", data[40 * i : 40 * i + 40])

    def drain():
        with state.stateful(spark):
            logs.drain(state.jobs(logs.read(spark, f"{tmp_path}/in/*", SCHEMA), ["done", "failed"], history=200), f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    drain()
    put(spark, f"{tmp_path}/in", "f6", data[:30])  # a file of replays
    put(spark, f"{tmp_path}/in", "f7", records(60, 9)[:0] + [(r[0], r[1], r[2] + 1000, r[3]) for r in records(60, 9)])
    drain()  # a new query over the same checkpoint
    whole = data + [(r[0], r[1], r[2] + 1000, r[3]) for r in records(60, 9)]
    log = spark.createDataFrame(whole, SCHEMA)
    want = {r["job"]: r["status"] for r in lifecycle.admit_jobs(log, "job", ["at", "seq"], "status", ["done", "failed"], 1000).collect()}
    got = {r["job"]: r for r in logs.current(spark, f"{tmp_path}/out", "job").collect()}
    assert {j: r["status"] for j, r in got.items()} == want
    for j, r in got.items():
        own = sorted((x[1], x[2], x[3]) for x in whole if x[0] == j)
        ends = [x for x in own if x[2] in ("done", "failed")]
        assert (r["seq"], r["ended"], r["n_records"], r["replays"]) == ((ends or [own[-1]])[0][1], bool(ends), len(own), sum(x[0] == j for x in data[:30]))


def test_jobs_are_forgotten_after_their_end(spark, tmp_path):
    put(spark, f"{tmp_path}/in", "a", [(1, START, 1, "queued"), (1, START, 2, "done"), (2, START, 3, "queued")])
    put(spark, f"{tmp_path}/in", "b", [(3, START + timedelta(hours=5), 4, "queued")])
    put(spark, f"{tmp_path}/in", "c", [(3, START + timedelta(hours=5), 5, "running")])
    put(spark, f"{tmp_path}/in", "d", [(1, START + timedelta(hours=6), 6, "queued"), (2, START + timedelta(hours=6), 7, "running")])
    with state.stateful(spark):
        jobs = state.jobs(logs.read(spark, f"{tmp_path}/in/*", SCHEMA), ["done"], keep="1 hour")
        logs.drain(jobs, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r["job"]: (r["status"], r["n_records"]) for r in logs.current(spark, f"{tmp_path}/out", "job").collect()}
    # job 1 had ended and was forgotten; job 2 is open, so that it never is
    assert got == {1: ("queued", 1), 2: ("running", 2), 3: ("running", 2)}


def test_requests_share_an_active_job(spark, tmp_path):
    rng = random.Random(7)
    data, active = [], {}
    want = []
    for i in range(120):
        spec, job = rng.choice("ab"), rng.randint(1, 9)
        ends = rng.random() < 0.3
        data.append((spec, START + timedelta(minutes=i), i, job, "done" if ends else "queued"))
        if ends:
            active = {s: j for s, j in active.items() if (s, j) != (spec, job)}
        else:
            active.setdefault(spec, job)
            want.append((spec, i, job, active[spec], active[spec] != job))
    schema = "spec string, at timestamp, seq long, job long, status string"
    for i in range(4):
        spark.createDataFrame(data[30 * i : 30 * i + 30], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
        with state.stateful(spark):  # a restart after each file
            logs.drain(state.admissions(logs.read(spark, f"{tmp_path}/in/*", schema), ["done"]), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "append")
    out = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


# ---- trees of digests and preflight -----------------------------------------------------------------------------------
def test_trees_find_what_differs(spark):
    base = spark.range(3000).selectExpr("id", "id * 2 v")
    other = base.where("id <> 17").withColumn("v", F.when(F.col("id") == 40, -1).otherwise(F.col("v"))).union(spark.createDataFrame([(5000, 1), (41, 82)], "id long, v long"))
    got = {(r["id"], r["problem"]) for r in audit.row_differences(other, base, ["id"]).collect()}
    assert got == {(17, "missing"), (40, "changed"), (5000, "unexpected"), (41, "changed")}  # a repeated row is a change
    assert audit.row_differences(base, base.repartition(5), ["id"]).count() == 0
    tree = audit.digest_tree(base, ["id"])
    parts = audit.merged_trees([audit.digest_tree(base.where(c), ["id"]) for c in ("id < 100", "id >= 100")])
    key = lambda t: sorted(map(tuple, t.collect()))
    assert key(tree) == key(parts)
    top = {(r["n"], r["digest"]) for r in tree.where("level = 4").agg(F.sum("n").alias("n"), F.sum("digest").alias("digest")).collect()}
    low = {(r["n"], r["digest"]) for r in tree.where("level = 16").agg(F.sum("n").alias("n"), F.sum("digest").alias("digest")).collect()}
    assert top == low
    assert audit.differing(audit.digest_tree(other, ["id"]), tree).count() == 4
    assert audit.row_differences(base.limit(0), base.limit(0), ["id"]).count() == 0


def test_preflight(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 3.0], 1), (3, [0.0, float("nan")], 1)], "i int, v array<double>, label int")
    source = spark.createDataFrame([(1, 0), (2, 0), (4, 1)], "i int, label int")
    found = {r["problem"]: r["n"] for r in audit.embedding_problems(rows, "v", 2, source, "i", "label", 3).collect()}
    assert found == {"wrong width": 0, "not finite": 1, "zero": 0, "repeated": 0, "constant column": 0, "label": 1, "not in both": 2, "classes": 1}
    assert [r[0] for r in audit.constant_columns(rows.limit(2), "v").collect()] == [0]
    orphans = audit.orphans(rows, "i", source, "i")
    out = audit.preflight({"embeddings": audit.embedding_problems(rows, "v", 2, source, "i", "label"), "orphans": orphans, "none": rows.limit(0)})
    got = {(r["check"], r["problem"]): (r["n"], r["passed"]) for r in out.collect()}
    assert got == {("embeddings", "not finite"): (1, False), ("embeddings", "label"): (1, False), ("embeddings", "not in both"): (2, False), ("orphans", "row"): (1, False), ("none", None): (0, True)}


def test_benchmark_cases_by_type(spark):
    terms = spark.createDataFrame([(f"GO:000000{i}", i == 4) for i in range(1, 8)], "id string, obsolete boolean")
    redirects = spark.createDataFrame([("GO:0000011", "alt_id", "GO:0000001"), ("GO:0000004", "consider", "GO:0000002"), ("GO:0000004", "consider", "GO:0000003"), ("GO:0000004", "replaced_by", "GO:0000001")], "id string, kind string, target string")
    aliases = spark.createDataFrame([("one", "GO:0000001", None), ("uno", "GO:0000001", "EXACT"), ("both", "GO:0000002", "BROAD"), ("both", "GO:0000003", "BROAD"), ("mixed", "GO:0000005", "EXACT"), ("mixed", "GO:0000006", "BROAD"), ("seven", "GO:0000007", None)], "alias string, id string, scope string")
    edges = spark.createDataFrame([("GO:0000001", "GO:0000002", "is_a"), ("GO:0000002", "GO:0000003", "part_of"), ("GO:0000003", "GO:0000005", "is_a")], "parent string, child string, relation string")
    go = lambda *n: [f"GO:000000{i}" for i in n]
    good = [
        ("c", "canonical_id", "GO:0000001", None, None, None, None, go(1), None, ["mrr"]), ("a", "alternate_id", "GO:0000011", None, None, None, None, go(1), None, []),
        ("o", "obsolete_id", "GO:0000004", "consider", None, None, None, go(2, 3), None, []), ("s", "synonym", "Uno", None, "EXACT", None, None, go(1), None, []),
        ("m", "ambiguous", "both", None, "BROAD", None, None, go(2, 3), None, []), ("r", "rare", "seven", None, None, None, None, go(7), 1, []),
        ("t", "traversal", "GO:0000001", None, None, "descendants", 2, go(2, 3), None, []), ("u", "traversal", "GO:0000005", None, None, "ancestors", 1, go(3), None, []), ("v", "traversal", "GO:0000005", None, None, "descendants", 3, [], None, []),
    ]
    bad = [
        ("x1", "canonical_id", "GO:0000004", None, None, None, None, go(4), None, []), ("x2", "alternate_id", "eleven", None, None, None, None, go(1), None, ["other"]), ("x3", "obsolete_id", "GO:0000004", "replaced_by", None, None, None, go(2), None, []),
        ("x4", "synonym", "mixed", None, "EXACT", None, None, go(5, 6), None, []), ("x5", "ambiguous", "uno", None, "EXACT", None, None, go(1), None, []), ("x6", "rare", "one", None, None, None, None, go(1), 1, []),
        ("x7", "traversal", "GO:0000001", None, None, "descendants", 1, go(2, 3), None, []), ("x8", "traversal", "GO:0000001", None, None, "sideways", 0, go(2), None, []), ("x9", None, " ", None, None, None, None, None, None, None), ("x9", "canonical_id", "GO:0000002", None, None, None, None, go(2), None, None),
    ]
    schema = "case_id string, case_type string, query string, kind string, scope string, direction string, depth int, gold_ids array<string>, alias_max int, eligible_metrics array<string>"
    assert evaluation.benchmark_problems(spark.createDataFrame(good, schema), terms, redirects, aliases, edges).count() == 0
    got = {}
    for r in evaluation.benchmark_problems(spark.createDataFrame(good + bad, schema), terms, redirects, aliases, edges).collect():
        got.setdefault(r["case_id"], set()).add(r["rule"])
    assert got == {
        "x1": {"target not current", "gold"}, "x2": {"identifier", "gold", "metric"}, "x3": {"gold"}, "x4": {"scope"}, "x5": {"ambiguous has several targets"},
        "x6": {"rare has few aliases"}, "x7": {"gold"}, "x8": {"traversal", "gold"}, "x9": {"type", "no query", "no gold", "repeated id"},
    }


# ---- array files ------------------------------------------------------------------------------------------------------
def test_npy_files_by_ranges(spark, tmp_path):
    arrays.register(spark)
    a = np.arange(7 * 2 * 3, dtype="f4").reshape(7, 2, 3)
    b = np.arange(5 * 2 * 3, dtype="f4").reshape(5, 2, 3) - 9
    (tmp_path / "fold").mkdir()
    np.save(tmp_path / "fold" / "a.npy", a)
    np.save(tmp_path / "fold" / "b.npy", b)
    df = spark.read.format("npy").option("rows", 2).load(f"{tmp_path}/fold")
    assert df.schema.simpleString() == "struct<row:bigint,value:array<float>>" and df.rdd.getNumPartitions() == 4 + 3
    got = {r["row"]: r["value"] for r in df.collect()}
    assert got == {i: row.reshape(-1).tolist() for i, row in enumerate(np.concatenate([a, b]))}
    np.save(tmp_path / "one.npy", np.array([3, 1, 2], "u1"))
    assert [tuple(r) for r in spark.read.format("npy").load(f"{tmp_path}/one.npy").orderBy("row").collect()] == [(0, [3]), (1, [1]), (2, [2])]
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    assert spark.read.format("npy").load(f"{tmp_path}/none.npy").count() == 0
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((3, 4))))
    with pytest.raises(Exception, match="column order"):
        spark.read.format("npy").load(f"{tmp_path}/columns.npy").collect()


def test_a_cache_of_arrays(spark, tmp_path):
    arrays.register(spark)
    path = f"{tmp_path}/cache"
    rows = [(i, i % 2 == 0, i / 8, [float(j) for j in range(i % 4)], list(range(i % 3))) for i in range(50)]
    schema = "id long, even boolean, x float, boxes array<double>, ids array<int>"
    df = spark.createDataFrame(rows, schema).repartition(3)
    df.write.format("array_cache").option("rows", 7).mode("append").save(path)
    back = spark.read.format("array_cache").load(path)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    told = json.loads((tmp_path / "cache" / "manifest.json").read_text())
    assert sum(p["rows"] for p in told["parts"]) == 50 and max(p["rows"] for p in told["parts"]) <= 7 and len(told["parts"]) >= 8
    with pytest.raises(Exception, match="published"):  # a second time
        df.write.format("array_cache").mode("append").save(path)
    assert back.count() == 50
    # a byte of one column's file is changed: that column can't be read any more, the others can
    victim = tmp_path / "cache" / told["parts"][0]["name"] / "boxes.npy"
    victim.write_bytes(victim.read_bytes()[:-1] + b"\x7f")
    one = spark.read.format("array_cache").schema("id long").load(path)
    assert sorted(r[0] for r in one.collect()) == list(range(50))
    with pytest.raises(Exception, match="not the file of the manifest"):
        spark.read.format("array_cache").load(path).collect()


def test_a_cache_that_is_not_committed_is_none(spark, tmp_path):
    arrays.register(spark)
    path = tmp_path / "cache"
    bad = spark.createDataFrame([(1, [1.0]), (2, None)], "id long, v array<double>").repartition(1)
    with pytest.raises(Exception, match="nulls"):
        bad.write.format("array_cache").mode("append").save(str(path))
    assert not (path / "manifest.json").exists() and not list(path.glob("part-*"))
    with pytest.raises(Exception):
        spark.read.format("array_cache").load(str(path))
    with pytest.raises(Exception, match="no kind"):
        spark.createDataFrame([("x",)], "s string").write.format("array_cache").mode("append").save(str(path))
    spark.createDataFrame([], "id long, v array<double>").write.format("array_cache").mode("append").save(str(path))
    assert spark.read.format("array_cache").load(str(path)).count() == 0


def test_repeats_prefixes_and_subsets(spark):
    def work(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    cases = spark.createDataFrame([(1, "a"), (2, "bad")], "case_id int, text string")
    got = sorted(map(tuple, lifecycle.run_repeats(cases, "case_id", "text", 2, work).collect()))
    assert got == [(1, 1, "ok", "A", None), (1, 2, "ok", "A", None), (2, 1, "failed", None, "ValueError: no"), (2, 2, "failed", None, "ValueError: no")]
    a = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("q", 3, "z"), ("r", 1, "x")], "case_id string, rank int, id string")
    b = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("q", 3, "w"), ("r", 1, "x"), ("r", 2, "y")], "case_id string, rank int, id string")
    equal = {(r["case_id"], r["prefix"]): r["equal"] for r in evaluation.prefix_equivalence(a, b, (0, 1, 2, 3)).collect()}
    assert equal == {("q", 0): True, ("q", 1): True, ("q", 2): True, ("q", 3): False, ("q", None): False, ("r", 0): True, ("r", 1): True, ("r", 2): False, ("r", 3): False, ("r", None): False}
    assert evaluation.prefix_equivalence(a, a).where("not equal").count() == 0
    assert evaluation.subset(a, spark.createDataFrame([("q",), ("q",), ("n",)], "case_id string"), "case_id").count() == 3
