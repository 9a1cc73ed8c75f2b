"""Operators on literal inputs."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import audit, lifecycle, matching, metrics, retrieval, sampling
from quillon.plans.catalogue import OBO
from quillon.sources import ontology, sinks
from quillon.streaming import logs


def px(spark, pred, truth, ignored=None):
    rows = [(0, p, t, bool(ignored and ignored[i][j])) for i, (a, b) in enumerate(zip(pred, truth)) for j, (p, t) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "patch int, pred int, truth int, ignored boolean")


def kinds(table):
    found = matching.outcomes(table, matching.match(table)).agg(*matching.counts_by_kind()).first()
    return tuple(found)


def test_ignored_pixels_hide_an_object(spark):
    assert kinds(px(spark, [[1, 1, 2], [1, 1, 2]], [[1, 1, 0], [1, 1, 0]], [[0, 0, 1], [0, 0, 1]])) == (1, 0, 0)


def test_empty_and_perfect(spark):
    assert kinds(px(spark, [[0, 0]], [[0, 0]])) == (0, 0, 0)
    assert kinds(px(spark, [[1, 1, 0], [0, 0, 2]], [[1, 1, 0], [0, 0, 2]])) == (2, 0, 0)


def test_exactly_half_is_no_match(spark):
    assert kinds(px(spark, [[1, 1]], [[1, 0]])) == (0, 1, 1)


def category(spark, pred, truth):
    t = px(spark, pred, truth)
    return [r["category"] for r in matching.false_positive_kinds(t, matching.match(t)).orderBy("pred").collect()]


def test_false_positive_kinds(spark):
    assert category(spark, [[1, 1, 0, 0]], [[0, 0, 0, 0]]) == ["background_only"]
    assert category(spark, [[1, 1, 1, 2, 2, 0]] * 2, [[1, 1, 1, 1, 1, 0]] * 2) == ["split_fragment"]
    assert category(spark, [[1] * 6] * 2, [[1, 1, 1, 2, 2, 2]] * 2) == ["merge"]
    assert category(spark, [[1, 1, 0, 0, 0, 0]], [[1] * 6]) == ["boundary_localization"]


def test_greedy_takes_the_best_first(spark):
    t = px(spark, [[1, 1, 1, 2, 2]], [[1, 1, 0, 1, 1]])
    assert [(r["pred"], r["truth"]) for r in matching.match_greedy(t, 0.3).collect()] == [(2, 1)]
    with pytest.raises(ValueError):
        matching.match(t, 0.3)


def box(x):
    return (x, 0.0, x + 10.0, 10.0)


def test_two_detections_of_one_truth(spark):
    b = "struct<x1:double,y1:double,x2:double,y2:double>"
    gt = spark.createDataFrame([(1, 0, 7, box(0.0))], f"image long, cls int, truth_id long, truth {b}")
    det = spark.createDataFrame([(1, 0, 1, 0.2, box(0.0)), (1, 0, 2, 0.9, box(0.0)), (2, 1, 3, 0.5, box(0.0))], f"image long, cls int, det_id long, conf double, box {b}")
    hits = matching.box_matches(det, gt)
    assert {(r["det_id"], r["hit"]) for r in hits.collect()} == {(1, False), (2, True), (3, False)}
    assert [(r["cls"], r["ap"]) for r in matching.ap50(hits, gt).orderBy("cls").collect()] == [(0, 1.0), (1, 0.0), (2, 0.0)]


def test_resolve_first_match_wins(spark):
    terms = spark.createDataFrame([(1, False), (2, True), (3, True)], "id long, obsolete boolean")
    red = spark.createDataFrame([(9, "alt_id", 1), (2, "replaced_by", 1), (2, "consider", 3)], "id long, kind string, target long")
    got = {r["query"]: (r["kind"], r["targets"]) for r in retrieval.resolve(spark.createDataFrame([(1,), (2,), (3,), (9,), (8,)], "query long"), terms, red).collect()}
    assert got == {1: ("canonical", [1]), 2: ("obsolete_replaced_by", [1]), 3: ("obsolete_unresolved", []), 9: ("alternate", [1]), 8: ("unknown_identifier", [])}


def test_walk_visits_once_and_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "is_a"), ("a", "b", "part_of"), ("b", "c", "is_a"), ("c", "a", "is_a")], "parent string, child string, relation string")
    start = spark.createDataFrame([("a",)], "start string")
    assert sorted((r["node"], r["depth"]) for r in retrieval.walk(edges, start).collect()) == [("b", 1), ("c", 2)]
    assert retrieval.walk(edges, start, relations=("other",)).count() == 0
    assert retrieval.walk(edges, start, depth=0).count() == 0


def test_blocks_give_the_same_ranking(spark):
    from quillon.operators import blocks

    rows = [(i, [float(i % 7), 1.0]) for i in range(30)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    asked = corpus.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    whole = sorted(map(tuple, retrieval.cosine_topk(asked, corpus, 3).collect()))
    before, blocks.AT_ONCE = blocks.AT_ONCE, 7
    parts = sorted(map(tuple, blocks.in_blocks(asked, "query_id", lambda b: retrieval.rank_by(corpus.join(b).select("query_id", "id", retrieval.dot(F.col("q"), F.col("v")).alias("score")), "query_id", "score", "id", 3), 7).collect()))
    blocks.AT_ONCE = before
    assert whole == parts


def test_reviews(spark):
    log = spark.createDataFrame([("F1", 1, "confirm", None), ("F2", 2, "correct", "WBC"), ("F2", 3, "correct", "WBC"), ("F1", 4, "reject", None)], "f string, seq int, action string, label string")
    state = lifecycle.latest_state(log, "f", ["seq"], ["action", "label"])
    assert {(r["f"], r["label"]) for r in lifecycle.effective(state).collect()} == {("F2", "WBC")}
    assert lifecycle.without_replays(log, "f", ["seq"], ["action", "label"]).count() == 3
    assert lifecycle.bad_transitions(log, "f", ["seq"], "action", [("confirm", "reject")]).count() == 1


def test_evidence_is_numbered_again(spark):
    m = spark.createDataFrame([("F", "a", 1), ("F", "b", 2)], "finding_id string, evidence_id string, rank int")
    x = spark.createDataFrame([("F", "a")], "finding_id string, evidence_id string")
    man = spark.createDataFrame([("F", "M1", 1)], "finding_id string, evidence_id string, rank int")
    assert {(r["label"], r["evidence_id"]) for r in lifecycle.selected_evidence(m, x, man).collect()} == {("E1", "b"), ("E2", "M1")}


def test_cap_spares_exempt_rows(spark):
    rows = spark.createDataFrame([("F", i, False) for i in range(6)] + [("F", 9, True)], "g string, o int, human boolean")
    assert lifecycle.cap_per_group(rows, "g", ["o"], 3, "human").count() == 4


def test_jobs_keep_their_first_end(spark):
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (1, 3, "failed"), (2, 4, "queued")], "job int, seq int, status string")
    assert {tuple(r) for r in lifecycle.admit_jobs(log, "job", ["seq"], "status", ["done", "failed"], 5).collect()} == {(1, "done"), (2, "queued")}


def test_audits(spark):
    idx = spark.createDataFrame([(0,), (1,), (1,), (7,)], "i int")
    assert tuple(audit.coverage(idx, "i", 4).first()) == (2, 1, 1)
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "name string, sha256 string")
    b = spark.createDataFrame([("x", "9"), ("z", "2")], "name string, sha256 string")
    assert {tuple(r) for r in audit.manifest_diff(a, b).collect()} == {("x", "changed"), ("y", "unexpected"), ("z", "missing")}
    claims = spark.createDataFrame([(1, "see GO:0000007", ["E1"]), (2, "fine", ["E1"])], "claim_id int, text string, cited array<string>")
    assert [tuple(r) for r in audit.ungrounded(claims, spark.createDataFrame([("E1",)], "evidence_id string")).collect()] == [(1, ["GO:0000007"])]
    cases = spark.createDataFrame([(1, "a B", ["b"], []), (2, "a", [], ["A"])], "case_id int, text string, required array<string>, forbidden array<string>")
    assert sorted(map(tuple, audit.case_scores(cases).collect())) == [(1, 1.0, 0, True), (2, 1.0, 1, False)]


def test_selection_falls_back(spark):
    swept = spark.createDataFrame([(0.1, 0.5, 0.1), (0.2, 0.5, 0.1)], "threshold double, f1 double, recall double")
    assert metrics.best(swept).first()["threshold"] == 0.1


def test_split_counts(spark):
    rows = spark.range(20).select("id", F.lit("c").alias("s"))
    n = {r["split"]: r["count"] for r in sampling.stratified_split(rows, "id", "s").groupBy("split").count().collect()}
    assert n == {"train": 14, "val": 3, "test": 3}


def test_obo(spark):
    read = ontology.fields(ontology.stanzas(spark.createDataFrame([(OBO,)], "value string")))
    terms = {r["id"]: r for r in ontology.terms(read).collect()}
    assert set(terms) == {"GO:0000001", "GO:0000002", "GO:0000003"}
    assert terms["GO:0000001"]["definition"] == 'The "first" cell.' and terms["GO:0000003"]["obsolete"]
    assert {(r["value"], r["scope"]) for r in ontology.synonyms(read).collect()} == {("first cell", "EXACT"), ("one", "RELATED")}
    assert {tuple(r) for r in ontology.edges(read).collect()} == {("GO:0000001", "GO:0000002", "is_a"), ("GO:0000003", "GO:0000002", "part_of")}
    assert {tuple(r) for r in ontology.redirects(read).collect()} == {("GO:0000009", "alt_id", "GO:0000001"), ("GO:0000003", "replaced_by", "GO:0000002")}


def test_escapes(spark):
    df = spark.createDataFrame([(r"a\nb\\n\"q\z",)], "t string")
    assert df.select(T.unescape(F.col("t"))).first()[0] == 'a\nb\\n"qz'


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.range(130).select("id", (F.col("id") * 2).alias("v"))
    sinks.publish(df, str(tmp_path / "t"), 64, "id")
    assert sorted(p.name for p in (tmp_path / "t").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    with pytest.raises(Exception, match="exist"):
        sinks.publish(df, str(tmp_path / "t"), 64, "id")
    a, b = sinks.manifest(spark, {"t": df}).first(), sinks.manifest(spark, {"t": df.repartition(3)}).first()
    assert a == b
    with pytest.raises(ValueError):
        sinks.append_events(spark.createDataFrame([("odd",)], "event string"), str(tmp_path / "log"), ["start"])


def test_stream_resumes(spark, tmp_path):
    src, mark, out = str(tmp_path / "in"), str(tmp_path / "mark"), str(tmp_path / "out")
    schema = "k string, seq int, v int"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 5)], schema).write.parquet(src)
    run = lambda: logs.drain(logs.latest(logs.read(spark, src, schema), "k", ["seq"], ["v"]), out, mark)
    run()
    spark.createDataFrame([("a", 3, 9)], schema).write.mode("append").parquet(src)
    run()
    assert [tuple(r) for r in logs.current(spark, out, "k").collect()] == [("a", 9, 3)]
