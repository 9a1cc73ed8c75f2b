"""The engine, policies, packets, publication and evaluation on small tables, with the cases that must fail."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from quillon.operators import engine, evaluation, packets, policies, retrieval
from quillon.sources import images, ontology, sinks
from quillon.streaming import logs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def index(spark):
    terms = [
        ("GO:0000001", "cell division", "d1", False), ("GO:0000002", "blood-cell growth", "d2", False), ("GO:0000003", "growth", "d3", False),
        ("GO:0000004", "old growth", "d4", True), ("GO:0000005", "Über cell", "d5", False), ("GO:0000006", "gone", "d6", True),
    ]
    synonyms = [("GO:0000001", "cytokinesis"), ("GO:0000003", "cell, growing"), ("GO:0000004", "ancient")]
    redirects = [("GO:0000011", "alt_id", "GO:0000001"), ("GO:0000004", "replaced_by", "GO:0000003"), ("GO:0000006", "consider", "GO:0000009")]
    vectors = [(f"GO:000000{i}", [float(i == j) + 0.1 for j in range(1, 4)]) for i in (1, 2, 3, 4)]
    return engine.build(
        spark.createDataFrame(terms, "id string, name string, definition string, obsolete boolean"), spark.createDataFrame(synonyms, "id string, value string"),
        spark.createDataFrame(redirects, "id string, kind string, target string"), spark.createDataFrame(vectors, "id string, v array<double>"),
    )


ASKED = ["cell, division", "blood-cell", "", "  growth ", "über CELL", "c", "cell division growth", "cytokinesis", "nothing like it", "gr"]


def test_lexical_by_index_and_by_scan(spark, index):
    q = spark.createDataFrame(list(enumerate(ASKED)), "query_id int, query string")
    scan = retrieval.lexical_scores(q.select("query"), index.aliases.select("id", "alias", "is_name")).join(q, "query").select("query_id", "id", "score")
    got = rows(engine.lexical(q, index), "query_id", "id", "score")
    assert got == rows(scan, "query_id", "id", "score")
    best = {(i, t): s for i, t, s in got}
    assert best[3, "GO:0000003"] == 10000 and best[7, "GO:0000001"] == 9000 and best[0, "GO:0000001"] == 2 and best[1, "GO:0000002"] == 100
    assert best[6, "GO:0000001"] == 102 and not any(i in (2, 8) for i, _ in best)


def test_modes(spark, index):
    q = spark.createDataFrame(
        [(1, "go:0000011", [0.0] * 3), (2, "GO:0000004", [1.0] * 3), (3, "GO:0000006", [1.0] * 3), (4, "GO:7777777", [1.0] * 3), (5, "growth", [0.0, 9.0, 0.0])], "query_id int, query string, q array<double>"
    )
    kinds = {r["query_id"]: (r["kind"], r["targets"]) for r in engine.resolved(q, index).collect()}
    assert kinds == {1: ("alternate", ["GO:0000001"]), 2: ("obsolete_replaced_by", ["GO:0000003"]), 3: ("obsolete_unresolved", []), 4: ("unknown_identifier", [])}
    for mode in engine.MODES:
        full = engine.retrieve(q, index, mode, None).cache()
        order = {i: [r["id"] for r in full.where(F.col("query_id") == i).orderBy("rank").collect()] for i in range(1, 6)}
        everyone = ["GO:0000001", "GO:0000002", "GO:0000003", "GO:0000005"]
        assert order[1] == everyone and order[2] == ["GO:0000003", "GO:0000001", "GO:0000002", "GO:0000005"] and order[3] == order[4] == everyone
        assert order[5][0] == {"symbolic": "GO:0000003", "vector": "GO:0000002", "hybrid": "GO:0000002"}[mode] or mode == "hybrid"
        short = engine.retrieve(q, index, mode, 2)
        assert rows(short, "query_id", "rank", "id") == rows(full.where("rank <= 2"), "query_id", "rank", "id")
    with pytest.raises(ValueError):
        engine.retrieve(q, index, "other")


def test_findings_and_lookups(spark, index):
    ranked = spark.createDataFrame([(1, "GO:0000003", 1), (1, "GO:0000004", 2), (1, "GO:0000001", 3)], "query_id int, id string, rank long")
    assert rows(engine.describe(ranked, index.terms), "id", "rank") == [("GO:0000001", 3), ("GO:0000003", 1)]
    with pytest.raises(ValueError):
        engine.describe(ranked, index.terms, strict=True)
    findings = spark.createDataFrame([("F1", "a", "confirmed"), ("F2", "a", "corrected")], "finding_id string, label string, review_state string")
    out = rows(engine.retrieve_for_findings(findings, {"a": "growth", "b": "x"}, index, "symbolic", 2), "finding_id", "evidence_id", "id", "rank")
    assert out == [("F1", "E1", "GO:0000003", 1), ("F1", "E2", "GO:0000002", 2), ("F2", "E1", "GO:0000003", 1), ("F2", "E2", "GO:0000002", 2)]
    for bad in (findings.withColumn("review_state", F.lit("rejected")), findings.withColumn("label", F.lit("z"))):
        with pytest.raises(ValueError):
            engine.retrieve_for_findings(bad, {"a": "growth"}, index)
    left = spark.createDataFrame([(1,), (1,), (2,)], "patch int")
    assert engine.lookup(left, spark.createDataFrame([(1, "x"), (2, "y")], "patch int, v string"), "patch").count() == 3
    with pytest.raises(ValueError):
        engine.lookup(left, spark.createDataFrame([(1, "x")], "patch int, v string"), "patch")
    machine = spark.createDataFrame([("F1", "E1", "a"), ("F1", "E2", "b")], "finding_id string, evidence_id string, id string")
    edits = spark.createDataFrame([(1, "F1", "exclude", "E1", None), (2, "F1", "add", None, "c"), (3, "F1", "exclude", "E2", None), (4, "F1", "include", "E2", None), (5, "F1", "exclude", "E9", None)], "seq int, finding_id string, op string, evidence_id string, id string")
    assert rows(engine.edited_evidence(machine, edits), "evidence_id", "origin", "excluded") == [("E1", "auto", True), ("E2", "auto", False), ("M1", "human", False)]
    assert rows(engine.unknown_edits(machine, edits), "seq") == [(5,)]


def test_policies(spark):
    x = F.array(F.lit(1.0), F.lit(2.0))
    one = spark.range(1).select(policies.linear_scores(x, (0.0, 1.0), (1.0, 0.0), ((1.0, 1.0), (2.0, 0.0)), (0.0, 0.0)).alias("s"))
    assert one.select(policies.first_largest(F.col("s")), policies.adjusted_class(F.col("s"), (0.0, 0.5)), "s").first()[:3] == (0, 2, [2.0, 2.0])
    entries = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "k string, f1 double")
    assert policies.choose(entries, ["f1"], "f1 > 0.1").first()["k"] == "b"
    with pytest.raises(ValueError):
        policies.choose(entries, ["f1"], "f1 > 1")
    left, right = spark.createDataFrame([(1, 5), (1, 3)], "g int, a int"), spark.createDataFrame([(1, 10), (1, 20)], "g int, b int")
    assert rows(policies.aligned(left, right, "g", ["a"], ["b"]), "a", "b") == [(3, 10), (5, 20)]
    with pytest.raises(ValueError):
        policies.aligned(left, right.limit(1), "g", ["a"], ["b"])
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert rows(policies.with_fallback(keys, spark.createDataFrame([(1, "c")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), ["k"], "v"), "k", "v") == [(1, "c"), (2, "y"), (3, None)]
    box = spark.createDataFrame([(0.5, 0.5, 0.2, 0.4)], "cx double, cy double, w double, h double").select(policies.corners(*(F.col(c) for c in ("cx", "cy", "w", "h")), 100, 50).alias("b"))
    assert [round(v, 6) for v in box.first()["b"]] == [40.0, 15.0, 60.0, 35.0] and list(box.select(policies.crop("b", 100, 36).alias("c")).first()["c"]) == [38, 13, 62, 36]
    det = spark.createDataFrame([(1, i, 0.5) for i in range(5)], "image int, det_id int, conf double")
    assert rows(policies.top_detections(det, 2), "det_id") == [(0,), (1,)]
    old, new = (spark.createDataFrame(d, "patch int, pred int, label int") for d in ([(1, 1, 0), (1, 2, 3), (1, 3, 1)], [(1, 1, 2), (1, 2, 3), (1, 4, 1)]))
    assert tuple(policies.relabelled(old, new).first()) == (1, 1, 1, 1)
    y, x = policies.turned(F.lit(0), F.lit(1), 3, 1, False)
    assert tuple(spark.range(1).select(y, x).first()) == (1, 0)
    ledger = policies.membership_ledger(old.withColumn("f", F.lit(1.5)).drop("label"), new)
    assert rows(ledger, "pred", "reason") == [(1, "matched"), (2, "matched"), (3, "unlabelled")]
    bad = spark.createDataFrame([(0, 1, 9, 0, 1), (0, 1, 1, 7, 1), (0, 1, 1, 0, 0)], "patch int, y int, x int, cls int, raw_id int")
    assert dict(rows(policies.bad_mask_rows(bad, 4, 4, range(5)))) == {"class": 1, "place": 1, "id": 1, "null": 0}


def test_pieces_and_targets(spark):
    snake = [(0, y, x, 0, 1) for y, x in [(0, 0), (1, 1), (2, 0), (3, 1), (3, 2), (2, 3), (1, 4), (0, 4)]]
    apart = [(0, 0, 7, 1, 1), (0, 3, 7, 1, 1)]
    over = [(0, 5, 5, 1, 2), (0, 5, 5, 2, 1), (0, 5, 6, 2, 1)]
    good = [(0, 6, 0, 3, 4), (0, 6, 1, 3, 4), (0, 7, 7, 0, 9)]
    mask = spark.createDataFrame(snake + apart + over + good, "patch int, y int, x int, cls int, raw_id int")
    got = {(r["cls"], r["raw_id"]): r["pieces"] for r in policies.pieces(mask).collect()}
    assert got == {(0, 1): 1, (1, 1): 2, (1, 2): 1, (2, 1): 1, (3, 4): 1, (0, 9): 1}
    background = spark.createDataFrame([(0, 4, 4), (0, 5, 5)], "patch int, y int, x int")
    t = {(r["y"], r["x"]): (r["semantic"], r["instance"]) for r in policies.target(mask, background).collect()}
    assert t[0, 0] == (1, 1) and t[7, 7] == (1, 2) and t[6, 0] == (4, 3) and t[4, 4] == (0, 0)
    assert t[0, 7] == t[5, 5] == t[5, 6] == (policies.IGNORE, 0) and (1, 0) not in t


def test_packets(spark):
    findings = spark.createDataFrame([(1, "F1", "dead", None, 2.0, 0.5), (1, "F2", "dead", "odd", -1.0, 1.5), (1, "x", "none", None, None, None), (1, "F1", "dead", None, None, None)], "case_id int, finding_id string, label string, qualifier string, count double, confidence double")
    got = rows(packets.finding_violations(findings, ["dead"]), "id", "rule")
    assert got == [("F1", "repeated finding"), ("F2", "confidence"), ("F2", "count"), ("F2", "qualifier"), ("x", "finding id"), ("x", "label")]
    state = findings.limit(2).withColumn("review_state", F.when(F.col("finding_id") == "F2", "rejected"))
    assert rows(packets.packet_findings(state), "finding_id", "qualifier") == [("F1", "observed")]
    assert packets.suite(spark.createDataFrame([(True,), (False,)], "passed boolean")).first()[:3] == (2, 1, False)
    raw = spark.createDataFrame([(1, '{"a": 1}'), (2, "[]"), (3, "{}"), (4, None), (5, '{"b": "x"}'), (6, "oops")], "id int, t string")
    good, bad = packets.parsed(raw, "t", "a int, b string")
    assert rows(good, "id") == [(1,), (5,)] and rows(bad, "id") == [(2,), (3,), (4,), (6,)]
    context = spark.createDataFrame([(1, "E2", "GO:0000001"), (1, "E10", "GO:0000002")], "case_id int, evidence_id string, go_id string")
    payload = json.loads(packets.requests(findings.limit(1), context).first()["payload"])
    assert [e["evidence_id"] for e in payload["context"]] == ["E2", "E10"] and payload["findings"][0]["label"] == "dead"
    ids = spark.createDataFrame([(1,), (2,)], "case_id int")
    out = {r["case_id"]: json.loads(r["bundle"]) for r in packets.bundle(ids, {"context": context}, "case_id").collect()}
    assert len(out[1]["context"]) == 2 and out[2] == {}
    a, b = spark.createDataFrame([(1, "x")], "p int, q string"), spark.createDataFrame([("x", 1)], "q string, p int")
    assert a.select(packets.digest(a.columns)).first() == b.select(packets.digest(b.columns)).first()


def test_publication(spark, tmp_path):
    source = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "idx int, sha string")
    batch = lambda rows: spark.createDataFrame([(b, i, [1.0, 0.0], s) for b, i, s in rows], "batch int, idx int, embedding array<double>, sha string")
    good = batch([(0, 0, "s0"), (0, 1, "s1"), (1, 2, "s2"), (1, 3, "s3")])
    for bad in (batch([(0, 0, "s0")]), good.union(good.limit(1)), good.withColumn("sha", F.lit("x")), good.withColumn("idx", F.col("idx") + 1), good.withColumn("embedding", F.array(F.lit(float("nan")), F.lit(0.0))), batch([(0, 0, "s0"), (0, 2, "s2"), (1, 1, "s1"), (1, 3, "s3")])):
        with pytest.raises(ValueError):
            sinks.publish_batches(bad, source, 2, f"{tmp_path}/bad")
    path = f"{tmp_path}/good"
    sinks.publish_batches(good, source, 2, path)
    assert sinks.read_published(spark, path, ["idx"]).count() == 4
    sinks.publish(good, f"{tmp_path}/half/rows")
    assert sinks.uncommitted(spark, [path, f"{tmp_path}/half", f"{tmp_path}/none"]) == [f"{tmp_path}/half"]
    good.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        sinks.read_published(spark, path)
    images = spark.createDataFrame([(1,), (2,)], "image int")
    det = spark.createDataFrame([(1, [([0.0, 0.0, 1.0, 1.0], 0, 0.5)]), (2, [])], "image int, boxes array<struct<box:array<double>,cls:int,conf:double>>")
    sinks.publish_detections(det, images, f"{tmp_path}/det")
    for bad in (det.limit(1), det.union(det), spark.createDataFrame([(1, [([0.0, 0.0, 0.0, 1.0], 3, -0.5)]), (2, [])], det.schema)):
        with pytest.raises(ValueError):
            sinks.publish_detections(bad, images, f"{tmp_path}/det2")
    sinks.require_unexposed(spark, f"{tmp_path}/marker")
    sinks.mark_exposed(spark, f"{tmp_path}/marker", "d")
    with pytest.raises(ValueError):
        sinks.require_unexposed(spark, f"{tmp_path}/marker")
    with pytest.raises(Exception, match="exist"):
        sinks.mark_exposed(spark, f"{tmp_path}/marker", "d")
    a, b = (sinks.stage_manifest(spark, "s", c, {}).first()["digest"] for c in ({"x": "1", "y": "2"}, {"y": "2", "x": "1"}))
    assert a == b
    rows_ = spark.createDataFrame([(1, [0.6, 0.8], "t")], "id int, v array<double>, title string")
    sinks.publish_embeddings(rows_, "id", "v", ["id", "title"], f"{tmp_path}/emb")
    with pytest.raises(ValueError):
        sinks.publish_embeddings(rows_.withColumn("v", F.array(F.lit(2.0))), "id", "v", ["id"], f"{tmp_path}/emb2")


OBO = """format-version: 1.2
data-version: releases/2024-01-01
property_value: terms:license http://example.org/by/4.0/

[Term]
id: GO:0000001
name: one
def: "A \\"q\\" text." [GOC:a, PMID:1]
synonym: "uno" EXACT latin [GOC:b]
synonym: "eins" WRONG []

[Term]
id: GO:0000001
is_a: GO:0000002
"""


def test_ontology_header_and_problems(spark, tmp_path):
    parts, found = ontology.from_text(spark.createDataFrame([(OBO,)], "value string"))
    assert tuple(ontology.header(parts).first()) == ("1.2", "releases/2024-01-01", "http://example.org/by/4.0/")
    assert {r["problem"]: r["n"] for r in ontology.problems(parts, found, 3).collect() if r["n"]} == {"no name": 1, "repeated id": 1, "number of terms": 1, "unknown scope": 1}
    s = {r["value"]: (r["scope"], r["type"], r["xrefs"]) for r in ontology.synonyms(found).collect()}
    assert s == {"uno": ("EXACT", "latin", ["GOC:b"]), "eins": (None, None, [])}
    assert ontology.terms(found).where("name = 'one'").first()["definition_xrefs"] == ["GOC:a", "PMID:1"]
    relations = {
        "terms": ontology.terms(found).where("name is not null"), "synonyms": ontology.synonyms(found), "redirects": ontology.redirects(found),
        "aliases": ontology.synonyms(found).select("id", "value"), "edges": spark.createDataFrame([], "parent string, child string, relation string"),
    }
    sinks.publish_ontology(spark, relations, f"{tmp_path}/onto")
    with pytest.raises(ValueError):
        sinks.publish_ontology(spark, relations | {"edges": ontology.edges(found)}, f"{tmp_path}/onto2")


def test_small_sources(spark, tmp_path):
    lines = spark.createDataFrame([("a b.png  blast",), ("",), ("c.png other",)], "value string")
    assert rows(ontology.annotations(lines, ["blast"], ["other"])) == [("a b.png", "blast")]
    with pytest.raises(ValueError):
        ontology.annotations(lines, ["blast"])
    assert ontology.fold_paths("/d", 2)["masks"] == "/d/fold2/masks"
    with pytest.raises(ValueError):
        ontology.fold_paths("/d", 4)
    digest = "a" * 64
    assert rows(ontology.sidecars(spark.createDataFrame([(f"{digest}  my file",), ("bad",)], "value string"))) == [("my file", digest), (None, None)]
    png = lambda w, h: bytes.fromhex("89504E470D0A1A0A") + b"\0\0\0\rIHDR" + struct.pack(">II", w, h)
    frame = b"\xff\xc2\0\x11\x08" + struct.pack(">HH", 80, 90)
    jpg = b"\xff\xd8\xff\xe0\0\x04xy\xff" + frame  # a segment, a fill byte, a progressive frame
    tiff = lambda o, w, h: (b"II*\0" if o == "<" else b"MM\0*") + struct.pack(o + "IH", 8, 2) + struct.pack(o + "HHIHH", 256, 3, 1, w, 0) + struct.pack(o + "HHII", 257, 4, 1, h)
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 100, -70)
    assert [images.dimensions(b) for b in (png(64, 65), jpg, tiff("<", 66, 67), tiff(">", 68, 69), bmp, jpg[:9], png(1, 1)[:18], b"", None)] == [(64, 65), (90, 80), (66, 67), (68, 69), (100, 70), None, None, None, None]
    small, wide, many = png(63, 64), png(4097, 64), png(4096, 4096) + b"more"
    assert images.dimensions(many) == (4096, 4096) and 8192 * 4000 > ontology.PIXELS >= 4096 * 4096
    for name, data in (("a.png", png(64, 4096)), ("b.png", png(64, 4096)), ("c.txt", b"text"), ("d.jpg", jpg), ("e.png", b""), ("f.png", small), ("g.png", wide), ("h.jpg", jpg[:12])):
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    first = ontology.image_stills(files)
    assert sorted((r["kind"], r["path"][-5:]) for r in first.collect()) == [("jpeg", "d.jpg"), ("png", "a.png")]
    assert {(r["kind"], r["width"], r["height"]) for r in first.collect()} == {("jpeg", 90, 80), ("png", 64, 4096)}
    assert ontology.image_stills(files, first.where("kind = 'png'")).count() == 1 and ontology.image_stills(files, pixels=8000).count() == 1
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.txt").write_text("0 0.5 0.5 0.1 0.1\n\n1 x 0 0 0\n2 3\n")
    assert sorted(r["malformed"] for r in ontology.read_labels(spark, f"{tmp_path}/l").collect()) == [False, True, True]
    assert ontology.file_catalogue(spark, f"{tmp_path}/l").count() == 1
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(ontology.read_log(spark, f"{tmp_path}/log", "a int").where("a is not null")) == [(1,), (2,)]


def test_evaluation(spark):
    rank = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 1), ("b", "y", 2)], "case_id string, id string, rank long")
    cases = spark.createDataFrame([("a", ["mrr", "exact_id_accuracy"]), ("b", ["recall_at_5"]), ("c", ["mrr"])], "case_id string, eligible_metrics array<string>")
    assert rows(evaluation.bad_rankings(rank, cases)) == [("b", "repeated"), ("c", "empty")]
    gold = spark.createDataFrame([("a", "x"), ("b", "z")], "case_id string, id string")
    m = evaluation.case_metrics(rank, gold, cases)
    assert rows(m) == [("a", 1, 1, None, 1.0, 1.0), ("b", 1, None, 0.0, None, None), ("c", 0, None, None, 0.0, None)]
    assert rows(evaluation.metric_means(m)) == [("exact_id_accuracy", 1, 1.0), ("mrr", 2, 0.5), ("recall_at_5", 1, 0.0)]
    d = spark.createDataFrame([("a", 1, "h"), ("a", 2, "h"), ("b", 1, "h"), ("b", 2, "g")], "case_id string, repeat int, digest string")
    assert rows(evaluation.unsteady(d), "case_id") == [("b",)]
    assert rows(evaluation.reused(gold, gold.limit(1), ["case_id", "id"])) == [("a", "x")]
    kinds = spark.createDataFrame([(1, "canonical", ["x"]), (2, "canonical", ["x", "y"]), (3, "ambiguous", ["x"]), (4, "rare", ["y"]), (5, "rare", ["q"])], "case_id int, case_type string, gold_ids array<string>")
    current, alias = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x", "1"), ("y", "1"), ("y", "2")], "id string, alias string")
    assert rows(evaluation.case_violations(kinds, current, alias)) == [(2, "canonical has one target"), (3, "ambiguous has several targets"), (4, "rare has few aliases"), (5, "target not current")]
    one = spark.createDataFrame([(5, 0.5)], "tp int, f1 double")
    assert rows(evaluation.within(one, {"tp": 5, "f1": 0.5000001}, 1e-3), "metric", "ok") == [("f1", True), ("tp", True)]
    assert rows(evaluation.within(one, {"tp": 6}), "ok") == [(False,)]
    parts, whole = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int"), spark.createDataFrame([("a", 3), ("b", 2)], "k string, v int")
    assert rows(evaluation.unreconciled(parts, whole, ["k"], "v"), "k") == [("b",)]
    swept = spark.createDataFrame([(0.1, 0.5, 0.9), (0.2, 0.6, 0.8), (0.3, 0.9, 0.5)], "threshold double, f1 double, recall double")
    assert evaluation.sensitive_threshold(swept).first()["threshold"] == 0.2
    synonyms = spark.createDataFrame([(1, "x", "EXACT"), (2, "y", "BROAD")], "synonym_id int, id string, scope string")
    aliases = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "alias string, synonym_id int")
    terms = spark.createDataFrame([("x", False), ("y", False)], "id string, obsolete boolean")
    assert rows(evaluation.alias_pairs(aliases, synonyms, terms, "EXACT")) == [("a", "x")]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 6, "c"), (1, 7, "b")], "user_id int, seq int, action string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: logs.read(spark, f"{tmp_path}/in", df.schema)
    for more, last in ((None, "c"), ((2, 9, "z"), "z"), (None, "z")):
        if more:
            spark.createDataFrame([more], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        logs.drain(logs.latest(read(), "user_id", ["seq"], ["action"]), f"{tmp_path}/state", f"{tmp_path}/ck")
        assert rows(logs.current(spark, f"{tmp_path}/state"), "user_id", "action") == [(1, "b"), (2, last)]
    logs.drain(logs.distinct_records(read(), ["user_id", "seq", "action"]), f"{tmp_path}/once", f"{tmp_path}/ck2", "append")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 4
    timed = logs.read(spark, f"{tmp_path}/in", df.schema).withColumn("ts", F.timestamp_seconds("seq"))
    logs.drain(logs.windows(timed, "ts", "4 seconds", "1 minute", ["user_id"]), f"{tmp_path}/win", f"{tmp_path}/ck3")
    assert spark.read.parquet(f"{tmp_path}/win").agg(F.max("count")).first()[0] >= 2


def test_injected_predictor_and_cache(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [-5.0, 0.0])], "patch int, pred int, x array<double>")

    def double(batches):
        for b in batches:
            yield b.assign(y=[sum(v) * 2 for v in b["x"]])[["pred", "y"]]

    assert rows(policies.predicted(df, double, "pred int, y double")) == [(1, 6.0), (2, -10.0)]
    model = {"mean": (0.0, 0.0), "scale": (1.0, 1.0), "weights": ((1.0, 0.0), (0.0, 1.0)), "intercept": (0.0, 0.0)}
    keep = {"mean": (0.0, 0.0), "scale": (1.0, 1.0), "weights": ((1.0, 0.0),), "intercept": (0.0,)}
    assert rows(policies.score_cache(df, "x", model, keep, 0.35), "pred", "cls") == [(1, 2)]


def test_hosts(spark):
    from quillon.functions import text as T

    urls = ["http://localhost:80/x", "https://[::1]:8/", "http://127.0.0.1", "http://u@example.org/127.0.0.1", "ftp://LOCALHOST", "nothing", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(T.is_loopback("u")).collect()] == [True, True, True, False, True, False, None]


def test_notes_of_repeated_claim_ids(spark):
    claims = [(1, 1, "C1", "first", ["F1"], ["E1"]), (1, 2, "C1", "second", ["F2", "F1"], ["E2"]), (1, 3, "C2", "third", ["F9"], [])]
    claims = spark.createDataFrame(claims, "case_id int, seq int, claim_id string, text string, finding_ids array<string>, evidence_ids array<string>")
    findings = spark.createDataFrame([(1, "F1", "dead"), (1, "F2", "blue"), (1, "F2", "azure")], "case_id int, finding_id string, label string")
    context = spark.createDataFrame([(1, "E1", "GO:1"), (1, "E2", "GO:2")], "case_id int, evidence_id string, go_id string")
    responses = spark.createDataFrame([(1, False, None), (2, True, "low count"), (3, False, None)], "case_id int, abstained boolean, abstention_reason string")
    limits = spark.createDataFrame([(1, ["one", "two"]), (2, [])], "case_id int, limitations array<string>")
    got = {r["case_id"]: r["note"] for r in packets.notes(responses, claims, findings, context, limits, "Warning.").collect()}
    assert got[1] == (
        "Case 1 \u2014 synthesis review note\n\n- [C1] first\n  findings: dead; evidence: E1 (GO:1)\n- [C1] second\n  findings: blue, dead; evidence: E2 (GO:2)\n"
        "- [C2] third\n  findings: ; evidence: \n\nLimitations: one; two\n\nWarning.\n"
    )
    assert got[2] == "Case 2 \u2014 synthesis review note\n\nABSTAINED: no supported finding to report.\nReason: low count\n\nWarning.\n"
    assert got[3] == "Case 3 \u2014 synthesis review note\n\n\nWarning.\n"
    plain = {r["case_id"]: r["note"] for r in packets.notes(responses, claims, findings, context).collect()}
    assert "Limitations" not in plain[1] and plain[3].endswith(packets.ASSIST_WARNING + "\n")


def test_entry_survives_a_missing_dependency():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'lexical_rank' in q and 'op1_bpe' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
