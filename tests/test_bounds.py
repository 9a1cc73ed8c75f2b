"""What a task holds is bounded, and copies of a text are ranked once: against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import engine, evaluation, fusion, retrieval


def test_first_rows_of_a_task_are_few_and_exact():
    rng = np.random.default_rng(4)
    few = rng.normal(size=(40, 8))
    vectors, asked = few[rng.integers(0, 40, 3000)], rng.normal(size=(30, 8))  # many equal vectors
    ids = np.array([f"GO:{i:07d}" for i in rng.permutation(3000)])
    best = retrieval._Best(asked, 5)
    for at in range(0, 3000, 7):
        best.add(ids[at : at + 7], vectors[at : at + 7])
        assert best.n <= 2 * 5 * 30 + 7 * 30
    q, score, found = best.shrink()
    whole = retrieval.cosines(asked, vectors)
    for i in range(30):
        want = sorted(range(3000), key=lambda j: (-whole[i, j], ids[j]))[:5]
        assert found[q == i].tolist() == ids[want].tolist() and score[q == i].tolist() == whole[i, want].tolist()


def test_vectors_of_a_large_batch_are_met_in_steps(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (2000, 6)).astype(float)
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").coalesce(1)
    queries = corpus.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = {}
    for r in retrieval.cosine_topk(queries, corpus, 3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for i in range(0, 2000, 2):
        s = v @ v[i]
        assert [got[i][r] for r in (1, 2, 3)] == sorted(range(2000), key=lambda j: (-s[j], j))[:3]


def test_two_measures_are_fused_without_whole_rankings(spark):
    rng = random.Random(6)
    ids = rng.sample(range(-3000, 3000), 900)
    corpus = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in ids], "id long, v array<double>").repartition(5)
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    number = lambda c: F.array(F.col(c).cast("double"))
    lists = [(queries, corpus, fusion.COSINE), (queries.select("query_id", number("query_id").alias("q")), corpus.select("id", number("id").alias("v")), fusion.NEARNESS)]
    every = corpus.crossJoin(queries)
    by_cosine = retrieval.rank_by(every.withColumn("s", retrieval.dot(F.col("q"), F.col("v"))), "query_id", "s", "id")
    by_id = retrieval.rank_by(every.withColumn("s", -F.abs(F.col("id") - F.col("query_id"))), "query_id", "s", "id")
    want = retrieval.reciprocal_rank_fusion([by_cosine, by_id]).where("rank <= 10")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert key(fusion.fused_lists(lists, 10)) == key(want)


def test_copies_of_a_text_are_ranked_once(spark):
    rng = random.Random(7)
    words = ["red", "blue", "ring", "rod", "a", "big ring"]
    terms = [(i, f"{rng.choice(words)} {rng.choice(words)}" if i % 9 else "Ring", "d", i % 11 == 0) for i in range(300)]
    t = spark.createDataFrame(terms, "id long, name string, definition string, obsolete boolean")
    synonyms = spark.createDataFrame([(i, rng.choice(words)) for i in range(0, 300, 2)], "id long, value string")
    index = engine.build(t, synonyms, spark.createDataFrame([], "id long, kind string, target long"))
    queries = spark.createDataFrame([(i, rng.choice(["ring", " Red rod ", "blue", "", "big ring red", "none", "in"])) for i in range(60)], "query_id long, query string")
    want = retrieval.rank_by(engine.lexical(queries, index), "query_id", "score", "id", 7)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(engine.lexical_top(queries, index, 7)) == key(want)
    # the rows that are ranked grow with distinct texts, not with queries or terms
    texts, first = engine._texts(index.aliases, 7)
    assert texts.aliases.count() == index.aliases.select("alias", "is_name").distinct().count() < 50 and first.groupBy("text").count().agg(F.max("count")).first()[0] == 7


def test_cases_of_a_common_text_are_no_pairs(spark):
    rng = random.Random(8)
    terms = spark.createDataFrame([(i, i % 7 == 0) for i in range(120)], "id long, obsolete boolean")
    aliases = [(rng.choice(["Ring", "rod", f"own {i}"]), i, rng.choice([None, "EXACT", "BROAD"])) for i in range(120) for _ in range(2)]
    held = lambda text, scoped: {i for a, i, s in aliases if a.lower() == text and i % 7 and (s or not scoped)}
    cases = []
    for c in range(150):
        kind, text = ("synonym", "ambiguous", "rare")[c % 3], rng.choice(["RING", "rod", f"Own {c % 120}", "none"])
        right = sorted(held(text.lower(), kind != "rare"))
        cases.append((c, kind, text, None, "EXACT", None, 0, rng.choice([right, right[:-1], [*right, 500], [c % 120]]) if c % 5 else [], 1, []))
    cases += [(3, "rare", "rod", None, None, None, 0, sorted(held("rod", False)), 1, []), (200, None, "rod", None, None, None, 0, [1], 1, [])]
    c = spark.createDataFrame(cases, "case_id long, case_type string, query string, kind string, scope string, direction string, depth int, gold_ids array<long>, alias_max int, eligible_metrics array<string>")
    a = spark.createDataFrame(aliases, "alias string, id long, scope string")
    redirects, edges = spark.createDataFrame([], "id long, kind string, target long"), spark.createDataFrame([], "parent long, child long, relation string")
    golds, want = {}, {}
    for r in cases:
        golds.setdefault(r[0], set()).update(r[7])
        want.setdefault(r[0], set()).update(held(r[2].lower(), r[1] != "rare") if r[1] else ())
    got = {r["case_id"] for r in evaluation.benchmark_problems(c, terms, redirects, a, edges).where("rule = 'gold'").collect()}
    assert got == {k for k in golds if golds[k] != want[k]} and 0 < len(got) < len(golds)
    # a case's targets are listed only where they are no more than its golds
    gold = c.select("case_id", F.explode("gold_ids").alias("id")).distinct()
    more, rest = evaluation.crowded(c, gold, terms, a)
    listed = evaluation.benchmark_targets(rest, terms, redirects, a, edges)
    assert more.count() and listed.count() <= gold.count() < evaluation.benchmark_targets(c, terms, redirects, a, edges).count()


def test_whole_rankings_are_counted_without_listing_them(spark):
    rng = random.Random(9)
    words = ["red", "blue", "ring", "rod", "big ring", "in"]
    go = lambda i: f"GO:{i:07d}"
    terms = spark.createDataFrame([(go(i), f"{rng.choice(words)} {rng.choice(words)}", "d", i % 6 == 0) for i in range(200)], "id string, name string, definition string, obsolete boolean")
    synonyms = spark.createDataFrame([(go(i), rng.choice(words)) for i in range(0, 200, 2)], "id string, value string")
    # targets that aren't current are foreign to the corpus
    redirects = spark.createDataFrame([(go(6), "replaced_by", go(12)), (go(18), "consider", go(7)), (go(18), "consider", go(24)), (go(900), "alt_id", go(9))], "id string, kind string, target string")
    index = engine.build(terms, synonyms, redirects)
    texts = [go(7), go(6), go(18), go(900), go(999), "ring", " Red rod ", "", None, "big ring red", "none", "in"]
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "query_id long, query string")
    want = evaluation.permutation_problems(engine.symbolic(queries, index, None).withColumnRenamed("query_id", "case_id"), index.current)
    heads = engine.symbolic_heads(queries, index)
    got = evaluation.completed_problems(heads.withColumnRenamed("query_id", "case_id"), index.current)
    key = lambda df: sorted(tuple(r[c] for c in ("case_id", "n", "repeated", "foreign", "missing")) for r in df.collect())
    assert key(got) == key(want) and sum(r[3] for r in key(got)) == 4
    # classes of ids are as many as there are sets of texts
    _, classes = retrieval.text_classes(index.aliases)
    assert classes.agg(F.sum("size")).first()[0] == index.current.count() > classes.count()


def sent(df):
    """Joins of a plan, as it ran, whose one side was sent to all."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_building_an_index_sends_none_of_its_tables(spark):
    from quillon.plans import engine_queries

    tables = engine_queries._corpus_tables(spark, "/root/testdata/sf0.001")
    index = engine.build(*tables)
    assert [sent(df) for df in (*tables, index.aliases, index.grams, index.names, index.redirects, index.vectors)] == [0] * 9


def test_scores_are_added_up_by_classes_of_ids(spark, monkeypatch):
    rng = random.Random(10)
    words = ["Red", "blue", "ring", "rod", "big ring", "in", ""]
    aliases = [(i, f"{rng.choice(words)} {rng.choice(words)}".strip(), True) for i in range(300)] + [(i, rng.choice(words), rng.random() < 0.2) for i in range(300) for _ in range(rng.randrange(3))]
    a = spark.createDataFrame(aliases, "id long, alias string, is_name boolean")
    queries = spark.createDataFrame([(q,) for q in ("ring", " Red rod ", "", "big ring red", "none", "in", "RING")], "query string")
    want = {}
    for r in retrieval.lexical_scores(queries, a).collect():
        n, total = want.get(r["query"], (0, 0))
        want[r["query"]] = (n + 1, total + r["score"])
    met, plain = [], retrieval.lexical_scores
    monkeypatch.setattr(retrieval, "lexical_scores", lambda q, t: met.append(t.count()) or plain(q, t))
    got = {r["query"]: (r["n"], r["total"]) for r in retrieval.lexical_totals(queries, a).collect()}
    # queries meet each text once
    assert got == want and met == [len({(t.lower(), n) for _, t, n in aliases})] and met[0] < 100


def test_findings_evidence_sends_no_table_of_terms(spark):
    terms = spark.createDataFrame([(f"GO:{i:07d}", f"ring {i}", "d", i % 5 == 0) for i in range(50)], "id string, name string, definition string, obsolete boolean")
    redirects = spark.createDataFrame([("GO:0000005", "consider", "GO:0000006"), ("GO:0000090", "alt_id", "GO:0000007")], "id string, kind string, target string")
    asked = spark.createDataFrame([(f"GO:{i:07d}",) for i in (5, 10, 11, 90, 91)], "query string")
    found = retrieval.resolve(asked, terms, redirects)
    assert sent(found) == 0
    assert {(r["query"][-2:], r["kind"], *r["targets"]) for r in found.collect()} == {("05", "obsolete_consider", "GO:0000006"), ("10", "obsolete_unresolved"), ("11", "canonical", "GO:0000011"), ("90", "alternate", "GO:0000007"), ("91", "unknown_identifier")}
    assert sent(engine.describe(terms.select("id", F.lit(1).alias("rank")), terms)) == 0
