"""The index on disk, fusion that stops early, and what both must refuse."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import engine, fusion, index_store, retrieval
from quillon.sources import files

WORDS = ["cell", "growth", "blood", "old", "über", "gr", "division", "c", "tissue", "x1"]
TERM = "id string, name string, definition string, obsolete boolean"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def tables(spark, seed, ids, copies=3):
    rng = random.Random(seed)
    terms = [(f"GO:{i:07d}", " ".join(rng.choices(WORDS, k=rng.randint(1, 4))), f"d{i}", rng.random() < 0.15) for i in ids]
    synonyms = [(t[0], rng.choice(WORDS)) for t in terms if rng.random() < 0.5]
    redirects = [(f"GO:{9_000_000 + i:07d}", "alt_id", f"GO:{i:07d}") for i in ids if i % 7 == 0] + [(t[0], "replaced_by", f"GO:{rng.choice(ids):07d}") for t in terms if t[3]]
    pool = [[rng.randint(-3, 3) / 2 for _ in range(4)] for _ in range(max(1, len(ids) // copies))]  # equal vectors: ties
    vectors = [(t[0], rng.choice(pool)) for t in terms if rng.random() < 0.95]
    return (
        spark.createDataFrame(terms, TERM), spark.createDataFrame(synonyms, "id string, value string"), spark.createDataFrame(redirects, "id string, kind string, target string"),
        spark.createDataFrame(vectors, "id string, v array<double>"),
    )


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(1)
    texts = ["cell", "", "growth blood", "nothing like it", "c", "gr", "über tissue cell growth", "GO:0000007", "go:9000007", "GO:7777777", "old old", " x1 "]
    return spark.createDataFrame([(i, t, [rng.randint(-3, 3) / 2 for _ in range(4)]) for i, t in enumerate(texts)], "query_id int, query string, q array<double>")


def fused_whole(queries, index):
    return engine.hybrid(queries, index, None)


def test_early_fusion_equals_the_whole_one(spark, asked):
    # more ids than any depth, fewer, and so few that both lists end; and the depth is what it says
    for n, ks in ((400, (10,)), (40, (5,))):
        index = engine.build(*tables(spark, n, list(range(1, n + 1)))).ordered()
        full = fused_whole(asked, index).cache()
        for k in ks:
            assert rows(engine.hybrid(asked, index, k), "query_id", "rank", "id") == rows(full.where(F.col("rank") <= k), "query_id", "rank", "id")
    for k in (1, 5, 100):
        assert 2 / (60 + fusion.depth(k) + 1) < 1 / (60 + k)


def test_vector_ranks(spark, asked):
    index = engine.build(*tables(spark, 3, list(range(1, 200))))
    whole = retrieval.cosine_topk(asked.select("query_id", "q"), index.vectors, None).select("query_id", "id", F.col("rank").alias("vrank"))
    probes = whole.where("vrank % 13 = 0").select("query_id", "id")
    got = rows(fusion.vector_ranks(asked, index.vectors.repartition(5), probes, 20, at_once=300))
    assert got == rows(whole.where("vrank <= 20 or vrank % 13 = 0"))
    # what leaves the tasks doesn't grow with the corpus: first rows and probes of each task and query
    assert fusion.vector_ranks(asked.limit(0), index.vectors, probes.limit(0), 5).count() == 0


def same_rankings(a, b, asked, modes=("symbolic",)):
    for mode in modes:
        assert rows(engine.retrieve(asked, a, mode, 8), "query_id", "rank", "id") == rows(engine.retrieve(asked, b, mode, 8), "query_id", "rank", "id")
    assert rows(engine.resolved(asked, a)) == rows(engine.resolved(asked, b))


def merged_tables(spark, old, new, gone):
    """What a fresh build would take after an update."""
    touched = new[0].select("id").union(new[2].select("id")).union(gone.select("id")).distinct()
    return tuple(o.join(touched, "id", "left_anti").select(*n.columns).union(n) for o, n in zip(old, new, strict=True))


def test_updates_equal_a_fresh_build(spark, asked, tmp_path):
    path = f"{tmp_path}/index"
    base = tables(spark, 5, list(range(1, 120)))
    assert index_store.create(path, "s1", *base, buckets=3) == 1
    same_rankings(index_store.load(spark, path, "s1"), engine.build(*base), asked)
    with pytest.raises(FileExistsError):
        index_store.create(path, "s1", *base)
    # new terms, changed ones, and some withdrawn
    delta = tables(spark, 6, [*range(100, 140), 7])
    gone = spark.createDataFrame([(f"GO:{i:07d}",) for i in (3, 4, 50, 139)], "id string")
    new = tuple(d.join(gone, "id", "left_anti").select(*d.columns) for d in delta)
    assert index_store.update(path, "s2", *new, withdrawn=gone) == 2
    fresh = merged_tables(spark, base, new, gone)
    now = index_store.load(spark, path, "s2")
    same_rankings(now, engine.build(*fresh), asked, ("symbolic", "vector"))
    assert now.terms.where("id in ('GO:0000003', 'GO:0000050')").count() == 0
    # the version before is still what it was; a compacted one says the same as the merged one
    same_rankings(index_store.load(spark, path, version=1), engine.build(*base), asked)
    assert index_store.compact(spark, path) == 3
    same_rankings(index_store.load(spark, path, "s2"), engine.build(*fresh), asked)
    assert len(index_store.manifest(spark, path)["segments"]) == 1
    index_store.sweep(spark, path, keep=1)
    assert index_store.versions(spark, path) == [3] and len([n for n in files.children(spark, path) if n.startswith("seg-")]) == 1
    same_rankings(index_store.load(spark, path, "s2"), engine.build(*fresh), asked)


def test_a_stale_index_is_refused(spark, tmp_path):
    path, source = f"{tmp_path}/index", f"{tmp_path}/terms"
    base = tables(spark, 8, list(range(1, 30)))
    base[0].write.parquet(source)
    digest = files.source_digest(spark, [source])
    index_store.create(path, digest, *base, buckets=2)
    index_store.load(spark, path, files.source_digest(spark, [source]))
    base[0].limit(1).write.mode("append").parquet(source)
    with pytest.raises(index_store.StaleIndex):
        index_store.load(spark, path, files.source_digest(spark, [source]))
    # a file of a segment is lost, or one was slipped in
    segment = index_store.manifest(spark, path)["segments"][0]["name"]
    base[0].limit(1).coalesce(1).write.mode("append").parquet(f"{path}/{segment}/names")
    with pytest.raises(index_store.StaleIndex):
        index_store.load(spark, path, digest)
    with pytest.raises(FileNotFoundError):
        index_store.load(spark, f"{tmp_path}/none")


def test_opened_builds_once_for_a_source(spark, tmp_path):
    source, made = f"{tmp_path}/terms", []
    base = tables(spark, 9, list(range(1, 20)))
    base[0].write.parquet(source)

    def make():
        made.append(1)
        return base

    for _ in range(3):
        index_store.opened(spark, f"{tmp_path}/store", [source], make)
    assert len(made) == 1
    base[0].limit(1).write.mode("append").parquet(source)
    index_store.opened(spark, f"{tmp_path}/store", [source], make)
    assert len(made) == 2


def test_the_index_side_of_a_join_is_not_shuffled(spark, tmp_path):
    path = f"{tmp_path}/index"
    index_store.create(path, "s", *tables(spark, 2, list(range(1, 50))), buckets=4)
    index = index_store.load(spark, path)
    keys = spark.createDataFrame([("cell",)], "token string").hint("shuffle_hash")
    plan = index.names.join(keys, "token")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in plan
