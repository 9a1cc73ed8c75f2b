"""Retrieval over terms and vectors: identifier resolution, lexical and cosine ranking, fusion, graph walks, metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators.blocks import in_blocks
from quillon.session import cut


#: Cosines that a task holds at once.
CELLS = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosines(asked: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Dot products, added up dimension by dimension as dot() does, so that both give the same bits."""
    out = np.zeros((len(asked), len(vectors)))
    by_dimension = np.ascontiguousarray(vectors.T)
    for j, column in enumerate(by_dimension):
        out += asked[:, j, None] * column
    return out


def rank_by(df: DataFrame, key: str | list[str], score: str, tie: str, k: int | None = None) -> DataFrame:
    """Adds rank from 1 by falling score, ties by id; with k, a limit that Spark applies before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))).cast("long"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


class _Best:
    """Of one task: each query's first k rows so far, by falling cosine and then by id."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k, self.columns = asked, k, np.ascontiguousarray(asked.T)
        self.slack = asked.shape[1] * 1e-15 * np.linalg.norm(asked, axis=1)
        self.least = np.full(len(asked), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        # a matrix product tells which may be among the first; their cosines are those of cosines()
        near = self.asked @ vectors.T
        slack = self.slack * np.linalg.norm(vectors, axis=1).max(initial=0.0)
        floor = self.least
        if len(ids) > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(near, len(ids) - self.k, 1)[:, len(ids) - self.k] - slack)
        q, e = np.nonzero(near >= (floor - slack)[:, None])
        if not len(q):
            return
        score = np.zeros(len(q))
        for a, v in zip(self.columns, np.ascontiguousarray(vectors.T), strict=True):
            score += a[q] * v[e]
        keep = score >= self.least[q]
        self.held.append((q[keep], score[keep], ids[e[keep]]))
        self.n += int(keep.sum())
        if self.n > 2 * self.k * len(self.asked):
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.held:
            return None
        q, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.least[q[place == self.k - 1]] = score[place == self.k - 1]
        keep = place < self.k
        self.held, self.n = [(q[keep], score[keep], ids[keep])], int(keep.sum())
        return self.held[0]


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int | None = 5, at_once: int = 4 << 20) -> DataFrame:
    """query_id, id, score, rank. queries(query_id, q), corpus(id, v): unit vectors of one length. The queries are the
    small, stated side: they are sent in blocks of at most `at_once` bytes. The corpus stays where it is and is met in
    steps of at most CELLS cosines; of each task only a query's first k move."""
    spark = queries.sparkSession
    kind = {c.name: c.dataType.simpleString() for c in (queries.schema["query_id"], corpus.schema["id"])}
    arrow_type, id_type = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(corpus.schema["id"].dataType)
    rows = corpus.select("id", F.col("v").cast("array<double>").alias("v")).coalesce(2 * spark.sparkContext.defaultParallelism)

    def one(names: list, asked: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((names, np.array(asked, float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = pa.array(sent.value[0], arrow_type), sent.value[1]
            best, step = _Best(asked, k or 0), max(1, CELLS // len(asked))

            def found(q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids.tolist(), id_type), pa.array(score)], ["query_id", "id", "score"])

            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    ids = np.array(part.column("id").to_pylist())
                    vectors = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                    if k is None:
                        q, e = np.divmod(np.arange(len(asked) * len(ids)), len(ids))
                        yield found(q, cosines(asked, vectors).ravel(), ids[e])
                    else:
                        best.add(ids, vectors)
            if (last := best.shrink()) is not None:
                for at in range(0, len(last[0]), 100_000):
                    yield found(*(x[at : at + 100_000] for x in last))

        return rows.mapInArrow(run, f"query_id {kind['query_id']}, id {kind['id']}, score double")

    parts, names, asked = [], [], []
    for row in queries.select("query_id", F.col("q").cast("array<double>")).toLocalIterator():
        names.append(row[0])
        asked.append(row[1])
        if 8 * len(row[1]) * len(asked) >= at_once:
            parts.append(one(names, asked))
            names, asked = [], []
    if names or not parts:
        parts.append(one(names, asked) if names else spark.createDataFrame([], f"query_id {kind['query_id']}, id {kind['id']}, score double"))
    return rank_by(reduce(DataFrame.unionAll, parts), "query_id", "score", "id", k)


def resolve(queries: DataFrame, terms: DataFrame, redirects: DataFrame) -> DataFrame:
    """query, kind, targets: the first of current id, alternate, replaced_by, consider, obsolete without target, unknown.
    terms(id, obsolete), redirects(id, kind, target). The joins are merge joins, as any side may be large."""
    at = lambda n, kind: (F.lit(n).alias("p"), F.lit(kind).alias("kind"))
    nothing = F.lit(None).cast(terms.schema["id"].dataType).alias("target")
    current = queries.join(terms.where("not obsolete").hint("merge"), queries.query == terms.id).select("query", *at(0, "canonical"), F.col("id").alias("target"))
    found = [current]
    for n, (kind, name) in enumerate((("alt_id", "alternate"), ("replaced_by", "obsolete_replaced_by"), ("consider", "obsolete_consider")), 1):
        r = redirects.where(F.col("kind") == kind).select(F.col("id").alias("query"), "target")
        found.append(queries.join(r.hint("merge"), "query").select("query", *at(n, name), "target"))
    found.append(queries.join(terms.where("obsolete").hint("merge"), queries.query == terms.id).select("query", *at(4, "obsolete_unresolved"), nothing))
    found.append(queries.select("query", *at(5, "unknown_identifier"), nothing))
    every = reduce(DataFrame.unionByName, found)
    first = every.groupBy("query").agg(F.min(F.struct("p", "kind")).alias("m"))
    return every.join(first.hint("merge"), "query").where("p = m.p").groupBy("query", "kind").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def lexical_scores(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query, id, score (R2). aliases(id, alias, is_name). Exact names 10000, synonyms 9000; else containment either way
    100 and the query's words among the alias's tokens; and the words a query shares with the name. The queries are the
    small, stated side; every alias is looked at. engine.lexical gives the same from an index."""
    q = queries.select("query", F.lower(F.trim("query")).alias("q")).withColumn("qw", T.words("q"))
    a = aliases.select("id", "is_name", F.lower("alias").alias("a")).withColumns({"aw": T.words("a"), "at": T.tokens("a")})
    exact = F.col("a") == F.col("q")
    near = (F.length("q") > 0) & (F.contains("a", F.col("q")) | F.contains("q", F.col("a")))
    by_alias = F.when(exact & F.col("is_name"), 10000).when(exact, 9000).when(near, 100 + F.size(F.array_intersect("qw", "at")))
    shared = F.when(F.col("is_name"), F.size(F.array_intersect("qw", "aw")))
    score = F.greatest(by_alias, F.when(shared > 0, shared))
    one = lambda block: a.join(block).select("query", "id", score.alias("score")).where("score is not null")
    return in_blocks(q, "query", one).groupBy("query", "id").agg(F.max("score").cast("long").alias("score"))


def text_classes(aliases: DataFrame, corpus: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (alias, is_name) of aliases (id, alias, is_name), and classes of ids that have the same texts:
    texts (an array of them), size, and with a corpus (id, live) the number known of those that it has."""
    own = aliases.select("id", F.struct("alias", "is_name").alias("text")).repartition("id").groupBy("id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    if corpus is not None:
        own = own.join(corpus.hint("merge"), "id", "left")
    classes = cut(own.groupBy("texts").agg(F.count("*").alias("size"), *([] if corpus is None else [F.count("live").alias("known")])))
    return classes.select(F.explode("texts").alias("text")).distinct().select("text.alias", "text.is_name"), classes


def lexical_totals(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query, n, total: how many ids lexical_scores() finds for each query, and the sum of their scores. Every distinct text is
    looked at; ids that have the same texts have the same scores and are counted together."""
    texts, classes = text_classes(aliases.select("id", F.lower("alias").alias("alias"), "is_name"))
    scored = lexical_scores(queries, texts.select(F.struct("alias", "is_name").alias("id"), "alias", "is_name")).withColumnRenamed("id", "text")
    of_class = classes.select("texts", "size", F.explode("texts").alias("text"))
    best = scored.join(of_class, "text").groupBy("query", "texts", "size").agg(F.max("score").alias("score"))
    return best.groupBy("query").agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("score")).alias("total"))


def ngram_candidates(queries: DataFrame, aliases: DataFrame, n: int = 3) -> DataFrame:
    """query, id: aliases that hold all of a query's n-grams (U1), by postings."""
    grams = lambda df, key, text: df.select(key, F.explode(F.array_distinct(T.ngrams(text, n))).alias("gram"))
    posted = grams(aliases.select("id", F.lower("alias").alias("a")), "id", "a").distinct()
    asked = grams(queries.select("query", F.lower(F.trim("query")).alias("q")), "query", "q")
    need = asked.groupBy("query").agg(F.count("*").alias("need"))
    return posted.join(asked, "gram").groupBy("query", "id").agg(F.count("*").alias("have")).join(need, "query").where("have = need").select("query", "id")


def reciprocal_rank_fusion(rankings: list[DataFrame], constant: int = 60) -> DataFrame:
    """query_id, id, score, rank over full rankings (query_id, id, rank), ranks from 1."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", "id", "rank") for r in rankings])
    fused = every.groupBy("query_id", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return rank_by(fused.withColumn("score", F.round("score", 12)), "query_id", "score", "id")


def complete(head: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """A head ranking (query, id, rank) and then all other ids ascending (U5): each query gets the whole corpus."""
    tail = in_blocks(queries.select("query"), "query", lambda block: corpus.select("id").join(block)).join(head, ["query", "id"], "left_anti")
    n = queries.select("query").join(head.groupBy("query").agg(F.max("rank").alias("n")), "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"))
    tail = tail.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("id"))).join(n, "query").select("query", "id", (F.col("r") + F.col("n")).cast("long").alias("rank"))
    return head.select("query", "id", "rank").unionByName(tail)


def walk(edges: DataFrame, start: DataFrame, direction: str = "descendants", depth: int = 10, relations: tuple[str, ...] = ("is_a", "part_of")) -> DataFrame:
    """start, node, depth: nodes within so many steps, each once at its least depth, without the start.
    edges(parent, child, relation), start(start). A frontier at a time, checkpointed, so that paths
    aren't enumerated and plans stay small."""
    allowed = [r for r in relations if r in ("is_a", "part_of")]
    if depth < 0 or direction not in ("ancestors", "descendants"):
        raise ValueError("depth or direction")
    a, b = ("parent", "child") if direction == "descendants" else ("child", "parent")
    steps = edges.where(F.col("relation").isin(allowed)).select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    frontier = start.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    seen = frontier
    for d in range(1, depth + 1 if allowed else 1):
        frontier = cut(frontier.join(steps, "node").select("start", F.col("next").alias("node"), F.lit(d).alias("depth")).distinct().join(seen, ["start", "node"], "left_anti"))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0").select("start", "node", "depth")


def retrieval_metrics(rankings: DataFrame, gold: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """case_id, n_gold, first_rank, recall, mrr (R10): 0 for cases without gold or without a hit."""
    hits = rankings.join(gold, ["case_id", "id"]).groupBy("case_id").agg(F.min("rank").alias("first_rank"), F.count_if(F.col("rank") <= k).alias("hits"))
    n = gold.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    every = cases.select("case_id").join(n, "case_id", "left").join(hits, "case_id", "left")
    n_gold, hit = F.coalesce("n_gold", F.lit(0)), F.coalesce("hits", F.lit(0))
    return every.select("case_id", n_gold.cast("long").alias("n_gold"), F.col("first_rank").cast("long").alias("first_rank"), F.round(F.when(n_gold > 0, hit / n_gold).otherwise(0.0), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"))
