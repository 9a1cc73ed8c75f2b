"""The retrieval engine: an index that is built once, and three ways to rank its terms for a batch of queries.

Identifiers never reach a ranking: a query that is one is resolved, its targets come first and the other current terms
follow by id. Lexical candidates come from equi-joins with the index's tables (whole aliases, n-grams, name words), so no
query meets all aliases. Queries are a table (query_id, query), with a column q (array) where vectors are asked for.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators import fusion, retrieval
from quillon.operators.blocks import in_blocks, numbered
from quillon.session import cut

MODES = ("symbolic", "vector", "hybrid")


@dataclass(frozen=True)
class Index:
    """terms (id, name, definition, obsolete); redirects (id, kind, target); aliases (alias_id, id, alias, is_name,
    tokens) of current terms in lower case; grams (gram, alias_id) of 1 to 3 characters; gram_counts (gram, n); names
    (token, id); order (id, pos), the place of each current id among them; vectors (id, v) of current terms.
    index_store keeps one on disk."""

    terms: DataFrame
    redirects: DataFrame
    aliases: DataFrame
    grams: DataFrame
    gram_counts: DataFrame | None
    names: DataFrame
    order: DataFrame | None = None
    vectors: DataFrame | None = None

    @property
    def current(self) -> DataFrame:
        return self.terms.where("not obsolete").select("id")

    def counted(self) -> Index:
        return replace(self, gram_counts=self.grams.groupBy("gram").agg(F.count("*").alias("n")))

    def ordered(self) -> Index:
        """With the places of the current ids; numbering them is a pass of its own, so it waits until they are asked for."""
        return self if self.order is not None else replace(self, order=numbered(self.current, [], [F.col("id")], "pos"))


def current_aliases(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Names and synonyms of the current terms (J1). synonyms (id, value). Joins of tables that grow with the terms are merge
    joins here and below: by their size on disk Spark would send tables to the driver that are many times as large there."""
    live = terms.where("not obsolete")
    return live.select("id", F.lower("name").alias("alias"), F.lit(True).alias("is_name")).union(synonyms.join(live.select("id").hint("merge"), "id").select("id", F.lower("value"), F.lit(False)))


def build(terms: DataFrame, synonyms: DataFrame, redirects: DataFrame, vectors: DataFrame | None = None) -> Index:
    """All tables of the index (R3). Redirects to terms that are not there are left out."""
    aliases = current_aliases(terms, synonyms).distinct().select(F.xxhash64("id", "alias", "is_name").alias("alias_id"), "*", T.tokens("alias").alias("tokens"))
    grams = aliases.select(F.explode(F.array_distinct(F.concat(*(T.ngrams("alias", n) for n in (1, 2, 3))))).alias("gram"), "alias_id")
    names = aliases.where("is_name").select(F.explode(T.words("alias")).alias("token"), "id")
    present = redirects.join(terms.select(F.col("id").alias("target")).hint("merge"), "target", "left_semi").select("id", "kind", "target")
    live = None if vectors is None else vectors.join(terms.where("not obsolete").select("id").hint("merge"), "id", "left_semi")
    return Index(terms, present, aliases, grams, None, names, None, live).counted()


def lexical(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, id, score (R2, U2): the union of three kinds of candidates, each by equality, and their highest score."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q")).withColumn("qw", T.words("q"))
    longest = index.aliases.agg(F.max(F.length("alias"))).first()[0] or 0
    inner = f"flatten(transform(sequence(1, greatest(length(q), 1)), i -> transform(sequence(1, least({longest or 1}, greatest(length(q) - i + 1, 1))), n -> substring(q, i, n))))"
    parts = q.select("*", F.explode(F.array_union(F.array("q"), F.expr(inner))).alias("alias"))
    within = parts.join(index.aliases, "alias").select("query_id", "q", "qw", "id", "alias", "is_name", "tokens")
    asked = q.where("q <> ''").select("query_id", F.explode(F.when(F.length("q") <= 3, F.array("q")).otherwise(F.array_distinct(T.ngrams("q", 3)))).alias("gram"))
    rarest = asked.join(index.gram_counts, "gram", "left").groupBy("query_id").agg(F.min_by("gram", "n").alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all")
    around = rarest.join(index.grams, "gram").join(index.aliases, "alias_id").join(q, "query_id").where("contains(alias, q)").select(*within.columns)
    score = F.when(F.col("alias") == F.col("q"), F.when(F.col("is_name"), 10000).otherwise(9000)).otherwise(100 + F.size(F.array_intersect("qw", "tokens")))
    near = within.where("alias = q or (alias <> '' and q <> '')").union(around).select("query_id", "id", score.cast("long").alias("score"))
    shared = q.select("query_id", F.explode("qw").alias("token")).join(index.names, "token").groupBy("query_id", "id").agg(F.count("*").alias("score"))
    return near.unionByName(shared).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def _texts(aliases: DataFrame, k: int) -> tuple[Index, DataFrame]:
    """An index of the distinct texts of aliases, names and others apart, and each text's first k ids (text, id)."""
    named = aliases.select("id", "alias", "is_name", "tokens")
    first = cut(retrieval.rank_by(named.withColumn("_s", F.lit(0)), ["alias", "is_name"], "_s", "id", k).select("id", "alias", "is_name", "tokens", "rank"))
    text = F.xxhash64("alias", "is_name").alias("text")
    return _text_index(first.where("rank = 1").select(text, "alias", "is_name", "tokens")), first.select(text, "id")


def _text_index(texts: DataFrame) -> Index:
    """An index of distinct texts (text, alias, is_name, tokens), which stand for their ids."""
    each = texts.select(F.col("text").alias("alias_id"), F.col("text").alias("id"), "alias", "is_name", "tokens")
    grams = each.select(F.explode(F.array_distinct(F.concat(*(T.ngrams("alias", n) for n in (1, 2, 3))))).alias("gram"), "alias_id")
    names = each.where("is_name").select(F.explode(T.words("alias")).alias("token"), "id")
    terms = each.select("id", F.lit(False).alias("obsolete"))
    return Index(terms, terms, each, grams, None, names).counted()


def lexical_top(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, id, score, rank: the first k by lexical() score and id. A score follows from the two texts, so distinct queries
    meet distinct aliases, each of which stands for its first k ids: whatever id is behind those in every text that gives
    it its score has k ids before it."""
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("q"))
    texts, first = _texts(index.aliases, k)
    scored = lexical(asked.select(F.col("q").alias("query_id"), F.col("q").alias("query")).distinct(), texts).withColumnRenamed("id", "text")
    best = scored.join(first, "text").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = retrieval.rank_by(best, "query_id", "score", "id", k).select(F.col("query_id").alias("q"), "id", "score", "rank")
    return asked.join(cut(ranked), "q").select("query_id", "id", "score", "rank")


def lexical_classes(queries: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """text, class, score: what lexical() gives each query (query_id, named text here) and class of ids with the same texts;
    and the classes' members (class, id). Queries meet distinct texts, and no id is listed for a query."""
    text = F.xxhash64("alias", "is_name").alias("text")
    own = index.aliases.select("id", text).groupBy("id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    own = cut(own.select("id", F.xxhash64("texts").alias("class"), "texts"))
    each = cut(index.aliases.select(text, "alias", "is_name").distinct().withColumn("tokens", T.tokens("alias")))
    held = own.select("class", "texts").distinct().select("class", F.explode("texts").alias("text"))
    hit = lexical(queries, _text_index(each)).withColumnRenamed("id", "text").join(held, "text")
    return hit.groupBy(F.col("query_id").alias("text"), "class").agg(F.max("score").alias("score")), own.select("class", "id")


def resolved(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, kind, targets of the queries that are identifiers."""
    ids = queries.select("query_id", T.canonical_id("query").alias("query")).where("query is not null")
    return ids.join(retrieval.resolve(ids.select("query").distinct(), index.terms, index.redirects).hint("merge"), "query").select("query_id", "kind", "targets")


def _split(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    is_id = T.canonical_id("query").isNotNull()
    return queries.where(is_id), queries.where(~is_id)


def _targets(queries: DataFrame, index: Index) -> DataFrame:
    return resolved(queries, index).select("query_id", F.posexplode("targets").alias("p", "id")).select("query_id", "id", (F.col("p") + 1).cast("long").alias("rank"))


def completed(head: DataFrame, index: Index, queries: DataFrame, k: int | None) -> DataFrame:
    """A head (query_id, id, rank) and then the other current ids ascending (U5); with k only the ids that can get so far."""
    as_query = lambda df: df.withColumnRenamed("query_id", "query")
    if k is not None:
        head = head.where(F.col("rank") <= k)
    # each is read several times, once for each block of queries
    corpus = index.current if k is None else cut(index.current.orderBy("id").limit(2 * k))
    head, asked = cut(as_query(head)), cut(as_query(queries.select("query_id")))
    full = retrieval.complete(head, corpus, asked).withColumnRenamed("query", "query_id")
    return full if k is None else full.where(F.col("rank") <= k)


def symbolic(queries: DataFrame, index: Index, k: int | None = 5) -> DataFrame:
    """query_id, id, rank."""
    ids, words = _split(queries)
    ranked = retrieval.rank_by(lexical(words, index), "query_id", "score", "id") if k is None else lexical_top(words, index, k)
    return completed(_targets(ids, index).unionByName(ranked.select("query_id", "id", "rank")), index, queries, k)


def symbolic_heads(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, n, ids, known: of the whole symbolic ranking of each query, what stands before the rest of the current ids
    (see completed): its length, its distinct ids and those of them that are current. Ids with the same texts are all
    found or none, so that distinct queries meet classes of ids, and no ranking is listed."""
    ids, words = _split(queries)
    found, current = _targets(ids, index), index.current.distinct().withColumn("live", F.lit(1))
    told = found.join(current.hint("merge"), "id", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(F.when(F.col("live").isNotNull(), F.col("id"))).alias("known"))
    texts, classes = retrieval.text_classes(index.aliases, current)
    classes = classes.select(F.col("texts").alias("class"), F.explode("texts").alias("text"), "size", "known")
    at = F.xxhash64("text.alias", "text.is_name")
    asked = words.select("query_id", F.lower(F.trim("query")).alias("q"))
    each = cut(texts.select(F.xxhash64("alias", "is_name").alias("text"), "alias", "is_name", T.tokens("alias").alias("tokens")))
    scored = lexical(asked.select(F.col("q").alias("query_id"), F.col("q").alias("query")).distinct(), _text_index(each)).select(F.col("query_id").alias("q"), F.col("id").alias("_text"))
    hit = scored.join(classes.withColumn("_text", at), "_text").select("q", "class", "size", "known").distinct()
    sums = cut(hit.groupBy("q").agg(F.sum("size").alias("n"), F.sum("known").alias("known")))
    said = asked.join(sums, "q").select("query_id", "n", F.col("n").alias("ids"), "known")
    none = F.lit(0).cast("long")
    every = queries.select("query_id").join(told.unionByName(said).hint("merge"), "query_id", "left")
    return every.select("query_id", *(F.coalesce(c, none).alias(c) for c in ("n", "ids", "known")))


def _unit(queries: DataFrame, *more: str) -> DataFrame:
    norm = F.greatest(F.sqrt(retrieval.dot(F.col("q"), F.col("q"))), F.lit(1e-12))
    return queries.withColumn("_n", norm).select("query_id", *more, F.transform("q", lambda x: x / F.col("_n")).alias("q"))


def by_vector(queries: DataFrame, index: Index, k: int | None = 5) -> DataFrame:
    """query_id, id, rank (R5): the query's vector is brought to unit length, the index's are as they are."""
    ids, rest = _split(queries)
    near = retrieval.cosine_topk(_unit(rest), index.vectors, k).select("query_id", "id", "rank")
    return completed(_targets(ids, index), index, ids, k).unionByName(near)


def hybrid(queries: DataFrame, index: Index, k: int | None = 5) -> DataFrame:
    """query_id, id, rank (R6): both rankings fused; with k, each is read only as deep as k needs (see fusion)."""
    ids, rest = _split(queries)
    if k is None:
        found = retrieval.reciprocal_rank_fusion([symbolic(rest, index, None), by_vector(rest, index, None)]).select("query_id", "id", "rank")
    else:
        # no alias holds a query without text
        asked = cut(_unit(rest.withColumn("text", F.coalesce(F.lower(F.trim("query")), F.lit("\0"))), "text"))
        texts = asked.select(F.col("text").alias("query_id"), F.col("text").alias("query")).distinct()
        found = fusion.fused(asked, *lexical_classes(texts, index), index.ordered().order, index.vectors, k)
    return completed(_targets(ids, index), index, ids, k).unionByName(found)


def retrieve(queries: DataFrame, index: Index, mode: str = "hybrid", k: int | None = 5) -> DataFrame:
    """R8."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    return {"symbolic": symbolic, "vector": by_vector, "hybrid": hybrid}[mode](queries, index, k)


def describe(ranked: DataFrame, terms: DataFrame, strict: bool = False) -> DataFrame:
    """Names and definitions of ranked ids; ranks stay what they are (J4). An id that isn't current is skipped, or with
    `strict` an error (J5)."""
    live = terms.where("not obsolete").select("id", "name", "definition")
    if strict and ranked.join(live.hint("merge"), "id", "left_anti").limit(1).count():
        raise ValueError("an id has no current term")
    return ranked.join(live.hint("merge"), "id")


def derived_queries(findings: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """finding_id, query by a fixed table of labels (P13); a label without a query is an error."""
    table = findings.sparkSession.createDataFrame(list(mapping.items()), "label string, query string")
    if findings.join(F.broadcast(table), "label", "left_anti").limit(1).count():
        raise ValueError("a label has no query")
    return findings.join(F.broadcast(table), "label").select("finding_id", "label", "query")


def retrieve_for_findings(findings: DataFrame, mapping: Mapping[str, str], index: Index, mode: str = "hybrid", k: int = 5) -> DataFrame:
    """finding_id, evidence_id, id, name, definition, rank (R13): each label's query is asked once; evidence is numbered
    E1.. without gaps, ranks are the ranking's. A finding that isn't confirmed or corrected is an error."""
    if findings.where("review_state is null or review_state not in ('confirmed', 'corrected')").limit(1).count():
        raise ValueError("a finding is not reviewed")
    asked = derived_queries(findings, mapping)
    queries = asked.select(F.col("label").alias("query_id"), "query").distinct()
    found = describe(retrieve(queries, index, mode, k), index.terms).withColumnRenamed("query_id", "label")
    # k rows for each label of the mapping
    rows = asked.join(F.broadcast(found), "label")
    n = F.row_number().over(Window.partitionBy("finding_id").orderBy("rank"))
    return rows.select("finding_id", F.concat(F.lit("E"), n).alias("evidence_id"), "id", "name", "definition", "rank")


def edited_evidence(machine: DataFrame, edits: DataFrame) -> DataFrame:
    """finding_id, evidence_id, id, origin, excluded after a log of edits (R14), which outlives any new machine ranking.
    machine (finding_id, evidence_id, id); edits (seq, finding_id, op, evidence_id, id): `add` makes M1.. of a finding in
    order, `exclude` and `include` set the flag of an evidence, the last one counts."""
    n = F.row_number().over(Window.partitionBy("finding_id").orderBy("seq"))
    added = edits.where("op = 'add'").select("finding_id", F.concat(F.lit("M"), n).alias("evidence_id"), "id", F.lit("human").alias("origin"))
    flags = edits.where("op in ('exclude', 'include')").groupBy("finding_id", "evidence_id").agg((F.max_by("op", "seq") == "exclude").alias("excluded"))
    every = machine.select("finding_id", "evidence_id", "id", F.lit("auto").alias("origin")).unionByName(added)
    return every.join(flags, ["finding_id", "evidence_id"], "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def unknown_edits(machine: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of evidence that isn't there."""
    known = edited_evidence(machine, edits).select("finding_id", "evidence_id")
    return edits.where("op in ('exclude', 'include')").join(known, ["finding_id", "evidence_id"], "left_anti")


def lookup(keys: DataFrame, values: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Rows of `keys` with their values, repeats and all (J8, J9); a key without a value is an error."""
    if strict and keys.join(values, key, "left_anti").limit(1).count():
        raise ValueError("a key has no value")
    return keys.join(values, key)


def grid(cases: DataFrame, modes: tuple[str, ...] = MODES, repeats: int = 1) -> DataFrame:
    """Every case with every mode and repeat (J12): the few modes are sent to the cases."""
    few = cases.sparkSession.createDataFrame([(m, r) for m in modes for r in range(1, repeats + 1)], "mode string, repeat int")
    return in_blocks(few, "mode", lambda block: cases.join(block))
