"""Audits: each returns the rows that break a rule, or counts of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.blocks import in_blocks


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def coverage(df: DataFrame, index: str, expected: int) -> DataFrame:
    """missing, duplicated, foreign: how a row index differs from 0 .. expected - 1."""
    counts = df.groupBy(F.col(index).cast("long").alias("i")).agg(F.count("*").alias("n"))
    inside = (F.col("i") >= 0) & (F.col("i") < expected)
    t = counts.agg(F.count_if(inside).alias("have"), F.count_if(inside & (F.col("n") > 1)).alias("duplicated"), F.count_if(~inside | F.col("i").isNull()).alias("foreign"))
    return t.select((F.lit(expected) - F.col("have")).cast("long").alias("missing"), "duplicated", "foreign")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def content_groups(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """sha, first_id, n of texts that occur more than once (G19); a group is counted, not collected."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("sha")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).where("n > 1")


def first_occurrence_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, first_id: every later row with the first row of its hash."""
    rows = df.select(F.col(id_col).alias("id"), F.sha2(F.col(text), 256).alias("sha"))
    return rows.join(rows.groupBy("sha").agg(F.min("id").alias("first_id")), "sha").where("id <> first_id").select("id", "first_id")


def split_overlap(df: DataFrame, split: str, content: str) -> DataFrame:
    """Contents that occur in several splits."""
    return df.groupBy(content).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def manifest_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """name, problem: missing, unexpected or changed files by digest."""
    both = actual.select("name", F.col("sha256").alias("a")).join(expected.select("name", F.col("sha256").alias("e")), "name", "full")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def embedding_quality(df: DataFrame, vector: str, width: int, tolerance: float = 2e-5) -> DataFrame:
    """One row of counts: wrong width, not finite, zero, not of unit length, repeated (A5, K7)."""
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    t = df.agg(F.count("*").alias("n"), F.count_if(F.size(v) != width).alias("wrong_width"), F.count_if(bad).alias("not_finite"), F.count_if(F.forall(v, lambda x: x == 0)).alias("zero"), F.count_if(F.abs(norm - 1) > tolerance).alias("not_unit"))
    distinct = df.select(F.xxhash64(v).alias("h")).agg(F.count_distinct("h").alias("d"))
    return t.join(distinct).select("n", "wrong_width", "not_finite", "zero", "not_unit", (F.col("n") - F.col("d")).alias("repeated"))


def ungrounded(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (claim_id, text, cited array) with what they cite or mention outside the evidence."""
    asked = claims.select("claim_id", F.explode(F.array_distinct(F.concat("cited", F.regexp_extract_all("text", F.lit(r"GO:[0-9]{7}"), F.lit(0))))).alias("evidence_id"))
    return asked.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti").groupBy("claim_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("unknown"))


def case_scores(cases: DataFrame) -> DataFrame:
    """Recall over required strings (1 without any), forbidden hits, pass.
    cases(case_id, text, required array, forbidden array)."""
    text = F.lower("text")
    found = F.size(F.filter("required", lambda s: F.contains(text, F.lower(s))))
    hits = F.size(F.filter("forbidden", lambda s: F.contains(text, F.lower(s))))
    recall = F.when(F.size("required") == 0, 1.0).otherwise(found / F.size("required"))
    return cases.select("case_id", F.round(recall, 6).alias("recall"), hits.cast("long").alias("forbidden_hits"), ((recall == 1.0) & (hits == 0)).alias("passed"))


def containing(docs: DataFrame, text: str, items: DataFrame, item: str, words: int = 4) -> DataFrame:
    """Pairs of rows whose text contains the item as it is. Candidates share the item's run of `words` whole words from its
    second on (the first may end another word), by equality; an item too short for that is compared with every text.

    What is taken apart are the texts' runs, each with its text's hash; whole texts meet only the items they may hold.
    """
    run = lambda c, lo: F.array_join(F.slice(c, lo, words), " ")
    asked = items.withColumn("_w", F.split(item, " "))
    long = asked.where(F.size("_w") >= words + 2).withColumn("_k", F.xxhash64(run(F.col("_w"), 2))).drop("_w")
    hashed = docs.withColumn("_h", F.xxhash64(text))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - words + 1, F.lit(1))), lambda i: F.xxhash64(run(F.col("_w"), i)))
    keys = hashed.select("_h", F.split(text, " ").alias("_w")).select("_h", F.explode(F.array_distinct(runs)).alias("_k"))
    met = keys.join(long, "_k").drop("_k").distinct()
    out = hashed.join(met, "_h").drop("_h").where(F.contains(text, F.col(item)))
    short = asked.where(F.size("_w") < words + 2).drop("_w")
    return out.unionByName(in_blocks(short, item, lambda block: docs.join(block, F.contains(text, F.col(item)))).select(*out.columns))


def relation_counts(edges: DataFrame) -> DataFrame:
    """relation, n, parents (G1)."""
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("parent").alias("parents"))


def constant_columns(df: DataFrame, vector: str) -> DataFrame:
    """position of the numbers that are the same in all vectors (A5)."""
    each = df.select(F.posexplode(vector).alias("position", "x"))
    return each.groupBy("position").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo = hi").select("position")


def embedding_problems(df: DataFrame, vector: str, width: int, source: DataFrame, index: str, label: str, classes: int | None = None) -> DataFrame:
    """problem, n of a set of embeddings (A5): vectors as in embedding_quality, constant columns, rows whose label isn't the
    source's, rows that only one of both has, and how far the source's classes are from the stated number."""
    quality = embedding_quality(df, vector, width)
    each = F.array(*(F.struct(F.lit(c.replace("_", " ")).alias("problem"), F.col(c).cast("long").alias("n")) for c in ("wrong_width", "not_finite", "zero", "repeated")))
    parts = [quality.select(F.explode(each).alias("e")).select("e.*")]
    parts.append(constant_columns(df, vector).agg(F.lit("constant column").alias("problem"), F.count("*").alias("n")))
    both = df.select(index, F.col(label).alias("_a"), F.lit(1).alias("_x")).join(source.select(index, F.col(label).alias("_b"), F.lit(1).alias("_y")), index, "full")
    one = F.col("_x").isNull() | F.col("_y").isNull()
    parts.append(both.agg(F.lit("label").alias("problem"), F.count_if(~one & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n")))
    parts.append(both.agg(F.lit("not in both").alias("problem"), F.count_if(one).alias("n")))
    if classes is not None:
        parts.append(source.agg(F.lit("classes").alias("problem"), F.abs(F.count_distinct(label) - classes).alias("n")))
    return reduce(DataFrame.unionByName, parts)


# ---- trees of digests -------------------------------------------------------------------------------------------------
#: Bits of a row's place in a tree, by level: each node has 16 children.
LEVELS = (4, 8, 12, 16)


def placed(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with their place (the highest bits of a hash of the key) and their own digest."""
    place = F.shiftrightunsigned(F.xxhash64(*key), 64 - LEVELS[-1]).cast("int")
    return df.withColumns({"_place": place, "_digest": F.xxhash64(*sorted(df.columns))})


def digest_tree(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """level, node, n, digest: of the rows below each node how many and the sum of their digests, so that a level follows
    from the one below it and a tree of a part can be added to that of another (A11). It has at most 70,000 rows."""
    leaves = placed(df, key).groupBy(F.col("_place").alias("node")).agg(F.count("*").alias("n"), F.sum(F.col("_digest").cast("decimal(38,0)")).alias("digest"))
    up = F.explode(F.array(*(F.struct(F.lit(bits).alias("level"), F.shiftright("node", LEVELS[-1] - bits).alias("at")) for bits in LEVELS)))
    return leaves.select(up.alias("u"), "n", "digest").groupBy("u.level", F.col("u.at").alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))


def merged_trees(trees: Sequence[DataFrame]) -> DataFrame:
    """The tree of all rows, from those of parts that share none: no row is read again."""
    return reduce(DataFrame.unionByName, trees).groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """node of the lowest level where two trees differ. Only children of nodes that differ are compared."""
    at = lambda t, bits, name: t.where(F.col("level") == bits).select("node", F.struct("n", "digest").alias(name))
    open_ = None
    for bits in LEVELS:
        left, right = at(a, bits, "x"), at(b, bits, "y")
        if open_ is not None:
            below = open_.withColumnRenamed("node", "_up")
            left, right = (t.join(F.broadcast(below), F.shiftright("node", 4) == F.col("_up"), "left_semi") for t in (left, right))
        open_ = left.join(right, "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
    return open_


def row_differences(actual: DataFrame, expected: DataFrame, key: Sequence[str], expected_tree: DataFrame | None = None) -> DataFrame:
    """key, problem: missing, unexpected or changed rows (X22, X25), of those leaves alone whose digests differ. With the
    tree that was kept of the expected rows, these are read only where the tree says so."""
    nodes = differing(digest_tree(actual, key), expected_tree if expected_tree is not None else digest_tree(expected, key))
    leaf = nodes.withColumnRenamed("node", "_place")
    a, e = (placed(df, key).join(F.broadcast(leaf), "_place", "left_semi") for df in (actual, expected))
    # repeated rows of a key are one: their number and the sum of their digests
    one = lambda df, name: df.groupBy(*key).agg(F.struct(F.count("*"), F.sum(F.col("_digest").cast("decimal(38,0)"))).alias(name))
    both = one(a, "_x").join(one(e, "_y"), list(key), "full")
    problem = F.when(F.col("_x").isNull(), "missing").when(F.col("_y").isNull(), "unexpected").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return both.select(*key, problem.alias("problem")).where("problem is not null")


def preflight(checks: Mapping[str, DataFrame]) -> DataFrame:
    """check, problem, n, passed (X18): one row for each check, from tables of problems (problem, n) or of rows that break a
    rule (counted); a check without a problem has one row that says so."""
    parts = []
    for name, df in checks.items():
        counted = df.select(F.col("problem").cast("string").alias("problem"), F.col("n").cast("long").alias("n")).where("n > 0") if "n" in df.columns and "problem" in df.columns else df.groupBy((F.col("problem") if "problem" in df.columns else F.lit("row")).alias("problem")).agg(F.count("*").alias("n"))
        parts.append(counted.withColumn("check", F.lit(name)))
    found = reduce(DataFrame.unionByName, parts)
    every = found.sparkSession.createDataFrame([(name,) for name in checks], "check string")
    return every.join(found, "check", "left").select("check", "problem", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNull().alias("passed"))
