"""Exact order statistics by group, without a group in one task.

The value at a rank is found by narrowing: each round counts values by group and bucket of the interval that still holds
the wanted rank, and goes on with the bucket the rank falls into, from its least to its greatest value. The first buckets
are by sign and power of two, later ones cut an interval into BUCKETS equal parts, so that a few rounds suffice whatever
the distribution; an interval with one value, or with so few rows that they can be sorted, ends the search. A round is one
pass with counts summed before the shuffle, and what is kept of it is a row for each group and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import cut

BUCKETS, FEW, ROUNDS = 4096, 10_000, 80


def _power(v: str) -> Column:
    """A bucket that doesn't fall as the value rises: sign and power of two."""
    d = f"cast({v} as double)"
    size = f"cast(floor(log2(abs({d}))) as long)"
    return F.expr(f"case when isnan({d}) then 4000L when {d} > 0 then if({d} = double('infinity'), 3000L, {size} + 1100L) when {d} < 0 then if({d} = double('-infinity'), -3000L, -{size} - 1100L) else 0L end")


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: DataFrame, few: int = FEW) -> DataFrame:
    """by, rank, value: the value at each rank (from 1) among a group's values in order. ranks (by, rank), of ranks that the
    group has; nulls are no values, NaN comes last. A null in `by` is a group like others."""
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(value).alias("_v"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    wanted = ranks.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col("rank").cast("long").alias("rank")).distinct()
    counts = rows.groupBy(*keys, _power("_v").alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    open_, done = wanted.withColumn("before", F.lit(0).cast("long")).withColumn("_i", F.lit(0)), None
    for _ in range(ROUNDS):
        upto = F.sum("n").over(Window.partitionBy(*keys, *(["_lo"] if "_lo" in counts.columns else [])).orderBy("_b"))
        steps = counts.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
        on = same("o", "s") + ([F.col("o.lo").eqNullSafe(F.col("s._lo"))] if "_lo" in counts.columns else [])
        for c in on[1:]:
            on[0] = on[0] & c
        base = F.col("o.before") + F.col("s.from")
        hit = open_.alias("o").join(steps.alias("s"), (on[0] if on else F.lit(True)) & (F.col("o.rank") > base) & (F.col("o.rank") <= base + F.col("s.n")))
        found = cut(hit.select(*(F.col(f"o.{k}").alias(k) for k in keys), "o.rank", base.alias("before"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), F.col("s.n").alias("n")))
        single = (F.col("lo") == F.col("hi")) | F.isnan(F.col("lo").cast("double"))
        part = found.where(single).select(*keys, "rank", F.col("lo").alias("v"))
        done = part if done is None else done.unionByName(part)
        small = found.where(~single & (F.col("n") <= few))
        if small.take(1):
            done = done.unionByName(cut(_sorted(rows, small, keys)))
        open_ = found.where(~single & (F.col("n") > few))
        if not open_.take(1):
            break
        spans = open_.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
        inside = rows.alias("r").join(spans.alias("p"), [*same("r", "p"), F.col("r._v") >= F.col("p._lo"), F.col("r._v") <= F.col("p._hi")])
        share = "cast(r._v - p._lo as double) / cast(p._hi - p._lo as double)"
        inside = inside.select(*(F.col(f"r.{k}").alias(k) for k in keys), "r._v", "p._lo", F.expr(f"cast(floor(least({share}, 1d) * {BUCKETS}) as long)").alias("_b"))
        counts = inside.groupBy(*keys, "_lo", "_b").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    else:
        raise RuntimeError("ranks did not settle")
    return done.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), "rank", F.col("v").alias(value))


def _sorted(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks in intervals of few rows: those rows are numbered."""
    spans = small.select(*keys, "lo", "hi", "before").distinct()
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    inside = rows.alias("r").join(spans.alias("p"), [*on, F.col("r._v") >= F.col("p.lo"), F.col("r._v") <= F.col("p.hi")]).select(*(F.col(f"p.{k}").alias(k) for k in keys), "r._v", "p.lo", "p.before")
    turn = F.row_number().over(Window.partitionBy(*keys, "lo").orderBy("_v"))
    numbered = inside.withColumn("rank", F.col("before") + turn).select(*(F.col(k).alias(f"_n{k}") for k in keys), F.col("rank").alias("_nrank"), F.col("_v").alias("v"))
    match = [F.col(k).eqNullSafe(F.col(f"_n{k}")) for k in keys] + [F.col("rank") == F.col("_nrank")]
    return small.join(numbered, match).select(*keys, "rank", "v")


def sizes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n: how many values each group has, groups without any left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))


def picked(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, n and, for each name, the value at the rank that the expression (of n) gives."""
    n = cut(sizes(df, by, value))
    each = n.select(*by, "n", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()))).alias("w")).select(*by, "n", "w.*")
    got = at_ranks(df, by, value, each.select(*by, "rank"))
    same = [F.col(f"e.{b}").eqNullSafe(F.col(f"g.{b}")) for b in by] + [F.col("e.rank") == F.col("g.rank")]
    rows = each.alias("e").join(got.alias("g"), same)
    return rows.groupBy(*(F.col(f"e.{b}").alias(b) for b in by), F.col("e.n").alias("n")).agg(*(F.max(F.when(F.col("e.name") == name, F.col(f"g.{value}"))).alias(name) for name in ranks))


def interpolated(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name, the quantile at that share, linear between neighbours."""
    place = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in shares.items()}
    got = picked(df, by, value, {f"{name}_{side}": f(p) + 1 for name, p in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))})
    lo, hi = (lambda name, side=side: F.col(f"{name}_{side}").cast("double") for side in ("lo", "hi"))
    part = lambda name: place[name] - F.floor(place[name])
    return got.select(*by, *((lo(name) * (1 - part(name)) + hi(name) * part(name)).alias(name) for name in shares))
