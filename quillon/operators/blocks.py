"""A small stated side against a large one, in blocks whose broadcast size is bounded; prefix scans by key and range."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import cut

#: Rows of the small side that are sent to the executors at once.
AT_ONCE = 20_000


def in_blocks(small: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], at_once: int = AT_ONCE) -> DataFrame:
    """The union of work(broadcast block) over blocks of the small side, dealt by a hash of its key. The rows are counted
    first; one block is the usual case."""
    n = small.count()
    blocks = max(1, -(-n // at_once))
    parts = [small if blocks == 1 else small.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, [work(F.broadcast(part)) for part in parts])


def running_sums(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds for each value its sum over all rows before, in order. Rows are dealt to ranges, and each range starts with what
    the ones before hold, so that no task sees all rows. The ranges come from a sample and are cut off, as they must not
    change between the two passes. Rows that are equal in order are before each other in any order."""
    part = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    before = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = cut(part.withColumns({n: F.coalesce(F.sum(v).over(before), F.lit(0)) for n, v in values.items()} | {f"_v_{n}": v for n, v in values.items()}))
    totals = part.groupBy("_p").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    # a row for each range
    at = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_p", *(F.coalesce(F.sum(f"_s_{n}").over(at), F.lit(0)).alias(f"_s_{n}") for n in values))
    full = part.join(F.broadcast(starts), "_p")
    return full.withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in values}).drop("_p", *(f"_{k}_{n}" for k in "vs" for n in values))


#: How a scan puts two neighbouring stretches together: the aggregate over rows, and the one over stretches' totals.
MONOIDS = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "max": (F.max, F.max), "min": (F.min, F.min)}


def scan(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column]], keep: list[str] | None = None) -> DataFrame:
    """Adds for each name the sum, count, max or min (MONOIDS) over its key's rows so far, in order, the row's own included.
    With `keep`, only those of the other columns stay, and no more is written.

    Rows are dealt to ranges of (keys, order), so that a key with any share of the rows is in many tasks; each range is
    scanned by itself, and a key that began in an earlier range takes up what that holds (a carry for at most one key of
    each range, so that the carries can be sent to all). Falling order gives reversed scans. Rows that are equal in keys
    and order come in any order; nulls are a key, and add nothing as values. The ranges come from a sample and are cut
    off, as they must not change between the passes.
    """
    part = df.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("_p", F.spark_partition_id())
    so_far = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = ["*"] if keep is None else ["_p", *keys, *keep, *values, *(f"_v_{n}" for n in values)]
    part = cut(part.withColumns({n: MONOIDS[kind][0](v).over(so_far) for n, (kind, v) in values.items()} | {f"_v_{n}": v for n, (_, v) in values.items()}).select(*carried))
    totals = part.groupBy("_p", *keys).agg(*(MONOIDS[kind][0](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in values.items()), F.lit(1).alias("_one"))
    at = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select("_p", *keys, F.count("_one").over(at).alias("_before"), *(MONOIDS[kind][1](f"_t_{n}").over(at).alias(f"_c_{n}") for n, (kind, _) in values.items())).where("_before > 0")
    carries = carries.select(F.col("_p").alias("_cp"), *(F.col(k).alias(f"_k_{k}") for k in keys), *(f"_c_{n}" for n in values))
    same = F.col("_p") == F.col("_cp")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    full = part.join(F.broadcast(carries), same, "left")

    def joined(name: str, kind: str) -> Column:
        own, carry = F.col(name), F.col(f"_c_{name}")
        if kind in ("max", "min"):
            return (F.greatest if kind == "max" else F.least)(own, carry)
        return F.coalesce(own + carry, own, carry)

    return full.withColumns({n: joined(n, kind) for n, (kind, _) in values.items()}).drop("_p", "_cp", *(f"_k_{k}" for k in keys), *(f"_{x}_{n}" for x in "vc" for n in values))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "k") -> DataFrame:
    """Adds each row's place among its key's rows, from 1, by a scan."""
    return scan(df, keys, order, {name: ("count", F.lit(1))})
