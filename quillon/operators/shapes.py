"""Shapes of instances, from tables of their pixels: outline, hull, axes.

A table of pixels has the keys of an instance and y, x; what is counted about a pixel's neighbours is counted by votes: each
pixel sends a row to each place beside it, and places sum what they get, so that there is one shuffle by place and no join.
Outlines use the weights by which a pixel's neighbours on the outline tell straight, slanted and mixed steps; hulls are
those of the pixels' edge midpoints, and hold the pixels whose centre is in them, borders included. All counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of an outline pixel (1 for itself, 2 for each neighbour beside it, 10 for each slanted one) and the
#: length that it adds; other codes add nothing.
LENGTHS = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: math.sqrt(2), 33: math.sqrt(2), 13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}
BESIDE = ((-1, 0), (1, 0), (0, -1), (0, 1))
SLANTED = ((-1, -1), (-1, 1), (1, -1), (1, 1))


def votes(px: DataFrame, keys: Sequence[str], weights: dict[tuple[int, int], int]) -> DataFrame:
    """keys, y, x, n of each pixel: the sum of the weights of those pixels of its instance that lie at these offsets (dy, dx)
    from it. Repeated pixels count once."""
    px = px.select(*keys, "y", "x").distinct()
    sent = F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(w).alias("w"), F.lit(0).alias("own")) for (dy, dx), w in weights.items()), F.struct("y", "x", F.lit(0).alias("w"), F.lit(1).alias("own")))
    at = px.select(*keys, F.explode(sent).alias("s")).select(*keys, "s.*")
    return at.groupBy(*keys, "y", "x").agg(F.sum("w").alias("n"), F.max("own").alias("own")).where("own = 1").drop("own")


def outline(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels with one beside them that isn't of the instance."""
    return votes(px, keys, dict.fromkeys(BESIDE, 1)).where("n < 4").select(*keys, "y", "x")


def perimeters(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, perimeter."""
    codes = votes(outline(px, keys), keys, dict.fromkeys(BESIDE, 2) | dict.fromkeys(SLANTED, 10))
    length = F.coalesce(*(F.when(F.col("n") + 1 == code, F.lit(size)) for code, size in LENGTHS.items()), F.lit(0.0))
    # equal lengths are counted before they are added, so that the sum doesn't depend on the order
    by = codes.select(*keys, length.alias("length")).groupBy(*keys, "length").agg(F.count("*").alias("n"))
    parts = [F.sum(F.when(F.col("length") == size, F.col("n")).otherwise(0)) * F.lit(size) for size in sorted(set(LENGTHS.values()))]
    return by.groupBy(*keys).agg(sum(parts[1:], parts[0]).alias("perimeter"))


def moments(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, area, height, width, eccentricity, major, minor: of the ellipse with the same second moments."""
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    sums = {"n": F.count("*"), "sy": F.sum(y), "sx": F.sum(x), "syy": F.sum(y * y), "sxx": F.sum(x * x), "sxy": F.sum(y * x), "height": F.max(y) - F.min(y) + 1, "width": F.max(x) - F.min(x) + 1}
    s = px.select(*keys, "y", "x").distinct().groupBy(*keys).agg(*(e.alias(k) for k, e in sums.items()))
    n = F.col("n").cast("double")
    # whole numbers are subtracted before they are divided: nothing is lost for instances far from the origin
    about = lambda a, b, ab: (F.col("n") * F.col(ab) - F.col(a) * F.col(b)) / (n * n)
    s = s.select(*keys, "n", "height", "width", about("sy", "sy", "syy").alias("yy"), about("sx", "sx", "sxx").alias("xx"), about("sy", "sx", "sxy").alias("yx"))
    half, root = (F.col("yy") + F.col("xx")) / 2, F.sqrt(F.pow((F.col("yy") - F.col("xx")) / 2, 2) + F.pow("yx", 2))
    s = s.withColumns({"l1": half + root, "l2": F.greatest(half - root, F.lit(0.0))})
    flat = F.when(F.col("l1") > 0, F.sqrt(F.greatest(1 - F.col("l2") / F.col("l1"), F.lit(0.0)))).otherwise(0.0)
    return s.select(*keys, F.col("n").alias("area"), "height", "width", flat.alias("eccentricity"), (4 * F.sqrt("l1")).alias("major"), (4 * F.sqrt("l2")).alias("minor"))


def _border(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (Y, X), the corners where X as a function of Y is largest: a monotone chain."""
    best: dict[int, int] = {}
    for y, x in points:
        best[y] = max(x, best.get(y, x))
    chain: list[tuple[int, int]] = []
    for p in sorted(best.items()):
        while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) >= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
            chain.pop()
        chain.append(p)
    return chain


def hull_pixels(rows: list[tuple[int, int, int]]) -> int:
    """How many pixels have their centre in the hull of rows (y, first x, last x); in halves of a pixel, with whole numbers."""
    right = _border([p for y, _, hi in rows for p in ((2 * y, 2 * hi + 1), (2 * y - 1, 2 * hi), (2 * y + 1, 2 * hi))])
    left = _border([p for y, lo, _ in rows for p in ((2 * y, 1 - 2 * lo), (2 * y - 1, -2 * lo), (2 * y + 1, -2 * lo))])
    total, at = 0, [0, 0]
    for y in range(rows[0][0], rows[-1][0] + 1):
        ends = []
        for side, chain in enumerate((right, left)):
            while chain[at[side] + 1][0] < 2 * y:
                at[side] += 1
            (y1, x1), (y2, x2) = chain[at[side]], chain[at[side] + 1]
            ends.append((x1 * (y2 - y1) + (x2 - x1) * (2 * y - y1)) // (2 * (y2 - y1)))
        total += ends[0] + ends[1] + 1
    return total


def hulls(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, hull: pixels in the convex hull. Only the ends of an instance's rows are brought together."""

    @F.pandas_udf("long")
    def count(rows: pd.Series) -> pd.Series:
        return pd.Series([hull_pixels([(r["y"], r["lo"], r["hi"]) for r in own]) for own in rows])

    ends = px.groupBy(*keys, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("y", "lo", "hi"))))).alias("rows"))
    return ends.select(*keys, count("rows").alias("hull"))


def features(px: DataFrame, keys: Sequence[str], scale: float = 256.0) -> DataFrame:
    """keys and eight columns: outline over root of area, circularity, log of height over width, extent (share of the
    bounding box), eccentricity, solidity (share of the hull), and both axes in parts of `scale`."""
    keys = list(keys)
    a, p = F.col("area"), F.col("perimeter")
    every = moments(px, keys).join(perimeters(px, keys), keys).join(hulls(px, keys), keys)
    out: dict[str, Column] = {
        "compactness": p / F.sqrt(a), "circularity": 4 * math.pi * a / F.greatest(p * p, F.lit(1.0)), "log_aspect": F.log(F.greatest(F.col("height") / F.col("width"), F.lit(1e-6))),
        "extent": a / (F.col("height") * F.col("width")), "eccentricity": F.col("eccentricity"), "solidity": a / F.col("hull"), "major": F.col("major") / scale, "minor": F.col("minor") / scale,
    }
    return every.select(*keys, *(c.alias(name) for name, c in out.items()))
