"""Colour and texture of instances (F16): what a pixel's neighbours give is computed in tiles that bring them along.

An image is a table (image, y, x, r, g, b), values from 0 to 1; a pixel that isn't there is black. Pixels are dealt to square
tiles, and those within the halo of other tiles to these as well, so that a tile is one group of bounded size and a pixel's
neighbours are with it, whatever the image's size. Gradients repeat the image's edge; binary patterns see black beyond it.
Per instance, percentiles are exact order statistics, and the rest is sums; the ring around an instance comes from its
outline alone, as the nearest pixel of an instance lies there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import quantiles, shapes
from quillon.session import cut

TILE, HALO, REACH, PATTERNS = 64, 1, 5, 10
#: Where the eight neighbours of a binary pattern lie, rounded as such patterns are.
CIRCLE = tuple((round(-math.sin(2 * math.pi * k / 8), 5), round(math.cos(2 * math.pi * k / 8), 5)) for k in range(8))
COLOURS = ("r", "g", "b", "gray")


def _local(gray: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and binary pattern of the inner cells of a tile with its halo; `inside` is what the image holds of it."""
    rows, cols = np.flatnonzero(inside.any(1)), np.flatnonzero(inside.any(0))
    edge = gray[np.clip(np.arange(len(gray)), rows[0], rows[-1])][:, np.clip(np.arange(gray.shape[1]), cols[0], cols[-1])]
    at = lambda a, dy, dx: a[1 + dy : len(a) - 1 + dy, 1 + dx : a.shape[1] - 1 + dx]
    down = sum(w * (at(edge, -1, d) - at(edge, 1, d)) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)))
    across = sum(w * (at(edge, d, -1) - at(edge, d, 1)) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)))
    whole = np.where(inside, np.round(gray * 255), 0.0)
    bits = []
    for dy, dx in CIRCLE:
        y0, x0 = math.floor(dy), math.floor(dx)
        y1, x1, fy, fx = math.ceil(dy), math.ceil(dx), dy - y0, dx - x0
        top = (1 - fx) * at(whole, y0, x0) + fx * at(whole, y0, x1)
        bottom = (1 - fx) * at(whole, y1, x0) + fx * at(whole, y1, x1)
        bits.append((1 - fy) * top + fy * bottom - at(whole, 0, 0) >= 0)
    turns = sum((a != b).astype(int) for a, b in zip(bits, bits[1:], strict=False))
    return np.sqrt((down**2 + across**2) / 2), np.where(turns <= 2, sum(b.astype(int) for b in bits), PATTERNS - 1)


def local(image: DataFrame, size: DataFrame, tile: int = TILE) -> DataFrame:
    """image, y, x, r, g, b, gray, gradient, pattern of each pixel. size (image, height, width)."""
    px = image.select("image", *(F.col(c).cast("long").alias(c) for c in ("y", "x")), *(F.least(F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias(c) for c in "rgb"))
    lines = lambda c: F.expr(f"sequence(cast(floor(({c} - {HALO}) / {tile}) as long), cast(floor(({c} + {HALO}) / {tile}) as long))")
    dealt = px.withColumn("ty", F.explode(lines("y"))).withColumn("tx", F.explode(lines("x"))).where("ty >= 0 and tx >= 0").join(size, "image")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image, ty, tx = key
        top, left = ty * tile - HALO, tx * tile - HALO
        side = tile + 2 * HALO
        gray = np.zeros((side, side))
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        mean = rows[["r", "g", "b"]].to_numpy().sum(1) / 3
        gray[y - top, x - left] = mean
        height, width = int(rows["height"].iloc[0]), int(rows["width"].iloc[0])
        inside = np.zeros((side, side), bool)
        inside[max(0, -top) : max(0, height - top), max(0, -left) : max(0, width - left)] = True
        gradient, pattern = _local(gray, inside)
        own = (y // tile == ty) & (x // tile == tx)
        out = rows.loc[own, ["y", "x", "r", "g", "b"]].assign(image=image, gray=mean[own])
        cy, cx = y[own] - top - HALO, x[own] - left - HALO
        return out.assign(gradient=gradient[cy, cx], pattern=pattern[cy, cx])

    schema = f"image {image.schema['image'].dataType.simpleString()}, y long, x long, r double, g double, b double, gray double, gradient double, pattern int"
    return dealt.groupBy("image", "ty", "tx").applyInPandas(lambda key, rows: one(key, rows)[[c.split()[0] for c in schema.split(", ")]], schema)


def ring(px: DataFrame, keys: Sequence[str], reach: int = REACH) -> DataFrame:
    """keys, y, x of the places within `reach` of an instance that aren't its own; some lie beyond the image."""
    disk = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if 0 < dy * dy + dx * dx <= reach * reach]
    around = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in disk)))
    near = shapes.outline(px, keys).select(*keys, around.alias("p")).select(*keys, "p.*").distinct()
    return near.join(px.select(*keys, "y", "x").distinct(), [*keys, "y", "x"], "left_anti")


def features(px: DataFrame, keys: Sequence[str], image: DataFrame, size: DataFrame, tile: int = TILE) -> DataFrame:
    """keys and 33 columns of each instance. px (keys, y, x), where the first key is `image`: three percentiles of each colour
    and of gray, gray's interquartile range; mean, deviation and 90th percentile of the gradient; shares of the ten binary
    patterns; the ring's colours, gray, deviation and gradient less the instance's own; the share of the ring that the
    image holds. With the eight columns of shapes.features they are 41."""
    keys = list(keys)
    seen = cut(local(image, size, tile))
    place = ["image", "y", "x"]
    mine = px.select(*keys, *(F.col(c).cast("long").alias(c) for c in ("y", "x"))).distinct()
    own = cut(mine.join(seen, place))
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    parts = []
    for c in COLOURS:
        got = quantiles.interpolated(own, keys, c, shares | ({"q1": 0.25, "q3": 0.75} if c == "gray" else {}))
        parts.append(got.select(*keys, *(F.col(p).alias(f"{c}_{p}") for p in shares), *([(F.col("q3") - F.col("q1")).alias("gray_iqr")] if c == "gray" else [])))
    parts.append(quantiles.interpolated(own, keys, "gradient", {"gradient_p90": 0.9}))
    deviation = lambda c: F.coalesce(F.stddev_pop(c), F.lit(0.0))
    hist = [(F.count_if(F.col("pattern") == i) / F.count("*")).alias(f"pattern_{i}") for i in range(PATTERNS)]
    inner = own.groupBy(*keys).agg(F.avg("gradient").alias("gradient_mean"), deviation("gradient").alias("gradient_std"), *hist, *(F.avg(c).alias(f"_{c}") for c in COLOURS), deviation("gray").alias("_std"))
    around = ring(mine, keys)
    expected = around.groupBy(*keys).agg(F.count("*").alias("_all"))
    outer = around.join(seen, place).groupBy(*keys).agg(*(F.avg(c).alias(f"_o{c}") for c in COLOURS), deviation("gray").alias("_ostd"), F.avg("gradient").alias("_ograd"), F.count("*").alias("_seen"))
    both = inner.join(expected, keys, "left").join(outer, keys, "left")
    less = lambda outer, inner: F.coalesce(F.col(outer) - F.col(inner), F.lit(0.0))
    rings: dict[str, Column] = {f"ring_{c}": less(f"_o{c}", f"_{c}") for c in COLOURS} | {"ring_std": less("_ostd", "_std"), "ring_gradient": less("_ograd", "gradient_mean")}
    rings["ring_share"] = F.least(F.coalesce(F.col("_seen"), F.lit(0)) / F.greatest(F.coalesce("_all", F.lit(0)), F.lit(1)), F.lit(1.0))
    parts.append(both.select(*keys, "gradient_mean", "gradient_std", *(f"pattern_{i}" for i in range(PATTERNS)), *(c.alias(n) for n, c in rings.items())))
    return reduce(lambda a, b: a.join(b, keys), parts)
