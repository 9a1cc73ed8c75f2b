"""Scans, order statistics and matching rounds: against plain versions, with one key that holds all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, matching, metrics, quantiles, sampling, shapes, texture

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_scan_against_a_loop(spark):
    rng = random.Random(3)
    keys = ["hot"] * 300 + ["a"] * 20 + [None] * 10 + ["b"]
    data = [(k, i, rng.choice([None, 1, 2, -3, 7])) for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(7)
    for order, sign in (([F.col("i")], 1), ([F.desc("i")], -1)):
        out = blocks.scan(df, ["k"], order, {"total": ("sum", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.col("v")), "place": ("count", F.lit(1))})
        assert out.columns == ["k", "i", "v", "total", "most", "least", "place"]
        got = {r["i"]: tuple(r)[3:] for r in out.collect()}
        for key in set(keys):
            seen, place = [], 0
            for k, i, v in sorted((d for d in data if d[0] == key), key=lambda d: sign * d[1]):
                place += 1
                seen += [] if v is None else [v]
                assert got[i] == (sum(seen) if seen else None, max(seen, default=None), min(seen, default=None), place)
    plain = blocks.numbered(df, [], [F.col("i")]).orderBy("i").select("k").limit(0).union(blocks.numbered(df.drop("k"), [], [F.col("i")]).orderBy("i").selectExpr("cast(k as string)"))
    assert [int(r[0]) for r in plain.collect()] == list(range(1, len(data) + 1))
    assert blocks.scan(df.limit(0), ["k"], [F.col("i")], {"t": ("sum", F.col("v"))}).count() == 0


@pytest.mark.parametrize("few", [1, 10_000])
def test_order_statistics(spark, few):
    rng = np.random.default_rng(2)
    groups = {
        "even": rng.normal(size=400), "skewed": np.exp(rng.normal(size=501) * 20), "equal": np.full(300, 2.5), "two": np.array([0.0, 1.0] * 50), "one": np.array([-7.0]),
        "wide": np.array([-1e300, -1e-300, 0.0, 5e-324, 1e-10, 1.0, 1e300, float("inf"), float("-inf")]), "tiny steps": 1.0 + np.arange(300) * 2.0**-52,
    }
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("even", None), ("none", None)], "g string, x double").repartition(5)
    want = [(g, r) for g, v in groups.items() for r in sorted({1, len(v), len(v) // 2 + 1, max(1, len(v) // 3), max(1, 19 * len(v) // 20)})]
    got = quantiles.at_ranks(df, ["g"], "x", spark.createDataFrame(want, "g string, rank long"), few)
    assert sorted((r["g"], r["rank"], r["x"]) for r in got.collect()) == sorted((g, r, float(np.sort(groups[g])[r - 1])) for g, r in want)


def test_percentiles_as_before(spark):
    rng = random.Random(5)
    values = [("a", rng.randint(-50, 50)) for _ in range(1000)] + [("b", 3), ("b", 4)] + [(None, 1), (None, 9), (None, 4)]
    df = spark.createDataFrame(values, "g string, x long")
    by = lambda g: sorted(x for k, x in values if k == g)
    near = {r["g"]: r["p_nearest"] for r in metrics.percentile_nearest(df, "x", "g", 0.95).collect()}
    floor = {r["g"]: (r["p_floor"], r["p50_upper"], r["median"]) for r in metrics.percentile_floor(df, "x", "g", 0.95).collect()}
    linear = {r["g"]: (r["p10"], r["p50"], r["p90"], r["iqr"]) for r in metrics.percentile_features(df, "x", "g").collect()}
    for g in ("a", "b", None):
        s, n = by(g), len(by(g))
        assert near[g] == s[int(np.ceil(0.95 * n)) - 1]
        assert floor[g] == (s[max(0, int(0.95 * n) - 1)], s[n // 2], float(np.median(s)))
        q = np.quantile(s, [0.1, 0.5, 0.9, 0.25, 0.75])
        assert np.allclose(linear[g], (*q[:3], q[4] - q[3]))


def greedy(pairs):
    used_p, used_t, out = set(), set(), []
    for iou, p, t in sorted(pairs, reverse=True):
        if p not in used_p and t not in used_t:
            used_p.add(p), used_t.add(t)
            out.append((p, t))
    return sorted(out)


def test_dominant_pairs_are_the_greedy_ones(spark):
    rng = random.Random(9)
    for chain in (False, True):
        pairs = [(i / 100, i // 2, (i + 1) // 2) for i in range(1, 30)] if chain else [(rng.randint(1, 6) / 7, p, t) for p in range(40) for t in rng.sample(range(40), 6)]
        df = spark.createDataFrame([(1, *x) for x in pairs], "patch int, iou double, pred int, truth int")
        got = matching.dominant_pairs(df, ["patch", "pred"], ["patch", "truth"], F.struct("iou", "pred", "truth"))
        assert sorted((r["pred"], r["truth"]) for r in got.collect()) == greedy(pairs)
    assert matching.dominant_pairs(df.limit(0), ["patch", "pred"], ["patch", "truth"], F.struct("iou", "pred", "truth")).count() == 0


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    return inter / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter, 1e-9)


@pytest.mark.parametrize("threshold", [0.5, 0.3, 0.9])
def test_boxes_of_one_image(spark, threshold):
    rng = random.Random(int(threshold * 10))

    def one():
        x, y, w, h = rng.uniform(-40, 40), rng.uniform(-40, 40), rng.choice([0, 1, 2, 4, 8, 16, rng.uniform(0.1, 30)]), rng.choice([1, 2, 4, rng.uniform(0.1, 30)])
        return (float(x), float(y), float(x + w), float(y + h))

    truth = [one() for _ in range(150)] + [(0.0, 0.0, 10.0, 10.0)] * 3
    found = [tuple(c + rng.choice([0, 0, 0.4, -1.5]) for c in rng.choice(truth)) for _ in range(220)] + [(0.0, 0.0, 20.0, 10.0), (0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 5.0, 5.0)]
    det = [(1, 0, i, rng.choice([0.5, 0.9, rng.random()]), b) for i, b in enumerate(found)]
    gt = [(1, 0, i, b) for i, b in enumerate(truth)]
    d = spark.createDataFrame(det, f"image long, cls int, det_id long, conf double, box {BOX}")
    t = spark.createDataFrame(gt, f"image long, cls int, truth_id long, truth {BOX}")
    want = {(i, j) for _, _, i, _, b in det for _, _, j, c in gt if iou(b, c) >= threshold and b[2] > b[0] and c[2] > c[0]}
    pairs = matching.box_pairs(d, t, threshold)
    assert sorted((r["det_id"], r["truth_id"]) for r in pairs.collect()) == sorted(want)
    used, hits = set(), {}
    for _, _, i, _, b in sorted(det, key=lambda x: (-x[3], x[2])):
        best = max(((iou(b, c), j) for _, _, j, c in gt if j not in used and (i, j) in want), default=None)
        hits[i] = best is not None
        if best:
            used.add(best[1])
    assert {r["det_id"]: r["hit"] for r in matching.box_matches(d, t, threshold).collect()} == hits


def test_many_boxes_of_one_image(spark):
    n = 60_000  # in pairs they would be 3.6 thousand million
    base = spark.range(n).selectExpr("1L image", "0 cls", "id", "cast(id % 300 * 12 as double) x", "cast(id div 300 * 12 as double) y")
    t = base.selectExpr("image", "cls", "id truth_id", "named_struct('x1', x, 'y1', y, 'x2', x + 10, 'y2', y + 10) truth")
    d = base.selectExpr("image", "cls", "id det_id", "(id * 7919 % 1000) / 1000d conf", "named_struct('x1', x + id % 3 * 3, 'y1', y, 'x2', x + id % 3 * 3 + 10, 'y2', y + 10) box")
    hits = matching.box_matches(d, t)
    assert hits.count() == n and hits.where("hit").count() == n - n // 3  # a shift by 6 of 10 leaves too little


def test_small_groups_of_boxes_write_nothing_by_pairs(spark, monkeypatch):
    """Boxes of small groups are matched without a table of pairs; large ones beside them in rounds, with the same result."""
    rng = random.Random(8)
    data = [(i, float(rng.randint(0, 30)), float(rng.randint(0, 3)), float(rng.randint(8, 14)), rng.choice([0.5, 0.9, None, rng.random()])) for i in range(240)]
    df = spark.createDataFrame(data, "i long, x double, y double, w double, conf double").selectExpr("case when i < 80 then 1L when i < 230 then i % 7 + 2 end image", "0 cls", "i", "x", "y", "w", "conf")
    t = df.selectExpr("image", "cls", "i truth_id", "named_struct('x1', x, 'y1', y, 'x2', x + w, 'y2', y + w) truth")
    d = df.selectExpr("image", "cls", "i det_id", "conf", "named_struct('x1', x + 1, 'y1', y, 'x2', x + w + 1, 'y2', y + w) box")
    seen = []
    rounds = matching._matched_in_rounds
    monkeypatch.setattr(matching, "_matched_in_rounds", lambda *a: seen.append(1) or rounds(*a))
    hits = lambda: sorted((r["det_id"], r["hit"]) for r in matching.box_matches(d, t).collect())
    whole = hits()
    assert not seen and len(whole) == 240 and 100 < sum(h for _, h in whole) < 230
    for few in (100, 0):
        monkeypatch.setattr(matching, "FEW", few)
        assert hits() == whole
    assert len(seen) == 2


def test_detector_threshold(spark):
    hits = spark.createDataFrame([(0, 0.9, True), (0, 0.8, False), (1, 0.7, True), (1, 0.6, True)], "cls int, conf double, hit boolean")
    truths = spark.createDataFrame([(0,), (1,), (1,)], "cls int")
    grid = spark.createDataFrame([(0.5,), (0.75,), (0.65,)], "threshold double")
    s = matching.detector_scores(hits, truths, grid, 2)
    got = {r["threshold"]: tuple(r)[1:] for r in s.collect()}
    assert got[0.75] == (round((2 / 3 + 0) / 2, 6), 0.0, 0.5, round(1 / 3, 6)) and got[0.5] == (round((2 / 3 + 1) / 2, 6), 1.0, 1.0, 1.0)
    assert matching.chosen_threshold(s).first()["threshold"] == 0.5


def test_split_of_one_stratum(spark):
    df = spark.range(200).selectExpr("id", "'all' s")
    counts = {r["split"]: r["count"] for r in sampling.stratified_split(df, "id", "s").groupBy("split").count().collect()}
    assert counts == {"train": 140, "val": 30, "test": 30}


# ---- shapes and textures ----------------------------------------------------------------------------------------------
def blob(rng, n):
    cells = {(0, 0)}
    while len(cells) < n:
        y, x = rng.choice(sorted(cells))
        cells.add((y + rng.choice([-1, 0, 1]), x + rng.choice([-1, 0, 1])))
    return cells


def in_hull(cells):
    """Pixel centres in the hull of the edge midpoints: on the inner side of every line that has all of them on one side."""
    pts = sorted({p for y, x in cells for p in ((2 * y, 2 * x + 1), (2 * y, 2 * x - 1), (2 * y + 1, 2 * x), (2 * y - 1, 2 * x))})
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    edges = [(a, b) for a in pts for b in pts if a != b and all(side(a, b, p) >= 0 for p in pts)]
    ys, xs = [y for y, _ in cells], [x for _, x in cells]
    return sum(all(side(a, b, (2 * y, 2 * x)) >= 0 for a, b in edges) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1))


def plain_perimeter(cells):
    edge = {(y, x) for y, x in cells if any((y + a, x + b) not in cells for a, b in shapes.BESIDE)}
    code = lambda y, x: 1 + sum(2 for a, b in shapes.BESIDE if (y + a, x + b) in edge) + sum(10 for a, b in shapes.SLANTED if (y + a, x + b) in edge)
    return sum(shapes.LENGTHS.get(code(*c), 0.0) for c in edge)


def test_shapes(spark):
    rng = random.Random(4)
    square = {(y, x) for y in range(5) for x in range(5)}
    every = {0: square, 1: {(7, -3)}, 2: {(0, x) for x in range(6)}, 3: {(y, 0) for y in range(6)}, **{i: blob(rng, rng.randint(2, 30)) for i in range(4, 30)}}
    far = 1_000_000
    px = spark.createDataFrame([(i, y + far, x + far) for i, c in every.items() for y, x in c] + [(0, far, far)], "id int, y int, x int").repartition(4)
    got = {r["id"]: r.asDict() for r in shapes.features(px, ["id"], 1.0).collect()}
    hull = {r["id"]: r["hull"] for r in shapes.hulls(px, ["id"]).collect()}
    for i, c in every.items():
        assert hull[i] == in_hull(c), c
        per, area = plain_perimeter(c), len(c)
        ys, xs = np.array(sorted(c), float).T
        l2, l1 = np.linalg.eigvalsh(np.cov(ys, xs, bias=True)) if area > 1 else (0.0, 0.0)
        want = {"compactness": per / area**0.5, "circularity": 4 * np.pi * area / max(per * per, 1), "solidity": area / hull[i], "eccentricity": np.sqrt(max(0, 1 - max(l2, 0) / l1)) if l1 > 0 else 0.0, "major": 4 * np.sqrt(max(l1, 0)), "minor": 4 * np.sqrt(max(l2, 0))}
        assert {k: round(got[i][k], 5) for k in want} == {k: round(float(v), 5) for k, v in want.items()}
    assert shapes.features(px.limit(0), ["id"]).count() == 0
    assert abs(got[0]["compactness"] - 16 / 5) < 1e-9 and got[0]["solidity"] == 1.0


def plain_local(gray):
    h, w = gray.shape
    at = lambda y, x: gray[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    dark = lambda y, x: np.round(gray[y, x] * 255) if 0 <= y < h and 0 <= x < w else 0.0
    gradient, pattern = np.zeros((h, w)), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            d = sum(k / 4 * (at(y - 1, x + c) - at(y + 1, x + c)) for k, c in ((1, -1), (2, 0), (1, 1)))
            a = sum(k / 4 * (at(y + c, x - 1) - at(y + c, x + 1)) for k, c in ((1, -1), (2, 0), (1, 1)))
            gradient[y, x] = np.sqrt((d * d + a * a) / 2)
            bits = []
            for p in range(8):
                ry, rx = y + round(-np.sin(2 * np.pi * p / 8), 5), x + round(np.cos(2 * np.pi * p / 8), 5)
                y0, x0, y1, x1 = int(np.floor(ry)), int(np.floor(rx)), int(np.ceil(ry)), int(np.ceil(rx))
                fy, fx = ry - y0, rx - x0
                v = (1 - fy) * ((1 - fx) * dark(y0, x0) + fx * dark(y0, x1)) + fy * ((1 - fx) * dark(y1, x0) + fx * dark(y1, x1))
                bits.append(v - dark(y, x) >= -1e-9)
            pattern[y, x] = sum(bits) if sum(a != b for a, b in zip(bits, bits[1:], strict=False)) <= 2 else 9
    return gradient, pattern


def test_texture_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(3)
    h, w = 23, 17
    rgb = rng.integers(0, 256, (h, w, 3)) / 255
    image = spark.createDataFrame([(5, y, x, *map(float, rgb[y, x])) for y in range(h) for x in range(w)], "image long, y int, x int, r double, g double, b double")
    size = spark.createDataFrame([(5, h, w)], "image long, height int, width int")
    gray = rgb.sum(2) / 3
    gradient, pattern = plain_local(gray)
    for tile in (4, 8, 64):
        got = {(r["y"], r["x"]): r for r in texture.local(image, size, tile).collect()}
        assert len(got) == h * w
        assert all(abs(got[y, x]["gradient"] - gradient[y, x]) < 1e-9 for y in range(h) for x in range(w))
        # what lies just on a step may fall on either side of it
        assert sum(got[y, x]["pattern"] == pattern[y, x] for y in range(h) for x in range(w)) >= 0.97 * h * w
    cells = {(y, x) for y in range(6) for x in range(9)} - {(2, 2)}
    px = spark.createDataFrame([(5, 1, y, x) for y, x in cells], "image long, id int, y int, x int")
    row = texture.features(px, ["image", "id"], image, size).first().asDict()
    assert len(row) == 2 + 33
    own = np.array([gray[c] for c in cells])
    around = {(y + a, x + b) for y, x in cells for a in range(-5, 6) for b in range(-5, 6) if a * a + b * b <= 25} - cells
    seen = [c for c in around if 0 <= c[0] < h and 0 <= c[1] < w]
    assert abs(row["gray_p50"] - np.median(own)) < 1e-9 and abs(row["gradient_std"] - np.std([gradient[c] for c in cells])) < 1e-9
    assert abs(row["ring_share"] - len(seen) / len(around)) < 1e-9 and abs(row["ring_gray"] - (np.mean([gray[c] for c in seen]) - own.mean())) < 1e-9
    assert abs(sum(row[f"pattern_{i}"] for i in range(10)) - 1) < 1e-9
