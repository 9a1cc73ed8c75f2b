"""Instance policies: which instances are kept, how they are labelled and scored, and how targets are made of masks.

Pixel tables are as in `matching` (patch, pred, truth, ignored), mask tables (patch, y, x, cls, raw_id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import matching
from quillon.session import cut

IGNORE = 255


# ---- validity and labels --------------------------------------------------------------------------------------------
def reaches(score: Column, threshold: float) -> Column:
    """score >= threshold, both as 32-bit floats."""
    return score.cast("float") >= F.lit(threshold).cast("float")


def retain(px: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """The label map without rejected instances (P1): their pixels become background. scored (patch, pred, score)."""
    out = scored.where(~reaches(F.col("score"), threshold)).select("patch", "pred", F.lit(True).alias("_out"))
    return px.join(out, ["patch", "pred"], "left").withColumn("pred", F.when(F.col("_out"), 0).otherwise(F.col("pred"))).drop("_out")


def proposals(px: DataFrame) -> DataFrame:
    """patch, pred, area, evaluable: every predicted instance and whether a pixel of it isn't ignored."""
    return px.where("pred > 0").groupBy("patch", "pred").agg(F.count("*").alias("area"), F.bool_or(~F.col("ignored")).alias("evaluable"))


def validity_labels(px: DataFrame, matched: DataFrame) -> DataFrame:
    """patch, pred, label of the evaluable proposals: 1 if matched (P2). What isn't evaluable is left out; accounting()
    counts it."""
    hit = matched.select("patch", "pred", F.lit(1).alias("label"))
    return proposals(px).where("evaluable").join(hit, ["patch", "pred"], "left").select("patch", "pred", F.coalesce("label", F.lit(0)).alias("label"))


def proposal_labels(px: DataFrame, matched: DataFrame) -> DataFrame:
    """patch, pred, label (P3): the matched truth's class, 0 if unmatched, -1 without an evaluable pixel."""
    hit = matched.select("patch", "pred", matching.instance_type(F.col("truth")).alias("cls"))
    label = F.when(F.col("cls").isNotNull(), F.col("cls")).when(F.col("evaluable"), 0).otherwise(-1)
    return proposals(px).join(hit, ["patch", "pred"], "left").select("patch", "pred", label.cast("int").alias("label"))


def relabelled(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("patch", "pred")) -> DataFrame:
    """changed, unchanged, missing, extra between two label tables."""
    both = old.select(*keys, F.col("label").alias("a"), F.lit(True).alias("o")).join(new.select(*keys, F.col("label").alias("b"), F.lit(True).alias("n")), list(keys), "full")
    have = F.col("o").isNotNull() & F.col("n").isNotNull()
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.count_if(have & ~same).alias("changed"), F.count_if(have & same).alias("unchanged"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("o").isNull()).alias("extra"))


def accounting(px: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """total, retained, rejected of the proposals that only cover ignored pixels (G10); the first is the others' sum."""
    lost = proposals(px).where("not evaluable").join(scored, ["patch", "pred"], "left")
    keep = F.coalesce(reaches(F.col("score"), threshold), F.lit(False))
    return lost.agg(F.count("*").alias("total"), F.count_if(keep).alias("retained"), F.count_if(~keep).alias("rejected"))


def balanced(labels: DataFrame, total: int | None = None) -> DataFrame:
    """positive, negative, excluded, total, adds_up (A9, X11): labels of 1 and 0, null where excluded."""
    t = labels.agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.count_if(F.col("label").isNull()).alias("excluded"), F.count("*").alias("n"))
    whole = F.col("n") if total is None else F.lit(total).cast("long")
    return t.select("positive", "negative", "excluded", whole.alias("total"), (F.col("positive") + F.col("negative") + F.col("excluded") == whole).alias("adds_up"))


# ---- linear scores --------------------------------------------------------------------------------------------------
def linear_scores(x: Column, mean: Sequence[float], scale: Sequence[float], weights: Sequence[Sequence[float]], intercept: Sequence[float]) -> Column:
    """(x - mean) / scale times each class's weights, plus its intercept (P6): an array. Written out, so that it stays
    within generated code."""
    z = [(x[i].cast("double") - float(m)) / float(s or 1.0) for i, (m, s) in enumerate(zip(mean, scale, strict=True))]
    one = lambda w, b: sum((z[i] * float(v) for i, v in enumerate(w)), F.lit(0.0)) + float(b)
    return F.array(*(one(w, b) for w, b in zip(weights, intercept, strict=True)))


def first_largest(scores: Column) -> Column:
    """Place of the largest element from 0, the first on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def adjusted_class(scores: Column, offsets: Sequence[float]) -> Column:
    """Class from 1 after offsets are added."""
    return first_largest(F.zip_with(scores, F.array(*(F.lit(float(o)) for o in offsets)), lambda a, b: a + b)) + 1


def probability(z: Column) -> Column:
    """Logistic, as a 32-bit float."""
    return (1 / (1 + F.exp(-z))).cast("float")


def confidence_features(df: DataFrame, keys: Sequence[str], logit: str) -> DataFrame:
    """mean, std, low, high of the probability per instance."""
    p = df.select(*keys, (1 / (1 + F.exp(-F.col(logit)))).alias("c"))
    return p.groupBy(*keys).agg(*(F.round(f("c"), 6).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))))


def majority_class(df: DataFrame, keys: Sequence[str], cls: str, classes: tuple[int, int] = (1, 5)) -> DataFrame:
    """The most frequent class of each instance among the given ones, the lowest on a tie."""
    n = df.where(F.col(cls).between(*classes)).groupBy(*keys, cls).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by(cls, F.struct("n", -F.col(cls))).alias(cls))


def choose(entries: DataFrame, order: Sequence[str], constraint: str) -> DataFrame:
    """The best entry that meets the constraint by falling order (O5); none is an error."""
    best = entries.where(constraint).orderBy(*(F.desc(c) for c in order)).limit(1)
    if not best.take(1):
        raise ValueError("no entry meets the constraint")
    return best


def separate_bests(entries: DataFrame, by: dict[str, str], key: str) -> DataFrame:
    """criterion, key: the best entry by each of several expressions (O10), the smaller key on a tie."""
    each = F.array(*(F.struct(F.lit(n).alias("criterion"), F.expr(e).cast("double").alias("v")) for n, e in by.items()))
    rows = entries.select(key, F.explode(each).alias("e")).select(key, "e.*")
    return rows.groupBy("criterion").agg(F.min_by(key, F.struct(-F.col("v"), F.col(key))).alias(key), F.round(F.max("v"), 6).alias("value"))


def top_detections(det: DataFrame, cap: int = 300) -> DataFrame:
    """The `cap` surest detections of an image, earlier ones first on a tie."""
    w = Window.partitionBy("image").orderBy(F.desc("conf"), "det_id")
    return det.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


# ---- masks ----------------------------------------------------------------------------------------------------------
def audit_masks(mask: DataFrame, classes: Sequence[int]) -> DataFrame:
    """cls, instances, pixels, patches of each class, zeros for absent ones."""
    t = mask.groupBy("cls").agg(F.count_distinct("patch", "raw_id").alias("instances"), F.count("*").alias("pixels"), F.count_distinct("patch").alias("patches"))
    every = mask.sparkSession.createDataFrame([(int(c),) for c in classes], "cls int")
    return every.join(t.withColumn("cls", F.col("cls").cast("int")), "cls", "left").na.fill(0)


def pixel_conflicts(mask: DataFrame, background: DataFrame, height: int, width: int, patches: int) -> DataFrame:
    """overlap (several classes), contradiction (a class and background), void (neither) pixels.
    background (patch, y, x)."""
    place = ["patch", "y", "x"]
    fg = mask.groupBy(*place).agg(F.count("*").alias("n"))
    both = fg.join(background.select(*place).distinct().withColumn("bg", F.lit(1)), place, "full")
    t = both.agg(F.count_if(F.col("n") > 1).alias("overlap"), F.count_if(F.col("n").isNotNull() & F.col("bg").isNotNull()).alias("contradiction"), F.count("*").alias("known"))
    return t.select("overlap", "contradiction", (F.lit(height * width * patches) - F.col("known")).cast("long").alias("void"))


def bad_mask_rows(mask: DataFrame, height: int, width: int, classes: Sequence[int]) -> DataFrame:
    """problem, n of rows out of range (A1)."""
    rules = {"class": ~F.col("cls").isin(list(classes)), "place": ~(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)), "id": F.col("raw_id") <= 0, "null": F.col("raw_id").isNull() | F.col("cls").isNull()}
    each = F.array(*(F.struct(F.lit(k).alias("problem"), F.coalesce(v, F.lit(False)).alias("bad")) for k, v in rules.items()))
    return mask.select(F.explode(each).alias("e")).groupBy("e.problem").agg(F.count_if("e.bad").alias("n"))


def pieces(mask: DataFrame) -> DataFrame:
    """patch, cls, raw_id, pieces: 8-connected parts of each instance (M10). First runs of each row, which one window
    makes, then runs that touch from row to row take the smaller label until nothing changes: rounds grow with the
    windings of a shape, not with its size."""
    key = ["patch", "cls", "raw_id"]
    px = mask.select(*key, "y", "x").distinct()
    row = Window.partitionBy(*key, "y").orderBy("x")
    starts = px.withColumn("new", (F.col("x") - F.lag("x", 1, -2).over(row) > 1).cast("int"))
    part = starts.withColumn("run", F.sum("new").over(row)).groupBy(*key, "y", "run").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    part = cut(part.withColumn("label", F.struct("y", "lo")))
    b = part.select(*key, (F.col("y") - 1).alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.struct(F.col("y"), F.col("lo")).alias("to"))
    touch = part.join(b, [*key, "y"]).where("lo2 <= hi + 1 and lo <= hi2 + 1").select(*key, F.struct("y", "lo").alias("from"), "to")
    touch = cut(touch.union(touch.select(*key, F.col("to"), F.col("from"))))
    part = part.select(*key, F.struct("y", "lo").alias("at"), "label")
    while True:
        near = touch.join(part.select(*key, F.col("at").alias("to"), "label"), [*key, "to"]).groupBy(*key, F.col("from").alias("at")).agg(F.min("label").alias("near"))
        spread = cut(part.join(near, [*key, "at"], "left").select(*key, "at", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")))
        part = spread.drop("old")
        if not spread.where("label <> old").limit(1).count():
            return part.groupBy(*key).agg(F.count_distinct("label").alias("pieces"))


def target(mask: DataFrame, background: DataFrame) -> DataFrame:
    """patch, y, x, semantic, instance of every known pixel (P5). Instances that overlap another or are in several pieces
    are ignored as a whole; the others are numbered from 1 by class and raw id; class c is semantic c + 1; known background is
    0. Pixels of no row are void and stay unknown."""
    place, key = ["patch", "y", "x"], ["patch", "cls", "raw_id"]
    crowded = mask.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1")
    out = mask.join(crowded, place, "left_semi").select(*key).union(pieces(mask).where("pieces > 1").select(*key)).distinct()
    kept = mask.select(*key).distinct().join(out, key, "left_anti")
    number = kept.withColumn("instance", F.row_number().over(Window.partitionBy("patch").orderBy("cls", "raw_id")).cast("int"))
    fg = mask.join(number, key, "left")
    # a crowded pixel belongs to ignored instances only
    fg = fg.groupBy(*place).agg(F.min(F.when(F.col("instance").isNotNull(), F.col("cls"))).alias("cls"), F.min("instance").alias("instance"))
    bg = background.select(*place).distinct().join(fg, place, "left_anti").select(*place, F.lit(0).alias("semantic"), F.lit(0).alias("instance"))
    return fg.select(*place, F.coalesce(F.col("cls") + 1, F.lit(IGNORE)).cast("int").alias("semantic"), F.coalesce("instance", F.lit(0)).alias("instance")).union(bg)


def centre_offsets(px: DataFrame, keys: Sequence[str] = ("patch", "instance")) -> DataFrame:
    """dy, dx: each pixel's place from its instance's centre, by the largest distance on that axis, at least 1 (F17). Only
    the instances' extents are joined back, as no instance's pixels need be together."""
    centre = px.groupBy(*keys).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), *(f(c).alias(f"{n}_{c}") for c in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max))))
    scale = lambda c: F.greatest(F.col(f"hi_{c}") - F.col(f"c{c}"), F.col(f"c{c}") - F.col(f"lo_{c}"), F.lit(1.0))
    return px.join(centre, list(keys)).select(*keys, "y", "x", ((F.col("y") - F.col("cy")) / scale("y")).alias("dy"), ((F.col("x") - F.col("cx")) / scale("x")).alias("dx"))


def turned(y: Column, x: Column, size: int, quarter_turns: int, flip: bool) -> tuple[Column, Column]:
    """Places after quarter turns counter-clockwise and then a left-right flip."""
    for _ in range(quarter_turns % 4):
        y, x = (size - 1) - x, y
    return (y, (size - 1) - x) if flip else (y, x)


def extents(px: DataFrame, keys: Sequence[str], cls: str) -> DataFrame:
    """Bounding box, pixels, and pixels of the most frequent class of each instance."""
    n = px.groupBy(*keys, cls).agg(F.count("*").alias("n"), *(f(c).alias(f"{a}_{c}") for c in ("y", "x") for a, f in (("lo", F.min), ("hi", F.max))))
    box = [f(f"{a}_{c}").alias(f"{a}_{c}") for c in ("y", "x") for a, f in (("lo", F.min), ("hi", F.max))]
    return n.groupBy(*keys).agg(*box, F.sum("n").alias("pixels"), F.max("n").alias("top_pixels"), F.count("*").alias("classes"))


# ---- boxes and rows -------------------------------------------------------------------------------------------------
def corners(cx: Column, cy: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """A box of shares (centre, size) as corners in pixels."""
    return F.struct(((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2"))


def crop(box: str, width: int, height: int, margin: float = 0.1) -> Column:
    """A box widened by a share of its sides, cut to whole pixels of the image."""
    c = lambda n: F.col(f"{box}.{n}")
    dx, dy = (c("x2") - c("x1")) * margin, (c("y2") - c("y1")) * margin
    return F.struct(
        F.greatest(F.lit(0), F.floor(c("x1") - dx)).cast("int").alias("x1"), F.greatest(F.lit(0), F.floor(c("y1") - dy)).cast("int").alias("y1"),
        F.least(F.lit(width), F.ceil(c("x2") + dx)).cast("int").alias("x2"), F.least(F.lit(height), F.ceil(c("y2") + dy)).cast("int").alias("y2"),
    )


def aligned(left: DataFrame, right: DataFrame, group: str, order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of two tables paired by their place within a group (X1); a row without a partner is an error."""
    number = lambda df, o, n: df.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*o))).withColumn(n, F.lit(True))
    both = number(left, order, "_l").join(number(right, right_order, "_r"), [group, "_at"], "full")
    if both.where("_l is null or _r is null").limit(1).count():
        raise ValueError("rows are left over")
    return both.drop("_at", "_l", "_r")


def with_fallback(keys: DataFrame, cached: DataFrame, computed: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """The cached value where there is one, else the computed."""
    both = keys.join(cached.select(*on, F.col(value).alias("_a")), list(on), "left").join(computed.select(*on, F.col(value).alias("_b")), list(on), "left")
    return both.withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def typing_accuracy(matched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, right, accuracy of the types of matches, per stratum (M9); null without a match."""
    same = matching.instance_type(F.col("pred")) == matching.instance_type(F.col("truth"))
    t = matched.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(same).alias("right"))
    return t.withColumn("accuracy", F.round(F.when(F.col("n") > 0, F.col("right") / F.col("n")), 6))


def paired_typing(matched: DataFrame, before: Column, after: Column) -> DataFrame:
    """both, only_before, only_after, neither: on the same matches, which of two typings is right (M9)."""
    truth = matching.instance_type(F.col("truth"))
    a, b = before == truth, after == truth
    return matched.agg(*(F.count_if(c).alias(n) for n, c in (("both", a & b), ("only_before", a & ~b), ("only_after", ~a & b), ("neither", ~a & ~b))))


def frozen_decisions(payload: DataFrame, raw: DataFrame, threshold: float) -> DataFrame:
    """patch, pred, problem of retained predictions that don't follow from their scores (A6). payload (patch, pred, score,
    kept), raw (patch, pred): all proposals."""
    both = raw.select("patch", "pred", F.lit(True).alias("r")).join(payload.withColumn("p", F.lit(True)), ["patch", "pred"], "full")
    problem = F.when(F.col("p").isNull(), "missing").when(F.col("r").isNull(), "unexpected").when(~F.col("kept").eqNullSafe(reaches(F.col("score"), threshold)), "decision")
    return both.select("patch", "pred", problem.alias("problem")).where("problem is not null")


def membership_ledger(features: DataFrame, labels: DataFrame, keys: Sequence[str] = ("patch", "pred")) -> DataFrame:
    """One row a proposal with the reason it is in or out and a digest of its features."""
    reason = F.when(F.col("label") > 0, "matched").when(F.col("label") == 0, "unmatched").when(F.col("label") < 0, "not_evaluable").otherwise("unlabelled")
    digest = F.sha2(F.to_json(F.struct(*sorted(c for c in features.columns if c not in keys))), 256)
    return features.select(*keys, digest.alias("digest")).join(labels.select(*keys, "label"), list(keys), "left").select(*keys, reason.alias("reason"), "digest")


def shape_features(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """area, extent (share of its bounding box), log_aspect, equivalent diameter and second moments of each instance
    (F15): what sums of pixels give; outlines and hulls need image kernels."""
    t = px.groupBy(*keys).agg(F.count("*").alias("area"), *(f(c).alias(f"{n}_{c}") for c in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max), ("var", F.var_pop))))
    h, w = (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1 for c in ("y", "x"))
    return t.select(
        *keys, "area", F.round(F.col("area") / (h * w), 6).alias("extent"), F.round(F.log(h / w), 6).alias("log_aspect"),
        F.round(F.sqrt(4 * F.col("area") / F.pi()), 6).alias("diameter"), "var_y", "var_x",
    )


def predicted(df: DataFrame, predict: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through a predictor that the caller brings (E8): it gets batches of the rows and gives rows of the schema."""
    return df.mapInPandas(predict, schema)


def score_cache(features: DataFrame, column: str, classifier: dict, filter_: dict, threshold: float, keys: Sequence[str] = ("patch", "pred")) -> DataFrame:
    """Keys, scores, cls and validity of what the filter keeps (X16): two linear models on the same features. A model is
    mean, scale, weights, intercept."""
    x = F.col(column)
    valid = probability(linear_scores(x, filter_["mean"], filter_["scale"], filter_["weights"], filter_["intercept"])[0])
    rows = features.select(*keys, linear_scores(x, classifier["mean"], classifier["scale"], classifier["weights"], classifier["intercept"]).alias("scores"), valid.alias("validity"))
    return rows.where(reaches(F.col("validity"), threshold)).select(*keys, "scores", (first_largest(F.col("scores")) + 1).alias("cls"), "validity")
