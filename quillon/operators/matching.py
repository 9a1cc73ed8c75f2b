"""Instance matching on pixel tables (patch, pred, truth, ignored); 0 is background.

Overlaps come from one aggregation of pixels, never from comparing instances in pairs. Above an IoU of one half a match is
one-to-one by itself; below, pairs are settled in rounds. Matching below one half, and that of the boxes of large groups,
are joins and maxima, without a group in one task; boxes of groups of a bounded size take their turns one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.blocks import scan
from quillon.session import cut, uncut

#: Boxes of one image and class up to which they are compared in pairs and take their turns within one row.
FEW = 1024
CLASSES = (1, 2, 3, 4, 5)


def instance_type(instance: Column) -> Column:
    return instance % 5 + 1


def areas(px: DataFrame, side: str) -> DataFrame:
    """Evaluable pixels of each instance; an instance without any isn't evaluable."""
    return px.where((F.col(side) > 0) & ~F.col("ignored")).groupBy("patch", side).agg(F.count("*").alias(f"{side}_area"))


def overlaps(px: DataFrame) -> DataFrame:
    """patch, pred, truth, inter, areas, iou of all that share an evaluable pixel."""
    shared = px.where("pred > 0 and truth > 0 and not ignored").groupBy("patch", "pred", "truth").agg(F.count("*").alias("inter"))
    both = shared.join(areas(px, "pred"), ["patch", "pred"]).join(areas(px, "truth"), ["patch", "truth"])
    return both.withColumn("iou", F.col("inter") / (F.col("pred_area") + F.col("truth_area") - F.col("inter")))


def match(px: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one matches with IoU above the threshold, which must be a half or more (M1)."""
    if threshold < 0.5:
        raise ValueError("below one half use match_greedy")
    return overlaps(px).where(F.col("iou") > threshold).select("patch", "pred", "truth", "iou")


def dominant_pairs(pairs: DataFrame, left: list[str], right: list[str], strength: Column) -> DataFrame:
    """Of pairs each side's row in one pair at most, taken by falling strength (which must differ between pairs).

    In rounds: a pair that is the strongest of both its sides is in the result whatever else is; it goes out of the game
    with all others of its sides. Rounds are joins and maxima by key, so that a group of any size is spread; a round takes
    all such pairs at once, so their number is that of the longest chain of ever stronger neighbours.
    """
    open_ = cut(pairs.withColumn("_s", strength))
    taken: list[DataFrame] = []
    while open_.take(1):
        most_left, most_right = open_.groupBy(*left).agg(F.max("_s").alias("_l")), open_.groupBy(*right).agg(F.max("_s").alias("_r"))
        won = cut(open_.join(most_left, left).join(most_right, right).where("_s = _l and _s = _r").select(*pairs.columns))
        taken.append(won)
        before, open_ = open_, cut(open_.join(won.select(*left), left, "left_anti").join(won.select(*right), right, "left_anti"))
        uncut(before)
    return reduce(DataFrame.unionByName, taken) if taken else open_.select(*pairs.columns)


def match_greedy(px: DataFrame, threshold: float) -> DataFrame:
    """Matches by falling (iou, pred, truth), each instance once, at any threshold."""
    pairs = overlaps(px).where(F.col("iou") > threshold).selectExpr("cast(patch as long) patch", "cast(pred as long) pred", "cast(truth as long) truth", "iou")
    return dominant_pairs(pairs, ["patch", "pred"], ["patch", "truth"], F.struct("iou", "pred", "truth"))


def outcomes(px: DataFrame, matched: DataFrame) -> DataFrame:
    """A row for each match and each unmatched evaluable instance: patch, kind (tp, fp, fn), pred, truth, iou."""
    fp = areas(px, "pred").join(matched, ["patch", "pred"], "left_anti").selectExpr("patch", "'fp' kind", "pred", "null truth", "0D iou")
    fn = areas(px, "truth").join(matched, ["patch", "truth"], "left_anti").selectExpr("patch", "'fn' kind", "null pred", "truth", "0D iou")
    return matched.selectExpr("patch", "'tp' kind", "pred", "truth", "iou").unionByName(fp).unionByName(fn)


def typed_events(found: DataFrame) -> DataFrame:
    """class, tp, fp, fn, iou: a match of unequal types is a false positive of one class and a negative of the other (M3)."""
    p, t = instance_type(F.col("pred")), instance_type(F.col("truth"))
    zero, one = F.lit(0), F.lit(1)
    event = lambda c, tp, fp, fn, iou: F.struct(c.cast("int").alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), iou.alias("iou"))
    hit = event(p, one, zero, zero, F.col("iou"))
    false_p, false_n = event(p, zero, one, zero, F.lit(0.0)), event(t, zero, zero, one, F.lit(0.0))
    events = F.when((F.col("kind") == "tp") & (p == t), F.array(hit)).when(F.col("kind") == "tp", F.array(false_p, false_n)).when(F.col("kind") == "fp", F.array(false_p)).otherwise(F.array(false_n))
    return found.select("patch", F.explode(events).alias("e")).select("patch", "e.*")


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def metric_columns() -> list[Column]:
    """precision, recall, f1, pq from tp, fp, fn, sum_iou; 0 where a denominator is."""
    tp, fp, fn, s = (F.col(c) for c in ("tp", "fp", "fn", "sum_iou"))
    return [F.round(x, 6).alias(n) for n, x in (("precision", ratio(tp, tp + fp)), ("recall", ratio(tp, tp + fn)), ("f1", ratio(2 * tp, 2 * tp + fp + fn)), ("pq", ratio(s, tp + (fp + fn) / 2)))]


def counts_by_kind() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")]


def class_scores(found: DataFrame) -> DataFrame:
    """All classes 1 to 5, zeros where a class doesn't occur."""
    spark = found.sparkSession
    sums = typed_events(found).groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.sum("iou").alias("sum_iou"))
    domain = spark.createDataFrame([(c,) for c in CLASSES], "class int")
    return domain.join(sums, "class", "left").select("class", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")), F.coalesce("sum_iou", F.lit(0.0)).alias("sum_iou"))


def false_positive_kinds(px: DataFrame, matched: DataFrame, share: float = 0.1) -> DataFrame:
    """patch, pred, category of each unmatched prediction (M4); categories are tried in a fixed order."""
    lost = areas(px, "pred").join(matched, ["patch", "pred"], "left_anti")
    over = overlaps(px).join(matched.select("patch", "truth", F.lit(1).alias("taken")), ["patch", "truth"], "left")
    big = F.col("inter") >= share * F.least("pred_area", "truth_area")
    seen = over.groupBy("patch", "pred").agg(F.count_if(big).alias("big"), F.count_if(big & F.col("taken").isNotNull()).alias("taken"))
    category = F.when(F.col("big").isNull(), "background_only").when(F.col("big") == 0, "other_unresolved").when(F.col("big") > 1, "merge").when(F.col("taken") > 0, "split_fragment").otherwise("boundary_localization")
    return lost.join(seen, ["patch", "pred"], "left").select("patch", "pred", category.alias("category"))


def merge_split(px: DataFrame) -> DataFrame:
    """Predictions over several truths and truths over several predictions; the ignore mask is not applied (M5)."""
    pairs = px.where("pred > 0 and truth > 0").select("patch", "pred", "truth").distinct()
    merged = pairs.groupBy("patch", "pred").count().where("count > 1").agg(F.count("*").alias("merges"))
    split = pairs.groupBy("patch", "truth").count().where("count > 1").agg(F.count("*").alias("splits"))
    return merged.crossJoin(split)  # one row each


def confusion(matched: DataFrame) -> DataFrame:
    """All 25 cells of truth class by predicted class over matches."""
    spark = matched.sparkSession
    cells = spark.createDataFrame([(t, p) for t in CLASSES for p in CLASSES], "truth_class int, pred_class int")
    n = matched.groupBy(instance_type(F.col("truth")).cast("int").alias("truth_class"), instance_type(F.col("pred")).cast("int").alias("pred_class")).agg(F.count("*").alias("n"))
    return cells.join(n, ["truth_class", "pred_class"], "left").select("truth_class", "pred_class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box_iou(a: str, b: str, floor: float = 1e-9) -> Column:
    """IoU of two box structs (x1, y1, x2, y2)."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    area = lambda x: (F.col(f"{x}.x2") - F.col(f"{x}.x1")) * (F.col(f"{x}.y2") - F.col(f"{x}.y1"))
    inter = side("x1", "x2") * side("y1", "y2")
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(floor))


def box_pairs(det: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The columns of det (image, cls, det_id, box) and gt (image, cls, truth_id, truth), and iou, of all pairs of one image
    and class with an IoU at the threshold or above.

    Such boxes differ in width and height by no more than the threshold, and their centres by no more than the rest of the
    wider one. So a truth lies in one cell of a grid whose size follows its own width and height, and a detection looks
    into the few cells, of sizes like its own, that can hold a partner; nothing else is compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0")
    slack = 1e-9

    def sides(df: DataFrame, box: str) -> DataFrame:
        return df.where(f"{box}.x2 > {box}.x1 and {box}.y2 > {box}.y1").withColumns({"_w": F.expr(f"{box}.x2 - {box}.x1"), "_h": F.expr(f"{box}.y2 - {box}.y1"), "_x": F.expr(f"({box}.x1 + {box}.x2) / 2"), "_y": F.expr(f"({box}.y1 + {box}.y2) / 2")})

    cell = lambda at, level: f"cast(floor(({at}) / pow(2d, {level} + 1)) as long)"
    own = sides(gt, "truth").withColumns({"_lw": F.expr("cast(floor(log2(_w)) as int)"), "_lh": F.expr("cast(floor(log2(_h)) as int)")})
    own = own.withColumns({"_cx": F.expr(cell("_x", "_lw")), "_cy": F.expr(cell("_y", "_lh"))}).drop("_w", "_h", "_x", "_y")
    asks = sides(det, "box")
    for level, size in (("_lw", "_w"), ("_lh", "_h")):
        low, high = f"cast(floor(log2({size} * {threshold * (1 - slack)})) as int)", f"cast(floor(log2({size} * {(1 + slack) / threshold})) as int)"
        asks = asks.withColumn(level, F.explode(F.expr(f"sequence({low}, {high})")))
    for at, level, size, out in (("_x", "_lw", "_w", "_cx"), ("_y", "_lh", "_h", "_cy")):
        reach = f"{(1 - threshold) * (1 + slack) + slack} * greatest({size}, pow(2d, {level} + 1))"
        asks = asks.withColumn(out, F.explode(F.expr(f"sequence({cell(f'{at} - {reach}', level)}, {cell(f'{at} + {reach}', level)})")))
    met = asks.join(own, ["image", "cls", "_lw", "_lh", "_cx", "_cy"]).withColumn("iou", box_iou("box", "truth"))
    return met.where(F.col("iou") >= threshold).drop("_lw", "_lh", "_cx", "_cy", "_w", "_h", "_x", "_y")


def box_matches(det: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image, cls, det_id, conf, hit: detections by falling confidence (then id) take the best unused truth, IoU at the
    threshold or above, the later truth on a tie (M6).

    An image's boxes of a class that are FEW together are compared in pairs and take their turns in one fold: of pairs
    only those at the threshold are kept, and nothing is moved but the boxes. Larger groups are matched in rounds.
    """
    group = ["image", "cls"]
    det, gt = det.select(*group, "det_id", "conf", "box"), gt.select(*group, "truth_id", "truth")
    sizes = det.select(*group).unionAll(gt.select(*group)).groupBy(*group).agg(F.count("*").alias("n"))
    large = cut(sizes.where((F.col("n") > FEW) & F.col("image").isNotNull() & F.col("cls").isNotNull()).select(*group))
    known = det.where("image is not null and cls is not null")
    nowhere = det.where("image is null or cls is null").select(*group, "det_id", "conf", F.lit(False).alias("hit"))
    if not large.take(1):
        return _matched_by_turns(known, gt, threshold).unionByName(nowhere)
    # at most one in FEW rows has a large group of its own
    rest = [df.join(F.broadcast(large), group, "left_anti") for df in (known, gt)]
    many = [df.join(F.broadcast(large), group, "left_semi") for df in (known, gt)]
    return _matched_by_turns(*rest, threshold).unionByName(_matched_in_rounds(*many, threshold)).unionByName(nowhere)


def _late(conf: Column) -> Column:
    return F.coalesce(-conf, F.lit(float("inf"))).alias("late")


def _matched_by_turns(det: DataFrame, gt: DataFrame, threshold: float) -> DataFrame:
    """box_matches() of groups of a bounded size: each detection's truths, best first, then a fold over the detections."""
    proper = " and ".join(f"{b}.x2 > {b}.x1 and {b}.y2 > {b}.y1" for b in ("box", "truth"))
    iou = box_iou("box", "truth")
    other = gt.select(F.col("image").alias("_image"), F.col("cls").alias("_cls"), "truth_id", "truth")
    met = det.join(other, (F.col("image") == F.col("_image")) & (F.col("cls") == F.col("_cls")) & F.expr(proper) & (iou >= threshold), "left")
    wants = F.sort_array(F.collect_list(F.when(F.col("truth_id").isNotNull(), F.struct(iou.alias("iou"), "truth_id"))), asc=False).alias("wants")
    each = met.groupBy("image", "cls", "det_id", "conf").agg(wants)
    turns = each.groupBy("image", "cls").agg(F.array_sort(F.collect_list(F.struct(_late(F.col("conf")), "det_id", "conf", "wants"))).alias("turns"))
    none = F.array().cast(f"array<{gt.schema['truth_id'].dataType.simpleString()}>")
    free = lambda taken: lambda w: ~F.coalesce(F.array_contains(taken, w["truth_id"]), F.lit(False))
    picks = F.aggregate("turns", none, lambda taken, x: F.array_append(taken, F.get(F.filter(x["wants"], free(taken)), F.lit(0))["truth_id"]))
    rows = turns.select("image", "cls", F.explode(F.arrays_zip("turns", picks.alias("picks"))).alias("e"))
    return rows.select("image", "cls", "e.turns.det_id", "e.turns.conf", F.col("e.picks").isNotNull().alias("hit"))


def _matched_in_rounds(det: DataFrame, gt: DataFrame, threshold: float) -> DataFrame:
    """box_matches() of groups of any size. Truths all prefer the earlier detection, so taking turns gives the one stable
    matching, which deferred acceptance finds in rounds: each detection asks its best truth, a truth holds the first of
    those that ask, and all pairs of a held truth with later detections are out, until no truth is asked twice.
    """
    det = det.withColumn("_turn", F.struct(_late(F.col("conf")), "det_id"))
    truth, one = ["image", "cls", "truth_id"], ["image", "cls", "det_id"]
    open_ = cut(box_pairs(det, gt, threshold).select(*truth, "det_id", "_turn", "iou"))
    while True:
        asked = open_.groupBy(*one).agg(F.max(F.struct("iou", "truth_id")).alias("_want"), F.first("_turn").alias("_turn")).withColumn("truth_id", F.col("_want.truth_id"))
        held = cut(asked.groupBy(*truth).agg(F.min("_turn").alias("_held"), F.count("*").alias("_n")))
        if not held.where("_n > 1").take(1):
            break
        before, open_ = open_, cut(open_.join(held, truth, "left").where("_held is null or _turn <= _held").drop("_held", "_n"))
        uncut(before, held)
    hits = asked.select(*one, F.lit(True).alias("hit"))
    return det.join(hits, one, "left").select(*one, "conf", F.coalesce("hit", F.lit(False)).alias("hit"))


def ap50(hits: DataFrame, truths: DataFrame, classes: int = 3) -> DataFrame:
    """cls, ap: precision envelope averaged over 101 recall points; a class without truth counts 0 (M7, W7). Hits are summed
    by a scan over ranges; each goes to the last recall point it reaches, and the envelope is a maximum over those."""
    spark = hits.sparkSession
    n = truths.groupBy("cls").agg(F.count("*").alias("n"))
    run = scan(hits, ["cls"], [F.desc("conf"), F.col("image"), F.col("det_id")], {"tp": ("sum", F.col("hit").cast("int")), "k": ("count", F.lit(1))}, [])
    run = run.join(n, "cls").withColumns({"recall": F.col("tp") / F.col("n"), "precision": F.col("tp") / F.col("k")})
    near = F.floor(F.col("recall") * 100)
    last = F.when((near + 1) / 100 <= F.col("recall"), near + 1).when(near / 100 <= F.col("recall"), near).otherwise(near - 1)
    best = run.groupBy("cls", F.least(last, F.lit(100)).alias("at")).agg(F.max("precision").alias("p"))
    # at most 101 rows a class: each stands for the points from the one before it up to its own
    falling = Window.partitionBy("cls").orderBy(F.desc("at"))
    ends = best.select("cls", "at", F.max("p").over(falling).alias("p"), F.lag("at").over(Window.partitionBy("cls").orderBy("at")).alias("from"))
    points = ends.groupBy("cls").agg((F.sum(F.col("p") * (F.col("at") - F.coalesce("from", F.lit(-1)))) / 101).alias("ap"))
    return spark.range(classes).select(F.col("id").cast("int").alias("cls")).join(points, "cls", "left").select("cls", F.round(F.coalesce("ap", F.lit(0.0)), 6).alias("ap"))


def detector_scores(hits: DataFrame, truths: DataFrame, thresholds: DataFrame, classes: int = 3) -> DataFrame:
    """threshold, macro_f1, min_recall, mean_recall, recall (M6, O7) of box_matches() at each threshold of confidence. As
    detections take turns by falling confidence, leaving later ones out changes nothing for those before: one matching
    serves all thresholds, and these meet distinct confidences and not rows."""
    spark = hits.sparkSession
    domain = spark.range(classes).select(F.col("id").cast("int").alias("cls")).join(F.broadcast(thresholds.select("threshold")))
    n = truths.groupBy("cls").agg(F.count("*").alias("n"))
    by = hits.groupBy("cls", "conf").agg(F.count_if("hit").alias("tp"), F.count("*").alias("k"))
    got = by.join(F.broadcast(thresholds.select("threshold")), F.col("conf") >= F.col("threshold")).groupBy("threshold", "cls").agg(F.sum("tp").alias("tp"), F.sum("k").alias("k"))
    per = domain.join(got, ["threshold", "cls"], "left").join(n, "cls", "left").fillna(0, ["tp", "k", "n"])
    f1, recall = ratio(2 * F.col("tp"), F.col("k") + F.col("n")), ratio(F.col("tp"), F.col("n"))
    six = lambda x, name: F.round(x, 6).alias(name)
    return per.groupBy("threshold").agg(six(F.avg(f1), "macro_f1"), six(F.min(recall), "min_recall"), six(F.avg(recall), "mean_recall"), six(ratio(F.sum("tp"), F.sum("n")), "recall"))


def chosen_threshold(scores: DataFrame) -> DataFrame:
    """The row with the highest (macro_f1, min_recall, mean_recall), the smaller threshold on a tie."""
    return scores.orderBy(F.desc("macro_f1"), F.desc("min_recall"), F.desc("mean_recall"), "threshold").limit(1)


def iou_bins(matched: DataFrame, bins: list[tuple[float, float]]) -> DataFrame:
    """lo, hi, n, right_type of matches with an IoU in (lo, hi] (J14): the few bins are sent to the matches."""
    few = matched.sparkSession.createDataFrame(bins, "lo double, hi double")
    at = matched.join(F.broadcast(few), (F.col("iou") > F.col("lo")) & (F.col("iou") <= F.col("hi")))
    return at.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_if(instance_type(F.col("pred")) == instance_type(F.col("truth"))).alias("right_type"))


def training_rows(matched: DataFrame, features: DataFrame) -> DataFrame:
    """patch, pred, truth, iou, cls and the features of each matched proposal."""
    return matched.select("patch", "pred", "truth", "iou", instance_type(F.col("truth")).alias("cls")).join(features, ["patch", "pred"])


def typed_truths(px: DataFrame, features: DataFrame) -> DataFrame:
    """Features of the truth instances that have a type and an evaluable pixel."""
    typed = areas(px, "truth").where(instance_type(F.col("truth")).between(CLASSES[0], CLASSES[-1])).select("patch", "truth")
    return features.join(typed, ["patch", "truth"], "left_semi")


def report(px: DataFrame, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Everything that is said of one set of predictions (X8): class scores, kinds of false positives, confusion."""
    matched = match(px, threshold)
    kinds = false_positive_kinds(px, matched).groupBy("category").agg(F.count("*").alias("n"))
    return {"classes": class_scores(outcomes(px, matched)).select("class", "tp", "fp", "fn", *metric_columns()), "false_positives": kinds, "confusion": confusion(matched)}
