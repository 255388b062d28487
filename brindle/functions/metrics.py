"""Scores as aggregates over predictions.

``p`` has candidate_id, fold, target, row_id, truth, pred and confidence; each metric gives one row for each
(candidate_id, fold, target).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.keys import u
from brindle.operators.ranks import quantile_blocks, scan
from brindle.session import scratch

BY = ("candidate_id", "fold", "target")
#: (metric, larger is better, best value, worst value)
DIRECTIONS = (
    ("accuracy", True), ("precision", True), ("recall", True), ("f1", True), ("f1Micro", True), ("f1Macro", True), ("rocAuc", True), ("rocAucMicro", True),
    ("rocAucMacro", True), ("meanSquaredError", False), ("rootMeanSquaredError", False), ("meanAbsoluteError", False), ("rootMeanSquaredErrorAvg", False), ("rSquared", True),
    ("normalizedMutualInformation", True), ("jaccardSimilarityScore", True), ("precisionAtTopK", True), ("objectDetectionAP", True), ("hammingLoss", False),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def accuracy(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H1."""
    return p.groupBy(*by).agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("value"))


def prf(p: DataFrame, pos_label: str, by: Sequence[str] = BY) -> DataFrame:
    """H2. precision, recall and f1 of one label; 0/0 is 0."""
    t, q = F.col("truth") == pos_label, F.col("pred") == pos_label
    c = p.groupBy(*by).agg(F.count_if(t & q).alias("tp"), F.count_if(~t & q).alias("fp"), F.count_if(t & ~q).alias("fn"))
    return c.select(*by, _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def confusion(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, truth, pred, n): the cells of the confusion table."""
    return p.groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))


def score_confusion(cells: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H14. accuracy and f1Macro of predictions that :func:`confusion` has counted, as rows like those of :func:`score`."""
    hit = F.col("truth") == F.col("pred")
    share = cells.groupBy(*by).agg(F.try_divide(F.sum(hit.cast("double") * F.col("n")), F.sum(F.when(hit.isNotNull(), F.col("n")))).alias("value"))
    f1 = _counts_of(cells, by).groupBy(*by).agg(F.avg(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("value"))
    return reduce(DataFrame.unionByName, [x.withColumns({"metric": F.lit(m), "larger": F.lit(True)}) for m, x in (("accuracy", share), ("f1Macro", f1))])


def class_counts(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, class, tp, fp, fn) over classes in truth or prediction. Rows are counted by (truth, pred)
    first, so the explode sees one row for each cell of the confusion table."""
    return _counts_of(confusion(p, by), by)


def _counts_of(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    hit = F.col("truth") == F.col("pred")
    parts = F.when(hit, F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).otherwise(
        F.array(
            F.struct(F.col("truth").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn")),
            F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn")),
        )
    )
    return cells.select(*by, F.inline(parts)).groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def f1_micro(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H3."""
    return class_counts(p, by).groupBy(*by).agg(_ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("value"))


def f1_macro(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H3. Mean over the classes in truth or prediction."""
    return class_counts(p, by).groupBy(*by).agg(F.avg(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("value"))


def jaccard(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H10. Macro mean of tp / (tp + fp + fn)."""
    return class_counts(p, by).groupBy(*by).agg(F.avg(_ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))).alias("value"))


def roc_auc(p: DataFrame, pos_label: str, by: Sequence[str] = BY) -> DataFrame:
    """H4. From average ranks of the confidence; null with one class. Equal confidences are counted
    together first, and ranks run along blocks of scores, so no task holds all scores of a candidate."""
    s = scratch(p.groupBy(*by, F.col("confidence").alias("s")).agg(F.count_if(F.col("truth") == pos_label).alias("pos"), F.count("*").alias("n")), "auc")
    s = scan(s, by, quantile_blocks(s, "s", s.count()), ["s"], {"upto": ("sum", F.col("n"))})
    s = s.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    c = s.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("m"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    return c.select(*by, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("m")).alias("value"))


def one_vs_rest(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, class, truth, confidence): one row for each class, scores from the map ``scores``."""
    long = p.select(*by, "row_id", F.col("truth").alias("_t"), F.explode("scores").alias("class", "confidence"))
    return long.select(*by, "class", (F.col("_t") == F.col("class")).cast("string").alias("truth"), "confidence")


def roc_auc_micro(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H5. All classes pooled."""
    return roc_auc(one_vs_rest(p, by), "true", by)


def roc_auc_macro(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H5. Mean over classes."""
    return roc_auc(one_vs_rest(p, by), "true", [*by, "class"]).groupBy(*by).agg(F.avg("value").alias("value"))


def errors(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H6. mse, rmse, mae."""
    d = F.col("truth").try_cast("double") - F.col("pred").try_cast("double")
    return p.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def rmse_avg(p: DataFrame, by: Sequence[str] = ("candidate_id", "fold")) -> DataFrame:
    """H7. Mean over targets."""
    return errors(p, [*by, "target"]).groupBy(*by).agg(F.avg("rmse").alias("value"))


def r2(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H8. Null when the truth is constant; sums only, no window."""
    t, q = F.col("truth").try_cast("double"), F.col("pred").try_cast("double")
    return p.groupBy(*by).agg((1 - F.try_divide(F.avg((t - q) * (t - q)), F.when(F.var_pop(t) > 1e-12, F.var_pop(t)))).alias("value"))


def nmi(p: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """H9. I over the arithmetic mean of the entropies, natural logs; 1 when both are 0."""
    cells = p.groupBy(*by, "truth", "pred").agg(F.count("*").cast("double").alias("n"))
    w = lambda *c: F.sum("n").over(Window.partitionBy(*by, *c))
    cells = cells.withColumns({"t": w("truth"), "q": w("pred"), "all": w()})
    x = cells.groupBy(*by).agg(
        F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("t") * F.col("q")))).alias("i"),
        (-F.sum(F.col("n") / F.col("all") * F.log(F.col("t") / F.col("all")))).alias("ht"),
        (-F.sum(F.col("n") / F.col("all") * F.log(F.col("q") / F.col("all")))).alias("hq"),
    )
    return x.select(*by, F.when(F.col("ht") + F.col("hq") <= 1e-12, 1.0).otherwise(F.col("i") / ((F.col("ht") + F.col("hq")) / 2)).alias("value"))


def precision_at_k(p: DataFrame, k: int, by: Sequence[str] = BY) -> DataFrame:
    """H11. Overlap of the top k by truth and by prediction, over k; ties by key."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(c).try_cast("double").desc(), "row_id"))
    # a filter on the row number lets every task keep its own first k of a group
    first = lambda c: p.withColumn("_n", rank(c)).where(F.col("_n") <= k).select(*by, "row_id")
    both = first("truth").unionByName(first("pred")).groupBy(*by, "row_id").agg(F.count("*").alias("n"))
    return both.groupBy(*by).agg((F.count_if(F.col("n") == 2) / F.lit(k)).alias("value"))


def _best_boxes(places: DataFrame, shapes: DataFrame, area) -> DataFrame:
    """(image, x1, y1, x2, y2, b): for each of the different ``shapes`` the (box_id, iou) of the place in its image that it overlaps most, ties to
    the smallest box_id; without an overlap that is the image's smallest box_id. Two boxes meet in a cell of a grid whose cells are as
    wide as the larger one of them, up to a power of two, so a box stands in few cells of each size and only near boxes are compared."""
    corners = ["x1", "y1", "x2", "y2"]
    x = {c: F.col(c) for c in corners}
    least = places.groupBy(F.col("image").alias("_i")).agg(F.min("box_id").alias("box_id"))
    none = shapes.join(least, F.col("image") == F.col("_i"), "left").select("image", *corners, "box_id", F.lit(0.0).alias("iou"))
    whole = (x["x2"] > x["x1"]) & (x["y2"] > x["y1"]) & (F.greatest(*[F.abs(v) for v in x.values()]) < float("inf"))
    size = F.ceil(F.log2(F.greatest(x["x2"] - x["x1"], x["y2"] - x["y1"]))).cast("int")
    boxes = [scratch(df.where("image is not null").where(whole).withColumn("size", size), "boxes") for df in (places, shapes)]
    sizes = [sorted(r[0] for r in df.select("size").distinct().collect()) for df in boxes]

    def cells(df: DataFrame, level: Column) -> DataFrame:
        df = df.withColumn("_level", level)
        at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "_level"))
        return df.withColumn("_x", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("_y", F.explode(F.sequence(at("y1"), at("y2"))))

    def above(levels: Sequence[int], test) -> Column:
        return F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda m: test(m, F.col("size"))))

    t, p = boxes
    meets = [(cells(t, F.col("size")), cells(p, above(sizes[0], lambda m, s: m >= s))), (cells(t, above(sizes[1], lambda m, s: m > s)), cells(p, F.col("size")))]
    told = [none]
    for a, b in meets:
        a = a.select(F.col("image").alias("_i"), "box_id", *[F.col(c).alias(f"t_{c}") for c in corners], *[F.col(c).alias(f"_t{c}") for c in ("_level", "_x", "_y")])
        near = b.join(a, (F.col("image") == F.col("_i")) & (F.col("_level") == F.col("_t_level")) & (F.col("_x") == F.col("_t_x")) & (F.col("_y") == F.col("_t_y")))
        inter = area(F.greatest(x["x1"], F.col("t_x1")), F.greatest(x["y1"], F.col("t_y1")), F.least(x["x2"], F.col("t_x2")), F.least(x["y2"], F.col("t_y2")))
        union = area(*x.values()) + area(F.col("t_x1"), F.col("t_y1"), F.col("t_x2"), F.col("t_y2")) - inter
        told.append(near.select("image", *corners, "box_id", F.coalesce(F.try_divide(inter, union), F.lit(0.0)).alias("iou")))
    return reduce(DataFrame.unionByName, told).groupBy("image", *corners).agg(F.max_by(F.struct("box_id", "iou"), F.struct("iou", -F.col("box_id"))).alias("b"))


def detection_ap(truth: DataFrame, pred: DataFrame, iou: float = 0.5) -> DataFrame:
    """H12. truth(image, box_id, x1, y1, x2, y2), pred(image, pred_id, x1, y1, x2, y2, confidence).

    In the order of confidence a prediction takes the truth box it overlaps most, if that is enough and
    no better prediction wants the same box; the rest are false. Boxes at the same place in an image are compared once, and a box
    without a corner overlaps nothing. One row: the area under the precision envelope."""
    corners = ["x1", "y1", "x2", "y2"]
    area = lambda a, b, c, d: F.greatest(F.lit(0.0), c - a) * F.greatest(F.lit(0.0), d - b)
    placed = lambda df, *more: df.select("image", *[F.col(c).cast("double").alias(c) for c in corners], *more)
    places = scratch(placed(truth, "box_id").groupBy("image", *corners).agg(F.min("box_id").alias("box_id")), "places")
    shapes = scratch(placed(pred).distinct(), "shapes")
    told = _best_boxes(places, shapes, area).select(*[F.col(c).alias(f"_s_{c}") for c in ("image", *corners)], "b")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in ("image", *corners)])
    best = placed(pred, "pred_id", "confidence").join(told, on).groupBy("image", "pred_id", "confidence").agg(F.max_by("b", F.struct("b.iou", -F.col("b.box_id"))).alias("b"))
    best = scratch(best.select("image", "pred_id", "confidence", "b.box_id", "b.iou"), "detections")
    # the first that wants a box comes from an aggregate, as many may want the same one
    first = best.groupBy("image", "box_id").agg(F.min(F.struct(F.col("confidence").isNull().alias("no"), (-F.col("confidence")).alias("fall"), "pred_id", "iou")).alias("f"))
    first = first.where(F.col("f.iou") >= iou).select(F.col("image").alias("_i"), F.col("f.pred_id").alias("_p"), (-F.col("f.fall")).alias("_c"), F.lit(1).alias("tp"))
    wins = F.col("image").eqNullSafe(F.col("_i")) & F.col("pred_id").eqNullSafe(F.col("_p")) & F.col("confidence").eqNullSafe(F.col("_c"))
    hits = best.join(first, wins, "left").select("pred_id", "confidence", (-F.col("confidence")).alias("_fall"), F.coalesce("tp", F.lit(0)).alias("tp"))
    hits = scratch(hits, "detections")
    block = quantile_blocks(hits, "_fall", hits.count())
    order = [F.desc("confidence"), "pred_id"]
    curve = scan(hits, [], block, order, {"tps": ("sum", F.col("tp")), "k": ("sum", F.lit(1))})
    curve = scratch(curve.withColumn("precision", F.col("tps") / F.col("k")), "detections")
    curve = scan(curve, [], block, order, {"envelope": ("max", F.col("precision"))}, backwards=True)
    n = F.broadcast(truth.agg(F.count("*").alias("_n")))
    return curve.crossJoin(n).agg(F.coalesce(F.sum(F.col("tp") * F.col("envelope") / F.col("_n")), F.lit(0.0)).alias("value"))


def hamming(p: DataFrame, labels: int, by: Sequence[str] = BY) -> DataFrame:
    """H13. truth and pred are arrays: symmetric difference over the number of labels, averaged."""
    d = F.size(F.array_except("truth", "pred")) + F.size(F.array_except("pred", "truth"))
    return p.groupBy(*by).agg(F.avg(d / F.lit(labels)).alias("value"))


def score(p: DataFrame, metrics: Sequence[str], pos_label: str = "1", by: Sequence[str] = BY, k: int = 20, labels: int = 1, boxes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """H14. Rows (by, metric, value, larger); repeated metric names raise.

    Some metrics need more of ``p``: rocAucMicro and rocAucMacro the map ``scores``, hammingLoss arrays and the number of
    ``labels``, precisionAtTopK the ``k``, objectDetectionAP the tables ``boxes`` of truth and predictions, whose value all
    groups share. rootMeanSquaredErrorAvg is one value for all targets, under the target ``all``."""
    if len(set(metrics)) != len(metrics):
        raise ValueError("a metric is named twice")
    one = {
        "accuracy": lambda: accuracy(p, by), "f1Micro": lambda: f1_micro(p, by), "f1Macro": lambda: f1_macro(p, by), "jaccardSimilarityScore": lambda: jaccard(p, by),
        "normalizedMutualInformation": lambda: nmi(p, by), "rSquared": lambda: r2(p, by), "rocAuc": lambda: roc_auc(p, pos_label, by),
        **{m: lambda c=c: prf(p, pos_label, by).select(*by, F.col(c).alias("value")) for m, c in (("precision", "precision"), ("recall", "recall"), ("f1", "f1"))},
        **{m: lambda c=c: errors(p, by).select(*by, F.col(c).alias("value")) for m, c in (("meanSquaredError", "mse"), ("rootMeanSquaredError", "rmse"), ("meanAbsoluteError", "mae"))},
        "rocAucMicro": lambda: roc_auc_micro(p, by), "rocAucMacro": lambda: roc_auc_macro(p, by), "precisionAtTopK": lambda: precision_at_k(p, k, by), "hammingLoss": lambda: hamming(p, labels, by),
        "rootMeanSquaredErrorAvg": lambda: rmse_avg(p, [b for b in by if b != "target"]).withColumn("target", F.lit("all")).select(*by, "value"),
        "objectDetectionAP": lambda: p.select(*by).distinct().crossJoin(F.broadcast(detection_ap(*boxes))),
    }
    larger = dict(DIRECTIONS)
    parts = [one[m]().withColumn("metric", F.lit(m)).withColumn("larger", F.lit(larger[m])) for m in metrics]
    return reduce(DataFrame.unionByName, parts)


def normalize_score(scores: DataFrame) -> DataFrame:
    """H15. Bounded metrics stand as they are (hamming loss turned round); errors become 1 / (1 + v)."""
    v = F.col("value")
    unbounded = F.col("metric").isin("meanSquaredError", "rootMeanSquaredError", "meanAbsoluteError", "rootMeanSquaredErrorAvg")
    return scores.withColumn("normalized", F.when(unbounded, 1 / (1 + v)).when(F.col("metric") == "hammingLoss", 1 - v).when(F.col("metric") == "rSquared", F.greatest(v, F.lit(0.0))).otherwise(v))


def mean_folds(scores: DataFrame) -> DataFrame:
    """H16. Mean over folds with the folds' values in order."""
    return scores.groupBy("candidate_id", "target", "metric").agg(F.avg("value").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda x: x["value"]).alias("values"))


def combine_folds(frames: Sequence[DataFrame]) -> DataFrame:
    """H17. Fold tables below each other with their number."""
    return reduce(DataFrame.unionByName, [f.withColumn("fold", F.lit(i)) for i, f in enumerate(frames)])


def with_seed(scores: DataFrame, seed: int) -> DataFrame:
    """H17."""
    return scores.withColumn("seed", F.lit(seed))


def rank_value(value: Column, larger: Column, key: Column) -> Column:
    """H18. 1 / v if larger is better (1e5 for v <= 0), else v; a little noise by id breaks ties."""
    return F.when(larger, F.when(value > 0, 1 / value).otherwise(F.lit(1e5))).otherwise(value) * (1 + 1e-4 * u(key, "rank"))
