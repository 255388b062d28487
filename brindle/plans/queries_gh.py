"""Queries over the given tables: splits and scores (G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import query
from brindle.functions import metrics
from brindle.functions.keys import u, u_sql
from brindle.operators import split
from brindle.plans.queries_df import PREDS, candidates, r
from brindle.session import table

U = u_sql("o_orderkey")


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("g1_split_holdout", f"SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {U}, o_orderkey) > count(*) OVER (PARTITION BY o_orderstatus) - floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END AS part FROM orders")
def g1(spark, d):
    return split.split_holdout(orders(spark, d), "o_orderkey", 0.2, "o_orderstatus").select("o_orderkey", "part")


@query("g2_split_kfold", f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {U}, o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def g2(spark, d):
    return split.split_kfold(orders(spark, d), "o_orderkey").select("o_orderkey", "fold")


@query("g3_split_stratified", f"SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {U}, o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def g3(spark, d):
    return split.split_stratified(orders(spark, d), "o_orderkey", "o_orderstatus").select("o_orderkey", "fold")


@query("g4_split_time", "SELECT o_orderkey, ntile(6) OVER (ORDER BY o_orderdate, o_orderkey)::INT AS tile FROM orders")
def g4(spark, d):
    return split.split_time(orders(spark, d), "o_orderdate", "o_orderkey").select("o_orderkey", "tile")


@query("g5_nested_splits", f"SELECT o_orderkey, CASE WHEN {u_sql('o_orderkey', 'one')} < 0.1 THEN 'test1' WHEN {u_sql('o_orderkey', 'two')} < 0.2 THEN 'test2' WHEN {u_sql('o_orderkey', 'three')} < 0.1 THEN 'ensemble' ELSE 'train' END AS split FROM orders")
def g5(spark, d):
    return split.nested_splits(orders(spark, d), "o_orderkey", 5, 0.1).select("o_orderkey", "split")


@query("g6_weighted_sample", f"SELECT o_orderkey FROM orders ORDER BY -ln(greatest({U}, 1e-12)) / o_totalprice, o_orderkey LIMIT 50")
def g6(spark, d):
    return split.weighted_sample(orders(spark, d), "o_orderkey", "o_totalprice", 50).select("o_orderkey")


@query("g7_weighted_choice", f"WITH s AS (SELECT p_partkey, p_retailprice AS w, sum(p_retailprice) OVER (ORDER BY p_partkey) AS hi FROM part), t AS (SELECT sum(p_retailprice) AS t FROM part), g AS (SELECT range AS draw, {u_sql('range')} * t AS u FROM range(100) CROSS JOIN t) SELECT draw, p_partkey FROM g JOIN s ON u < hi AND u >= hi - w")
def g7(spark, d):
    return split.weighted_choice(table(spark, d, "part"), "p_partkey", "p_retailprice", 100)


P = f"(SELECT p.candidate_id, (p.row_id % 3)::INT AS fold, 'status' AS target, p.row_id, o_orderstatus AS truth, p.pred, {u_sql('p.row_id', 'conf')} AS confidence FROM {PREDS} p JOIN orders ON o_orderkey = p.row_id)"
BY = "candidate_id, fold, target"


def predictions(spark, d):
    truth = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("truth"))
    p = candidates(spark, d).join(truth, "row_id").withColumns({"fold": (F.col("row_id") % 3).cast("int"), "target": F.lit("status"), "confidence": u("row_id", "conf")})
    return p.select("candidate_id", "fold", "target", "row_id", "truth", "pred", "confidence")


def numbers(spark, d):
    """Regression: price predicted from the customer's number, for two candidates."""
    o = table(spark, d, "orders")
    preds = F.array(*[F.struct(F.lit(f"r{i}").alias("candidate_id"), p.cast("string").alias("pred")) for i, p in enumerate([F.lit(250_000.0), F.col("o_custkey") * 10.0 + 200_000])])
    return o.select(F.col("o_orderkey").alias("row_id"), F.inline(preds), F.col("o_totalprice").cast("string").alias("truth"), (F.col("o_orderkey") % 2).cast("int").alias("fold"), F.lit("price").alias("target"))


N = "(SELECT o_orderkey AS row_id, 'r' || c AS candidate_id, CASE c WHEN 0 THEN 250000.0 ELSE o_custkey * 10.0 + 200000 END AS pred, o_totalprice AS truth, (o_orderkey % 2)::INT AS fold, 'price' AS target FROM orders CROSS JOIN range(2) t(c))"


@query("h1_accuracy", f"SELECT {BY}, round(avg((truth = pred)::INT), 6) AS value FROM {P} GROUP BY ALL")
def h1(spark, d):
    return metrics.accuracy(predictions(spark, d)).withColumn("value", F.round("value", 6))


@query("h2_prf", f"""SELECT {BY}, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
 FROM (SELECT {BY}, count(*) FILTER (truth = 'F' AND pred = 'F') AS tp, count(*) FILTER (truth <> 'F' AND pred = 'F') AS fp, count(*) FILTER (truth = 'F' AND pred <> 'F') AS fn FROM {P} GROUP BY ALL)""")
def h2(spark, d):
    x = metrics.prf(predictions(spark, d), "F")
    return x.select("candidate_id", "fold", "target", r("precision", 6), r("recall", 6), r("f1", 6))


CLASSES = f"""(SELECT {BY}, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT {BY}, truth AS class, (truth = pred)::INT AS tp, 0 AS fp, (truth <> pred)::INT AS fn FROM {P}
 UNION ALL SELECT {BY}, pred, 0, (truth <> pred)::INT, 0 FROM {P}) GROUP BY ALL)"""


@query("h3_f1_micro", f"SELECT {BY}, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS value FROM {CLASSES} GROUP BY ALL")
def h3i(spark, d):
    return metrics.f1_micro(predictions(spark, d)).withColumn("value", F.round("value", 6))


@query("h3_f1_macro", f"SELECT {BY}, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS value FROM {CLASSES} GROUP BY ALL")
def h3a(spark, d):
    return metrics.f1_macro(predictions(spark, d)).withColumn("value", F.round("value", 6))


AUC = """SELECT {by}, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / nullif(count(*) FILTER (pos) * count(*) FILTER (NOT pos), 0), 6) AS value
 FROM (SELECT {by}, pos, rank() OVER (PARTITION BY {by} ORDER BY s) + (count(*) OVER (PARTITION BY {by}, s) - 1) / 2 AS rk FROM {src}) GROUP BY ALL"""


@query("h4_roc_auc", AUC.format(by=BY, src=f"(SELECT {BY}, truth = 'F' AS pos, round(confidence, 2) AS s FROM {P})"))
def h4(spark, d):
    p = predictions(spark, d).withColumn("confidence", F.round("confidence", 2))
    return metrics.roc_auc(p, "F").withColumn("value", F.round("value", 6))


SCORES = f"(SELECT {BY}, truth = c.class AS pos, c.class AS class, round(CASE WHEN pred = c.class THEN confidence ELSE (1 - confidence) / 2 END, 2) AS s FROM {P} CROSS JOIN (VALUES ('F'), ('O'), ('P')) c(class))"


def scored(spark, d):
    p = predictions(spark, d)
    s = lambda c: F.round(F.when(F.col("pred") == c, F.col("confidence")).otherwise((1 - F.col("confidence")) / 2), 2)
    return p.withColumn("scores", F.create_map(*[x for c in ("F", "O", "P") for x in (F.lit(c), s(c))]))


@query("h5_roc_auc_micro", AUC.format(by=BY, src=SCORES))
def h5i(spark, d):
    return metrics.roc_auc_micro(scored(spark, d)).withColumn("value", F.round("value", 6))


@query("h5_roc_auc_macro", f"SELECT {BY}, round(avg(value), 5) AS value FROM ({AUC.format(by=BY + ', class', src=SCORES).replace(', 6)', ', 12)')}) GROUP BY ALL")
def h5a(spark, d):
    return metrics.roc_auc_macro(scored(spark, d)).withColumn("value", F.round("value", 5))


@query("h6_errors", f"SELECT {BY}, round(avg(pow(truth - pred, 2)) / 1e6, 4) AS mse, round(sqrt(avg(pow(truth - pred, 2))), 4) AS rmse, round(avg(abs(truth - pred)), 4) AS mae FROM {N} GROUP BY ALL")
def h6(spark, d):
    return metrics.errors(numbers(spark, d)).select("candidate_id", "fold", "target", F.round(F.col("mse") / 1e6, 4).alias("mse"), r("rmse"), r("mae"))


@query("h7_rmse_avg", f"SELECT candidate_id, fold, round(avg(v), 4) AS value FROM (SELECT candidate_id, fold, target, sqrt(avg(pow(truth - pred, 2))) AS v FROM (SELECT * FROM {N} UNION ALL SELECT row_id, candidate_id, pred * 2, truth, fold, 'other' FROM {N}) GROUP BY ALL) GROUP BY ALL")
def h7(spark, d):
    n = numbers(spark, d)
    other = n.withColumns({"pred": (F.col("pred").cast("double") * 2).cast("string"), "target": F.lit("other")})
    return metrics.rmse_avg(n.unionByName(other)).withColumn("value", F.round("value", 4))


@query("h8_r2", f"SELECT {BY}, round(1 - avg(pow(truth - pred, 2)) / var_pop(truth), 6) AS value FROM {N} GROUP BY ALL")
def h8(spark, d):
    return metrics.r2(numbers(spark, d)).withColumn("value", F.round("value", 6))


@query("h9_nmi", f"""WITH c AS (SELECT {BY}, truth, pred, count(*) AS n FROM {P} GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY {BY}) AS a, sum(n) OVER (PARTITION BY {BY}, truth) AS t, sum(n) OVER (PARTITION BY {BY}, pred) AS q FROM c),
x AS (SELECT {BY}, sum(n / a * ln(n * a / (t * q))) AS i, -sum(n / a * ln(t / a)) AS ht, -sum(n / a * ln(q / a)) AS hq FROM w GROUP BY ALL) SELECT {BY}, round(CASE WHEN ht + hq <= 1e-12 THEN 1 ELSE i / ((ht + hq) / 2) END + 0.0, 6) AS value FROM x""")
def h9(spark, d):
    return metrics.nmi(predictions(spark, d)).withColumn("value", F.round(F.col("value") + 0.0, 6))


@query("h10_jaccard", f"SELECT {BY}, round(avg(tp / (tp + fp + fn)), 6) AS value FROM {CLASSES} GROUP BY ALL")
def h10(spark, d):
    return metrics.jaccard(predictions(spark, d)).withColumn("value", F.round("value", 6))


@query("h11_precision_at_k", f"SELECT {BY}, count(*) FILTER (t <= 200 AND q <= 200) / 200 AS value FROM (SELECT {BY}, row_number() OVER (PARTITION BY {BY} ORDER BY truth DESC, row_id) AS t, row_number() OVER (PARTITION BY {BY} ORDER BY pred DESC, row_id) AS q FROM {N}) GROUP BY ALL")
def h11(spark, d):
    return metrics.precision_at_k(numbers(spark, d), 200)


BOX_T = f"(SELECT (p_partkey % 40) AS image, p_partkey AS box_id, 20.0 * p_size AS x1, 0.0 AS y1, 20.0 * p_size + 18 AS x2, 18.0 AS y2 FROM part)"
BOX_P = f"(SELECT (p_partkey % 40) AS image, p_partkey AS pred_id, 20.0 * p_size + p_partkey % 13 AS x1, 0.0 AS y1, 20.0 * p_size + 18 + p_partkey % 13 AS x2, 18.0 AS y2, {u_sql('p_partkey', 'box')} AS confidence FROM part)"


@query("h12_detection_ap", f"""WITH t AS {BOX_T}, p AS {BOX_P}, j AS (SELECT p.image, pred_id, confidence, box_id, greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS s FROM p LEFT JOIN t USING (image)),
b AS (SELECT *, coalesce(i / (s - i), 0) AS iou FROM j QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY coalesce(i / (s - i), 0) DESC, box_id) = 1),
h AS (SELECT *, CASE WHEN iou >= 0.5 AND row_number() OVER (PARTITION BY image, box_id ORDER BY confidence DESC, pred_id) = 1 THEN 1 ELSE 0 END AS tp FROM b),
c AS (SELECT tp, row_number() OVER w AS k, sum(tp) OVER w AS tps FROM h WINDOW w AS (ORDER BY confidence DESC, pred_id)),
e AS (SELECT tp, max(tps / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c) SELECT round(sum(tp * env) / (SELECT count(*) FROM t), 6) AS value FROM e""")
def h12(spark, d):
    p = table(spark, d, "part")
    at, shift = F.col("p_size") * 20.0, F.col("p_partkey") % 13
    truth = p.select((F.col("p_partkey") % 40).alias("image"), F.col("p_partkey").alias("box_id"), at.alias("x1"), F.lit(0.0).alias("y1"), (at + 18).alias("x2"), F.lit(18.0).alias("y2"))
    pred = p.select((F.col("p_partkey") % 40).alias("image"), F.col("p_partkey").alias("pred_id"), (at + shift).alias("x1"), F.lit(0.0).alias("y1"), (at + 18 + shift).alias("x2"), F.lit(18.0).alias("y2"), u("p_partkey", "box").alias("confidence"))
    return metrics.detection_ap(truth, pred).withColumn("value", F.round("value", 6))


@query("h13_hamming", "WITH s AS (SELECT o_custkey, list_distinct(list(o_orderstatus)) AS t, list_distinct(list(CASE WHEN o_totalprice > 250000 THEN 'F' ELSE o_orderstatus END)) AS q FROM orders GROUP BY 1) SELECT (o_custkey % 4)::INT AS fold, round(avg((len(list_filter(t, lambda x: NOT list_contains(q, x))) + len(list_filter(q, lambda x: NOT list_contains(t, x)))) / 3), 6) AS value FROM s GROUP BY 1")
def h13(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("truth"), F.collect_set(F.when(F.col("o_totalprice") > 250000, "F").otherwise(F.col("o_orderstatus"))).alias("pred"))
    return metrics.hamming(s.withColumn("fold", (F.col("o_custkey") % 4).cast("int")), 3, ["fold"]).withColumn("value", F.round("value", 6))


H14 = f"SELECT {BY}, round(avg((truth = pred)::INT), 6) AS value, 'accuracy' AS metric, true AS larger FROM {P} GROUP BY {BY} UNION ALL SELECT {BY}, round(avg(2 * tp / (2 * tp + fp + fn)), 6), 'f1Macro', true FROM {CLASSES} GROUP BY {BY} UNION ALL SELECT {BY}, value, 'rocAucMicro', true FROM ({AUC.format(by=BY, src=SCORES)}) UNION ALL SELECT {BY}, round(avg(value), 6), 'rocAucMacro', true FROM ({AUC.format(by=BY + ', class', src=SCORES).replace(', 6)', ', 12)')}) GROUP BY {BY}"


@query("h14_score", H14)
def h14(spark, d):
    return metrics.score(scored(spark, d), ["accuracy", "f1Macro", "rocAucMicro", "rocAucMacro"]).withColumn("value", F.round("value", 6))


@query("h14_score_numbers", f"SELECT candidate_id, fold, 'all' AS target, round(avg(v), 4) AS value, 'rootMeanSquaredErrorAvg' AS metric, false AS larger FROM (SELECT {BY}, sqrt(avg(pow(truth - pred, 2))) AS v FROM {N} GROUP BY ALL) GROUP BY ALL UNION ALL SELECT {BY}, round(count(*) FILTER (t <= 20 AND q <= 20) / 20, 4), 'precisionAtTopK', true FROM (SELECT {BY}, row_number() OVER (PARTITION BY {BY} ORDER BY truth DESC, row_id) AS t, row_number() OVER (PARTITION BY {BY} ORDER BY pred DESC, row_id) AS q FROM {N}) GROUP BY {BY}")
def h14n(spark, d):
    return metrics.score(numbers(spark, d), ["rootMeanSquaredErrorAvg", "precisionAtTopK"]).withColumn("value", F.round("value", 4))


@query("h15_normalize_score", f"SELECT {BY}, round(1 / (1 + sqrt(avg(pow(truth - pred, 2)))), 9) AS normalized, 'rootMeanSquaredError' AS metric FROM {N} GROUP BY {BY}")
def h15(spark, d):
    s = metrics.normalize_score(metrics.score(numbers(spark, d), ["rootMeanSquaredError"]))
    return s.select("candidate_id", "fold", "target", r("normalized", 9), "metric")


@query("h16_mean_folds", f"SELECT candidate_id, target, 'accuracy' AS metric, round(avg(value), 5) AS mean, array_to_string(list(round(value, 4) ORDER BY fold), ',') AS values FROM (SELECT {BY}, avg((truth = pred)::INT) AS value FROM {P} GROUP BY ALL) GROUP BY ALL")
def h16(spark, d):
    s = metrics.mean_folds(metrics.score(predictions(spark, d), ["accuracy"]))
    return s.select("candidate_id", "target", "metric", r("mean", 5), F.array_join(F.transform("values", lambda x: F.round(x, 4).cast("string")), ",").alias("values"))


@query("h17_combine_folds", "SELECT o_orderkey, (o_orderkey % 2)::INT AS fold, 4767 AS seed FROM orders")
def h17(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return metrics.with_seed(metrics.combine_folds([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")]), 4767)


@query("h18_rank_value", f"SELECT o_orderkey, round(CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_totalprice - 100000 > 0 THEN 1 / (o_totalprice - 100000) ELSE 1e5 END ELSE o_totalprice - 100000 END * (1 + 1e-4 * {u_sql('o_orderkey', 'rank')}), 4) AS rank FROM orders")
def h18(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(metrics.rank_value(F.col("o_totalprice") - 100000, F.col("o_custkey") % 2 == 0, F.col("o_orderkey")), 4).alias("rank"))
