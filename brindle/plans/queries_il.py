"""Queries over the given tables: models, search, streams, user surface (A9, I, J, K, L)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from brindle.catalog import query
from brindle.functions import metrics, user
from brindle.functions.keys import u, u_sql
from brindle.operators import linear, models, neighbours, relate, split, trees, vertices
from brindle.plans import jobs, search
from brindle.plans.queries_ac import REPORTS, folder, reports
from brindle.plans.queries_df import FEATURES, LKEY, PREDS, candidates, lines, r
from brindle.session import scratch, table
from brindle.sources import datasets
from brindle.streaming import reports as streams

CUT = 0.2


def parts(spark, d, label: str = "l_returnflag"):
    """(train, test) rows of lineitem by the key's bucket, with numeric features."""
    li = lines(spark, d).select("row_id", *FEATURES, label, "l_linestatus" if label != "l_linestatus" else "l_returnflag")
    return li.where(u("row_id") >= CUT), li.where(u("row_id") < CUT)


TEST = f"{u_sql('row_id')} < {CUT}"
LI = f"(SELECT *, {LKEY} AS row_id FROM lineitem)"


@query("a9_save_fitted")
def a9(spark, d):
    train, test = parts(spark, d)
    at = folder(spark, "fitted")
    datasets.save_fitted(models.fit_classifier("decision_tree", train, FEATURES, "l_returnflag"), at, "f1")
    return models.predict(datasets.load_fitted(at, "f1"), test, "row_id")


@query("i1_dummy", f"SELECT row_id, (SELECT l_returnflag FROM {LI} WHERE NOT {TEST} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS pred, 1.0::DOUBLE AS confidence FROM {LI} WHERE {TEST}")
def i1(spark, d):
    train, test = parts(spark, d)
    return models.predict_dummy(models.fit_dummy(train, "l_returnflag"), test, "row_id")


NB_STATS = f"(SELECT l_linestatus AS class, count(*) AS n, avg(l_quantity) AS m1, greatest(var_pop(l_quantity), 1e-9 * (SELECT var_pop(l_quantity) FROM {LI} WHERE NOT {TEST})) AS v1, avg(l_tax) AS m2, greatest(var_pop(l_tax), 1e-9 * (SELECT var_pop(l_quantity) FROM {LI} WHERE NOT {TEST})) AS v2 FROM {LI} WHERE NOT {TEST} GROUP BY 1)"


@query("i10_gaussian_nb", f"""WITH s AS {NB_STATS}, t AS (SELECT sum(n) AS total FROM s),
p AS (SELECT row_id, class, ln(n / total) - 0.5 * ln(2 * pi() * v1) - pow(l_quantity - m1, 2) / (2 * v1) - 0.5 * ln(2 * pi() * v2) - pow(l_tax - m2, 2) / (2 * v2) AS l FROM {LI} CROSS JOIN s CROSS JOIN t WHERE {TEST})
SELECT row_id, first(class ORDER BY l DESC, class) AS pred, round(1 / sum(exp(l - m)), 6) AS confidence FROM (SELECT *, max(l) OVER (PARTITION BY row_id) AS m FROM p) GROUP BY 1""")
def i10(spark, d):
    train, test = parts(spark, d, "l_linestatus")
    model = models.fit_gaussian_nb(train, ["l_quantity", "l_tax"], "l_linestatus")
    return models.predict_gaussian_nb(model, test, ["l_quantity", "l_tax"], "row_id").withColumn("confidence", F.round("confidence", 6))


@query("i10_bernoulli_nb")
def i10b(spark, d):
    train, test = [x.withColumns({"cheap": (F.col("l_extendedprice") < 20_000).cast("int"), "few": (F.col("l_quantity") < 20).cast("int"), "untaxed": (F.col("l_tax") == 0).cast("int")}) for x in parts(spark, d)]
    return models.predict(models.fit_classifier("bernoulli_nb", train, ["cheap", "few", "untaxed"], "l_returnflag"), test, "row_id")


@query("i10_other_nb")
def i10o(spark, d):
    train, test = parts(spark, d)
    return models.predict(models.fit_classifier("multinomial_nb", train, FEATURES, "l_returnflag"), test, "row_id")


def _classifier(name: str, label: str = "l_returnflag", **params):
    def run(spark, d):
        train, test = parts(spark, d, label)
        return models.predict(models.fit_classifier(name, train, FEATURES, label, **params), test, "row_id")

    return run


def _regressor(name: str, **params):
    def run(spark, d):
        train, test = parts(spark, d)
        names = [c for c in FEATURES if c != "l_extendedprice"]
        return models.predict(models.fit_regressor(name, train, names, "l_extendedprice", **params), test, "row_id")

    return run


query("i2_random_forest")(_classifier("random_forest", trees=5, depth=4))
query("i2_random_forest_regressor")(_regressor("random_forest", trees=5, depth=4))
query("i4_gradient_boosting")(_classifier("gradient_boosting", trees=2, depth=2))
query("i4_gradient_boosting_regressor")(_regressor("gradient_boosting", trees=3))
query("i5_decision_tree")(_regressor("decision_tree"))
query("i6_bagging")(_regressor("bagging", trees=4, depth=4))
query("i7_logistic_regression")(_classifier("logistic_regression"))
query("i8_linear_svc")(_classifier("linear_svc"))
query("i13_sgd")(_regressor("sgd"))
query("i13_passive_aggressive")(_classifier("passive_aggressive"))


@query("i3_extra_trees")
def i3(spark, d):
    train, test = parts(spark, d)
    return models.extra_trees(train, test, FEATURES, "l_returnflag", "row_id", trees=2)


@query("i3_extra_trees_levels")
def i3_levels(spark, d):
    train, test = parts(spark, d)
    return trees.predict_extra_trees(trees.fit_extra_trees(train, FEATURES, "l_returnflag"), test, "row_id")


@query("i3_extra_trees_regressor")
def i3_regressor(spark, d):
    train, test = parts(spark, d)
    names = [c for c in FEATURES if c != "l_extendedprice"]
    return trees.predict_extra_trees(trees.fit_extra_trees(train, names, "l_extendedprice", classification=False), test, "row_id")


@query("i9_kernel_svm")
def i9(spark, d):
    train, test = parts(spark, d)
    return models.kernel_svm(train, test, FEATURES, "l_returnflag", "row_id")


DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))))"
NEAR = f"(SELECT a.vec_id, b.label FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DIST}, 9), b.vec_id) <= 5)"


@query("i11_knn", f"SELECT vec_id, label AS pred, n / 5 AS confidence FROM (SELECT vec_id, label, count(*) AS n FROM {NEAR} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1")
def i11(spark, d):
    e = table(spark, d, "embeddings")
    return models.knn_predict(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "label", 5, same=True)


@query("i12_lda")
def i12(spark, d):
    train, test = parts(spark, d)
    return models.predict_lda(models.fit_lda(train, FEATURES, "l_returnflag"), test, FEATURES, "row_id")


@query("i14_ridge", f"WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1) AS w, avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM {LI} WHERE NOT {TEST}) SELECT row_id, round(y + w * (l_quantity - x), 3) AS pred, 1.0::DOUBLE AS confidence FROM {LI} CROSS JOIN s WHERE {TEST}")
def i14(spark, d):
    train, test = parts(spark, d)
    return models.predict_linear(models.fit_ridge(train, ["l_quantity"], "l_extendedprice"), test, ["l_quantity"], "row_id").withColumn("pred", F.round("pred", 3))


@query("i15_lasso_path")
def i15(spark, d):
    return models.lasso_path(parts(spark, d)[0], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


_PATH_SQL = f"""WITH m AS (SELECT sqrt(count(*)) AS t, avg(l_extendedprice) AS y, stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, corr(l_quantity, l_discount) AS r,
  covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) * sqrt(count(*)) AS c1, covar_pop(l_discount, l_extendedprice) / stddev_pop(l_discount) * sqrt(count(*)) AS c2 FROM {LI} WHERE NOT {TEST}),
f AS (SELECT *, abs(c1) >= abs(c2) AS one, greatest(abs(c1), abs(c2)) AS c, CASE WHEN abs(c1) >= abs(c2) THEN c2 ELSE c1 END AS o, r * sign(CASE WHEN abs(c1) >= abs(c2) THEN c1 ELSE c2 END) AS a FROM m),
g AS (SELECT *, least((c - o) / (1 - a), (c + o) / (1 + a)) AS go FROM f),
k AS (SELECT 0 AS step, c AS penalty, 0.0 AS w1, 0.0 AS w2 FROM g
  UNION ALL SELECT 1, c - go, CASE WHEN one THEN sign(c1) * go / s1 / t ELSE 0 END, CASE WHEN one THEN 0 ELSE sign(c2) * go / s2 / t END FROM g
  UNION ALL SELECT 2, 0, (c1 - r * c2) / (1 - r * r) / s1 / t, (c2 - r * c1) / (1 - r * r) / s2 / t FROM g)
SELECT step::INT AS step, round(penalty, 2) AS penalty, 'l_quantity' AS feature, round(w1, 3) AS weight FROM k UNION ALL SELECT step::INT, round(penalty, 2), 'l_discount', round(w2, 3) FROM k"""


@query("i15_least_angle", _PATH_SQL)
def i15_path(spark, d):
    return linear.least_angle_path(parts(spark, d)[0], ["l_quantity", "l_discount"], "l_extendedprice").select("step", r("penalty", 2), "feature", r("weight", 3))


@query("i13_passive_aggressive_rounds")
def i13_rounds(spark, d):
    train, test = parts(spark, d)
    return models.predict_lda(linear.fit_passive_aggressive(train, FEATURES, "l_returnflag", "row_id"), test, FEATURES, "row_id")


@query("i13_passive_aggressive_regressor")
def i13_regressor(spark, d):
    train, test = parts(spark, d)
    names = [c for c in FEATURES if c != "l_extendedprice"]
    return models.predict_linear(linear.fit_passive_aggressive_regressor(train, names, "l_extendedprice", "row_id"), test, names, "row_id")


@query("i16_mlp")
def i16(spark, d):
    train, test = parts(spark, d)
    return models.predict(models.fit_mlp(train, FEATURES, "l_returnflag", 3), test, "row_id")


@query("i17_multilabel")
def i17(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumns({"words": F.size(F.split("text", " ")).cast("double"), "chars": F.col("n_chars").cast("double")})
    docs = docs.select("doc_id", "quality", "toxic", "words", "chars")
    return models.multilabel(docs.where(u("doc_id") >= CUT), docs.where(u("doc_id") < CUT), ["words", "chars"], ["quality", "toxic"], "doc_id")


@query("i18_best_forest")
def i18(spark, d):
    train, test = parts(spark, d)
    model, _ = models.best_forest(train, test, FEATURES, "l_returnflag", "row_id", [{"trees": 2, "depth": 2}, {"trees": 3, "depth": 3}])
    return models.predict(model, test, "row_id")


@query("i19_self_training")
def i19(spark, d):
    train, test = parts(spark, d)
    model = models.self_training(train.where(u("row_id", "few") < 0.3), train.where(u("row_id", "few") >= 0.3), FEATURES, "l_returnflag", "row_id", rounds=1)
    return models.predict(model, test, "row_id")


@query("i20_privileged")
def i20(spark, d):
    train, test = parts(spark, d)
    return models.privileged_forest(train, test, ["l_quantity", "l_extendedprice"], ["l_tax", "l_discount"], "l_returnflag", "row_id")


@query("i21_vote", f"SELECT row_id, pred, round(s, 6) AS confidence FROM (SELECT row_id, pred, sum({u_sql('row_id', 'conf')}) AS s FROM {PREDS} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(s, 9) DESC, pred) = 1")
def i21(spark, d):
    return models.vote(candidates(spark, d).withColumn("confidence", u("row_id", "conf")), "row_id").withColumn("confidence", F.round("confidence", 6))


@query("i22_stack")
def i22(spark, d):
    c = candidates(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    return models.stack([c.where(F.col("candidate_id") == f"c{i}") for i in (1, 2, 3)], o, "o_orderstatus", "row_id")


@query("i22_stack_folds")
def i22_folds(spark, d):
    train, test = parts(spark, d)
    return models.stack_folds(train.unionByName(test), FEATURES, "l_returnflag", "row_id")


@query("i23_collaborative")
def i23(spark, d):
    ratings = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("u"), F.col("l_partkey").cast("int").alias("i")).agg(F.avg("l_quantity").cast("float").alias("v"))
    return models.collaborative(ratings, "u", "i", "v").transform(ratings).select("u", "i", "prediction")


@query("i24_cluster")
def i24(spark, d):
    return models.cluster(table(spark, d, "embeddings"), "embedding", 4).select("vec_id", "cluster")


@query("i24_cluster_best")
def i24_best(spark, d):
    return models.cluster_best(table(spark, d, "embeddings"), "embedding")[1].select("vec_id", "cluster")


def _apart(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(range(1, 65), lambda i: pow({a}[i]::DOUBLE - {b}[i]::DOUBLE, 2))))"


#: The tree's first three nodes: the smallest key, the row furthest from it, and the row furthest from the nearer of both.
_NODES_SQL = f"""WITH n0 AS (SELECT embedding AS a FROM embeddings ORDER BY vec_id LIMIT 1),
n1 AS (SELECT embedding AS b FROM embeddings, n0 ORDER BY {_apart('embedding', 'a')} DESC, vec_id LIMIT 1),
n2 AS (SELECT embedding AS c FROM embeddings, n0, n1 ORDER BY least({_apart('embedding', 'a')}, {_apart('embedding', 'b')}) DESC, vec_id LIMIT 1),
d AS (SELECT vec_id, {_apart('embedding', 'a')} AS x, {_apart('embedding', 'b')} AS y, {_apart('embedding', 'c')} AS z FROM embeddings, n0, n1, n2)"""


@query("i24_cover_tree", f"{_NODES_SQL} SELECT vec_id, (CASE WHEN x <= least(y, z) THEN 0 WHEN y <= z THEN 1 ELSE 2 END)::INT AS cluster FROM d")
def i24_tree(spark, d):
    return neighbours.cluster_tree(table(spark, d, "embeddings"), "vec_id", "embedding", 3).select("vec_id", "cluster")


@query("i25_gaussian_clusters")
def i25(spark, d):
    return models.gaussian_clusters(table(spark, d, "embeddings"), "embedding", (2, 3, 4))[1].select("vec_id", "cluster")


DAILY = "(SELECT event_type, ts::DATE AS day, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"


@query("i26_ar1", f"WITH l AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY day) AS x FROM {DAILY}) SELECT event_type, round(regr_slope(v, x), 6) AS slope, round(regr_intercept(v, x), 4) AS intercept, round(regr_slope(v, x) * arg_max(v, day) + regr_intercept(v, x), 4) AS forecast FROM l GROUP BY 1")
def i26(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))
    return models.fit_ar1(daily, "event_type", "day", "v").select("event_type", r("slope", 6), r("intercept"), r("forecast"))


@query("i26_ar_log", f"WITH l AS (SELECT event_type, day, ln(v) AS y, lag(ln(v)) OVER (PARTITION BY event_type ORDER BY day) AS x FROM {DAILY}) SELECT event_type, 1::INT AS \"order\", round(exp(regr_slope(y, x) * arg_max(y, day) + regr_intercept(y, x)), 3) AS forecast FROM l GROUP BY 1")
def i26_log(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))
    return models.fit_ar(daily, "event_type", "day", "v", take_log=True).select("event_type", "order", r("forecast", 3))


@query("i26_ar_order")
def i26_order(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))
    return models.fit_ar(daily, "event_type", "day", "v", orders=(1, 2, 3))


WEEK = "(SELECT user_id, [" + ", ".join(f"round(coalesce(sum(value) FILTER (dayofweek(ts) = {k}), 0), 4)" for k in range(7)) + "] AS w, (user_id % 2)::INT AS label FROM events GROUP BY 1)"
_WEEKS_APART = "round(sqrt(list_sum(list_transform(range(1, 8), lambda i: pow(x.w[i] - y.w[i], 2)))), 9)"


@query("i27_series_knn", f"""WITH s AS {WEEK},
n AS (SELECT x.user_id, y.label FROM s x JOIN s y ON x.user_id <> y.user_id WHERE x.user_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY x.user_id ORDER BY {_WEEKS_APART}, y.user_id) <= 3)
SELECT user_id, label AS pred FROM (SELECT user_id, label, count(*) AS n FROM n GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) = 1""")
def i27(spark, d):
    """Queries are the users whose id is divisible by 50, against all users."""
    day = lambda k: F.round(F.coalesce(F.sum(F.when(F.dayofweek("ts") == k + 1, F.col("value"))), F.lit(0.0)), 4)
    s = table(spark, d, "events").groupBy("user_id").agg(F.array(*map(day, range(7))).alias("series")).withColumn("label", (F.col("user_id") % 2).cast("int"))
    return models.knn_predict(s, s.where("user_id % 50 = 0"), "user_id", "series", "label", 3, same=True).select("user_id", "pred")


def edges(spark, d, where="true"):
    """Supplier to part edges of all lines; parts are numbered from a million."""
    return table(spark, d, "lineitem").where(where).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).distinct()


EDGES = "(SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem)"
#: Labels by node: a row replaces the node's former one, as long as a neighbour's is smaller.
COMPONENTS = f"""WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}),
r(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.src, min(r.component) FROM r JOIN e ON e.dst = r.node JOIN recurring.r AS o ON o.node = e.src GROUP BY e.src, o.component HAVING min(r.component) < o.component)"""


@query("i28_largest_component", f"{COMPONENTS} SELECT node, component FROM r WHERE component = (SELECT component FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def i28(spark, d):
    return models.largest_component(edges(spark, d))


@query("i29_spectral_embedding")
def i29(spark, d):
    return models.spectral_embedding(edges(spark, d), 2, 8)


@query("i29_laplacian_elbow")
def i29_elbow(spark, d):
    return vertices.embed(edges(spark, d), 4, 8, laplacian=True)[1]


@query("i30_communities")
def i30(spark, d):
    return models.communities(edges(spark, d))


@query("i31_link_scores", f"""WITH e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), g AS (SELECT src, count(*) AS deg FROM e GROUP BY 1 HAVING deg >= 2), w AS (SELECT e.src AS via, e.dst AS n, deg FROM e JOIN g USING (src))
SELECT a.n AS a, b.n AS b, count(*) AS common, round(sum(1 / ln(a.deg)), 6) AS adamic_adar FROM w a JOIN w b ON a.via = b.via AND a.n <> b.n WHERE a.n % 50 = 0 GROUP BY 1, 2""")
def i31(spark, d):
    """Queries are the nodes whose id is divisible by 50, against all nodes."""
    e = edges(spark, d)
    asked = datasets.nodes_of(e).where("id % 50 = 0").select(F.col("id").alias("node"))
    return models.link_scores(e, asked).withColumn("adamic_adar", F.round("adamic_adar", 6))


@query("i32_vertex_features")
def i32(spark, d):
    e = edges(spark, d)
    labels = datasets.nodes_of(e).select(F.col("id").alias("node"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("class")).where(u("node") < 0.5)
    return models.vertex_features(e, labels, ["even", "odd"])


@query("i32_nominate")
def i32_nominate(spark, d):
    """Suppliers and parts are the classes; half of the nodes are labelled."""
    e = edges(spark, d)
    labels = datasets.nodes_of(e).select(F.col("id").alias("node"), F.when(F.col("id") < 1_000_000, "supplier").otherwise("part").alias("class")).where(u("node") < 0.5)
    return vertices.nominate(vertices.classify_vertices(e, labels, most=4, rounds=8))


@query("i33_match_graphs")
def i33(spark, d):
    """On the lines of quantity 50 that come first in their order: marks are pairs of neighbours' neighbours."""
    e = edges(spark, d, "l_quantity = 50 and l_linenumber = 1")
    other = e.select((F.col("src") + 5_000_000).alias("src"), (F.col("dst") + 5_000_000).alias("dst"))
    nodes = datasets.nodes_of(e)
    return models.match_graphs(e, other, nodes.where(u("id") < 0.5).select(F.col("id").alias("a"), (F.col("id") + 5_000_000).alias("b")))


@query("j1_find_templates", """WITH p AS (SELECT max(len(string_split(text, ' '))) >= 20 AS texts, count(DISTINCT lang) > 2 AS many FROM documents)
SELECT name, place FROM (VALUES ('dummy', 0, false, false), ('classification', 1, false, false), ('multiclass_jmi', 1, false, true), ('naive_bayes', 1, false, false), ('text', 1, true, false)) t(name, place, of_texts, of_many), p WHERE (texts OR NOT of_texts) AND (many OR NOT of_many)""")
def j1(spark, d):
    """Templates for telling a document's language; types and keywords follow from the rows."""
    found = search.describe_problem(table(spark, d, "documents"), "text", "lang")
    return search.find_templates(search.templates(spark), "classification", *found).select("name", "place")


def asked(target: str = "l_returnflag") -> jobs.Problem:
    return jobs.Problem("row_id", FEATURES, target)


@query("j2_to_pipeline")
def j2(spark, d):
    """A template's chain with a drawn choice for each step, and a model behind it."""
    train, test = parts(spark, d)
    point = jobs.points_of(spark, "classification", ["random_forest"], 1)[-1]
    return jobs.fit_produce(asked(), point, train, test)


@query("j3_expand_grid", "SELECT s || '|' || p AS point, count(*) AS n FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) JOIN orders ON o_orderstatus = s AND o_orderpriority = p GROUP BY 1")
def j3(spark, d):
    o = table(spark, d, "orders")
    params = o.select(F.lit("p").alias("name"), F.col("o_orderpriority").alias("value")).distinct().union(o.select(F.lit("s"), "o_orderstatus").distinct())
    points = relate.grid(params).select(F.col("params")["s"].alias("o_orderstatus"), F.col("params")["p"].alias("o_orderpriority"))
    return points.join(o, ["o_orderstatus", "o_orderpriority"]).groupBy(F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("point")).agg(F.count("*").alias("n"))


_SPACE_SQL = f"""SELECT point, 'depth' AS step, CAST(CAST(floor(lo + {{0}} * (hi - lo + 1)) AS BIGINT) AS VARCHAR) AS value FROM (SELECT range AS point, (SELECT min(p_size) FROM part) AS lo, (SELECT max(p_size) FROM part) AS hi FROM range(200))
 UNION ALL SELECT range, 'loss', CASE WHEN {{1}} < 0.5 THEN 'a' ELSE '2' END FROM range(200)""".format(u_sql("'depth-' || point", "draw"), u_sql("'loss-' || range", "draw"))


@query("j4_draw_points", _SPACE_SQL)
def j4(spark, d):
    ends = table(spark, d, "part").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")).first()
    return search.draw_points(spark, {"depth": [ends["lo"], ends["hi"]], "loss": ["a", 2]}, 200)


@query("j5_candidate_stream", f"""WITH w AS (SELECT c_mktsegment AS name, round(sum(c_acctbal), 2) AS weight FROM customer GROUP BY 1), s AS (SELECT name, weight AS x, sum(weight) OVER (ORDER BY name) AS hi FROM w), t AS (SELECT sum(weight) AS t, count(*) AS k FROM w)
SELECT row_number() OVER (ORDER BY weight DESC, name) - 1 AS turn, name FROM w UNION ALL SELECT draw + k, name FROM (SELECT range AS draw, {u_sql('range', 'stream')} * t AS u, k FROM range(50) CROSS JOIN t) JOIN s ON u < hi AND u >= hi - x""")
def j5(spark, d):
    w = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.round(F.sum("c_acctbal"), 2).alias("weight"))
    return search.candidate_stream(w, 50)


@query("j6_random_search", f"WITH s AS (SELECT DISTINCT c_mktsegment AS name FROM customer), k AS (SELECT name, row_number() OVER (ORDER BY name) AS hi, count(*) OVER () AS n FROM s) SELECT range AS draw, name FROM range(50) JOIN k ON {u_sql('range', 'uniform')} * n < hi AND {u_sql('range', 'uniform')} * n >= hi - 1")
def j6(spark, d):
    return search.random_search(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct(), 50)


@query("j7_dimension_search")
def j7(spark, d):
    splits = scratch(split.nested_splits(lines(spark, d).select("row_id", *FEATURES, "l_returnflag"), "row_id"), "splits")

    def value(point: dict) -> float:
        return jobs.evaluate(asked(), point, splits, "quick")[0].where("metric = 'accuracy'").first()["value"]

    _, tried = search.dimension_search({"model": "decision_tree", "depth": 2}, {"depth": [3, 4], "model": ["random_forest"]}, value, 2)
    return spark.createDataFrame([(p["model"], int(p["depth"]), float(v)) for p, v in tried], "model string, depth int, value double")


HIST = f"(SELECT template_name, sum(sim_count) AS sim_count, sum(total_runtime) AS total_runtime, max(cv) FILTER (error IS NULL) AS cv, first(id ORDER BY cv DESC NULLS LAST, id) FILTER (error IS NULL) AS best_id FROM {REPORTS} GROUP BY 1)"
NORM = "(SELECT template_name, " + ", ".join(f"greatest(0.01, least(1, coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0))) AS {c}" for c in ("sim_count", "total_runtime", "cv")) + f" FROM {HIST})"


@query("j8_uct", f"""SELECT template_name, round(10 * cv * greatest(greatest(ln(10 * sim_count), 0), 1) + coalesce(sim_count / nullif(sqrt(2 * greatest(ln(n), 0)), 0), 0) + 4 * sqrt(2 * greatest(ln(t), 0) / total_runtime), 6) AS uct
 FROM (SELECT *, sum(sim_count) OVER () AS n, sum(total_runtime) OVER () AS t FROM {NORM})""")
def j8(spark, d):
    return search.uct(search.normalize_history(search.update_history(reports(spark, d)))).select("template_name", r("uct", 6))


@query("j9_evaluate")
def j9(spark, d):
    """Scores of every split and of five folds; predictions of a refit on all are counted beside them."""
    splits = scratch(split.nested_splits(lines(spark, d).select("row_id", *FEATURES, "l_returnflag"), "row_id"), "splits")
    scores, fitted = jobs.evaluate(asked(), {"candidate_id": "a", "model": "decision_tree", "depth": 3}, splits, folds=5)
    whole = jobs.score(fitted, splits.drop("split"), "all")
    return scores.unionByName(whole)


@query("j9_search")
def j9_search(spark, d):
    """From the table to ranked candidates: the baseline, naive Bayes and the classification template's points."""
    df = lines(spark, d).select("row_id", *FEATURES, "l_returnflag")
    points = [p for t, names in (("dummy", ["dummy"]), ("naive_bayes", ["gaussian_nb"]), ("classification", ["logistic_regression"])) for p in jobs.points_of(spark, t, names, 1)]
    return jobs.run_search(asked(), df, points)[0]


@query("j10_cross_validate")
def j10(spark, d):
    li = split.split_kfold(lines(spark, d).select("row_id", *FEATURES, (F.col("l_linestatus") == "F").cast("double").alias("y")), "row_id", 3)
    return spark.createDataFrame([(float(x),) for x in search.cross_validate(li, FEATURES, "y", LogisticRegression(maxIter=3), "fold", 3)], "f1 double")


@query("j11_update_history", f"SELECT template_name, sim_count::BIGINT AS sim_count, total_runtime, round(cv, 6) AS cv, best_id FROM {HIST}")
def j11(spark, d):
    return search.update_history(reports(spark, d)).withColumn("cv", F.round("cv", 6))


@query("j12_better", f"SELECT template_name, arg_max(id, (sub_pipelines * 1e7) + CASE WHEN sub_pipelines = 0 THEN -cv ELSE cv END) AS id FROM {REPORTS} GROUP BY 1")
def j12(spark, d):
    key = search.better_key(F.col("sub_pipelines"), F.col("cv"), F.col("sub_pipelines") == 1)
    return reports(spark, d).groupBy("template_name").agg(F.max_by("id", key).alias("id"))


@query("j13_normalize_history", f"SELECT template_name, round(sim_count, 6) AS sim_count, round(total_runtime, 6) AS total_runtime, round(cv, 6) AS cv FROM {NORM}")
def j13(spark, d):
    return search.normalize_history(search.update_history(reports(spark, d))).select("template_name", r("sim_count", 6), r("total_runtime", 6), r("cv", 6))


@query("j14_best", f"SELECT id, template_name, rank FROM {REPORTS} QUALIFY row_number() OVER (PARTITION BY template_name ORDER BY rank NULLS LAST, id) = 1")
def j14(spark, d):
    return search.best(reports(spark, d), ["template_name"]).select("id", "template_name", "rank")


@query("j15_top_ranked", f"SELECT id, rank, 'kept' AS part FROM (SELECT * FROM {REPORTS} ORDER BY rank NULLS LAST, id LIMIT 20) UNION ALL SELECT id, rank, 'removed' FROM (SELECT * FROM {REPORTS} ORDER BY rank NULLS LAST, id OFFSET 20)")
def j15(spark, d):
    rs = reports(spark, d)
    return search.top_ranked(rs, 20).select("id", "rank", F.lit("kept").alias("part")).unionByName(search.removed(rs, 20).select("id", "rank", F.lit("removed").alias("part")))


@query("j16_best_per_model", f"SELECT model, id, rank FROM {REPORTS} QUALIFY row_number() OVER (PARTITION BY model ORDER BY rank NULLS LAST, id) = 1")
def j16(spark, d):
    return search.best_per_model(reports(spark, d)).select("model", "id", "rank")


@query("j17_most_diverse", f"""WITH p AS (SELECT a.candidate_id AS a, b.candidate_id AS b, avg((a.pred = b.pred)::INT) AS s FROM {PREDS} a JOIN {PREDS} b ON a.row_id = b.row_id AND a.candidate_id < b.candidate_id GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (ORDER BY round(s, 9), a, b) AS place FROM p), i AS (SELECT a AS id, place * 2 AS o FROM k UNION ALL SELECT b, place * 2 + 1 FROM k) SELECT id FROM i GROUP BY 1 ORDER BY min(o) LIMIT 3""")
def j17(spark, d):
    return search.most_diverse(relate.pair_similarity(candidates(spark, d)), 3)


@query("j18_top_simple", f"SELECT id, rank FROM {REPORTS} WHERE sub_pipelines = 0 ORDER BY rank NULLS LAST, id LIMIT 3")
def j18(spark, d):
    return search.top_simple(reports(spark, d)).select("id", "rank")


@query("j19_fit_score")
def j19(spark, d):
    train, test = parts(spark, d)
    return metrics.normalize_score(jobs.fit_score(asked(), {"candidate_id": "a", "model": "decision_tree"}, train, test))


DUMMY = f"(SELECT l_returnflag AS truth, (SELECT l_returnflag FROM {LI} WHERE NOT {TEST} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS pred FROM {LI} WHERE {TEST})"


@query("j19_score_baseline", f"SELECT 'a' AS candidate_id, 'test' AS fold, 'l_returnflag' AS target, 'accuracy' AS metric, round(avg((truth = pred)::INT), 6) AS value FROM {DUMMY}")
def j19_baseline(spark, d):
    """The jobs one by one, on a model with a closed form: fit, produce, score the predictions."""
    train, test = parts(spark, d)
    told = jobs.produce(jobs.fit(asked(), {"model": "dummy"}, train), test)
    return jobs.score_predictions(asked(), told, test).where("metric = 'accuracy'").select("candidate_id", "fold", "target", "metric", r("value", 6))


@query("j20_produce")
def j20(spark, d):
    train, test = parts(spark, d)
    at = datasets.save_fitted(models.fit_classifier("logistic_regression", train, FEATURES, "l_returnflag"), folder(spark, "produce"), "f")
    return search.produce(at, test.drop("l_returnflag"), "row_id")


@query("j21_scores_of", f"SELECT fid, 'f1Macro' AS metric, round(cv, 6) AS value FROM {REPORTS} WHERE fid = 'f7' UNION ALL SELECT fid, 'runtime', total_runtime FROM {REPORTS} WHERE fid = 'f7'")
def j21(spark, d):
    held = reports(spark, d).withColumn("test_metrics", F.array(F.struct(F.lit("f1Macro").alias("metric"), F.round("cv", 6).alias("value")), F.struct(F.lit("runtime").alias("metric"), F.col("total_runtime").alias("value"))))
    return search.scores_of(held, "f7")


@query("j22_failures", f"SELECT template_name AS template, model AS step, 'ValueError' AS exception, count(*) AS n FROM {REPORTS} WHERE error IS NOT NULL GROUP BY 1, 2, 3")
def j22(spark, d):
    bad = reports(spark, d).where("error is not null").select(F.col("template_name").alias("template"), F.col("model").alias("step"), F.regexp_extract("error", r"^(\w+)", 1).alias("exception"))
    return search.failures(bad)


def stored(spark, d):
    """Reports as files of a folder, for streams."""
    at = folder(spark, "reports")
    reports(spark, d).select("id", "template_name", "cv", "rank", "finished_at", "error").repartition(2).write.parquet(at)
    return at


@query("k1_stream_reports", f"SELECT id, cv FROM {REPORTS} WHERE error IS NULL")
def k1(spark, d):
    return streams.drain(streams.stream_reports(streams.read_reports(spark, stored(spark, d))).select("id", "cv"), folder(spark, "k1"))


@query("k1_running_count", f"SELECT count(*) AS seen FROM {REPORTS} WHERE error IS NULL")
def k1_count(spark, d):
    """Followed until as many reports are in as the stored folder holds."""
    at = stored(spark, d)
    want = spark.read.parquet(at).where("cv is not null and error is null").count()
    out = streams.follow(streams.stream_reports(streams.read_reports(spark, at, per_batch=1)).select("id", "cv"), folder(spark, "k1"), lambda n: n >= want, 600)
    return out.agg(F.max("seen").alias("seen"))


@query("k2_stream_best", f"SELECT template_name, arg_max(id, cv) AS id, max(cv) AS cv, count(*) AS reports FROM {REPORTS} WHERE error IS NULL GROUP BY 1")
def k2(spark, d):
    return streams.drain(streams.stream_best(streams.read_reports(spark, stored(spark, d), per_batch=1)), folder(spark, "k2"), "complete")


@query("k3_stream_dedupe", f"SELECT id, template_name FROM {REPORTS}")
def k3(spark, d):
    at = folder(spark, "twice")
    rs = reports(spark, d).select("id", "template_name", "cv", "rank", "finished_at", "error")
    rs.unionByName(rs).write.parquet(at)
    return streams.drain(streams.stream_dedupe(streams.read_reports(spark, at), "400 weeks").select("id", "template_name"), folder(spark, "k3"))


@query("k3_flag_duplicates", f"SELECT id, template_name, duplicate FROM {REPORTS} CROSS JOIN (VALUES (false), (true)) AS t(duplicate)")
def k3_flags(spark, d):
    """Every report comes twice, in files of their own, and so in batches of their own."""
    at = folder(spark, "flags")
    rs = reports(spark, d).select("id", "template_name", "cv", "rank", "finished_at", "error")
    for _ in range(2):
        rs.coalesce(1).write.mode("append").parquet(at)
    flagged = streams.flag_duplicates(streams.read_reports(spark, at, per_batch=1), "400 weeks")
    return streams.drain(flagged.select("id", "template_name", "duplicate"), folder(spark, "k3f"))


@query("k4_drop_late", f"SELECT id FROM {REPORTS} WHERE finished_at <= TIMESTAMP '1998-01-01'")
def k4(spark, d):
    return streams.drain(streams.drop_late(streams.read_reports(spark, stored(spark, d)), "1998-01-01").select("id"), folder(spark, "k4"))


_MARK_SQL = "TIMESTAMP '1994-01-01' + INTERVAL 1 YEAR * (template_name[1]::INT - 1)"


@query("k4_mark_late", f"SELECT id, template_name, (finished_at > {_MARK_SQL} OR finished_at > TIMESTAMP '1997-01-01') AS late FROM {REPORTS}")
def k4_mark(spark, d):
    """Each priority's search is marked as done a year after the one before; the marks come first."""
    at, found = folder(spark, "marked"), reports(spark, d).select("id", "template_name", "finished_at", F.lit(False).alias("done"))
    year = (1993 + F.substring("template_name", 1, 1).cast("int")).cast("string")
    marks = found.select("template_name").distinct().select(F.lit(None).cast("string").alias("id"), "template_name", F.concat(year, F.lit("-01-01")).cast("timestamp").alias("finished_at"), F.lit(True).alias("done"))
    marks.coalesce(1).write.mode("append").parquet(at)
    found.repartition(2).write.mode("append").parquet(at)
    marked = streams.mark_late(streams.read_reports(spark, at, "id string, template_name string, finished_at timestamp, done boolean", per_batch=1), "1997-01-01", "400 weeks", "400 weeks")
    return streams.drain(marked.select("id", "template_name", "late"), folder(spark, "k4m"))


def samples(spark, d):
    at = folder(spark, "samples")
    table(spark, d, "events").select(F.col("user_id").alias("pid"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cpu")).repartition(2).write.parquet(at)
    return spark.readStream.schema("pid long, ts timestamp, cpu double").parquet(at)


@query("k5_stream_usage", "SELECT date_trunc('day', ts) AS start, user_id AS pid, count(*) AS samples, round(avg(value), 4) AS cpu FROM events GROUP BY 1, 2")
def k5(spark, d):
    out = streams.drain(streams.stream_usage(samples(spark, d), "1 day", "60 days"), folder(spark, "k5"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "pid", "samples", r("cpu"))


@query("k6_stream_produce")
def k6(spark, d):
    train, test = parts(spark, d)
    rows = scratch(test.select("row_id", *FEATURES), "rows")
    at = folder(spark, "rows")
    rows.write.parquet(at)
    model = models.fit_classifier("logistic_regression", train, FEATURES, "l_returnflag")
    return streams.drain(streams.stream_produce(model, spark.readStream.schema(rows.schema).parquet(at), "row_id"), folder(spark, "k6"))


@query("l1_user_step")
def l1(spark, d):
    from pyspark.ml.feature import Binarizer

    if "binarize" not in user.STEPS:
        user.register_step("binarize", Binarizer)
    return user.make_step("binarize", threshold=900.0, inputCol="p_retailprice", outputCol="dear").transform(table(spark, d, "part").select("p_partkey", "p_retailprice"))


@query("l2_map_rows", "SELECT event_id, value * 2 AS value FROM events")
def l2(spark, d):
    return user.map_rows(table(spark, d, "events").select("event_id", "value"), user.half_up, "event_id long, value double")


@query("l3_metric_udf", "SELECT user_id % 5 AS fold, round(avg(abs(value - 20)), 6) AS value FROM events GROUP BY 1")
def l3(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("fold"), "value", F.lit(20.0).alias("pred"))
    return e.groupBy("fold").agg(F.round(user.metric_udf(user.mean_absolute)("value", "pred"), 6).alias("value"))


@query("l4_explode_udtf", "SELECT o_orderkey, 0::INT AS part, split_part(o_orderpriority, '-', 1) AS word FROM orders UNION ALL SELECT o_orderkey, 1, split_part(o_orderpriority, '-', 2) FROM orders")
def l4(spark, d):
    split_words = user.explode_udtf(user.tokens_of, "part int, word string")
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").lateralJoin(split_words(F.col("o_orderpriority").outer())).select("o_orderkey", "part", "word")
