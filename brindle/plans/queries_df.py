"""Queries over the given tables: encoding, selection, joins (D, E, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import query
from brindle.functions.keys import u, u_sql
from brindle.operators import encode, neighbours, relate, select
from brindle.plans.queries_ac import HOLED, holed
from brindle.session import table


def r(c: str, n: int = 4):
    return F.round(c, n).alias(c)


D1_SQL = f"""WITH t AS {HOLED}, top AS (SELECT p_brand AS v, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM t WHERE p_brand IS NOT NULL GROUP BY 1 QUALIFY k <= 3)
SELECT p_partkey, coalesce((p_brand = (SELECT v FROM top WHERE k = 1))::INT, 0) AS first, coalesce((p_brand NOT IN (SELECT v FROM top))::INT, 0) AS p_brand_other, (p_brand IS NULL)::INT AS p_brand_null FROM t"""


@query("d1_encode", D1_SQL)
def d1(spark, d):
    t = holed(spark, d).select("p_partkey", "p_brand")
    top = encode.top_values(t, "p_brand", 3)
    return encode.encode(t, ["p_brand"], 3).select("p_partkey", F.col(f"`p_brand_{top[0]}`").alias("first"), "p_brand_other", "p_brand_null")


@query("d2_label_encode", "WITH i AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS code FROM orders GROUP BY 1) SELECT o_orderkey, o_orderpriority AS back, code::INT AS code FROM orders JOIN i ON v = o_orderpriority")
def d2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    coded = encode.label_encode(o, "o_orderpriority", "code").select("o_orderkey", "code")
    return encode.label_decode(coded, encode.label_index(o, "o_orderpriority"), "code", "back").select("o_orderkey", "back", "code")


@query("d3_one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
def d3(spark, d):
    return encode.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("d4_binary_encode", f"WITH t AS {HOLED}, i AS (SELECT p_brand AS v, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS i FROM t WHERE p_brand IS NOT NULL GROUP BY 1) SELECT p_partkey, " + ", ".join(f"((coalesce(i, 0) >> {b}) & 1)::INT AS p_brand_b{b}" for b in range(5)) + " FROM t LEFT JOIN i ON v = p_brand")
def d4(spark, d):
    return encode.binary_encode(holed(spark, d).select("p_partkey", "p_brand"), "p_brand")


@query("d5_unary_encode", "WITH i AS (SELECT o_orderstatus AS v, dense_rank() OVER (ORDER BY o_orderstatus) AS i FROM orders GROUP BY 1) SELECT o_orderkey, (i >= 1)::INT AS o_orderstatus_ge0, (i >= 2)::INT AS o_orderstatus_ge1, (i >= 3)::INT AS o_orderstatus_ge2 FROM orders JOIN i ON v = o_orderstatus")
def d5(spark, d):
    return encode.unary_encode(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


TOKENS = "unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'))"


@query("d6_text_encode", f"""WITH w AS (SELECT doc_id, lang, {TOKENS} AS token FROM documents), n AS (SELECT token, count(*) AS n, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en FROM w GROUP BY 1),
m AS (SELECT doc_id, avg(ln((de + 1) / (n + (SELECT count(DISTINCT lang) FROM documents)))) AS de, avg(ln((en + 1) / (n + (SELECT count(DISTINCT lang) FROM documents)))) AS en FROM w JOIN n USING (token) GROUP BY 1)
SELECT d.doc_id, round(coalesce(m.de, 0), 6) AS text_de, round(coalesce(m.en, 0), 6) AS text_en FROM documents d LEFT JOIN m USING (doc_id)""")
def d6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return encode.text_encode(docs, "doc_id", "text", "lang").select("doc_id", r("text_de", 6), r("text_en", 6))


@query("d7_count_vector", f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations), g AS (SELECT id, unnest(list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM t),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), k AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING df >= 3 AND df <= 0.5 * (SELECT count(*) FROM t)) SELECT id, term, tf, df FROM tf JOIN k USING (term)""")
def d7(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return encode.count_vector(c, "id", "text", n=2, min_df=3, max_df=0.5)


@query("d8_tfidf", f"""WITH tf AS (SELECT doc_id, token AS term, count(*) AS tf FROM (SELECT doc_id, {TOKENS} AS token FROM documents) GROUP BY 1, 2), k AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, term, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS tfidf FROM tf JOIN k USING (term)""")
def d8(spark, d):
    return encode.tfidf(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", r("tfidf", 6))


@query("d9_topics")
def d9(spark, d):
    return encode.topics(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", 3, 3).drop("text")


@query("d10_text_factors")
def d10(spark, d):
    return encode.text_factors(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["role", "text"], 3)


@query("d11_scale_maxabs", "SELECT p_partkey, round(p_retailprice / (SELECT max(abs(p_retailprice)) FROM part), 6) AS p_retailprice FROM part")
def d11(spark, d):
    return encode.scale_maxabs(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).select("p_partkey", r("p_retailprice", 6))


@query("d12_scale_iqr", "SELECT o_orderkey, round((o_totalprice - m) / (h - l), 6) AS o_totalprice FROM orders CROSS JOIN (SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.25) AS l, quantile_cont(o_totalprice, 0.75) AS h FROM orders)")
def d12(spark, d):
    return encode.scale_iqr(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", r("o_totalprice", 6))


@query("d13_scale_robust")
def d13(spark, d):
    return encode.scale_robust(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@query("d14_scale_standard", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS o_totalprice FROM orders")
def d14(spark, d):
    return encode.scale_standard(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", r("o_totalprice", 6))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LKEY = "l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(l_shipdate::DATE AS VARCHAR)"


def lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.to_date("l_shipdate").cast("string")))


@query("e1_select_variance", "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def e1(spark, d):
    return select.select_variance(table(spark, d, "lineitem").select("l_orderkey", *FEATURES), FEATURES, 0.05)


def flagged(spark, d):
    """Lines with a label that follows the quantity, a tenth of it flipped by key."""
    return lines(spark, d).withColumn("big", ((F.col("l_quantity") > 25) != (u("row_id", "flip") < 0.1)).cast("double"))


def named(spark, name: str, rows) -> object:
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"place int, {name} string")


@query("e2_select_fwe")
def e2(spark, d):
    return named(spark, "feature", select.select_fwe(flagged(spark, d), FEATURES, "big"))


F_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 4) AS f FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag)" for c in FEATURES
)


@query("e3_f_scores", F_SQL)
def e3(spark, d):
    return select.f_scores(table(spark, d, "lineitem"), FEATURES, "l_returnflag").select("feature", r("f"))


@query("e3_select_percentile", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def e3p(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("target"), "l_extendedprice", "l_discount", "l_tax")
    return select.select_percentile(li, FEATURES, "target", 25, classification=False).drop("target")


@query("e4_select_univariate", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(pow(corr({c}, l_quantity * 2 + l_tax), 2) * (count(*) - 2) / (1 - pow(corr({c}, l_quantity * 2 + l_tax), 2)), 3) AS f FROM lineitem" for c in ("l_extendedprice", "l_discount", "l_tax")))
def e4(spark, d):
    li = table(spark, d, "lineitem").withColumn("target", F.col("l_quantity") * 2 + F.col("l_tax"))
    kept = select.select_univariate(li.select(*FEATURES[1:], "target"), FEATURES[1:], "target", "k_best", 3, classification=False)
    return select.f_scores(kept, FEATURES[1:], "target", classification=False).select("feature", r("f", 3))


def _jmi_sql(nbins: int = 5) -> str:
    """The two features that joint mutual information takes first, as SQL."""
    row_id = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate::DATE)"
    ends = ", ".join(f"min({c}) AS lo_{c}, (max({c}) - min({c})) / {nbins} AS w_{c}" for c in FEATURES)
    bins = ", ".join(f"least(floor(({c} - lo_{c}) / CASE WHEN w_{c} = 0 THEN 1 ELSE w_{c} END), {nbins - 1})::INT AS {c}" for c in FEATURES)
    one = " UNION ALL ".join(f"SELECT '{c}' AS feature, '' AS beside, {c}::VARCHAR AS x, y FROM b" for c in FEATURES)
    two = " UNION ALL ".join(f"SELECT '{c}', '{s}', {c} || ',' || {s}, y FROM b" for c in FEATURES for s in FEATURES if s != c)
    return f"""
WITH f AS (SELECT {", ".join(FEATURES)}, (l_quantity > 25) <> ({u_sql(row_id, "flip")} < 0.1) AS y FROM lineitem),
e AS (SELECT {ends} FROM f), b AS (SELECT {bins}, y FROM f, e),
cells AS (SELECT feature, beside, x, y, count(*) AS n FROM ({one} UNION ALL {two}) GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER (PARTITION BY feature, beside, x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY feature, beside, y)::DOUBLE AS ny, sum(n) OVER (PARTITION BY feature, beside)::DOUBLE AS total FROM cells),
info AS (SELECT feature, beside, round(sum(n / total * ln(n * total / (nx * ny))), 9) AS v FROM sums GROUP BY ALL),
first AS (SELECT feature FROM info WHERE beside = '' ORDER BY v DESC, feature LIMIT 1),
second AS (SELECT feature FROM info WHERE beside = (SELECT feature FROM first) ORDER BY v DESC, feature LIMIT 1)
SELECT 0 AS place, feature FROM first UNION ALL SELECT 1, feature FROM second
"""


@query("e5_select_jmi", _jmi_sql())
def e5(spark, d):
    return named(spark, "feature", select.select_jmi(flagged(spark, d), FEATURES, "big", k=2))


@query("e6_select_mb")
def e6(spark, d):
    return named(spark, "feature", select.select_mb(flagged(spark, d), FEATURES, "big"))


@query("e7_select_smb")
def e7(spark, d):
    return named(spark, "feature", select.select_smb(flagged(spark, d), FEATURES, "big"))


@query("e8_pca")
def e8(spark, d):
    return select.pca(table(spark, d, "embeddings"), "embedding", 4).select("vec_id", "pca")


@query("e9_kernel_pca")
def e9(spark, d):
    return select.kernel_pca(table(spark, d, "embeddings"), "embedding", "vec_id", 3, landmarks=8).select("vec_id", "kernel_pca")


@query("e10_huber_pca")
def e10(spark, d):
    return select.huber_pca(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 7).alias("m")), ["p_size", "p_retailprice", "m"])


@query("e11_random_projection", "SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * CASE WHEN CAST('0x' || substr(md5(i || '-1'), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 THEN 1 ELSE -1 END / 2)), 5) AS rp1 FROM embeddings")
def e11(spark, d):
    return select.random_projection(table(spark, d, "embeddings"), "embedding", 64, 4).select("vec_id", r("rp1", 5))


@query("e12_prune_similar", """WITH c AS (SELECT label::VARCHAR AS "column", label AS ord, list_transform(range(64), lambda i: 0)::INT[] AS z FROM embeddings GROUP BY 1, 2),
v AS (SELECT label AS ord, """ + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS v{i}" for i in range(64)) + """ FROM embeddings GROUP BY 1),
p AS (SELECT a.ord AS a, b.ord AS b, (""" + " + ".join(f"a.v{i} * b.v{i}" for i in range(64)) + """) / (sqrt(""" + " + ".join(f"a.v{i} * a.v{i}" for i in range(64)) + """) * sqrt(""" + " + ".join(f"b.v{i} * b.v{i}" for i in range(64)) + """)) AS cos FROM v a JOIN v b ON a.ord <> b.ord),
n AS (SELECT a, b FROM p WHERE cos > 0.9 OR cos < 0.4),
k AS (SELECT v.ord, count(b) AS matches, coalesce(least(min(b), v.ord), v.ord) AS head FROM v LEFT JOIN n ON a = v.ord GROUP BY v.ord)
SELECT ord::VARCHAR AS "column", matches FROM k QUALIFY row_number() OVER (PARTITION BY head ORDER BY matches DESC, ord) = 1""")
def e12(spark, d):
    e = table(spark, d, "embeddings")
    means = e.groupBy(F.col("label").alias("ord")).agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("vec"))
    return select.prune_similar(means.select(F.col("ord").cast("string").alias("column"), "ord", "vec"))


@query("e13_synthesize_single", "SELECT o_orderkey, o_totalprice / nullif(o_custkey, 0) AS ratio, length(o_orderpriority) AS o_orderpriority_length, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day FROM orders")
def e13(spark, d):
    x = select.synthesize_single(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], ["o_orderpriority"], ["o_orderdate"])
    return x.select("o_orderkey", F.col("o_totalprice_per_o_custkey").alias("ratio"), "o_orderpriority_length", "o_orderdate_year", "o_orderdate_month", "o_orderdate_day")


@query("e14_synthesize_multi", """SELECT c_custkey, coalesce(n, 0) AS orders_count, round(s, 2) AS total, round(a, 6) AS mean, lo, hi, round(sd, 6) AS sd, k AS statuses FROM customer LEFT JOIN
 (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_samp(o_totalprice) AS sd, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def e14(spark, d):
    x = select.synthesize_multi(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey", ["o_totalprice"], ["o_orderstatus"], "orders")
    return x.select("c_custkey", "orders_count", F.round("orders_o_totalprice_sum", 2).alias("total"), F.round("orders_o_totalprice_avg", 6).alias("mean"), F.col("orders_o_totalprice_min").alias("lo"), F.col("orders_o_totalprice_max").alias("hi"), F.round("orders_o_totalprice_std", 6).alias("sd"), F.col("orders_o_orderstatus_distinct").alias("statuses"))


@query("f1_denormalize", """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, o_totalprice, c_mktsegment, n_name, r_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
 LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def f1(spark, d):
    t = lambda n: table(spark, d, n)
    x = relate.denormalize(t("lineitem"), [(t("orders"), "l_orderkey", "o_orderkey"), (t("customer"), "o_custkey", "c_custkey"), (t("nation"), "c_nationkey", "n_nationkey"), (t("region"), "n_regionkey", "r_regionkey")])
    return x.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "o_totalprice", "c_mktsegment", "n_name", "r_name")


@query("f2_augment", "SELECT c_custkey, round(a, 6) AS aug_o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS a FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def f2(spark, d):
    x = relate.augment(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), {"c_custkey": "o_custkey"}, ["o_totalprice"])
    return x.select("c_custkey", r("aug_o_totalprice", 6))


@query("f3_discover_joins", """SELECT 'o_custkey' AS "column", 'customer' AS "table", 'c_custkey' AS other, round(count(c_custkey) / count(*), 6) AS score FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) ON c_custkey = o_custkey
 UNION ALL SELECT 'o_custkey', 'supplier', 's_suppkey', round(count(s_suppkey) / count(*), 6) FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier) ON s_suppkey = o_custkey""")
def f3(spark, d):
    t = lambda n: table(spark, d, n)
    found = relate.discover_joins(t("orders"), ["o_custkey"], {"customer": (t("customer"), ["c_custkey", "c_name"]), "supplier": (t("supplier"), ["s_suppkey"]), "part": (t("part"), ["p_partkey"])}, used=["part"])
    return found.withColumn("score", F.round("score", 6))


@query("f4_augment_all", "SELECT c_custkey, round(a, 6) AS aug_o_totalprice, round(b, 6) AS aug_s_acctbal FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS a FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS b FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def f4(spark, d):
    steps = [(table(spark, d, "orders"), {"c_custkey": "o_custkey"}, ["o_totalprice"]), (table(spark, d, "supplier"), {"c_nationkey": "s_nationkey"}, ["s_acctbal"])]
    return relate.augment_all(table(spark, d, "customer"), steps)[0].select("c_custkey", r("aug_o_totalprice", 6), r("aug_s_acctbal", 6))


@query("f5_join_truth", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'o_orderstatus' AS target, o_orderstatus AS truth, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS pred FROM orders")
def f5(spark, d):
    o = table(spark, d, "orders")
    return relate.join_truth(o.select("o_orderkey", "o_orderstatus"), o.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")), "o_orderkey")


@query("f6_hconcat", "SELECT o_orderkey, o_orderstatus AS pred, o_orderpriority AS pred_1 FROM orders")
def f6(spark, d):
    o = table(spark, d, "orders")
    return relate.hconcat([o.select("o_orderkey", F.col("o_orderstatus").alias("pred")), o.select("o_orderkey", F.col("o_orderpriority").alias("pred"))], "o_orderkey")


@query("f7_vconcat", "SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def f7(spark, d):
    return relate.vconcat([table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))])


@query("f8_compare_baseline", "SELECT p_partkey AS dataset, p_retailprice AS target, coalesce(CAST(n AS VARCHAR), 'N/A') AS score FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def f8(spark, d):
    ours = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("dataset")).agg(F.count("*").alias("score"))
    return relate.compare_baseline(table(spark, d, "part").select(F.col("p_partkey").alias("dataset"), F.col("p_retailprice").alias("target")), ours, "dataset", "score")


@query("f9_join_usage", "WITH s AS (SELECT user_id AS pid, ts::DATE AS step, ts::DATE::TIMESTAMP AS a, ts::DATE::TIMESTAMP + INTERVAL 12 HOUR AS b FROM events GROUP BY ALL) SELECT s.pid, CAST(step AS VARCHAR) AS step, count(ts) AS samples, round(avg(value), 4) AS cpu FROM s LEFT JOIN events e ON e.user_id = s.pid AND ts >= a AND ts < b GROUP BY 1, 2")
def f9(spark, d):
    e = table(spark, d, "events")
    steps = e.select(F.col("user_id").alias("pid"), F.to_date("ts").alias("day")).distinct().select("pid", F.col("day").cast("string").alias("step"), F.col("day").cast("timestamp_ntz").alias("start"), (F.col("day").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("end"))
    return relate.join_usage(steps, e.select(F.col("user_id").alias("pid"), "ts", F.col("value").alias("cpu"), F.col("value").alias("memory"))).select("pid", "step", "samples", r("cpu"))


@query("f10_unseen", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {u_sql('o_orderkey')} >= 0.4")
def f10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return relate.unseen(o, o.where(u("o_orderkey") < 0.4), ["o_orderkey", "o_orderstatus"])


@query("f11_existing", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def f11(spark, d):
    return relate.existing(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


@query("f12_keyword_sets", "WITH s AS (SELECT o_custkey, list_distinct(list(o_orderstatus)) AS a FROM orders GROUP BY 1) SELECT o_custkey, list_has_any(a, ['F', 'O']) AS shares, array_to_string(list_sort(list_filter(a, lambda x: x NOT IN ('F', 'O'))), ',') AS rest, list_has_all(['F', 'O'], a) AS inside FROM s")
def f12(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"))
    b = F.array(F.lit("F"), F.lit("O"))
    return s.select("o_custkey", relate.overlap(F.col("a"), b).alias("shares"), F.array_join(relate.difference(F.col("a"), b), ",").alias("rest"), relate.subset(F.col("a"), b).alias("inside"))


@query("f13_grid", "SELECT a.o_orderstatus || '|' || b.o_orderpriority AS point FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b")
def f13(spark, d):
    o = table(spark, d, "orders")
    params = o.select(F.lit("a").alias("name"), F.col("o_orderstatus").alias("value")).distinct().union(o.select(F.lit("b"), "o_orderpriority").distinct())
    return relate.grid(params).select(F.concat_ws("|", F.col("params")["a"], F.col("params")["b"]).alias("point"))


PREDS = "(SELECT o_orderkey AS row_id, 'c' || c AS candidate_id, CASE c WHEN 0 THEN o_orderstatus WHEN 1 THEN 'F' WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 'O' ELSE o_orderstatus END ELSE CASE WHEN o_custkey % 2 = 0 THEN 'P' ELSE 'F' END END AS pred FROM orders CROSS JOIN range(4) t(c))"


def candidates(spark, d):
    """Four made-up models' predictions of each order's status."""
    o = table(spark, d, "orders")
    s, k = F.col("o_orderstatus"), F.col("o_custkey")
    preds = [s, F.lit("F"), F.when(k % 3 == 0, "O").otherwise(s), F.when(k % 2 == 0, "P").otherwise("F")]
    return o.select(F.col("o_orderkey").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f"c{i}").alias("candidate_id"), p.alias("pred")) for i, p in enumerate(preds)])).alias("x")).select("row_id", "x.*")


@query("f14_pair_similarity", f"SELECT a.candidate_id AS a, b.candidate_id AS b, round(avg((a.pred = b.pred)::INT), 6) AS similarity FROM {PREDS} a JOIN {PREDS} b ON a.row_id = b.row_id AND a.candidate_id < b.candidate_id GROUP BY 1, 2")
def f14(spark, d):
    return relate.pair_similarity(candidates(spark, d)).select("a", "b", r("similarity", 6))


KNN_SQL = """SELECT a.vec_id, b.vec_id AS neighbour, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))), 9), b.vec_id) <= 5"""


@query("f15_knn_join", KNN_SQL)
def f15(spark, d):
    e = table(spark, d, "embeddings")
    return neighbours.knn_join(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5, same=True).select("vec_id", "neighbour", r("distance", 6))
