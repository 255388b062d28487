"""Queries over the given tables: sources, schema, cleaning (A, B, C)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.catalog import query
from brindle.functions.keys import u, u_sql
from brindle.operators import clean, schema
from brindle.session import shared_dir, table
from brindle.sources import datasets


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_nulls(df, key: str, columns):
    """Cells set to null by the key's bucket, since the given tables have none."""
    return df.withColumns({c: F.when(u(key, c) >= 0.1, F.col(c)) for c in columns})


def null_sql(key: str, column: str) -> str:
    return f"CASE WHEN {u_sql(key, column)} >= 0.1 THEN {column} END"


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query("a1_read_dataset", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a1(spark, d):
    cols = [("c_custkey", "integer", "index"), ("c_name", "text", "attribute"), ("c_nationkey", "integer", "attribute"), ("c_acctbal", "real", "attribute"), ("c_mktsegment", "categorical", "suggestedTarget")]
    doc = {"dataResources": [{"resID": "learningData", "resType": "table", "resPath": "customer.parquet", "resFormat": ["parquet"], "entryPoint": True, "columns": [{"colIndex": i, "colName": n, "colType": t, "role": [r]} for i, (n, t, r) in enumerate(cols)]}]}
    tables, main = datasets.read_dataset(spark, doc, d)
    assert datasets.key_and_target(tables[main]) == ("c_custkey", "c_mktsegment")
    return tables[main]


@query("a2_read_text_collection", "SELECT n_nationkey, n_name, n_nationkey || ':' || n_name AS content FROM nation")
def a2(spark, d):
    at, nation = folder(spark, "texts"), table(spark, d, "nation").select("n_nationkey", "n_name")
    nation.select(F.concat_ws(":", "n_nationkey", "n_name").alias("value"), F.col("n_nationkey").alias("k")).repartition(4, "k").write.partitionBy("k").text(at)
    named = nation.withColumn("file", F.concat(F.lit("k="), "n_nationkey"))
    found = datasets.read_text_collection(named, "file", at, name="regexp_extract(_metadata.file_path, 'k=[0-9]+', 0)")
    return found.select("n_nationkey", "n_name", F.regexp_replace("content", "\n$", "").alias("content"))


@query("a3_read_series", "SELECT event_type AS series_id, CAST(ts::DATE AS VARCHAR) AS ts, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def a3(spark, d):
    at = folder(spark, "series")
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("ts")).agg(F.round(F.sum("value"), 4).alias("value"))
    daily.repartition(1, "event_type").write.partitionBy("event_type").option("header", True).csv(at)
    # a folder for each series: the partition column is its id
    return datasets.read_series(spark, at).select(F.col("event_type").alias("series_id"), "ts", "value")


@query("a4_read_graph", "SELECT DISTINCT s_suppkey AS id FROM supplier UNION SELECT 1000000 + s_nationkey FROM supplier")
def a4(spark, d):
    at = folder(spark, "graph")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + 1_000_000).cast("long").alias("dst"), F.col("s_acctbal").alias("weight")).write.option("header", True).csv(at)
    return datasets.read_graph(spark, at)[1]


@query("a5_read_splits", f"SELECT o_orderkey, o_orderstatus, CASE WHEN {u_sql('o_orderkey')} < 0.2 THEN 'TEST' ELSE 'TRAIN' END AS type, 0 AS repeat, 0 AS fold FROM orders")
def a5(spark, d):
    at, orders = folder(spark, "splits"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    orders.select("o_orderkey", F.when(u("o_orderkey") < 0.2, "TEST").otherwise("TRAIN").alias("type"), F.lit(0).alias("repeat"), F.lit(0).alias("fold")).write.option("header", True).csv(at)
    return datasets.read_splits(spark, at, orders, "o_orderkey")


@query("a6_write_predictions", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders")
def a6(spark, d):
    at = folder(spark, "predictions")
    datasets.write_predictions(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), at)
    return spark.read.option("header", True).csv(at)


def reports(spark, d):
    """Reports made from orders: one for each order, by priority as template."""
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("r"), "o_orderkey").alias("id"), F.concat(F.lit("f"), "o_orderkey").alias("fid"), F.col("o_orderpriority").alias("template_name"), F.col("o_orderstatus").alias("model"),
        (F.col("o_totalprice") / 1e6).alias("cv"), F.when(u("o_orderkey", "rank") >= 0.1, F.round(1 / F.col("o_totalprice"), 9)).alias("rank"), F.lit(1).cast("long").alias("sim_count"), (F.col("o_custkey") % 100).cast("double").alias("total_runtime"),
        F.when(u("o_orderkey", "error") < 0.05, F.concat(F.lit("ValueError: step "), "o_orderstatus", F.lit(" using a.b.C"))).alias("error"), F.col("o_orderdate").cast("timestamp").alias("finished_at"), (F.col("o_custkey") % 2).alias("sub_pipelines"), F.col("o_custkey"),
    )


REPORTS = f"""(SELECT 'r' || o_orderkey AS id, 'f' || o_orderkey AS fid, o_orderpriority AS template_name, o_orderstatus AS model, o_totalprice / 1e6 AS cv,
 CASE WHEN {u_sql('o_orderkey', 'rank')} >= 0.1 THEN round(1 / o_totalprice, 9) END AS rank, 1::BIGINT AS sim_count, (o_custkey % 100)::DOUBLE AS total_runtime,
 CASE WHEN {u_sql('o_orderkey', 'error')} < 0.05 THEN 'ValueError: step ' || o_orderstatus || ' using a.b.C' END AS error, o_orderdate AS finished_at, o_custkey % 2 AS sub_pipelines, o_custkey FROM orders)"""


@query("a7_write_ranked", f"SELECT id, rank, template_name, round(cv, 6) AS value FROM {REPORTS}")
def a7(spark, d):
    at = folder(spark, "ranked")
    datasets.write_ranked(reports(spark, d).select("id", "rank", "template_name", F.lit("f1Macro").alias("metric"), F.round("cv", 6).alias("value"), F.array("cv").alias("fold_values")), at)
    return spark.read.schema("id string, rank double, template_name string, value double").json(at)


@query("a8_save_splits", f"SELECT o_orderkey, o_orderstatus, 'test' AS split FROM orders WHERE {u_sql('o_orderkey')} < 0.3")
def a8(spark, d):
    at = folder(spark, "parts")
    datasets.save_splits(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(u("o_orderkey") < 0.3, "test").otherwise("train").alias("split")), at)
    return datasets.load_splits(spark, at, "test")


@query("a10_write_runs", "SELECT 'c' || c_custkey AS id, c_nationkey AS step FROM customer")
def a10(spark, d):
    at = folder(spark, "runs")
    runs = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("step"))
    datasets.write_runs(runs.where(F.col("step") < 10), at)
    datasets.write_runs(runs.unionByName(runs), at)
    return spark.read.parquet(at)


@query("a11_write_failures", f"SELECT template_name AS template, 'ValueError' AS exception, model AS step, 'a.b.C' AS implementation, count(*) AS n FROM {REPORTS} WHERE error IS NOT NULL GROUP BY 1, 2, 3, 4")
def a11(spark, d):
    from brindle.plans.search import failures

    at = folder(spark, "failures")
    datasets.write_failures(reports(spark, d).where("error is not null").select(F.col("template_name").alias("template"), F.col("error").alias("message")), at)
    found = spark.read.schema("template string, exception string, step string, implementation string").json(at)
    return failures(found).withColumn("implementation", F.lit("a.b.C"))


@query("a12_attach_scores", "SELECT c_custkey AS stem, c_name AS info, s.n AS n, s.best AS best FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS best FROM orders GROUP BY 1) s ON o_custkey = c_custkey")
def a12(spark, d):
    info = table(spark, d, "customer").select(F.col("c_custkey").alias("stem"), F.col("c_name").alias("info"))
    scores = table(spark, d, "orders").select(F.col("o_custkey").alias("stem"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"))
    joined = datasets.attach_scores(info, scores)
    return joined.select("stem", "info", F.when(F.col("scores").isNotNull(), F.size("scores")).cast("long").alias("n"), F.round(F.array_max(F.transform("scores", lambda s: s["value"])), 2).alias("best"))


def roled(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return schema.with_roles(o, {"o_orderkey": ["index"], "o_custkey": ["attribute"], "o_orderstatus": ["attribute", "suggestedTarget"], "o_totalprice": ["attribute"], "o_orderpriority": ["attribute", "augmented"]})


PROBLEM = schema.Problem(targets=("o_orderstatus",), privileged=("o_totalprice",))


@query("b1_set_roles", "SELECT * FROM (VALUES ('o_orderkey', 'index'), ('o_custkey', 'attribute'), ('o_orderstatus', 'target,trueTarget'), ('o_totalprice', 'attribute,privileged'), ('o_orderpriority', 'attribute,augmented')) t(name, roles) CROSS JOIN (SELECT count(*) AS n FROM orders)")
def b1(spark, d):
    tagged = schema.set_roles(roled(spark, d), PROBLEM)
    rows = spark.createDataFrame([(c, ",".join(schema.roles_of(tagged, c))) for c in tagged.columns], "name string, roles string")
    return rows.crossJoin(F.broadcast(tagged.agg(F.count("*").alias("n"))))


@query("b2_select_roles", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def b2(spark, d):
    return schema.select_roles(schema.set_roles(roled(spark, d), PROBLEM), ["attribute"], use=["o_orderkey"], exclude=["o_orderpriority"])


@query("b3_drop_roles", "SELECT o_orderkey, o_orderstatus FROM orders")
def b3(spark, d):
    return schema.drop_roles(schema.set_roles(roled(spark, d), PROBLEM), ["attribute"])


@query("b4_drop_augmented", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def b4(spark, d):
    return schema.drop_augmented(roled(spark, d), ["o_totalprice", "o_orderkey", "o_custkey", "o_orderstatus"])


@query("b5_target_frame", "SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(label AS VARCHAR) AS label, label || ',' || (label + 1) AS pair FROM embeddings")
def b5(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.array("label", F.col("label") + 1).alias("pair"))
    schema.check_key(e, "vec_id")
    return schema.target_frame(e, "vec_id", ["label", "pair"])


@query("b6_parse_columns", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS ts, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def b6(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("bad"))
    return schema.parse_columns(e, {"k": "integer", "ts": "dateTime", "bad": "real"}).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("b7_cast_to", "SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS p_retailprice FROM (SELECT p_partkey, floor(p_retailprice) AS p_retailprice FROM part)")
def b7(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.floor("p_retailprice").cast("string").alias("p_retailprice"))
    return schema.cast_to(p, ["p_retailprice"], "bigint")


@query("b8_to_numeric", "SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice FROM orders")
def b8(spark, d):
    return schema.to_numeric(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), keep=["o_orderkey"])


@query("b9_drop_empty_targets", f"SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, {null_sql('o_orderkey', 'o_orderstatus')} AS o_orderstatus FROM orders) WHERE o_orderstatus IS NOT NULL")
def b9(spark, d):
    return schema.drop_empty_targets(with_nulls(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"]), PROBLEM)


@query("b10_construct_predictions", "SELECT o_orderkey, o_orderpriority AS o_orderstatus FROM orders")
def b10(spark, d):
    return schema.construct_predictions(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", "o_orderstatus")


@query("b11_vectors", "SELECT p_partkey, p_size::DOUBLE AS v0, p_retailprice AS v1 FROM part")
def b11(spark, d):
    v = schema.cols_to_vector(table(spark, d, "part"), ["p_size", "p_retailprice"], "v", dense=False)
    return schema.vector_to_cols(v, "v", 2, "v").select("p_partkey", "v0", "v1")


@query("b12_compose_group_key", "SELECT event_type || '|' || user_id AS group_key, count(*) AS n FROM events GROUP BY 1")
def b12(spark, d):
    return schema.compose_group_key(table(spark, d, "events"), ["event_type", "user_id"]).groupBy("group_key").agg(F.count("*").alias("n"))


@query("b13_condition", "SELECT o_orderkey, o_totalprice, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders")
def b13(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.concat(F.lit("n"), "o_custkey").alias("wide"))
    return schema.condition(o, ["o_orderkey"])


@query("c1_infer_types", "SELECT * FROM (VALUES ('event_id', 'integer'), ('ts', 'dateTime'), ('event_type', 'categorical'), ('value', 'real'), ('flag', 'boolean'), ('note', 'text')) t(\"column\", type) WHERE (SELECT count(*) FROM events) > 0")
def c1(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type", "value", (F.col("user_id") % 2).alias("flag"), F.concat_ws(" ", "event_type", "event_id").alias("note"))
    return clean.infer_types(e, e.columns)


C2_COLUMNS = ("o_custkey", "o_orderstatus", "o_totalprice")


def _c2(c: str, number: bool) -> str:
    x = f"{c}::DOUBLE" if number else "NULL::DOUBLE"
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct", round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(avg({x}), 4) AS mean,
 (SELECT {c}::VARCHAR FROM t WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top, round(stddev_samp({x}), 4) AS std, round(quantile_cont({x}, 0.25), 4) AS q1, round(quantile_cont({x}, 0.5), 4) AS median, round(quantile_cont({x}, 0.75), 4) AS q3,
 round((SELECT count(*) FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) / count({c}), 6) AS top_share FROM t"""


@query("c2_profile", f"WITH t AS (SELECT o_custkey, {null_sql('o_orderkey', 'o_orderstatus')} AS o_orderstatus, {null_sql('o_orderkey', 'o_totalprice')} AS o_totalprice FROM orders) " + " UNION ALL ".join(_c2(c, c != "o_orderstatus") for c in C2_COLUMNS))
def c2(spark, d):
    o = with_nulls(table(spark, d, "orders").select("o_orderkey", *C2_COLUMNS), "o_orderkey", ["o_orderstatus", "o_totalprice"])
    p = clean.profile(o, C2_COLUMNS)
    return p.select("column", "rows", "nulls", "distinct", "top", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std", "q1", "median", "q3")], F.round("top_share", 6).alias("top_share"))


@query("c3_clean_featurize", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS o_orderpriority_0, split_part(o_orderpriority, '-', 2) AS o_orderpriority_1, 'F' AS code_alpha, CAST(o_custkey AS VARCHAR) AS code_digits FROM orders")
def c3(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.concat(F.lit("F"), "o_custkey").alias("code"))
    return clean.clean_featurize(o, ["o_orderpriority", "code"])


@query("c4_enrich_dates", "SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, quarter(o_orderdate)::INT AS o_orderdate_quarter, month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day, isodow(o_orderdate)::INT AS o_orderdate_weekday, dayofyear(o_orderdate)::INT AS o_orderdate_dayofyear FROM orders")
def c4(spark, d):
    return clean.enrich_dates(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"]).drop("o_orderdate")


@query("c5_replace_singletons", "SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY c) = 1 THEN '__other__' ELSE c END AS c FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice / 20) AS BIGINT) AS VARCHAR) AS c FROM orders)")
def c5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 20).cast("string").alias("c"))
    return clean.replace_singletons(o, ["c"])


def holed(spark, d):
    return with_nulls(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand"), "p_partkey", ["p_size", "p_retailprice", "p_brand"])


HOLED = f"(SELECT p_partkey, {null_sql('p_partkey', 'p_size')} AS p_size, {null_sql('p_partkey', 'p_retailprice')} AS p_retailprice, {null_sql('p_partkey', 'p_brand')} AS p_brand FROM part)"


@query("c6_impute_median", f"SELECT p_partkey, round(coalesce(p_size::DOUBLE, (SELECT quantile_cont(p_size, 0.5) FROM {HOLED})), 4) AS p_size, round(coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5) FROM {HOLED})), 4) AS p_retailprice FROM {HOLED}")
def c6(spark, d):
    x = clean.impute(holed(spark, d).select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"], "median")
    return x.select("p_partkey", F.round("p_size", 4).alias("p_size"), F.round("p_retailprice", 4).alias("p_retailprice"))


@query("c6_impute_frequent", f"SELECT p_partkey, coalesce(p_size, (SELECT p_size FROM {HOLED} WHERE p_size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS p_size FROM {HOLED}")
def c6f(spark, d):
    return clean.impute(holed(spark, d).select("p_partkey", "p_size"), ["p_size"], "most_frequent")


@query("c7_impute_mean", f"SELECT p_partkey, round(coalesce(p_retailprice, (SELECT avg(p_retailprice) FROM {HOLED})), 4) AS p_retailprice FROM {HOLED}")
def c7(spark, d):
    return clean.impute_mean(holed(spark, d).select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("c8_impute_categorical", f"SELECT p_partkey, coalesce(p_brand, (SELECT p_brand FROM {HOLED} WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS p_brand, coalesce(p_brand, '__missing__') AS marked FROM {HOLED}")
def c8(spark, d):
    x = holed(spark, d).select("p_partkey", "p_brand", F.col("p_brand").alias("marked"))
    return clean.impute_categorical(clean.impute_categorical(x, ["p_brand"]), ["marked"], explicit=True)


C9_SQL = f"""WITH t AS {HOLED}, s AS (SELECT *, {u_sql('p_partkey', 'greedy')} < 0.1 AS h FROM t),
f AS (SELECT 'mean' AS name, avg(p_retailprice) AS v FROM s WHERE NOT h UNION ALL SELECT 'median', quantile_cont(p_retailprice, 0.5) FROM s WHERE NOT h UNION ALL SELECT 'zero', 0.0
 UNION ALL SELECT 'mode', (SELECT p_retailprice FROM s WHERE NOT h AND p_retailprice IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
e AS (SELECT name, v, round(avg(abs(p_retailprice - v)), 9) AS e FROM f CROSS JOIN s WHERE h AND p_retailprice IS NOT NULL GROUP BY 1, 2),
b AS (SELECT name, v FROM e ORDER BY e, name LIMIT 1)
SELECT p_partkey, round(coalesce(p_retailprice, v), 4) AS p_retailprice, name AS p_retailprice_strategy FROM t CROSS JOIN b"""


@query("c9_impute_greedy", C9_SQL)
def c9(spark, d):
    return clean.impute_greedy(holed(spark, d).select("p_partkey", "p_retailprice"), ["p_retailprice"], "p_partkey").withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("c10_impute_iterative")
def c10(spark, d):
    return clean.impute_iterative(holed(spark, d).select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 50).alias("m")), ["p_size", "p_retailprice", "m"], rounds=1)


@query("c11_impute_matrix")
def c11(spark, d):
    return clean.impute_matrix(holed(spark, d).select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"], rank=2, iters=3)


@query("c12_missing_indicator", f"SELECT p_partkey, (p_size IS NULL)::INT AS p_size_missing, (p_brand IS NULL)::INT AS p_brand_missing FROM {HOLED}")
def c12(spark, d):
    return clean.missing_indicator(holed(spark, d), ["p_size", "p_brand"]).select("p_partkey", "p_size_missing", "p_brand_missing")


@query("c13_limit_size", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {u_sql('o_orderkey')} < 500 / (SELECT count(*) FROM orders)")
def c13(spark, d):
    return clean.limit_size(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 500, 1, ["o_custkey", "o_totalprice"])


@query("c14_sample_rows", f"SELECT o_orderkey FROM orders WHERE {u_sql('o_orderkey', 's')} < 0.25")
def c14(spark, d):
    return clean.sample_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.25, "s")


@query("c15_column_sample", f"SELECT DISTINCT o_custkey AS value FROM (SELECT o_custkey, (SELECT count(*) FROM orders) AS n, row_number() OVER (ORDER BY {u_sql('o_orderkey')}, o_orderkey) AS k, {u_sql('o_orderkey')} AS u FROM orders) WHERE CASE WHEN n > 100000 THEN u < 0.1 WHEN n > 1000 THEN k <= 1000 ELSE true END")
def c15(spark, d):
    return clean.column_sample(table(spark, d, "orders"), "o_orderkey", "o_custkey")


@query("c16_candidate_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'attribute' AS role, count({c}) AS filled, count(DISTINCT {c}) AS different FROM orders" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")))
def c16(spark, d):
    return clean.candidate_columns(roled(spark, d), ["attribute"])


@query("c17_series_to_long", "SELECT o_orderkey, 'o_totalprice' AS step, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'half', round(o_totalprice / 2, 4) FROM orders")
def c17(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.round(F.col("o_totalprice") / 2, 4).alias("half"))
    return clean.series_to_long(o, "o_orderkey", ["o_totalprice", "half"])


@query("c17_series_to_list", "SELECT user_id, array_to_string(list(value ORDER BY ts, event_id), ',') AS values FROM events GROUP BY 1")
def c17l(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.round("value", 2).alias("value"))
    return clean.series_to_list(e, "user_id", "at", "value").select("user_id", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("values"))
