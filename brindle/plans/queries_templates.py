"""Queries over the given tables: templates that run from raw tables, and the search that learns."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import query
from brindle.functions.keys import u, u_sql
from brindle.plans import jobs
from brindle.plans.queries_ac import folder
from brindle.plans.queries_df import FEATURES, TOKENS, lines
from brindle.session import table

CUT = 0.2


def _nb_sql(rows: str, n: int, digits: int = 6) -> str:
    """Gaussian naive Bayes over ``rows(row_id, y, train, f0, f1, ...)``: the prediction of the rows that aren't in training."""
    stats = ", ".join(f"avg(f{i}) AS m{i}, greatest(var_pop(f{i}), max(floor)) AS v{i}" for i in range(n))
    log = " - ".join(["ln(n / (SELECT sum(n) FROM s))", *(f"0.5 * ln(2 * pi() * v{i}) - pow(f{i} - m{i}, 2) / (2 * v{i})" for i in range(n))])
    return f"""WITH x AS ({rows}), o AS (SELECT 1e-9 * greatest({", ".join(f"var_pop(f{i})" for i in range(n))}) AS floor FROM x WHERE train),
s AS (SELECT y AS class, count(*) AS n, {stats} FROM x CROSS JOIN o WHERE train GROUP BY 1), p AS (SELECT row_id, class, {log} AS l FROM x CROSS JOIN s WHERE NOT train)
SELECT row_id, first(class ORDER BY l DESC, class) AS pred, round(1 / sum(exp(l - m)), {digits}) AS confidence FROM (SELECT *, max(l) OVER (PARTITION BY row_id) AS m FROM p) GROUP BY 1"""


def _stored_nb(spark, problem: jobs.Problem, df, digits: int = 6):
    """Fit the template's steps and naive Bayes on the training rows, store the pipeline, and predict the others with what is
    read back."""
    fitted = jobs.fit(problem, {"model": "gaussian_nb", "steps": [("scale", "nothing", "table")]}, df.where(u(problem.key) >= CUT))
    stored = jobs.load(problem, jobs.save(fitted, folder(spark, "template") + "/pipeline"))
    told = jobs.produce(stored, df.where(u(problem.key) < CUT).drop(problem.target))
    return told.select(F.col(problem.key).alias("row_id"), "pred", F.round("confidence", digits).alias("confidence"))


_LANGS = ("de", "en", "es", "fr")


@query("j2_text_template", _nb_sql(f"""SELECT d.doc_id AS row_id, lang AS y, {u_sql('d.doc_id')} >= {CUT} AS train, n_chars::DOUBLE AS f0, {", ".join(f"coalesce(t{i}, 0) AS f{i + 1}" for i in range(4))} FROM documents d LEFT JOIN
 (WITH w AS (SELECT doc_id, lang, {TOKENS} AS token FROM documents), k AS (SELECT token, {", ".join(f"ln((count(*) FILTER (lang = '{c}') + 1) / (count(*) + 4)) AS w{i}" for i, c in enumerate(_LANGS))} FROM w WHERE {u_sql('doc_id')} >= {CUT} GROUP BY 1)
 SELECT doc_id, {", ".join(f"avg(w{i}) AS t{i}" for i in range(4))} FROM w JOIN k USING (token) GROUP BY 1) USING (doc_id)""", 5))
def j2_text(spark, d):
    """Texts scored by class, and their length."""
    return _stored_nb(spark, jobs.Problem("doc_id", ["n_chars"], "lang", roles={"texts": ["text"]}), table(spark, d, "documents").select("doc_id", "text", "n_chars", "lang"))


@query("j2_event_template", _nb_sql(f"SELECT event_id AS row_id, event_type AS y, {u_sql('event_id')} >= {CUT} AS train, value AS f0, year(ts)::DOUBLE AS f1, quarter(ts)::DOUBLE AS f2, month(ts)::DOUBLE AS f3, day(ts)::DOUBLE AS f4, isodow(ts)::DOUBLE AS f5, dayofyear(ts)::DOUBLE AS f6 FROM events", 7))
def j2_events(spark, d):
    """Events by their value and the parts of their date."""
    return _stored_nb(spark, jobs.Problem("event_id", ["value"], "event_type", roles={"dates": ["ts"]}), table(spark, d, "events").select("event_id", "ts", "value", "event_type"))


_REL = [f"{f}({c})" for c in ("l_quantity", "l_tax") for f in ("sum", "avg", "min", "max", "stddev_samp")]
_REL_SQL = ", ".join(f"coalesce(r{i}, (SELECT avg(r{i}) FROM j WHERE train)) AS f{i + 2}" for i in range(10))


@query("j2_multi_table_template", _nb_sql(f"""WITH c AS (SELECT l_orderkey, count(*) AS n, {", ".join(f"{f} AS r{i}" for i, f in enumerate(_REL))} FROM lineitem GROUP BY 1),
 j AS (SELECT *, {u_sql('o_orderkey')} >= {CUT} AS train FROM orders LEFT JOIN c ON o_orderkey = l_orderkey), t AS (SELECT DISTINCT o_orderpriority AS v FROM orders)
 SELECT o_orderkey AS row_id, o_orderstatus AS y, train, o_totalprice AS f0, coalesce(n, 0)::DOUBLE AS f1, {_REL_SQL}, {", ".join(f"(o_orderpriority = (SELECT v FROM t ORDER BY v LIMIT 1 OFFSET {i}))::INT::DOUBLE AS f{12 + i}" for i in range(5))} FROM j""", 17))
def j2_multi(spark, d):
    """Orders with their lines aggregated and their priority encoded."""
    roles = {"categories": ["o_orderpriority"], "related": (table(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_tax"]), "related_by": "o_orderkey"}
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return _stored_nb(spark, jobs.Problem("o_orderkey", ["o_totalprice"], "o_orderstatus", roles=roles), orders)


def _projection_sql(j: int) -> str:
    sign = f"CASE WHEN CAST('0x' || substr(md5(i || '-{j}'), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 THEN 1 ELSE -1 END / 2"
    return f"list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * {sign})) AS f{j}"


@query("j2_series_template", _nb_sql(f"SELECT vec_id AS row_id, label AS y, {u_sql('vec_id')} >= {CUT} AS train, {', '.join(_projection_sql(j) for j in range(4))} FROM embeddings", 4, 4))
def j2_series(spark, d):
    """Series of 64 values, projected at random."""
    return _stored_nb(spark, jobs.Problem("vec_id", [], "label", roles={"series": ("embedding", 64)}), table(spark, d, "embeddings"), 4)


@query("j8_bandit_search")
def j8_bandit(spark, d):
    """Eight turns over three templates, one of which always fails: each turn's template, point, rank and kind of failure."""
    df = lines(spark, d).select("row_id", *FEATURES, "l_returnflag")
    arms = {"dummy": ["dummy"], "naive_bayes": ["gaussian_nb"], "text": ["no_such_model"]}
    reports, _ = jobs.bandit_search(jobs.Problem("row_id", FEATURES, "l_returnflag"), df, arms, draws=8)
    return reports.select("id", "turn", "template_name", "model", F.round("cv", 6).alias("cv"), "rank", F.regexp_extract("error", r"^(\w+)", 1).alias("failure"))
