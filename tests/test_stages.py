"""Pipelines from raw tables, stored and read again, and the search that learns."""

import time

import pytest
from pyspark.sql import functions as F

from brindle.plans import jobs, search
from brindle.session import shared_dir


@pytest.fixture(scope="module")
def raw(spark):
    """The class follows the category, the text and the related rows; numbers, categories and texts have gaps."""
    df = spark.range(160).withColumn("t", F.when(F.col("id") % 3 == 0, "low").otherwise("high"))
    low = F.col("t") == "low"
    df = df.withColumns({
        "x": F.when(F.col("id") % 5 != 0, (F.col("id") % 7).cast("double")),
        "c": F.when(F.col("id") % 11 != 0, F.when(low, "red").otherwise(F.concat(F.lit("blue"), (F.col("id") % 2).cast("string")))),
        "s": F.when(F.col("id") % 13 != 0, F.when(low, "a small and cheap thing").otherwise("a large and dear thing")),
        "day": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")),
        "v": F.array(*[(F.col("id") % (k + 2) + F.when(low, 0).otherwise(5)).cast("double") for k in range(6)]),
        "z": F.col("id") * 2.0 + F.when(low, 100).otherwise(0), "l1": low, "l2": F.col("id") % 2 == 0,
        "g": (F.col("id") % 4).cast("string"), "user": F.col("id") % 9, "item": F.col("id") % 8,
    })
    return df.cache()


@pytest.fixture(scope="module")
def related(spark):
    return spark.range(500).select((F.col("id") % 160).alias("of"), (F.when(F.col("id") % 160 % 3 == 0, 1.0).otherwise(9.0) + F.col("id") % 2).alias("amount")).where("of != 7")


def roles(related, *names):
    every = {"categories": ["c"], "texts": ["s"], "dates": ["day"], "series": ("v", 6), "related": (related, "of", ["amount"])}
    return {k: every[k] for k in names} | {"related_by": "id"}


@pytest.mark.parametrize("names", [("categories",), ("texts",), ("series",), ("related",), ("categories", "texts", "dates", "series", "related")])
def test_a_stored_pipeline_predicts_unseen_rows_as_the_fitted_one(spark, raw, related, names):
    problem = jobs.Problem("id", ["x"], "t", roles=roles(related, *names))
    train, new = raw.where("id < 120"), raw.where("id >= 120").drop("t")
    steps = [("scale", "standard_scale", "table")]
    for model in ("gaussian_nb", "decision_tree"):
        fitted = jobs.fit(problem, {"model": model, "steps": steps}, train)
        told = {r.id: (r.pred, round(r.confidence, 9)) for r in jobs.produce(fitted, new).collect()}
        stored = jobs.load(problem, jobs.save(fitted, f"{shared_dir(spark)}/stage-test-{'-'.join(names)}-{model}"))
        assert {r.id: (r.pred, round(r.confidence, 9)) for r in jobs.produce(stored, new).collect()} == told
        right = {r.id: r.t for r in raw.where("id >= 120").collect()}
        assert sum(told[k][0] == right[k] for k in right) >= 0.85 * len(right) == 34


def test_what_was_learned_does_not_change_with_new_rows(spark, raw, related):
    """A single new row is cleaned by the training rows' values, not by its own."""
    problem = jobs.Problem("id", ["x"], "t", roles=roles(related, "categories", "texts"))
    fitted = jobs.fit(problem, {"model": "gaussian_nb"}, raw)
    odd = spark.createDataFrame([(900, None, "green", "words unknown here"), (901, None, None, None)], "id long, x double, c string, s string")
    impute = next(s for s in fitted.model.stages if type(s).__name__ == "ImputeModel")
    assert impute.transform(odd).first()["x"] == pytest.approx(raw.agg(F.avg("x")).first()[0])
    assert jobs.produce(fitted, odd).count() == 2
    encoded = next(s for s in fitted.model.stages if type(s).__name__ == "EncodeModel").transform(odd).collect()
    assert encoded[0]["_enc_c_3"] == 1.0 and encoded[1]["_enc_c_4"] == 1.0


def test_families_of_tables_run_from_the_raw_table(spark, raw, related):
    """Every template but those of graphs, which take edges."""
    every = roles(related, "categories", "texts", "dates", "series", "related")
    more = {"privileged": ["z"], "labels": ["l1", "l2"], "group": "g", "ts": "id", "user": "user", "item": "item"}
    own = {"forecasting": ("z", False, {}), "collaborative": ("z", False, {}), "multi_table": ("z", False, every), "regression": ("z", False, every)}
    for name, task, _, _, names, _ in search.TEMPLATES:
        if task == "graph":
            continue
        target, classes, given = own.get(name, ("t", True, every))
        if name == "series":
            given = roles(related, "series")
        problem = jobs.Problem("id", ["x"], target, classes, given | more)
        df = raw.withColumn("t", F.when(F.col("id") < 140, F.col("t"))) if name == "semi_supervised" else raw
        point = jobs.points_of(spark, name, names[-1:], 0)[0] | ({"trees": 3, "depth": 2} if names[-1] in ("gradient_boosting", "random_forest") else {})
        told = jobs.fit_produce(problem, point, df, raw.where("id >= 140"))
        assert {"id", "pred"} <= set(told.columns) and told.select("id").distinct().count() == 20, name


def test_jmi_keeps_what_tells_the_class(spark, raw, related):
    problem = jobs.Problem("id", ["x", "z"], "t", roles=roles(related, "categories", "related"))
    fitted = jobs.fit(problem, {"model": "decision_tree", "depth": 2, "steps": [("select", "jmi", "table", {"k": 2})]}, raw)
    kept = next(s for s in fitted.model.stages if type(s).__name__ == "SelectJMIModel").known
    names = next(s for s in fitted.model.stages if type(s).__name__ == "ToVectorModel").known
    assert len(kept) == 2 and names[kept[0]].startswith("rel_amount")


REWARDS = {"good": 0.9, "bad": 0.2}


@pytest.fixture
def stubbed(monkeypatch, spark):
    def evaluate(problem, point, splits, mode):
        if point["template"] == "broken":
            raise ValueError("no such thing")
        return spark.createDataFrame([("accuracy", REWARDS[point["template"]], True)], "metric string, value double, larger boolean"), None

    monkeypatch.setattr(jobs, "evaluate", evaluate)
    monkeypatch.setattr(jobs, "fit", lambda problem, point, df: point)


def test_the_better_arm_is_drawn_more_and_failures_are_rows(spark, raw, stubbed):
    problem = jobs.Problem("id", ["x"], "t")
    arms = {"good": ["decision_tree"], "bad": ["decision_tree"], "broken": ["decision_tree"]}
    reports, best = jobs.bandit_search(problem, raw, arms, draws=18)
    rows = sorted(reports.collect(), key=lambda r: r.turn)
    drawn = [r.template_name for r in rows]
    assert sorted(drawn[:3]) == ["bad", "broken", "good"] and len(rows) == 18
    assert drawn.count("good") > drawn.count("bad") >= 1
    assert all((r.error == "ValueError: no such thing") == (r.cv is None) == (r["rank"] is None) == (r.template_name == "broken") for r in rows)
    assert best["template"] == "good" and min(r.turn for r in rows if r["rank"] == 1) == drawn.index("good")
    assert len({r.id for r in rows}) == 18


def test_a_search_ends_with_its_time_and_without_a_result(spark, raw, stubbed):
    problem = jobs.Problem("id", ["x"], "t")
    began = time.monotonic()
    reports, best = jobs.bandit_search(problem, raw, {"broken": ["decision_tree"]}, draws=1000, seconds=4)
    assert best is None and 1 <= reports.count() < 100 and time.monotonic() - began < 60
    assert jobs.bandit_search(problem, raw, {"good": ["decision_tree"]}, draws=5, seconds=0)[0].count() == 0
