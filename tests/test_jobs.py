"""Pipelines from templates and one-call jobs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import models
from brindle.plans import jobs, search


@pytest.fixture(scope="module")
def rows(spark):
    """Two classes that x tells apart; y is noise and sometimes missing, w is ten times x and a little more."""
    df = spark.range(240).withColumns({"x": (F.col("id") % 12).cast("double"), "y": F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 11).cast("double"))})
    return df.withColumns({"t": F.when(F.col("x") < 6, "low").otherwise("high"), "w": 10 * F.col("x") + F.col("id") % 5}).cache()


def test_every_template_model_is_known():
    known = set(models.CLASSIFIERS) | set(models.REGRESSORS) | set(jobs.OTHERS)
    assert {m for t in search.TEMPLATES for m in t[4]} <= known
    assert set(jobs.CHAINS) <= {t[0] for t in search.TEMPLATES}


def test_steps_are_wired_by_name(spark, rows):
    problem = jobs.Problem("id", ["x", "y"], "t")
    with pytest.raises(ValueError):
        jobs.chain(problem, [("a", "nothing", "b")])
    with pytest.raises(ValueError):
        jobs.chain(problem, [("a", "nothing", "table"), ("a", "nothing", "table")])
    # the model reads the last step, which goes back to the table past the first one
    steps = [("small", "pca", "table", {"k": 1}), ("scale", "standard_scale", "table"), ("best", "percentile", "scale", {"keep": 0.5})]
    fitted = jobs.fit(problem, {"model": "decision_tree", "steps": steps}, rows)
    assert fitted.model.stages[-2].numFeatures == 1
    assert jobs.score(fitted, rows).where("metric = 'accuracy'").first().value == 1.0


def test_points_follow_the_template(spark):
    points = jobs.points_of(spark, "classification", ["random_forest"], 3)
    assert len(points) == 4 and points[0]["steps"][0] == ("scale", "nothing", "table")
    for p in points:
        assert 10 <= p["trees"] <= 50 and 4 <= p["depth"] <= 8
        assert [(s[0], s[2]) for s in p["steps"]] == [("scale", "table"), ("select", "scale")]
    assert jobs.points_of(spark, "dummy", ["dummy"], 2) == [{"candidate_id": "dummy-dummy-0", "template": "dummy", "model": "dummy", "steps": []}]


def test_regression_and_evaluation(rows):
    problem = jobs.Problem("id", ["x", "y"], "w", classification=False)
    splits = jobs.split.nested_splits(rows, "id")
    scores, fitted = jobs.evaluate(problem, {"candidate_id": "a", "model": "decision_tree", "steps": [("best", "percentile", "table")]}, splits, folds=2)
    assert {r.fold for r in scores.collect()} == {"train", "test2", "test1", "cv"}
    assert jobs.score(fitted, rows).where("metric = 'rSquared'").first().value > 0.9


def test_search_ranks_and_refits(rows):
    problem = jobs.Problem("id", ["x", "y"], "t")
    scores, best = jobs.run_search(problem, rows, [{"candidate_id": "d", "model": "dummy"}, {"candidate_id": "n", "model": "gaussian_nb"}])
    ranked = {r.candidate_id: r.rank for r in scores.where("rank is not null").collect()}
    assert ranked == {"n": 1, "d": 2}
    assert best.point["candidate_id"] == "n" and jobs.produce(best, rows.drop("t")).count() == 240


def test_order_of_a_series_is_found(spark):
    """A series of order 2 is told from one of order 1; one too short for any order stays without a forecast."""
    rng, out = np.random.default_rng(3), []
    for name, (a, b) in {"one": (0.7, 0.0), "two": (0.2, 0.7)}.items():
        y = [1.0, 2.0]
        for _ in range(400):
            y.append(a * y[-1] + b * y[-2] + 1 + rng.normal(0, 0.5))
        out += [(name, i, float(v)) for i, v in enumerate(y)]
    out.append(("short", 0, 1.0))
    found = {r.g: r for r in models.fit_ar(spark.createDataFrame(out, "g string, i long, v double"), "g", "i", "v", (1, 2)).collect()}
    y = np.array([v for g, _, v in out if g == "two"])
    x = np.column_stack([np.ones(len(y) - 2), y[1:-1], y[:-2]])
    w = np.linalg.lstsq(x, y[2:], rcond=None)[0]
    assert found["two"]["order"] == 2 and np.allclose(found["two"].weights, w)
    assert abs(found["two"].forecast - (w @ [1, y[-1], y[-2]])) < 1e-9
    assert len(found["one"].weights) == found["one"]["order"] + 1 and found["short"].forecast is None


def test_stacking_learns_from_its_bases_but_not_from_a_row_itself(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random()) for i in range(240)]
    told = spark.createDataFrame([(i, x, y, "a" if x > 0.5 else "b") for i, x, y in rows], "id long, x double, y double, label string")
    found = models.stack_folds(told, ["x", "y"], "label", "id").join(told, "id")
    assert found.count() == 240 and found.where("pred = label").count() > 200
    # labels that nothing tells: a model that saw a row's own label would do better than chance
    noise = spark.createDataFrame([(i, x, y, rng.choice("ab")) for i, x, y in rows], "id long, x double, y double, label string")
    assert models.stack_folds(noise, ["x", "y"], "label", "id").join(noise, "id").where("pred = label").count() < 160
