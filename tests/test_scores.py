"""Scores of a fitted pipeline without a join, predicted once; the same as from joined predictions."""

import pytest
from pyspark.sql import functions as F

from brindle.plans import jobs
from brindle.session import scratch


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 7 > 3, "b").otherwise("a").alias("y"))
    return scratch(df.withColumn("y", F.when(F.col("id") % 10 != 0, F.when(F.col("id") % 9 == 0, "c").otherwise(F.col("y")))), "score-rows")


@pytest.mark.parametrize("point", [{"model": "decision_tree", "depth": 2}, {"model": "dummy"}, {"model": "gaussian_nb"}, {"model": "gaussian_nb", "steps": [("scale", "standard_scale", "table")]}])
def test_scores_equal_those_of_joined_predictions(rows, point, monkeypatch):
    problem = jobs.Problem("id", ["x"], "y")
    fitted = jobs.fit(problem, point, rows.where("y is not null"))
    want = {(r.metric, round(r.value, 12)) for r in jobs.score_predictions(problem, jobs.produce(fitted, rows), rows).collect()}
    monkeypatch.setattr(jobs, "score_predictions", None)  # joins predictions and truth
    found = jobs.score(fitted, rows)
    assert {(r.metric, round(r.value, 12)) for r in found.collect()} == want and len(want) == 2
    assert (found.count(), found.select("fold", "candidate_id").distinct().collect()) == (2, [("test", "a")])


def test_a_search_fits_each_point_once_for_its_score(rows, monkeypatch):
    fits, fit = [], jobs.fit
    monkeypatch.setattr(jobs, "fit", lambda problem, point, df: fits.append(point["candidate_id"]) or fit(problem, point, df))
    points = [{"candidate_id": "tree", "model": "decision_tree", "depth": 2}, {"candidate_id": "dummy", "model": "dummy"}]
    scores, _ = jobs.run_search(jobs.Problem("id", ["x"], "y"), rows, points)
    assert sorted(fits) == ["dummy", "tree", "tree", "tree"]  # the best one once more for test1 and once on all rows
    assert scores.where("rank = 1").first()["candidate_id"] == "tree" and scores.count() == 8
