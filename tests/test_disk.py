"""What loops leave on disk: tables of one round, not of all."""

from pyspark.sql import functions as F

from brindle.operators import models


def test_an_embedding_keeps_one_round(spark, monkeypatch):
    written, dropped = [], []
    scratch, discard = models.scratch, models.discard
    monkeypatch.setattr(models, "scratch", lambda df, name: written.append(name) or scratch(df, name))
    monkeypatch.setattr(models, "discard", lambda df: dropped.append(1) or discard(df))
    edges = spark.createDataFrame([(i, 100 + i % 7) for i in range(60)] + [(i, 100 + i % 5) for i in range(60)], "src long, dst long").distinct()
    assert models.spectral_embedding(edges, 2, 6).where(F.size("vec") == 2).count() == 67
    assert written.count("graph-vectors") - len(dropped) == 1


def test_stacked_predictions_need_no_join(spark, monkeypatch):
    df = models.scratch(spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"), F.when(F.col("id") % 7 > 3, "x").otherwise("y").alias("c")), "stack-rows")
    plans, scratch = [], models.scratch
    monkeypatch.setattr(models, "scratch", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or scratch(df, name))
    told = models.stack_folds(df, ["a", "b"], "c", "id")
    assert "Join" not in dict(plans)["stack-coded"]
    found = {r.id: r.pred for r in told.collect()}
    assert len(found) == 300 and sum((i % 7 > 3) == (p == "x") for i, p in found.items()) > 280
