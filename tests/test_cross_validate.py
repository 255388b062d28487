"""The folds' mean score equals that of Spark's own cross-validator, and nothing is cached."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import models
from brindle.plans import search
from brindle.session import discard, scratch


@pytest.mark.parametrize("classification", [True, False])
def test_scores_equal_sparks_and_nothing_is_cached(spark, monkeypatch, classification):
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 3).cast("int").alias("fold"))
    df = scratch(df.withColumn("y", ((F.col("a") + F.col("b") * F.col("b")) % 3).cast("double")), "cross-rows")
    learner = LogisticRegression(maxIter=3) if classification else LinearRegression()
    judge = MulticlassClassificationEvaluator(labelCol="y", metricName="f1") if classification else RegressionEvaluator(labelCol="y", metricName="rmse")
    ready = models.assembled(["a", "b"]).transform(df)
    own = learner.copy().setFeaturesCol("_features").setLabelCol("y")
    want = CrossValidator(estimator=own, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=3, foldCol="fold").fit(ready).avgMetrics
    monkeypatch.setattr(DataFrame, "cache", None)
    assert search.cross_validate(df, ["a", "b"], "y", learner, "fold", 3, classification) == pytest.approx(want, abs=1e-9)


def test_a_discarded_table_is_gone(spark, tmp_path):
    df = scratch(spark.range(10), "gone")
    kept, files = scratch(spark.range(10), "kept"), df.inputFiles()
    discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(*files).count()
    assert kept.count() == 10
