"""Edge cases that the table queries do not meet."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import metrics, user
from brindle.operators import clean, encode, models, relate, schema, select, split
from brindle.plans import search
from brindle.session import scratch, shared_dir


def test_keys_and_names_are_checked(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, t string")
    with pytest.raises(ValueError):
        schema.check_key(df, "k")
    with pytest.raises(ValueError):
        schema.target_frame(df, "k", ["confidence"])
    with pytest.raises(ValueError):
        schema.target_frame(df, "missing", ["t"])
    with pytest.raises(ValueError):
        metrics.score(df, ["accuracy", "accuracy"])
    with pytest.raises(ValueError):
        relate.join_truth(df, df.select("k"), "k")


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(i, 5.0, None) for i in range(9)], "k long, c double, n double")
    assert {r.c for r in encode.scale_iqr(df, ["c"]).collect()} == {0.0}
    assert select.select_variance(df, ["c"]).columns == ["k", "n"]
    assert schema.to_numeric(df).columns == ["k", "c"]
    assert clean.impute_mean(df, ["n"]).where("n is null").count() == 9
    kinds = {r["column"]: r["type"] for r in clean.infer_types(df.limit(0), ["c"]).collect()}
    assert kinds == {}


def test_one_class_and_constant_truth(spark):
    p = spark.createDataFrame([("a", 0, "t", i, "1", "1", 0.5) for i in range(4)], "candidate_id string, fold int, target string, row_id long, truth string, pred string, confidence double")
    assert metrics.roc_auc(p, "1").first().value is None
    assert metrics.r2(p).first().value is None
    assert metrics.nmi(p).first().value == 1.0


def test_small_classes_fall_back_to_plain_folds(spark):
    df = spark.createDataFrame([(i, "x" if i else "y") for i in range(10)], "k long, t string")
    assert split.split_stratified(df, "k", "t", 5).groupBy("fold").count().count() == 5
    assert {r.split for r in split.nested_splits(df, "k", can_split=False).collect()} == {"train"}


def test_value_lists_become_distributions():
    assert search.distribution([3])[0] == "constant"
    assert search.distribution([10, 50, 100]) == ("int", (10, 100))
    assert search.distribution([0.01, 0.1, 1.0])[0] == "log"
    assert search.distribution([0.1, 0.2, 0.3])[0] == "float"
    assert search.distribution(["a", 1])[0] == "choice"
    assert search.default_point({"a": [1, 3], "b": [0.01, 0.1, 1.0], "c": ["x", 2]}) == {"a": "2", "b": "0.1", "c": "x"}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    found = {r.node: r.component for r in models.connected(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_scratch_follows_the_cluster_setting(spark):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.checkpoint.dir": "hdfs://shared/here"})

    assert shared_dir(Session) == "hdfs://shared/here"
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch(spark.range(3), "t").count() == 3


def test_steps_are_registered_once():
    user.register_step("own", dict)
    with pytest.raises(ValueError):
        user.register_step("own", dict)


def test_vote_and_augment(spark):
    p = spark.createDataFrame([(1, "b", None), (1, "a", 0.5), (1, "a", 0.5)], "k long, pred string, confidence double")
    assert models.vote(p, "k").first().pred == "a"
    df = spark.createDataFrame([(1,)], "k long")
    other = spark.createDataFrame([(1, 2.0), (1, 4.0)], "k long, v double")
    once = relate.augment(df, other, {"k": "k"}, ["v"])
    assert once.first().aug_v == 3.0 and relate.augment(once, other, {"k": "k"}, ["v"]) is once
    assert relate.denormalize(df, [(other, "k", "k")]).count() == 1
    assert relate.denormalize(df, [(other, "k", "k")], ["graph"]) is df
    assert clean.limit_size(df, "k", 5, 1, []).count() == 1
    assert df.select(relate.subset(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("s")).first().s
