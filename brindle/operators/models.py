"""Models: fit and predict (I1 to I33). Predictions carry the key, ``pred`` and ``confidence``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import metrics
from brindle.functions.keys import u
from brindle.operators.neighbours import knn_join
from brindle.operators.ranks import quantiles
from brindle.session import discard, release, scratch


def assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")


def classify(train: DataFrame, features: Sequence[str], target: str, learner, index: bool = True):
    """A pipeline: labels to numbers, features to a vector, the learner, numbers back to labels."""
    labels = StringIndexer(inputCol=target, outputCol="_label", handleInvalid="keep").fit(train)
    learner = learner.setFeaturesCol("_features").setLabelCol("_label") if not isinstance(learner, OneVsRest) else learner
    stages = [labels, assembled(features), learner]
    stages.append(IndexToString(inputCol="prediction", outputCol="pred", labels=labels.labels))
    return Pipeline(stages=stages).fit(train)


def regress(train: DataFrame, features: Sequence[str], target: str, learner):
    return Pipeline(stages=[assembled(features), learner.setFeaturesCol("_features").setLabelCol(target)]).fit(train)


def predict(model, df: DataFrame, key: str, more: Sequence[str] = ()) -> DataFrame:
    """(key, pred, confidence) of a fitted pipeline; confidence is the largest probability, or 1. At fit
    time labels of unseen kinds are kept as one more class; a prediction never needs the label column."""
    stages = [s for s in model.stages if not type(s).__name__.startswith("StringIndexer")]
    out = df
    for s in stages:
        out = s.transform(out)
    pred = F.col("pred") if "pred" in out.columns else F.col("prediction")
    sure = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(1.0)
    return out.select(key, *more, pred.alias("pred"), sure.alias("confidence"))


# --- closed forms -------------------------------------------------------------------------------------


def fit_dummy(train: DataFrame, target: str, classification: bool = True) -> DataFrame:
    """I1. One row: the majority class (ties to the smallest), or the mean."""
    return train.agg((F.mode(target, True) if classification else F.avg(target)).alias("pred"))


def predict_dummy(model: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return df.select(key).crossJoin(F.broadcast(model)).select(key, "pred", F.lit(1.0).alias("confidence"))


def fit_gaussian_nb(train: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """I10. (class, prior, means, variances) from one aggregate; the variance floor is 1e-9 of the largest."""
    by = train.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in features], *[F.var_pop(c).alias(f"v_{c}") for c in features])
    top = train.agg(F.greatest(*[F.var_pop(c) for c in features]) if len(features) > 1 else F.var_pop(features[0])).first()[0] or 1.0
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return by.withColumns({"prior": F.col("n") / total} | {f"v_{c}": F.greatest(F.col(f"v_{c}"), F.lit(1e-9 * top)) for c in features}).drop("n")


def predict_gaussian_nb(model: DataFrame, df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """The class of largest log density (ties by name), its posterior as confidence. The model has one row
    for each class and is collected into the expression, so prediction is one narrow pass."""
    rows = model.orderBy("class").collect()
    logs = []
    for r in rows:
        log = F.lit(float(np.log(r["prior"])))
        for c in features:
            v = r[f"v_{c}"]
            log = log - F.lit(0.5 * float(np.log(2 * np.pi * v))) - (F.col(c) - r[f"m_{c}"]) * (F.col(c) - r[f"m_{c}"]) / (2 * v)
        logs.append(F.struct(log.alias("log"), F.lit(r["class"]).alias("class")))
    best = F.reduce(F.array(*logs), F.struct(F.lit(float("-inf")).alias("log"), F.lit(rows[0]["class"]).alias("class")), lambda a, x: F.when(x["log"] > a["log"], x).otherwise(a))
    out = df.select(key, F.array(*logs).alias("_l"), best.alias("_b"))
    total = F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.exp(x["log"] - F.col("_b.log")))
    return out.select(key, F.col("_b.class").alias("pred"), (1 / total).alias("confidence"))


def knn_predict(train: DataFrame, df: DataFrame, key: str, vector: str, target: str, k: int = 5, classification: bool = True, same: bool = False) -> DataFrame:
    """I11, I27. Majority (ties to the smallest) or mean over the k nearest training rows."""
    near = knn_join(df, train, key, vector, k, same=same)
    told = near.join(train.select(F.col(key).alias("neighbour"), target), "neighbour")
    if classification:
        votes = told.groupBy(key, target).agg(F.count("*").alias("n"))
        best = votes.groupBy(key).agg(F.min_by(F.struct(target, "n"), F.struct(-F.col("n"), target)).alias("b"))
        return best.select(key, F.col(f"b.{target}").alias("pred"), (F.col("b.n") / k).alias("confidence"))
    return told.groupBy(key).agg(F.avg(target).alias("pred"), F.lit(1.0).alias("confidence"))


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """I14. Weights and intercept from the normal equations; one aggregate of d x d sums."""
    d = len(features)
    sums = [F.count("*").alias("n"), F.sum(target).alias("y"), *[F.sum(c).alias(f"x{i}") for i, c in enumerate(features)], *[F.sum(F.col(c) * F.col(target)).alias(f"b{i}") for i, c in enumerate(features)]]
    sums += [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"a{i}_{j}") for i in range(d) for j in range(i, d)]
    r = train.agg(*sums).first()
    x, n = np.array([r[f"x{i}"] for i in range(d)]), r["n"]
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) - np.outer(x, x) / n
    w = np.linalg.solve(a + alpha * np.eye(d), np.array([r[f"b{i}"] for i in range(d)]) - x * r["y"] / n)
    return w, float(r["y"] / n - w @ x / n)


def predict_linear(model: tuple[np.ndarray, float], df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    w, b = model
    pred = reduce(lambda s, x: s + x, [F.col(c) * float(v) for c, v in zip(features, w, strict=True)], F.lit(b))
    return df.select(key, pred.alias("pred"), F.lit(1.0).alias("confidence"))


def fit_lda(train: DataFrame, features: Sequence[str], target: str) -> list[tuple[str, np.ndarray, float]]:
    """I12. For each class (name, weights, offset) from class means and the pooled covariance."""
    d = len(features)
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"x{i}") for i, c in enumerate(features)], *[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"a{i}_{j}") for i in range(d) for j in range(i, d)]]
    rows = train.groupBy(target).agg(*sums).orderBy(target).collect()
    total = sum(r["n"] for r in rows)
    means = {r[target]: np.array([r[f"x{i}"] / r["n"] for i in range(d)]) for r in rows}
    within = sum(np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) - r["n"] * np.outer(means[r[target]], means[r[target]]) for r in rows) / max(1, total - len(rows))
    inverse = np.linalg.pinv(within)
    return [(r[target], inverse @ means[r[target]], float(-0.5 * means[r[target]] @ inverse @ means[r[target]] + np.log(r["n"] / total))) for r in rows]


def predict_lda(model: list[tuple[str, np.ndarray, float]], df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    scores = [F.struct(reduce(lambda s, x: s + x, [F.col(c) * float(v) for c, v in zip(features, w, strict=True)], F.lit(b)).alias("s"), F.lit(name).alias("class")) for name, w, b in model]
    return df.select(key, F.array_max(F.array(*scores))["class"].alias("pred"), F.lit(1.0).alias("confidence"))


# --- Spark ML ------------------------------------------------------------------------------------------

CLASSIFIERS: dict[str, Callable] = {
    "random_forest": lambda trees=20, depth=8, **kw: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, **kw),  # I2
    "gradient_boosting": lambda trees=5, depth=3, rate=0.1: OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=7, featuresCol="_features"), featuresCol="_features", labelCol="_label"),  # I4
    "bagging": lambda trees=10, depth=8: RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=7),  # I6
    "logistic_regression": lambda reg=0.0: LogisticRegression(maxIter=20, regParam=reg),  # I7
    "linear_svc": lambda reg=0.01: OneVsRest(classifier=LinearSVC(maxIter=10, regParam=reg, featuresCol="_features"), featuresCol="_features", labelCol="_label"),  # I8
    "multinomial_nb": lambda alpha=1.0: NaiveBayes(modelType="multinomial", smoothing=alpha),  # I10
    "bernoulli_nb": lambda alpha=1.0: NaiveBayes(modelType="bernoulli", smoothing=alpha),  # I10
    "sgd": lambda alpha=1e-3: LogisticRegression(maxIter=5, regParam=alpha),  # I13
    "passive_aggressive": lambda alpha=1e-2: OneVsRest(classifier=LinearSVC(maxIter=5, regParam=alpha, featuresCol="_features"), featuresCol="_features", labelCol="_label"),  # I13: hinge loss
    "decision_tree": lambda depth=5: DecisionTreeClassifier(maxDepth=depth, seed=7),
}
REGRESSORS: dict[str, Callable] = {
    "random_forest": lambda trees=20, depth=8, **kw: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=7, **kw),  # I2
    "gradient_boosting": lambda trees=10, depth=3, rate=0.1: GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, seed=7),  # I4
    "decision_tree": lambda depth=5: DecisionTreeRegressor(maxDepth=depth, seed=7),  # I5
    "bagging": lambda trees=10, depth=8: RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=7),  # I6
    "sgd": lambda alpha=1e-3: LinearRegression(loss="huber", maxIter=20, regParam=alpha),  # I13
    "passive_aggressive": lambda alpha=1e-2: LinearRegression(loss="huber", epsilon=1.1, maxIter=10, regParam=alpha),  # I13
    "ridge": lambda alpha=1.0: LinearRegression(elasticNetParam=0.0, regParam=alpha),  # I14
    "lasso": lambda alpha=0.1: LinearRegression(elasticNetParam=1.0, regParam=alpha),  # I15
}


def fit_classifier(name: str, train: DataFrame, features: Sequence[str], target: str, **params):
    return classify(train, features, target, CLASSIFIERS[name](**params))


def fit_regressor(name: str, train: DataFrame, features: Sequence[str], target: str, **params):
    return regress(train, features, target, REGRESSORS[name](**params))


def fit_mlp(train: DataFrame, features: Sequence[str], target: str, classes: int, hidden: int = 8):
    """I16. The indexer keeps one more class for unseen labels."""
    return classify(train, features, target, MultilayerPerceptronClassifier(layers=[len(features), hidden, classes + 1], maxIter=20, seed=7))


def lasso_path(train: DataFrame, features: Sequence[str], target: str, regs: Sequence[float] = (10.0, 1.0, 0.1)) -> DataFrame:
    """I15. (reg, feature, weight) along a path of penalties."""
    rows = []
    for reg in regs:
        model = fit_regressor("lasso", train, features, target, alpha=reg)
        rows += [(float(reg), c, float(w)) for c, w in zip(features, model.stages[-1].coefficients, strict=True)]
    return train.sparkSession.createDataFrame(rows, "reg double, feature string, weight double")


def extra_trees(train: DataFrame, df: DataFrame, features: Sequence[str], target: str, key: str, trees: int = 5, cuts: int = 8) -> DataFrame:
    """I3. Each tree sees the features cut at its own random points, drawn from the seeded range; the trees
    vote (ties by label)."""
    ends = train.agg(*[F.min(c).alias(f"l|{c}") for c in features], *[F.max(c).alias(f"h|{c}") for c in features]).first()
    votes = []
    for t in range(trees):
        rng = np.random.default_rng(t)
        points = {c: sorted(rng.uniform(ends[f"l|{c}"], ends[f"h|{c}"], cuts).tolist()) for c in features}
        cut = lambda d, points=points: d.withColumns({f"_c_{c}": reduce(lambda s, x: s + x, [(F.col(c) > p).cast("double") for p in points[c]]) for c in features})
        model = fit_classifier("decision_tree", cut(train), [f"_c_{c}" for c in features], target)
        votes.append(predict(model, cut(df), key).select(key, "pred", F.lit(1.0).alias("confidence")))
    return vote(reduce(DataFrame.unionByName, votes), key)


def fourier(df: DataFrame, features: Sequence[str], size: int = 16, gamma: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Random Fourier features of standardised columns, for I9."""
    rng = np.random.default_rng(7)
    stats = df.agg(*[F.avg(c).alias(f"m|{c}") for c in features], *[F.stddev_pop(c).alias(f"s|{c}") for c in features]).first()
    scaled = [(F.col(c) - stats[f"m|{c}"]) / (stats[f"s|{c}"] or 1.0) for c in features]
    out = {}
    for i in range(size):
        w, b = rng.normal(0, (2 * gamma) ** 0.5, len(features)), rng.uniform(0, 2 * np.pi)
        out[f"_rff{i}"] = F.cos(reduce(lambda s, x: s + x, [x * float(v) for x, v in zip(scaled, w, strict=True)], F.lit(float(b)))) * float((2 / size) ** 0.5)
    return df.withColumns(out), list(out)


def kernel_svm(train: DataFrame, df: DataFrame, features: Sequence[str], target: str, key: str, c: float = 1.0, classification: bool = True) -> DataFrame:
    """I9. Kernel SVC or SVR, approximated: random Fourier features and a linear model."""
    both, names = fourier(train.withColumn("_train", F.lit(True)).unionByName(df.withColumn("_train", F.lit(False)), allowMissingColumns=True), features)
    fitted = fit_classifier("linear_svc", both.where("_train"), names, target, reg=1 / (100 * c)) if classification else fit_regressor("sgd", both.where("_train"), names, target, alpha=1 / (100 * c))
    return predict(fitted, both.where("not _train"), key)


def multilabel(train: DataFrame, df: DataFrame, features: Sequence[str], labels: Sequence[str], key: str) -> DataFrame:
    """I17. One binary model for each label; (key, pred) with the labels that hold as an array."""
    out = df.select(key)
    for x in labels:
        model = fit_classifier("logistic_regression", train.withColumn(x, F.col(x).cast("string")), features, x)
        out = out.join(predict(model, df, key).select(key, F.col("pred").alias(x)), key)
    return out.select(key, F.array_compact(F.array(*[F.when(F.col(x) == "1", F.lit(x)) for x in labels])).alias("pred"))


def best_forest(train: DataFrame, valid: DataFrame, features: Sequence[str], target: str, key: str, grid: Sequence[dict] = ({"trees": 5, "depth": 3}, {"trees": 10, "depth": 6})):
    """I18. The forest of a small grid with the best macro F1 on the validation rows."""
    found = []
    for i, params in enumerate(grid):
        model = fit_classifier("random_forest", train, features, target, **params)
        p = predict(model, valid, key).join(valid.select(key, F.col(target).alias("truth")), key)
        found.append((metrics.f1_macro(p.withColumn("c", F.lit(0)), ["c"]).first()["value"], -i, model, params))
    return max(found, key=lambda f: f[:2])[2:]


def self_training(labelled: DataFrame, unlabelled: DataFrame, features: Sequence[str], target: str, key: str, rounds: int = 2, share: float = 0.3, learner: str = "logistic_regression"):
    """I19. Fit, label the unlabelled rows, keep the surest ``share`` as training rows, again."""
    train = labelled.select(key, *features, target)
    rest = unlabelled.select(key, *features)
    for _ in range(rounds):
        model = fit_classifier(learner, train, features, target)
        told = scratch(predict(model, rest, key), "self-training")
        cut = quantiles(told, {"cut": F.col("confidence")}, [1 - share])["cut"][0]
        if cut is None:
            break
        sure = scratch(told.where(F.col("confidence") >= cut).select(key, F.col("pred").alias(target)), "self-training")
        train = scratch(train.unionByName(rest.join(sure, key).select(key, *features, target)), "self-training")
        rest = scratch(rest.join(sure, key, "left_anti"), "self-training")
    return fit_classifier(learner, train, features, target)


def privileged_forest(train: DataFrame, df: DataFrame, features: Sequence[str], privileged: Sequence[str], target: str, key: str) -> DataFrame:
    """I20. Privileged columns, known in training only, are regressed from the others and their predictions
    become features of a forest."""
    for c in privileged:
        model = fit_regressor("ridge", train, features, c, alpha=0.01)
        train = model.transform(train).withColumnRenamed("prediction", f"_p_{c}").drop("_features")
        df = model.transform(df).withColumnRenamed("prediction", f"_p_{c}").drop("_features")
    names = [*features, *[f"_p_{c}" for c in privileged]]
    return predict(fit_classifier("random_forest", train, names, target), df, key)


def vote(preds: DataFrame, key: str) -> DataFrame:
    """I21. The label with the largest summed confidence (null counts as 1), ties by label."""
    sums = preds.groupBy(key, "pred").agg(F.sum(F.coalesce("confidence", F.lit(1.0))).alias("s"))
    best = sums.groupBy(key).agg(F.min_by(F.struct("pred", "s"), F.struct(-F.round("s", 9), "pred")).alias("b"))
    return best.select(key, F.col("b.pred").alias("pred"), F.col("b.s").alias("confidence"))


def stack(bases: Sequence[DataFrame], df: DataFrame, target: str, key: str) -> DataFrame:
    """I22. Base predictions as 0/1 columns, then Bernoulli naive Bayes on them."""
    from brindle.operators.encode import one_hot

    joined = df.select(key, target)
    for i, b in enumerate(bases):
        joined = joined.join(b.select(key, F.col("pred").alias(f"base{i}")), key)
    coded = one_hot(joined, [f"base{i}" for i in range(len(bases))])
    names = [c for c in coded.columns if c not in (key, target)]
    return predict(fit_classifier("bernoulli_nb", coded, names, target), coded, key)


def stack_folds(df: DataFrame, features: Sequence[str], target: str, key: str, learners: Sequence[str] = ("logistic_regression", "multinomial_nb"), meta: str = "logistic_regression", folds: int = 3) -> DataFrame:
    """I22. Stacking without a look at a row's own label: each learner predicts a fold from the others (dealt within each
    class), the predictions join the features as 0/1 columns, and the model on top predicts each fold from the others too.
    Returns (key, pred, confidence) for every row; keys are unique."""
    from brindle.operators.encode import one_hot
    from brindle.operators.split import split_stratified

    def model_of(learner: str, rows: DataFrame, i: int, names: Sequence[str]):
        return fit_classifier(learner, rows.where(F.col("fold") != i), names, target)

    dealt = scratch(split_stratified(df.select(key, *features, target), key, target, folds), "stack-folds")
    release(df.sparkSession)  # what dealing the folds has shuffled
    bases, parts = [f"_base{i}" for i in range(len(learners))], []
    for i in range(folds):
        part = dealt.where(F.col("fold") == i)
        for base, learner in zip(bases, learners, strict=True):  # a prediction stays with its row, which no join has to find
            part = predict(model_of(learner, dealt, i, features), part, key, [c for c in part.columns if c != key]).withColumnRenamed("pred", base).drop("confidence")
        parts.append(part)
    coded = scratch(one_hot(reduce(DataFrame.unionByName, parts), bases), "stack-coded")
    discard(dealt)
    names = [c for c in coded.columns if c not in (key, target, "fold")]
    return reduce(DataFrame.unionByName, [predict(model_of(meta, coded, i, names), coded.where(F.col("fold") == i), key) for i in range(folds)])


def collaborative(ratings: DataFrame, user: str, item: str, value: str, rank: int = 5):
    """I23."""
    return ALS(rank=rank, maxIter=5, regParam=0.1, userCol=user, itemCol=item, ratingCol=value, coldStartStrategy="drop", seed=7).fit(ratings)


def cluster(df: DataFrame, vector: str, k: int) -> DataFrame:
    """I24. Cluster numbers by k-means."""
    ready = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=7, featuresCol="_features", predictionCol="cluster").fit(ready).transform(ready).drop("_features")


def cluster_best(df: DataFrame, vector: str, ks: Sequence[int] = range(2, 13)) -> tuple[int, DataFrame]:
    """I24. The number of clusters with the best silhouette (ties to the fewest), and its clusters."""
    ready = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    judge = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster")
    best = None
    for k in ks:
        found = KMeans(k=k, seed=7, featuresCol="_features", predictionCol="cluster").fit(ready).transform(ready)
        value = judge.evaluate(found)
        if best is None or value > best[0]:
            best = (value, k, found)
    return best[1], best[2].drop("_features")


def gaussian_clusters(df: DataFrame, vector: str, ks: Sequence[int] = (2, 3, 4)) -> tuple[int, DataFrame]:
    """I25. The number of components with the best BIC, and its clusters."""
    ready = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    n, d = ready.count(), ready.select(F.max(F.size(vector))).first()[0]
    best = None
    for k in ks:
        model = GaussianMixture(k=k, seed=7, maxIter=10, featuresCol="_features", predictionCol="cluster", probabilityCol="_p").fit(ready)
        bic = (k * (1 + d + d * (d + 1) / 2) - 1) * np.log(n) - 2 * model.summary.logLikelihood
        if best is None or bic < best[0]:
            best = (bic, k, model)
    return best[1], best[2].transform(ready).drop("_features", "_p")


def fit_ar1(series: DataFrame, group: str, ts: str, value: str) -> DataFrame:
    """I26. (group, slope, intercept, last, forecast): a regression of order 1 for each series."""
    w = Window.partitionBy(group).orderBy(ts)
    lagged = series.withColumn("_x", F.lag(value).over(w))
    fit = lagged.groupBy(group).agg(F.regr_slope(value, "_x").alias("slope"), F.regr_intercept(value, "_x").alias("intercept"), F.max_by(value, ts).alias("last"))
    return fit.withColumn("forecast", F.col("slope") * F.col("last") + F.col("intercept"))


def _solve_ar(group: str, orders: Sequence[int], take_log: bool):
    """Solve each series' normal equations, given as sums of products of [1, lags, value]."""
    top = max(orders)

    def run(batches):
        for rows in batches:
            out = []
            for n, sums, last in zip(rows["n"], rows["sums"], rows["last"], strict=True):
                full = np.zeros((top + 2, top + 2))
                full[np.triu_indices(top + 2)] = sums
                full += np.triu(full, 1).T
                best = (np.inf, None, None)
                for p in orders:
                    if n <= p:
                        continue
                    a, b = full[: p + 1, : p + 1], full[: p + 1, -1]
                    w = np.linalg.lstsq(a, b, rcond=None)[0]
                    rss = max(float(full[-1, -1] - 2 * w @ b + w @ a @ w), 1e-12)
                    aic = n * np.log(rss / n) + 2 * (p + 1)
                    if aic < best[0]:
                        best = (aic, p, w)
                if best[1] is None:
                    out.append((None, None, None))
                    continue
                y = float(best[2][0] + best[2][1:] @ np.asarray(last, float)[: best[1]])
                out.append((best[1], best[2].tolist(), float(np.exp(y)) if take_log else y))
            yield pd.DataFrame({group: rows[group], "order": pd.array([o[0] for o in out], "Int32"), "weights": [o[1] for o in out], "forecast": [o[2] for o in out]})

    return run


def fit_ar(series: DataFrame, group: str, ts: str, value: str, orders: Sequence[int] = (1,), take_log: bool = False) -> DataFrame:
    """I26. (group, order, weights, forecast) with the order of least AIC for each series; weights begin with the
    intercept. Spark sums products of lags, a task solves a few numbers for each series. ``take_log``: on logarithms
    of values, which must be positive. All orders see the same rows; a series too short for all of them gives nulls."""
    top = max(orders)
    w = Window.partitionBy(group).orderBy(ts)
    y = F.log(value) if take_log else F.col(value).cast("double")
    lagged = series.withColumn("_y", y).withColumns({f"_x{i}": F.lag("_y", i).over(w) for i in range(1, top + 1)})
    terms = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(1, top + 1)], F.col("_y")]
    whole = F.col(f"_x{top}").isNotNull() & F.col("_y").isNotNull()
    sums = [F.coalesce(F.sum(F.when(whole, terms[i] * terms[j])), F.lit(0.0)) for i in range(top + 2) for j in range(i, top + 2)]
    last = F.max_by(F.array("_y", *[f"_x{i}" for i in range(1, top)]), ts)
    found = lagged.groupBy(group).agg(F.count_if(whole).alias("n"), F.array(*sums).alias("sums"), last.alias("last"))
    kind = series.schema[group].dataType.simpleString()
    return found.mapInPandas(_solve_ar(group, sorted(orders), take_log), f"`{group}` {kind}, order int, weights array<double>, forecast double")


# --- graphs --------------------------------------------------------------------------------------------


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each one reaches. Labels go along edges and then jump to
    their own label; each round is written to shared scratch space."""
    both = scratch(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct(), "graph-edges")
    labels = scratch(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "graph-labels")
    for _ in range(rounds):
        told = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        lower = labels.join(told, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        lower = scratch(lower.join(jump, "component", "left").select("node", "old", F.least("component", "far").alias("component")), "graph-labels")
        labels = lower.select("node", "component")
        if lower.where(F.col("old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def largest_component(edges: DataFrame) -> DataFrame:
    """I28. The nodes of the largest component (ties to the smallest label)."""
    labels = connected(edges)
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(top.select("component")), "component", "left_semi").select("node", "component")


def spectral_embedding(edges: DataFrame, d: int = 2, rounds: int = 3, laplacian: bool = False) -> DataFrame:
    """I29. (node, vec): orthogonal iteration. A round multiplies by the (normalised) adjacency as a join and
    a sum; only the d x d Gram matrix comes to the driver."""
    both = scratch(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct(), "graph-edges")
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    x = degree.select("node", "deg", *[(u(F.concat_ws("-", "node", F.lit(j))) - 0.5).alias(f"x{j}") for j in range(d)])
    names = [f"x{j}" for j in range(d)]
    former = None
    for _ in range(rounds):
        x = scratch(x, "graph-vectors")
        if former is not None:
            discard(former)
        part = lambda c: F.col(c) / F.sqrt("deg") if laplacian else F.col(c)
        y = both.join(x.select(F.col("node").alias("dst"), *[part(c).alias(c) for c in names]), "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(c).alias(c) for c in names])
        former = scratch(y.join(degree, "node").select("node", "deg", *[part(c).alias(c) for c in names]), "graph-vectors")
        discard(x)
        release(edges.sparkSession)  # a round's shuffles go before the next one's come
        g = former.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in names for b in names]).first()
        gram = np.array([[g[f"{a}{b}"] for b in names] for a in names])
        inverse = np.linalg.inv(np.linalg.cholesky(gram + 1e-12 * np.eye(d))).T
        x = former.select("node", "deg", *[reduce(lambda s, v: s + v, [F.col(names[i]) * float(inverse[i, j]) for i in range(d)]).alias(names[j]) for j in range(d)])
    return x.select("node", F.array(*names).alias("vec"))


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """I30. Label propagation until no label changes, in ``rounds`` rounds at most: a node takes its neighbours' most
    frequent label, its own counting once, ties to the smallest. Half of the nodes may change in a round, so that
    two sides of a graph don't just swap their labels."""
    both = scratch(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct(), "graph-edges")
    labels = scratch(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")), "graph-labels")
    idle = 0
    for turn in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "label").union(labels)
        votes = votes.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"))
        may = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        told = scratch(labels.join(votes, "node").select("node", F.col("label").alias("old"), F.when(may, F.col("best")).otherwise(F.col("label")).alias("label")), "graph-labels")
        idle = idle + 1 if told.where(F.col("old") != F.col("label")).isEmpty() else 0
        labels = told.select("node", "label")
        if idle == 2:
            break
    return labels


#: Neighbours of a node that one task pairs with the queries among them.
HUB = 2_000


def link_scores(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """I31. (a, b, common, adamic_adar) for each ``queries(node)`` a and every other node b with which it has a common
    neighbour of degree 2 or more. A hub's neighbours are dealt over blocks of HUB, so that no task pairs all of them."""
    both = scratch(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct(), "graph-edges")
    degree = both.groupBy("src").agg(F.count("*").alias("deg")).where("deg >= 2").withColumn("blocks", F.ceil(F.col("deg") / HUB).cast("int"))
    weighed = both.join(degree, "src").select(F.col("src").alias("via"), F.col("dst").alias("n"), "deg", "blocks")
    asked = weighed.join(queries.select(F.col("node").alias("n")).distinct(), "n").select("via", F.col("n").alias("a"), "deg", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    others = weighed.select("via", F.col("n").alias("b"), F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int").alias("block"))
    pairs = asked.join(others, ["via", "block"]).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(1 / F.log(F.col("deg"))).alias("adamic_adar"))


def vertex_features(edges: DataFrame, labels: DataFrame, classes: Sequence[str]) -> DataFrame:
    """I32. (node, share of each class among labelled neighbours, vec)."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()
    told = both.join(labels.select(F.col("node").alias("dst"), "class"), "dst", "left")
    shares = told.groupBy(F.col("src").alias("node")).agg(*[_share(F.col("class") == c).alias(f"share_{c}") for c in classes])
    return shares.join(spectral_embedding(edges), "node")


def _share(cond: Column) -> Column:
    return F.coalesce(F.avg(cond.cast("double")), F.lit(0.0))


def match_graphs(left: DataFrame, right: DataFrame, seeds: DataFrame, rounds: int = 10, least: int = 2) -> DataFrame:
    """I33. Seeded matching by percolation: pairs are scored by their matched neighbour pairs, and mutual best
    ones join the matching, round by round, until there are no more (in ``rounds`` rounds at most)."""
    a = left.select("src", "dst").union(left.select(F.col("dst"), F.col("src"))).distinct()
    b = right.select("src", "dst").union(right.select(F.col("dst"), F.col("src"))).distinct()
    matched = seeds.select("a", "b")
    for _ in range(rounds):
        near = matched.join(a.select(F.col("src").alias("a"), F.col("dst").alias("x")), "a").join(b.select(F.col("src").alias("b"), F.col("dst").alias("y")), "b")
        marks = near.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        marks = marks.join(matched.select(F.col("a").alias("x")), "x", "left_anti").join(matched.select(F.col("b").alias("y")), "y", "left_anti")
        by = lambda c, o: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("n"), o))
        best = marks.withColumns({"_x": by("x", "y"), "_y": by("y", "x")}).where("_x = 1 and _y = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))
        best = scratch(best, "graph-match")
        if best.isEmpty():
            break
        matched = scratch(matched.union(best), "graph-match")
    return matched
