"""Runnable pipelines from templates, and one-call jobs on them."""

from __future__ import annotations

import ast
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import OneVsRest
from pyspark.ml.feature import PCA, Imputer, IndexToString, MaxAbsScaler, MinMaxScaler, RobustScaler, SQLTransformer, StandardScaler, StringIndexer, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import metrics
from brindle.operators import models, split
from brindle.operators.split import weighted_choice
from brindle.plans import search, stages
from brindle.session import scratch

#: What a step may be: from its input's and its own column to a transformer or estimator of vectors. ``percentile`` is Spark's
#: selector, which passes over a feature that a numeric target follows without any rest.
KINDS: dict[str, Callable] = {
    "nothing": lambda i, o: SQLTransformer(statement=f"SELECT *, {i} AS {o} FROM __THIS__"),
    "standard_scale": lambda i, o: StandardScaler(inputCol=i, outputCol=o, withMean=True),
    "min_max_scale": lambda i, o: MinMaxScaler(inputCol=i, outputCol=o),
    "max_abs_scale": lambda i, o: MaxAbsScaler(inputCol=i, outputCol=o),
    "robust_scale": lambda i, o: RobustScaler(inputCol=i, outputCol=o, withCentering=True),
    "variance": lambda i, o, threshold=0.0: VarianceThresholdSelector(featuresCol=i, outputCol=o, varianceThreshold=threshold),
    "percentile": lambda i, o, keep=0.5: UnivariateFeatureSelector(featuresCol=i, outputCol=o, labelCol="_label", selectionMode="percentile").setFeatureType("continuous").setSelectionThreshold(keep),
    "pca": lambda i, o, k=2: PCA(k=k, inputCol=i, outputCol=o),
    "jmi": lambda i, o, k=3, nbins=5: stages.SelectJMI(column=i, out=o, target="_label", k=k, nbins=nbins),
}
SCALES = ("nothing", "standard_scale", "max_abs_scale", "robust_scale")
#: The steps of a template before its model: (name, choices, the step it reads). ``table`` is the imputed table.
CHAINS: dict[str, tuple] = {
    "classification": (("scale", SCALES, "table"), ("select", ("nothing", "percentile", "variance"), "scale")),
    "multiclass_jmi": (("scale", SCALES, "table"), ("select", ("jmi",), "scale")),
    "naive_bayes": (("scale", SCALES, "table"),),
    "text": (("scale", ("min_max_scale",), "table"),),  # multinomial models take nothing below 0
    "event_table": (("scale", SCALES, "table"), ("select", ("nothing", "variance"), "scale")),
    "multi_table": (("scale", SCALES, "table"), ("select", ("nothing", "variance"), "scale")),
    "series": (("scale", SCALES, "table"),),
    "regression": (("scale", SCALES, "table"), ("select", ("nothing", "percentile", "variance"), "scale")),
    "wide_numeric": (("select", ("variance", "percentile"), "table"), ("reduce", ("pca", "nothing"), "select")),
}
#: Values of a model's parameters to choose from; ranges between the ends are drawn (see ``search.distribution``).
GRIDS: dict[str, dict[str, Sequence]] = {
    "random_forest": {"trees": [10, 50], "depth": [4, 8]},
    "gradient_boosting": {"trees": [5, 20], "depth": [2, 4]},
    "bagging": {"trees": [5, 20], "depth": [4, 8]},
    "decision_tree": {"depth": [3, 8]},
    "logistic_regression": {"reg": [0.001, 0.01, 0.1]},
    "linear_svc": {"reg": [0.001, 0.01, 0.1]},
    "ridge": {"alpha": [0.01, 0.1, 1.0]},
    "kmeans": {"k": [2, 8]},
}


@dataclass(frozen=True)
class Problem:
    """What is asked of a table. ``roles`` names columns that only some models need: ``privileged`` and ``labels``
    (lists), ``vector``, ``user``, ``item``, ``group``, ``ts``; and what of a raw table becomes features besides the numbers
    in ``features``: ``categories``, ``texts``, ``dates`` (lists), ``series`` (column, length), ``related`` (table, its key,
    its numbers) whose rows belong to the value of ``related_by``."""

    key: str
    features: Sequence[str]
    target: str
    classification: bool = True
    roles: dict = field(default_factory=dict)

    @property
    def raw(self) -> bool:
        return any(self.roles.get(k) for k in ("categories", "texts", "dates", "series", "related"))

    @property
    def metrics(self) -> list[str]:
        return ["accuracy", "f1Macro"] if self.classification else ["rootMeanSquaredError", "rSquared"]


#: Values of a category that get a column, and random projections of a series.
VALUES, PROJECTIONS = 12, 4
#: Closed forms that end a pipeline as a stage of it.
CLOSED: dict[str, Callable] = {
    "gaussian_nb": lambda p, column: stages.GaussianNB(column=column, target=p.target),
    "dummy": lambda p, column: stages.Majority(target=p.target, classification=p.classification),
}


def table_stages(problem: Problem) -> list:
    """From a raw table to the vector ``_table``: related rows aggregated, dates taken apart, series projected, texts scored
    by class, gaps filled, categories encoded. Each stage is saved and reloaded with the pipeline."""
    roles, made, prefixes = problem.roles, [], []
    numbers, categories = list(problem.features), list(roles.get("categories", ()))
    if roles.get("related"):
        table, key, of = roles["related"]
        made.append(stages.AggregateRelated(table, key=roles["related_by"], related_key=key, numbers=list(of)))
        numbers += ["rel_count", *(f"rel_{c}_{n}" for c in of for n in ("sum", "avg", "min", "max", "std"))]
    if roles.get("dates"):
        made.append(stages.DateParts(columns=list(roles["dates"])))
        numbers += [f"{c}_{n}" for c in roles["dates"] for n in ("year", "quarter", "month", "day", "weekday", "dayofyear")]
    if roles.get("series"):
        column, size = roles["series"]
        made.append(stages.ProjectSeries(column=column, size=size, k=PROJECTIONS))
        numbers += [f"rp{i}" for i in range(PROJECTIONS)]
    for c in roles.get("texts", ()):
        made.append(stages.TargetText(column=c, target=problem.target))
        prefixes.append(f"_text_{c}_")
    made.append(stages.Impute(numbers=numbers, categories=categories, strategy="mean"))
    if categories:
        made.append(stages.Encode(columns=categories, n_limit=VALUES))
        prefixes += [f"_enc_{c}_" for c in categories]
    return [*made, stages.ToVector(columns=numbers, prefixes=prefixes, out="_table")]


def chain(problem: Problem, steps: Sequence[tuple] = ()) -> tuple[list, str]:
    """The stages before the model and the column of the last one. Missing numbers become means; a step is (name,
    kind, the step it reads, parameters)."""
    filled = [f"_filled_{c}" for c in problem.features]
    made: list = [Imputer(inputCols=list(problem.features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_table", handleInvalid="keep")]
    if problem.raw:
        made = table_stages(problem)
    known = {"table"}
    last = "table"
    for name, kind, reads, *params in steps:
        if reads not in known:
            raise ValueError(f"step {name} reads {reads}, which no earlier step is called")
        if name in known:
            raise ValueError(f"two steps are called {name}")
        step = KINDS[kind](f"_{reads}", f"_{name}", **(params[0] if params else {}))
        if kind == "percentile":
            step = step.setLabelType("categorical" if problem.classification else "continuous").setLabelCol("_label")
        made.append(step)
        known.add(name)
        last = name
    return made, f"_{last}"


def learned(problem: Problem, train: DataFrame, model: str, steps: Sequence[tuple], params: dict):
    """A fitted ML pipeline: label, chain, model, label back. Rows without a target teach nothing."""
    train = train.where(F.col(problem.target).isNotNull())
    before, last = chain(problem, steps)
    if model in CLOSED:
        return Pipeline(stages=[*before, CLOSED[model](problem, last)]).fit(train)
    handed = SQLTransformer(statement=f"SELECT *, {last} AS _features FROM __THIS__")
    if problem.classification:
        labels = StringIndexer(inputCol=problem.target, outputCol="_label", handleInvalid="keep").fit(train)
        learner = models.CLASSIFIERS[model](**params)
        learner = learner if isinstance(learner, OneVsRest) else learner.setFeaturesCol("_features").setLabelCol("_label")
        back = IndexToString(inputCol="prediction", outputCol="pred", labels=labels.labels)
        return Pipeline(stages=[labels, *before, handed, learner, back]).fit(train)
    train = train.withColumn("_label", F.col(problem.target).cast("double"))
    learner = models.REGRESSORS[model](**params).setFeaturesCol("_features").setLabelCol("_label")
    return Pipeline(stages=[*before, handed, learner]).fit(train)


def _dummy(p: Problem, train: DataFrame, params: dict) -> Callable:
    model = models.fit_dummy(train.where(F.col(p.target).isNotNull()), p.target, p.classification)
    return lambda df: models.predict_dummy(model, df, p.key)


def _gaussian(p: Problem, train: DataFrame, params: dict) -> Callable:
    model = models.fit_gaussian_nb(train, p.features, p.target)
    return lambda df: models.predict_gaussian_nb(model, df, p.features, p.key)


def _self_trained(p: Problem, train: DataFrame, params: dict) -> Callable:
    known = F.col(p.target).isNotNull()
    model = models.self_training(train.where(known), train.where(~known), p.features, p.target, p.key, **params)
    return lambda df: models.predict(model, df, p.key)


def _ar(p: Problem, train: DataFrame, params: dict) -> Callable:
    told = models.fit_ar(train, p.roles["group"], p.roles["ts"], p.target, **params).select(p.roles["group"], F.col("forecast").alias("pred"))
    return lambda df: df.select(p.key, p.roles["group"]).join(told, p.roles["group"], "left").select(p.key, "pred", F.lit(1.0).alias("confidence"))


def _als(p: Problem, train: DataFrame, params: dict) -> Callable:
    model = models.collaborative(train, p.roles["user"], p.roles["item"], p.target, **params)
    return lambda df: model.transform(df).select(p.key, F.col("prediction").alias("pred"), F.lit(1.0).alias("confidence"))


#: Models that are no stage of an ML pipeline: from (problem, training rows, parameters) to a function that predicts.
OTHERS: dict[str, Callable] = {
    "dummy": _dummy,
    "gaussian_nb": _gaussian,
    "self_training": _self_trained,
    "ar1": _ar,
    "als": _als,
    "knn": lambda p, train, params: lambda df: models.knn_predict(train, df, p.key, p.roles["vector"], p.target, classification=p.classification, **params),
    "privileged_forest": lambda p, train, params: lambda df: models.privileged_forest(train, df, p.features, p.roles["privileged"], p.target, p.key),
    "multilabel": lambda p, train, params: lambda df: models.multilabel(train, df, p.features, p.roles["labels"], p.key).withColumn("confidence", F.lit(1.0)),
    "kmeans": lambda p, train, params: lambda df: models.cluster(df, p.roles["vector"], **params).select(p.key, F.col("cluster").alias("pred"), F.lit(1.0).alias("confidence")),
    "largest_component": lambda p, train, params: lambda df: models.largest_component(df),
    "communities": lambda p, train, params: lambda df: models.communities(df),
    "link_scores": lambda p, train, params: lambda df: models.link_scores(df, **params),
}


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline: ``produce(df)`` gives (key, pred, confidence). ``model`` is its ML pipeline, if it has one."""

    problem: Problem
    point: dict
    produce: Callable[[DataFrame], DataFrame]
    model: object = None


def fit(problem: Problem, point: dict, df: DataFrame) -> Fitted:
    """J2, J19. Fit a point: ``model``, ``steps`` and, under any other name, the model's parameters."""
    params = {k: v for k, v in point.items() if k not in ("candidate_id", "template", "model", "steps")}
    name = point["model"]
    if problem.raw and name in OTHERS and name not in CLOSED:
        return _over_raw(problem, point, df, OTHERS[name], params)
    if name in OTHERS and not (problem.raw or point.get("steps")):
        return Fitted(problem, point, OTHERS[name](problem, df, params))
    model = learned(problem, df, name, point.get("steps", ()), params)
    return Fitted(problem, point, lambda new: models.predict(model, new, problem.key), model)


def _over_raw(problem: Problem, point: dict, df: DataFrame, learner: Callable, params: dict) -> Fitted:
    """A model that is no stage, behind the stages that make numbers of a raw table: as columns, and as the array ``_row``."""
    known = df if point["model"] == "self_training" else df.where(F.col(problem.target).isNotNull())
    before = Pipeline(stages=table_stages(problem)).fit(known)
    columns = before.stages[-1].known
    inner = Problem(problem.key, columns, problem.target, problem.classification, problem.roles | {"vector": "_row"})
    ready = lambda rows: before.transform(rows).withColumn("_row", F.array(*[F.col(c).cast("double") for c in columns]))
    predict = learner(inner, ready(df), params)
    return Fitted(problem, point, lambda new: predict(ready(new)))


def save(fitted: Fitted, path: str) -> str:
    """A9, J20. Store a fitted pipeline with all that its stages learned: what cleans new rows as well as the model."""
    if fitted.model is None:
        raise ValueError(f"{fitted.point['model']} is no stage of a pipeline and can't be stored")
    fitted.model.write().overwrite().save(path)
    return path


def load(problem: Problem, path: str) -> Fitted:
    """J20. A stored pipeline, to predict rows that were never seen; of the problem only the key and the target count."""
    model = PipelineModel.load(path)
    return Fitted(problem, {"model": "stored"}, lambda new: models.predict(model, new, problem.key), model)


def produce(fitted: Fitted, df: DataFrame) -> DataFrame:
    """J19. (key, pred, confidence) for new rows."""
    return fitted.produce(df)


def score_predictions(problem: Problem, preds: DataFrame, truth: DataFrame, candidate: str = "a", fold: str = "test") -> DataFrame:
    """J19. The problem's metrics of predictions against the rows that know the target."""
    known = truth.where(F.col(problem.target).isNotNull()).select(problem.key, F.col(problem.target).alias("truth"))
    return _score_told(problem, preds.join(known, problem.key), candidate, fold)


def _score_told(problem: Problem, rows: DataFrame, candidate: str, fold: str) -> DataFrame:
    """The metrics of rows with truth and pred. Those of a classification follow from the confusion table, which is written, so that the
    rows are predicted once."""
    rows = rows.withColumns({"candidate_id": F.lit(candidate), "fold": F.lit(fold), "target": F.lit(problem.target)})
    if problem.classification:
        return metrics.score_confusion(scratch(metrics.confusion(rows), "confusion"))
    return metrics.score(rows.withColumnRenamed(problem.key, "row_id"), problem.metrics)


def score(fitted: Fitted, df: DataFrame, fold: str = "test") -> DataFrame:
    """J19. Produce, then score. A pipeline and a closed form predict a row where it lies, so the truth goes along; predictions of other models
    meet it by the key."""
    problem, name = fitted.problem, fitted.point.get("candidate_id", "a")
    known = df.where(F.col(problem.target).isNotNull())
    if fitted.model is not None:
        told = models.predict(fitted.model, known.withColumn("_truth", F.col(problem.target)), problem.key, ["_truth"])
        return _score_told(problem, told.withColumnRenamed("_truth", "truth"), name, fold)
    if fitted.point["model"] in CLOSED:
        told = produce(fitted, known.withColumn(problem.key, F.struct(problem.key, F.col(problem.target).alias("truth"))))
        return _score_told(problem, told.select(F.col(problem.key)[problem.key].alias(problem.key), F.col(problem.key)["truth"].alias("truth"), "pred", "confidence"), name, fold)
    return score_predictions(fitted.problem, produce(fitted, df), df, fitted.point.get("candidate_id", "a"), fold)


def fit_produce(problem: Problem, point: dict, train: DataFrame, df: DataFrame) -> DataFrame:
    """J19."""
    return produce(fit(problem, point, train), df)


def fit_score(problem: Problem, point: dict, train: DataFrame, df: DataFrame) -> DataFrame:
    """J19."""
    return score(fit(problem, point, train), df)


def cross_validated(problem: Problem, point: dict, df: DataFrame, folds: int = 5) -> DataFrame:
    """J9, J10, J19. The metrics' means over folds, as fold ``cv``; the folds of a classification are dealt within each class."""
    dealt = split.split_stratified(df, problem.key, problem.target, folds) if problem.classification else split.split_kfold(df, problem.key, folds)
    dealt = scratch(dealt, "folds")
    told = [score(fit(problem, point, dealt.where(F.col("fold") != i).drop("fold")), dealt.where(F.col("fold") == i).drop("fold"), str(i)) for i in range(folds)]
    return reduce(DataFrame.unionByName, told).groupBy("candidate_id", "target", "metric", "larger").agg(F.avg("value").alias("value")).withColumn("fold", F.lit("cv"))


def evaluate(problem: Problem, point: dict, splits: DataFrame, mode: str = "full", folds: int = 0, quick: tuple[DataFrame, Fitted] | None = None) -> tuple[DataFrame, Fitted]:
    """J9, J19. (scores, fitted pipeline) over the splits of ``split.nested_splits``, best written before, as each fit reads them several times.

    A fit on train is scored on train and test2, one on train and test2 on test1, and the pipeline returned is fitted on all
    rows. Mode ``quick``: one fit on train and its score on test2, which a full evaluation of the same point takes as ``quick``. ``folds``: a
    cross-validated score on train besides.
    """
    part = lambda *names: splits.where(F.col("split").isin(*names)).drop("split")
    first = quick[1] if quick else fit(problem, point, part("train"))
    scores = [quick[0] if quick else score(first, part("test2"), "test2")]
    if folds:
        scores.append(cross_validated(problem, point, part("train"), folds))
    if mode == "quick":
        return reduce(DataFrame.unionByName, scores), first
    scores.append(score(first, part("train"), "train"))
    scores.append(score(fit(problem, point, part("train", "test2")), part("test1"), "test1"))
    return reduce(DataFrame.unionByName, scores), fit(problem, point, splits.drop("split"))


def _value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def space_of(template: str, model: str) -> dict[str, Sequence]:
    """The choices that a template leaves open for one of its models."""
    return {name: list(kinds) for name, kinds, _ in CHAINS.get(template, ())} | GRIDS.get(model, {})


def to_point(template: str, model: str, values: dict[str, str], candidate: str) -> dict:
    """J2. A runnable point from a template, a model and a drawn value for each open choice."""
    steps = [(name, values[name], reads) for name, _, reads in CHAINS.get(template, ())]
    grid = {k: _value(values[k]) for k in GRIDS.get(model, {})}
    return {"candidate_id": candidate, "template": template, "model": model, "steps": steps} | grid


def points_of(spark, template: str, names: Sequence[str], n: int, seed: str = "draw") -> list[dict]:
    """J4, J5. For each model of a template its default point, then ``n`` drawn ones."""
    out = []
    for model in names:
        space = space_of(template, model)
        out.append(to_point(template, model, search.default_point(space), f"{template}-{model}-0"))
        drawn: dict[int, dict] = {}
        for row in search.draw_points(spark, space, n, f"{seed}-{model}").collect() if space and n else ():
            drawn.setdefault(row["point"], {})[row["step"]] = row["value"]
        out += [to_point(template, model, values, f"{template}-{model}-{i + 1}") for i, values in sorted(drawn.items())]
    return out


_REPORTS = "id string, turn int, template_name string, model string, cv double, total_runtime double, sim_count long, error string"


def _next_arm(reports: DataFrame, arms: Sequence[str], seed: str) -> str:
    """J8. A template drawn by its bandit weight; one that never succeeded has the least metric."""
    weights = search.uct(search.normalize_history(search.update_history(reports)))
    weights = weights.where(F.col("template_name").isin(list(arms))).select(F.col("template_name").alias("name"), F.col("uct").alias("weight"))
    return weighted_choice(weights, "name", "weight", 1, seed).first()["name"]


def bandit_search(problem: Problem, df: DataFrame, arms: dict[str, Sequence[str]], draws: int = 50, seconds: float = math.inf, seed: str = "bandit") -> tuple[DataFrame, Fitted | None]:
    """J5, J8, J9, J11. A search that learns: (reports, the best pipeline, fitted on all rows; None if none ran).

    ``arms``: the models of each template. First every template's default point, heaviest first (J5); then, turn by
    turn, a template drawn by its bandit weight over the history so far and a point that wasn't evaluated yet. It ends after ``draws`` turns, or with the first turn
    that begins after ``seconds``. A point that fails becomes a report with its error and no metric, and costs its template its time.
    Reports: one row for each turn, ``cv`` the first metric on test2 (negative where less is better), ``rank`` from 1, null for failures.
    """
    spark, lead = df.sparkSession, problem.metrics[0]
    splits = scratch(split.nested_splits(df, problem.key), "search-splits")
    weight = {t[0]: t[5] for t in search.TEMPLATES}
    first, rows, points = sorted(arms, key=lambda a: (-weight.get(a, 1.0), a)), [], {}
    ends = time.monotonic() + seconds
    for turn in range(draws):
        began = time.monotonic()
        if began >= ends:
            break
        name = first[turn] if turn < len(first) else _next_arm(spark.createDataFrame(rows, _REPORTS), first, f"{seed}-{turn}")
        nth = sum(r[2] == name for r in rows)
        model = arms[name][nth % len(arms[name])]
        value = error = None
        point = {"candidate_id": f"{name}-{model}-{nth // len(arms[name])}"}
        try:
            point = points_of(spark, name, [model], nth // len(arms[name]), seed)[-1]
            found = evaluate(problem, point, splits, "quick")[0].where(F.col("metric") == lead).first()
            value = float(found["value"] if found["larger"] else -found["value"])
        except Exception as failure:  # a point may fail in any step, and the search goes on
            error = f"{type(failure).__name__}: {failure}"[:500]
        points[point["candidate_id"]] = point
        rows.append((f"{turn}-{point['candidate_id']}", turn, name, model, value, time.monotonic() - began, 1, error))
    reports = spark.createDataFrame(rows, _REPORTS)
    order = sorted((r for r in rows if r[4] is not None), key=lambda r: (-r[4], r[1]))
    ranks = spark.createDataFrame([(r[0], i + 1) for i, r in enumerate(order)], "id string, rank int")
    reports = reports.join(F.broadcast(ranks), "id", "left")
    return reports, fit(problem, points[order[0][0].split("-", 1)[1]], df) if order else None


def run_search(problem: Problem, df: DataFrame, points: Sequence[dict], n: int = 1) -> tuple[DataFrame, Fitted]:
    """Search end to end: quick scores of all points, then a full evaluation of the best ``n`` on test2.

    Returns (ranked scores, the best pipeline, fitted on all rows). Scores: (candidate_id, fold, target, metric, value,
    larger, rank); rank counts from 1 over the first metric on test2, ties by id, and is null for other rows.
    """
    splits = scratch(split.nested_splits(df, problem.key), "search-splits")
    fits = [evaluate(problem, p, splits, "quick") for p in points]
    quick = [q for q, _ in fits]
    lead = problem.metrics[0]
    told = [(r["value"] if r["larger"] else -r["value"], p) for q, p in zip(quick, points, strict=True) for r in q.where(F.col("metric") == lead).collect()]
    order = [p for _, p in sorted(told, key=lambda t: (-t[0], t[1]["candidate_id"]))]
    before = {p["candidate_id"]: found for p, found in zip(points, fits, strict=True)}
    full = [evaluate(problem, p, splits, quick=before[p["candidate_id"]]) for p in order[:n]]
    chosen = {p["candidate_id"] for p in order[:n]}
    frames = [s for s, _ in full] + [q for q, p in zip(quick, points, strict=True) if p["candidate_id"] not in chosen]
    places = df.sparkSession.createDataFrame([(p["candidate_id"], i + 1) for i, p in enumerate(order)], "candidate_id string, rank int")
    scores = reduce(DataFrame.unionByName, frames).join(F.broadcast(places), "candidate_id")
    main = (F.col("fold") == "test2") & (F.col("metric") == lead)
    return scores.withColumn("rank", F.when(main, F.col("rank"))), full[0][1]
