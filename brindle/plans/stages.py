"""Steps of pipelines that work on table columns: own estimators and transformers, saved and reloaded with the pipeline.

An estimator learns on the training rows and its model applies what it learned to any rows, so a stored
pipeline cleans and encodes new rows as it did the old ones. What is learned is small (values of a
column) and held in a parameter, or a table that is written beside the stage and stays distributed.
"""

from __future__ import annotations

import json
import math

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import clean, encode, select
from brindle.session import scratch


class _Settings(Params):
    """Settings and learned values as JSON, which is all that a stage's metadata hold."""

    settings = Param(Params._dummy(), "settings", "settings as JSON", TypeConverters.toString)
    learned = Param(Params._dummy(), "learned", "learned values as JSON", TypeConverters.toString)

    def __init__(self, **settings) -> None:
        super().__init__()
        self._set(settings=json.dumps(settings))

    def of(self, name: str):
        return json.loads(self.getOrDefault(self.settings))[name]

    @property
    def known(self):
        return json.loads(self.getOrDefault(self.learned))

    def _taught(self, model: _Settings, learned) -> _Settings:
        model._set(settings=self.getOrDefault(self.settings), learned=json.dumps(learned))
        return model


class _Step(_Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer without anything to learn."""


class _Learner(_Settings, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    pass


class _Learned(_Settings, Model, DefaultParamsReadable, DefaultParamsWritable):
    pass


class Impute(_Learner):
    """C6, C8. Missing numbers become the column's mean or median, missing categories its most frequent value."""

    def _fit(self, df: DataFrame) -> ImputeModel:
        numbers, categories, strategy = self.of("numbers"), self.of("categories"), self.of("strategy")
        aggs = [clean.STRATEGIES[strategy](c).alias(c) for c in numbers] + [clean.mode_of(c).alias(c) for c in categories]
        return self._taught(ImputeModel(), df.agg(*aggs).first().asDict() if aggs else {})


class ImputeModel(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.known.items()})


class Encode(_Learner):
    """D1, D3. A 0/1 column for each of a category's most frequent values, for others and for null, named
    ``_enc_<column>_<place>``."""

    def _fit(self, df: DataFrame) -> EncodeModel:
        top = {c: encode.top_values(df.select(F.col(c).cast("string")), c, self.of("n_limit")) for c in self.of("columns")}
        return self._taught(EncodeModel(), top)


class EncodeModel(_Learned):
    @property
    def outputs(self) -> list[str]:
        return [f"_enc_{c}_{i}" for c, top in self.known.items() for i in range(len(top) + 2)]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, top in self.known.items():
            value = F.col(c).cast("string")
            tests = [*(value == v for v in top), value.isNotNull() & ~value.isin(top), value.isNull()]
            out |= {f"_enc_{c}_{i}": F.coalesce(t.cast("double"), F.lit(0.0)) for i, t in enumerate(tests)}
        return df.withColumns(out)


class DateParts(_Step):
    """C4. Year, quarter, month, day, weekday and day of year of dates, as numbers."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return clean.enrich_dates(df, self.of("columns"))


class Synthesize(_Step):
    """E13. Ratios of neighbouring numbers, text lengths and date parts of one table."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return select.synthesize_single(df, self.of("numbers"), self.of("texts"), self.of("dates"))


class ProjectSeries(_Step):
    """E11. A column of equally long arrays becomes ``k`` random projections ``rp0``, ``rp1``, ..."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return select.random_projection(df, self.of("column"), self.of("size"), self.of("k"))


class ToVector(_Learner):
    """Numbers to one vector. ``columns`` are named, ``prefixes`` name all numeric columns that begin so at fit time; null is 0."""

    def _fit(self, df: DataFrame) -> ToVectorModel:
        more = [c for c in df.columns if c.startswith(tuple(self.of("prefixes"))) and c not in self.of("columns")] if self.of("prefixes") else []
        return self._taught(ToVectorModel(), [*self.of("columns"), *more])


class ToVectorModel(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.of("out"), array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.known])))


class SelectJMI(_Learner):
    """E5. The vector's places that joint mutual information chooses."""

    def _fit(self, df: DataFrame) -> SelectJMIModel:
        values = vector_to_array(F.col(self.of("column")))
        size = df.select(F.size(values)).first()[0]
        names = [f"f{i}" for i in range(size)]
        rows = scratch(df.select(*[values[i].alias(c) for i, c in enumerate(names)], F.col(self.of("target")).alias("_target")), "jmi")
        return self._taught(SelectJMIModel(), [int(c[1:]) for c in select.select_jmi(rows, names, "_target", self.of("nbins"), self.of("k"))])


class SelectJMIModel(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        values = vector_to_array(F.col(self.of("column")))
        return df.withColumn(self.of("out"), array_to_vector(F.array(*[values[i] for i in self.known])))


class _TableWriter(MLWriter):
    def __init__(self, model: _TableModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.table = self.sparkSession.read.parquet(f"{path}/table")
        return model


class _TableModel(_Settings, Model, MLReadable, MLWritable):
    """A model with a learned table of any size."""

    table: DataFrame

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class TargetText(_Learner):
    """D6. For each class c the mean over a text's tokens of ln((n_tc + 1) / (n_t + V)), as ``_text_<column>_<place>``. Classes
    are numbered in their order; what is learned is a table of terms."""

    def _fit(self, df: DataFrame) -> TargetTextModel:
        column, target = self.of("column"), self.of("target")
        words = df.where(F.col(target).isNotNull()).select(F.col(target).alias("class"), F.explode(encode.tokens(column)).alias("token"))
        # a token's rows are counted before they meet, however frequent it is
        counts = words.groupBy("token", "class").agg(F.count("*").alias("n"))
        classes = sorted(r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().limit(encode.MAX_COLUMNS + 1).collect())
        if len(classes) > encode.MAX_COLUMNS:
            raise ValueError(f"{target} has more than {encode.MAX_COLUMNS} classes")
        total = F.sum("n")
        of = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0))
        weights = counts.groupBy("token").agg(*[F.log((of(c) + 1) / (total + len(classes))).alias(f"w{i}") for i, c in enumerate(classes)], total.alias("df"))
        model = self._taught(TargetTextModel(), len(classes))
        model.table = scratch(weights, "text-weights")
        return model


class TargetTextModel(_TableModel):
    @property
    def outputs(self) -> list[str]:
        return [f"_text_{self.of('column')}_{i}" for i in range(self.known)]

    def _transform(self, df: DataFrame) -> DataFrame:
        """A text is cut up and its tokens' weights are summed in the task that reads it, so neither texts nor their tokens cross the network:
        the most frequent tokens, up to ``encode.TERM_BYTES``, go to the tasks, and only rows of the rare others are dealt. The means
        are written once, by the text's hash, since each later stage passes over them."""
        column = self.of("column")
        hashed = F.unhex(F.sha2(column, 256))
        table = self.table if "df" in self.table.columns else self.table.withColumn("df", F.lit(1))  # stored by an earlier version
        level = F.floor(F.log2("df")).alias("level")
        sizes = table.groupBy(level).agg(F.sum(F.octet_length("token") + 8 * len(table.columns)).alias("bytes")).orderBy(F.desc("level")).collect()
        room, least = encode.TERM_BYTES, None
        for row in sizes:
            room -= row["bytes"]
            if room < 0:
                break
            least = row["level"]
        often = F.broadcast(table.where(level >= least) if least is not None else table.limit(0))
        words = df.where(F.col(column).isNotNull()).select(hashed.alias("_h"), column).select("_h", F.explode(encode.tokens(column)).alias("token"))
        found = words.join(often, "token")
        if room < 0:
            found = found.unionByName(words.join(often.select("token"), "token", "left_anti").join(table.where(level < least) if least is not None else table, "token"))
        means = scratch(found.groupBy("_h").agg(*[F.avg(f"w{i}").alias(name) for i, name in enumerate(self.outputs)]), "text-means")
        joined = df.withColumn("_h", hashed).join(means, "_h", "left").drop("_h")
        return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in self.outputs})


class AggregateRelated(Estimator, _Settings):
    """E14. Aggregates of a related table on the rows' key: ``rel_count`` and sum, mean, least, largest and deviation of its
    numbers. The related table is given to the estimator; its aggregates are what the model keeps."""

    def __init__(self, related: DataFrame | None = None, **settings) -> None:
        super().__init__(**settings)
        self.related = related

    def _fit(self, df: DataFrame) -> AggregateRelatedModel:
        keys = self.related.select(F.col(self.of("related_key")).alias("_related")).distinct()
        model = self._taught(AggregateRelatedModel(), None)
        rows = select.synthesize_multi(keys, self.related, "_related", self.of("related_key"), self.of("numbers"), prefix="rel")
        model.table = scratch(rows, "related")
        return model


class AggregateRelatedModel(_TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        """Rows without related ones have count 0 and nulls."""
        joined = df.join(self.table, F.col(self.of("key")) == F.col("_related"), "left").drop("_related")
        return joined.withColumn("rel_count", F.coalesce("rel_count", F.lit(0)))


class GaussianNB(_Learner):
    """I10. Gaussian naive Bayes of a vector in closed form: one aggregate. The variance floor is 1e-9 of the largest."""

    def _fit(self, df: DataFrame) -> GaussianNBModel:
        target = self.of("target")
        known = df.where(F.col(target).isNotNull()).withColumn("_v", vector_to_array(F.col(self.of("column"))))
        size = known.select(F.size("_v")).first()[0]
        values = [F.col("_v")[i] for i in range(size)]
        aggs = [f(v).alias(f"{name}{i}") for i, v in enumerate(values) for name, f in (("m", F.avg), ("v", F.var_pop))]
        rows = known.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"), *aggs).orderBy("class").limit(encode.MAX_COLUMNS + 1).collect()
        if len(rows) > encode.MAX_COLUMNS:
            raise ValueError(f"{target} has more than {encode.MAX_COLUMNS} classes")
        total = sum(r["n"] for r in rows)
        # the variance over all rows follows from the classes' sums
        mean = [sum(r["n"] * r[f"m{i}"] for r in rows) / total for i in range(size)]
        whole = [sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean[i]) ** 2) for r in rows) / total for i in range(size)]
        floor = 1e-9 * (max(whole, default=0.0) or 1.0)
        told = [{"class": r["class"], "prior": r["n"] / total, "mean": [r[f"m{i}"] for i in range(size)], "var": [max(r[f"v{i}"], floor) for i in range(size)]} for r in rows]
        return self._taught(GaussianNBModel(), told)


class GaussianNBModel(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``pred`` (ties to the smallest class) and ``probability``, a vector in the classes' order."""
        found = df.withColumn("_v", vector_to_array(F.col(self.of("column"))))
        logs = []
        for row in self.known:
            fixed = math.log(row["prior"]) - 0.5 * sum(math.log(2 * math.pi * v) for v in row["var"])
            terms = [(F.col("_v")[i] - m) * (F.col("_v")[i] - m) / (2 * v) for i, (m, v) in enumerate(zip(row["mean"], row["var"], strict=True))]
            logs.append(F.lit(fixed) - sum(terms, F.lit(0.0)))
        found = found.withColumn("_l", F.array(*logs))
        found = found.withColumns({"_b": F.array_max("_l"), "_i": F.array_position("_l", F.array_max("_l")).cast("int")})
        classes = F.array(*[F.lit(row["class"]) for row in self.known])
        share = F.transform("_l", lambda x: F.exp(x - F.col("_b")))
        total = F.aggregate(share, F.lit(0.0), lambda s, x: s + x)
        return found.withColumns({"pred": F.element_at(classes, F.col("_i")), "probability": array_to_vector(F.transform(share, lambda x: x / total))}).drop("_v", "_l", "_b", "_i")


class Majority(_Learner):
    """I1. The most frequent class (ties to the smallest), or the mean."""

    def _fit(self, df: DataFrame) -> MajorityModel:
        target = self.of("target")
        told = F.mode(target, True) if self.of("classification") else F.avg(target)
        return self._taught(MajorityModel(), df.where(F.col(target).isNotNull()).agg(told).first()[0])


class MajorityModel(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("pred", F.lit(self.known))
