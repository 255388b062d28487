"""Profiling, sampling, cleaning and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.keys import u
from brindle.operators.ranks import quantiles
from brindle.session import scratch

BOOLEANS = ("true", "false", "0", "1", "yes", "no")
MAX_CATEGORIES, MAX_SHARE = 50, 0.1
SINGLETON = "__other__"
MISSING = "__missing__"
MARKS = ("-", "/", "_", ",", ";")


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of some columns as text, in one pass over the table."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")


def infer_types(df: DataFrame, columns: Sequence[str], max_cat: int = MAX_CATEGORIES) -> DataFrame:
    """C1. (column, type), the first that fits all values: boolean, integer, real, dateTime, categorical,
    text. The table is unpivoted and grouped once by (column, value), so wide tables need no more jobs."""
    values = _long(df, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    all_ok = lambda test: F.bool_and(F.coalesce(test, F.lit(False)))
    v = F.col("value")
    found = values.groupBy("column").agg(
        all_ok(F.lower(v).isin(*BOOLEANS)).alias("b"),
        all_ok(v.try_cast("bigint").isNotNull()).alias("i"),
        all_ok(v.try_cast("double").isNotNull()).alias("r"),
        all_ok(F.try_to_timestamp(v).isNotNull()).alias("d"),
        F.count("*").alias("distinct"),
        F.sum("n").alias("n"),
    )
    few = (F.col("distinct") <= max_cat) & (F.col("distinct") / F.col("n") <= MAX_SHARE)
    kind = F.when(F.col("b"), "boolean").when(F.col("i"), "integer").when(F.col("r"), "real").when(F.col("d"), "dateTime").when(few, "categorical").otherwise("text")
    return found.select("column", kind.alias("type"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C2. One row for each column: counts, extremes, moments and exact quartiles of numbers, the most frequent
    value with its share, mean text length."""
    values = _long(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    x = F.col("value").try_cast("double")
    total = values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.sum(x * F.col("n")) / F.sum(F.when(x.isNotNull(), F.col("n")))).alias("mean"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("top"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top_n"),
        (F.sum(F.length("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean_length"),
    )
    spread = _long(df, columns).groupBy("column").agg(F.stddev_samp(x).alias("std"))
    told = quantiles(df, {c: F.col(c).cast("string").try_cast("double") for c in columns}, (0.25, 0.5, 0.75))
    at = F.col("column")
    for i, name in enumerate(("q1", "median", "q3")):
        one = F.lit(None).cast("double")
        for c in columns:
            one = F.when(at == c, F.lit(told[c][i])).otherwise(one)
        spread = spread.withColumn(name, one)
    return total.join(spread, "column").withColumn("top_share", F.col("top_n") / (F.col("rows") - F.col("nulls"))).drop("top_n")


def clean_featurize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C3. Columns where at least 90% of the values hold one mark the same number of times are split on it;
    letters followed by digits are split in two."""
    tests, digits = [], r"^([A-Za-z#]+)([0-9]+)$"
    for c in columns:
        for k, m in enumerate(MARKS):
            count = F.length(c) - F.length(F.translate(F.col(c), m, ""))
            tests += [F.mode(F.when(count > 0, count), True).alias(f"{c}|{k}"), F.count(F.when(count > 0, 1)).alias(f"{c}|{k}|n")]
        tests += [F.count(c).alias(f"{c}|n"), F.count_if(F.col(c).rlike(digits)).alias(f"{c}|a")]
    found = df.agg(*tests).first()
    out = {}
    same = {}
    for c in columns:
        for k, m in enumerate(MARKS):
            if (n := found[f"{c}|{k}"]) and found[f"{c}|{k}|n"] >= 0.9 * found[f"{c}|n"]:
                same[c] = (m, n)
                break
    if same:
        agree = df.agg(*[F.count_if(F.length(c) - F.length(F.translate(F.col(c), m, "")) == n).alias(c) for c, (m, n) in same.items()]).first()
    for c in columns:
        if c in same and agree[c] >= 0.9 * found[f"{c}|n"]:
            m, n = same[c]
            parts = F.split(F.col(c), m)
            out |= {f"{c}_{i}": F.get(parts, F.lit(i)) for i in range(n + 1)}
        elif found[f"{c}|n"] and found[f"{c}|a"] >= 0.9 * found[f"{c}|n"]:
            out |= {f"{c}_alpha": F.regexp_extract(c, digits, 1), f"{c}_digits": F.regexp_extract(c, digits, 2)}
    return df.withColumns(out).drop(*{name.rsplit("_", 1)[0] for name in out})


def enrich_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C4. Year, quarter, month, day, weekday (Monday 1) and day of year of each date column."""
    parts = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "weekday": lambda c: F.weekday(c) + 1, "dayofyear": F.dayofyear}
    return df.withColumns({f"{c}_{name}": f(F.col(c)) for c in columns for name, f in parts.items()})


def replace_singletons(df: DataFrame, columns: Sequence[str], token: str = SINGLETON) -> DataFrame:
    """C5. Values that a column holds once become one token. Frequent values are joined by a pre-aggregated
    count, so a hot value costs one row."""
    for c in columns:
        once = df.groupBy(c).agg(F.count("*").alias("_n")).where((F.col("_n") == 1) & F.col(c).isNotNull()).select(F.col(c).alias("_v"))
        df = df.join(once, df[c] == once["_v"], "left").withColumn(c, F.when(F.col("_v").isNotNull(), token).otherwise(F.col(c))).drop("_v")
    return df


def mode_of(c: str) -> Column:
    """The most frequent value; ties go to the smallest."""
    return F.mode(c, True)


STRATEGIES = {"mean": F.avg, "most_frequent": mode_of}


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean") -> DataFrame:
    """C6, C7. Nulls become the column's mean, median or most frequent value (one aggregate for all), or the
    exact median (a few counted passes for all)."""
    if strategy == "median":
        fill = {c: q[0] for c, q in quantiles(df, {c: F.col(c) for c in columns}, [0.5]).items()}
    else:
        fill = df.agg(*[STRATEGIES[strategy](c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fill[c])) for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C7. Nulls of numeric features become the mean."""
    return impute(df, columns, "mean")


def impute_categorical(df: DataFrame, columns: Sequence[str], explicit: bool = False) -> DataFrame:
    """C8. Nulls become a token of their own, or the most frequent value."""
    if explicit:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in columns})
    return impute(df, columns, "most_frequent")


def impute_greedy(df: DataFrame, columns: Sequence[str], key: str, hide: float = 0.1) -> DataFrame:
    """C9. Each column takes the strategy (mean, median, mode, zero) with the least absolute error on cells
    that are hidden by the key's bucket; ties go to the first by name."""
    hidden = u(key, "greedy") < hide
    names = ("mean", "median", "mode", "zero")
    fills = df.agg(*[f(F.when(~hidden, F.col(c))).alias(f"{c}|{n}") for c in columns for n, f in (("mean", F.avg), ("mode", lambda x: F.mode(x, True)))]).first()
    middle = quantiles(df.where(~hidden), {c: F.col(c) for c in columns}, [0.5])
    told = lambda c, n: {"median": middle[c][0], "zero": 0.0}[n] if n in ("median", "zero") else fills[f"{c}|{n}"]
    value = {(c, n): told(c, n) or 0.0 for c in columns for n in names}
    errors = df.where(hidden).agg(*[F.avg(F.abs(F.col(c) - F.lit(float(value[c, n])))).alias(f"{c}|{n}") for c in columns for n in names]).first()
    best = {c: min(names, key=lambda n: (round(errors[f"{c}|{n}"] or 0.0, 9), n)) for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(value[c, best[c]]))) for c in columns} | {f"{c}_strategy": F.lit(best[c]) for c in columns})


def impute_iterative(df: DataFrame, columns: Sequence[str], rounds: int = 2) -> DataFrame:
    """C10. Each column's nulls become its regression on the others, a few rounds, from the mean."""
    work = df.withColumns({f"_null_{c}": F.col(c).isNull() for c in columns})
    work = impute_mean(work.withColumns({c: F.col(c).cast("double") for c in columns}), columns)
    for _ in range(rounds):
        for c in columns:
            others = [x for x in columns if x != c]
            ready = VectorAssembler(inputCols=others, outputCol="_x").transform(work)
            model = LinearRegression(featuresCol="_x", labelCol=c, predictionCol="_p", regParam=1e-6).fit(ready.where(~F.col(f"_null_{c}")))
            work = model.transform(ready).withColumn(c, F.when(F.col(f"_null_{c}"), F.col("_p")).otherwise(F.col(c))).drop("_x", "_p")
        work = scratch(work, "impute-round")
    return work.drop(*[f"_null_{c}" for c in columns])


def impute_matrix(df: DataFrame, key: str, columns: Sequence[str], rank: int = 4, reg: float = 0.05, iters: int = 5) -> DataFrame:
    """C11. Nulls become the entries of a low-rank completion of the (standardised) table."""
    stats = df.agg(*[F.avg(c).alias(f"{c}|m") for c in columns], *[F.stddev_pop(c).alias(f"{c}|s") for c in columns]).first()
    scale = {c: (stats[f"{c}|m"] or 0.0, stats[f"{c}|s"] or 1.0) for c in columns}
    cells = [F.struct(F.lit(i).alias("col"), ((F.col(c) - scale[c][0]) / scale[c][1]).cast("float").alias("value")) for i, c in enumerate(columns)]
    long = df.select(F.col(key).cast("int").alias("row"), F.explode(F.array(*cells)).alias("x")).select("row", "x.*")
    model = ALS(rank=rank, maxIter=iters, regParam=reg, userCol="row", itemCol="col", ratingCol="value", seed=7).fit(long.where(F.col("value").isNotNull()))
    guess = model.transform(long.where(F.col("value").isNull())).groupBy("row").pivot("col", list(range(len(columns)))).agg(F.first("prediction"))
    joined = df.join(guess, F.col(key).cast("int") == F.col("row"), "left")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.coalesce(F.nanvl(F.col(f"`{i}`"), F.lit(0.0)), F.lit(0.0)) * scale[c][1] + scale[c][0]) for i, c in enumerate(columns)}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def missing_indicator(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C12. A 0/1 column for each, 1 where the value is missing."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def limit_size(df: DataFrame, key: str, max_rows: int, max_cols: int, features: Sequence[str]) -> DataFrame:
    """C13. Rows by the key's bucket down to about ``max_rows``, and the ``max_cols`` features of largest
    variance (ties by name)."""
    found = df.agg(F.count("*").alias("n"), *[F.var_samp(c).alias(f"v|{c}") for c in features]).first()
    rows = df if found["n"] <= max_rows else df.where(u(key) < max_rows / found["n"])
    best = sorted(features, key=lambda c: (-(found[f"v|{c}"] or 0.0), c))[:max_cols]
    return rows.select(*[c for c in df.columns if c in best or c not in features])


def sample_rows(df: DataFrame, key: str, share: float, seed: str = "") -> DataFrame:
    """C14. The rows whose key falls in the first ``share`` of the buckets."""
    return df.where(u(key, seed) < share)


def column_sample(df: DataFrame, key: str, column: str, large: int = 100_000, medium: int = 1_000) -> DataFrame:
    """C15. Distinct values of a sample: a tenth of a large table, ``medium`` rows of a middle one, all of
    a small one."""
    n = df.count()
    part = df.where(u(key) < 0.1) if n > large else df.orderBy(u(key), key).limit(medium) if n > medium else df
    return part.select(F.col(column).alias("value")).distinct()


def candidate_columns(df: DataFrame, roles: Sequence[str]) -> DataFrame:
    """C16. (column, role, filled, different) for the columns with one of ``roles``: candidates for entity matching, with
    how many rows fill them and how many different values there are, from one pass over the rows."""
    from brindle.operators.schema import roles_of

    found = [(c, r) for c in df.columns for r in roles_of(df, c) if r in roles]
    columns = list(dict.fromkeys(c for c, _ in found))
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, role string, filled long, different long")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = cells.groupBy("column", "value").agg(F.count("value").alias("n")).groupBy("column").agg(F.sum("n").alias("filled"), F.count("value").alias("different"))
    roles_by = F.create_map(*(x for c in columns for x in (F.lit(c), F.array(*[F.lit(r) for k, r in found if k == c]))))
    return counts.select("column", F.explode(roles_by[F.col("column")]).alias("role"), "filled", "different")


def series_to_long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """C17. A wide series to (key, step, value)."""
    return df.unpivot([key], list(columns), "step", "value")


def series_to_list(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """C17. A long series to one row for each key with its values in time order."""
    parts = F.array_sort(F.collect_list(F.struct(ts, value)))
    return df.groupBy(key).agg(F.transform(parts, lambda p: p[value]).alias("values"))
