"""Joins, set operations and relational combination."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKIPPED = ("graph", "audio", "timeSeries")


def denormalize(fact: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]], keywords: Sequence[str] = ()) -> DataFrame:
    """F1. Follow foreign keys: (table, key in the frame, key in the table), left joins that never add rows
    (each table is first reduced to one row for a key). Join sides are left to the optimizer, which
    broadcasts only what it knows to be small. Graph, audio and time-series tasks stay as they are."""
    if set(keywords) & set(SKIPPED):
        return fact
    for table, own, other in lookups:
        unique = table.dropDuplicates([other])
        fact = fact.join(unique.withColumnRenamed(other, "_key"), fact[own] == F.col("_key"), "left").drop("_key")
    return fact


def augment(df: DataFrame, other: DataFrame, on: dict[str, str], numbers: Sequence[str]) -> DataFrame:
    """F2. Left join of an outside table's averages on ``on`` (own column: its column); unchanged unless
    that adds a column."""
    fresh = [c for c in numbers if f"aug_{c}" not in df.columns]
    if not fresh:
        return df
    by = other.groupBy(*[F.col(o).alias(f"_k{i}") for i, o in enumerate(on.values())]).agg(*[F.avg(c).alias(f"aug_{c}") for c in fresh])
    cond = reduce(lambda a, b: a & b, [df[c] == by[f"_k{i}"] for i, c in enumerate(on)])
    return df.join(by, cond, "left").drop(*[f"_k{i}" for i in range(len(on))])


def discover_joins(df: DataFrame, columns: Sequence[str], tables: dict[str, tuple[DataFrame, Sequence[str]]], used: Sequence[str] = ()) -> DataFrame:
    """F3. (column, table, other, score): the share of a column's distinct values that another table's column
    of the same type has; best first. Tables in ``used`` are left out."""
    parts = []
    for name, (table, others) in tables.items():
        if name in used:
            continue
        for c in columns:
            for o in others:
                if df.schema[c].dataType != table.schema[o].dataType:
                    continue
                left, right = df.select(F.col(c).alias("v")).distinct(), table.select(F.col(o).alias("v"), F.lit(1).alias("hit")).distinct()
                score = left.where("v is not null").join(right, "v", "left").agg((F.count("hit") / F.count("*")).alias("score"))
                parts.append(score.select(F.lit(c).alias("column"), F.lit(name).alias("table"), F.lit(o).alias("other"), "score"))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "table", "column", "other")


def augment_all(df: DataFrame, steps: Sequence[tuple[DataFrame, dict[str, str], Sequence[str]]], mode: str = "serial") -> list[DataFrame]:
    """F4. A chain of augmentations, or one alternative for each table."""
    if mode == "parallel":
        return [augment(df, *s) for s in steps]
    return [reduce(lambda d, s: augment(d, *s), steps, df)]


def join_truth(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """F5. Truth and prediction on the key as text: (key, target, truth, pred)."""
    if len(truth.columns) != len(pred.columns):
        raise ValueError("truth and prediction have different numbers of columns")
    targets = [c for c in truth.columns if c != key]
    long = lambda d, name: d.select(F.col(key).cast("string").alias(key), F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias(name)) for t in targets])).alias("x")).select(key, "x.*")
    return long(truth, "truth").join(long(pred, "pred"), [key, "target"])


def hconcat(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """F6. Frames side by side on their key, columns of later frames numbered."""
    named = [d if not i else d.select(key, *[F.col(c).alias(f"{c}_{i}") for c in d.columns if c != key]) for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.join(b, key), named)


def vconcat(dfs: Sequence[DataFrame]) -> DataFrame:
    """F7. Frames below each other by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def compare_baseline(targets: DataFrame, ours: DataFrame, key: str, value: str) -> DataFrame:
    """F8. Our score beside each target, N/A where there is none."""
    return targets.join(ours.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit("N/A")))


def join_usage(steps: DataFrame, samples: DataFrame) -> DataFrame:
    """F9. steps(pid, step, start, end), samples(pid, ts, cpu, memory): averages and counts of the samples of
    the same process with start <= ts < end; steps without any keep nulls."""
    s = samples.select(F.col("pid").alias("_pid"), "ts", "cpu", "memory")
    joined = steps.join(s, (steps["pid"] == s["_pid"]) & (s["ts"] >= steps["start"]) & (s["ts"] < steps["end"]), "left")
    return joined.groupBy("pid", "step").agg(F.count("ts").alias("samples"), F.avg("cpu").alias("cpu"), F.avg("memory").alias("memory"))


def candidate_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def unseen(cands: DataFrame, seen: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F10. Candidates that were not evaluated yet."""
    return cands.withColumn("_h", candidate_hash(columns)).join(seen.select(candidate_hash(columns).alias("_h")), "_h", "left_anti").drop("_h")


def existing(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """F11. Rows whose key exists in another table."""
    return df.join(keys.select(key), key, "left_semi")


def overlap(a: Column, b: Column) -> Column:
    """F12. Whether two keyword sets share an element."""
    return F.arrays_overlap(a, b)


def difference(a: Column, b: Column) -> Column:
    """F12. The elements of ``a`` that ``b`` lacks, sorted."""
    return F.array_sort(F.array_except(a, b))


def subset(a: Column, b: Column) -> Column:
    """F12. Whether all of ``a`` is in ``b``."""
    return F.size(F.array_except(a, b)) == 0


def grid(params: DataFrame) -> DataFrame:
    """F13. params(name, value): every combination as a map, one row each. The values of a hyperparameter
    are few; the product is built by exploding each list in turn."""
    lists = params.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("values")).orderBy("name").collect()
    out = params.sparkSession.range(1).select()
    for r in lists:
        out = out.withColumn(r["name"], F.explode(F.array(*map(F.lit, r["values"]))))
    return out.select(F.create_map(*[x for r in lists for x in (F.lit(r["name"]), F.col(r["name"]))]).alias("params"))


def pair_similarity(preds: DataFrame) -> DataFrame:
    """F14. preds(candidate_id, row_id, pred): for each pair of candidates the share of rows they agree on,
    by an equi join on the row."""
    a, b = preds.alias("a"), preds.alias("b")
    joined = a.join(b, (F.col("a.row_id") == F.col("b.row_id")) & (F.col("a.candidate_id") < F.col("b.candidate_id")))
    return joined.groupBy(F.col("a.candidate_id").alias("a"), F.col("b.candidate_id").alias("b")).agg(F.avg((F.col("a.pred") == F.col("b.pred")).cast("double")).alias("similarity"))


def distance(a: Column, b: Column, metric: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))
