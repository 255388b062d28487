"""Sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.schema import with_roles

TYPES = {
    "boolean": T.BooleanType(), "integer": T.LongType(), "real": T.DoubleType(), "string": T.StringType(), "text": T.StringType(), "categorical": T.StringType(),
    "dateTime": T.TimestampType(), "realVector": T.StringType(), "json": T.StringType(), "geojson": T.StringType(), "unknown": T.StringType(),
}


def schema_of(columns: Sequence[dict]) -> T.StructType:
    """A declared schema: types, with roles and the declared type as metadata."""
    ordered = sorted(columns, key=lambda c: c.get("colIndex", 0))
    return T.StructType([T.StructField(c["colName"], TYPES[c.get("colType", "unknown")], True, {"roles": list(c.get("role", [])), "type": c.get("colType", "unknown")}) for c in ordered])


def read_dataset(spark: SparkSession, document: dict | str, base: str, problem: dict | None = None) -> tuple[dict[str, DataFrame], str]:
    """A1. Named tables of a dataset document and the name of its main one (tagged ``entryPoint``, else the
    first). Schemas are declared, so nothing is inferred; the problem's targets get their role."""
    document = json.loads(document) if isinstance(document, str) else document
    tables, main = {}, None
    for r in document["dataResources"]:
        if r.get("resType") != "table":
            continue
        path, schema = f"{base}/{r['resPath']}", schema_of(r["columns"])
        if "parquet" in r.get("resFormat", ["csv"]):
            df = spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema])
        else:
            df = spark.read.schema(schema).option("header", True).csv(path)
            df = with_roles(df, {f.name: f.metadata["roles"] for f in schema})
        tables[r["resID"]] = df
        main = main or (r["resID"] if r.get("entryPoint") else None)
    main = main or next(iter(tables))
    for t in (problem or {}).get("targets", []):
        own = tables[t.get("resID", main)]
        tables[t.get("resID", main)] = with_roles(own, {t["colName"]: ["target", "trueTarget"]})
    return tables, main


def key_and_target(df: DataFrame) -> tuple[str, str]:
    """A1. The columns with the roles ``index`` and ``suggestedTarget`` or ``target``, else first and last."""
    find = lambda roles, other: next((f.name for f in df.schema if set(roles) & set(f.metadata.get("roles", []))), other)
    return find(("index",), df.columns[0]), find(("target", "suggestedTarget"), df.columns[-1])


def read_text_collection(df: DataFrame, column: str, path: str, out: str = "content", name: str = "_metadata.file_name") -> DataFrame:
    """A2. The texts of files named in a column. ``name``: an SQL expression for a file's name."""
    spark = df.sparkSession
    texts = spark.read.text(path, wholetext=True).select(F.expr(name).cast("string").alias("_file"), F.col("value").alias(out))
    return df.join(texts, df[column] == texts["_file"], "left").drop("_file")


def read_series(spark: SparkSession, path: str, schema: str = "ts string, value double") -> DataFrame:
    """A3. One file for each series, to (series_id, ts, value)."""
    return spark.read.schema(schema).option("header", True).csv(path).select(F.regexp_replace("_metadata.file_name", r"\.csv$", "").alias("series_id"), "*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4. (edges, nodes) of an edge list."""
    edges = spark.read.schema("src long, dst long, weight double").option("header", True).csv(path)
    return edges, nodes_of(edges)


def nodes_of(edges: DataFrame) -> DataFrame:
    """A4. The distinct endpoints."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def read_splits(spark: SparkSession, path: str, df: DataFrame, key: str) -> DataFrame:
    """A5. Rows with the given type, repeat and fold of a splits file."""
    splits = spark.read.schema(f"{key} long, type string, repeat int, fold int").option("header", True).csv(path)
    return df.join(splits, key)


def write_predictions(df: DataFrame, path: str) -> None:
    """A6."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_ranked(reports: DataFrame, path: str) -> None:
    """A7. Rank, metrics, template and fold scores, one JSON line each."""
    reports.select("id", "rank", "template_name", "metric", "value", "fold_values").write.mode("overwrite").json(path)


def save_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A8. One table, partitioned by its split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def load_splits(spark: SparkSession, path: str, part: str | None = None, split: str = "split") -> DataFrame:
    """A8. All parts or one; partition pruning reads no other."""
    df = spark.read.parquet(path)
    return df.where(F.col(split) == part) if part else df


def save_fitted(model: PipelineModel, base: str, fid: str) -> str:
    """A9."""
    path = f"{base}/{fid}"
    model.write().overwrite().save(path)
    return path


def load_fitted(base: str, fid: str | None = None, reports: DataFrame | None = None) -> PipelineModel:
    """A9. A fitted pipeline by id, or the latest of the reports."""
    if fid is None:
        fid = reports.agg(F.max_by("fid", "finished_at")).first()[0]
    return PipelineModel.load(f"{base}/{fid}")


def write_runs(runs: DataFrame, path: str) -> None:
    """A10. Append records whose id isn't there yet."""
    spark, fresh = runs.sparkSession, runs.dropDuplicates(["id"])
    try:
        known = spark.read.parquet(path).select("id")
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None:
        fresh = fresh.join(known, "id", "left_anti")
    fresh.write.mode("append").parquet(path)


def write_failures(df: DataFrame, path: str) -> None:
    """A11. (template, message) to exception, step and implementation, appended as JSON."""
    m = F.col("message")
    df.select("template", F.regexp_extract(m, r"^(\w+):", 1).alias("exception"), F.regexp_extract(m, r"step (\w+)", 1).alias("step"), F.regexp_extract(m, r"using ([\w.]+)", 1).alias("implementation")).write.mode("append").json(path)


def attach_scores(info: DataFrame, scores: DataFrame) -> DataFrame:
    """A12. Pipeline records with their scores as a sorted list; records without any keep null."""
    by = scores.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("scores"))
    return info.join(by, "stem", "left")
