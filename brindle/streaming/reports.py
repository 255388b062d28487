"""Streams of finished reports and of usage samples (K1 to K6)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

SCHEMA = "id string, template_name string, cv double, rank double, finished_at timestamp, error string"


def read_reports(spark: SparkSession, path: str, schema: str = SCHEMA, per_batch: int | None = None) -> DataFrame:
    """Reports as a stream of the files of a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def stream_reports(reports: DataFrame) -> DataFrame:
    """K1. Reports that have a result, with the minute they finished in."""
    return reports.where(F.col("cv").isNotNull() & F.col("error").isNull()).withColumn("minute", F.date_trunc("minute", "finished_at"))


def stream_best(reports: DataFrame) -> DataFrame:
    """K2. The best report so far for each template."""
    return reports.where(F.col("error").isNull()).groupBy("template_name").agg(F.max_by("id", F.struct("cv", "id")).alias("id"), F.max("cv").alias("cv"), F.count("*").alias("reports"))


def stream_dedupe(reports: DataFrame, delay: str = "1 hour") -> DataFrame:
    """K3. Each id once; an id may come again within ``delay``. State is bounded by the watermark."""
    return reports.withWatermark("finished_at", delay).dropDuplicatesWithinWatermark(["id"])


#: Groups of ids that share a state. It is part of a stream's checkpoint, so a changed number needs a new one.
GROUPS = 2_048


def flag_duplicates(reports: DataFrame, delay: str = "1 hour") -> DataFrame:
    """K3. All reports, with ``duplicate``: whether the id came before. An id is remembered until the watermark, ``delay``
    behind the newest report, has passed its last report by ``delay`` again, so state is bounded; a report behind the watermark
    is dropped. Of reports of an id in one batch the one that finished first is no duplicate. Ids are dealt by their hash over GROUPS states, since
    a call of Python for each id would take a millisecond."""
    span = reports.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {delay})").first()[0]
    schema = StructType([*reports.schema.fields, StructField("duplicate", BooleanType())])

    def flag(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        told, seen, mark = None, set(), None
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("_ms", kind="stable")
            ids = rows["_id"].where(rows["_id"].notna(), None).tolist()
            rows["duplicate"] = rows["_id"].isin(known) | rows["_id"].duplicated()
            mark, seen = state.getCurrentWatermarkMs(), set(ids)
            for name, ms in zip(ids, rows["_ms"].tolist(), strict=True):
                known[name] = max(known.get(name, mark), mark, mark if ms != ms else int(ms))
            told = rows.drop(columns=["_ms", "_id", "_group"])
        mark = state.getCurrentWatermarkMs()
        known = {name: ms for name, ms in known.items() if name in seen or ms + span >= mark}
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(min(known.values()) + span)
        else:
            state.remove()
        if told is not None:
            yield told

    text = F.hex("id") if isinstance(reports.schema["id"].dataType, BinaryType) else F.col("id").cast("string")
    own = {"_ms": F.unix_millis("finished_at"), "_id": text, "_group": F.pmod(F.xxhash64(text), F.lit(GROUPS)).cast("int")}
    timed = reports.withColumns(own).withWatermark("finished_at", delay)
    return timed.groupBy("_group").applyInPandasWithState(flag, schema, "ids array<string>, latest array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drop_late(reports: DataFrame, deadline: str, delay: str = "10 minutes") -> DataFrame:
    """K4. Without reports that finished after the deadline."""
    return reports.withWatermark("finished_at", delay).where(F.col("finished_at") <= F.lit(deadline).cast("timestamp"))


def mark_late(reports: DataFrame, deadline: str | None = None, delay: str = "1 hour", keep: str = "7 days") -> DataFrame:
    """K4. All reports, with ``late``: whether they finished after their search (template_name) was marked as done or after the
    ``deadline``, so that they aren't ranked. A row whose ``done`` is true is such a mark and no report; the earliest counts. Marks hold
    for reports of their own batch and of all later ones, in any order of times; one that comes after a report doesn't take it
    back. A report without a time is late once there is a mark. State is one number for each marked search and ends ``keep``
    after the watermark, ``delay`` behind the newest row, has passed the mark."""
    spark = reports.sparkSession
    span = spark.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {keep})").first()[0]
    end = spark.range(1).select(F.unix_millis(F.lit(deadline).cast("timestamp"))).first()[0] if deadline else None
    schema = StructType([*[f for f in reports.schema.fields if f.name != "done"], StructField("late", BooleanType())])

    def tell(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        is_mark = rows["done"].eq(True)
        marks = [int(x) for x in rows.loc[is_mark, "_ms"].dropna()] + ([state.get[0]] if state.exists else [])
        if marks:
            state.update((min(marks),))
            state.setTimeoutTimestamp(max(min(marks), state.getCurrentWatermarkMs()) + span + 1)
        closing = min([*marks, *([end] if end is not None else [])], default=None)
        told = rows[~is_mark]
        late = pd.Series(False, index=told.index) if closing is None else (told["_ms"] > closing) | (told["_ms"].isna() & bool(marks))
        yield told.assign(late=late).drop(columns=["_ms", "done"])

    timed = reports.withColumn("_ms", F.unix_millis("finished_at")).withWatermark("finished_at", delay)
    return timed.groupBy("template_name").applyInPandasWithState(tell, schema, "mark long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_usage(samples: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """K5. Averages for each process and tumbling window."""
    by = samples.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "pid")
    return by.agg(F.count("*").alias("samples"), F.avg("cpu").alias("cpu")).select(F.col("w.start").alias("start"), "pid", "samples", "cpu")


def stream_produce(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """K6. Predictions of a fitted pipeline for a stream of rows."""
    from brindle.operators.models import predict

    return predict(model, rows, key)


def drain(stream: DataFrame, path: str, mode: str = "append", each: Callable | None = None) -> DataFrame | None:
    """Run a stream over all that is there and return what it wrote: a table for ``append``; for ``update``
    and ``complete`` every batch replaces the last, as tables do that readers poll."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append" and each is None:
        writer.format("parquet").start(f"{path}/out").awaitTermination()
    else:
        put = each or (lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out"))
        writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def follow(stream: DataFrame, path: str, done: Callable[[int], bool], seconds: float) -> DataFrame:
    """K1. Run a stream until ``done(rows so far)`` or until ``seconds`` have passed; what it wrote, with the number of
    rows up to the end of its batch as ``seen``. A batch that is run again replaces itself, and its number too."""
    spark = stream.sparkSession
    told: dict[int, int] = {}

    def put(df: DataFrame, batch: int) -> None:
        at = f"{path}/out/batch={batch}"
        df.write.mode("overwrite").parquet(at)
        told[batch] = spark.read.schema(df.schema).parquet(at).count()

    query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).start()
    end = time.monotonic() + seconds
    try:
        while time.monotonic() < end and not done(sum(told.values())) and not query.awaitTermination(1):
            pass
    finally:
        query.stop()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    if not told:
        return spark.createDataFrame([], StructType([*stream.schema.fields, StructField("seen", LongType())]))
    counts = spark.createDataFrame(sorted(told.items()), "batch int, n long")
    counts = counts.withColumn("seen", F.sum("n").over(Window.orderBy("batch"))).drop("n")
    return spark.read.schema(schema).parquet(f"{path}/out").join(F.broadcast(counts), "batch").drop("batch")
