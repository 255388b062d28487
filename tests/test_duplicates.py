"""K3: flags of repeated reports over batches, with nulls, forgotten ids and as many ids as rows."""

import datetime
import time

from pyspark.sql import functions as F

from brindle.plans.queries_ac import folder
from brindle.streaming import reports

SCHEMA = "id string, finished_at timestamp, nth long"


def flags(spark, batches, delay, groups=None):
    at, out = folder(spark, "flag-in"), folder(spark, "flag-out")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(at)
    stream = reports.flag_duplicates(reports.read_reports(spark, at, SCHEMA, per_batch=1), delay)
    return reports.drain(stream.select("id", "nth", "duplicate"), out)


def test_ids_that_share_a_state(spark, monkeypatch):
    monkeypatch.setattr(reports, "GROUPS", 2)
    at = lambda hour: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)
    told = [
        [("a", at(0), 0), ("b", at(1), 1), ("a", at(0.5), 2), (None, at(1), 3), ("c", at(0.6), 4)],
        [("a", at(1), 5), (None, at(1.2), 6), ("d", at(20), 7), ("d", at(19), 8)],
        [("b", at(20), 9), ("d", at(20), 10), ("a", at(21), 11), ("a", at(20.5), 12), (None, at(21), 13)],
        [("c", at(21), 14), ("a", at(21), 15)],
    ]
    found = flags(spark, [spark.createDataFrame(rows, SCHEMA) for rows in told], "1 hour")
    # ids end with the third batch unless they come in it, so ``c`` is forgotten in the fourth; of one batch the earliest counts first
    assert {r.nth for r in found.where("duplicate").collect()} == {2, 5, 6, 7, 9, 10, 11, 12, 13, 15}
    assert found.count() == 16


def test_many_ids_take_few_calls(spark):
    ids = spark.range(40_000).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("finished_at"), F.col("id").alias("nth"))
    began = time.monotonic()
    found = flags(spark, [ids, ids], "1 hour")
    assert {(r.duplicate, r["count"]) for r in found.groupBy("duplicate").count().collect()} == {(False, 40_000), (True, 40_000)}
    assert found.where("not duplicate").select("id").distinct().count() == 40_000
    assert time.monotonic() - began < 90
