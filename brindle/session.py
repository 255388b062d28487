"""Small helpers shared by the operators: table reading and shared scratch space."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names
    it, else (tests, one machine) a temporary folder made once per session and removed at the end.

    Tables in a named folder stay, since results that read them may outlive the session's queries."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.conf.get("brindle.scratch", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = "file://" + folder
        spark.conf.set("brindle.scratch", own)
    return own


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage
    in a way that outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`scratch` wrote and that no later query reads."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def planned_once(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """Queries inside are planned before they run and not anew after each shuffle, which is for few rows: a query is one job beside
    its broadcasts. Else the driver starts a thread and a job for each exchange, and keeps every new plan's metrics with the query's.
    ``tasks``: how many of them a shuffle goes to."""
    own = {"spark.sql.adaptive.enabled": "false"} | ({"spark.sql.shuffle.partitions": str(tasks)} if tasks else {})
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def counted(df: DataFrame) -> int:
    """How many rows ``df``, a written table, has."""
    with planned_once(df.sparkSession):
        return df.count()


def release(spark: SparkSession) -> None:
    """Let go of what earlier jobs left. Spark drops their shuffle files and broadcasts once the objects on the driver that
    stand for them are collected. An executor's heap grows with their garbage too, and shrinks when it is collected: every
    core gets a task that asks for it. No result depends on that, so it does no harm where such a task goes astray."""
    gc.collect()
    context = spark.sparkContext
    context._jvm.System.gc()
    if context.master.split("[")[0] != "local":  # else the driver's heap is the only one
        cores = context.defaultParallelism
        spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
