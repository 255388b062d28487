import importlib.util
import os
import subprocess
import sys
from pathlib import Path

#: Runs in a session of its own, since executors share the driver's process in the others.
SCRIPT = """
import os
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

from brindle.session import release

conf = {"spark.master": "local-cluster[1,2,1500]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()


def held(batches):
    for _ in batches:
        daemon = int(re.search(r"PPid:\\s+(\\d+)", Path(f"/proc/{os.getppid()}/status").read_text())[1])
        mb = int(re.search(r"RssAnon:\\s+(\\d+)", Path(f"/proc/{daemon}/status").read_text())[1]) // 1024
        yield pa.RecordBatch.from_arrays([pa.array([mb], pa.int64())], names=["mb"])


def memory():
    return spark.range(0, 1, 1, 1).mapInArrow(held, "mb long").first()[0]


memory()
spark.range(0, 6_000_000, 1, 4).selectExpr("id % 7 as k", "repeat(cast(id as string), 12) as text").repartition(4, "text").sortWithinPartitions("text").write.format("noop").mode("overwrite").save()
before = memory()
release(spark)
print("MB", before, memory())
spark.stop()
"""


def test_executors_give_back_the_heap_of_earlier_jobs(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    (tmp_path / "home" / "work").mkdir(parents=True)  # executors work below Spark's home
    for part in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if part.name != "work":
            (tmp_path / "home" / part.name).symlink_to(part)
    own = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_SCALA_VERSION": "2.13"}
    own = {k: v for k, v in own.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", SCRIPT], env=own, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [line for line in run.stdout.splitlines() if line.startswith("MB ")]
    assert said, run.stderr[-2000:]
    before, after = map(int, said[0].split()[1:])
    assert before - after > 150, (before, after)
