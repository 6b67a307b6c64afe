"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where the setting is absent, a local master gets a temporary folder, once per session; on a cluster that
    would be another folder on every host, so it is an error there.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-graphloom-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Rows that a task writes of a table whose size is known, and tasks that share the smallest ones.
TASK_ROWS, LEAST_TASKS = 1 << 15, 12


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: lineage ends there. The folder goes when the
    driver ends. rows: about how many df has at most, where known; a small table isn't written as a file per shuffle
    partition then."""
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    schema = df.schema
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = os.path.realpath(tempfile.mkdtemp(prefix="spark-graphloom-")) + "/graphloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(path)
    sc._graphloom_shipped = True
