"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

Writing a phase's result and reading it again cuts the lineage, survives lost
executors (the files are not on an executor's own disk) and gives the next phase exact
sizes to plan joins with.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names; with a local master, if none is set, a temporary one."""
    folder = spark.conf.get(_KEY, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rillflow-")
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/rillflow/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(*frames: DataFrame) -> None:
    """Deletes the files behind frames made by ``store`` that nothing needs any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that only unreachable plans refer to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
