"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage and survives the loss of any executor, unlike a
local checkpoint.  The folder is the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine that names no checkpoint folder, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; on a local master a default, on a cluster an error if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = DEFAULT_SHARED
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet, with the writer's ``options``, and read it back.

    The table lies below ``<shared>/mobilome/<application id>/``, which may be
    deleted when the application has ended.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/mobilome/{app}/{label}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._shared_path = path
    return written


def discard(table: DataFrame | None) -> None:
    """Remove a table that ``materialize`` returned and that no later plan reads."""
    path = getattr(table, "_shared_path", None)
    if path is None:
        return
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A table below this size, half of one split, may lie in a single row group and so be read by a single task.
SMALL_BYTES = 64 << 20


def deal_small(frame: DataFrame) -> DataFrame:
    """``frame``, its rows dealt over all cores if it is smaller than SMALL_BYTES; larger tables are read as they lie, without a shuffle."""
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else frame
