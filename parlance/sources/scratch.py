"""Folders for tables that a job writes on its way: under the cluster's checkpoint folder, which all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where none is set, under the warehouse (refused if that is local to a cluster's machines)."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
            if not context.master.startswith("local[") and context.master != "local" and warehouse.startswith(("file:", "/", "spark-warehouse")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = f"{warehouse}/_checkpoints"
        context.setCheckpointDir(at)
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table as Parquet to a new folder and read it back: lineage is cut, and its true size is known."""
    path, schema = new_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
