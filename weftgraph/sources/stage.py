"""Intermediate results as tables in the shared folder: short plans, and nothing to recompute when an executor is lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..ship import ship


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir (under a local master, a temporary folder where it is unset); deleted with the driver's JVM."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
        base = context.getCheckpointDir()
    target = f"{base.rstrip('/')}/weftgraph/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return target


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in a folder of its own, read back."""
    spark = df.sparkSession
    ship(spark)
    target = folder(spark, name)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
