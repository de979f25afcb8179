"""Tables in the folder that all executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where the session names none and runs locally (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/shiftloom-checkpoints"
    return f"{base.rstrip('/')}/shiftloom-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
