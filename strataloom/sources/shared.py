"""Tables in the folder that all executors share (``spark.checkpoint.dir``): they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """A folder for one table; a temporary one only where the setting is missing and Spark runs in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graph-{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """df written as the table `name`, dealt and sorted by a column: joins by it don't shuffle it. The caller drops the table."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).format("parquet").option("path", shared_dir(spark)).saveAsTable(name)
    return spark.table(name)
