"""Tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is used in local mode only; on a
    cluster a machine-local folder would be lost with its machine, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strataloom-{spark.sparkContext.applicationId}"


def shared_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, outlives executors.

    The size of the reread files is known to Spark, so its own broadcast threshold
    checks the real size of a side.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`shared_table`, and the files of the shuffles that it took go when it is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return shared_table(spark, df, name)
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def free(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes shared tables from which everything was made already."""
    for df in tables:
        files = df.inputFiles()
        if files:
            remove(spark, files[0].rpartition("/")[0])


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one; a path without a scheme is a mounted one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder if ":/" in folder else f"file://{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Deletes what this application has in the shared folder; call it when all results are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(conf).delete(path, True)


def posix(path: str) -> str:
    """The mounted path of a shared folder; memory-mapped files need one."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: memory-mapped models need a shared folder that is mounted as a file system")
    return path.removeprefix("file://").replace("file:", "", 1) if path.startswith("file:") else path


def whole(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of batches sorted by some columns, none of which ends within a group."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            same = all(held[-1].column(n)[-1] == batch.column(n)[0] and batch.column(n)[0] == batch.column(n)[-1] for n in by)
            if same:
                held.append(t)
                continue
            t = pa.concat_tables([*held, t]).combine_chunks()
        k = [t.column(n).to_numpy() for n in by]
        cut = np.flatnonzero(~np.logical_and.reduce([x == x[-1] for x in k]))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        held = [t.slice(cut)]
        if cut:
            yield t.slice(0, cut)
    if held is not None:
        yield pa.concat_tables(held).combine_chunks()
