"""Tables in the folder that driver and executors share; they cut a job's lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if Spark runs on this machine alone, and an error if not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def gone_at_end(spark: SparkSession, path: str) -> None:
    """Lets a path that exists be removed when the application ends."""
    where, system = _located(spark, path)
    if not system.deleteOnExit(where):
        raise FileNotFoundError(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nothing reads any more."""
    for path in paths:
        where, system = _located(spark, path)
        system.delete(where, True)


def new_path(spark: SparkSession) -> str:
    """A path in a new folder of the shared one; the folder is removed when the application ends."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    where, system = _located(spark, folder)
    system.mkdirs(where)
    gone_at_end(spark, folder)
    return f"{folder}/table"


def keep_at(df: DataFrame, path: str | None = None, *partition_by: str) -> tuple[DataFrame, str]:
    """The table, written (at a new path if none is given) and read back, and its path; new paths go when the application ends."""
    path = path or new_path(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def keep(df: DataFrame) -> DataFrame:
    return keep_at(df)[0]
