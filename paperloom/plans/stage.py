"""Written intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import bound_batches


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that setting is absent and the master is local, a temporary folder is made and removed
    at exit. On a cluster a missing setting is an error: executors don't share local folders.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_paperloom_root", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="paperloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    root = f"file://{made}"
    spark.sparkContext._paperloom_root = root
    spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/stage-{uuid.uuid4().hex}-{tag}"


def staged(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back with its schema; and the path."""
    bound_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``staged`` for tables that stay until the driver's JVM ends."""
    return staged(df, tag)[0]


def _located(spark: SparkSession, path: str):
    """Hadoop's path and its file system, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _located(spark, path)
    return files.exists(where)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has a written path deleted when the driver's JVM ends: results that read it live until then."""
    where, files = _located(spark, path)
    files.deleteOnExit(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path."""
    where, files = _located(spark, path)
    files.delete(where, True)
