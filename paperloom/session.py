"""Sessions and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "paperloom", partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one that spark-submit makes."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PAPERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of a batch that goes to Python, at most. They hold whole texts: more fill a worker and the buffers beside the heap.
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to ``BATCH_ROWS``, unless fewer are set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; the path may be in any store that Spark reads. Bounds the session's Arrow batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
