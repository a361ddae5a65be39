"""Documents that arrive over time: each file is processed once, in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.completion import Backend
from ..operators.retrieval import Embedder
from ..plans.documents import extract_documents
from ..sources.files import LOADERS, blocks_of_files, with_suffix


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """``doc_id, suffix, content`` of files that appear below a path, as a stream; an unknown suffix is an error."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return with_suffix(files, LOADERS)


def process_arrivals(files: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Runs ``process(blocks, batch number)`` over the blocks of each batch of files.

    The checkpoint folder records what was read. A batch whose processing fails is run again with the
    same number, so ``process`` should write to a place of that number. ``once``: stops after what is
    there now.
    """

    def run(batch: DataFrame, number: int) -> None:
        process(blocks_of_files(batch), number)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def extract_arrivals(spark: SparkSession, path: str, out: str, checkpoint: str, backend: Backend, embedder: Embedder | None = None, cache: str | None = None, once: bool = False) -> StreamingQuery:
    """Writes the exported results of arriving documents below ``out/batch=N``; a repeated batch replaces its own folder."""

    def process(blocks: DataFrame, number: int) -> None:
        results = extract_documents(blocks, backend, embedder, cache=cache)
        results.withColumn("arrived", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return process_arrivals(arriving_files(spark, path), checkpoint, process, once)
