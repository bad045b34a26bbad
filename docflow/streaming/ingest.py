"""Incremental runs: new files as a stream, results put into a keyed table batch by batch.

The stream's checkpoint remembers files, the table the keys and the last batch of each stream; together a broken run is
taken up without doing work twice. What a batch writes follows the batch, not the table (see sources.buckets).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docflow.schemas import KEYS
from docflow.sources.buckets import Buckets
from docflow.sources.manifest import only_images


def sink(folder: str, work: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, only_new: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: does the batch's items and puts the results in; with only_new, those that the table lacks."""
    keys = keys or KEYS

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = Buckets(spark, folder, keys)
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        table.put(work(table.lacking(batch) if only_new else batch), stream=stream, batch=number)
        table.vacuum()

    return step


def ingest(items: DataFrame, folder: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, only_new: bool = True) -> None:
    """Runs over all that a streaming table of items has now, then ends."""
    query = items.writeStream.foreachBatch(sink(folder, work, keys, only_new)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def image_stream(spark: SparkSession, root: str) -> DataFrame:
    """Image files below a folder as a stream: (file_id, file_name, content)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    return only_images(files.selectExpr("path as file_id", "regexp_extract(path, '([^/]*)/[^/]*$', 1) as folder_name", "regexp_extract(path, '([^/]*)$', 1) as file_name", "content"))
