"""Scans of document images and the manifest of what is left to do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, EXTENSIONS, Settings
from docflow.functions.text import extension
from docflow.schemas import KEYS
from docflow.sources.stores import last_wins


#: Characters that the file source takes for patterns.
GLOB = re.compile(r"[\\\[\]{}*?]")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """The images below a folder: (folder_id, folder_name, file_id, file_name, content).

    content is read only where a plan uses it: select it after everything that drops rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    named = files.select(parent.alias("folder_id"), F.regexp_extract(parent, r"([^/]*)$", 1).alias("folder_name"), F.col("path").alias("file_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "content")
    return only_images(named)


def listed(spark: SparkSession, settings: Settings = DEFAULTS, **options: str) -> DataFrame:
    """A manifest from the source that the settings name: 'binaryFile' below option root, or any registered format."""
    if settings.data_source == "binaryFile":
        return image_files(spark, options["root"]).drop("content")
    return spark.read.format(settings.data_source).options(**options).load()


def only_images(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Rows whose extension, in any case, is that of an image."""
    return files.where(extension(F.col(name)).isin(*EXTENSIONS))


def union_keys(*stores: DataFrame) -> DataFrame:
    """The distinct keys of several stores."""
    found = stores[0].select(*KEYS)
    for s in stores[1:]:
        found = found.unionByName(s.select(*KEYS))
    return found.distinct()


def without(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items whose key isn't done. Put this before any Python stage: filters don't move below one."""
    return items.join(done.select(*KEYS), KEYS, "left_anti")


def manifest(items: DataFrame, done: DataFrame, settings: Settings = DEFAULTS, order: str = "scan_pos") -> DataFrame:
    """The next items to do: of the first max_raw_scan images those not done, the first fetch_limit. None lifts a cap.

    An item is its key: of several files of one folder and name the last one in order is the item, as results are kept
    by key. Both caps are a top-k by partition and a merge, not a sort of all items.
    """
    seen = items if settings.max_raw_scan is None else items.orderBy(order).limit(settings.max_raw_scan)
    left = without(last_wins(seen, KEYS, [order]), done)
    return left if settings.fetch_limit is None else left.orderBy(order).limit(settings.fetch_limit)


def with_content(items: DataFrame) -> DataFrame:
    """Adds content and error to items whose file_id is a path; a file that can't be read has the error.

    The paths go through the driver, which lists them for the file source: give it a batch, not a whole folder. Only these
    files are read, as a source that lists a folder reads all that is in it before a join drops any.
    """
    spark = items.sparkSession
    names = [r.file_id for r in items.select("file_id").collect()]
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    files = reader.load([GLOB.sub(r"\\\g<0>", n) for n in names]).select(F.col("path").alias("file_id"), "content") if names else spark.createDataFrame([], "file_id string, content binary")
    return items.join(files, "file_id", "left").withColumn("error", F.when(F.col("content").isNull(), "the file can't be read"))
