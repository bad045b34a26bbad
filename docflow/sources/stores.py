"""Result stores: nested JSON {folder: {file: value}} at the border, long tables inside."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.schemas import DECISION, KEYS, LINES


def from_nested(document: Column, value: str) -> Column:
    """The map of maps in a JSON text; null where the text isn't one."""
    return F.from_json(document, f"map<string, map<string, {value}>>")


def long_form(documents: DataFrame, column: str, value: str, into: str) -> DataFrame:
    """(folder_name, file_name, value) of all nested JSON texts of a column; malformed ones give no rows."""
    folders = documents.select(F.explode(from_nested(F.col(column), value)).alias("folder_name", "files"))
    return folders.select("folder_name", F.explode("files").alias("file_name", into))


def read_store(spark: SparkSession, path: str, value: str = LINES, into: str = "lines", by_line: bool = False) -> DataFrame:
    """A nested JSON file, or one JSON text a line, as a long table; a missing or malformed file is an empty store.

    A folder that one text names twice has the files of both.
    """
    try:
        text = spark.read.text(path, wholetext=not by_line)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = spark.createDataFrame([], "value string")
    return long_form(text, "value", value, into)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The cache of page decisions as a long table."""
    return read_store(spark, path, DECISION, "decision")


def nested(rows: DataFrame, value: str = "lines") -> DataFrame:
    """One row by folder: (folder_name, files), files a map by file name. Keys must be unique."""
    files = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("file_name"), F.col(value)))))
    return rows.groupBy("folder_name").agg(files.alias("files"))


def write_store(rows: DataFrame, path: str, value: str = "lines") -> None:
    """JSON lines {folder: {file: value}}, a folder a line; the write commits whole or not at all. Read it by line."""
    text = F.to_json(F.map_from_arrays(F.array("folder_name"), F.array("files")))
    nested(rows, value).select(text.alias("value")).write.mode("overwrite").text(path)


def write_document(rows: DataFrame, path: str, value: str = "lines") -> None:
    """One JSON text for all folders, as tools that load the whole store want it; so it is made by one task."""
    every = F.map_from_entries(F.sort_array(F.collect_list(F.struct("folder_name", F.to_json("files")))))
    folders = nested(rows, value).agg(every.alias("m")).select(F.transform(F.map_entries("m"), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))), F.lit(" "), e["value"])).alias("e"))
    body = F.array_join(F.transform("e", lambda x: F.regexp_replace(x, r'^\{"k":("(?:[^"\\]|\\.)*")\} ', "$1:")), ",")
    folders.select(F.concat(F.lit("{"), body, F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that comes last in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The old store with the new rows put in; a new row of a key replaces the old one, the last new one counts."""
    keys, order = keys or KEYS, order or []
    columns = [c for c in old.columns if c not in order] + order
    stacked = old.select(*columns, F.lit(0).alias("__age")).unionByName(new.select(*columns, F.lit(1).alias("__age")))
    return last_wins(stacked, keys, ["__age", *order]).drop("__age")


def report(printed: DataFrame, handwritten: DataFrame, refine=lambda rows: rows) -> DataFrame:
    """One row an image: its kind, number of lines, and lines joined by line breaks. refine may rework the rows."""
    both = printed.select(*KEYS, "lines", F.lit("printed").alias("kind")).unionByName(handwritten.select(*KEYS, "lines", F.lit("handwritten").alias("kind")))
    return refine(both).select(*KEYS, "kind", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("content"))


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def counters(rows: DataFrame) -> DataFrame:
    """Images stored, and of these printed and handwritten ones."""
    return rows.agg(F.count("*").alias("images"), F.count_if(F.col("kind") == "printed").alias("printed"), F.count_if(F.col("kind") == "handwritten").alias("handwritten"))
