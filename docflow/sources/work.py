"""Folders for intermediate files that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset a temporary one, but only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault("base", "file://" + tempfile.mkdtemp(prefix="docflow-"))
    return f"{base.rstrip('/')}/docflow-{uuid.uuid4().hex}"


def written(rows: DataFrame, seen: Observation | None = None, **counts: Column) -> DataFrame:
    """Writes rows to a new work folder and reads them again, so that what made them runs once. The writing job also
    gathers counts for seen."""
    path = f"{work_dir(rows.sparkSession)}/rows"
    (rows.observe(seen, *[c.alias(n) for n, c in counts.items()]) if seen else rows).write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() gave and that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table.__dict__.pop("written_to").rpartition("/")[0])


def place(spark: SparkSession, path: str):
    """The path as Hadoop has it, and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(found), system


def delete(spark: SparkSession, path: str) -> None:
    found, system = place(spark, path)
    system.delete(found, True)
