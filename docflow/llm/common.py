"""Helpers that the operators share: shared work folders, text batches, byte-table gathers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing a temporary folder stands in, but only for a local master (tests): elsewhere
    executors wouldn't see it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault("base", "file://" + tempfile.mkdtemp(prefix="docflow-"))
    return f"{base.rstrip('/')}/docflow-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() gave and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__.pop("written_to")).getParent()
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def own(names: Iterable[str]) -> list[Column]:
    """The columns of these names, which may have dots."""
    return [F.col(quoted(c)) for c in names]


def besides(columns: Iterable[str], *names: str) -> list[str]:
    """The columns but those of these names, in any case."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def free(columns: Iterable[str], *names: str) -> list[str]:
    """These names, each with as many underscores in front as it takes to differ from all columns in any case."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mapped(rows: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """mapInArrow for columns of any names, which it takes by their places."""
    names = [f"c{k}" for k in range(len(schema))]
    numbered = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema, strict=True)])
    plain = rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])
    return plain.mapInArrow(lambda batches: (b.rename_columns(names) for b in run(batches)), numbered).toDF(*schema.names)


def placed(rows: DataFrame, order: list[Column], part: str, row: str) -> DataFrame:
    """Rows sorted in ranges of the order, kept in the shared folder, with the range (part) and a number that grows by one
    from row to row of a range. Rows that tie are in any order, so that ranges may part them."""
    (spread,) = free([*rows.columns, part, row], "spread")
    dealt = rows.withColumn(spread, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order, F.col(spread)).sortWithinPartitions(*order, F.col(spread)).drop(spread)
    return written(dealt.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.shiftright(row, 33)), "ranges")


def slices(batches, text: int, rows: int = 1024, limit: int = 8 << 20):
    """Record batches cut so that each has at most `rows` rows and about `limit` bytes of column `text`."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        done, total = 0, np.cumsum(size)
        while done < batch.num_rows:
            before = total[done - 1] if done else 0
            end = int(np.searchsorted(total, before + limit, side="right"))
            end = min(max(end, done + 1), done + rows, batch.num_rows)
            yield batch.slice(done, end - done)
            done = end


class WordCache:
    """Values by word, about `most` of them. A generation takes up all words asked for; when it has half of that, a new
    one starts and the one before goes, so that words in use stay. Values must not be None."""

    def __init__(self, most: int):
        self.half, self.new, self.old = max(1, most // 2), {}, {}

    def known(self, words: set, make: Callable[[list], Iterable]) -> dict:
        """A table that has the values of these words; those of new ones come from `make`."""
        fresh = words - self.new.keys()
        if fresh and self.new and len(self.new) + len(fresh) > self.half:
            self.old, self.new, fresh = self.new, {}, words
        if fresh and self.old:
            self.new.update((w, v) for w in fresh if (v := self.old.get(w)) is not None)
            fresh = fresh - self.new.keys()
        if fresh:
            some = list(fresh)
            self.new.update(zip(some, make(some), strict=True))
        return self.new

    def values(self, words: list, make: Callable[[list], Iterable]) -> list:
        """The values of words."""
        return list(map(self.known(set(words), make).__getitem__, words))


class ByteTable:
    """Byte strings by number, joined for whole arrays of numbers without a Python loop."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items) + b"\0", np.uint8)
        self.size = np.array([len(x) for x in items] + [0], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def join(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        total = int(size.sum())
        if not total:
            return b""
        shift = self.start[ids] - (np.cumsum(size) - size)
        at = np.repeat(shift, size)
        at += np.arange(total)
        return self.data[at].tobytes()
