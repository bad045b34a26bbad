"""Shards as leaves of a k-d tree over document metadata, split at distributed weighted medians.

A node that shall become n shards is split along its widest dimension (its extent over that of all rows) into
parts for n // 2 and n - n // 2 shards, at the place where the bytes so far come nearest to that share. All nodes of a level
are split at once: a narrow table is sorted in ranges by node and by the node's dimension, running sums of bytes within
ranges and the sums of ranges before give the bytes before each row, and a row's place against its node's cut is its new
node. The node is a column, so work and plans don't grow with the tree; what is broadcast is a row for each node of the
level, or for each range and node. The driver sees none of these.

The number of shards is given, or follows from target bytes: as many as it takes for shards of that many on average. A part
never gets more shards than it has rows: shards that a single large row would span go back to the rest of its node.

Each dimension is one integer per row: its scaled coordinate, then bits of the text's hash, then bits of the
key's hash. The coordinate of a string is its rank among the distinct ones. So rows that are equal in a coordinate still have an order, and rows of equal texts stand side by
side in all orders. A split goes beside their group if that is at most as large as the largest row, else through
it (a group can be larger than a shard).

Defined results: null texts have 16 bytes, null metadata the lowest coordinate. Repeated rows are placed one by
one. An empty table gives no rows. Shards are empty only if there are fewer rows than shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from docflow.llm.common import forget, quoted, text_or_empty, written

OVERHEAD = 16
COORDINATE_BITS, TIE_BITS = 24, 38
#: Keys of one coordinate and one hash of the text.
GROUP = 1 << (TIE_BITS // 2)
#: Rows of a slot bucket, on average; the numbering of a shard is put together from its buckets.
BUCKET_ROWS = 20_000


def _ranks(rows: DataFrame, name: str) -> DataFrame:
    """(value, rank) of the distinct strings of a column, in byte order: places in sorted ranges, by ranges' counts.

    The driver sees a count for each range.
    """
    values = rows.select(F.col(name).alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value")
    placed = written(values.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "values")
    start, base = 0, []
    for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("id")).orderBy("part").collect():
        base.append((r.part, start - r.id))
        start += r.n
    shift = rows.sparkSession.createDataFrame(base, "part long, shift long")
    return placed.join(shift, "part").select("value", (F.col("id") + F.col("shift")).cast("double").alias("rank"))


def metadata(docs: DataFrame, dimensions: list[str], key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """A narrow table, kept in the shared folder: key, size, text_crc32 and an integer key by dimension.

    dimensions are columns of docs, or 'size' and 'text_crc32', which are made here.
    """
    body, kinds = text_or_empty(text), dict(docs.dtypes)
    made = {"size": (F.octet_length(body) + OVERHEAD).cast("long"), "text_crc32": F.crc32(body)}
    rows = docs.select(
        F.col(quoted(key)).alias("key"), *[c.alias(n) for n, c in made.items()],
        *[(made[d].cast("double") if d in made else F.coalesce(F.col(quoted(d)), F.lit("")) if kinds[d] == "string" else F.coalesce(F.col(quoted(d)).cast("double"), F.lit(0.0))).alias(f"__c{k}") for k, d in enumerate(dimensions)],
        F.xxhash64(body).alias("__text"), F.xxhash64(F.col(quoted(key)), F.lit(7)).alias("__row"),
    )
    rows = first = written(rows, "metadata")
    for k, d in enumerate(dimensions):
        if d not in made and kinds[d] == "string":
            ranks = _ranks(rows, f"__c{k}")
            rows = rows.join(ranks.withColumnRenamed("value", f"__c{k}"), f"__c{k}").withColumn(f"__c{k}", F.col("rank")).drop("rank")
    if rows is not first:
        rows = written(rows, "metadata")
        forget(first)
    ends = rows.agg(*[f(f"__c{k}").alias(f"{n}{k}") for k in range(len(dimensions)) for n, f in (("a", F.min), ("b", F.max))]).first()
    half = TIE_BITS // 2
    tie = F.shiftrightunsigned("__text", 64 - half) * (1 << half) + F.shiftrightunsigned("__row", 64 - half)
    keys = []
    for k in range(len(dimensions)):
        a, b = ends[f"a{k}"] or 0.0, ends[f"b{k}"] or 0.0
        scale = ((1 << COORDINATE_BITS) - 1) / (b - a) if b > a else 0.0
        keys.append((F.floor((F.col(f"__c{k}") - a) * scale).cast("long") * (1 << TIE_BITS) + tie).alias(f"k{k}"))
    names = [f"k{k}" for k in range(len(dimensions))]
    keyed = written(rows.select("key", "size", "text_crc32", *keys), "keys")
    forget(rows)
    return keyed, names


def _with_sums(rows: DataFrame) -> DataFrame:
    """Rows sorted in ranges of (first, v), with the range and the bytes before each row in its node and range."""
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("before", LongType())])
    first, size = rows.columns.index("first"), rows.columns.index("size")

    def run(batches):
        from pyspark import TaskContext

        part, node, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            nodes, sizes = b.column(first).to_numpy(), b.column(size).to_numpy()
            until = np.cumsum(sizes)
            start = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
            base = (until - sizes)[start]
            base[0] -= held if nodes[0] == node else 0
            before = until - sizes - np.repeat(base, np.diff(np.append(start, len(nodes))))
            node, held = nodes[-1], int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(nodes), part, np.int32)), pa.array(before)], names=schema.names)

    return rows.repartitionByRange("first", "v").sortWithinPartitions("first", "v").mapInArrow(run, schema)


def _level(rows: DataFrame, keys: list[str], whole: list[float], largest: int) -> DataFrame | None:
    """The rows of split nodes' parts, or None if no node is left to split.

    rows: key, size, text_crc32, keys, first (shard of the node), shards (of the node, at most its rows).
    """
    ends = [f(k).alias(n + k) for k in keys for n, f in (("a", F.min), ("b", F.max))]
    extents = F.array(*[(F.col("b" + k) - F.col("a" + k)) / F.lit(w) for k, w in zip(keys, whole, strict=True)])
    found = rows.where("shards > 1").groupBy("first", "shards").agg(F.sum("size").alias("total"), F.count("*").alias("n"), *ends)
    nodes = written(found.select("first", "total", "n", (F.array_position(extents, F.array_max(extents)) - 1).alias("d"), (F.col("total") * F.floor(F.col("shards") / 2) / F.col("shards")).alias("target")), "nodes")
    if nodes.isEmpty():
        forget(nodes)
        return None
    known = F.broadcast(nodes)
    v = F.element_at(F.array(*keys), (F.col("d") + 1).cast("int"))
    open_ = rows.join(known, "first").withColumn("v", v).select(*rows.columns, "v", "n", "total", "target")
    ranges = written(_with_sums(open_), "ranges")
    sums = ranges.groupBy("first", "part").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("first").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = written(sums.select("first", "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("shift")), "shifts")
    placed = ranges.join(F.broadcast(shift), ["first", "part"]).withColumn("before", F.col("before") + F.col("shift")).drop("shift")

    group, after = F.shiftright("v", TIE_BITS // 2), F.col("before") + F.col("size")
    median = placed.where((F.col("before") < F.col("target")) & (after >= F.col("target")))
    median = median.select("first", group.alias("group"), F.col("before").alias("row_start"), F.col("size").alias("row_size"), "n", "total", "target")
    same = placed.select("first", group.alias("group"), "before", "size").join(F.broadcast(median.select("first", "group")), ["first", "group"])
    same = same.groupBy("first").agg(F.min("before").alias("group_start"), F.sum("size").alias("group_size"), F.count("*").alias("members"))
    by_group = (F.col("group_size") <= largest) & (F.col("members") < F.col("n"))
    unit = median.join(same, "first").select("first", "total", "target", F.when(by_group, F.col("group_start")).otherwise(F.col("row_start")).alias("start"), F.when(by_group, F.col("group_size")).otherwise(F.col("row_size")).alias("size"))
    end = F.col("start") + F.col("size")
    low = (F.col("target") - F.col("start") > end - F.col("target")) & (end < F.col("total")) | (F.col("start") == 0)
    cuts = written(unit.select("first", F.when(low, end).otherwise(F.col("start")).alias("cut")), "cuts")

    sided = placed.join(F.broadcast(cuts), "first").withColumn("is_low", F.col("before") < F.col("cut"))
    counts = sided.groupBy("first", "shards").agg(F.count_if("is_low").alias("lows"), F.count_if(~F.col("is_low")).alias("highs"))
    half = counts.withColumn("low", F.least(F.floor(F.col("shards") / 2), "lows")).withColumn("high", F.least(F.col("shards") - F.col("low"), "highs"))
    parts = written(half.select("first", F.least(F.col("shards") - F.col("high"), "lows").cast("int").alias("low"), F.col("high").cast("int").alias("high")), "parts")
    split = sided.join(F.broadcast(parts), "first")
    first = F.col("first") + F.when(F.col("is_low"), 0).otherwise(F.col("low"))
    parted = split.select("key", "size", "text_crc32", *keys, first.cast("int").alias("first"), F.when(F.col("is_low"), F.col("low")).otherwise(F.col("high")).alias("shards"))
    onward = written(parted, "level")
    forget(nodes, ranges, shift, cuts, parts)
    return onward


def assign(docs: DataFrame, shards: int | None, dimensions: list[str], key: str = "doc_id", text: str = "text", target_bytes: int | None = None) -> DataFrame:
    """Per row: key, size, text_crc32, shard (from 0) and slot (gapless from 0 within the shard).

    Without a number of shards, there are as many as it takes for target_bytes on average.
    """
    rows, keys = metadata(docs, dimensions, key, text)
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), *[(F.max(k) - F.min(k)).cast("double").alias(k) for k in keys]).first()
    if shards is None:
        shards = max(1, -(-(total.bytes or 0) // target_bytes))
    whole = [max(1.0, total[k] or 0.0) for k in keys]
    columns = [F.lit(0).alias("first"), F.lit(max(1, min(shards, total.n))).alias("shards")]
    ended, level = [], rows.select("key", "size", "text_crc32", *keys, *columns)
    while level is not None:
        ended.append(level.where("shards = 1").select("key", "size", "text_crc32", F.col("first").alias("shard")))
        level = _level(level, keys, whole, total.largest or 0)
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    buckets = max(8, -(-total.n // (shards * BUCKET_ROWS)))
    placed = every.select("key", "size", "text_crc32", "shard", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(buckets)).alias("bucket"))
    count = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = count.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1).join(start, ["shard", "bucket"])
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
