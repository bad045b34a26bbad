"""A Merkle manifest of a dataset, in a node store on disk that is written and read level by level.

Rows are hashed where they are read; only hashes go on. Leaves are sorted in ranges and numbered within their tree
(a source's rows), and written as level 0 of a Parquet store that is parted by level. A pass reads one level in order of
coordinates (tree, place), by blocks of 729 consecutive nodes (3 ** LEVELS), and streams the next six levels out; the last of these is what the next pass reads. So memory is a block, a large tree is many blocks, and there are as many passes as
the number of a tree's leaves has powers of 729. The trees' roots are the leaves of one more tree.

Proofs are read from the top down by merging sorted scans: a block's nodes at all its levels and the path above its
root, in order of coordinates, give the path of each node at the block's lowest level. A path has a step for each level:
the hashes of the node's run to its left and to its right.

Defined results: a null field is hashed as such and not as an empty one; rows of a null source are a tree of their own,
the first. Rows of one source and key are ordered by their hashes; repeated rows are leaves of their own, of one hash.
An empty table has no root and gives no rows. Columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docflow.llm.common import forget, own, placed, quoted, shared_dir, written

#: Nodes of a run, and levels that a pass goes up.
FAN, LEVELS = 3, 6
#: Rows of an Arrow batch that a pass gives out.
BATCH = 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, pos long, n long, hash string, level int"
PATH = "tree string, pos long, path string, root string"
NODE_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("hash", pa.string()), ("level", pa.int32())])
PATH_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.string()), ("root", pa.string())])
#: Ends of the left side and of the step, in a path kept as text.
SIDE_END, STEP_END = ",", ";"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: of each field its size in bytes, a colon and its value, or a hyphen if it is null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds pos, the place from 0 within its tree, and n, the tree's rows. A tree may lie in many ranges of the sort; what
    is joined is a row for each tree and range."""
    ranges = placed(rows, [F.col(tree), *own(order)], "__part", "__row")
    found = ranges.groupBy(tree, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    of_tree = Window.partitionBy(tree)
    before = F.coalesce(F.sum("__n").over(of_tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = found.select(tree, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(of_tree).alias("n"))
    joined = ranges.join(written(starts, "starts"), [tree, "__part"])
    return joined.withColumn("pos", F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def in_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a block in one task, in order of coordinates, what stands above first: tree, block and the columns."""
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "pos")
    return dealt.select("tree", "block", *columns)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), its rows), one block at a time."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for key, some in groupby(rows, key=lambda r: r[:2]):
        yield key, [r[2:] for r in some]


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _nodes_above(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """The levels above a block's nodes, until the tree has one node."""

    def rows():
        for (tree, block), found in blocks(batches):
            (level, _, n, _), hashes, first = found[0], [r[3] for r in found], block * FAN**levels
            for _ in range(levels):
                if n == 1:
                    break
                hashes = [digest("".join(hashes[k : k + FAN])) for k in range(0, len(hashes), FAN)]
                n, first, level = -(-n // FAN), first // FAN, level + 1
                yield from ((tree, first + k, n, h, level) for k, h in enumerate(hashes))

    return batched(rows(), NODE_ARROW)


def sides(hashes: list[str]) -> list[str]:
    """The step of each node of consecutive runs: the hashes to its left, and to its right."""
    runs = (hashes[k : k + FAN] for k in range(0, len(hashes), FAN))
    return ["".join(run[:i]) + SIDE_END + "".join(run[i + 1 :]) + STEP_END for run in runs for i in range(len(run))]


def _with_paths(batches: Iterator[pa.RecordBatch], low: int) -> Iterator[tuple]:
    """(tree, path, hash of the tree's root, place, hash, payload) of the nodes at the lowest level of blocks."""
    for (tree, _), found in blocks(batches):
        above, root = found[0][4:6]
        levels: dict[int, list[str]] = {}
        for level, _, n, hash_, *_ in found[1:]:
            if n > 1:
                levels.setdefault(level, []).append(hash_)
        paths = [above]
        for level in sorted(levels, reverse=True):
            paths = [step + paths[k // FAN] for k, step in enumerate(sides(levels[level]))]
        lowest = (r for r in found[1:] if r[0] == low)
        yield from ((tree, path, root, r[1], r[3], r[6:]) for path, r in zip(paths, lowest, strict=True))


def folded(hash_: str, path: str) -> str:
    """The root that a leaf and a path lead to."""
    for step in path.split(STEP_END)[:-1]:
        left, right = step.split(SIDE_END)
        hash_ = digest(left + hash_ + right)
    return hash_


def leads_to(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path (array of left, right) lead to, as a column."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


@dataclass
class Store:
    """Levels of trees below a folder, which a pass goes up by so many. leaves: tree, pos, n, hash and further columns."""

    spark: SparkSession
    folder: str
    levels: int
    passes: int
    leaves: DataFrame

    def nodes(self) -> DataFrame:
        """All nodes above the leaves: tree, pos, n (nodes of that tree and level), hash, level."""
        return self.spark.read.schema(NODE).parquet(f"{self.folder}/nodes")

    def roots(self) -> DataFrame:
        """(tree, hash, level) of the node that remains of each tree."""
        lone = self.leaves.where("n = 1").select("tree", "hash", F.lit(0).alias("level"))
        return lone.unionByName(self.nodes().where("n = 1").select("tree", "hash", "level"))

    def paths(self, above: DataFrame, finish: Callable[[Iterator[tuple]], Iterator[tuple]], schema: StructType, payload: list[str]) -> DataFrame:
        """Rows that finish makes of (tree, path, root's hash, place, hash, payload) of all leaves.

        above: tree, level of its root, path and hash (root) of that root in what stands above it.
        """
        found = None
        for k in reversed(range(self.passes)):
            low, top = k * self.levels, (k + 1) * self.levels
            heads = above.where(F.col("level").between(low + 1 if k else 0, top)).select("tree", F.lit(0).cast("long").alias("block"), "path", "root")
            heads = heads if found is None else heads.unionByName(found.select("tree", F.col("pos").alias("block"), "path", "root"))
            heads = heads.select("tree", "block", F.lit(top).alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit("").alias("hash"), "path", "root")
            nodes = self.nodes().where(F.col("level").between(max(1, low), top - 1) & (F.col("n") > 1))
            if not k:
                nodes = nodes.unionByName(self.leaves.withColumn("level", F.lit(0)), allowMissingColumns=True)
            width = F.element_at(F.array(*[F.lit(FAN ** (top - x)) for x in range(low, top)]), F.col("level") - low + 1)
            nodes = nodes.withColumn("block", F.floor(F.col("pos") / width))
            dealt = in_blocks(nodes.unionByName(heads, allowMissingColumns=True), ["level", "pos", "n", "hash", "path", "root", *(payload if not k else [])])
            if not k:
                break
            onward = lambda batches, low=low: batched(((t, at, path, root) for t, path, root, at, _, _ in _with_paths(batches, low)), PATH_ARROW)
            found = written(dealt.mapInArrow(onward, PATH), f"paths-{k}")
        arrow = to_arrow_schema(schema)
        return dealt.mapInArrow(lambda batches: batched(finish(_with_paths(batches, 0)), arrow), schema)


def built(leaves: DataFrame, folder: str, levels: int = LEVELS) -> Store:
    """Writes the levels of all trees, from leaves (tree, pos, n, hash and further columns)."""
    spark = leaves.sparkSession
    leaves.write.parquet(f"{folder}/leaves")
    leaves = spark.read.schema(leaves.schema).parquet(f"{folder}/leaves")
    most, passes, level = leaves.agg(F.max("n").alias("n")).first().n or 0, 0, leaves.withColumn("level", F.lit(0))
    while not passes or most > 1:
        nodes = level.where("n > 1").withColumn("block", F.floor(F.col("pos") / FAN**levels))
        nodes = in_blocks(nodes, ["level", "pos", "n", "hash"]).mapInArrow(lambda batches: _nodes_above(batches, levels), NODE)
        nodes.withColumn("part_level", F.col("level")).write.mode("append").partitionBy("part_level").parquet(f"{folder}/nodes")
        most, passes = -(-most // FAN**levels), passes + 1
        level = spark.read.schema(NODE).parquet(f"{folder}/nodes").where(F.col("level") == passes * levels)
    return Store(spark, folder, levels, passes, leaves)


@dataclass
class Manifest:
    """The store of all sources' trees, the paths of their roots (tree, level, path, root) and the root of all."""

    store: Store
    above: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """Per row: tree, pos, hash, the path to the root of all (array of left, right)."""
        steps = self.store.paths(self.above, lambda rows: ((t, at, h, path) for t, path, _, at, h, _ in rows), StructType.fromDDL("tree string, pos long, hash string, path string"), [])
        step = lambda x: F.struct(F.substring_index(x, SIDE_END, 1).alias("left"), F.substring_index(x, SIDE_END, -1).alias("right"))
        return steps.withColumn("path", F.transform(F.filter(F.split("path", STEP_END), lambda x: x != ""), step))


def manifest(rows: DataFrame, hash_: Column, source: str, key: str, payload: dict[str, Column] | None = None, folder: str | None = None, levels: int = LEVELS) -> Manifest:
    """Writes the node store of a table: a tree of the rows' hashes for each source, in order of the key, and a tree of
    these. payload: further columns that stay with the leaves."""
    spark, payload = rows.sparkSession, payload or {}
    folder = folder or f"{shared_dir(spark)}/merkle"
    name = F.coalesce(F.concat(F.lit("="), F.col(quoted(source)).cast("string")), F.lit(""))
    narrow = written(rows.select(name.alias("tree"), F.col(quoted(key)).alias("key"), hash_.alias("hash"), *[c.alias(n) for n, c in payload.items()]), "hashes")
    store = built(numbered(narrow, "tree", ["key", "hash"]), f"{folder}/rows", levels)
    forget(narrow)
    tops = store.roots().select(F.lit("all").alias("tree"), F.col("tree").alias("source"), "hash", F.col("level").alias("of_level"))
    upper = built(numbered(tops, "tree", ["source"]), f"{folder}/sources", levels)
    root = next((r.hash for r in upper.roots().collect()), None)
    head = upper.roots().select("tree", "level", F.lit("").alias("path"), F.col("hash").alias("root"))
    each = lambda rows: ((source, level, path, h) for _, path, _, _, h, (source, level) in rows)
    above = upper.paths(head, each, StructType.fromDDL("tree string, level int, path string, root string"), ["source", "of_level"])
    return Manifest(store, written(above, "above"), root)


def report(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Per row: the key, its leaf, its source's root (subroot), the root, the SHA-256 of its proof's hashes, the root that
    its tampered row folds to (its own, where it isn't tampered with), and whether that is the root.

    Tampering takes the line breaks out of the text of rows whose key's CRC-32, as a decimal, is even.
    """
    fields = [F.col(quoted(c)) for c in columns]
    changed = [F.replace(f, F.lit("\n"), F.lit("")) if c == text else f for c, f in zip(columns, fields, strict=True)]
    name = F.col(quoted(key))
    even = F.crc32(name.cast("string").cast("binary")) % 2 == 0
    altered = F.when(even & F.contains(fields[columns.index(text)], F.lit("\n")), leaf(changed))
    made = manifest(docs, leaf(fields), source, key, {"altered": altered})
    root = made.root

    def finish(rows):
        for _, path, subroot, _, hash_, (k, other) in rows:
            end = folded(other or hash_, path)
            yield k, hash_, subroot, root, digest(path.replace(SIDE_END, "").replace(STEP_END, "")), end, end == root

    text_columns = [F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = docs.select(name.alias("key"), *text_columns, F.lit(True).alias("verified")).schema
    return made.store.paths(made.above, finish, schema, ["key", "altered"]).withColumnRenamed("key", key)
