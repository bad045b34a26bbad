"""A keyed Parquet table that is changed batch by batch without being rewritten.

Rows lie in buckets of their keys' hash. A batch writes a run of its rows for each bucket that it touches; of runs with
the same key the newest one counts. Runs of a bucket shrink from the oldest to the newest: as soon as later runs
together are as large as an earlier one, these are merged into one, by the commit that makes them so. So a bucket has
a logarithm of runs, and a row is rewritten a logarithm of times: what is written follows the batches.

    FOLDER/data/COMMIT/__bucket=K/part-*.parquet     files of a commit, which never change
    FOLDER/generations/N.json                        the manifest: the runs of each bucket at generation N

A commit is the renaming of one manifest to a name that must not be there. A writer that is killed before leaves files
that no manifest names, and the generation before stays what it was; of two writers one fails and may try again. The
manifest also has the last batch of each stream, so that a batch that is repeated changes nothing. It has an entry for
each run, whose number is bounded by the buckets, not by the rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from docflow.schemas import KEYS
from docflow.sources.work import place

BUCKET, GENERATION = "__bucket", "__generation"


class Conflict(RuntimeError):
    """Another writer has made this generation."""


def last_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes last; rows are thinned out before they are sent."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


@dataclass
class Buckets:
    """The table below a folder; keys and the number of buckets are those of the first commit."""

    spark: SparkSession
    folder: str
    keys: list[str] = field(default_factory=lambda: list(KEYS))
    buckets: int = 64

    # --- manifests ----------------------------------------------------------------------------------------

    def generations(self) -> list[int]:
        """The numbers of the manifests that are there, in order."""
        path, system = place(self.spark, f"{self.folder}/generations")
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, generation: int | None = None) -> dict:
        """The manifest of a generation, or the newest one; before the first commit it has number -1."""
        found = self.generations()
        if generation is None and not found:
            return {"number": -1, "keys": self.keys, "buckets": self.buckets, "runs": {}, "streams": {}, "rows": 0}
        number = found[-1] if generation is None else generation
        path, system = place(self.spark, f"{self.folder}/generations/{number}.json")
        stream = system.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": number}
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        """Makes the manifest the next generation, or fails."""
        number, jvm = manifest["number"] + 1, self.spark._jvm
        draft, system = place(self.spark, f"{self.folder}/generations/.{number}-{uuid.uuid4().hex}")
        final, _ = place(self.spark, f"{self.folder}/generations/{number}.json")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}).encode()))
        out.close()
        how = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = jvm.java.lang.reflect.Array.newInstance(how, 1)
        options[0] = how.getEnumConstants()[0]
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Py4JJavaError as e:
            system.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"generation {number} of {self.folder} is there already") from e
            raise
        return number

    # --- reading ------------------------------------------------------------------------------------------

    def _read(self, manifest: dict, runs: list[tuple[str, list]]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"]).add(GENERATION, LongType())
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{r['commit']}/{BUCKET}={b}" for b, some in runs for r in some])

    def _newest(self, manifest: dict, runs: list[tuple[str, list]]) -> DataFrame:
        """Of each key in these runs the newest row."""
        return last_rows(self._read(manifest, runs), manifest["keys"], [F.col(GENERATION)]).drop(GENERATION)

    def rows(self, schema: str | None = None, generation: int | None = None, touched: list[int] | None = None) -> DataFrame:
        """All rows of a generation, or those in some buckets. Buckets of one run are read as they are, without a shuffle.

        schema: that of a table without a commit.
        """
        manifest = self.manifest(generation)
        if "schema" not in manifest:
            return self.spark.createDataFrame([], schema or ", ".join(f"`{k}` string" for k in self.keys))
        runs = [(b, some) for b, some in manifest["runs"].items() if touched is None or int(b) in touched]
        one, several = [x for x in runs if len(x[1]) == 1], [x for x in runs if len(x[1]) > 1]
        parts = [self._read(manifest, one).drop(GENERATION)] if one else []
        parts += [self._newest(manifest, several)] if several else []
        if not parts:
            return self.spark.createDataFrame([], StructType.fromJson(manifest["schema"]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def count(self) -> int:
        """How many rows there are; known without a job as long as all batches had new keys only."""
        known = self.manifest()["rows"]
        return self.rows().count() if known is None else known

    def bucket(self, keys: list[str] | None = None, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys or self.keys]), F.lit(buckets or self.buckets)).cast("int")

    def lacking(self, rows: DataFrame) -> DataFrame:
        """The rows whose key isn't in the table. Only buckets that these rows fall into are read."""
        manifest = self.manifest()
        keys = manifest["keys"]
        if "schema" not in manifest:
            return rows
        touched = [r[0] for r in rows.select(self.bucket(keys, manifest["buckets"])).distinct().collect()]
        have = self.rows(touched=touched).select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)])
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
        on = same[0]
        for s in same[1:]:
            on = on & s
        return rows.join(have, on, "left_anti")

    # --- writing ------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, manifest: dict, commit: str) -> dict[str, int]:
        """Writes runs, and gives the bytes of each bucket."""
        number = F.lit(manifest["number"] + 1).cast("long")
        dealt = rows.withColumn(BUCKET, self.bucket(manifest["keys"], manifest["buckets"])).withColumn(GENERATION, number)
        dealt.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{commit}")
        path, system = place(self.spark, f"{self.folder}/data/{commit}")
        made = [s.getPath() for s in system.listStatus(path) if s.isDirectory()]
        return {p.getName().partition("=")[2]: system.getContentSummary(p).getLength() for p in made}

    def put(self, rows: DataFrame, order: list[str] | None = None, stream: str | None = None, batch: int | None = None, new: bool = False) -> int:
        """Commits rows, and gives the generation: they replace rows of their keys, and of rows of one key in the batch the
        last in order counts (by default by their other columns).

        A batch of a stream that is not beyond the stream's last one is left out. new: no key of the rows is in the
        table, so that their number is known.
        """
        manifest = self.manifest()
        if stream is not None and manifest["streams"].get(stream, -1) >= batch:
            return manifest["number"]
        keys, columns = manifest["keys"], [c for c in rows.columns if c not in (BUCKET, GENERATION)]
        if "schema" in manifest and {f["name"] for f in manifest["schema"]["fields"]} != set(columns) or len(columns) < len(rows.columns):
            raise ValueError(f"the table has other columns than {rows.columns}")
        order = [c for c in columns if c not in keys] if order is None else order
        manifest.setdefault("schema", json.loads(rows.schema.json()))
        seen, commit = Observation(), f"{manifest['number'] + 1}-{uuid.uuid4().hex}"
        last = last_rows(rows, keys, [F.col(f"`{c}`") for c in order] or [F.lit(0)]).select(*[f["name"] for f in manifest["schema"]["fields"]])
        for b, size in self._write(last.observe(seen, F.count("*").alias("n")), manifest, commit).items():
            manifest["runs"].setdefault(b, []).append({"commit": commit, "bytes": size})
        due = {b: i for b, runs in manifest["runs"].items() if (i := first_due([r["bytes"] for r in runs])) is not None}
        manifest["written"] = [commit] + [commit + "-merged"] * bool(due)
        if due:
            sizes = self._write(self._newest(manifest, [(b, manifest["runs"][b][i:]) for b, i in due.items()]), manifest, commit + "-merged")
            for b, i in due.items():
                manifest["runs"][b][i:] = [{"commit": commit + "-merged", "bytes": sizes[b]}]
        if stream is not None:
            manifest["streams"][stream] = batch
        manifest["rows"] = manifest["rows"] + seen.get["n"] if manifest["rows"] is not None and (new or manifest["number"] < 0) else None
        return self._commit(manifest)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all manifests but the newest ones, and the commits that only deleted ones name. Files of writers that were
        killed stay, as they can't be told from those of writers at work; a table without writers may delete any commit
        that no manifest names."""
        numbers = self.generations()
        manifests = {n: self.manifest(n) for n in numbers}
        named = lambda n: {r["commit"] for runs in manifests[n]["runs"].values() for r in runs}
        held = set().union(*map(named, numbers[-keep:])) if numbers else set()
        for n in numbers[:-keep]:
            for commit in named(n).union(manifests[n]["written"]) - held:
                path, system = place(self.spark, f"{self.folder}/data/{commit}")
                system.delete(path, True)
            path, system = place(self.spark, f"{self.folder}/generations/{n}.json")
            system.delete(path, False)


def first_due(sizes: list[int]) -> int | None:
    """The first of a bucket's runs that those after it together are as large as; it and they are merged."""
    later = sum(sizes)
    for k, size in enumerate(sizes[:-1]):
        later -= size
        if later >= size:
            return k
    return None
