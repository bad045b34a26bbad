"""The keyed table: batches against a dictionary, bytes written, killed and repeated commits."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docflow.sources import buckets
from docflow.sources.buckets import Buckets, Conflict, first_due

SCHEMA = "folder_name string, file_name string, n int"


def size(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_batches_against_a_dictionary(spark, tmp_path):
    table, expected, r = Buckets(spark, f"file://{tmp_path}/t", buckets=5), {}, random.Random(3)
    assert table.rows(SCHEMA).collect() == [] and table.count() == 0
    for k in range(7):
        rows = [(r.choice(["a", "b/c", None]), str(r.randrange(25)), r.randrange(1000)) for _ in range(r.randrange(1, 25))]
        assert table.put(spark.createDataFrame(rows, SCHEMA)) == k
        for f, n, v in sorted(rows, key=lambda x: x[2]):
            expected[f, n] = v
        got = [tuple(x) for x in table.rows().collect()]
        assert len(got) == len(expected) == table.count() and {x[:2]: x[2] for x in got} == expected
    asked = spark.createDataFrame([(None, "3"), ("a", "x"), ("b/c", "7")], "folder_name string, file_name string")
    assert {tuple(x) for x in table.lacking(asked).collect()} == {x for x in [(None, "3"), ("a", "x"), ("b/c", "7")] if x not in expected}
    old = {x[:2]: x[2] for x in map(tuple, table.rows(generation=0).collect())}
    assert 0 < len(old) <= 25
    table.vacuum()
    assert table.generations() == [5, 6] and {tuple(x)[:2]: x[2] for x in table.rows().collect()} == expected
    named = {x["commit"] for n in (5, 6) for some in table.manifest(n)["runs"].values() for x in some}
    there = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    assert named <= there <= named | {c for n in (5, 6) for c in table.manifest(n)["written"]}


def test_bytes_follow_the_batch(spark, tmp_path):
    table = Buckets(spark, f"file://{tmp_path}/t", ["id"], 32)
    table.put(spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")), new=True)
    whole = size(tmp_path)
    for k in range(4):
        before = size(tmp_path)
        table.put(spark.range(3).select((F.col("id") * 7 + k).alias("id"), F.lit("new").alias("v")))
        assert size(tmp_path) - before < whole / 50
    assert table.rows().where("v = 'new'").count() == len({i * 7 + k for i in range(3) for k in range(4)})
    assert table.rows().count() == 40_000


def test_killed_and_repeated_commits(spark, tmp_path, monkeypatch):
    table = Buckets(spark, f"file://{tmp_path}/t", buckets=4)
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    table.put(rows(("f", "1", 1), ("f", "2", 2)), stream="s", batch=0)

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Buckets, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.put(rows(("f", "1", 9)), stream="s", batch=1)
    assert sorted(x.n for x in table.rows().collect()) == [1, 2] and table.generations() == [0]
    assert table.put(rows(("f", "1", 5)), stream="s", batch=1) == 1
    assert table.put(rows(("f", "1", 7)), stream="s", batch=1) == 1
    assert sorted(x.n for x in table.rows().collect()) == [2, 5]
    stale = table.manifest(0)
    with pytest.raises(Conflict):
        table._commit(stale)
    assert json.loads((tmp_path / "t" / "generations" / "1.json").read_text())["streams"] == {"s": 1}
    with pytest.raises(ValueError, match="other columns"):
        table.put(rows(("f", "1", 1)).withColumn("more", F.lit(1)))


def test_runs_shrink():
    assert first_due([10, 4, 2, 1]) is None and first_due([10, 4, 2, 2]) == 1 and first_due([7, 4, 2, 1]) == 0 and first_due([5]) is None
    runs, written, r = [], 0, random.Random(1)
    for _ in range(2000):
        runs.append(r.randrange(1, 20))
        written += runs[-1]
        if (k := first_due(runs)) is not None:
            runs[k:] = [sum(runs[k:])]
            written += runs[-1]
    assert len(runs) <= 16 and written <= 16 * sum(runs)
    assert buckets.BUCKET == "__bucket"
