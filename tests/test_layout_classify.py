"""Layout and classification against models written one row after the other."""

import random

from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Settings
from docflow.functions.text import strip
from docflow.operators import classify, layout


def plain_reading_order(boxes: list[tuple]) -> list[tuple]:
    """(ins, col, row) in reading order of (ins, box, score)."""
    merged: dict = {}
    for ins, box, score in boxes:
        key = tuple(round(v / 10) * 10 for v in box)
        if key not in merged:
            merged[key] = [ins, box, score]
        elif score > merged[key][2]:
            merged[key][1:] = [box, score]
    items = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, ins) for ins, b, _ in merged.values()]
    found, cols, last = [], [], None
    for it in sorted(items, key=lambda i: i[0]):
        if last is None or it[0] - last > 120:
            cols.append([])
        cols[-1].append(it)
        last = it[0]
    for c, col in enumerate(cols):
        groups: list[list] = []
        for it in sorted(col, key=lambda i: i[1]):
            if groups and abs(it[1] - groups[-1][0][1]) <= 15:
                groups[-1].append(it)
            else:
                groups.append([it])
        for r, g in enumerate(groups):
            found += [(it[2], c, r) for it in sorted(g, key=lambda i: i[0])]
    return found


def random_pages(seed: int, pages: int = 12) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for p in range(pages):
        for ins in range(r.randrange(1, 60)):
            x, y = r.randrange(0, 800, r.choice([1, 5, 120])), r.randrange(0, 200, r.choice([1, 5, 15]))
            rows.append((p, ins, [x, y, x + 50, y + 20], r.choice(["", "  ", "Pulse", "Puls", "x" * 30, "98 %"]), r.choice([0.3, 0.35, 0.5, 0.9])))
    return rows


def test_reading_order(spark):
    rows = random_pages(1)
    table = spark.createDataFrame(rows, "page long, ins long, box array<int>, text string, score double")
    got: dict = {}
    for r in layout.reading_order(layout.centred(layout.best_readings(table))).orderBy("page", "line_no").collect():
        got.setdefault(r.page, []).append((r.ins, r.col_id, r.row_id))
    for p in {x[0] for x in rows}:
        assert got[p] == plain_reading_order([(x[1], x[2], x[4]) for x in rows if x[0] == p])


def test_one_exchange_by_page(spark):
    table = spark.createDataFrame(random_pages(2), "page long, ins long, box array<int>, text string, score double")
    plan = layout.reading_order(layout.centred(layout.best_readings(table)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_boxes_of_a_task_do_not_grow(spark, monkeypatch):
    """Tasks follow the number of boxes, and Spark doesn't make fewer of them."""
    monkeypatch.setattr(layout.tasks_for, "__defaults__", (500,))
    for n in (2_000, 8_000):
        boxes = spark.range(n).select(F.floor(F.col("id") / 20).alias("page"), "id", F.lit(0.5).alias("score"), F.lit("").alias("text"))
        boxes = boxes.select("page", F.col("id").alias("ins"), F.array(*[(F.col("id") * k % 700).cast("int") for k in (3, 5, 7, 11)]).alias("box"), "text", "score")
        found = layout.reading_order(layout.centred(layout.best_readings(boxes)))
        most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 1_500


def test_finished_entries(spark):
    table = spark.createDataFrame(random_pages(3), "page long, ins long, box array<int>, text string, score double")
    ordered = layout.reading_order(layout.centred(layout.best_readings(table)))
    for r in layout.finished(ordered).collect():
        assert r.text.strip() and r.score >= (0.35 if len(r.text.strip()) >= 25 else 0.5)
        assert r.text != "Puls" or r.score >= 0.85
        assert r.vitals_type == ("SpO2" if "%" in r.text else None)
    kept = layout.confident(ordered).count()
    plain = [r for r in ordered.collect() if r.text.strip() and r.score >= (0.35 if len(r.text.strip()) >= 25 else 0.5)]
    assert kept == len(plain)
    assert strip(F.lit("a")) is not None


def test_ladder(spark):
    r = random.Random(5)
    pages, tiles = [], []
    for k in range(400):
        h = r.choice([0.1, 0.45, 0.46, 0.461, 0.6, 0.84, 0.85, 0.9])
        pages.append((k, r.random() < 0.1, 1 - h, h))
        for _ in range(r.choice([0, 1, 3, 4, 6])):
            th = r.choice([0.2, 0.6, 0.65, 0.7, 1.0])
            tiles.append((k, r.choice([0.0, 0.0799, 0.08, 0.25, 0.5]), 1 - th, th))
    votes = classify.tile_votes(spark.createDataFrame(tiles, "page int, ink double, p_printed double, p_handwritten double"), ["page"])
    table = spark.createDataFrame(pages, "page int, tabular boolean, p_printed double, p_handwritten double").join(votes, "page", "left")
    got = {x.page: x.decision for x in classify.decided(table).collect()}
    for k, tabular, p, h in pages:
        own = [t for t in tiles if t[0] == k]
        inked = [t for t in own if t[1] >= 0.08]
        d = got[k]
        if tabular:
            expected = ("structural_table_override", False)
        elif p >= 0.40 and p - h >= 0.08:
            expected = ("whole_page_printed", False)
        elif h >= 0.85 and h - p >= 0.40:
            expected = ("whole_page_handwritten", True)
        elif not own:
            expected = (None, False)
            assert d.reason == "no_tiles"
        elif not inked:
            expected = ("all_tiles_blank", False)
        elif len(inked) < 4:
            expected = ("insufficient_tile_evidence", False)
        else:
            ratio = sum(t[1] for t in inked if t[3] >= 0.65 and t[3] - t[2] >= 0.20) / sum(t[1] for t in inked)
            expected = ("tile_vote", ratio >= 0.75)
            assert abs(d.handwritten_ratio - ratio) < 0.001
        assert (d.decision, d.is_handwritten) == expected
        assert d._cfg == DEFAULTS.fingerprint()


def test_ruled_lines(spark):
    rows = [
        (1, 100, 100, 0, 10 * k, 50, 10 * k) for k in range(4)
    ] + [(1, 100, 100, 5, 0, 5, 60)] + [(2, 100, 100, 0, 10 * k, 34, 10 * k) for k in range(6)] + [(3, 100, 100, 0, k, 40, k) for k in range(5)]
    table = spark.createDataFrame(rows, "page int, height int, width int, x1 int, y1 int, x2 int, y2 int")
    got = {r.page: (r.horizontal, r.vertical, r.tabular) for r in classify.ruled_lines(table, ["page"]).collect()}
    assert got == {1: (4, 1, True), 2: (0, 0, False), 3: (5, 0, False)}
    either = {r.page: r.tabular for r in classify.ruled_lines(table, ["page"], Settings(structural_both_axes=False)).collect()}
    assert either == {1: True, 2: False, 3: True}


def test_cascade_asks_only_open_pages(spark):
    pages = spark.createDataFrame([("f", str(k)) for k in range(30)], "folder_name string, file_name string")
    k = F.col("file_name").cast("int")
    asked = []

    def tabular(p):
        return p.select("folder_name", "file_name", (k < 10).alias("tabular"))

    def page_scores(p):
        asked.append(sorted(int(r.file_name) for r in p.collect()))
        h = F.when(k < 20, 0.9).otherwise(0.6)
        return p.select("folder_name", "file_name", (1 - h).alias("p_printed"), h.alias("p_handwritten"))

    def tile_scores(p):
        asked.append(sorted(int(r.file_name) for r in p.collect()))
        return p.select("folder_name", "file_name", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("tile_row"), F.lit(0.3).alias("ink"), F.lit(0.1).alias("p_printed"), F.lit(0.9).alias("p_handwritten"))

    out = {int(r.file_name): r.decision.decision for r in classify.cascade(pages, tabular, page_scores, tile_scores).collect()}
    assert asked == [list(range(10, 30)), list(range(20, 30))]
    assert out == {k: "structural_table_override" if k < 10 else "whole_page_handwritten" if k < 20 else "tile_vote" for k in range(30)}
