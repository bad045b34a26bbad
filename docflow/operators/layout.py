"""From recognised boxes to lines in reading order.

Input rows: page, ins (order of arrival within the page), box, text, score. All steps group by page or by page
and something else, so one exchange by page serves them all. As a task sorts its boxes several times, it is given a number
of boxes that doesn't grow with the input (or one page, if that has more).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Settings
from docflow.functions.geometry import box_key, centre
from docflow.functions.text import best_match, strip, unit_tag
from docflow.operators import vocabulary


#: Boxes of a task.
BOXES = 250_000


def tasks_for(boxes: DataFrame, each: int = BOXES) -> int:
    """How many tasks boxes are dealt to: by their number, as their packed size says little about what a task's sorts hold."""
    return max(boxes.sparkSession.sparkContext.defaultParallelism, -(-boxes.count() // each))


def best_readings(boxes: DataFrame, settings: Settings = DEFAULTS, tasks: int | None = None) -> DataFrame:
    """Of boxes that snap to one place the reading of highest score, the first of equals; in the place of the first to come.

    tasks: how many the pages are dealt to; if it isn't known, boxes are counted for it.
    """
    dealt = boxes.repartition(tasks or tasks_for(boxes), "page").withColumn("place", box_key(F.col("box"), settings.box_grid))
    best = F.max_by(F.struct("box", "text", "score"), F.struct(F.col("score"), -F.col("ins")))
    return dealt.groupBy("page", "place").agg(best.alias("best"), F.min("ins").alias("ins")).select("page", "ins", "best.box", "best.text", "best.score")


def centred(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("x", centre(F.col("box"), 0)).withColumn("y", centre(F.col("box"), 1))


def columns(items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds col_id: a new column starts where an item is further than the gap from the one to its left."""
    w = Window.partitionBy("page").orderBy("x", "ins")
    starts = F.coalesce((F.col("x") - F.lag("x").over(w) > settings.column_gap).cast("int"), F.lit(0))
    return items.withColumn("__starts", starts).withColumn("col_id", F.sum("__starts").over(w).cast("int")).drop("__starts")


def rows(items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds row_id: an item joins a row if it is within the tolerance of the row's first item.

    The anchors of a column's rows are folded from its distinct heights in order; an item's row is the number of
    anchors up to its height, less one. There are at most as many anchors as the page's height has tolerances, so
    the work grows with the items alone.
    """
    same = ["page", "col_id"]
    tolerance = F.lit(float(settings.row_tolerance))
    heights = F.sort_array(F.collect_set("y"))
    step = lambda a, y: F.when((F.size(a) == 0) | (y - F.try_element_at(a, F.lit(-1)) > tolerance), F.array_append(a, y)).otherwise(a)
    anchors = F.aggregate(heights, F.array().cast("array<double>"), step)
    item = F.struct(*[c for c in items.columns if c not in same])
    folded = items.groupBy(*same).agg(anchors.alias("anchors"), F.collect_list(item).alias("items"))
    placed = F.transform("items", lambda i: F.struct(i.alias("item"), (F.size(F.filter("anchors", lambda a: a <= i["y"])) - 1).alias("row_id")))
    return folded.select(*same, F.inline(placed)).select(*same, "row_id", "item.*")


def reading_order(items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds col_id, row_id and line_no: columns from the left, rows from the top, items from the left."""
    placed = rows(columns(items, settings), settings)
    return placed.withColumn("line_no", F.row_number().over(Window.partitionBy("page").orderBy("col_id", "row_id", "x", "y", "ins")))


def confident(entries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Entries with text whose score reaches the limit for their length."""
    text = strip(F.col("text"))
    least = F.when(F.char_length(text) >= settings.long_text_chars, settings.long_text_confidence).otherwise(settings.confidence)
    return entries.where((text != "") & (F.col("score") >= least))


def with_corrections(entries: DataFrame, settings: Settings = DEFAULTS, terms: DataFrame | None = None) -> DataFrame:
    """Entries with uncertain readings replaced by the best term of the vocabulary, if one is similar enough.

    Each distinct reading is compared once, as the readings of a corpus repeat. terms (term, rank) stand in for the settings'
    short vocabulary; there may be any number of any size (see operators.vocabulary).
    """
    unsure = (F.col("score") < settings.vocabulary_gate) & (strip(F.col("text")) != "")
    readings = entries.where(unsure).select("text").distinct()
    if terms is None:
        best = readings.select(F.col("text").alias("__text"), best_match(F.col("text"), settings.vocabulary_threshold)["term"].alias("__term")).where("__term is not null")
    else:
        best = vocabulary.matched(readings, terms, settings.vocabulary_threshold).select(F.col("text").alias("__text"), F.col("term").alias("__term"))
    found = entries.join(best, F.when(unsure, F.col("text")) == F.col("__text"), "left")
    return found.select(*[F.coalesce("__term", "text").alias(c) if c == "text" else F.col(c) for c in entries.columns])


def finished(entries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Confident entries with text corrected, vitals_type by unit, and score of three digits."""
    kept = with_corrections(confident(entries, settings), settings)
    return kept.withColumn("vitals_type", unit_tag(F.col("text"))).withColumn("score", F.round("score", 3))


def page_lines(boxes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(page, lines): the whole way from boxes of both recognisers to a page's texts in reading order."""
    entries = finished(reading_order(centred(best_readings(boxes, settings)), settings), settings)
    return entries.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda e: e["text"]).alias("lines"))
