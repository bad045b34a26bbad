"""Straight lines on pages, at any angle: edges, votes for lines, segments along them.

Edge pixels are found inside a Python stage, a page at a time: gradient, thinning across the edge, and of weak edges
those that hang together with strong ones. All else is a plan over their rows: each pixel votes for the lines through it
whose direction is near its edge's, votes are a group-by over (page, angle, offset) that is summed up before it is sent,
a line stands if no line beside it has more votes, and a line's pixels are cut at gaps into segments.

A line is x * cos + y * sin = offset, angles are whole degrees of its normal from 0 to 179, offsets whole pixels. Sines and
cosines are whole numbers of 20 binary digits, so that all sums and roundings are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Settings
from docflow.operators.images import ImageError, decode_png, given, grey, shrunk

BITS = 20
COS = [round(math.cos(math.radians(a)) * (1 << BITS)) for a in range(180)]
SIN = [round(math.sin(math.radians(a)) * (1 << BITS)) for a in range(180)]
#: Lines within so many degrees and pixels of one with more votes are that line.
NEAR_ANGLES, NEAR_OFFSETS = 3, 3
#: Pixels that far from a line belong to it, as its true angle may be half a degree or so off.
BAND = 2
EDGE = "array<struct<x: int, y: int, angle: int>>"


def edge_pixels(image: np.ndarray, weak: int = 50, strong: int = 150, apart: int = 2 * DEFAULTS.line_spread) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, angle of the normal in degrees) of the edges of an image. The angle is that of all gradients around, as steps
    of a slanted edge have few angles of their own. A pixel whose own angle is further `apart` from it, as at crossings, is
    there with that one too."""
    g = np.pad(grey(image).astype(np.int32), 1, mode="edge")
    down = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    right = g[:-2] + 2 * g[1:-1] + g[2:]
    dy, dx = down[2:] - down[:-2], right[:, 2:] - right[:, :-2]
    size = np.abs(dx) + np.abs(dy)
    angle = np.rint(np.degrees(np.arctan2(dy, dx))).astype(np.int32) % 180
    around = np.pad(size, 1)
    height, width = size.shape
    peak = np.zeros(size.shape, bool)
    for step, (i, j) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        across = ((angle + 22) // 45) % 4 == step
        before = around[1 - i : 1 - i + height, 1 - j : 1 - j + width]
        after = around[1 + i : 1 + i + height, 1 + j : 1 + j + width]
        peak |= across & (size > before) & (size >= after)
    able = np.pad(peak & (size > weak), 1).ravel()
    row = width + 2
    front = np.flatnonzero(np.pad(peak & (size > strong), 1).ravel())
    found = np.zeros(able.shape, bool)
    found[front] = True
    beside = np.array([-row - 1, -row, -row + 1, -1, 1, row - 1, row, row + 1])
    while len(front):
        near = np.unique(front[:, None] + beside)
        front = near[able[near] & ~found[near]]
        found[front] = True
    y, x = np.nonzero(found.reshape(height + 2, row)[1:-1, 1:-1])
    own, (a, b) = angle[y, x], (_summed(v, y, x) for v in (dx * dx - dy * dy, 2 * dx * dy))
    common = np.rint(np.degrees(np.arctan2(b, a)) / 2).astype(np.int32) % 180
    other = np.abs((own - common + 90) % 180 - 90) > apart
    return np.concatenate([x, x[other]]), np.concatenate([y, y[other]]), np.concatenate([common, own[other]])


def _summed(values: np.ndarray, y: np.ndarray, x: np.ndarray, reach: int = 5) -> np.ndarray:
    """Sums of the values around places."""
    total = np.pad(np.cumsum(np.cumsum(values.astype(np.float64), 0), 1), ((1, 0), (1, 0)))
    height, width = values.shape
    a, b, c, d = np.maximum(y - reach, 0), np.minimum(y + reach + 1, height), np.maximum(x - reach, 0), np.minimum(x + reach + 1, width)
    return total[b, d] - total[a, d] - total[b, c] + total[a, c]


def edges_of(pages: DataFrame, keys: list[str], content: str = "content", cap: int = DEFAULTS.classifier_max_side) -> DataFrame:
    """One row a page: keys, height, width, edges. Pages that can't be decoded give none."""
    schema = ", ".join(f"`{k}` string" for k in keys) + f", height int, width int, edges {EDGE}"

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                try:
                    image = shrunk(decode_png(given(row[-1])), cap)
                except ImageError:
                    continue
                points = zip(*(v.tolist() for v in edge_pixels(image)), strict=True)
                rows.append((*row[:-1], *image.shape[:2], [{"x": x, "y": y, "angle": a} for x, y, a in points]))
            yield pd.DataFrame(rows, columns=[*keys, "height", "width", "edges"])

    return pages.select(*keys, content).mapInPandas(run, schema)


def _of(values: list[int], angle: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), angle.cast("int") + 1)


def _rounded(sum_: Column) -> Column:
    """The nearest whole number to a sum of products with sines and cosines."""
    return F.shiftright(sum_ + (1 << (BITS - 1)), BITS)


def offset(x: Column, y: Column, angle: Column) -> Column:
    return _rounded(x * _of(COS, angle) + y * _of(SIN, angle))


def along(x: Column, y: Column, angle: Column) -> Column:
    """The place on the line of a normal's angle."""
    return _rounded(y * _of(COS, angle) - x * _of(SIN, angle))


def point(offset: Column, place: Column, angle: Column) -> tuple[Column, Column]:
    """(x, y) of a place on a line."""
    c, s = _of(COS, angle), _of(SIN, angle)
    return _rounded(offset * c - place * s), _rounded(offset * s + place * c)


def votes(pixels: DataFrame, keys: list[str], spread: int) -> DataFrame:
    """(keys, angle, offset, votes): each pixel (x, y, angle) votes for the lines through it of up to `spread` degrees off."""
    turned = pixels.select(*keys, "x", "y", F.explode(F.sequence(F.col("angle") - spread, F.col("angle") + spread)).alias("a"))
    angle = F.pmod(F.col("a"), F.lit(180))
    cells = turned.select(*keys, angle.alias("angle"), offset(F.col("x").cast("long"), F.col("y").cast("long"), angle).alias("offset"))
    return cells.groupBy(*keys, "angle", "offset").agg(F.count("*").alias("votes"))


def standing(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Lines of enough votes beside which none has more; of equal ones that of least angle, then offset. Beyond 179
    degrees a line goes on at 0 with its offset negated."""
    enough = cells.where(F.col("votes") >= least)
    rank = F.struct("votes", (-F.col("angle")).alias("a"), (-F.col("offset")).alias("o"))
    turns = F.sequence(F.col("angle") - NEAR_ANGLES, F.col("angle") + NEAR_ANGLES)
    moves = F.sequence(F.lit(-NEAR_OFFSETS), F.lit(NEAR_OFFSETS))
    told = enough.select(*keys, rank.alias("rank"), F.explode(turns).alias("a"), "offset").select("*", F.explode(moves).alias("o"))
    sign = F.when((F.col("a") < 0) | (F.col("a") >= 180), -1).otherwise(1)
    near = told.select(*keys, F.pmod("a", F.lit(180)).alias("angle"), (sign * F.col("offset") + F.col("o")).alias("offset"), "rank")
    best = near.groupBy(*keys, "angle", "offset").agg(F.max("rank").alias("rank"))
    own = (F.col("rank.a") == -F.col("angle")) & (F.col("rank.o") == -F.col("offset"))
    return best.where(own).select(*keys, "angle", "offset", "rank.votes")


def page_votes(edges: DataFrame, keys: list[str], spread: int, least: int) -> DataFrame:
    """What votes() gives, of those with at least `least`, for pages whose pixels are in one row (edges): they are counted within
    the row, so only cells with enough votes go on. Of sorted cells those have enough whose like stands `least` - 1 further."""
    cell = lambda e, a: F.shiftleft(a.cast("long"), 32) + offset(e["x"].cast("long"), e["y"].cast("long"), a) + (1 << 31)
    of_pixel = lambda e: F.transform(F.sequence(e["angle"] - spread, e["angle"] + spread), lambda a: cell(e, F.pmod(a, F.lit(180))))
    cells = F.sort_array(F.flatten(F.transform("edges", of_pixel)))
    enough = F.flatten(F.transform(F.array(cells), lambda all_: F.filter(all_, lambda c, i: c == F.try_element_at(all_, i + least))))
    counted = edges.select(*keys, F.explode(enough).alias("c")).groupBy(*keys, "c").agg((F.count("*") + least - 1).alias("votes"))
    return counted.select(*keys, F.shiftright("c", 32).cast("int").alias("angle"), (F.col("c").bitwiseAND(0xFFFFFFFF) - (1 << 31)).alias("offset"), "votes")


def by_page(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row a page with its lines. It is joined sorted: the size of packed pixels says little about that of their rows, which
    mustn't be broadcast."""
    return lines.groupBy(*keys).agg(F.collect_list(F.struct("angle", "offset", "votes")).alias("lines")).hint("merge")


def segments(pixels: DataFrame, keys: list[str], least: Column, threshold: int = 150, gap: int = 10, spread: int = 8) -> DataFrame:
    """(keys, x1, y1, x2, y2, angle, offset, votes) of the segments of all lines with enough votes.

    pixels: keys, x, y, angle of the normal, and what `least` needs: the length that a segment must have. Pixels near
    the line (BAND) belong to it; places up to `gap` apart belong together.
    """
    lines = standing(votes(pixels, keys, spread), keys, threshold)
    lined = pixels.withColumn("least", least).select(*keys, "least", "x", "y", "angle").join(by_page(lines, keys), keys)
    return islands(lined, keys, gap, spread)


def islands(lined: DataFrame, keys: list[str], gap: int, spread: int) -> DataFrame:
    """The segments of segments(), from pixels (keys, least, x, y, angle) with the lines of their page: each is held against
    these, so that no pixel moves once for each of its votes."""
    held = lined.select(*keys, "least", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("angle").alias("own"), F.explode("lines").alias("l"))
    held = held.select(*keys, "least", "x", "y", "own", "l.angle", F.col("l.offset").alias("line"), "l.votes")
    angle = F.col("angle")
    turned = F.abs(F.pmod(F.col("own") - angle + 90, F.lit(180)) - 90) <= spread
    on = held.where(turned & (F.abs(offset(F.col("x"), F.col("y"), angle) - F.col("line")) <= BAND))
    line = [*keys, "angle", "line"]
    places = on.select(*line, "votes", "least", along(F.col("x"), F.col("y"), F.col("angle")).alias("t")).distinct()
    w = Window.partitionBy(*line).orderBy("t")
    starts = places.withColumn("s", F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(0)))
    found = starts.withColumn("s", F.sum("s").over(w)).groupBy(*line, "s").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("votes").alias("votes"), F.max("least").alias("least"))
    ends = [point(F.col("line"), F.col(t), F.col("angle")) for t in ("a", "b")]
    named = [e.cast("int").alias(n) for e, n in zip([*ends[0], *ends[1]], ("x1", "y1", "x2", "y2"), strict=True)]
    return found.where(F.col("b") - F.col("a") >= F.col("least")).select(*keys, *named, "angle", F.col("line").alias("offset"), "votes")


def ruled(edges: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Segments of pages: keys, height, width, x1, y1, x2, y2. edges: keys, height, width, edges."""
    size = F.struct("height", "width").alias("size")
    sized, own = edges.select(*keys, size, "edges"), [*keys, "size"]
    least = F.floor(F.least("size.height", "size.width") * F.lit(settings.structural_min_fraction))
    lines = standing(page_votes(sized, own, settings.line_spread, settings.line_votes), own, settings.line_votes)
    lined = sized.join(by_page(lines, own), own).select(*own, least.alias("least"), "lines", F.explode("edges").alias("e"))
    found = islands(lined.select(*own, "least", "lines", "e.*"), own, settings.line_gap, settings.line_spread)
    return found.select(*keys, "size.height", "size.width", "x1", "y1", "x2", "y2")
