"""Column functions on boxes, segments, tiles and image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snapped(v: Column, grid: int = 10) -> Column:
    """The nearest multiple of the grid; halves go to the even one."""
    return (F.bround(v / float(grid), 0) * grid).cast("int")


def box_key(box: Column, grid: int = 10) -> Column:
    return F.transform(box, lambda v: snapped(v, grid))


def centre(box: Column, axis: int) -> Column:
    """Mean of every second element, from the first (x) or the second (y) on; of two or of four corners."""
    some = F.filter(box, lambda v, i: i % 2 == axis)
    return F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some)


def segment_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)).cast("double"))


def segment_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees from 0 to 180."""
    return F.abs(F.degrees(F.atan2((y2 - y1).cast("double"), (x2 - x1).cast("double"))))


def tiles(height: Column, width: Column, grid: tuple[int, int] = (3, 2)) -> Column:
    """Row-major tiles of an image as array of structs; tiles without a pixel are left out."""
    rows, cols = grid
    cell = lambda r, c: F.struct(
        F.lit(r).alias("tile_row"), F.lit(c).alias("tile_col"),
        F.floor(height * r / rows).cast("int").alias("y0"), F.floor(height * (r + 1) / rows).cast("int").alias("y1"),
        F.floor(width * c / cols).cast("int").alias("x0"), F.floor(width * (c + 1) / cols).cast("int").alias("x1"),
    )
    every = F.array(*[cell(r, c) for r in range(rows) for c in range(cols)])
    return F.filter(every, lambda t: (t["y1"] > t["y0"]) & (t["x1"] > t["x0"]))


def resized(side: Column, other: Column, cap: int) -> Column:
    """The side after shrinking so that the longer one is the cap; smaller images keep theirs."""
    longest = F.greatest(side, other)
    return F.when(longest > cap, F.floor(side * (F.lit(float(cap)) / longest)).cast("int")).otherwise(side)
