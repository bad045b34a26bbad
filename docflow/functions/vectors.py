"""Column functions on vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two vectors over the product of their lengths, each of which is summed once."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def softmax(scores: list[Column]) -> list[Column]:
    """Shares that sum to 1; the largest score is taken off first, so that none overflows."""
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def zero_shot(image: Column, prompts: list[Column], scale: float = 100.0) -> list[Column]:
    """Probability of each prompt for an image, from the cosines of their vectors."""
    return softmax([scale * cosine(image, p) for p in prompts])


def zip_shorter(a: Column, b: Column, names: tuple[str, str] = ("a", "b")) -> Column:
    """Two arrays joined by place into an array of structs, up to the shorter one's end."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias(names[0]), F.slice(b, F.lit(1), n).alias(names[1]))
