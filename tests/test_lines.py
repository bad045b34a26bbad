"""Lines on pages against a plain accumulator in NumPy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.config import Settings
from docflow.operators import images, lines

ONE = 1 << lines.BITS


def rounded(v):
    return (v + ONE // 2) >> lines.BITS


def plain(points, least, threshold, gap, spread):
    """Segments of (x, y, angle): an accumulator, its peaks, and runs of places along each."""
    cells, hits = Counter(), {}
    for x, y, a in points:
        for b in range(a - spread, a + spread + 1):
            b %= 180
            cell = b, rounded(x * lines.COS[b] + y * lines.SIN[b])
            cells[cell] += 1
            hits.setdefault(cell, set()).add(rounded(y * lines.COS[b] - x * lines.SIN[b]))
    enough = {c: n for c, n in cells.items() if n >= threshold}
    found = []
    for (a, o), n in enough.items():
        near = [(b % 180, (o if 0 <= b < 180 else -o) + d) for b in range(a - lines.NEAR_ANGLES, a + lines.NEAR_ANGLES + 1) for d in range(-lines.NEAR_OFFSETS, lines.NEAR_OFFSETS + 1)]
        if max((enough.get(c, 0), -c[0], -c[1]) for c in near) != (n, -a, -o):
            continue
        places = sorted(set().union(*(hits.get((a, o + d), set()) for d in range(-lines.BAND, lines.BAND + 1))))
        cuts = [0, *(k for k in range(1, len(places)) if places[k] - places[k - 1] > gap), len(places)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            s, e = places[i], places[j - 1]
            if e - s >= least:
                ends = [rounded(o * lines.COS[a] - s * lines.SIN[a]), rounded(o * lines.SIN[a] + s * lines.COS[a]), rounded(o * lines.COS[a] - e * lines.SIN[a]), rounded(o * lines.SIN[a] + e * lines.COS[a])]
                found.append((*ends, a, o, n))
    return sorted(found)


def test_random_pages(spark):
    r = np.random.default_rng(4)
    pages = []
    for p in range(6):
        points = [(int(x), int(y), int(a)) for x, y, a in zip(r.integers(0, 120, 400), r.integers(0, 90, 400), r.integers(0, 180, 400), strict=True)]
        for a, o in ((0, 40), (90, 30), (30, 60), (178, -20), (120 + p, 5)):
            points += [(rounded(o * lines.COS[a] - t * lines.SIN[a]), rounded(o * lines.SIN[a] + t * lines.COS[a]), (a + int(r.integers(-3, 4))) % 180) for t in range(60) if t % 25 < 17]
        pages.append(points)
    rows = spark.createDataFrame([(p, *x) for p, points in enumerate(pages) for x in points], "page int, x int, y int, angle int")
    got = lines.segments(rows, ["page"], F.lit(25), threshold=20, gap=10, spread=3).collect()
    for p, points in enumerate(pages):
        mine = sorted(tuple(r)[1:] for r in got if r.page == p)
        assert mine == plain(points, 25, 20, 10, 3) and len(mine) >= 5


def drawn(size, strokes, dash=None):
    """A white page with dark strokes (x1, y1, x2, y2) of three pixels."""
    page = np.full((*size, 3), 255, np.uint8)
    for x1, y1, x2, y2 in strokes:
        n = int(max(abs(x2 - x1), abs(y2 - y1)))
        for t in range(n + 1):
            if dash is None or t % sum(dash) < dash[0]:
                x, y = round(x1 + (x2 - x1) * t / n), round(y1 + (y2 - y1) * t / n)
                page[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2] = 0
    return page


@pytest.mark.parametrize("turn", [0, 17, 45, 90, 133])
def test_lines_at_any_angle_and_dashed(spark, turn):
    c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    stroke = (200 - 150 * c, 200 - 150 * s, 200 + 150 * c, 200 + 150 * s)
    rows = [(str(k), images.encode_png(drawn((400, 400), [stroke], dash))) for k, dash in enumerate([None, (30, 8), (30, 30)])]
    pages = spark.createDataFrame(rows, "page string, content binary")
    found = lines.ruled(lines.edges_of(pages, ["page"]), ["page"], Settings(line_votes=100)).collect()
    for k in ("0", "1"):
        mine = [r for r in found if r.page == k]
        angles = [np.degrees(np.arctan2(r.y2 - r.y1, r.x2 - r.x1)) % 180 for r in mine]
        assert mine and all(min(abs(a - turn), 180 - abs(a - turn)) <= 3 for a in angles)
        assert max(np.hypot(r.x2 - r.x1, r.y2 - r.y1) for r in mine) >= 240
    assert not [r for r in found if r.page == "2"]


def test_tables_and_edges(spark):
    ruled = drawn((260, 300), [(20, y, 280, y) for y in (30, 80, 130, 180)] + [(150, 10, 150, 250)])
    empty = np.full((200, 200, 3), 255, np.uint8)
    r = np.random.default_rng(1).integers(0, 256, (90, 90, 3)).astype(np.uint8)
    rows = [("a", images.encode_png(ruled)), ("b", images.encode_png(empty)), ("c", images.encode_png(r)), ("d", b"no page"), ("e", None)]
    edges = lines.edges_of(spark.createDataFrame(rows, "page string, content binary"), ["page"])
    assert sorted(x.page for x in edges.collect()) == ["a", "b", "c"]
    found = [x for x in lines.ruled(edges, ["page"]).collect() if x.page == "a"]
    flat = [x for x in found if abs(x.y2 - x.y1) <= 4 and abs(x.x2 - x.x1) >= 200]
    tall = [x for x in found if abs(x.x2 - x.x1) <= 4 and abs(x.y2 - x.y1) >= 150]
    assert len(flat) >= 4 and len(tall) >= 1
    x, y, a = lines.edge_pixels(ruled)
    assert set(a[(y > 40) & (y < 70) & (abs(x - 150) < 5)].tolist()) <= {0, 179, 1}


def test_votes_within_a_row(spark):
    """Votes counted within a page's row are those of its exploded pixels, and no pixel moves once for each vote."""
    r = random.Random(8)
    pages = [(f"p{k}", [(r.randrange(40), r.randrange(30), r.choice([0, 3, 90, 179, r.randrange(180)])) for _ in range(n)]) for k, n in enumerate([0, 1, 40, 300, 900])]
    edges = spark.createDataFrame(pages, f"page string, edges {lines.EDGE}")
    pixels = edges.select("page", F.explode("edges").alias("e")).select("page", "e.*")
    for least in (1, 2, 9):
        want = sorted(tuple(x) for x in lines.votes(pixels, ["page"], 8).where(F.col("votes") >= least).collect())
        assert sorted(tuple(x) for x in lines.page_votes(edges, ["page"], 8, least).collect()) == want
    plan = lines.segments(pixels, ["page"], F.lit(5), 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.split("Join")[1].count("Generate explode(sequence(") == 2  # votes and neighbours, on the lines' side only
