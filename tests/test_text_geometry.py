"""Column functions against Python."""

import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow import config
from docflow.functions import geometry, text, vectors

STRINGS = [
    "", " ", "  a b  ", "\t x\n", "\x1c\x1d\x1e\x1fy\x85", "\xa0z ", " q　", "a\r\nb\rc\nd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l",
    "\n\n  \n", "no end\n", "​x", "72 BPM", "120/80 mmHg 98%", "37 °C", "°F", "beats/min %", "Ünïcode MMHG", None,
]


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame([(k, s) for k, s in enumerate(STRINGS)], "k int, s string").cache()


def test_strip_and_lines(strings):
    for r in strings.select("s", text.strip(F.col("s")).alias("strip"), text.lines(F.col("s")).alias("lines")).collect():
        assert r.strip == (None if r.s is None else r.s.strip())
        assert r.lines == ([] if r.s is None else [x.strip() for x in r.s.splitlines() if x.strip()])


def test_all_white_space(spark):
    every = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000 and c]
    rows = spark.createDataFrame([(c,) for c in every], "s string").select("s", text.strip(F.col("s")).alias("t")).collect()
    assert {r.s for r in rows if r.t == ""} == {c for c in every if not c.strip()}


def test_unit_tag(strings):
    def tag(s):
        return None if s is None else next((label for u, label in config.UNITS if u in s.lower()), None)

    assert all(r.t == tag(r.s) for r in strings.select("s", text.unit_tag(F.col("s")).alias("t")).collect())


def test_extension(spark):
    names = ["a.jpg", "A.JPEG", "b.tar.PNG", "noext", ".png", "..png", "x.", "dir.x/file", "dir/.hidden.jpg", "a b.Jpg"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.extension(F.col("n")).alias("e")).collect()
    assert {r.n: r.e for r in rows} == {n: os.path.splitext(n)[1].lower() for n in names}


def indel_ratio(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_vocabulary_match(spark):
    r = random.Random(1)
    terms = config.VOCABULARY
    assert len(terms) == 55
    found = []
    for t in terms:
        for _ in range(4):
            x = list(t)
            for _ in range(r.randrange(4)):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice([[], [r.choice("aeRT ")], [x[k], "s"]])
                x = x or ["a"]
            found.append("".join(x))
    found += ["", "  ", "zzzz", "HR", "RR", "SpO2", "spo2", "High ", "\U0001f600 High"]
    rows = spark.createDataFrame([(s, r.choice([0.1, 0.84, 0.85, 0.9])) for s in found], "s string, p double")
    for x in rows.select("s", "p", text.corrected(F.col("s"), F.col("p")).alias("c")).collect():
        best = max(terms, key=lambda t: (indel_ratio(x.s, t), -terms.index(t)))
        expected = best if x.p < 0.85 and x.s.strip() and indel_ratio(x.s, best) >= 82 else x.s
        assert x.c == expected, (x.s, x.p)


def test_snapping_and_centres(spark):
    rows = spark.range(0, 4001).select("id", geometry.snapped(F.col("id")).alias("s")).collect()
    assert all(r.s == round(r.id / 10) * 10 for r in rows)
    boxes = spark.createDataFrame([([0, 10, 4, 20],), ([1, 2, 5, 2, 5, 8, 1, 8],)], "b array<int>")
    got = boxes.select(geometry.centre(F.col("b"), 0).alias("x"), geometry.centre(F.col("b"), 1).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(2.0, 15.0), (3.0, 5.0)]


def test_tiles_and_sizes(spark):
    sizes = [(0, 0), (1, 1), (2, 5), (100, 99), (3000, 10), (2001, 2000), (50, 4001)]
    rows = spark.createDataFrame(sizes, "h int, w int")
    got = rows.select("h", "w", geometry.tiles(F.col("h"), F.col("w")).alias("t"), geometry.resized(F.col("h"), F.col("w"), 2000).alias("a"), geometry.resized(F.col("w"), F.col("h"), 2000).alias("b")).collect()
    for r in got:
        expected = [(i, j, int(r.h * i / 3), int(r.h * (i + 1) / 3), int(r.w * j / 2), int(r.w * (j + 1) / 2)) for i in range(3) for j in range(2)]
        assert [tuple(t) for t in r.t] == [t for t in expected if t[3] > t[2] and t[5] > t[4]]
        scale = 2000 / max(r.h, r.w) if max(r.h, r.w) > 2000 else 1
        assert (r.a, r.b) == ((int(r.h * scale), int(r.w * scale)) if scale < 1 else (r.h, r.w))


def test_zero_shot(spark):
    r = np.random.default_rng(0)
    vecs, prompts = r.normal(size=(20, 8)), r.normal(size=(2, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "k int, v array<double>")
    p, h = vectors.zero_shot(F.col("v"), [F.array(*map(F.lit, x.tolist())) for x in prompts])
    for x in rows.select("k", p.alias("p"), h.alias("h")).collect():
        u = vecs[x.k] / np.linalg.norm(vecs[x.k])
        s = 100 * (prompts / np.linalg.norm(prompts, axis=1, keepdims=True)) @ u
        e = np.exp(s - s.max())
        assert np.allclose([x.p, x.h], e / e.sum())


def test_settings():
    s = config.Settings.from_env({"FETCH_LIMIT": "unlimited", "MAX_RAW_SCAN": "", "MIN_TILE_WEIGHT": "0.2", "AUTO_MANAGE_EC2": "TRUE", "HANDWRITTEN_ENDPOINT": "http://x"})
    assert (s.fetch_limit, s.max_raw_scan, s.min_tile_weight, s.manage_host, s.endpoint) == (None, 3000, 0.2, True, "http://x")
    assert s.fingerprint() != config.DEFAULTS.fingerprint() == config.Settings.from_env({}).fingerprint()
    assert config.DEFAULTS.fingerprint(True) != config.Settings(classifier_max_side=10).fingerprint(True)
    assert config.DEFAULTS.fingerprint() == config.Settings(classifier_max_side=10).fingerprint()
    assert unicodedata.normalize("NFC", config.UNITS[4][0]) == "°f"
