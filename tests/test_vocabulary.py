"""The vocabulary index against all pairs."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docflow.operators import layout, vocabulary


def subsequence(a: str, b: str) -> int:
    places = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(b)) - 1
    state = full
    for c in a:
        hits = state & places.get(c, 0)
        state = ((state + hits) | (state - hits)) & full
    return len(b) - bin(state).count("1")


def all_pairs(readings, terms, threshold):
    found = {}
    for x in set(readings) - {"", None}:
        best = max(((200 * subsequence(x, t) / (len(x) + len(t)), -k, t) for k, t in reversed(list(enumerate(terms))) if t), default=(0, 0, ""))
        if best[0] >= threshold:
            found[x] = (best[2], best[0])
    return found


def changed(r: random.Random, text: str, n: int, letters: str) -> str:
    chars = list(text)
    for _ in range(n):
        k = r.randrange(len(chars) + 1)
        chars[k : k + r.randrange(2)] = r.choice(letters) if r.random() < 0.7 else ""
    return "".join(chars)


@pytest.mark.parametrize("threshold", [82, 95, 40])
def test_equal_to_all_pairs(spark, threshold):
    r = random.Random(threshold)
    letters = "abcdeé日"
    terms = ["".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 25, 61, 62, 63, 130, 200]))) for _ in range(150)]
    terms = list(dict.fromkeys(terms))
    readings = [changed(r, r.choice(terms), r.choice([0, 1, 1, 2, 4, 12]), letters) for _ in range(250)] + ["", None, "a", "aaaa", "zzz"]
    rows = spark.createDataFrame([(x,) for x in readings], "text string")
    words = spark.createDataFrame([(t, k) for k, t in enumerate(terms)] + [(terms[0], 999), ("", -1), (None, -2)], "term string, rank int")
    got = {x.text: (x.term, round(x.score, 9)) for x in vocabulary.matched(rows, words, threshold).collect()}
    assert got == {x: (t, round(s, 9)) for x, (t, s) in all_pairs(readings, terms, threshold).items()}


def test_large_vocabulary_without_a_cross_join(spark):
    """100,000 terms; candidates are few, and the plan has neither a cross nor a nested loop join."""
    terms = spark.range(100_000).select(F.sha1(F.col("id").cast("string")).alias("term"), F.col("id").alias("rank"))
    readings = spark.range(0, 100_000, 5000).select(F.concat(F.lit("x"), F.substring(F.sha1(F.col("id").cast("string")), 2, 39)).alias("text"), "id")
    found = vocabulary.matched(readings, terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {x.text: x.term for x in found.collect()}
    assert got == {x.text: x.term for x in readings.select("text", F.sha1(F.col("id").cast("string")).alias("term")).collect()}


def test_bounds():
    for threshold in (50, 66, 70, 82, 95):
        for m in range(1, 40):
            bound = vocabulary.least_shared(m, threshold, vocabulary.math.ceil, min)
            for n in range(1, 120):
                d = (m + n) * (100 - threshold) // 100
                for k in range(abs(m - n), d + 1, 2):
                    assert m - 1 - 2 * ((k + m - n) // 2) - (k + n - m) // 2 >= bound
    assert vocabulary.longest_short(82) == 2 and vocabulary.longest_short(40) is None


def test_letters_in_common(spark):
    """The bound from bags is never below the letters that texts have in common, and exact for short texts of a to z."""
    r = random.Random(3)
    texts = ["".join(r.choice(some) for _ in range(r.randrange(1, 80))) for some in ("ab", "abcdefgh", "aé日😀", "qrstuvwxyz") for _ in range(30)]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "t string, u string")
    rows = rows.select("t", "u", *[F.struct(*vocabulary.bags(vocabulary.characters(F.col(c)))).alias(n) for c, n in (("t", "a"), ("u", "b"))])
    for x in rows.select("t", "u", vocabulary.common_letters("a", F.char_length("t"), "b", F.char_length("u")).alias("n")).collect():
        common = sum(min(x.t.count(c), x.u.count(c)) for c in set(x.t))
        assert x.n >= common
        if x.t.isascii() and x.u.isascii() and all(y.count(c) <= 4 for y in (x.t, x.u) for c in y):
            assert x.n == common


def test_few_candidates_of_syllables(spark):
    """Words of few syllables share most pairs of letters; those of other letters aren't candidates, and the readings are dealt."""
    parts = ["lle", "rra", "mente", "gasci", "ezdo", "bonu", "jaco", "osue"]
    words = ["".join(c) for c in itertools.product(parts, repeat=3)]
    rows = spark.createDataFrame([(w,) for w in words], "text string")
    terms = spark.createDataFrame([(w,) for w in words[::3]], "term string")
    n = vocabulary.candidates(rows, terms, 82, 3).count()
    some = [(a, b) for a in words for b in words[::3]]
    alike = sum(200 * subsequence(a, b) >= 82 * (len(a) + len(b)) for a, b in some)
    lettered = sum(200 * (Counter(a) & Counter(b)).total() >= 82 * (len(a) + len(b)) for a, b in some)
    assert alike <= n <= 1.2 * lettered
    plan = vocabulary.candidates(rows, terms, 82, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text" in plan and "REPARTITION_BY_NUM" in plan


def test_corrections_by_a_table_of_terms(spark):
    entries = spark.createDataFrame([("haemoglobyn", 0.5), ("haemoglobyn", 0.9), ("  ", 0.1), ("qqq", 0.2)], "text string, score double")
    terms = spark.createDataFrame([("haemoglobin", 1), ("globin", 0)], "term string, rank int")
    assert sorted(tuple(x) for x in layout.with_corrections(entries, terms=terms).collect()) == [("  ", 0.1), ("haemoglobin", 0.5), ("haemoglobyn", 0.9), ("qqq", 0.2)]
