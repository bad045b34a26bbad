"""Importance resampling against a plain version that builds every n-gram."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import importance
from docflow.llm.queries import op13_importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", "a", "A b", "x" * 300 + " " + "y" * 65 + " Z" + "w" * 64, "日本 A-b_c 9é", "q " * 50, "É\x00a ́b"]


def plain(text):
    """(words, n-grams) of a text."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def buckets(grams):
    return [zlib.crc32(g.encode()) % 10_000 for g in grams]


def expected(rows, target, percent=5, least=20):
    """{key: [n_features, weight, score, rank]} of (key, text)."""
    found = [(k, *plain(x)) for k, x in rows]
    s, t = Counter(b for _, _, g in found for b in buckets(g)), Counter(b for x in target for b in buckets(plain(x)[1]))
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in range(10_000)]
    out, able = {}, []
    for k, words, grams in found:
        h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(grams))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[k] = [len(grams), weight, score, None]
        if words >= least:
            able.append((-score, k))
    for rank, (_, k) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[k][3] = rank
    return out


def check_features(texts):
    grams = [plain(x)[1] for x in texts]
    counts, per = np.zeros(10_000, int), np.zeros(len(texts), int)
    for doc, at in importance.features(pa.array(texts, pa.string())):
        counts += np.bincount(at, minlength=10_000)
        per += np.bincount(doc, minlength=len(texts))
    want = Counter(b for g in grams for b in buckets(g))
    assert counts.tolist() == [want.get(b, 0) for b in range(10_000)]
    assert per.tolist() == [len(g) for g in grams]


def test_features(texts, monkeypatch):
    every = ODD + [x or "" for x in texts.values()]
    check_features(every)
    monkeypatch.setattr(importance, "BLOCK", 7)
    check_features(every[:40])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_features_of_any_texts(texts):
    check_features(texts)


def test_query(spark, sf_dir, texts):
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = op13_importance(spark, sf_dir).collect()
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in rows}
    assert got == expected(texts.items(), target) and len(rows) == len(texts)
    assert any(v[3] for v in got.values())


def test_many_rows_and_ties(spark):
    """Ranks over several ranges, with a third of the rows of one key, and the drawn rows themselves."""
    text = "some words of a text that goes on for as long as it takes to be drawn from all of these rows"
    docs = spark.range(900).selectExpr("if(id % 3 = 0, 7, id) doc_id", f"concat('{text} ', if(id % 3 = 0, 0, id % 50)) text", "id as RANK").repartition(9)
    target = spark.createDataFrame([(text,)], "text string")
    rows = importance.report(docs, target, percent=40).collect()
    ranks = sorted(r["rank"] for r in rows if r["rank"])
    assert ranks == list(range(1, 361)) and len(rows) == 900
    order = [(-r.score, r.doc_id) for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])]
    assert order == sorted(order) and max(order) <= min((-r.score, r.doc_id) for r in rows if not r["rank"])
    drawn = importance.resampled(docs, target, percent=40)
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in rows if (-r.score, r.doc_id) <= max(order))


def test_tables(spark, edge, empty):
    target = spark.createDataFrame([("the cat sat",), (None,)], "text string")
    rows = importance.report(edge, target).collect()
    assert len(rows) == edge.count() and all(r.n_features == 0 and r.weight == 0 for r in rows if r.doc_id in (2, 3, 5))
    clash = edge.withColumnRenamed("n", "weight").withColumnRenamed("b", "N_WORDS").withColumnRenamed("x", "a.b")
    assert importance.resampled(clash, target, percent=100).columns == clash.columns
    assert importance.report(empty, target).collect() == [] == importance.resampled(empty, target).collect()
    assert importance.report(edge, target.where("false")).count() == edge.count()
