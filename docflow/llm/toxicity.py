"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are words of letters, in lower case, and their first 4, 5 and 6 letters, each as log(1 + count) over
the whole text. P(grade >= k) is the logistic of w.x - t_k, with one weight vector for all thresholds
t_1 < t_2 < t_3; the severity is the expected grade, the sum of these probabilities.

Fitting: labels tell toxic from clean only, so the grades are 0 for clean rows and 1 to 3 for toxic ones by
terciles of how often they use the features that set toxic rows apart. At most FIT_ROWS labelled keys of each
kind, those of lowest hash, are fitted on, each by one text; of these come all features that pass the thresholds.
Everything else covers all rows and whole texts. A key that several labels or texts have counts once: as toxic if
one label says so, by the text of lowest hash.

Defined results: null and empty texts have severity 0 (as have all texts if no label is toxic). Rows with a
null key or label aren't fitted on. Equal texts have equal severities. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import WordCache, forget, mapped, own, slices, text_or_empty, written

#: The bound of fitting, documented above.
FIT_ROWS = 4000
#: A feature must be that much likelier in toxic rows of the sample, by a log-likelihood ratio of at least this
#: (20: chance gives one such feature in some hundred thousand).
LEAST_LOG_ODDS, LEAST_RATIO = 2.0, 20.0
GRADES = 4
CUT = 0.5
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Words that a worker's cache holds; results don't depend on it.
CACHE_WORDS = 700_000


def features_of(word: str) -> list[str]:
    """Features of a word: itself, marked, and its prefixes."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


@dataclass
class OrdinalModel:
    """Weights by feature and the thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def severity(self, counts: dict[str, int]) -> float:
        """Expected grade of a text from the counts of its features; 0 without any."""
        if not counts:
            return 0.0
        x = sum(self.weights[f] * np.log1p(n) for f, n in sorted(counts.items()))
        return float(sum(1 / (1 + np.exp(min(50.0, t - x))) for t in self.thresholds))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, weight: np.ndarray, width: int, steps: int = 600, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative logit, by gradient steps with adaptive moments on the whole sample.

    rows, cols, values: the sparse matrix of the sample, weight: of its rows; thresholds are a start and positive gaps.
    """
    n, k = len(grades), GRADES - 1
    w, t = np.zeros(width), np.array([1.0, *[0.0] * (k - 1)])
    moment, square = np.zeros(width + k), np.zeros(width + k)
    for step in range(1, steps + 1):
        gap = np.exp(t[1:])
        cut = t[0] + np.concatenate([[0.0], np.cumsum(gap)])
        score = np.bincount(rows, w[cols] * values, n)
        above = 1 / (1 + np.exp(np.clip(cut[None, :] - score[:, None], -50, 50)))
        error = (above - (grades[:, None] > np.arange(k))) * weight[:, None] / weight.sum()
        to_cut = -error.sum(axis=0)
        to_gap = np.cumsum(to_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(cols, error.sum(axis=1)[rows] * values, width) + l2 * w, [to_gap[0]], to_gap[1:] * gap])
        moment, square = 0.9 * moment + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        change = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, t = w - change[:width], t - change[width:]
    return w, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> OrdinalModel:
    """Fits on a bounded sample; the driver sees the features that pass and the sample's use of them."""
    known = labels.select(F.col(key).alias("key"), (F.col(label) > 0).alias("toxic")).where("key is not null and toxic is not null")
    known = known.groupBy("key").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("key", F.lit(5))
    sample = known.where("toxic").orderBy(order, "key").limit(FIT_ROWS).unionByName(known.where("not toxic").orderBy(order, "key").limit(FIT_ROWS))
    texts = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).join(F.broadcast(sample), "key")
    texts = texts.groupBy("key", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))

    def count(batches):
        for b in slices(batches, 1, rows=256, limit=1 << 20):
            names, numbers = [], []
            for x in b.column(1).to_pylist():
                counts: dict[str, int] = {}
                for word in LETTERS.findall(x.lower()):
                    for f in features_of(word):
                        counts[f] = counts.get(f, 0) + 1
                names.append(list(counts))
                numbers.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int64()))], names=["key", "toxic", "f", "n"])

    used = written(texts.select(F.col("key").cast("long").alias("key"), "text", "toxic").mapInArrow(count, "key long, toxic boolean, f array<string>, n array<long>"), "features")
    size = used.agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).first()
    if not size.a or not size.b:
        return OrdinalModel({}, [0.0] * (GRADES - 1))
    flat = used.select("key", "toxic", F.explode(F.arrays_zip("f", "n")).alias("u")).select("key", "toxic", "u.f", "u.n")
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5))
    a, b, n = F.col("a"), F.col("b"), size.a + size.b
    part = lambda c, share: F.when(c > 0, c * F.log(c / ((a + b) * share))).otherwise(0.0)
    best = (
        flat.groupBy("f").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
        .where(odds("a", size.a) - odds("b", size.b) >= LEAST_LOG_ODDS)
        .withColumn("ratio", 2 * (part(a, size.a / n) + part(b, size.b / n)))
        .where(F.col("ratio") >= LEAST_RATIO)
        .select("f")
    )
    names = sorted(r.f for r in best.collect())
    if not names:
        return OrdinalModel({}, [0.0] * (GRADES - 1))
    index = {f: k for k, f in enumerate(names)}
    chosen = docs.sparkSession.createDataFrame([(f,) for f in names], "f string")
    seen = sorted((r.key, r.f, r.n) for r in flat.join(chosen, "f").select("key", "f", "n").collect())
    keys = sorted((r.key, r.toxic) for r in used.select("key", "toxic").collect())
    place = {k: i for i, (k, _) in enumerate(keys)}
    rows = np.array([place[k] for k, _, _ in seen], np.int64)
    cols = np.array([index[f] for _, f, _ in seen], np.int64)
    values = np.log1p(np.array([n for *_, n in seen], float))
    toxic = np.array([y for _, y in keys], bool)
    use = np.bincount(rows, values, len(keys))
    low, high = np.quantile(use[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + (use > low) + (use > high), 0)
    every = known.agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).first()
    forget(used)
    weight = np.where(toxic, every.a / size.a, every.b / size.b)  # the sample has as many of each kind as it may
    w, t = fit_ordinal(rows, cols, values, grades, weight, len(names))
    return OrdinalModel({f: float(x) for f, x in zip(names, w, strict=True)}, t.tolist())


class Scorer:
    """Applies a model to texts; keeps by word which of its features the model has."""

    def __init__(self, model: OrdinalModel):
        self.model, self.cache = model, WordCache(CACHE_WORDS)

    def severities(self, texts: list[str]) -> list[float]:
        words = [LETTERS.findall(x.lower()) for x in texts]
        weights = self.model.weights
        known = self.cache.known(set().union(*words), lambda fresh: [tuple(f for f in features_of(w) if f in weights) for w in fresh])
        found = []
        for x in words:
            counts: dict[str, int] = {}
            for hit in filter(None, map(known.__getitem__, x)):
                for f in hit:
                    counts[f] = counts.get(f, 0) + 1
            found.append(self.model.severity(counts))
        return found


def scored(docs: DataFrame, model: OrdinalModel, text: str = "text", into: str = "severity") -> DataFrame:
    """Adds the severity of each whole text, 0 to GRADES - 1; a column of that name is replaced.

    The model is the weights of features of a bounded sample, so it goes with the function.
    """
    kept = [c for c in docs.columns if c != into]
    plain = docs.select(*own(kept), text_or_empty(text).alias("__text"))
    schema = docs.select(*own(kept), F.lit(0.0).alias(into)).schema

    def run(batches):
        scorer = Scorer(model)
        for b in slices(batches, len(kept), rows=256, limit=1 << 20):
            found = scorer.severities(b.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(found, pa.float64())], names=[*kept, into])

    return mapped(plain, run, schema)


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, severity, grade and whether it is rejected; texts stay out of the result."""
    model = fit(docs, labels, key, text)
    rows = scored(docs.select(F.col(key), text_or_empty(text).alias("text")), model, into="text")
    return rows.select(key, F.round("text", 6).alias("severity"), F.round("text").cast("int").alias("grade"), (F.col("text") >= CUT).alias("toxic"))


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows below the cut, with their own columns."""
    return scored(docs, fit(docs, labels, key, text), text, "__severity").where(F.col("__severity") < CUT).select(*own(docs.columns))
