"""Importance resampling towards a target: documents whose hashed n-grams are likelier in the target's texts than in
the corpus are drawn more often.

Two passes over Arrow batches. The first counts features by bucket: each partition adds np.bincount of its batches to
one vector, and treeReduce merges the vectors of all partitions. From these and the target's counts follows a gain for
each bucket, which is broadcast (as many numbers as there are buckets). The second pass gathers the gain of every
feature and sums them by document with the weights of np.bincount. Scores add noise that only a seed and the key decide
(Gumbel's, so the highest scores are a draw without replacement), and the rows of highest score are the draw.

Words and n-grams aren't built as strings. Words are runs of bytes of a batch; their CRC-32 is taken for all words at
once, byte by byte, and that of an n-gram follows from its parts: crc(xy) = crc(x) moved on by the length of y, xor
crc(y), where moving on is linear and read from tables.

Ranks are places in ranges of the scores: rows are dealt by range and numbered within, and the counts of the ranges
(one number for each, which the driver sees) give where each begins.

Defined results: null and empty texts have no words, weigh 0 and are never drawn; rows without a key take their noise
from the word null. Of equal scores the smaller key is drawn first, and rows of one score and key are drawn in any
order. Repeated rows count and are ranked one by one. An empty table gives an empty table; a target without words gives
every bucket the gain of a smoothed zero.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from docflow.llm.common import free, mapped, own, placed, slices, text_or_empty, written

BUCKETS, SMOOTHING_MILLI, TREE_FAN = 10_000, 1000, 32
#: Bytes of words whose checksums are moved on by one table, and taken step by step for all words at once.
SHORT = 64
#: Words that are worked on at once.
BLOCK = 1 << 18


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The steps of CRC-32 by byte; moves by 0 to SHORT bytes, and by powers of 2, for each byte of a checksum."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
    short = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(SHORT):
        short.append(step[short[-1] & 255] ^ (short[-1] >> 8))
    powers = [short[1]]
    for _ in range(40):
        powers.append(_move(powers[-1][None], powers[-1].ravel(), 0).reshape(4, 256))
    return step, np.array(short), np.array(powers)


def _move(tables: np.ndarray, crc: np.ndarray, which: np.ndarray | int) -> np.ndarray:
    return tables[which, 0, crc & 255] ^ tables[which, 1, crc >> 8 & 255] ^ tables[which, 2, crc >> 16 & 255] ^ tables[which, 3, crc >> 24]


STEP, MOVES, POWERS = _tables()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all of characters beyond ASCII.
OF_WORD = np.zeros(256, bool)
OF_WORD[48:58] = OF_WORD[97:123] = OF_WORD[128:] = True


def moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums as they are when zero bytes follow, less those bytes' own part."""
    out = _move(MOVES, crc, np.minimum(size, SHORT))
    for k in np.flatnonzero(size > SHORT):
        value, rest = crc[k : k + 1], int(size[k])
        for i in range(rest.bit_length()):
            if rest >> i & 1:
                value = _move(POWERS, value, i)
        out[k] = value[0]
    return out


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, first bytes of words, their lengths, how many words each text has); nulls must be gone."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = LOWER[np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]] if len(text) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = OF_WORD[data]
    opens = np.ones(len(data) + 1, bool)
    opens[1:-1] = ~inside[:-1]
    opens[offsets] = True
    start = np.flatnonzero(inside & opens[:-1])
    ends = np.ones(len(data) + 1, bool)
    ends[:-1] = ~inside
    ends[offsets] = True
    size = np.flatnonzero(inside & ends[1:]) + 1 - start
    return data, start, size, np.diff(np.searchsorted(start, offsets))


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    long = int(np.searchsorted(-size[order], -SHORT, side="left")) if len(size) else 0
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]])
    order = order[long:]
    at, width = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-width, -np.arange(1, SHORT + 1), side="right")
    for j, n in enumerate(live.tolist()):
        if not n:
            break
        crc[:n] = STEP[(crc[:n] ^ data[at[:n] + j]) & 255] ^ (crc[:n] >> 8)
    out[order] = ~crc
    return out


def features(text: pa.Array, longest: int = 3, buckets: int = BUCKETS):
    """(numbers of texts, buckets) of all runs of 1 to `longest` words, some words at a time; no run crosses texts."""
    data, start, size, counts = words(text)
    of = np.repeat(np.arange(len(counts)), counts)
    for low in range(0, len(start), BLOCK):
        high = min(len(start), low + BLOCK + longest - 1)
        crc, width, doc = checksums(data, start[low:high], size[low:high]), size[low:high], of[low:high]
        run = crc
        for n in range(min(longest, len(crc))):
            if n:
                spaced = ~(STEP[(~run[:-1] ^ 32) & 255] ^ (~run[:-1] >> 8))
                run = moved(spaced, width[n:]) ^ crc[n:]
            here = np.flatnonzero(doc[: len(run)] == doc[n:])
            here = here[here < BLOCK]
            yield doc[here], (run[here] % buckets).astype(np.int64)


def counted(texts: DataFrame, text: str = "text", longest: int = 3, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket. Partitions' vectors are merged as a tree, so that the driver
    gets a few however many there are."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, 0, rows=1 << 14, limit=2 << 20):
            for _, at in features(b.column(0), longest, buckets):
                total += np.bincount(at, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select(text_or_empty(text).alias("text")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(parts, TREE_FAN))))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm, in thousandths, of how much likelier each bucket is in the target, with one added to each count."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    share = lambda a, b: float(b + 1) * float(s + n) / (float(a + 1) * float(t + n))
    return np.array([math.floor(SMOOTHING_MILLI * math.log(share(a, b))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.float64)


def weighed(docs: DataFrame, gain: np.ndarray, into: tuple[str, str, str] = ("n_words", "n_features", "weight"), text: str = "text", longest: int = 3, kept: list[str] | None = None) -> DataFrame:
    """Adds the words and features of every text and the sum of its features' gains to the kept columns."""
    kept = docs.columns if kept is None else kept
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    schema = docs.select(*own(kept)).schema
    for c in into:
        schema = schema.add(StructField(c, LongType(), False))

    def run(batches):
        gain = sent.value
        for b in slices(batches, len(kept), rows=1 << 14, limit=2 << 20):
            n = b.num_rows
            found, weight = np.zeros(n, np.int64), np.zeros(n)
            for doc, at in features(b.column(len(kept)), longest, len(gain)):
                found += np.bincount(doc, minlength=n)
                weight += np.bincount(doc, gain[at], n)
            made = [pa.array(x.astype(np.int64)) for x in (words(b.column(len(kept)))[3], found, weight)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], names=schema.names)

    return mapped(docs.select(*own(kept), text_or_empty(text).alias("text")), run, schema)


def noise(key: str, seed: int):
    """Gumbel noise in thousandths, from the SHA-256 of the seed and the key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list, into: str) -> DataFrame:
    """Adds the place of each row in the whole order, from 1; rows that tie are in any order."""
    part, first, row = free([*rows.columns, into], "part", "first", "row")
    ranges = placed(rows, order, part, row)
    base, start = [], 0
    for r in ranges.groupBy(part).agg(F.count("*").alias("n"), F.min(row).alias("low")).orderBy(part).collect():
        base.append((r[0], start - r.low + 1))
        start += r.n
    shift = rows.sparkSession.createDataFrame(base, f"{part} long, {first} long")
    return ranges.join(shift, part).select(*own(rows.columns), (F.col(row) + F.col(first)).alias(into))


def _scored(docs: DataFrame, target: DataFrame, key: str, text: str, seed: int, kept: list[str], names: tuple[str, str, str, str]) -> DataFrame:
    gain = gains(counted(docs, text), counted(target))
    return weighed(docs, gain, names[:3], text, kept=kept).withColumn(names[3], F.col(names[2]) + noise(f"`{key}`", seed))


def report(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_features, weight, score, and its rank in the draw if it is drawn.

    The draw is the given percentage, rounded down, of the rows that have enough words. target has a column text.
    """
    rows = written(_scored(docs.select(*own([key, text])), target, key, text, seed, [key], ("n_words", "n_features", "weight", "score")), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    order = [F.desc("score"), F.asc(f"`{key}`"), F.asc("n_features"), F.asc("weight")]
    drawn = ranked(able, order, "rank").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*own([key]), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows, with their own columns. Rows that tie with the last one drawn in score and key are drawn too."""
    ranks = report(docs, target, percent, least_words, seed, key, text)
    last = ranks.where("rank is not null").agg(F.max_by(F.struct("score", F.col(f"`{key}`").alias("key")), "rank").alias("last")).first()["last"]
    if last is None:
        return docs.where("false")
    names = free(docs.columns, "n_words", "n_features", "weight", "score")
    rows = _scored(docs, target, key, text, seed, docs.columns, tuple(names))
    score, own_key = F.col(names[3]), F.col(f"`{key}`")
    before = own_key.isNull() | (own_key <= F.lit(last.key)) if last.key is not None else own_key.isNull()
    return rows.where((F.col(names[0]) >= least_words) & ((score > last.score) | ((score == last.score) & before))).select(*own(docs.columns))
