"""Near-duplicates by b-bit MinHash: classes, band candidates, corrected estimates, exact links, components.

1. Signatures. A document is the set of its word shingles. Of PERMUTATIONS minima the low BITS bits are kept
   and packed; bands of ROWS minima give the band keys. A digest of the whole set stands for it.
2. Classes. Documents of equal sets are one class, known by its least key; copies go no further.
3. Candidates. Classes that share a band key are candidates of each other. Each is joined to the least class of
   that band key, as a star and not as pairs; the connected components of the stars are the clusters.
4. Links. A cluster goes to one task with its texts. There the packed signatures of candidates are compared by bit
   counts; the share of equal low bits, less what chance gives, estimates the similarity. Pairs that may be similar,
   and that known links don't yet join, are checked on their full sets. A cluster of more weight than UNIT is dealt
   by the least classes of its stars: first each class is compared with these alone; then stars that this has not
   yet made one component are compared in pairs of blocks, but for blocks that it has. A text is sent once for each
   of its stars and rounds, not for each band, and no task holds more than a unit. Both ways compare the same pairs:
   those that share a band key, of which those that are joined already can add nothing.
5. Components. The links of all tasks are joined to components, named by their least key.

A pair at the threshold shares no band key with a probability of (1 - s^ROWS)^(PERMUTATIONS // ROWS), 3e-6 at
0.8 and 2e-9 at 0.85; the estimate passes a pair over at more than five deviations, 3e-7.

Defined results: words are what is between the white space 09-0D and 20, with A-Z in lower case. A text of
fewer words than a shingle has its whole sequence as one shingle. Null and empty texts and those without words
have the empty set and are linked with nothing. Repeated rows are in one component. Rows with a null key are
kept, with a null component unless copies give one. Rows of one key and different texts are compared each by its
own text. Keys are integers. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import forget, free, own, quoted, slices, text_or_empty, written
from docflow.llm.components import components

PERMUTATIONS, BITS, ROWS = 256, 4, 6
BANDS = PERMUTATIONS // ROWS
DEVIATIONS = 5.0
#: Weight that a task holds at most (shingles, and EACH for every class), signatures that it compares with all
#: others at a time, and members of sets that it keeps for the checks.
UNIT, EACH, STRIPE, HELD = 2_000_000, 250, 256, 400_000
#: Bytes beyond which a word is hashed alone.
LONG_WORD = 1024
#: Shingles hashed by all permutations at a time.
CHUNK = 1 << 15
#: Hashes made at a time of all these: many permutations of few shingles, or one of many.
TABLE = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (shift, multiply, thrice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each word, of eight bytes after the other for all words at once."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size, at = np.diff(ends), ends[:-1]
    hashes = _mixed((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    if not ends[-1] - ends[0]:
        return hashes
    padded = np.concatenate([np.frombuffer(data, np.uint8)[: ends[-1]], np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    for k in np.flatnonzero(size > LONG_WORD):
        hashes[k] = int.from_bytes(hashlib.blake2b(padded[at[k] : ends[k + 1]], digest_size=8).digest(), "little")
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, size = at[live], size[live]
    while len(live):
        lane = lanes[at]
        short = size < 8
        lane[short] &= (np.uint64(1) << (8 * size[short]).astype(np.uint64)) - np.uint64(1)
        hashes[live] = _mixed((hashes[live] ^ lane) * np.uint64(0x9E3779B97F4A7C15))
        more = size > 8
        live, at, size = live[more], at[more] + 8, size[more] - 8
    return hashes


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes. Of a batch each distinct word is hashed once."""

    def __init__(self, size: int):
        self.size = size

    def sets(self, texts: pa.Array | list) -> list[np.ndarray]:
        """The set of each text."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = split.flatten().dictionary_encode()
        real = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)
        at = flat.indices.to_numpy(zero_copy_only=False)
        whole = real[at]
        words = word_hashes(flat.dictionary)[at[whole]]
        first = split.offsets.to_numpy()
        start = np.concatenate([[0], np.cumsum(whole)])[first - first[0]].tolist()
        rolled = self._rolled(words, self.size) if len(words) >= self.size else words[:0]
        found = []
        for a, b in zip(start, start[1:], strict=False):
            n = b - a
            found.append(np.unique(rolled[a : b - self.size + 1]) if n >= self.size else self._rolled(words[a:b], n) if n else words[:0])
        return found

    @staticmethod
    def _rolled(words: np.ndarray, k: int) -> np.ndarray:
        """The hashes of all runs of k words."""
        n = len(words) - k + 1
        hashes = np.full(n, k, np.uint64)
        for i in range(k):
            hashes = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
        return hashes


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the permutations of 32-bit numbers."""
    draw = _mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return draw[:PERMUTATIONS].astype(np.uint32), draw[PERMUTATIONS:].astype(np.uint32) | np.uint32(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Least permuted values of nonempty sets, (sets, PERMUTATIONS)."""
    masks, factors = permutations()
    out = np.full((len(sets), PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    k = 0
    while k < len(sets):
        end, total = k, 0
        while end < len(sets) and (end == k or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        some = np.concatenate([x.astype(np.uint32) for x in sets[k:end]])
        starts = np.cumsum([0, *(len(x) for x in sets[k : end - 1])])
        step = max(1, TABLE // len(some))
        for p in range(0, PERMUTATIONS, step):
            table = (some ^ masks[p : p + step, None]) * factors[p : p + step, None]
            out[k:end, p : p + step] = np.minimum.reduceat(table, starts, axis=1).T
        k = end
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, packed into bytes."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << BITS)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minima."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), 1))
    for r in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r : BANDS * ROWS : ROWS])
    return key


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarities estimated from packed signatures as 64-bit words: (signatures, others).

    The share of equal low bits is J + (1 - J) 2^-BITS; this is solved for J.
    """
    equal = np.zeros((len(one), len(others)), np.int32)
    lows = np.uint64(0x1111111111111111)
    for w in range(one.shape[1]):
        x = one[:, w][:, None] ^ others[:, w][None, :]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        equal += 16 - np.bitwise_count(x & lows).astype(np.int32)
    chance = 2.0**-BITS
    return (equal / PERMUTATIONS - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """The estimate below which a pair at the threshold is, at more than DEVIATIONS standard deviations."""
    chance = 2.0**-BITS
    share = threshold + (1 - threshold) * chance
    return threshold - DEVIATIONS * (share * (1 - share) / PERMUTATIONS) ** 0.5 / (1 - chance)


def links(keys: np.ndarray, side: np.ndarray, known: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of classes to the least of those that verified links join them to: a star for each component.

    side: 0 for classes that are compared with all, else of two blocks only pairs across them are. known: the
    components that links have made before.
    """
    n = len(keys)
    if n < 2:
        return []
    order = np.argsort(keys, kind="stable")
    size = np.array([len(x) for x in sets])
    least = minima(sets)
    words, bands = np.ascontiguousarray(packed(least)).view(np.uint64), band_keys(least)
    floor, component = least_estimate(percent / 100), np.unique(known, return_inverse=True)[1]
    held: dict[int, set] = {}

    def of(i: int) -> set:
        if i not in held:
            if len(held) % 64 == 63 and sum(map(len, held.values())) > HELD:
                held.clear()
            held[i] = set(sets[i].tolist())
        return held[i]

    for start in range(0, n, STRIPE):
        rows, rest = order[start : start + STRIPE], order[start:]
        likely = estimates(words[rows], words[rest])
        likely[np.tri(len(rows), len(rest), 0, dtype=bool)] = -1
        a, b = size[rows][:, None], size[rest][None, :]
        likely[100 * np.minimum(a, b) < percent * np.maximum(a, b)] = -1
        likely[(side[rows][:, None] == side[rest][None, :]) & (side[rows][:, None] != 0)] = -1
        for i, guess in zip(rows, likely, strict=True):
            near = np.flatnonzero(guess >= floor)
            near = rest[near[np.argsort(-guess[near], kind="stable")]]
            near = near[component[near] != component[i]]
            near = near[(bands[near] == bands[i]).any(axis=1)]
            while len(near):
                j, near = near[0], near[1:]
                both = len(of(int(i)) & of(int(j)))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    component[component == component[j]] = component[i]
                    near = near[component[near] != component[i]]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, component, keys)
    return [(int(k), int(m)) for k, m in zip(keys, least[component], strict=True) if k != m]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SIGNED = "key bigint, row bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"


def _row(key: str, text: str) -> Column:
    """What tells rows of one key apart: a hash of the text, and whether text and key are null."""
    return F.xxhash64(F.col(quoted(text)), F.col(quoted(text)).isNull(), F.col(quoted(key)).isNull())


def signatures(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """Per row: key, a hash of its text, size of its set, a 128-bit digest of the set, band keys (null for the empty set)."""
    plain = docs.select(F.col(quoted(key)).cast("long").alias("key"), text_or_empty(text).alias("text"), _row(key, text).alias("row"))

    def run(batches):
        shingler = Shingler(words)
        for b in slices(batches, 1, rows=4096, limit=4 << 20):
            sets = shingler.sets(b.column(1))
            full = [k for k, x in enumerate(sets) if len(x)]
            keys = band_keys(minima([sets[k] for k in full])).view(np.int64) if full else np.zeros((0, BANDS), np.int64)
            bands: list[np.ndarray | None] = [None] * len(sets)
            for k, row in zip(full, keys, strict=True):
                bands[k] = row
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bands, pa.list_(pa.int64()))],
                names=["key", "row", "n", "d1", "d2", "bands"],
            )

    return plain.mapInArrow(run, SIGNED)


def _linked(units: DataFrame, words: int, percent: int) -> DataFrame:
    """Links found within each unit; units: (unit, key, side, known, text). A task holds the sets of one unit."""
    dealt = units.select("unit", "key", "side", "known", "text").repartition("unit").sortWithinPartitions("unit")

    def solved(rows: dict[tuple, np.ndarray]) -> list[tuple[int, int]]:
        keys, side, known = (np.array([k[c] for k in rows], np.int64) for c in range(3))
        return links(keys, side, known, list(rows.values()), percent)

    def run(batches):
        shingler, unit, rows, found = Shingler(words), None, {}, []
        for b in slices(batches, 4, rows=4096, limit=4 << 20):
            names, *rest = (b.column(c).to_pylist() for c in range(4))
            for name, x, set_ in zip(names, zip(*rest, strict=True), shingler.sets(b.column(4)), strict=True):
                if name != unit:
                    found += solved(rows)
                    unit, rows = name, {}
                    if len(found) >= 4096:
                        yield pa.RecordBatch.from_pylist([{"a": i, "b": j} for i, j in found], schema=LINKS)
                        found = []
                rows[*x, hash(set_.tobytes())] = set_  # rows of one key and one set are one
        found += solved(rows)
        yield pa.RecordBatch.from_pylist([{"a": i, "b": j} for i, j in found], schema=LINKS)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """Per row: key, n_shingles, component_id (least key of its component) and kept (whether that is its own key).

    Two sets are linked if 100 * size of the intersection >= percent * size of the union.
    """
    rows = _members(docs, words, percent, key, text, unit)
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def _members(docs: DataFrame, words: int, percent: int, key: str, text: str, unit: int) -> DataFrame:
    """(key, row, n, component) of all rows."""
    signed = written(signatures(docs, words, key, text), "signatures")
    sets = ["n", "d1", "d2"]
    classes = signed.groupBy(*sets).agg(F.min("key").alias("class"))
    class_ = written(classes, "classes")
    heads = class_.where("n > 0 and class is not null")
    banded = signed.join(heads.select(*sets, F.col("class").alias("key")), [*sets, "key"], "left_semi")
    keys = banded.select("key", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("m")).where("m > 1")
    stars = written(keys.join(shared.select("band", "head"), "band").select("key", "head").distinct(), "stars")
    cluster = components(stars.select(F.col("key").alias("a"), F.col("head").alias("b")))
    nodes = written(cluster.join(heads.groupBy(F.col("class").alias("node")).agg(F.max("n").alias("n")), "node").select(F.col("node").alias("key"), "root", (F.col("n") + EACH).alias("w")), "nodes")
    weight = nodes.groupBy("root").agg(F.sum("w").alias("total"))
    small = nodes.join(weight.where(F.col("total") <= unit), "root").select("key", F.concat_ws(":", F.lit("c"), "root").alias("unit"), *_alone())
    large = nodes.join(weight.where(F.col("total") > unit), "root", "left_semi").select("key", "w")
    texts = docs.select(F.col(quoted(key)).cast("long").alias("key"), text_or_empty(text).alias("text")).hint("merge")
    found = [written(_linked(small.join(texts, "key"), words, percent), "links")]
    if not large.isEmpty():
        stars_ = written(stars.join(large, "key"), "large")
        found.append(written(_linked(_spokes(stars_, unit).join(texts, "key"), words, percent), "links"))
        joined = components(found[-1])
        found.append(written(_linked(_blocks(stars_, joined, unit).join(texts, "key"), words, percent), "links"))
        forget(stars_)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    roots = components(every)
    forget(stars, nodes, *found)
    of_class = class_.select(*sets, "class").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select(*sets, F.coalesce("root", "class").alias("root"))
    rows = signed.select("key", "row", *sets).join(of_class, sets)
    return rows.select("key", "row", "n", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("key")).alias("component"))


def _alone() -> list[Column]:
    """side and known of classes that are compared with all of their unit."""
    return [F.lit(0).cast("long").alias("side"), F.col("key").alias("known")]


def _spokes(stars: DataFrame, unit: int) -> DataFrame:
    """Units in which each class of a star (key, head, w) is compared with the star's head, by blocks of classes."""
    weight = stars.groupBy("head").agg(F.ceil(F.sum("w") * 2 / F.lit(unit)).cast("int").alias("blocks"))
    rows = stars.join(weight, "head")
    block, sequence = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    hub = F.col("key") == F.col("head")
    rows = rows.select("key", "head", F.when(hub, 1).otherwise(2).cast("long").alias("side"), F.explode(F.when(hub, sequence).otherwise(F.array(block))).alias("block"))
    return rows.select("key", F.concat_ws(":", F.lit("s"), "head", "block").alias("unit"), "side", F.col("key").alias("known"))


def _blocks(stars: DataFrame, joined: DataFrame, unit: int) -> DataFrame:
    """Units of stars that links haven't made one component: pairs of blocks of classes, of which one at least isn't
    joined to the star's head; joined: (node, root)."""
    rows = stars.join(joined.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("known", F.coalesce("root", "key"))
    hub = F.max(F.when(F.col("key") == F.col("head"), F.col("known")))
    of_star = rows.groupBy("head").agg(hub.alias("hub"), F.sum("w").alias("total"))
    rows = rows.join(of_star, "head").withColumn("out", F.col("known") != F.col("hub"))
    size = rows.groupBy("head").agg(F.sum(F.when(F.col("out"), F.col("w")).otherwise(0)).alias("apart"), F.max("total").alias("total")).where("apart > 0")
    count = lambda w: F.ceil(w * 4 / F.lit(unit)).cast("int")
    whole = F.col("total") <= unit
    size = size.select("head", F.when(whole, 1).otherwise(count(F.col("apart"))).alias("outs"), F.when(whole, 0).otherwise(count(F.col("total") - F.col("apart"))).alias("ins"))
    rows = rows.join(size, "head")
    deal = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("out") | (F.col("ins") == 0), deal(F.col("outs"))).otherwise(F.col("outs") + deal(F.greatest(F.col("ins"), F.lit(1)))))
    last = F.when(F.col("mine") < F.col("outs"), F.col("outs") + F.col("ins") - 1).otherwise(F.col("outs") - 1)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return rows.select("key", F.concat_ws(":", F.lit("b"), "head", low, high).alias("unit"), side.cast("long").alias("side"), "known")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, unit: int = UNIT) -> DataFrame:
    """The rows of docs that stay: of each component one of least key; rows without words and rows without a key, less
    their repetitions. Of several rows of that key in the component, and of repeated rows, one stays.

    Rows are found again by their key and a hash of their text, so that a key's other texts don't keep a duplicate; texts
    are sent once, as the join deals them as the repetitions want it.
    """
    found = _members(docs, words, percent, key, text, unit).where(F.col("key").eqNullSafe(F.col("component")))
    alone = F.when((F.col("n") == 0) | F.col("key").isNull(), F.col("row"))
    name, row = free(docs.columns, "key", "row")
    kept = found.groupBy("key", alone.alias("alone")).agg(F.min("row").alias(row)).select(F.coalesce("key", F.lit(0)).alias(name), row)
    rows = docs.select("*", F.coalesce(F.col(quoted(key)).cast("long"), F.lit(0).cast("long")).alias(name), _row(key, text).alias(row))
    return rows.join(kept, [name, row], "left_semi").dropDuplicates([name, row]).select(*own(docs.columns))
