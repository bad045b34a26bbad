"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in the order of a hash of key and text, are cut into blocks of block_bytes. A source of weight w gets
T(i / w) slots for its first i blocks, where T(v) is the number of slots at which every source s has had w(s) * v
blocks, or all of its own if these are fewer. Its i-th block has the release time floor(T((i - 1) / w)) and the
deadline ceil(T(i / w)). Of the released blocks the one of earliest deadline takes the next slot. At any slot the
rates of the sources sum to 1, so every block is placed within its window, and each source has its share of the
slots to less than one block, from the first slot to the last. Weights are taken exactly as given, as fractions.

A phase ends at the slot at which a source has run out; the others go on with their weights scaled up, so every
row is placed once and none is repeated. One rule holds for any number of sources: one task takes the sources by
falling weight and keeps only those that have begun and have blocks left, and the distinct sizes of sources, of
which there are at most block_bytes and one for each source of several blocks. Blocks find their slots by a join.

Defined results: a null source is a source of its own. Null and empty texts count 1 byte. A row longer than a
block is in the block in which it starts, and the blocks that it runs over keep their slots. Repeated rows are
placed one by one. An empty table gives an empty table. Sources of weight 0 (those not given, if the given
weights leave nothing) follow when all others have run out, in shares of their bytes.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.common import forget, own, text_or_empty, written

#: Bytes of input, as estimated, for each of the ranges of the random order in which every source is summed and
#: numbered, and how many ranges there are at least and at most (as powers of two). Results don't depend on these.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 8 << 20, 6, 24
#: Blocks that the scheduling task hands over at once.
BATCH = 1 << 16


class Ends:
    """T by phases, from the distinct (weight, blocks) of all sources and how many sources have them.

    Phase k lies before the k-th end, at blocks[k] / weights[k]; in it T(v) = done[k] + rate[k] * v.
    """

    def __init__(self, sizes: dict[tuple[float, int], int]):
        exact = {w: Fraction(w) for w, _ in sizes}
        self.scale = max((x.denominator for x in exact.values()), default=1)
        found = [(n, self.whole(w), c) for (w, n), c in sizes.items()]
        found.sort(key=cmp_to_key(lambda a, b: a[0] * b[1] - b[0] * a[1]))
        self.blocks, self.weights, self.done, self.rate = [], [], [], []
        done, rate = 0, sum(w * c for _, w, c in found)
        starts = set()
        for n, w, c in found:
            if not self.blocks or n * self.weights[-1] != self.blocks[-1] * w:
                self.blocks.append(n)
                self.weights.append(w)
                self.done.append(done)
                self.rate.append(rate)
                starts.add(done - (-rate * n // w))
            done, rate = done + n * c, rate - w * c
        #: Slots at which the phases after the first begin.
        self.starts = sorted(starts)
        self.slots = done

    def whole(self, weight: float) -> int:
        """The weight in units in which all are whole: denominators of floats are powers of two."""
        x = Fraction(weight)
        return x.numerator * (self.scale // x.denominator)

    def phase(self, k: int, i: int, w: int) -> int:
        """The phase of i / w, sought from phase k."""
        while self.blocks[k] * w < i * self.weights[k]:
            k += 1
        while k and self.blocks[k - 1] * w >= i * self.weights[k - 1]:
            k -= 1
        return k


def scheduled_blocks(sources: Iterable[tuple[str, float, int]], ends: Ends) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, slot, phase) in order of slots, from (source, weight, blocks) by falling weight."""
    ready: list[tuple] = []
    later: list[tuple] = []
    k0 = 0

    def window(number, s, i, n, w, k):
        """Block i from 0 with its deadline first and the release of the next one last."""
        k = ends.phase(k, i + 1, w)
        at = ends.done[k] * w + ends.rate[k] * (i + 1)
        return -(-at // w), number, s, i, n, w, k, at // w

    def firsts():
        nonlocal k0
        for number, (s, weight, n) in enumerate(sources):
            found = window(number, s, 0, n, ends.whole(weight), k0)
            k0 = found[6]
            yield found

    new = firsts()
    first = next(new, None)
    number = 0
    for t in range(ends.slots):
        while later and later[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(later)[1])
        if first is not None and (not ready or first[:2] < ready[0][:2]):
            block, first = first, next(new, None)
        else:
            block = heapq.heappop(ready)
        deadline, of, s, i, n, w, k, after = block
        if t >= deadline:
            raise AssertionError("a block missed its deadline")
        while number < len(ends.starts) and ends.starts[number] <= t:
            number += 1
        yield s, i, t, number
        if i + 1 < n:
            heapq.heappush(later, (after, window(of, s, i + 1, n, w, k)))


def _scheduled(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int]]:
    """The schedule of sources at hand."""
    sources = [(s, weights[s], n) for s, n in blocks.items() if n > 0]
    return scheduled_blocks(sorted(sources, key=lambda x: (-x[1], x[0])), Ends(Counter((w, n) for _, w, n in sources)))


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[tuple]:
    """Rows (phase, source, first block, block after the last)."""
    found: dict[tuple[int, str], tuple[int, int]] = {}
    for s, i, _, number in _scheduled(blocks, weights):
        found[number, s] = found.get((number, s), (i, i))[0], i + 1
    return [(number, s, a, b) for (number, s), (a, b) in found.items()]


def _plan_bytes(docs: DataFrame) -> int:
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _plan(total: DataFrame, given: dict[str, float], exponent: float, block_bytes: int) -> DataFrame:
    """(__class, __block, __slot, __phase) of all blocks, from (__class, bytes) by source."""
    if any(not 0 <= w < float("inf") for w in given.values()):
        raise ValueError("weights must be finite and not below 0")
    spare = max(0.0, 1.0 - sum(given.values()))
    own = F.col("__class").isin(list(given)) if given else F.lit(False)
    known = {r["__class"]: r["bytes"] for r in total.where(own).collect()}
    sizes = {r["bytes"]: r["n"] for r in total.where(~own).groupBy("bytes").agg(F.count("*").alias("n")).collect()}
    rest = sum(b * n for b, n in sizes.items()) or 1
    late = bool(given) and spare == 0

    def weight(size: int) -> float:
        """Of a source without a given weight."""
        return float(size) if late else spare * size / rest if given else float(size) ** exponent

    count = lambda size: -(-size // block_bytes)
    named = [[(s, given[s], count(b)) for s, b in known.items() if given[s] > 0], [(s, float(b), count(b)) for s, b in known.items() if given[s] == 0]]
    others = Counter()
    for b, n in sizes.items():
        others[weight(b), count(b)] += n
    ends = [Ends(Counter((w, n) for _, w, n in x) + (others if k == late else Counter())) for k, x in enumerate(named)]
    order = lambda x: (-x[1], x[0])

    def run(batches):
        stream = ((s, weight(b), count(b)) for pdf in batches for s, b in zip(pdf["__class"], pdf["bytes"].tolist(), strict=True))
        slot = phase = 0
        for k in range(2):
            own = sorted(named[k], key=order)
            batch = []
            for s, i, t, p in scheduled_blocks(heapq.merge(own, stream, key=order) if k == late else own, ends[k]):
                batch.append((s, i, slot + t, phase + p))
                if len(batch) == BATCH:
                    yield pd.DataFrame(batch, columns=["__class", "__block", "__slot", "__phase"])
                    batch = []
            if batch:
                yield pd.DataFrame(batch, columns=["__class", "__block", "__slot", "__phase"])
            slot, phase = slot + ends[k].slots, phase + len(ends[k].starts)

    falls = F.col("bytes").asc() if not given and exponent < 0 else F.col("bytes").desc()
    one = total.where(~own).coalesce(1).sortWithinPartitions(falls, "__class")
    return written(one.mapInPandas(run, "__class string, __block long, __slot long, __phase int"), "plan")


def scheduled(
    docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, block_bytes: int = 1 << 16, key: str = "doc_id", source: str = "source", text: str = "text", kept: list[str] | None = None
) -> DataFrame:
    """Adds __class, __phase, __block, __slot and __offset (bytes from the start of the block) to the kept columns.

    weights: by source; without them, a source's weight is its bytes to the power of exponent.
    """
    kept = [key, source] if kept is None else kept
    bits = max(LEAST_BITS, min(MOST_BITS, (_plan_bytes(docs) // BUCKET_BYTES).bit_length()))
    name = F.concat(F.lit("s"), F.col(source).cast("string"))
    name = F.coalesce(name, F.lit("null"))
    order = F.xxhash64(F.col(key), text_or_empty(text))
    made = [
        F.greatest(F.octet_length(text_or_empty(text)), F.lit(1)).cast("long").alias("__size"),
        order.alias("__order"),
        F.shiftrightunsigned(order, 64 - bits).cast("int").alias("__bucket"),
        name.alias("__class"),
    ]
    rows = docs.select(*own(kept), *made)
    given = {"s" + s: w for s, w in (weights or {}).items()}
    sums = written(rows.groupBy("__class", "__bucket").agg(F.sum("__size").alias("bytes")), "sums")
    total = written(sums.groupBy("__class").agg(F.sum("bytes").alias("bytes")), "totals")
    plan = _plan(total, given, exponent, block_bytes)

    before = Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("__class", "__bucket", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__start"))
    first, last = F.floor(F.col("__start") / block_bytes), F.floor((F.col("__start") + F.col("bytes") - 1) / block_bytes)
    held = start.select("__class", "__bucket", "__start", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("__block"))
    found = F.array_sort(F.collect_list(F.struct("__block", "__slot", "__phase")))
    start = held.join(plan, ["__class", "__block"]).groupBy("__class", "__bucket", "__start").agg(found.alias("__slots"))
    inside = Window.partitionBy("__class", "__bucket").orderBy("__order", key).rowsBetween(Window.unboundedPreceding, -1)
    start = written(start, "starts")
    forget(sums, total, plan)
    rows = rows.withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(start, ["__class", "__bucket"])
    at = F.col("__start") + F.col("__before")
    rows = rows.withColumn("__block", F.floor(at / block_bytes).cast("long")).withColumn("__offset", at - F.col("__block") * block_bytes)
    place = F.element_at("__slots", (F.col("__block") - F.col("__slots")[0]["__block"]).cast("int") + 1)
    rows = rows.withColumn("__slot", place["__slot"]).withColumn("__phase", place["__phase"])
    return rows.select(*own(kept), "__class", "__phase", "__block", "__slot", "__offset", "__order")


def report(docs: DataFrame, key: str = "doc_id", source: str = "source", **more) -> DataFrame:
    """Per row its key, source, phase, block, slot and offset."""
    rows = scheduled(docs, key=key, source=source, **more)
    return rows.select(key, source, *[F.col("__" + c).alias(c) for c in ("phase", "block", "slot", "offset")])


def mixed(docs: DataFrame, key: str = "doc_id", **more) -> DataFrame:
    """All rows and columns in the order of the mix: ranges of slots by partition, ordered within."""
    rows = scheduled(docs, key=key, kept=docs.columns, **more)
    dealt = rows.repartitionByRange("__slot", "__offset").sortWithinPartitions("__slot", "__offset", "__order", key)
    return dealt.select(*own(docs.columns))

