"""Readings against a vocabulary of any size: the most similar term, through an index of pairs of letters.

Similarity is 200 * L / (m + n) for texts of m and n characters with a common subsequence of L. A text and a term that
reach the threshold differ by few letters, and each of these spoils few pairs of neighbouring letters; so they share at
least so many pairs as `least_shared` says. If each side keeps only its rarest pairs, all but that many less one, one of
them is still shared. Candidates therefore come from an equi-join on (pair, its number within the text), and only these
are compared, by bit-parallel steps over words of 61 bits. Nothing is lost, and frequent pairs are seldom keys.

Short texts keep nearly all their pairs, so the join meets many that are not alike. It therefore drops those that have too
few letters in common, whatever their order: a common subsequence is no longer. Letters are counted in bags of bits, so this
is a few bitwise steps a pair, before anything is sent on.

Where a threshold is so low, or a text so short, that no pair need be shared, keys are single characters: texts that have
any similarity share one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docflow.sources.work import forget, written

WORD = 61
FULL = (1 << WORD) - 1
#: A bag has BAGS words of bits; characters go to its cells by their code, and a cell counts up to CELL of them.
BAGS, CELL = 2, 4
#: Distinct readings that a task compares.
TEXTS = 2000


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def allowed(size: Column, other: Column, threshold: int) -> Column:
    """Whether texts of these sizes can reach the threshold, as the subsequence is at most the shorter one."""
    return 200 * F.least(size, other) >= threshold * (size + other)


def bags(chars: Column) -> list[Column]:
    """The characters whatever their order: a cell has as many bits as characters fall to it, CELL at most."""
    cells = 64 // CELL
    codes = F.transform(chars, lambda c: F.pmod(F.ascii(c), F.lit(BAGS * cells)))
    filled = lambda cell, at: F.call_function("shiftleft", _bit(F.least(F.size(F.filter(codes, lambda x: x == cell)), F.lit(CELL))) - 1, at * CELL)
    word = lambda first: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: filled(k + first, k))
    return [F.aggregate(word(w * cells), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b)).alias(f"bag{w}") for w in range(BAGS)]


def common_letters(a: str, m: Column, b: str, n: Column) -> Column:
    """At least the number of characters that two texts of these sizes have in common, from the bags in structs a and b. Where
    both have more than a cell counts, these may be common too: no more than the fewer of either text's."""
    held = lambda *x: sum((F.bit_count(y) for y in x[1:]), F.bit_count(x[0]))
    words = [(F.col(f"{a}.bag{k}"), F.col(f"{b}.bag{k}")) for k in range(BAGS)]
    over = F.least(m - held(*[x for x, _ in words]), n - held(*[y for _, y in words]))
    return held(*[x.bitwiseAND(y) for x, y in words]) + over


def least_shared(size, threshold: int, up=F.ceil, least=F.least):
    """Pairs of letters that a text of this size shares with any text that is similar enough.

    Let n be the other's size and d the letters that aren't common, at most (m + n) * (1 - threshold / 100). A letter of this
    text that isn't common spoils two of its pairs, one of the other text's spoils one: m - 1 - 2 * a - b are left, where
    a + b = d and a - b = m - n, that is m - 1 - (3 * d + m - n) / 2. It is linear in n, so least for the largest or the
    smallest n. size is a column, or a number if up and least are for numbers.
    """
    share, ratio = (100 - threshold) / 100, threshold / (200 - threshold)
    return up(least(*[size - 1 - (3 * share * size * (1 + r) + size * (1 - r)) / 2 for r in (ratio, 1 / ratio)]) - 1e-9)


def longest_short(threshold: int, most: int = 4096) -> int | None:
    """The size up to which texts need not share a pair, or None if there is no such size."""
    short = [m for m in range(1, most) if least_shared(m, threshold, math.ceil, min) < 1]
    return None if len(short) == most - 1 else max(short, default=0)


def _once(value: Column, use) -> Column:
    """use(value), an array, where the value is made once however often it is used."""
    return F.flatten(F.transform(F.array(value), use))


def keys(chars: Column, pairs: bool) -> Column:
    """The pairs of neighbouring characters, or the characters, each with its number among equal ones."""
    joined = lambda all_: F.zip_with(F.slice(all_, F.lit(1), F.greatest(F.size(all_) - 1, F.lit(0))), F.slice(all_, F.lit(2), F.size(all_)), lambda a, b: F.concat(a, b))
    numbered = lambda all_: F.transform(all_, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda h: h == g)).alias("nth")))
    return _once(_once(chars, joined) if pairs else chars, numbered)


def masks(chars: Column) -> Column:
    """For each character of a term its places, as bits of words of WORD bits."""

    def entries(all_: Column) -> Column:
        words = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / WORD).cast("int")), lambda w: bits(F.slice(all_, w * WORD + 1, F.lit(WORD)), c))
        bits = lambda some, c: F.aggregate(F.transform(some, lambda x, i: F.when(x == c, _bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s + b)
        return F.transform(F.array_distinct(all_), lambda c: F.struct(c.alias("c"), words(c).alias("words")))

    return F.map_from_entries(_once(chars, entries))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def common_subsequence(chars: Column, size: Column, masks: Column) -> Column:
    """Length of the longest common subsequence of characters and a term of any size, given by its masks.

    A state of ones loses a bit for each character of the term that is gained: state = (state + hits) | (state & ~places),
    hits = state & places, where sums carry from word to word.
    """
    zero, words = F.lit(0).cast("long"), F.floor((size - 1) / WORD).cast("int") + 1
    start = F.transform(F.sequence(F.lit(1), words), lambda _: F.lit(FULL).cast("long"))

    def step(state: Column, c: Column) -> Column:
        places = F.try_element_at(masks, c)
        both = F.arrays_zip(state.alias("v"), places.alias("p"))
        empty = F.struct(zero.alias("carry"), F.array().cast("array<long>").alias("out"))

        def word(acc: Column, x: Column) -> Column:
            v, p = x["v"], x["p"]
            total = v + v.bitwiseAND(p) + acc["carry"]
            kept = total.bitwiseAND(F.lit(FULL)).bitwiseOR(v.bitwiseAND(F.bitwise_not(p)))
            return F.struct(F.shiftright(total, WORD).alias("carry"), F.array_append(acc["out"], kept).alias("out"))

        return F.when(places.isNull(), state).otherwise(F.aggregate(both, empty, word, lambda acc: acc["out"]))

    ones = F.aggregate(F.aggregate(chars, start, step), F.lit(0), lambda n, v: n + F.bit_count(v))
    return words * WORD - ones


def _rarest(keyed: DataFrame, name: str, often: DataFrame, shared: Column, tasks: int | None) -> DataFrame:
    """(name, size, bag, gram, nth) of the rarest keys of each text, all but `shared` less one; so many that similar texts
    share one of these."""
    counted = keyed.join(often, ["gram", "nth"], "left").select(name, "size", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "nth").alias("k"))
    dealt = counted.repartition(tasks, name) if tasks else counted
    ranked = dealt.groupBy(name, "size").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    kept = F.slice("ks", F.lit(1), F.size("ks") - F.greatest(shared, F.lit(1)) + 1)
    bagged = ranked.where(F.size("ks") >= shared).select(name, "size", F.struct(*bags(characters(F.col(name)))).alias("bag"), kept.alias("kept"))
    return bagged.select(name, "size", "bag", F.explode("kept").alias("k")).select(name, "size", "bag", "k.gram", "k.nth")


def _sharing(texts: DataFrame, terms: DataFrame, pairs: bool, threshold: int, tasks: int | None) -> DataFrame:
    """(text, term) of those that share a rare key and whose sizes and letters may reach the threshold."""

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        chars = characters(F.col(name))
        return rows.select(name, F.size(chars).alias("size"), F.explode(keys(chars, pairs)).alias("k")).select(name, "size", "k.*")

    size = F.col("size")
    shared = (least_shared(size, threshold) if pairs else F.ceil(size * F.lit(threshold / (200 - threshold)) - 1e-9)).cast("int")
    own = keyed(terms, "term")
    often = own.groupBy("gram", "nth").agg(F.count("*").alias("n"))
    a = _rarest(keyed(texts, "text"), "text", often, shared, tasks).withColumnsRenamed({"size": "m", "bag": "a"})
    b = _rarest(own, "term", often, shared, tasks).withColumnsRenamed({"size": "n", "bag": "b"})
    m, n = F.col("m"), F.col("n")
    return a.join(b, ["gram", "nth"]).where(allowed(m, n, threshold) & (200 * common_letters("a", m, "b", n) >= threshold * (m + n))).select("text", "term")


def candidates(texts: DataFrame, terms: DataFrame, threshold: int, tasks: int | None = None) -> DataFrame:
    """(text, term) of all that may reach the threshold, each once. Both sides are distinct and not empty. tasks: how many
    the texts are dealt to, whose size tells little about the work that they make."""
    short = longest_short(threshold)
    size = lambda name: F.size(characters(F.col(name)))
    found = []
    if short is not None:
        found.append(_sharing(texts.where(size("text") > short), terms, True, threshold, tasks))
    if short != 0:
        near = None if short is None else short * (200 - threshold) // threshold
        some = (texts, terms) if near is None else (texts.where(size("text") <= short), terms.where(size("term") <= near))
        found.append(_sharing(*some, False, threshold, tasks))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return (every.repartition(tasks, "text") if tasks else every).distinct()


def matched(readings: DataFrame, terms: DataFrame, threshold: int = 82, text: str = "text", term: str = "term") -> DataFrame:
    """(text, term, score) of each distinct reading that is similar enough to a term: the most similar one, of equals the
    one of least rank.

    terms: term, and rank if it has that column; else terms rank by their bytes. Empty texts and nulls match nothing.
    """
    if not 0 < threshold <= 100:
        raise ValueError("the threshold must be above 0 and at most 100")
    seen = Observation()
    texts = written(readings.select(F.col(f"`{text}`").alias("text")).where("text <> ''").distinct(), seen, n=F.count("*"))
    tasks = max(1, -(-seen.get["n"] // TEXTS))
    ranked = terms.select(F.col(f"`{term}`").alias("term"), *(["rank"] if "rank" in terms.columns else [F.col(f"`{term}`").alias("rank")])).where("term <> ''")
    ranked = written(ranked.groupBy("term").agg(F.min("rank").alias("rank")))
    pairs = written(candidates(texts.repartition(tasks), ranked.select("term"), threshold, tasks))
    forget(texts)
    chars, own = characters(F.col("term")), characters(F.col("text"))
    known = ranked.join(pairs.select("term"), "term", "left_semi").select("term", "rank", F.size(chars).alias("n"), masks(chars).alias("masks"))
    compared = pairs.join(known, "term").select("text", "term", "rank", (200.0 * common_subsequence(own, F.col("n"), F.col("masks")) / (F.size(own) + F.col("n"))).alias("score")).where(F.col("score") >= threshold)
    best = compared.groupBy("text").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "term")).alias("b"))
    return best.select("text", "b.term", (-F.col("b.s")).alias("score"))
