"""Document fingerprints by winnowing, in DataFrame functions only.

A text's tokens are its runs of characters other than white space; a run of more than PIECE characters gives the
PIECE characters from each of its places on. So a passage within runs has the same tokens wherever it starts, also
in text without white space. (On request, runs are cut at every PIECE characters instead, which loses passages at
other offsets.) The hash of K tokens is a polynomial of theirs modulo a prime; it is rolled by doubling: hashes of two tokens from
those of one, of four from two, of five from four and one, for all places at once. Minima of WINDOW hashes are
made likewise from those of 2, 4 and 8. A value holds the hash above and the complement of its place below, so
the least of a window is the least hash and, among equals, the rightmost. The distinct minima with their
places are the fingerprint: of any WINDOW + K - 1 tokens that two texts share, both keep a common hash.

Defined results: a text of fewer than K tokens has one hash, of all of them; one of fewer than WINDOW hashes
has one window. Null and empty texts have no hash; two of these are alike (1). Equal texts have equal
fingerprints. Rows with one key are ordered by text. Rows without a key have no next document and take the
empty text for it. Very long texts take linear time. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.common import text_or_empty

K, WINDOW, PIECE = 5, 16, 8
#: Tokens cut from the start of a run, and (group 1) those of every place of a long run and short runs as a whole.
CUT = rf"\S{{1,{PIECE}}}"
ROLLED = rf"(?=(\S{{{PIECE}}}|(?<!\S)\S{{1,{PIECE - 1}}}(?!\S)))\S"
#: A prime below 2^31 and a base below it.
PRIME, BASE = 2147483647, 1000003
#: Quantiles of the key between which buckets are even, rows of a bucket, and buckets at most.
QUANTILES, BUCKET_ROWS, MAX_BUCKETS = 64, 2000, 65536


def _pairs(a: str, shift: int, f, b: str | None = None) -> Column:
    """f of all a[i] and b[i + shift]; b is a if not given."""
    b = b or a
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), f)


def _rolled(width: int):
    """Joins hashes where the right one is of so many tokens."""
    factor = pow(BASE, width, PRIME)
    return lambda x, y: (x * F.lit(factor).cast("long") + y) % F.lit(PRIME).cast("long")


def with_fingerprint(rows: DataFrame, text: str, into: str, rolled: bool = False) -> DataFrame:
    """Adds the fingerprint as array<bigint>, hash * 2^31 + 2^31 - 1 - place, in order of place.

    rolled: long runs give a token for each place, not for each PIECE characters.
    """
    t, h, g, v = (f"__{into}_{c}" for c in "thgv")
    none = F.array().cast("array<bigint>")
    whole = F.aggregate(h, F.lit(0).cast("long"), _rolled(1))
    packed = lambda x, i: x * F.lit(1 << 31) + (F.lit(PRIME).cast("long") - i)
    tokens = (ROLLED, 1) if rolled else (CUT, 0)
    rows = rows.withColumn(t, F.regexp_extract_all(text, F.lit(tokens[0]), F.lit(tokens[1])))
    rows = rows.withColumn(h, F.transform(t, lambda x: F.xxhash64(x).bitwiseAND(F.lit(PRIME).cast("long")) % F.lit(PRIME).cast("long"))).drop(t)
    rows = rows.withColumn(g, _pairs(h, 1, _rolled(1)))
    rows = rows.withColumn(g, _pairs(g, 2, _rolled(2)))
    rows = rows.withColumn(g, _pairs(g, 4, _rolled(1), h))
    rows = rows.withColumn(g, F.when(F.size(h) == 0, none).when(F.size(h) < K, F.array(whole)).otherwise(F.col(g))).drop(h)
    rows = rows.withColumn(g, F.transform(g, packed)).withColumn(v, F.col(g))
    for shift in (1, 2, 4, 8):
        rows = rows.withColumn(v, _pairs(v, shift, lambda x, y: F.least(x, y)))
    short = F.when(F.size(g) == 0, none).otherwise(F.array(F.array_min(g)))
    return rows.withColumn(into, F.array_distinct(F.when(F.size(g) < WINDOW, short).otherwise(F.col(v)))).drop(g, v)


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def places(fingerprint: Column) -> Column:
    """Hash and place (number of the first token) of each member."""
    return F.transform(fingerprint, lambda x: F.struct(F.shiftright(x, 31).alias("hash"), (F.lit(PRIME).cast("long") - x.bitwiseAND(F.lit(PRIME).cast("long"))).alias("place")))


def as_text(fingerprint: Column) -> Column:
    """hash@place of each member, in hexadecimal."""
    return F.array_join(F.transform(places(fingerprint), lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit("@"), F.lower(F.hex(x["place"])))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of both that are common; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", rolled: bool = False) -> DataFrame:
    """Per row: the key and its fingerprint as an array of (hash, place)."""
    rows = docs.select(F.col(key).alias("__key"), text_or_empty(text).alias("__text"))
    return with_fingerprint(rows, "__text", "__print", rolled).select(F.col("__key").alias(key), places(F.col("__print")).alias("fingerprint"))


def _buckets(docs: DataFrame) -> tuple[Column, int]:
    """The bucket of a key, rising with it and of about equal rows, and how many there are."""
    share = [k / QUANTILES for k in range(QUANTILES + 1)]
    found = docs.agg(F.percentile_approx("key", share, 10000).alias("q"), F.count("*").alias("n")).first()
    cuts = sorted(set(found.q or [0, 0]))
    parts = max(1, len(cuts) - 1)
    each = max(1, min(MAX_BUCKETS // parts, -(-found.n // (parts * BUCKET_ROWS))))

    def part(low: int, high: int) -> Column:
        """Number of the part, by bisection."""
        if high - low <= 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("key") < F.lit(cuts[middle]), part(low, middle)).otherwise(part(middle, high))

    p = part(0, parts)
    start, width = F.array(*map(F.lit, cuts[:parts])), F.array(*[F.lit(max(1, b - a)) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1], strict=True)][:parts])
    inside = F.floor((F.col("key") - F.element_at(start, p + 1)) * F.lit(float(each)) / F.element_at(width, p + 1))
    return p * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), inside)).cast("int"), parts * each


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", rolled: bool = False) -> DataFrame:
    """Per row: fingerprints of its text and of its edited text, and how alike its own is to that and to the next row's.

    The edited text has its last floor(n / 2) characters replaced by as many first ones of the next text in
    ascending order of the key; after the last comes the first. Texts are dealt once, by buckets of the key;
    a bucket also gets a copy of the first row of the next one. There are at most MAX_BUCKETS of these.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    bucket, _ = _buckets(rows.select("key"))
    keyed = rows.withColumn("bucket", F.when(F.col("key").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(64)).cast("int")).otherwise(bucket))
    heads = keyed.where("key is not null").groupBy("bucket").agg(F.min("key").alias("head"))
    one = Window.orderBy("bucket")
    following = F.coalesce(F.lead("head").over(one), F.first("head").over(one))
    heads = heads.select(F.col("bucket").alias("before"), following.alias("key"))
    both = keyed.join(F.broadcast(heads), "key", "left").withColumn(
        "to", F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("x")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("x")), F.struct(F.col("before").alias("b"), F.lit(True).alias("x"))))
    )
    dealt = both.select("key", "text", F.inline("to"))
    order = Window.partitionBy("b").orderBy("x", "key", "text")
    known = F.col("key").isNotNull()
    rows = dealt.withColumn("next", F.when(known, F.coalesce(F.lead("text").over(order), F.lit(""))).otherwise(F.lit("")))
    rows = rows.withColumn("n_chars", F.char_length("text"))
    rows = rows.withColumn("cut", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("cut")), F.substring("next", F.lit(1), F.col("cut")))).drop("next", "cut")
    rows = with_fingerprint(with_fingerprint(rows, "text", "own", rolled), "edited", "other", rolled)
    rows = rows.select("key", "b", "x", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "other")
    rows = rows.withColumn("a", hashes(F.col("own")))
    after = F.when(known, F.lead("a").over(order))
    rows = rows.withColumn("after", F.coalesce(after, F.array().cast("array<bigint>"))).where("not x")
    return rows.select(
        F.col("key").alias(key), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("a"), hashes(F.col("other"))).alias("near_edited"), likeness(F.col("a"), F.col("after")).alias("near_next"),
    )
