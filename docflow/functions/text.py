"""Column functions on text: stripping and splitting as in Python, unit tags, similarity to a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.config import UNITS, VOCABULARY

#: The characters that Python strips, and those at which it splits lines.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Without white space at both ends; Spark's trim() knows only the space."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def lines(text: Column) -> Column:
    """Stripped lines that aren't empty; null gives none."""
    return F.coalesce(F.filter(F.transform(F.split(text, LINE_END, -1), strip), lambda x: x != ""), F.array().cast("array<string>"))


def unit_tag(text: Column, units: tuple[tuple[str, str], ...] = UNITS) -> Column:
    """The label of the first unit, in their order, that the lower-cased text contains; else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(u)), F.lit(label)) for u, label in units])


def item_key(folder: Column, file: Column) -> Column:
    """Folder and file joined by a slash: for display; it is ambiguous if names hold slashes."""
    return F.concat_ws("/", folder, file)


def extension(name: Column) -> Column:
    """The lower-cased extension with its dot, as os.path.splitext has it; else the empty text."""
    base = F.substring_index(name, "/", -1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def fingerprint(parts: Column) -> Column:
    """Twelve hexadecimal digits of settings given as an array of texts, as Settings.fingerprint() has them."""
    return F.substring(F.sha1(F.array_join(parts, "|", "None")), 1, 12)


def vocabulary_masks(terms: tuple[str, ...] = VOCABULARY) -> Column:
    """A constant array of terms with the places of each character as bits, for term lengths below 62."""
    if any(len(t) > 61 or not t for t in terms):
        raise ValueError("terms must have 1 to 61 characters")

    def masks(term: str) -> Column:
        bits: dict[str, int] = {}
        for k, c in enumerate(term):
            bits[c] = bits.get(c, 0) | 1 << k
        return F.map_from_arrays(F.array(*map(F.lit, bits)), F.array(*[F.lit(b).cast("long") for b in bits.values()]))

    return F.array(
        *[F.struct(F.lit(-k).alias("rank"), F.lit(t).alias("term"), F.lit(len(t)).alias("size"), F.lit((1 << len(t)) - 1).cast("long").alias("full"), masks(t).alias("masks")) for k, t in enumerate(terms)]
    )


def common_subsequence(chars: Column, term: Column) -> Column:
    """Length of the longest common subsequence of a text's characters and a term, by bit-parallel steps:
    a bit of the state turns to zero for each character of the term that the subsequence has gained."""
    masks = F.transform(chars, lambda c: F.coalesce(F.try_element_at(term["masks"], c), F.lit(0).cast("long")))
    step = lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v - v.bitwiseAND(m)).bitwiseAND(term["full"])
    return term["size"] - F.bit_count(F.aggregate(masks, term["full"], step))


def best_match(text: Column, threshold: int = 82, terms: tuple[str, ...] = VOCABULARY) -> Column:
    """The most similar term, first of equals, as struct(score, rank, term), or null if none reaches the threshold.

    Similarity is 200 * common subsequence / (sum of lengths). A term too long or short to reach the threshold
    by length alone isn't compared; this loses nothing, as the subsequence is at most the shorter length.
    """
    size = F.char_length(text)
    chars = F.split(text, "")
    able = F.filter(vocabulary_masks(terms), lambda t: 200 * F.least(size, t["size"]) >= threshold * (size + t["size"]))
    scored = F.transform(able, lambda t: F.struct((200.0 * common_subsequence(chars, t) / (size + t["size"])).alias("score"), t["rank"].alias("rank"), t["term"].alias("term")))
    best = F.array_max(scored)
    return F.when(best["score"] >= threshold, best)


def corrected(text: Column, score: Column, gate: float = 0.85, threshold: int = 82, terms: tuple[str, ...] = VOCABULARY) -> Column:
    """The best term for readings below the gate that aren't blank, if one is similar enough; else the text."""
    return F.when((score >= gate) | (strip(text) == ""), text).otherwise(F.coalesce(best_match(text, threshold, terms)["term"], text))
