"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word stand in a linked list, the ranks of its adjacent pairs in a heap. The pair of lowest
rank, leftmost first, is popped and merged until none is left. The count is the number of initial symbols
less that of merges; no identifiers are made. Characters outside the vocabulary start as one symbol a byte.

The vocabulary joins words by a mark for spaces and has no piece in which the mark follows another
character, nor a piece with a line break; so texts part before each run of marks and at line breaks, and a
worker keeps counts by part in a bounded cache.

Defined results: null and empty texts have no bytes and no tokens. Control strings in texts are plain text.
Repeated rows give repeated results. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import WordCache, slices, text_or_empty

MARK = "▁"
#: Parts that a worker's cache holds; results don't depend on it.
CACHE_PARTS = 800_000
SHIFT = 40


class HeapCounter:
    """A sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  a ") != f"{MARK}ﬁ{MARK}{MARK}a{MARK}":
            raise ValueError(f"{path}: only models that keep texts as they are, with a mark in front, are counted")
        skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        pieces = {model.id_to_piece(k): model.get_score(k) for k in range(len(model)) if not any(f(k) for f in skip)}
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in pieces.items()}
        chars = set("".join(pieces))
        if not chars <= pieces.keys() or "\n" in chars or any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError(f"{path}: texts can't be parted at spaces and line breaks under this vocabulary")
        self.chars = chars
        self.parts = re.compile(r" *[^ \n]+| +|\n")
        self.cache = WordCache(CACHE_PARTS)

    def count_part(self, part: str) -> int:
        """Tokens of a text within which any pair may merge."""
        rank, symbols = self.rank.get, list(part.replace(" ", MARK))
        n, merges = len(symbols), 0
        initial = sum(1 if c in self.chars else len(c.encode()) for c in symbols)
        heap = [(r << SHIFT) + k for k in range(n - 1) if (r := rank(symbols[k] + symbols[k + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, k = divmod(heappop(heap), 1 << SHIFT)
            left, j = symbols[k], after[k]
            if left is None or j == n or rank(joined := left + symbols[j]) != r:
                continue
            symbols[k], symbols[j] = joined, None
            merges += 1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := rank(joined + symbols[j])) is not None:
                    heappush(heap, (r << SHIFT) + k)
            if (i := before[k]) >= 0 and (r := rank(symbols[i] + joined)) is not None:
                heappush(heap, (r << SHIFT) + i)
        return initial - merges

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        found = [self.parts.findall(" " + x.replace(MARK, " ")) if x else [] for x in texts]
        known = self.cache.known(set().union(*found), lambda fresh: list(map(self.count_part, fresh)))
        return [sum(map(known.__getitem__, x)) for x in found]


@lru_cache(2)
def load(path: str) -> HeapCounter:
    """The model of this Python worker."""
    return HeapCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, UTF-8 bytes, tokens of the whole text, and whether these exceed the limit."""
    plain = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    schema = docs.select(F.col(key), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema

    def run(batches):
        counter = load(path)
        for b in slices(batches, 1, rows=256, limit=1 << 20):
            tokens = counter.count_batch(b.column(1).to_pylist())
            size = pc.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], names=schema.names)

    return plain.mapInArrow(run, schema)
