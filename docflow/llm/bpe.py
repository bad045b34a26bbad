"""Byte-level BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of every word. A proposal is what BPE itself would give if each
of its tokens survives its own merges and every adjacent pair is compatible: undoing merges from the latest
to the earliest, no merge across the border would have come first. Both are checked for whole arrays of
tokens at once. Words that fail, and only these, are merged exactly. Results are kept by word in a bounded
cache of the worker, so that frequent words are handled once.

Defined results: null and empty texts have no tokens and decode to the empty text. Special strings inside a
text become their special ids, as the tokenizer file says. Repeated rows give repeated results. Very long
words take n log n steps. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import ByteTable, WordCache, mapped, own, slices, text_or_empty

#: Fixed value: the pattern by which byte-level BPE splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker's cache holds; results don't depend on it.
CACHE_WORDS = 700_000
#: Bytes beyond which a word is merged alone, with a heap, and not in a block with others.
LONG_WORD = 64
NEVER = np.int64(1 << 62)


def byte_of_symbol() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes take the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def heap_merge(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Exact BPE of a symbol list: the pair of lowest rank, leftmost first, merges until none is left."""
    n = len(ids)
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
    heapq.heapify(heap)
    while heap:
        _, new, k, a, b = heapq.heappop(heap)
        j = after[k]
        if ids[k] != a or j >= n or ids[j] != b:
            continue
        ids[k], ids[j] = new, -1
        after[k] = j = after[j]
        if j < n:
            before[j] = k
            if m := merges.get((new, ids[j])):
                heapq.heappush(heap, (*m, k, new, ids[j]))
        i = before[k]
        if i >= 0 and (m := merges.get((ids[i], new))):
            heapq.heappush(heap, (*m, i, ids[i], new))
    return [x for x in ids if x >= 0]


class PairTable:
    """Merge rank and result of token pairs, looked up for whole arrays: a hash table with linear probing."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], n: int):
        self.n, self.bits = n, max(4, int(len(merges)).bit_length() + 2)
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.rank, self.new = np.full(size, NEVER // 4, np.int64), np.zeros(size, np.int64)
        todo = np.array([a * n + b for a, b in merges], np.int64)
        value = np.array(list(merges.values()), np.int64).reshape(-1, 2)
        at, self.probes = self._slot(todo), 0
        while len(todo):
            self.probes += 1
            free = self.key[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            take = free & first
            self.key[at[take]], self.rank[at[take]], self.new[at[take]] = todo[take], value[take, 0], value[take, 1]
            todo, value, at = todo[~take], value[~take], (at[~take] + 1) % size

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs; of pairs that never merge, a place of rank beyond all."""
        key = a.astype(np.int64) * self.n + b
        at = self._slot(key)
        there = self.key[at]
        wrong = np.flatnonzero((there != key) & (there >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.key)
            there = self.key[at[wrong]]
            wrong = wrong[(there != key[wrong]) & (there >= 0)]
        return at


def merge_words(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """Exact BPE of many words at once: rows of ids, padded with -1 at their ends; the result likewise.

    Each step merges in every word its pair of lowest rank, leftmost first, until no word has one.
    """
    never = NEVER // 4
    ids, result, rows = ids.astype(np.int64), np.full(ids.shape, -1, np.int64), np.arange(len(ids))
    found = table.rank[table.find(np.maximum(ids[:, :-1], 0).ravel(), np.maximum(ids[:, 1:], 0).ravel())]
    rank = np.where(ids[:, 1:] >= 0, found.reshape(ids[:, 1:].shape), never)
    rank = np.concatenate([rank, np.full((len(ids), 1), never)], axis=1)
    while len(rows):
        k = rank.argmin(axis=1)
        every = np.arange(len(rows))
        done = rank[every, k] >= never
        if done.any():
            result[rows[done], : ids.shape[1]] = ids[done]
            ids, rank, rows, k = ids[~done], rank[~done], rows[~done], k[~done]
            every = every[: len(rows)]
            if not len(rows):
                break
        width = ids.shape[1]
        ids[every, k] = table.new[table.find(ids[every, k], ids[every, k + 1])]
        pick = np.arange(width - 1)[None, :]
        pick = pick + (pick > k[:, None])
        ids = np.take_along_axis(ids, pick, 1)
        pick = np.arange(width - 1)[None, :]
        rank = np.take_along_axis(rank, pick + (pick >= k[:, None]), 1)
        for i, left, right in ((every, k - 1, k), (every, k, k + 1)):
            ok = (left >= 0) & (right < width - 1)
            i, left, right = i[ok], left[ok], right[ok]
            b = ids[i, right]
            rank[i, left] = np.where(b >= 0, table.rank[table.find(ids[i, left], np.maximum(b, 0))], never)
    return result


class SpeculativeBpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, vocab = byte_of_symbol(), spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = added
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        n = 1 + max([*vocab.values(), *added.values()])
        self.bytes = [b""] * n
        for token, k in vocab.items():
            self.bytes[k] = bytes(map(byte.__getitem__, token))
        for token, k in added.items():
            self.bytes[k] = token.encode()
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.n = n
        self.base = [0] * 256
        for token, k in vocab.items():
            if len(token) == 1:
                self.base[byte[token]] = k
        self.birth = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        for (a, b), (r, new) in self.merges.items():
            if self.birth[new] < 0 or r < self.birth[new]:
                self.birth[new], self.left[new], self.right[new] = r, a, b
        self.table = PairTable(self.merges, n)
        self.survives = self._survivors()
        self.matcher = ahocorasick.Automaton()
        for token, k in vocab.items():
            if self.survives[k]:
                self.matcher.add_word(self.bytes[k].decode("latin-1"), k)
        self.matcher.make_automaton()
        self.words = regex.compile(WORDS)
        self.texts, self.decimals = ByteTable(self.bytes), ByteTable([b"%d," % k for k in range(n)])
        self.cache = WordCache(CACHE_WORDS)
        self.exact = self.proposed = 0

    def _survivors(self) -> np.ndarray:
        """Tokens that BPE makes of their own bytes."""
        made = np.flatnonzero(self.birth >= 0)
        good = np.ones(self.n, bool)
        good[made] = self.compatible(self.left[made], self.right[made], 2 * self.birth[made])
        for k in made[np.argsort(self.birth[made])]:
            good[k] &= good[self.left[k]] and good[self.right[k]]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE keeps the border between tokens a and b, for arrays of pairs.

        limit: twice the rank before which a merge across the border counts; one more where the border's
        merge, being left of the undone one, goes first at the same rank.
        """
        result = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER // 4) if limit is None else limit.astype(np.int64)
        while len(at):
            crossed = 2 * self.table.rank[self.table.find(a, b)] < limit
            result[at[crossed]] = False
            of_a, of_b = self.birth[a], self.birth[b]
            go = ~crossed & ((of_a >= 0) | (of_b >= 0))
            undo_a = of_a > of_b
            limit = np.where(undo_a, 2 * of_a, 2 * of_b + 1)[go]
            a, b, at = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go], at[go]
        return result

    def _learn(self, words: list[str]) -> list[bytes]:
        """Encodes words that the cache lacks: propose for all, verify for all, merge what fails."""
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw])
        joined = "Ā".join(x.decode("latin-1") for x in raw)
        found = np.array(list(self.matcher.iter_long(joined)), np.int64).reshape(-1, 2)
        end, ids = found[:, 0], found[:, 1]
        last = np.cumsum(size + 1) - 2
        owner = np.searchsorted(last, end)
        covered = np.bincount(owner, self.texts.size[ids], len(raw)) == size
        inner = owner[1:] == owner[:-1]
        good = self.compatible(ids[:-1][inner], ids[1:][inner])
        fails = ~covered
        fails[owner[1:][inner][~good]] = True
        cut = np.searchsorted(owner, np.arange(len(raw) + 1))
        data = ids.astype("<i4").tobytes()
        self.proposed += len(raw)
        self.exact += int(fails.sum())
        bounds = (4 * cut).tolist()
        learned = [data[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        again = np.flatnonzero(fails)
        again = again[np.argsort(size[again], kind="stable")]
        for k in again[size[again] > LONG_WORD]:
            learned[k] = np.array(heap_merge([self.base[c] for c in raw[k]], self.merges), "<i4").tobytes()
        again = again[size[again] <= LONG_WORD]
        for some in np.array_split(again, max(1, len(again) // 2048)):
            if not len(some):
                continue
            width = int(size[some].max())
            block = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in some), np.uint8).reshape(-1, width)
            block = np.where(np.arange(width) < size[some][:, None], np.array(self.base)[block], -1)
            block = merge_words(block, self.table).astype("<i4")
            ends = 4 * (block >= 0).sum(axis=1)
            for k, row, end in zip(some.tolist(), block, ends.tolist(), strict=True):
                learned[k] = row.tobytes()[:end]
        return learned

    def split(self, text: str) -> list[str]:
        return self.words.findall(text)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts = []
        for text in texts:
            if self.special_at and self.special_at.search(text):
                parts.append([w for k, x in enumerate(self.special_at.split(text)) for w in ([("", x)] if k % 2 else self.split(x))])
            else:
                parts.append(self.split(text))
        known = self.cache.known({w for w in set().union(*parts) if isinstance(w, str)}, self._learn)
        known.update((("", content), np.array([k], "<i4").tobytes()) for content, k in self.special.items())
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), "<i4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        return self.texts.join(ids).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimals joined by commas."""
        return self.decimals.join(ids)[:-1]


@lru_cache(2)
def load(path: str) -> SpeculativeBpe:
    """The tokenizer of this Python worker."""
    return SpeculativeBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the ids of every whole text as array<int>; a column of that name is replaced, those of drop are left out."""
    kept = [c for c in docs.columns if c not in (into, *drop)]
    plain = docs.select(*own(kept), text_or_empty(text).alias("__text"))
    schema = docs.select(*own(kept), F.array(F.lit(0)).alias(into)).schema

    def run(batches):
        bpe = load(path)
        for b in slices(batches, len(kept), rows=1024, limit=2 << 20):
            ids = bpe.encode_batch(b.column(len(kept)).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], lists], names=[*kept, into])

    return mapped(plain, run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of every array of ids; null arrays give the empty text."""
    kept = [c for c in rows.columns if c != into]
    schema = rows.select(*own(kept), F.lit("").alias(into)).schema

    def run(batches):
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in b.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(kept.index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, into])

    return mapped(rows, run, schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the number of tokens and digests of the ids and of the text decoded from them.

    Ids and texts stay inside the worker, so that the result is small however long the texts are.
    """
    plain = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    schema = docs.select(F.col(key), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches):
        bpe = load(path)
        for b in slices(batches, 1, rows=1024, limit=2 << 20):
            ids = bpe.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(bpe.decimal(x)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=schema.names,
            )

    return plain.mapInArrow(run, schema)
