"""Token-id files in Simple-8b, written in ascending order of documents and read back by ranges.

A file is: the magic, the words of its blocks (see simple8b), the table of blocks (words in each), the table
of documents (key, whether it is null, ids), and a footer of five numbers with the magic again. All numbers
are little-endian. The table of blocks gives the offset of any block, so that any range of ids decodes alone.

Texts are dealt to files by ranges of the key; a file holds one partition. Each attempt of a task writes a
file of its own and hands back its manifest row, so only the files of attempts that succeeded are ever read:
lost executors and repeated attempts leave unused files behind and nothing else.

Defined results: null and empty texts have the end id alone. Rows with one key stand side by side, ordered by
text; rows without a key come first. An empty table gives no files and no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm import simple8b
from docflow.llm.common import WordCache, shared_dir, slices, text_or_empty, written

MAGIC = b"DFTOKS8B"
#: Words in lower case and without punctuation that a worker's cache holds; results don't depend on it.
CACHE_WORDS = 1_000_000
#: Ids that a writer or reader holds at a time, beyond those of one document.
CHUNK_IDS = 1 << 19
#: Separator for encoding many words in one call, and the strings that would be mistaken for it or for
#: special tokens; words with these are encoded alone.
SEPARATOR = "\x1f"
ALONE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Punctuation, and words of Latin letters with punctuation behind: the ids of these are those of both parts.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
PLAIN = "^[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[!-/:-@\\[-`{-~]*$"
#: The mark of a word's last token in vocabularies of word ends.
END = "</w>"
MANIFEST = "path string, docs bigint, ids bigint, bytes bigint, first_key bigint, part int"


def _tails(words: pa.Array, heads: pa.Array) -> pa.Array:
    """What each word has behind its head."""
    _, offsets, data = words.buffers()
    if data is None:
        return words
    end = np.frombuffer(offsets, np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
    size = pc.subtract(pc.binary_length(words), pc.binary_length(heads)).to_numpy(zero_copy_only=False)
    until = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(end - until[1:], size) + np.arange(until[-1])
    out = np.frombuffer(data, np.uint8)[place]
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(until.astype(np.int32)), pa.py_buffer(out.tobytes()))


def is_odd(text: str) -> bool:
    return any(x in text for x in ALONE)


class WordEncoder:
    """A tokenizers file that drops white space: the ids of a text are those of its words, one by one.

    Of a batch each distinct word is looked up once; its ids are laid out for all its places by array gathers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.plain = (Tokenizer.from_file(path) for _ in range(2))
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        #: For stems, which normalizing leaves as they are.
        self.plain.normalizer = normalizers.Sequence([])
        probe = [self._ids(x) for x in ("a b", "a", "b", " a\n\n b ", SEPARATOR, f"a {SEPARATOR} b")]
        if probe[0] != probe[1] + probe[2] or probe[3] != probe[0] or len(probe[4]) != 1 or probe[5] != probe[1] + probe[4] + probe[2]:
            raise ValueError(f"{path}: its words can't be encoded one by one")
        self.separator = probe[4][0]
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith(END)]] = True
        #: Whether stems and punctuation can be encoded apart.
        self.parts = all(self._ids(f" {x}\u00c9a{y} ") == self._ids(f"{x}\u00e9a") + self._ids(y) and self.ends[self._ids(x)].sum() == 1 for x in ("q", "the", "zxqj") for y in (",", ".", "'", "...", "_"))
        #: White space as the tokenizer has it: str.split() and Arrow also part at the four separators 1C to 1F.
        self.words = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
        self.stems, self.whole = WordCache(CACHE_WORDS), WordCache(CACHE_WORDS // 8)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn_stems(self, stems: list[str]) -> list[bytes]:
        """The ids of single pre-tokens of lower case, cut at the tokens that end a word."""
        found = []
        for k in range(0, len(stems), 20_000):
            some = stems[k : k + 20_000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            end = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(end) != len(some):
                raise ValueError("a word has more than one end")
            data, end = ids.tobytes(), end.tolist()
            found += [data[i:j] for i, j in zip([0, *end[:-1]], end, strict=True)]
        return found

    def _learn_whole(self, words: list[str]) -> list[bytes]:
        """The ids of words of any kind."""
        found: dict[str, bytes] = {"": b""}
        if is_odd(" ".join(words)):
            found.update((w, np.array(self._ids(w), "<u4").tobytes()) for w in words if is_odd(w))
        rest = [w for w in words if w not in found]
        for k in range(0, len(rest), 20_000):
            some = rest[k : k + 20_000]
            ids = np.array(self._ids(f" {SEPARATOR} ".join(some)), "<u4")
            cut = np.flatnonzero(ids == self.separator)
            if len(cut) != len(some) - 1:
                raise ValueError("a word's ids hold the separator")
            data = ids.tobytes()
            start, end = (4 * np.concatenate([[0], cut + 1])).tolist(), (4 * np.concatenate([cut, [len(ids)]])).tolist()
            found.update((w, data[i:j]) for w, i, j in zip(some, start, end, strict=True))
        return [found[w] for w in words]

    def _parts(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of parts, and of each distinct word the numbers of its two parts: stem and marks, or itself and nothing."""
        n, none = len(words), np.zeros(len(words), np.int32)
        low = pc.utf8_lower(words)
        stems = pc.utf8_rtrim(low, characters=MARKS)
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        if not self.parts:
            plain = np.zeros(n, bool)
        tails = _tails(low, stems)
        plain &= ~pc.match_substring(tails, "<|").to_numpy(zero_copy_only=False)
        whole = words.filter(pa.array(~plain)).to_pylist()
        stems = stems.filter(pa.array(plain)).dictionary_encode()
        tails = tails.filter(pa.array(plain)).dictionary_encode()
        found = [b"", *self._learn_whole(tails.dictionary.to_pylist())]
        one, two = none, none.copy()
        two[plain] = 1 + tails.indices.to_numpy(zero_copy_only=False)
        one[plain] = len(found) + stems.indices.to_numpy(zero_copy_only=False)
        found += self.stems.values(stems.dictionary.to_pylist(), self._learn_stems)
        one[~plain] = len(found) + np.arange(len(whole), dtype=np.int32)
        found += self.whole.values(whole, self._learn_whole)
        return found, np.stack([one, two], 1)

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text; there may be empty ones at its ends."""
        if not pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            return pc.utf8_split_whitespace(texts)
        return pa.array([self.words.findall(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    def encode_batch(self, texts: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, each with the end id behind if there is one, and how many each has."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = self._split(texts)
        words = split.flatten().dictionary_encode()
        found, parts = self._parts(words.dictionary)
        ids, of_part = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int32, len(found)) // 4
        at = parts[words.indices.to_numpy(zero_copy_only=False)].ravel()
        size = of_part[at]
        until = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        place = np.repeat((np.cumsum(of_part) - of_part)[at] - until[:-1], size)
        place += np.arange(until[-1])
        ids = ids[place]
        first = split.offsets.to_numpy()
        sizes = np.diff(until[2 * (first - first[0])])
        if end is None:
            return ids, sizes
        sizes += 1
        out = np.full(int(sizes.sum()), end, np.uint32)
        own = np.ones(len(out), bool)
        own[np.cumsum(sizes) - 1] = False
        out[own] = ids
        return out, sizes


@lru_cache(2)
def load(path: str) -> WordEncoder:
    """The tokenizer of this Python worker."""
    return WordEncoder(path)


class FileWriter:
    """Writes one file; holds the tables and less than a chunk of ids."""

    def __init__(self, place: str):
        self.system, self.path = fs.FileSystem.from_uri(place)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.pending: list[np.ndarray] = []
        self.waiting = self.ids = self.words = 0
        self.blocks: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, keys: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents with their ids, one after the other, and how many each has."""
        self.keys += keys
        self.sizes += sizes.tolist()
        self.pending.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= CHUNK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        n = len(ids) if last else len(ids) // simple8b.BLOCK * simple8b.BLOCK
        words, of = simple8b.encode(ids[:n])
        self.out.write(words.astype("<u8").tobytes())
        self.words += len(words)
        self.blocks.append(of)
        self.pending, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> int:
        """Ends the file; its size in bytes."""
        self._flush(True)
        blocks = np.concatenate(self.blocks).astype("<i8")
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        nulls = np.array([k is None for k in self.keys], np.uint8)
        tail = b"".join(x.tobytes() for x in (blocks, keys, np.array(self.sizes, "<i8"), nulls))
        tail += np.array([len(keys), self.ids, len(blocks), self.words, simple8b.BLOCK], "<i8").tobytes() + MAGIC
        self.out.write(tail)
        self.out.close()
        return 8 + 8 * self.words + len(tail)


class FileReader:
    """Reads one file by ranges of ids."""

    def __init__(self, place: str):
        system, path = fs.FileSystem.from_uri(place)
        self.file = system.open_input_file(path)
        end = self.file.size()
        foot = self.file.read_at(48, end - 48)
        if foot[40:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{place} is not a token file")
        docs, self.ids, blocks, words, block = np.frombuffer(foot[:40], "<i8").tolist()
        if block != simple8b.BLOCK:
            raise ValueError(f"{place} has blocks of {block} ids")
        table = self.file.read_at(8 * blocks + 17 * docs, 8 + 8 * words)
        self.words_of = np.frombuffer(table[: 8 * blocks], "<i8")
        self.keys = np.frombuffer(table[8 * blocks : 8 * (blocks + docs)], "<i8")
        self.sizes = np.frombuffer(table[8 * (blocks + docs) : 8 * (blocks + 2 * docs)], "<i8")
        self.nulls = np.frombuffer(table[8 * (blocks + 2 * docs) :], np.uint8).astype(bool)
        self.word_at = np.concatenate([[0], np.cumsum(self.words_of)])

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file."""
        if not n:
            return np.zeros(0, np.uint32)
        low, high = start // simple8b.BLOCK, -(-(start + n) // simple8b.BLOCK)
        at, end = int(self.word_at[low]), int(self.word_at[high])
        words = np.frombuffer(self.file.read_at(8 * (end - at), 8 + 8 * at), "<u8")
        first = low * simple8b.BLOCK
        ids = simple8b.decode(words, self.words_of[low:high], min(high * simple8b.BLOCK, self.ids) - first)
        return ids[start - first : start - first + n].astype(np.uint32)

    def documents(self):
        """(key, start, ids) of each document, in order."""
        start = np.concatenate([[0], np.cumsum(self.sizes)])
        k = 0
        while k < len(self.sizes):
            end = max(k + 1, int(np.searchsorted(start, start[k] + CHUNK_IDS, side="right")) - 1)
            ids = self.read(int(start[k]), int(start[end] - start[k]))
            for i in range(k, end):
                yield None if self.nulls[i] else int(self.keys[i]), int(start[i]), ids[start[i] - start[k] : start[i + 1] - start[k]]
            k = end


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts, each with the end id behind, in ascending order of the integer key.

    Gives the manifest: a row for each file. It is kept in the shared folder, so that the writing job runs once.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens"
    plain = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    dealt = plain.repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, writer, first = load(tokenizer), None, None
        part = TaskContext.get().partitionId()
        place = f"{folder}/{part:06d}-{uuid.uuid4().hex}.s8b"
        for b in slices(batches, 1, rows=1 << 14, limit=4 << 20):
            keys = b.column(0).to_pylist()
            if writer is None:
                writer, first = FileWriter(place), next((k for k in keys if k is not None), None)
            writer.add(keys, *encoder.encode_batch(b.column(1), end_id))
        if writer is not None:
            size = writer.close()
            row = {"path": place, "docs": len(writer.keys), "ids": writer.ids, "bytes": size, "first_key": first, "part": part}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("first_key", pa.int64()), ("part", pa.int32())]))

    return written(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_digests(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), number and crc32 of its ids.

    The driver sees one row a file, as many as the writing job had partitions.
    """
    spark, base, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("part").collect():
        rows.append((r.path, base))
        base += r.ids
    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                for k, start, ids in FileReader(path).documents():
                    out.append((k, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 4096:
                        yield _rows(out, key)
                        out = []
                if out:
                    yield _rows(out, key)

    return files.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple], key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[key, "start", "n_tokens", "ids_crc32"])
