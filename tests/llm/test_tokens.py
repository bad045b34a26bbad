"""BPE, counts and token files against the public libraries, exactly."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import bpe, simple8b, token_count, token_files
from docflow.llm.common import WordCache
from docflow.llm.queries import tokenizer

ODD = ["", " ", "  a  \n\n b\t", "don't 'LL <|endoftext|>x", "a" * 2000, "日本語 é́ \U0001f468‍\U0001f469 ½ Σς İ", "\x00\x1c\x1f\x85  z", "▁▁x </s> <unk> <0x0A>", "1234567 a.b,c;;; -- ##"]


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), bpe.load(tokenizer("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), token_count.load(tokenizer("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("word_bpe_49k.json")), token_files.load(tokenizer("word_bpe_49k.json"))


def test_bpe_equals_library(byte_level, texts):
    theirs, mine = byte_level
    every = [*ODD, *texts.values()]
    for x, ids in zip(every, mine.encode_batch(every), strict=True):
        expected = theirs.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert mine.decode(ids) == theirs.decode(expected, skip_special_tokens=False)
    assert 0 < mine.exact < mine.proposed


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(byte_level, x):
    theirs, mine = byte_level
    assert mine.encode_batch([x])[0].tolist() == theirs.encode(x, add_special_tokens=False).ids


def test_block_and_heap_merging_agree(byte_level):
    mine = byte_level[1]
    raw = [b"unbelievable", b"aaaaaaaaaaa", b"zqxj", b" thththth", b"a"]
    block = np.array([[mine.base[c] for c in x] + [-1] * (12 - len(x)) for x in raw])
    merged = bpe.merge_words(block, mine.table)
    for row, x in zip(merged, raw, strict=True):
        assert row[row >= 0].tolist() == bpe.heap_merge([mine.base[c] for c in x], mine.merges)


def test_bpe_small_cache(byte_level, texts, monkeypatch):
    theirs, _ = byte_level
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    mine = bpe.SpeculativeBpe(tokenizer("byte_bpe_50k.json"))
    some = list(texts.values())[:6]
    for _ in range(2):
        for x in some:
            assert mine.encode_batch([x])[0].tolist() == theirs.encode(x, add_special_tokens=False).ids


def test_round_trip_table(edge, empty):
    path = tokenizer("byte_bpe_50k.json")
    rows = bpe.round_trip(edge, path).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[1].ids_sha256 == by[4].ids_sha256
    assert bpe.round_trip(empty, path).count() == 0
    back = bpe.decode(bpe.encode(edge, path), path).select("doc_id", "text", "decoded", "lang").collect()
    assert all((r.text or "") == r.decoded for r in back) and len(back) == len(rows)


def test_counts_equal_library(pieces, texts):
    theirs, mine = pieces
    every = [*ODD, *texts.values()]
    assert mine.count_batch(every) == [len(x) for x in theirs.encode(every)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_counts_any_text(pieces, x):
    theirs, mine = pieces
    assert mine.count_batch([x]) == [len(theirs.encode(x))]


def test_counts_table(edge, empty):
    path = tokenizer("piece_bpe_32k.model")
    by = {r.doc_id: r for r in token_count.token_counts(edge, path, 4096).collect()}
    assert (by[2].n_bytes, by[2].n_tokens, by[2].over_limit) == (0, 0, False)
    assert by[7].over_limit and by[7].n_bytes == 28000
    assert token_count.token_counts(empty, path, 4096).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=2500))
def test_simple8b_any_numbers(values):
    x = np.array(values, np.uint64)
    words, of = simple8b.encode(x)
    assert of.sum() == len(words) and (simple8b.decode(words, of, len(x)) == x).all()


def test_simple8b_escapes():
    x = np.array([2**64 - 1, 2**60 - 1, 2**60, 2**60 + 15, 3] * 700, np.uint64)
    words, of = simple8b.encode(x)
    assert (simple8b.decode(words, of, len(x)) == x).all()


def test_simple8b_packs():
    words, _ = simple8b.encode(np.ones(60 * 100, np.uint64))
    assert len(words) < 120


def test_word_ids_equal_library(words, texts):
    theirs, mine = words
    every = [*ODD, "a,b 'S x's don't. É. ÀÉ!! ß_ naïve... <|endoftext|>, the<|endoftext|> é, q' µ, ª. \xd7x", *texts.values()]
    for some in (every, every[1:5], every[:2], [], [x for x in every if not any("\x1c" <= c <= "\x1f" for c in x)]):
        ids, sizes = mine.encode_batch(some)
        found = np.split(ids, np.cumsum(sizes)[:-1]) if some else []
        for x, part in zip(some, found, strict=True):
            assert part.tolist() == theirs.encode(x, add_special_tokens=False).ids
    ids, sizes = mine.encode_batch(["", "a b", ""], 2)
    assert sizes.tolist() == [1, 3, 1] and ids.tolist() == [2, *theirs.encode("a b", add_special_tokens=False).ids, 2, 2]


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aBßéÉ .,'_\n<|x\x1f\u0301"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_ids_any_text(words, x):
    theirs, mine = words
    assert mine.encode_batch([x])[0].tolist() == theirs.encode(x, add_special_tokens=False).ids


def test_word_cache_keeps_words_in_use():
    cache, made = WordCache(20), []

    def double(words):
        made.extend(words)
        return [w + w for w in words]

    for k in range(200):
        some = ["in use", str(k), str(k - 1)]
        assert cache.values(some, double) == [w + w for w in some]
    assert made.count("in use") == 1 and len(made) == 202 and len(cache.new) + len(cache.old) <= 20
    assert cache.values(list(map(str, range(100))), double)[99] == "9999"


def test_token_files(words, edge, empty, monkeypatch):
    theirs, _ = words
    path = tokenizer("word_bpe_49k.json")
    found = token_files.read_digests(token_files.write(edge, path, 2)).orderBy("start").collect()
    order = sorted(edge.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, d in zip(found, order, strict=True):
        ids = theirs.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_digests(token_files.write(empty, path, 2)).count() == 0


def test_token_file_ranges(tmp_path):
    place = f"file://{tmp_path}/x.s8b"
    writer, ids = token_files.FileWriter(place), np.arange(5000, dtype=np.uint32) * 7 % 40_000
    writer.add([None], ids[:10], np.array([10]))
    writer.add([4, 5], ids[10:], np.array([0, 4990]))
    writer.close()
    reader = token_files.FileReader(place)
    assert (reader.read(1000, 2100) == ids[1000:3100]).all() and len(reader.read(17, 0)) == 0
    assert [(k, s, len(x)) for k, s, x in reader.documents()] == [(None, 0, 10), (4, 10, 0), (5, 10, 4990)]
    (tmp_path / "y.s8b").write_bytes(b"not a token file" * 10)
    with pytest.raises(ValueError):
        token_files.FileReader(f"file://{tmp_path}/y.s8b")
