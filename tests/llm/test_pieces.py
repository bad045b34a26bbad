"""Pieces, their spans and decoding against the public library, also with compiled character maps."""

import hashlib
import random

import numpy as np
import pytest

from docflow.llm import pieces
from docflow.llm.queries import op12_pieces, tokenizer

MODEL = tokenizer("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "  a  \n\n b\t", "a" * 2000, "日本語 é́ \U0001f468‍\U0001f469 ½ Σς İ", "\x00\x1c\x1f\x85  z", "▁▁x </s> <unk> <0x0A>", "x ▁ ▁",
    "1234567 a.b,c;;; -- ##", "ﷺ ㌔ ｶﾞ 각  ̈x¨ ¨", "ﬁ  a ", "　　あ　 ", "ẛ̣ Å é", " " * 300 + "x", "\n" * 70,
]


def library(rule=None, squeeze=False, prefix=True):
    """The library's processor, and the bytes of the model, under another normalisation."""
    import sentencepiece

    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    if rule:
        model.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    spec = model.normalizer_spec
    spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces = squeeze, prefix, True
    data = model.SerializeToString()
    return sentencepiece.SentencePieceProcessor(model_proto=data), data


def random_texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    pool = "ab  　 \n\t▁éÅ̊a̧日本ｶﾞﾊﾟ각ᄀ가½¨ﬁ\U0001f600\x00ⅷ²‍­"
    some = ["".join(r.choice(pool) for _ in range(r.randrange(30))) for _ in range(n)]
    return some + ["".join(chr(r.choice([r.randrange(0x20, 0xD800), r.randrange(0xE000, 0x11000)])) for _ in range(r.randrange(20))) for _ in range(n)]


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("rule", [None, "nfkc_cf"])
def test_pieces_equal_library(rule, squeeze, prefix):
    theirs, data = library(rule, squeeze, prefix)
    mine = pieces.PieceEncoder(proto=data)
    texts = ODD + random_texts(5, 700)
    for x, (ids, begin, end) in zip(texts, mine.encode_batch(texts), strict=True):
        expected = theirs.encode(x, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in expected], x
        assert list(zip(begin.tolist(), end.tolist(), strict=True)) == [(p.begin, p.end) for p in expected], x
        assert mine.decode(ids) == theirs.decode(ids.tolist())
    r = random.Random(7)
    for _ in range(700):
        ids = [r.choice([r.randrange(32000), r.randrange(262), 29871]) for _ in range(r.randrange(9))]
        assert mine.decode(np.array(ids, np.int64)) == theirs.decode(ids)


def test_whole_documents(texts):
    theirs, _ = library()
    mine = pieces.load(MODEL)
    every = [x or "" for x in texts.values()]
    for x, (ids, begin, end) in zip(every, mine.encode_batch(every), strict=True):
        assert ids.tolist() == theirs.encode(x)
        data = x.encode()
        assert b"".join(data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)) == data


def test_long_part_and_block_agree():
    mine = pieces.load(MODEL)
    for part in ("▁unbelievable", "▁" * 40, "▁aaaaaaaaaaab", "ththththth"):
        ids = [int(mine.char[ord(c)]) for c in part]
        assert pieces.merge_long(ids, mine.merges) == np.frombuffer(mine._learn([part])[0], "<i4").tolist()


def test_refused_models():
    _, data = library()
    with pytest.raises(ValueError):
        pieces.PieceEncoder(proto=data[: len(data) // 2])
    with pytest.raises(ValueError):
        pieces.Normaliser(b"", suffix=True)


def test_query(spark, sf_dir, texts):
    theirs, _ = library()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = op12_pieces(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = texts[r.doc_id] or ""
        ids = theirs.encode(x)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.covered_bytes) == (len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids)), len(x.encode()))


def test_tables(edge, empty):
    theirs, _ = library()
    clash = edge.withColumnRenamed("ids", "IDS").withColumnRenamed("b", "a.b")
    out = pieces.encode(clash, MODEL)
    assert out.columns == [c for c in clash.columns if c != "IDS"] + ["ids", "begins", "ends"]
    back = pieces.decode(out, MODEL)
    for r in back.collect():
        assert r.ids == theirs.encode(r.text or "") and r.decoded == theirs.decode(r.ids) and len(r.begins) == len(r.ids)
    assert pieces.round_trip(edge, MODEL).count() == edge.count()
    assert pieces.encode(empty, MODEL).collect() == [] == pieces.round_trip(empty, MODEL).collect()
