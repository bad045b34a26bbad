"""The registered queries over the smallest tables, and the pipeline's stages."""

import hashlib
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docflow.llm import bpe, media, minhash, toxicity
from docflow.llm.queries import ORACLE_SQL, QUERIES, tokenizer


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    expected = con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == sorted(expected)


CONTRACT = {
    "op1_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_mixing": "doc_id bigint, source string, phase int, block bigint, slot bigint, offset bigint",
    "op3_token_count": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_toxicity": "doc_id bigint, severity double, grade int, toxic boolean",
    "op6_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames int, n_clips int",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
}


def plain_row(name: str, text: str) -> dict:
    """Columns that follow from a row's text alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    data = text.encode()
    if name == "op1_bpe":
        t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
        ids = t.encode(text, add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
    if name == "op3_token_count":
        n = len(sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")).encode(text))
        return {"n_bytes": len(data), "n_tokens": n, "over_limit": n > 4096}
    if name == "op4_token_files":
        ids = Tokenizer.from_file(tokenizer("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids + [2]
        return {"n_tokens": len(ids), "ids_crc32": zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))}
    if name == "op6_media":
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        return {"n_bytes": len(data), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:])}
    if name == "op7_sharding":
        return {"size": len(data) + 16, "text_crc32": zlib.crc32(data), "law": "bytes", "grown_shard": None}
    return {"n_chars": len(text)} if name == "op10_fingerprint" else {}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_contracts(spark, sf_dir, texts, name):
    """Columns, their types, a row for each row, and on every 19th row what its text alone gives."""
    got = QUERIES[name](spark, sf_dir)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == CONTRACT[name]
    rows = got.collect()
    if name == "op9_chat":
        assert -7 in {r.conv_id for r in rows}
        return
    by = {r.doc_id: r.asDict() for r in rows}
    assert len(rows) == len(by) == len(texts)
    for k in sorted(texts)[::19]:
        assert by[k].items() >= plain_row(name, texts[k]).items()
    if name == "op4_token_files":
        order = sorted(rows, key=lambda r: r.doc_id)
        assert [r.start for r in order] == [sum(x.n_tokens for x in order[:i]) for i in range(len(order))]


def test_dotted_column_names(spark, sf_dir, edge):
    docs = edge.withColumn("a.b", F.lit("x")).withColumn("c d", F.col("lang"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.count() > 0 and (k == 3 or out.columns == docs.columns)
    assert bpe.encode(docs, tokenizer("byte_bpe_50k.json")).where("`a.b` = 'x'").count() == docs.count()
    assert media.store(docs).where("`a.b` = 'x'").count() == docs.count()


def test_pipeline(spark, sf_dir, documents, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mixing", "bpe"]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(documents, labels)
    keys = sorted(texts)
    clean = [k for k, s in zip(keys, toxicity.Scorer(model).severities([texts[k] for k in keys]), strict=True) if s < toxicity.CUT]
    sets = dict(zip(clean, minhash.Shingler(5).sets([texts[k].encode() for k in clean]), strict=True))
    sets = {k: set(x.tolist()) for k, x in sets.items()}
    gone, root = set(), {k: k for k in clean}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(clean):
        for b in clean[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    gone = {k for k in clean if top(k) != k}
    assert sorted(r.doc_id for r in rows) == sorted(set(clean) - gone)
    assert all(len(r.ids) == r.n_tokens for r in rows)
    assert len({(r.mix_file, r.mix_row) for r in rows}) == len(rows)


def test_stages_on_edge_tables(spark, sf_dir, edge, empty):
    for docs in (edge, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if k < 3:
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
