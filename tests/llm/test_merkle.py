"""The Merkle manifest against a plain tree in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docflow.llm import merkle
from docflow.llm.queries import op11_merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        found.append(nodes)
    return found


def plain(rows):
    """Rows of the report, from (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, text: sha("".join(map(field, (*r[:4], text))))
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    found = {s: levels([leaf(r, r[4]) for r in trees[s]]) for s in order}
    top = levels([found[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            text, proof = r[4], ""
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf(r, text)
            for tree, at in ((found[s], i), (top, k)):
                for nodes in tree[:-1]:
                    run, at, j = nodes[at // 3 * 3 : at // 3 * 3 + 3], at // 3, at % 3
                    proof += "".join(run[:j] + run[j + 1 :])
                    h = sha("".join(run[:j]) + h + "".join(run[j + 1 :]))
            out.append((r[0], found[s][0][i], found[s][-1][0], top[-1][0], sha(proof), h, h == top[-1][0]))
    return out


def check(docs):
    got = [tuple(r) for r in merkle.report(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]), key=repr)
    return got


def test_query(spark, sf_dir, documents):
    assert op11_merkle(spark, sf_dir).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = check(documents)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [4, 729, 2188])
def test_sizes_of_trees(spark, n):
    """Trees of one leaf, whole blocks, one leaf beyond a block, and several passes."""
    docs = spark.range(n).selectExpr("id doc_id", "if(id < 2, null, 'all') source", "'en' lang", "id n_chars", "concat('text\n', id) text").repartition(5)
    check(docs)


def test_three_passes(spark):
    docs = spark.range(500).selectExpr("id doc_id", "if(id < 400, 'hot', concat('s', id % 40)) source", "'en' lang", "id n_chars", "concat('text\n', id) text")
    fields = [F.col(c) for c in merkle.COLUMNS]
    made = merkle.manifest(docs, merkle.leaf(fields), "source", "doc_id", levels=2)
    assert made.store.passes == 3 and {r[3] for r in plain([tuple(r) for r in docs.select(*merkle.COLUMNS).collect()])} == {made.root}
    ends = made.proofs().select(merkle.leads_to(F.col("hash"), F.col("path")).alias("root"))
    assert ends.count() == 500 and ends.where(F.col("root") != made.root).count() == 0
    assert made.store.nodes().where("tree = '=hot' and level = 1").count() == 134


def test_tables(edge, empty):
    got = check(edge.withColumnRenamed("b", "a.b").withColumnRenamed("x", "tree").withColumnRenamed("n", "pos"))
    assert len(got) == edge.count()
    assert merkle.report(empty).collect() == []
