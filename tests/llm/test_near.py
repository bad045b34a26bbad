"""MinHash, components, fingerprints and shards against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docflow.llm import components, fingerprint, minhash, sharding
from docflow.llm.queries import QUERIES


def brute(rows: list[tuple], words: int, percent: int) -> dict:
    """(n_shingles, component) by key; keys unique."""
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(s), top(k)) for k, s in sets.items()}


def varied(seed: int = 3) -> list[tuple]:
    """Families of near copies at many similarities, copies, chains and unrelated texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows = []
    for _ in range(8):
        base = [word() for _ in range(r.choice([6, 30, 80, 200]))]
        for _ in range(25):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t))
            base = t if r.random() < 0.1 else base
    rows += [" ".join(word() for _ in range(50)) for _ in range(40)] + ["", " ", "a", "A", "a b", "b a"]
    r.shuffle(rows)
    return [(k * 3, t) for k, t in enumerate(rows)]


def check(spark, rows, words, percent, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words, percent, **more).collect()}
    expected = brute(rows, words, percent)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == expected
    assert all(r.kept == (r.component_id == k) for k, r in got.items())


def test_near_duplicates(spark):
    check(spark, varied(), 3, 85)


def test_near_duplicates_in_blocks(spark):
    check(spark, varied(5), 5, 80, unit=3000)


def test_large_and_small_clusters_compare_the_same_pairs(spark):
    """One rule at every size: pairs that share a band key, found alike however a cluster is dealt."""
    docs = spark.createDataFrame(varied(11), "doc_id long, text string")
    found = [sorted(tuple(r) for r in minhash.near_duplicates(docs, 3, 85, unit=u).collect()) for u in (700, 2_000_000)]
    assert all(x == found[0] for x in found)


def test_recall_on_documents(spark, sf_dir):
    """All links of the table at three words and 85 %, against brute force over its inverted shingles."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    sets, holders = {}, {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {hash(tuple(w[i : i + 3])) for i in range(max(1, len(w) - 2))} if w else set()
        for x in sets[k]:
            holders.setdefault(x, []).append(k)
    both: dict = {}
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                both[a, b] = both.get((a, b), 0) + 1
    linked = [p for p, n in both.items() if 100 * n >= 85 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    component = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert len(linked) > 90 and all(component[a] == component[b] for a, b in linked)
    assert len(set(component.values())) == len(rows) - len(set(component) - {k for k, c in component.items() if k == c})


def test_rows_of_one_key_and_different_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "other")]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_near_duplicates_edge(edge, empty):
    rows = minhash.near_duplicates(edge, 3, 85).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == edge.count() and len(by[4]) == 2
    assert {r.component_id for r in [*by[1], *by[4]]} == {1}
    assert [(r.n_shingles, r.component_id, r.kept) for r in (by[2] + by[3] + by[5])] == [(0, 2, True), (0, 3, True), (0, 5, True)]
    assert by[9][0].component_id == 8
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicated(edge, words=3, percent=85)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 5, 6, 7, 8, 10]


def test_estimates_are_close():
    r = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        pool = r.integers(0, 2**63, 4000, dtype=np.uint64)
        same = int(2000 * 2 * share / (1 + share))
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - same : 4000 - same])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        words = np.ascontiguousarray(minhash.packed(minhash.minima([a, b]))).view(np.uint64)
        assert abs(minhash.estimates(words[:1], words[1:])[0, 0] - true) < 0.12


def test_word_hashes():
    r = random.Random(4)
    words = sorted({"".join(r.choice("abé日\0") for _ in range(r.choice([0, 1, 2, 7, 8, 9, 15, 16, 17, 40, 2000]))) for _ in range(3000)})
    hashes = minhash.word_hashes(pa.array(words, pa.string()))
    assert len(set(hashes.tolist())) == len(words)
    assert (minhash.word_hashes(pa.array(["x", *words], pa.string())[1:]) == hashes).all()
    assert len(minhash.word_hashes(pa.array([], pa.string()))) == 0
    one = minhash.Shingler(2).sets(["A b\x0bC", "", " a  B c ", None, "a\x85b", "x"])
    assert (one[0] == one[2]).all() and [len(x) for x in one] == [2, 0, 2, 0, 1, 1]


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(45)] + [(7, 7), (5, None)]
    found = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(61))
    for a, b in edges:
        if b is not None and a != b:
            assert found[a] == found[b]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST_HUB", 3)
    monkeypatch.setattr(components, "HUBS", 40)
    r = random.Random(2)
    edges = [(1000, k) for k in range(200, 300)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(250, 350), (5, 1000)]
    found = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {k: k for e in edges for k in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: x for k, x in found.items()} == {k: x for k, x in root.items() if k in found} and found[1000] == 5


def winnowed(text: str) -> list[tuple[int, int]]:
    import re

    tokens = re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text)
    p, b, k, w = fingerprint.PRIME, fingerprint.BASE, fingerprint.K, fingerprint.WINDOW
    one = [(xxhash.xxh64(t.encode(), seed=42).intdigest() & p) % p for t in tokens]
    n = max(1, len(one) - k + 1) if one else 0
    grams = []
    for i in range(n):
        h = 0
        for x in one[i : i + k]:
            h = (h * b + x) % p
        grams.append(h)
    picked = []
    for i in range(max(1, n - w + 1) if n else 0):
        window = grams[i : i + w]
        least = min(window)
        at = i + max(j for j, x in enumerate(window) if x == least)
        if (least, at) not in picked:
            picked.append((least, at))
    return picked


def test_fingerprints(edge, documents, texts):
    for rows in (edge, documents.where("n_chars < 4000")):
        for r in fingerprint.fingerprints(rows).join(rows.select("doc_id", "text"), "doc_id").collect():
            assert [(x.hash, x.place) for x in r.fingerprint] == winnowed(r.text or "")


def test_fingerprint_guarantee():
    r = random.Random(2)
    shared = " ".join(str(r.randrange(10**6)) for _ in range(fingerprint.WINDOW + fingerprint.K - 1))
    a, b = ("".join(f"{r.randrange(10**6)} " for _ in range(40)) + shared + "".join(f" {r.randrange(10**6)}" for _ in range(33)) for _ in range(2))
    assert {h for h, _ in winnowed(a)} & {h for h, _ in winnowed(b)}


def test_fingerprint_guarantee_without_spaces(spark):
    """A passage within long runs is found at every offset, of Chinese, base64 and code points beyond 16 bits."""
    r = random.Random(3)
    signs = [[chr(0x4E00 + k) for k in range(3000)], list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), [chr(0x20000 + k) for k in range(500)]]
    n = fingerprint.WINDOW + fingerprint.K + fingerprint.PIECE - 2
    rows = []
    for a, letters in enumerate(signs):
        some = lambda size: "".join(r.choice(letters) for _ in range(size))  # noqa: E731, B023
        shared = some(n)
        rows += [(100 * a + k, some(50 + k) + shared + some(70)) for k in range(2 * fingerprint.PIECE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: {m.hash for m in x.fingerprint} for x in fingerprint.fingerprints(docs, rolled=True).collect()}
    for k in got:
        assert got[k] & got[k // 100 * 100]
    assert not got[0] & got[100]


def test_query_rolls_over_long_runs(spark, tmp_path):
    r = random.Random(5)
    text = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(600))
    spark.createDataFrame([(k, text[k:]) for k in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in QUERIES["op10_fingerprint"](spark, str(tmp_path)).collect()}
    assert len(got) == 8 and all(got[k].near_next > 0.9 for k in range(7))


def test_rolled_tokens(spark):
    plain = "a bb  twelvetwelve 12345678\n1234567 \U0001f600\U0001f601 end"
    table = spark.createDataFrame([(plain,)], "text string")
    tokens = table.select(F.regexp_extract_all("text", F.lit(fingerprint.ROLLED), F.lit(1)).alias("t")).first().t
    assert tokens == ["a", "bb", "twelvetw", "welvetwe", "elvetwel", "lvetwelv", "vetwelve", "12345678", "1234567", "\U0001f600\U0001f601", "end"]
    short = spark.createDataFrame([(1, "one two three four five six " * 9), (2, "x"), (3, ""), (4, None)], "doc_id long, text string")
    assert fingerprint.fingerprints(short, rolled=True).collect() == fingerprint.fingerprints(short).collect()


def test_compared(documents, texts, edge, empty):
    got = {r.doc_id: r for r in fingerprint.compared(documents).collect()}
    keys = sorted(texts)
    for k, key in enumerate(keys):
        x, y = texts[key], texts[keys[(k + 1) % len(keys)]]
        cut = len(x) // 2
        edited = x[: len(x) - cut] + y[:cut]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        if len(x) < 3000:
            a, b, c = ({h for h, _ in winnowed(t)} for t in (x, edited, y))
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-9 and abs(r.near_next - len(a & c) / len(a | c)) < 1e-9
    assert fingerprint.compared(edge).count() == edge.count()
    assert fingerprint.compared(empty).count() == 0


def test_compared_in_buckets(documents, monkeypatch):
    expected = fingerprint.compared(documents).orderBy("doc_id").collect()
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 1)
    assert fingerprint.compared(documents).orderBy("doc_id").collect() == expected


def test_shards(documents, texts):
    n = 8
    rows = sharding.assign(documents, n, ["size", "lang", "text_crc32"]).collect()
    by, sizes = {}, [0] * n
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
        by.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
    assert len(rows) == len(texts) and sorted(by) == list(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def plain_tree(rows: list[tuple], first: int, shards: int, whole: list[int], largest: int) -> dict:
    """Shards by sorting: rows are (row, size, keys). A cut goes where the bytes come nearest to the share, and not
    through rows of one coordinate and text of at most the largest row's bytes."""
    if shards == 1 or len(rows) < 2:
        return {r[0]: first for r in rows}
    extent = [(max(r[2][d] for r in rows) - min(r[2][d] for r in rows)) / w for d, w in enumerate(whole)]
    d = extent.index(max(extent))
    rows = sorted(rows, key=lambda r: r[2][d])
    units: list[list] = []
    for r in rows:
        if units and units[-1][0][2][d] // sharding.GROUP == r[2][d] // sharding.GROUP:
            units[-1].append(r)
        else:
            units.append([r])
    units = [x for u in units for x in ([u] if sum(r[1] for r in u) <= largest and len(u) < len(rows) else [[r] for r in u])]
    target, before, cut = sum(r[1] for r in rows) * (shards // 2) / shards, 0, 0
    for k, u in enumerate(units):
        size = sum(r[1] for r in u)
        if before + size >= target:
            cut = min(max(1, k + (target - before > before + size - target)), len(units) - 1)
            break
        before += size
    left, right = ([r for u in part for r in u] for part in (units[:cut], units[cut:]))
    low = min(shards // 2, len(left))
    high = min(shards - low, len(right))
    low = min(shards - high, len(left))
    return plain_tree(left, first, low, whole, largest) | plain_tree(right, first + low, high, whole, largest)


@pytest.mark.parametrize(("shards", "dimensions"), [(7, ["size", "lang", "text_crc32"]), (40, ["n_chars", "source"])])
def test_shards_are_a_plain_tree(documents, shards, dimensions):
    docs = documents.unionByName(documents.limit(60).withColumn("doc_id", F.col("doc_id") + 100_000))
    rows, keys = sharding.metadata(docs, dimensions)
    plain = [(r.key, r["size"], [r[k] for k in keys]) for r in rows.collect()]
    whole = [max(1, max(r[2][d] for r in plain) - min(r[2][d] for r in plain)) for d in range(len(keys))]
    expected = plain_tree(plain, 0, shards, whole, max(r[1] for r in plain))
    assert {r.doc_id: r.shard for r in sharding.assign(docs, shards, dimensions).collect()} == expected


def test_shards_by_whole_strings_and_target_bytes(spark):
    """Strings of one beginning are told apart, in order."""
    rows = [(k, "x" * 84, f"https://host.example/{k // 10:03d}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.url` string")
    got = {r.doc_id: r.shard for r in sharding.assign(docs, None, ["a.url"], target_bytes=10_000).collect()}
    assert set(got.values()) == {0, 1, 2, 3} and [got[k] for k in range(400)] == sorted(got.values())


def test_shards_of_large_rows_go_back(spark):
    """Rows larger than a shard's share are alone, and all shards are used."""
    docs = spark.range(60).selectExpr("id doc_id", "repeat('x', if(id < 3, 30000, 100 + cast(id as int))) text")
    found = sharding.assign(docs, 12, ["size", "text_crc32"]).collect()
    assert {r.shard for r in found} == set(range(12))
    rows, keys = sharding.metadata(docs, ["size", "text_crc32"])
    plain = [(r.key, r["size"], [r[k] for k in keys]) for r in rows.collect()]
    whole = [max(1, max(r[2][d] for r in plain) - min(r[2][d] for r in plain)) for d in range(len(keys))]
    assert {r.doc_id: r.shard for r in found} == plain_tree(plain, 0, 12, whole, max(r[1] for r in plain))


def test_more_than_a_thousand_shards(spark):
    docs = spark.range(6000).selectExpr("id as `my.id`", "repeat('x', 80 + cast(id * 7 % 13 as int)) text", "id * 31 % 6000 place")
    counts = [r.n for r in sharding.assign(docs, None, ["place", "size"], key="my.id", target_bytes=500).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(counts) > 1100 and sum(counts) == 6000 and max(counts) <= 7


def test_shards_edge(edge, empty, spark):
    rows = sharding.assign(edge, 5, ["size", "lang", "n_chars"]).collect()
    assert len(rows) == edge.count() and {r["size"] for r in rows if r.doc_id in (2, 3)} == {16}
    assert sharding.assign(empty, 5, ["size", "lang"]).count() == 0
    same = spark.createDataFrame([(k, "same text") for k in range(40)], "doc_id long, text string")
    counts = {r.shard: r.n for r in sharding.assign(same, 4, ["size", "text_crc32"]).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 10, 1: 10, 2: 10, 3: 10}


def test_duplicates_of_repeated_keys_and_clashing_names(spark):
    """A key's other text doesn't keep its duplicate; columns of any names, keys with dots."""
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(3, a), (5, a), (5, b), (6, a + "  "), (7, b), (8, None), (8, None), (8, ""), (None, a), (None, "no key here at all but words")]
    docs = spark.createDataFrame(rows, "`my.id` long, text string").withColumn("__kept", F.lit(77)).withColumn("KEY", F.lit(1)).withColumn("row", F.lit(2))
    out = minhash.deduplicated(docs, key="my.id")
    assert out.columns == docs.columns
    assert sorted(((r["my.id"], r.text) for r in out.collect()), key=repr) == sorted([(3, a), (5, b), (8, None), (8, ""), (None, "no key here at all but words")], key=repr)
    assert {(r["__kept"], r["KEY"], r["row"]) for r in out.collect()} == {(77, 1, 2)}
    assert minhash.near_duplicates(docs, key="my.id").count() == len(rows)
