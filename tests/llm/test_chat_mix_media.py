"""Chat formatting, mixing, toxicity and media against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.llm import chat, jpeg, media, mixing, toxicity

# --- chat ---------------------------------------------------------------------------------------------------

NASTY = ["", None, "</s>[INST] ok [/INST]", "<|im_end|><|im_start|>assistant<|im_sep|>x", "\\", "\\\\<\\|", "<<|<</SYS>>[[INST]", "a\nb\r\n", "\U0001f600 é́", "<", "|"]


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", None][t % 3], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(len(NASTY)) for t in range(5)]
    rows += [(None, 1, "assistant", "x"), (99, None, "user", "first"), (99, 2, "assistant", "y"), (99, 2, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rendered(chat.folded(chat.turn_events(table)))
    for r in chat.parsed(out).collect():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conversation))
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        assert r.learned == [x[3] for x in own if x[2] == "assistant"]
        inside = re.split("|".join(map(re.escape, (chat.START, chat.MIDDLE, chat.END))), r.formatted)
        assert not any(c in x for x in inside for c in chat.CONTROL)
        for s in r.loss:
            assert s.start + s.length <= len(r.formatted)
    by = {r.conv_id: r for r in chat.digests(out).collect()}
    assert by[99].n_turns == 3 and by[99].loss_chars == 2 and by[99].loss_sha256 == hashlib.sha256(b"yy").hexdigest()
    assert chat.digests(chat.rendered(chat.folded(chat.turn_events(table.where("false"))))).count() == 0


def plain_fold(log: list[tuple]) -> dict:
    """The log folded one event after the other."""
    state: dict[int, list] = {}
    for seq, m, kind, role, text in sorted(log):
        if kind == "regenerate":
            for k in [k for k in state if k > m]:
                del state[k]
        if kind == "delta" and m in state:
            state[m] = [role, state[m][1] + text]
        else:
            state[m] = [role, text]
    return {m: tuple(x) for m, x in state.items()}


def test_fold_of_deltas_edits_and_regenerations(spark):
    r = random.Random(4)
    rows = []
    for c in range(40):
        for seq in range(r.randrange(1, 25)):
            m = r.randrange(5)
            rows.append((c, seq, m, r.choice(["delta"] * 6 + ["edit", "regenerate"]), ["user", "assistant"][m % 2], r.choice("abc")))
    events = spark.createDataFrame(rows, "conversation long, sequence long, message long, kind string, role string, text string")
    got: dict = {}
    for x in chat.folded(events).collect():
        got.setdefault(x.conversation, {})[x.message] = (x.role, x.text)
    assert got == {c: plain_fold([x[1:] for x in rows if x[0] == c]) for c in range(40)}


def test_role_on_the_first_delta_only(spark):
    rows = [(1, 1, 1, "delta", "user", "q"), (1, 2, 2, "delta", "assistant", "a"), (1, 3, 2, "delta", None, "b"), (1, 4, 2, "delta", "", "c"), (1, 5, 3, "delta", None, "d")]
    rows += [(2, 1, 1, "delta", "user", "q"), (2, 2, 2, "delta", "assistant", "a"), (2, 3, 2, "edit", None, "new"), (2, 4, 2, "delta", None, "er")]
    events = spark.createDataFrame(rows, "conversation long, sequence long, message long, kind string, role string, text string")
    messages = chat.folded(events)
    got = {(x.conversation, x.message): (x.role, x.text) for x in messages.collect()}
    assert got == {(1, 1): ("user", "q"), (1, 2): ("assistant", "abc"), (1, 3): ("", "d"), (2, 1): ("user", "q"), (2, 2): ("assistant", "newer")}
    assert {r.conversation: r.learned for r in chat.parsed(chat.rendered(messages)).collect()} == {1: ["abc"], 2: ["newer"]}


def test_chat_is_native(spark):
    table = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.rendered(chat.folded(chat.turn_events(table))))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and plan.count("Exchange hashpartitioning") == 1


# --- mixing -------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0.001, 100), min_size=1, max_size=12))
def test_schedule_stays_within_a_block(weights):
    share = {s: 1 + int(w * 10) for s, w in weights.items()}
    total, seen = sum(share.values()), dict.fromkeys(share, 0)
    for k, (s, _, t, _) in enumerate(mixing._scheduled(share, share)):
        assert k == t
        seen[s] += 1
        assert all(abs(seen[x] - share[x] * (t + 1) / total) < 1 for x in share)
    assert seen == share


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0.01, 50), min_size=1, max_size=9))
def test_schedule_is_earliest_deadline_first(weights):
    """The first phase, slot by slot from the definition: of the sources whose next block is released, the one of
    earliest deadline; of equal ones the heavier, then the first by name."""
    from fractions import Fraction

    share = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    got = [s for s, *_ in mixing._scheduled(dict.fromkeys(weights, 400), weights)]
    seen, end = dict.fromkeys(weights, 0), 400 / max(share.values()) - 2 / min(share.values())
    for t, s in enumerate(got):
        if t >= end:  # from here on windows reach into the next phase, of other rates
            break
        ready = [x for x in share if seen[x] / share[x] // 1 <= t]
        assert s == min(ready, key=lambda x: (-((seen[x] + 1) / share[x] // -1), -weights[x], x))
        seen[s] += 1


def test_mix_is_the_same_for_any_ranges(spark, documents, monkeypatch):
    expected = sorted(tuple(r) for r in mixing.report(documents, block_bytes=2048).collect())
    monkeypatch.setattr(mixing, "BUCKET_BYTES", 2000)
    assert sorted(tuple(r) for r in mixing.report(documents, block_bytes=2048).collect()) == expected


def test_mixing_places_every_row(spark, documents, edge, empty):
    block = 2048
    rows = mixing.report(documents, block_bytes=block).join(documents.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id").collect()
    assert len(rows) == documents.count()
    slot_of, start = {}, {}
    for r in rows:
        assert 0 <= r.offset < block
        assert slot_of.setdefault((r.source, r.block), r.slot) == r.slot
        start.setdefault(r.source, []).append((r.block * block + r.offset, r.bytes))
    assert len(set(slot_of.values())) == len(slot_of)
    for x in start.values():
        x.sort()
        at = 0
        for place, size in x:
            assert place == at
            at += size
    total = {s: sum(n for _, n in x) for s, x in start.items()}
    plan = mixing.phases({s: -(-n // block) for s, n in total.items()}, {s: n**0.5 for s, n in total.items()})
    ends = {s: max(e for _, k, _, e, *_ in plan if k == s) for s in total}
    assert ends == {s: -(-n // block) for s, n in total.items()}
    assert mixing.report(edge).count() == edge.count()
    mixed = mixing.mixed(edge)
    assert mixed.columns == edge.columns and mixed.count() == edge.count()
    assert mixing.report(empty).count() == 0


def test_mixing_to_given_weights(spark):
    docs = spark.createDataFrame([(k, "x" * 100, "big" if k % 4 else "small") for k in range(4000)], "doc_id long, text string, source string")
    rows = mixing.report(docs, weights={"small": 0.5, "big": 0.5}, block_bytes=1000).where("phase = 0").collect()
    last = max(r.slot for r in rows)
    blocks = {s: len({r.block for r in rows if r.source == s}) for s in ("big", "small")}
    assert blocks["small"] == 100 and abs(blocks["big"] - blocks["small"]) <= 1 and last in (198, 199)


def test_mixing_many_sources(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), (F.col("id") % 300).cast("string").alias("source"))
    assert mixing.report(docs, block_bytes=4).select("slot").distinct().count() == 600


def plain_shares(blocks: dict, weights: dict, slots: int) -> dict:
    """Blocks that each source would have by then if slots could be shared out at will."""
    from fractions import Fraction

    left, got, t = {s: Fraction(n) for s, n in blocks.items() if n}, dict.fromkeys(blocks, Fraction(0)), Fraction(slots)
    while left and t > 0:
        rate = {s: Fraction(weights[s]) / sum(Fraction(weights[k]) for k in left) for s in left}
        step = min(t, *(left[s] / rate[s] for s in left))
        for s in rate:
            got[s] += rate[s] * step
            left[s] -= rate[s] * step
        left, t = {s: n for s, n in left.items() if n > 0}, t - step
    return got


def test_mixing_gives_each_of_many_sources_its_share(spark):
    """300 sources, one of which has a third of the bytes: each follows its own bytes to the power of 0.5."""
    block = 64
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("x" * 16).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 299).cast("string")).alias("source"))
    rows = mixing.report(docs, block_bytes=block).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 9000
    count, slots = {}, {}
    for r in rows:
        count[r.source] = count.get(r.source, 0) + 1
        slots.setdefault(r.source, {})[r.block] = r.slot
    blocks = {s: -(-n * 16 // block) for s, n in count.items()}
    assert len(count) == 300 and {s: len(x) for s, x in slots.items()} == blocks
    assert sorted(t for x in slots.values() for t in x.values()) == list(range(sum(blocks.values())))
    for t in (1, 100, 700, 1500, 2100, sum(blocks.values()) - 1):
        share = plain_shares(blocks, {s: float(n * 16) ** 0.5 for s, n in count.items()}, t)
        assert all(abs(sum(x < t for x in slots[s].values()) - share[s]) < 1 for s in slots)


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.tuples(st.floats(1e-5, 100), st.integers(1, 400)), min_size=1, max_size=8))
def test_schedule_stays_within_a_block_of_given_weights(sources):
    weights, blocks = {s: w for s, (w, _) in sources.items()}, {s: n for s, (_, n) in sources.items()}
    seen = dict.fromkeys(sources, 0)
    for k, (s, i, t, _) in enumerate(mixing._scheduled(blocks, weights)):
        assert (i, t) == (seen[s], k)
        seen[s] += 1
        if k % 37 == 0:
            share = plain_shares(blocks, weights, t + 1)
            assert all(abs(seen[x] - share[x]) < 1 for x in seen)
    assert seen == blocks


def test_schedule_keeps_small_weights_over_many_slots():
    weights = {"a": 1 / 3 + 1e-4, "b": 2 / 3 - 1e-4 - 1e-5, "rare": 1e-5}
    total = sum(weights.values())
    seen, n = dict.fromkeys(weights, 0), 210_000
    for s, _, t, number in mixing._scheduled({"a": n, "b": n, "rare": n}, weights):
        if t == n:
            break
        seen[s] += 1
        assert number == 0
        if t % 100 == 99:
            assert all(abs(seen[x] - weights[x] / total * (t + 1)) < 1 + 1e-6 for x in seen)
    assert seen["rare"] in (2, 3)


def test_sources_of_no_weight_come_last(spark):
    docs = spark.createDataFrame([(k, "x" * 100, "abcn"[k % 4]) for k in range(400)], "doc_id long, text string, source string")
    rows = mixing.report(docs, weights={"a": 0.75, "b": 0.25, "n": 0.0}, block_bytes=1000).collect()
    slots = {s: {r.slot for r in rows if r.source == s} for s in "abcn"}
    assert max(slots["a"] | slots["b"]) == 19 and slots["c"] | slots["n"] == set(range(20, 40)) and len(rows) == 400
    assert {r.phase for r in rows if r.source in "cn"} == {2}
    with pytest.raises(ValueError):
        mixing.report(docs, weights={"a": -1.0})


def test_a_thousand_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), (F.col("id") % 1000).cast("string").alias("source"))
    rows = mixing.report(docs, weights={"7": 0.375}, block_bytes=4).collect()
    assert sorted(r.slot for r in rows) == list(range(3000)) and [r.slot for r in sorted(rows, key=lambda r: r.slot) if r.source == "7"] == [0, 2, 5]


# --- toxicity -----------------------------------------------------------------------------------------------


def test_severity_is_a_plain_cumulative_logit(spark):
    """Grades, counts and probabilities written out, against the scorer."""
    weights, cuts = {"=bad": 2.0, "badl": 0.7, "badly": -0.3, "=x": 0.5}, [1.0, 1.5, 3.0]
    model = toxicity.OrdinalModel(weights, cuts)
    texts = ["", None, "good words only", "Bad bad BAD badly", "x badly9badlyish x_x", "bad " * 5000]
    expected = []
    for text in texts:
        found: dict = {}
        for word in re.findall("[a-z]+", (text or "").lower()):
            for f in {"=" + word} | {word[:n] for n in (4, 5, 6) if n < len(word)}:
                found[f] = found.get(f, 0) + 1
        used = {f: n for f, n in found.items() if f in weights}
        score = sum(weights[f] * np.log(1 + n) for f, n in used.items())
        above = [1 / (1 + np.exp(c - score)) for c in cuts]
        grade = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        expected.append(sum(g * p for g, p in enumerate(grade)) if used else 0.0)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.severity for r in toxicity.scored(table, model).orderBy("doc_id").collect()]
    assert np.allclose(got, expected, atol=1e-12)


def test_repeated_keys_and_labels_count_once(spark):
    docs = labels = toxic_table(spark)
    one = toxicity.fit(docs, labels)
    more = docs.unionByName(docs.where("doc_id % 50 = 1").crossJoin(spark.range(40).select("id")).drop("id"))
    again = labels.unionByName(labels.where("doc_id % 3 = 0"))
    assert toxicity.fit(more, again) == one


def toxic_table(spark, n=400):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(5))
    rows = []
    for k in range(n):
        bad = k % 4 == 0
        words = [word() for _ in range(r.randrange(10, 60))]
        for _ in range(r.randrange(2, 12) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["vileword", "nastyish", "nastylike"]))
        rows.append((k, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(spark):
    table = toxic_table(spark)
    model = toxicity.fit(table, table.where("doc_id < 250"))
    assert model.thresholds == sorted(model.thresholds)
    out = toxicity.scored(table, model).where("doc_id >= 250").collect()
    assert sum((r.severity >= toxicity.CUT) == bool(r.toxic) for r in out) >= 0.97 * len(out)
    many, few = (toxicity.Scorer(model).severities(["vileword " * n])[0] for n in (12, 2))
    assert 0.5 < few < many <= toxicity.GRADES - 1


def test_toxicity_edge(edge, empty, spark):
    table = toxic_table(spark, 200)
    labels = table.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    model = toxicity.fit(table, labels)
    rows = toxicity.scored(edge, model).collect()
    assert len(rows) == edge.count() and all(r.severity < toxicity.CUT for r in rows)
    assert toxicity.clean(edge, labels).columns == edge.columns
    assert toxicity.report(empty, labels).count() == 0
    none = toxicity.fit(table, labels.where("toxic = 0"))
    assert toxicity.Scorer(none).severities(["vileword", ""]) == [0.0, 0.0]


def test_ordinal_gradient_finds_order():
    r = np.random.default_rng(0)
    x = r.normal(size=600)
    grades = np.digitize(x + 0.1 * r.normal(size=600), [-0.5, 0.5, 1.2])
    w, t = toxicity.fit_ordinal(np.arange(600), np.zeros(600, int), x, grades, np.ones(600), 1, steps=1500)
    assert w[0] > 2 and (np.diff(t) > 0).all()
    assert np.allclose(t / w[0], [-0.5, 0.5, 1.2], atol=0.15)


# --- media --------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=4))
def test_media_round_trip(parts):
    studio = media.Studio()
    payloads = [media.padded(p) for p in parts]
    assert all(len(p) % media.FRAME == 0 and p for p in payloads)
    files = studio.store(payloads)
    back, clips = studio.read(files)
    assert back == payloads
    for f, c in zip(files, clips, strict=True):
        frames = media.parse_avi(f)[0]
        assert c[0]["first_frame"] == 0 and sum(x["frames"] for x in c) == len(frames)
        assert all(a["end_s"] == b["start_s"] for a, b in zip(c[:-1], c[1:], strict=True))


def test_lossless_jpeg_hard_samples():
    jpeg = media.LosslessJpeg()
    r = np.random.default_rng(1)
    frames = np.stack([np.zeros((24, 24)), np.full((24, 24), 255), np.indices((24, 24)).sum(0) % 2 * 255, r.integers(0, 256, (24, 24))]).astype(np.uint8)
    files = jpeg.encode(frames)
    assert (jpeg.decode(files) == frames).all()
    moved = files[3][:2] + b"\xff\xfe\x00\x06note" + files[3][2:]
    assert (jpeg.decode([moved])[0] == frames[3]).all()


def test_media_faults():
    studio = media.Studio()
    good = studio.store([media.padded(b"abc" * 500)])[0]
    for bad in (b"", b"RIFF....WAVE", good[:200], good.replace(b"idx1", b"idx0"), good.replace(b"\xff\xc3", b"\xff\xc0")):
        with pytest.raises((ValueError, IndexError)):
            studio.read([bad])


def test_files_of_several_parts_or_streams_are_refused():
    good = media.Studio().store([media.padded(b"abc" * 500)])[0]
    assert media.parse_avi(good)[0]
    with pytest.raises(ValueError, match="behind the first RIFF"):
        media.parse_avi(good + media._chunk(b"RIFF", b"AVIX" + media._chunk(b"LIST", b"movi" + media._chunk(b"00dc", b"frame"))))
    at = good.index(b"strl") - 8
    stream = good[at : at + 8 + int.from_bytes(good[at + 4 : at + 8], "little")]
    body = good[8:at] + stream + good[at:]
    head = body.index(b"hdrl") - 4
    size = int.from_bytes(body[head : head + 4], "little") + len(stream)
    with pytest.raises(ValueError, match="several video streams"):
        media.parse_avi(media._chunk(b"RIFF", body[:head] + size.to_bytes(4, "little") + body[head + 4 :]))


def test_shots_are_found():
    level = lambda v, n: np.full((n, 24, 24), v, np.uint8)
    frames = np.concatenate([level(10, 12), level(200, 9), level(90, 14)])
    d = media.histogram_differences(frames, np.array([len(frames) - 1]))
    assert media.shots(d[:-1]) == [0, 12, 21]
    calm = np.random.default_rng(0).integers(0, 256, (40, 24, 24)).astype(np.uint8)
    assert media.shots(media.histogram_differences(calm, np.array([39]))[:-1]) == [0]


def test_media_tables(edge, empty):
    rows = media.round_trip(edge).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in edge.collect()}
    assert len(rows) == edge.count()
    for r in rows:
        payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 4)}) == 1
    clips = media.clips(media.store(edge, into="film"), "film").collect()
    assert {r.doc_id for r in clips} == set(texts) and all(r.end_s > r.start_s for r in clips)
    assert media.round_trip(empty).count() == 0 and media.clips(media.store(empty)).count() == 0


def jvm_jpeg(spark, pixels: np.ndarray) -> bytes:
    """A baseline JPEG that the JVM's encoder writes; grey or colour."""
    jvm = spark._jvm
    kind = 5 if pixels.ndim == 3 else 10
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], kind)
    flat = spark.sparkContext._gateway.new_array(jvm.int, pixels.size)
    for k, x in enumerate(pixels.ravel().tolist()):
        flat[k] = x
    image.getRaster().setPixels(0, 0, pixels.shape[1], pixels.shape[0], flat)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_baseline_frames(spark):
    y, x = np.indices((21, 30))
    grey = (40 + 5 * x + 3 * y).clip(0, 255).astype(np.uint8)
    data = jvm_jpeg(spark, grey)
    assert np.abs(jpeg.luminance(data).astype(int) - grey).mean() < 3
    at = data.index(b"\xff\xc4")
    size = int.from_bytes(data[at + 2 : at + 4], "big") + 2
    assert (jpeg.luminance(data[:at] + data[at + size :]) == jpeg.luminance(data)).all()
    colour = np.stack([grey, 255 - grey, grey // 2], axis=2)
    luma = colour @ np.array([0.299, 0.587, 0.114])
    assert np.abs(jpeg.luminance(jvm_jpeg(spark, colour)) - luma).mean() < 6
    dark, light = jvm_jpeg(spark, grey // 8), jvm_jpeg(spark, 255 - grey // 8)
    film = media.avi([dark] * 7 + [light] * 5, 30, 21, 10)
    assert [(c["first_frame"], c["start_s"], c["end_s"]) for c in media.Studio().clips([film])[0]] == [(0, 0.0, 0.7), (7, 0.7, 1.2)]
    for bad in (b"", data[:50], data.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.luminance(bad)
