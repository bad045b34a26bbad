"""Sources, stores, images, models, whole runs and streaming."""

import base64
import json
import os
import struct
import threading
import tracemalloc
import zlib
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.__main__ import main
from docflow.config import DEFAULTS, Settings
from docflow.operators import images, models
from docflow.plans import pipeline
from docflow.sources import listing, manifest, stores
from docflow.sources.buckets import Buckets
from docflow.streaming import ingest


def picture(seed: int, height: int = 30, width: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


@pytest.fixture()
def folder(tmp_path):
    """Images in two folders, with odd extensions and files that aren't images."""
    for k, name in enumerate(["a/1.png", "a/2.PNG", "a/3.txt", "b/1.png", "b/4.jpeg", "b/bad.png"]):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"no image" if "bad" in name or "jpeg" in name else images.encode_png(np.full((30, 20, 3), 10 * k, np.uint8)))
    return tmp_path


def test_image_files(spark, folder):
    rows = manifest.image_files(spark, f"file://{folder}/in")
    assert sorted((r.folder_name, r.file_name) for r in rows.drop("content").collect()) == [("a", "1.png"), ("a", "2.PNG"), ("b", "1.png"), ("b", "4.jpeg"), ("b", "bad.png")]
    assert "content" not in rows.drop("content")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1].split("\n")[0]
    assert manifest.listed(spark, root=f"file://{folder}/in").count() == 5


def test_manifest_caps(spark):
    items = spark.range(100).select(F.lit("f").alias("folder_name"), F.col("id").cast("string").alias("file_name"), F.col("id").alias("scan_pos"))
    done = items.where("scan_pos < 10")
    run = lambda **c: sorted(r.scan_pos for r in manifest.manifest(items, done, Settings(**c)).collect())
    assert run(fetch_limit=5, max_raw_scan=12) == [10, 11]
    assert run(fetch_limit=3, max_raw_scan=None) == [10, 11, 12]
    assert len(run(fetch_limit=None, max_raw_scan=None)) == 90


def test_keys_with_slashes_stay_apart(spark):
    items = spark.createDataFrame([("a/b", "c", 1), ("a", "b/c", 2)], "folder_name string, file_name string, scan_pos int")
    assert [r.scan_pos for r in manifest.without(items, items.where("scan_pos = 1")).collect()] == [2]


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ('{"f": {"1": ["a", "b"], "2": []}, "g": {"1": ["c"]}}', {("f", "1"): ["a", "b"], ("f", "2"): [], ("g", "1"): ["c"]}),
        ('{"f": {"1": ["a"]', {}), ("", {}), ("[1]", {}), ('{"f": {"1": ["a"]}, "f": {"2": ["b"]}}', {("f", "1"): ["a"], ("f", "2"): ["b"]}),
    ],
)
def test_read_store(spark, tmp_path, content, expected):
    path = tmp_path / "store.json"
    path.write_text(content)
    assert {(r.folder_name, r.file_name): r.lines for r in stores.read_store(spark, f"file://{path}").collect()} == expected
    assert stores.read_store(spark, f"file://{tmp_path}/none.json").count() == 0


def test_store_round_trip_and_upsert(spark, tmp_path):
    old = spark.createDataFrame([("f", "1", ["a"]), ("f", "2", ["b"])], "folder_name string, file_name string, lines array<string>")
    new = spark.createDataFrame([("f", "2", ["é"], 1), ("f", "2", ["d"], 2), ("g", "1", [], 0)], "folder_name string, file_name string, lines array<string>, seq int")
    merged = stores.upsert(old.withColumn("seq", F.lit(0)), new, order=["seq"]).drop("seq")
    stores.write_store(merged, f"file://{tmp_path}/out")
    back = {(r.folder_name, r.file_name): r.lines for r in stores.read_store(spark, f"file://{tmp_path}/out", by_line=True).collect()}
    assert back == {("f", "1"): ["a"], ("f", "2"): ["d"], ("g", "1"): []}
    odd = merged.unionByName(spark.createDataFrame([('q"\\ {', "1", ["x"])], merged.schema))
    stores.write_document(odd, f"file://{tmp_path}/one")
    (text,) = [p.read_text() for p in (tmp_path / "one").glob("part-*")]
    assert json.loads(text) == {"f": {"1": ["a"], "2": ["d"]}, "g": {"1": []}, 'q"\\ {': {"1": ["x"]}}
    assert stores.read_store(spark, f"file://{tmp_path}/one").count() == 4
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert [json.loads(x) for x in text.splitlines()]
    report = stores.report(merged, merged.where("false"), refine=lambda rows: rows.where("size(lines) > 0"))
    stores.write_report(report, f"file://{tmp_path}/csv")
    rows = spark.read.option("header", True).csv(f"file://{tmp_path}/csv").collect()
    assert len(rows) == 2 and {r.kind for r in rows} == {"printed"}


def test_decisions_round_trip(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"f": {"1": {"is_handwritten": True, "_cfg": "x", "decision": "tile_vote", "handwritten_ratio": 0.8}}}))
    r = stores.read_decisions(spark, f"file://{tmp_path}/f.json").first()
    assert r.decision.is_handwritten and r.decision.handwritten_ratio == 0.8 and r.decision.error is None


SEEN: list[dict] = []


class Service(BaseHTTPRequestHandler):
    """Two folders, listed two entries a page."""

    FOLDERS = [{"id": "x", "name": "first"}, {"id": "y", "name": "second"}, {"id": "z", "name": "third"}]
    FILES = {"x": 5, "y": 0, "z": 1}

    def do_GET(self):
        from urllib.parse import parse_qs, urlparse

        q = parse_qs(urlparse(self.path).query)
        SEEN.append(q)
        if q.get("alt") == ["media"]:
            name = urlparse(self.path).path.rpartition("/")[2]
            self.answer(f"bytes of {name}".encode(), "image/png") if name != "x2" else self.send_error(404)
            return
        parent = q["q"][0].split("'")[1]
        if parent == "html":
            self.answer(b"<html>", "text/html")
            return
        every = self.FOLDERS if parent == "root" else [{"id": f"{parent}{k}", "name": f"{k}.{'png' if k % 2 == 0 else 'txt'}", "mimeType": "x"} for k in range(self.FILES[parent])]
        at = int(q.get("pageToken", ["0"])[0])
        body = {"files": every[at : at + 2]} | ({"nextPageToken": str(at + 2)} if at + 2 < len(every) else {})
        self.answer(json.dumps(body).encode(), "application/json")

    def answer(self, body, kind):
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture()
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/files"
    server.shutdown()


def test_paged_listing(spark, service):
    listing.register(spark)
    rows = spark.read.format("paged_listing").options(url=service, root="root").load()
    found = manifest.only_images(rows).orderBy("scan_pos").collect()
    assert [(r.folder_name, r.file_id) for r in found] == [("first", "x0"), ("first", "x2"), ("first", "x4"), ("third", "z0")]
    SEEN.clear()
    shared = spark.read.format("paged_listing").options(url=service, root="root", params="supportsAllDrives=true&includeItemsFromAllDrives=true").load()
    assert shared.count() == 6 and all(q["supportsAllDrives"] == q["includeItemsFromAllDrives"] == ["true"] for q in SEEN)
    got = {r.file_id: r for r in listing.downloaded(manifest.only_images(rows), service).collect()}
    assert got["x0"].content == b"bytes of x0" and got["x0"].error is None and got["z0"].content == b"bytes of z0"
    assert got["x2"].content is None and "404" in got["x2"].error
    with pytest.raises(listing.ListingError):
        listing.get_json(service, {"q": "'html' in parents"})
    with pytest.raises(listing.ListingError):
        listing.get_json("http://127.0.0.1:9/x", {}, timeout=2)


def test_png_round_trip_and_channels():
    for k, shape in enumerate([(1, 1), (7, 13), (64, 3)]):
        p = picture(k, *shape)
        assert (images.decode_png(images.encode_png(p)) == p).all()
    for bad in (b"", b"\x89PNG\r\n\x1a\n", b"GIF89a", images.encode_png(picture(1))[:60]):
        with pytest.raises(images.ImageError):
            images.decode_png(bad)
    assert images.three_channels(np.zeros((2, 2), np.uint8)).shape == (2, 2, 3)
    assert images.three_channels(np.zeros((2, 2, 4), np.uint8)).shape == (2, 2, 3)
    assert (images.to_rgb(picture(1))[..., 0] == picture(1)[..., 2]).all()


def test_png_of_the_jvm(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.png").write_bytes(images.encode_png(picture(3)))
    r = spark.read.format("image").load(f"file://{tmp_path}/i").select("image.*").first()
    assert (images.from_spark(r.height, r.width, r.nChannels, bytes(r.data)) == picture(3)).all()
    with pytest.raises(images.ImageError):
        images.from_spark(-1, -1, -1, b"")


def test_shrinking():
    p = np.zeros((100, 50, 3), np.uint8)
    p[:, 25:] = 200
    s = images.shrunk(p, 20)
    assert s.shape == (20, 10, 3) and (s[:, :5] == 0).all() and (s[:, 5:] == 200).all()
    assert images.shrunk(p, 100) is p
    assert abs(images.shrunk(picture(1, 90, 70), 33).mean() - picture(1, 90, 70).mean()) < 2


def otsu_by_hand(pixels: np.ndarray) -> float:
    best, level = -1.0, 0
    for t in range(256):
        a, b = pixels[pixels <= t], pixels[pixels > t]
        v = len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else -1.0
        if v > best * (1 + 1e-12):
            best, level = v, t
    return float((pixels <= level).mean())


def test_ink_density(spark):
    r = np.random.default_rng(2)
    for k in range(10):
        pixels = np.where(r.random(400) < 0.1 * k, r.integers(0, 60, 400), r.integers(150, 256, 400)).astype(np.uint8)
        assert abs(images.ink_density(pixels.reshape(20, 20)) - otsu_by_hand(pixels)) < 1e-9
    assert images.ink_density(np.zeros((0, 5, 3), np.uint8)) == 0.0


def test_ink_of_a_batch_without_copies():
    """A batch's pixels aren't copied into Python objects; null and empty ones have no ink."""
    rows = [bytes([k % 256, 255] * 2000) for k in range(3000)] + [None, b""]
    data, size = pa.array(rows, pa.binary()), [len(x or b"") for x in rows]
    tracemalloc.start()
    got = images.ink_densities(data, pa.array(size, pa.int32()), pa.array([1] * len(rows), pa.int32()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < data.nbytes / 4
    assert got.to_pylist() == [images.ink_density(np.frombuffer(x, np.uint8)) if x else 0.0 for x in rows]


def test_encoding_for_requests():
    small, large = images.encode_png(picture(1)), images.encode_png(picture(1, 900, 100))
    text, mime = images.encoded(small, "x.PNG")
    assert base64.b64decode(text) == small and mime == "image/png"
    assert max(images.decode_png(base64.b64decode(images.encoded(large, "x.png")[0])).shape) == 720
    assert images.encoded(b"\xff\xd8jpeg", "x.jpg") == (base64.b64encode(b"\xff\xd8jpeg").decode(), "image/jpeg")
    for name in ("x.gif", "x"):
        with pytest.raises(images.ImageError):
            images.encoded(small, name)


def test_retries_and_host():
    waits, calls = [], []

    def fails(n):
        def call():
            calls.append(1)
            if len(calls) <= n:
                raise RuntimeError(f"no {len(calls)}")
            return "yes"

        return call

    assert models.with_retries(fails(2), 3, waits.append) == ("yes", None) and waits == [2, 4]
    calls.clear()
    assert models.with_retries(fails(9), 3, waits.append) == (None, "no 3") and len(calls) == 3
    seen = []
    with models.running_host(lambda: seen.append("start") or True, lambda: seen.append("stop"), lambda: len(seen) > 2, pause=seen.append):
        seen.append("work")
    assert seen == ["start", 90, 10, "work", "stop"] or seen[-1] == "stop"
    clock = iter(range(0, 10_000, 400))
    with pytest.raises(TimeoutError), models.running_host(lambda: False, lambda: seen.append("off"), lambda: False, pause=lambda s: None, clock=lambda: next(clock)):
        pass
    assert seen[-1] == "off"
    body = models.request_body("AAA", "image/png")
    assert body["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,AAA" and body["temperature"] == 0


def test_recognised_batches_fail_alone(spark):
    rows = spark.createDataFrame([("f", str(k), bytes([k])) for k in range(4)], "folder_name string, file_name string, content binary").coalesce(1)

    def broken():
        def read(batch):
            if b"\x02" in batch:
                raise RuntimeError("boom")
            return [[([0, 0, 1, 1], "t", 0.9)] for _ in batch]

        return read

    got = {r.file_name: r.error for r in models.recognised(rows, ["folder_name", "file_name"], {"a": broken, "b": models.stand_in_recogniser}, batch=2).collect()}
    assert got == {"0": None, "1": None, "2": "boom", "3": "boom"}


def test_whole_run_is_resumed(spark, folder):
    items = manifest.image_files(spark, f"file://{folder}/in").withColumn("scan_pos", F.xxhash64("file_id"))
    out, settings = f"file://{folder}/out", Settings(fetch_limit=None, max_raw_scan=None, attempts=1)
    echo = lambda: lambda image, mime: f"  read \n\n{mime} "
    hand = lambda: lambda batch: [(0.05, 0.95) for _ in batch]
    first = pipeline.run(spark, items, out, echo, hand, settings=settings, tasks=2, wait=0.0)
    assert first["images"] == first["handwritten"] == 3 and first["printed"] == 0
    assert (first["todo"], first["from_cache"], first["undecided"], first["failed"]) == (5, 0, 2, 2)
    rows = pipeline.stored(spark, f"{out}/handwritten", pipeline.LINE_STORE).collect()
    assert all(r.lines == ["read", "image/png"] for r in rows)
    again = pipeline.run(spark, items, out, echo, hand, settings=settings, tasks=2, wait=0.0)
    assert again == first | {"todo": 2, "from_cache": 2}
    assert pipeline.report(spark, out).count() == 3
    printed = lambda: lambda batch: [(0.95, 0.05) for _ in batch]
    other = pipeline.run(spark, items, f"file://{folder}/other", echo, printed, settings=settings, tasks=2, wait=0.0)
    assert other["printed"] == other["images"] == 3 and other["failed"] == 2


@pytest.mark.parametrize("stage", ["handwritten", "printed", "decisions"])
def test_broken_run_goes_on_behind_its_last_part(spark, tmp_path, stage):
    """The first run breaks off at its seventh page of a stage; the second one repeats one part at most."""
    for k in range(12):
        (tmp_path / "in" / "f").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "f" / f"{k}.png").write_bytes(images.encode_png(np.full((30, 20, 3), 20 * k, np.uint8)))
    asked = tmp_path / "asked"
    asked.mkdir()

    def count(limit: int, n: int = 1) -> None:
        for _ in range(n):
            if len(list(asked.iterdir())) >= limit:
                raise SystemExit("the worker is gone")
            (asked / str(len(list(asked.iterdir())))).touch()

    def transcriber(limit: int):
        def ask(image, mime):
            if stage == "handwritten":
                count(limit)
            return "read"

        return lambda: ask

    def recogniser(limit: int):
        def read(batch):
            if stage == "printed":
                count(limit, len(batch))
            return [[([0, 0, 90, 20], "read", 0.9)] for _ in batch]

        return {"one": lambda: read}

    def scorer(limit: int):
        def score(batch):
            if stage == "decisions":
                count(limit, len(batch))
            return [(0.05, 0.95) if stage == "handwritten" else (0.95, 0.05) for _ in batch]

        return lambda: score

    settings = Settings(fetch_limit=None, max_raw_scan=None, attempts=1, concurrency=1, recogniser_batch=1, printed_save_every=1, handwritten_save_every=1, decisions_save_every=1)
    items = manifest.image_files(spark, f"file://{tmp_path}/in").drop("content")
    run = lambda limit: pipeline.run(spark, items, f"file://{tmp_path}/out", transcriber(limit), scorer(limit), recogniser(limit), settings, fetch=manifest.with_content, order="file_id", tasks=1, wait=0.0)
    with pytest.raises(Exception, match="the worker is gone|SystemExit|Python worker"):
        run(6)
    kept, paid = Buckets(spark, f"file://{tmp_path}/out/{stage}").count(), len(list(asked.iterdir()))
    counts = run(1000)
    assert counts["images"] == 12 and counts["failed"] == 0 and counts["printed" if stage == "decisions" else stage] == 12
    again = len(list(asked.iterdir())) - paid - (12 - kept)
    assert again <= 0 and paid - kept <= 12
    rows = pipeline.report(spark, f"file://{tmp_path}/out").collect()
    assert sorted(r.file_name for r in rows) == sorted(f"{k}.png" for k in range(12)) and all(r.content == "read" for r in rows)


def test_equal_pages_are_decided_once(spark, tmp_path):
    """Models see each distinct page once, and every item gets its page's decision."""
    seen = tmp_path / "seen"

    def scorer():
        def score(batch):
            with seen.open("a") as f:
                f.writelines(f"{images.png_size(x)}\n" for x in batch)
            return [(0.5, 0.5) if images.png_size(x) == (48, 48) else (0.05, 0.95) for x in batch]

        return score

    page = np.full((48, 48), 255, np.uint8)
    page[::4] = 0
    other = images.encode_png(images.three_channels(255 - page))
    kinds = [images.encode_png(images.three_channels(page)), other, b"\xff\xd8", None]
    items = spark.createDataFrame([("f", f"{k}.png", kinds[k % 4]) for k in range(40)], "folder_name string, file_name string, content binary")
    cache = spark.createDataFrame([], pipeline.DECISION_STORE)
    got = {x.file_name: x.decision for x in pipeline.classified(items, cache, scorer).collect()}
    assert len(got) == 40
    for k in range(40):
        assert got[f"{k}.png"].decision == ("tile_vote" if k % 4 < 2 else "error")
    assert seen.read_text().splitlines().count("(48, 48)") == 2


def test_files_of_one_name_are_one_item(spark, tmp_path):
    """Two files of one folder and name give one decision and one row, by the one that comes last in order."""
    page = lambda k: images.encode_png(np.full((30, 20, 3), 40 * k, np.uint8))
    rows = [("f", "1.png", f"id{k}", k, page(k)) for k in range(3)] + [("f", "2.png", "id9", 9, page(5)), ("g", "1.png", "id8", 8, None)]
    items = spark.createDataFrame(rows, "folder_name string, file_name string, file_id string, scan_pos long, content binary")
    asked = tmp_path / "asked"
    asked.mkdir()

    def ask(image, mime):
        (asked / str(zlib.crc32(base64.b64decode(image)))).open("a").write("x")
        return "read"

    hand = lambda: lambda batch: [(0.05, 0.95) for _ in batch]
    counts = pipeline.run(spark, items, f"file://{tmp_path}/out", lambda: ask, hand, settings=Settings(attempts=1), tasks=1, wait=0.0)
    assert counts == {"images": 2, "printed": 0, "handwritten": 2, "todo": 3, "from_cache": 0, "undecided": 1, "failed": 1}
    assert {p.name: p.read_text() for p in asked.iterdir()} == {str(zlib.crc32(page(k))): "x" for k in (2, 5)}
    assert Buckets(spark, f"file://{tmp_path}/out/decisions").rows().count() == 3


def test_command_line(spark, tmp_path, service, monkeypatch, capsys):
    monkeypatch.setenv("HANDWRITTEN_MAX_RETRIES", "1")
    monkeypatch.setenv("HANDWRITTEN_ENDPOINT", "http://127.0.0.1:9")
    store = f"file://{tmp_path}/out"
    where = ["--root", "root", "--url", service, "--store", store]
    main(["preview", *where, "-n", "2"], spark)
    assert "only showing top 2 rows" in capsys.readouterr().out
    counts = main(["run", *where], spark)
    assert counts["todo"] == 4 and counts["failed"] >= 1 and counts["images"] + counts["failed"] == 4
    main(["report", "--store", store, "--out", f"file://{tmp_path}/csv"], spark)
    assert spark.read.option("header", True).option("multiLine", True).csv(f"file://{tmp_path}/csv").count() == counts["images"]


def test_host_is_up_only_for_handwritten_pages(spark, folder):
    seen = []

    @contextmanager
    def host():
        seen.append("up")
        yield
        seen.append("down")

    items = manifest.image_files(spark, f"file://{folder}/in").withColumn("scan_pos", F.xxhash64("file_id"))
    for k, score in enumerate([(0.95, 0.05), (0.05, 0.95)]):
        scorer = lambda score=score: lambda batch: [score for _ in batch]
        pipeline.run(spark, items, f"file://{folder}/out{k}", lambda: lambda image, mime: "x", scorer, settings=Settings(attempts=1), host=host, wait=0.0)
    assert seen == ["up", "down"]


def png(head: tuple, raw: bytes, palette: bytes = b"") -> bytes:
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_of_all_kinds():
    r = np.random.default_rng(7)
    grey = r.integers(0, 256, (11, 13)).astype(np.uint8)
    deep = b"".join(b"\0" + np.stack([line, 255 - line], 1).tobytes() for line in grey)
    assert (images.decode_png(png((13, 11, 16, 0, 0, 0, 0), deep))[..., 1] == grey).all()
    laced = b"".join(b"\0" + line.tobytes() for y, x, down, right in images.PASSES for line in grey[y::down, x::right])
    assert (images.decode_png(png((13, 11, 8, 0, 0, 0, 1), laced))[..., 0] == grey).all()
    for depth in (1, 2, 4):
        low = (grey >> (8 - depth)).astype(np.uint8)
        bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - depth :].reshape(11, -1)
        raw = b"".join(b"\0" + line.tobytes() for line in np.packbits(bits, axis=1))
        assert (images.decode_png(png((13, 11, depth, 0, 0, 0, 0), raw))[..., 2] == low * (255 // (2**depth - 1))).all()
        table = r.integers(0, 256, (2**depth, 3)).astype(np.uint8)
        assert (images.decode_png(png((13, 11, depth, 3, 0, 0, 0), raw, table.tobytes())) == table[low][:, :, ::-1]).all()


def jvm_jpeg(spark, grey: np.ndarray) -> bytes:
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(grey.shape[1], grey.shape[0], 10)
    flat = spark.sparkContext._gateway.new_array(jvm.int, grey.size)
    for k, x in enumerate(grey.ravel().tolist()):
        flat[k] = x
    image.getRaster().setPixels(0, 0, grey.shape[1], grey.shape[0], flat)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_open_jpeg_pages_and_pages_that_cannot_be_read(spark, tmp_path):
    page = np.full((120, 96), 255, np.uint8)
    for y in range(8, 120, 24):
        for x in range(8, 96, 24):
            page[y : y + 8, x : x + 8] = 0
    ruled = np.full((320, 320), 255, np.uint8)
    for y in range(8, 320, 16):
        ruled[y : y + 4, 4:316] = 0
    ruled[4:316, 78:82] = 0
    good, table = jvm_jpeg(spark, page), jvm_jpeg(spark, ruled)
    deep = png((96, 120, 16, 0, 0, 0, 0), b"".join(b"\0" + np.repeat(line, 2).tobytes() for line in page))
    files = {"a.jpg": good, "b.JPEG": good, "c.png": deep, "ruled.jpg": table, "cut.jpg": good[:40], "bad.jpeg": b"no image", "bad.png": images.SIGNATURE}
    for name, data in files.items():
        (tmp_path / "in" / "f").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "f" / name).write_bytes(data)
    hand = lambda: lambda batch: [(0.5, 0.5) if images.png_size(x) in ((96, 120), (320, 320)) else (0.05, 0.95) for x in batch]
    items = manifest.image_files(spark, f"file://{tmp_path}/in").withColumn("scan_pos", F.xxhash64("file_id"))
    echo = lambda: lambda image, mime: f"read {mime}"
    counts = pipeline.run(spark, items, f"file://{tmp_path}/out", echo, hand, settings=Settings(fetch_limit=None, max_raw_scan=None, attempts=1), tasks=2, wait=0.0)
    got = {r.file_name: r.decision for r in Buckets(spark, f"file://{tmp_path}/out/decisions").rows().collect()}
    assert set(got) == set(files)
    for name in ("a.jpg", "b.JPEG", "c.png"):
        assert (got[name].decision, got[name].is_handwritten, got[name].error) == ("tile_vote", True, None)
    assert got["ruled.jpg"].decision == "structural_table_override"
    for name in ("cut.jpg", "bad.jpeg", "bad.png"):
        assert got[name].decision == "error" and got[name].error and not got[name].is_handwritten
    assert counts == {"images": 4, "printed": 1, "handwritten": 3, "todo": 7, "from_cache": 0, "undecided": 3, "failed": 3}


def test_stream_takes_up_where_it_ended(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    work = lambda rows: rows.select("folder_name", "file_name", F.length("content").alias("n"))

    def step(names):
        for n in names:
            (src / n).write_bytes(n.encode())
        ingest.ingest(ingest.image_stream(spark, f"file://{src}"), f"file://{tmp_path}/store", f"file://{tmp_path}/checkpoint", work)
        table = Buckets(spark, f"file://{tmp_path}/store")
        return {r.file_name for r in table.rows().collect()}, table.generations()[-1]

    assert step(["1.png", "2.JPG", "x.txt"]) == ({"1.png", "2.JPG"}, 0)
    assert step(["3.png"]) == ({"1.png", "2.JPG", "3.png"}, 1)
    assert step([])[1] == 1
    assert DEFAULTS.fetch_limit == 25 and os.path.isdir(src)
