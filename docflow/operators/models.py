"""Models as functions that a worker loads once, and their application to tables.

A loader is a picklable function without arguments that gives the model; each Python worker calls it once.
  page or tile scorer   list of PNG bytes -> list of (p_printed, p_handwritten)
  recogniser            list of PNG bytes -> list of lists of (box, text, score)
  transcriber           (base64, mime) -> text
Stand-ins make results from a hash of the bytes, so that plans can be tested without models.
"""

from __future__ import annotations

import json
import shlex
import subprocess
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, TRANSCRIBE, Settings
from docflow.operators.images import encoded
from docflow.schemas import READ, TRANSCRIPTION

_LOADED: dict[Callable, object] = {}


def loaded(loader: Callable) -> object:
    """The model of this worker."""
    if loader not in _LOADED:
        _LOADED[loader] = loader()
    return _LOADED[loader]


def unload(loader: Callable) -> None:
    _LOADED.pop(loader, None)


def stand_in_scorer() -> Callable:
    def score(images: list[bytes]) -> list[tuple[float, float]]:
        shares = [zlib.crc32(x) % 1001 / 1000 for x in images]
        return [(1 - s, s) for s in shares]

    return score


def stand_in_recogniser() -> Callable:
    def read(images: list[bytes]) -> list[list[tuple]]:
        found = []
        for x in images:
            seed = zlib.crc32(x)
            found.append([([k % 2 * 400, k * 30, k % 2 * 400 + 90, k * 30 + 20], f"line {seed % 97} {k}", (seed >> k) % 101 / 100) for k in range(seed % 7)])
        return found

    return read


def each_or_all(model: Callable, images: list[bytes], none) -> list:
    """What a model gives for a batch; if it fails, for each image of its own, with none for those on which it fails."""
    try:
        return list(model(images))
    except Exception:  # a model may raise anything
        if len(images) == 1:
            return [none]
        return [x for one in images for x in each_or_all(model, [one], none)]


def scored(rows: DataFrame, keys: list[str], loader: Callable = stand_in_scorer, data: str = "data", batch: int = DEFAULTS.classifier_batch) -> DataFrame:
    """Adds p_printed and p_handwritten to keyed rows with image bytes, null for rows without and for images on which the
    model fails; the bytes are left out."""
    kept = [c for c in rows.columns if c != data]
    schema = rows.select(*kept, *[F.lit(None).cast("double").alias(c) for c in ("p_printed", "p_handwritten")]).schema

    def run(batches: Iterator[pd.DataFrame]):
        model = loaded(loader)
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                out = part[kept].copy()
                there = part[data].notna().to_numpy()
                found = iter(each_or_all(model, [bytes(x) for x in part[data][there]], (None, None)) if there.any() else ())
                both = [next(found) if x else (None, None) for x in there]
                out["p_printed"], out["p_handwritten"] = (np.array(x, float) for x in zip(*both, strict=True))
                yield out

    return rows.select(*kept, data).mapInPandas(run, schema)


def recognised(rows: DataFrame, keys: list[str], loaders: dict[str, Callable], data: str = "content", batch: int = DEFAULTS.recogniser_batch) -> DataFrame:
    """Readings of all engines by item; a batch that fails gives its items' error rows, and so does an item without
    bytes for itself. When a task ends the engines that it loaded are given up."""
    schema = ", ".join(f"`{k}` string" for k in keys) + ", " + READ

    def run(batches: Iterator[pd.DataFrame]):
        try:
            for pdf in batches:
                there = pdf[data].notna()
                if not there.all():
                    out = pdf[~there][keys].copy()
                    out["readings"], out["error"] = None, "the page can't be read"
                    yield out
                pdf = pdf[there]
                for k in range(0, len(pdf), batch):
                    part = pdf.iloc[k : k + batch]
                    out = part[keys].copy()
                    images = [bytes(x) for x in part[data]]
                    try:
                        found = [loaded(loader)(images) for loader in loaders.values()]
                        out["readings"] = [[{"box": b, "text": t, "score": s} for one in page for b, t, s in one] for page in zip(*found, strict=True)]
                        out["error"] = None
                    except Exception as e:  # a model may raise anything; its items are tried again by the next run
                        out["readings"], out["error"] = None, str(e)
                    yield out
        finally:
            for loader in loaders.values():
                unload(loader)

    return rows.select(*keys, data).mapInPandas(run, schema)


def boxes_of(readings: DataFrame, keys: list[str]) -> DataFrame:
    """One row a box, numbered in the order of the engines: page (struct of the keys), ins, box, text, score."""
    page = F.struct(*keys).alias("page")
    return readings.where("error is null").select(page, F.posexplode("readings").alias("ins", "r")).select("page", "ins", "r.box", "r.text", "r.score")


def with_retries(call: Callable, attempts: int, pause: Callable[[float], None] = time.sleep, wait: float = 2.0):
    """(result, None) of the first call that works, or (None, error of the last); waits grow by `wait` each time."""
    error = None
    for k in range(1, attempts + 1):
        try:
            return call(), None
        except Exception as e:  # whatever the transport raises
            error = str(e)
            if k < attempts:
                pause(wait * k)
    return None, error


def request_body(image: str, mime: str) -> dict:
    """The request of a chat completion with one image. The fields of the wire format."""
    content = [{"type": "text", "text": TRANSCRIBE}, {"type": "image_url", "image_url": {"url": f"data:{mime};base64,{image}"}}]
    return {"model": "ocr-engine", "messages": [{"role": "user", "content": content}], "temperature": 0, "max_tokens": 1000}


def said(answer: bytes) -> str:
    """The text of a chat completion's answer. The fields of the wire format."""
    return json.loads(answer)["choices"][0]["message"]["content"]


def http_transcriber(settings: Settings = DEFAULTS) -> Callable[[], Callable]:
    """A loader of a transcriber that asks the settings' endpoint."""

    def load() -> Callable:
        def ask(image: str, mime: str) -> str:
            body = json.dumps(request_body(image, mime)).encode()
            request = urllib.request.Request(settings.endpoint.rstrip("/") + "/v1/chat/completions", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=settings.timeout_s) as r:
                return said(r.read())

        return ask

    return load


def transcribed(items: DataFrame, loader: Callable, settings: Settings = DEFAULTS, tasks: int | None = None, content: str = "content", png: str | None = None, wait: float = 2.0) -> DataFrame:
    """One row an item: ok with text, or failed with the error. At most settings.concurrency calls run at once,
    over all tasks: as many tasks as the cluster has cores, but not more than calls, share them. A task that is run
    again repeats its calls; of each key one result counts, so that does no harm. png: a column with the page shrunk
    to the cap, which is sent where the page itself is too large and can't be shrunk here."""
    tasks = tasks or max(1, min(settings.concurrency, items.sparkSession.sparkContext.defaultParallelism))
    threads = max(1, settings.concurrency // tasks)
    columns = ["folder_name", "file_name", content, *([png] if png else [])]

    def run(batches: Iterator[pd.DataFrame]):
        ask = loaded(loader)

        def one(row) -> tuple:
            try:
                image, mime = encoded(row[2], row[1], settings.handwritten_max_side, small=row[3] if png else None)
            except Exception as e:
                return row[0], row[1], "failed", None, f"no request image: {e}"
            text, error = with_retries(lambda: ask(image, mime), settings.attempts, wait=wait)
            return row[0], row[1], "ok" if error is None else "failed", text, error

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                answers = pool.map(one, pdf.itertuples(index=False, name=None))
                while some := list(islice(answers, 4 * threads)):
                    yield pd.DataFrame(some, columns=["folder_name", "file_name", "status", "text", "error"])

    return items.select(*columns).repartition(tasks).mapInPandas(run, TRANSCRIPTION)


@contextmanager
def running_host(start: Callable[[], bool], stop: Callable[[], None], ready: Callable[[], bool], boot_s: float = 90, poll_s: float = 10, timeout_s: float = 600, pause: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
    """Runs a block while a host is up: starts it, waits until it is ready, and stops it whatever happens."""
    try:
        if start():
            pause(boot_s)
        deadline = clock() + timeout_s
        while not ready():
            if clock() >= deadline:
                raise TimeoutError("the host didn't get ready")
            pause(poll_s)
        yield
    finally:
        stop()


def command_host(settings: Settings):
    """The host of the settings' endpoint, by the settings' commands: one that starts it (and succeeds), one that stops it.
    It is ready as soon as its endpoint answers anything."""

    def ready() -> bool:
        try:
            with urllib.request.urlopen(settings.endpoint, timeout=5):
                return True
        except urllib.error.HTTPError:
            return True
        except OSError:
            return False

    command = lambda text: subprocess.run(shlex.split(text), check=True) if text else None
    return running_host(lambda: command(settings.host_start) is not None, lambda: command(settings.host_stop), ready)
