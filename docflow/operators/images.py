"""Image kernels on NumPy, and the columns made of them.

Images are arrays height x width x 3 of bytes in BGR order. decode_png reads PNG of all kinds inside a Python
stage; with_png has Spark's image source decode all other files on the JVM.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.config import DEFAULTS
from docflow.sources.work import delete, forget, work_dir, written

MIME = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png"}


class ImageError(ValueError):
    """Bytes that aren't an image that can be read here."""


def three_channels(pixels: np.ndarray) -> np.ndarray:
    """Grey repeated thrice, alpha left out."""
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    if pixels.shape[2] in (1, 2):
        return np.repeat(pixels[:, :, :1], 3, axis=2)
    return pixels[:, :, :3]


def from_spark(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Pixels of a row of Spark's image source."""
    if height <= 0 or width <= 0:
        raise ImageError("the image can't be decoded")
    return three_channels(np.frombuffer(data, np.uint8).reshape(height, width, channels))


SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour types of PNG: bit depths and samples of a pixel.
KINDS = {0: ((1, 2, 4, 8, 16), 1), 2: ((8, 16), 3), 3: ((1, 2, 4, 8), 1), 4: ((8, 16), 2), 6: ((8, 16), 4)}
#: Passes of an interlaced PNG: first line and column, steps of lines and columns.
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def given(data: bytes | None) -> bytes:
    """The bytes of a column; null is an error."""
    if data is None:
        raise ImageError("the image can't be decoded")
    return bytes(data)


def decode_png(data: bytes) -> np.ndarray:
    """A PNG in BGR; of samples of 16 bits the upper 8."""
    if data[:8] != SIGNATURE:
        raise ImageError("not a PNG file")
    at, head, palette, parts = 8, None, None, []
    try:
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                parts.append(body)
            at += 12 + size
        if head is None or head[2] not in KINDS.get(head[3], ((), 0))[0] or head[6] not in (0, 1) or not head[0] or not head[1]:
            raise ImageError("a PNG without a valid header")
        width, height, depth, kind, *_, laced = head
        n, raw = KINDS[kind][1], np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
        image = np.zeros((height, width, n), np.uint8)
        for y, x, down, right in PASSES if laced else [(0, 0, 1, 1)]:
            part = image[y::down, x::right]
            if part.size:
                samples, raw = _samples(raw, *part.shape, depth)
                part[:] = samples * (255 // (2**depth - 1)) if depth < 8 and kind == 0 else samples
        if kind == 3:
            image = palette[image[:, :, 0]]
    except (zlib.error, struct.error, ValueError, IndexError, TypeError) as e:
        raise e if isinstance(e, ImageError) else ImageError(f"damaged PNG data: {e}") from e
    image = three_channels(image)
    return image[:, :, ::-1] if kind in (2, 3, 6) else image


def _samples(raw: np.ndarray, height: int, width: int, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples height x width x n of filtered lines, and the data after them."""
    size, step = -(-width * n * depth // 8), max(1, n * depth // 8)
    lines = raw[: height * (1 + size)].reshape(height, 1 + size)
    pixels = np.zeros((height, size), np.uint8)
    above = np.zeros(size, np.uint8)
    for y in range(height):
        line, filter_ = lines[y, 1:], lines[y, 0]
        if filter_ == 0:
            above = line
        elif filter_ == 1:
            above = (np.cumsum(line.reshape(-1, step).astype(np.int64), axis=0) & 255).astype(np.uint8).ravel()
        elif filter_ == 2:
            above = line + above
        else:
            above = _slow_filter(line, above, step, int(filter_))
        pixels[y] = above
    if depth == 16:
        pixels = pixels[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(pixels, axis=1).reshape(height, -1, depth)
        pixels = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * n]
    return pixels.reshape(height, width, n), raw[height * (1 + size) :]


def _slow_filter(line: np.ndarray, above: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Average and Paeth lines, in which each sample needs the one before it."""
    out, up = [0] * len(line), above.tolist()
    for k, v in enumerate(line.tolist()):
        a, b, c = (out[k - n] if k >= n else 0), up[k], (up[k - n] if k >= n else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = (v + guess) & 255
    return np.array(out, np.uint8)


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of a BGR image."""
    height, width = image.shape[:2]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), image[:, :, ::-1].reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def shrunk(image: np.ndarray, cap: int) -> np.ndarray:
    """The image with its longer side at most the cap, each new pixel the mean of the area that it covers."""
    height, width = image.shape[:2]
    if max(height, width) <= cap:
        return image
    scale = cap / max(height, width)
    size = max(1, int(height * scale)), max(1, int(width * scale))
    out = image.astype(np.float64)
    for axis in (0, 1):
        out = _area_mean(out, axis, size[axis])
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _area_mean(x: np.ndarray, axis: int, n: int) -> np.ndarray:
    """Means over n equal parts of an axis; parts may cut through samples."""
    total = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis=axis)], axis=axis)
    edge = np.arange(n + 1) * (x.shape[axis] / n)
    low = np.minimum(edge.astype(int), x.shape[axis] - 1)
    shape = [1] * x.ndim
    shape[axis] = n + 1
    at = np.take(total, low, axis) + np.take(x, low, axis) * (edge - low).reshape(shape)
    return np.diff(at, axis=axis) / (x.shape[axis] / n)


def to_rgb(image: np.ndarray) -> np.ndarray:
    return image[:, :, ::-1]


def grey(image: np.ndarray) -> np.ndarray:
    """Luminance, with the usual weights of blue, green and red."""
    return np.rint(image.astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu(histogram: np.ndarray) -> int:
    """The level that parts a histogram into two classes of largest variance between them."""
    n, levels = histogram.sum(), np.arange(len(histogram))
    below = np.cumsum(histogram)
    mass = np.cumsum(histogram * levels)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / n - mass) ** 2 / (below * (n - below))
    between[~np.isfinite(between)] = -1
    return int(between.argmax())


def ink_density(image: np.ndarray) -> float:
    """Share of pixels that aren't brighter than Otsu's level; 0 without pixels."""
    if not image.size:
        return 0.0
    histogram = np.bincount(grey(image).ravel() if image.ndim == 3 else image.ravel(), minlength=256)
    return float(histogram[: otsu(histogram) + 1].sum() / histogram.sum())


def cut_tiles(image: np.ndarray, grid: tuple[int, int] = (3, 2)) -> list[tuple[int, int, np.ndarray]]:
    """(row, column, pixels) of the tiles that have pixels, row by row."""
    height, width = image.shape[:2]
    rows, cols = grid
    found = ((r, c, image[height * r // rows : height * (r + 1) // rows, width * c // cols : width * (c + 1) // cols]) for r in range(rows) for c in range(cols))
    return [t for t in found if t[2].size]


def png_size(data: bytes) -> tuple[int, int]:
    """Width and height in a PNG's header."""
    if data[:8] != SIGNATURE or len(data) < 24:
        raise ImageError("not a PNG file")
    return struct.unpack(">II", data[16:24])


def jpeg_size(data: bytes) -> tuple[int, int]:
    """Width and height in a JPEG's frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 1 if kind == 0xFF else 2 + (0 if kind == 1 or 0xD0 <= kind <= 0xD7 else struct.unpack(">H", data[at + 2 : at + 4])[0])
    raise ImageError("not a JPEG file with a frame")


def within(data: bytes, cap: int) -> bytes:
    """A PNG as it is, or shrunk so that its longer side is the cap."""
    return data if max(png_size(data)) <= cap else encode_png(shrunk(decode_png(data), cap))


def encoded(data: bytes | None, name: str, cap: int = DEFAULTS.handwritten_max_side, small: bytes | None = None) -> tuple[str, str]:
    """Base64 and MIME type of an image for a request, no side beyond the cap.

    The type follows the name; other names are errors. An image that needs no shrinking goes as it is. A PNG is shrunk
    here; a JPEG is sent as the PNG of it that is given as small, or an error if there is none.
    """
    mime = MIME.get("." + name.rpartition(".")[2].lower()) if "." in name else None
    if mime is None:
        raise ImageError(f"unsupported image type: {name}")
    data = given(data)
    if data[:8] == SIGNATURE:
        decode_png(data)
        shrunk_to = within(data, cap)
        return base64.b64encode(shrunk_to).decode(), mime if shrunk_to is data else "image/png"
    try:
        fits = max(jpeg_size(data)) <= cap
    except ImageError:
        fits = mime == "image/jpeg" and data[:2] == b"\xff\xd8" and small is None
        if not fits and small is None:
            raise
    if not fits and small is None:
        raise ImageError("the image is too large, and there is no smaller one of it")
    return (base64.b64encode(data).decode(), "image/jpeg") if fits else (base64.b64encode(within(bytes(small), cap)).decode(), "image/png")


def ink_densities(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Ink density of each row's grey pixels. They are looked at where they lie: a batch has thousands of rows, of which no
    copies are made."""
    rows = zip(data, width.to_pylist(), height.to_pylist(), strict=True)
    return pa.array([ink_density(np.frombuffer(d.as_buffer(), np.uint8).reshape(h, w)) if d.is_valid and len(d.as_buffer()) else 0.0 for d, w, h in rows], pa.float64())


def ink_column(data: Column, width: Column, height: Column) -> Column:
    """Ink density of grey pixels (binary), by Arrow batches."""

    @F.arrow_udf("double")
    def run(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        return ink_densities(data, width, height)

    return run(data, width, height)


def with_png(pages: DataFrame, content: str = "content", cap: int = DEFAULTS.classifier_max_side) -> DataFrame:
    """Adds png: a PNG's own bytes; of any other file a PNG, shrunk to the cap, of what Spark's image source reads.

    It is null where that can't read the file. The source reads files only, so tasks write the bytes of these pages
    to the work folder, equal ones once, each attempt to files of its own; only those of the job that succeeded are joined.
    """
    spark = pages.sparkSession
    folder = work_dir(spark)
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    plain = F.coalesce(F.substring(content, 1, 8) == F.lit(SIGNATURE), F.lit(False))

    def store(batches):
        system, path = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            out = pdf[["__digest"]].copy()
            out["__file"] = [uuid.uuid4().hex for _ in range(len(pdf))]
            for name, data in zip(out["__file"], pdf[content], strict=True):
                with system.open_output_stream(f"{path}/{name}") as file:
                    file.write(bytes(data) if data is not None else b"")
            yield out

    def convert(batches):
        for pdf in batches:
            out = pdf[["__file"]].copy()
            out["__png"] = [encode_png(shrunk(from_spark(h, w, n, bytes(d)), cap)) for h, w, n, d in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True)]
            yield out

    digest = F.sha2(content, 256)
    kept = written(pages.where(~plain).select(digest.alias("__digest"), content).dropDuplicates(["__digest"]).mapInPandas(store, "__digest string, __file string"))
    read = spark.read.format("image").option("ignoreCorruptFiles", True).load(folder)
    found = read.select(F.regexp_extract("image.origin", "([^/]*)$", 1).alias("__file"), "image.height", "image.width", "image.nChannels", "image.data").where("height > 0 and width > 0")
    made = written(kept.join(found.mapInPandas(convert, "__file string, __png binary"), "__file").drop("__file"))
    forget(kept)
    delete(spark, folder)
    both = pages.withColumn("__digest", digest).join(made, "__digest", "left")
    return both.select(*pages.columns, F.when(plain, F.col(content)).otherwise(F.col("__png")).alias("png"))


def capped(pages: DataFrame, cap: int, png: str = "png") -> DataFrame:
    """Pages with every PNG beyond the cap shrunk to it; one that is damaged becomes null."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf[png] = [_within_or_none(x, cap) for x in pdf[png]]
            yield pdf

    return pages.mapInPandas(run, pages.schema)


def _within_or_none(data: bytes | None, cap: int) -> bytes | None:
    try:
        return within(bytes(data), cap) if data is not None else None
    except ImageError:
        return None


def tiles_of(pages: DataFrame, keys: list[str], content: str = "content", grid: tuple[int, int] = DEFAULTS.tile_grid, cap: int = DEFAULTS.classifier_max_side) -> DataFrame:
    """Tiles of each page with their ink and PNG bytes; a page that can't be decoded gives one row with the error."""
    schema = ", ".join(f"`{k}` string" for k in keys) + ", tile_row int, tile_col int, ink double, data binary, error string"

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                key = [getattr(row, k) for k in keys]
                try:
                    image = shrunk(decode_png(given(getattr(row, content))), cap)
                    rows += [(*key, r, c, ink_density(t), encode_png(t), None) for r, c, t in cut_tiles(image, grid)]
                except ImageError as e:
                    rows.append((*key, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[*keys, "tile_row", "tile_col", "ink", "data", "error"])

    return pages.select(*keys, content).mapInPandas(run, schema)
