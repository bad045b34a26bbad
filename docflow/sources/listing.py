"""A Spark data source that lists folders and files of a REST service page by page.

The service answers GET <url>?q=...&pageSize=...&pageToken=... with JSON {"files": [...], "nextPageToken": ...}.
Options: url, root (id of the root folder), key (API key, optional), pagesize, and params: further parameters of
every request as a query string, such as those that services want for shared drives. Only direct subfolders of the
root are listed, each folder in a partition of its own, so folders are listed in parallel. downloaded() fetches the
content of listed files.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docflow.config import DEFAULTS, Settings
from docflow.schemas import MANIFEST

FOLDER_KIND = "application/vnd.google-apps.folder"
FOLDER_STRIDE = 1 << 32


class ListingError(RuntimeError):
    """The service's answer isn't what a listing is."""


def get_json(url: str, params: dict[str, str], timeout: float = 30) -> dict:
    """A GET whose answer must be JSON, by status and by content type."""
    full = f"{url}?{urllib.parse.urlencode(params)}"
    try:
        with urllib.request.urlopen(full, timeout=timeout) as r:
            kind, body = r.headers.get("Content-Type", ""), r.read()
    except OSError as e:
        raise ListingError(f"{url}: {e}") from e
    if "json" not in kind.lower():
        raise ListingError(f"{url}: an answer of type {kind or 'none'}")
    try:
        return json.loads(body)
    except ValueError as e:
        raise ListingError(f"{url}: an answer that isn't JSON") from e


def get_bytes(url: str, params: dict[str, str] | None = None, timeout: float = 60) -> bytes:
    """The content of an object."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    try:
        with urllib.request.urlopen(full, timeout=timeout) as r:
            return r.read()
    except OSError as e:
        raise ListingError(f"{url}: {e}") from e


def pages(url: str, query: str, names: str, options: dict[str, str]):
    """All entries of a listing, over its pages."""
    params = {"q": query, "pageSize": options.get("pagesize", "1000"), "fields": f"nextPageToken, files({names})"}
    if options.get("key"):
        params["key"] = options["key"]
    params |= dict(urllib.parse.parse_qsl(options.get("params", "")))
    while True:
        answer = get_json(url, params)
        yield from answer.get("files", [])
        if not answer.get("nextPageToken"):
            return
        params["pageToken"] = answer["nextPageToken"]


class Folder(InputPartition):
    def __init__(self, number: int, id_: str, name: str):
        self.number, self.id, self.name = number, id_, name


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        query = f"'{self.options['root']}' in parents and mimeType = '{FOLDER_KIND}' and trashed = false"
        found = [Folder(k, f["id"], f["name"]) for k, f in enumerate(pages(self.options["url"], query, "id, name", self.options))]
        return found or [Folder(0, "", "")]

    def read(self, partition):
        if not partition.id:
            return
        query = f"'{partition.id}' in parents and trashed = false"
        for k, f in enumerate(pages(self.options["url"], query, "id, name, mimeType", self.options)):
            yield partition.id, partition.name, f["id"], f["name"], partition.number * FOLDER_STRIDE + k


class ListingSource(DataSource):
    """spark.read.format("paged_listing"); filter with only_images()."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return MANIFEST

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


def downloaded(files: DataFrame, url: str, params: dict[str, str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds content and error to rows with a file_id: GET <url>/<file_id>?alt=media, by several threads in a task.

    Put this behind everything that drops rows. A file that can't be fetched has null content and the error. A task
    holds the bytes of a few files by thread.
    """
    more = {"alt": "media"} | (params or {})
    schema = files.select("*", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("error")).schema

    def fetch(file_id: str) -> tuple[bytes | None, str | None]:
        try:
            return get_bytes(f"{url}/{urllib.parse.quote(file_id, safe='')}", more), None
        except ListingError as e:
            return None, str(e)

    def run(batches):
        threads = max(1, settings.download_workers)
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                for k in range(0, len(pdf), 4 * threads):
                    some = pdf.iloc[k : k + 4 * threads]
                    found = list(pool.map(fetch, some["file_id"]))
                    yield some.assign(content=[c for c, _ in found], error=[e for _, e in found])

    return files.mapInPandas(run, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)
