"""The entry points: make the manifest, classify, read printed pages, transcribe handwritten ones, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, ExitStack, nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Settings
from docflow.functions.text import lines
from docflow.operators import classify, images, layout, models
from docflow.operators import lines as lines_of
from docflow.schemas import DECISION, KEYS
from docflow.sources import stores
from docflow.sources.buckets import Buckets
from docflow.sources.manifest import manifest, union_keys, without
from docflow.sources.work import forget, written

LINE_STORE = "folder_name string, file_name string, lines array<string>"
DECISION_STORE = f"folder_name string, file_name string, decision {DECISION}"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a run's table; one that isn't there is empty."""
    return Buckets(spark, path).rows(schema)


def classified(items: DataFrame, cache: DataFrame, scorer: Callable = models.stand_in_scorer, settings: Settings = DEFAULTS) -> DataFrame:
    """Items (keys, content) with their decision, and whether it was cached. Pages of equal bytes are decided once, under the
    least of their keys."""
    hits, misses = classify.cache_split(items, cache, settings)
    digest = F.coalesce(F.sha2("content", 256), F.lit("")).alias("__digest")
    named = misses.select(*KEYS, "content", digest).groupBy("__digest").agg(F.min(F.struct(*KEYS)).alias("k"), F.any_value("content").alias("content"))
    distinct = written(named.select("k.*", "content", "__digest"))
    open_ = images.with_png(distinct.select(*KEYS, "content"), cap=settings.classifier_max_side).drop("content")

    def tabular(pages: DataFrame) -> DataFrame:
        """Whether pages have ruled lines. Edges are looked up twice, by votes and by lines, so they are kept meanwhile."""
        edges = written(lines_of.edges_of(pages, KEYS, "png", settings.classifier_max_side))
        found = written(classify.ruled_lines(lines_of.ruled(edges, KEYS, settings), KEYS, settings).select(*KEYS, "tabular"))
        forget(edges)
        return found

    page = lambda p: written(models.scored(p, KEYS, scorer, "png").select(*KEYS, "p_printed", "p_handwritten"))

    def tiles(pages: DataFrame) -> DataFrame:
        """Scored tiles, and a row with the error of each page that can't be read."""
        found = written(images.tiles_of(pages, KEYS, "png"))
        good = models.scored(found.where("error is null").select(*KEYS, "ink", "data"), KEYS, scorer)
        return good.unionByName(found.where("error is not null").select(*KEYS, "error"), allowMissingColumns=True)

    found = classify.cascade(open_, tabular, page, tiles, settings).select(*KEYS, "decision")
    decided = distinct.select(*KEYS, "__digest").join(found, KEYS).select("__digest", "decision")
    fresh = misses.select("*", digest).join(decided, "__digest").select(*misses.columns, "decision")
    return hits.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))


def printed_lines(readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(keys, lines) of the readings without an error."""
    found = layout.page_lines(models.boxes_of(readings, KEYS), settings).select("page.*", "lines")
    read = readings.where("error is null").select(*KEYS)
    return read.join(found, KEYS, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def handwritten_lines(rows: DataFrame) -> DataFrame:
    """(keys, lines) of the transcriptions that came."""
    return rows.where("status = 'ok'").select(*KEYS, lines(F.col("text")).alias("lines"))


def read_printed(items: DataFrame, done: DataFrame, loaders: dict[str, Callable] | None = None, settings: Settings = DEFAULTS) -> tuple[DataFrame, int]:
    """(keys, lines) of printed items not done yet, and how many failed, which the next run tries again. Recognisers get
    PNG bytes, no side beyond the cap."""
    loaders = loaders or {"first": models.stand_in_recogniser, "second": models.stand_in_recogniser}
    pages = images.with_png(without(items, done).select(*KEYS, "content"), cap=settings.printed_max_side)
    pages = images.capped(pages.drop("content"), settings.printed_max_side)
    seen = Observation()
    readings = written(models.recognised(pages, KEYS, loaders, data="png", batch=settings.recogniser_batch), seen, n=F.count_if(F.col("error").isNotNull()))
    return printed_lines(readings, settings), seen.get["n"]


def read_handwritten(items: DataFrame, done: DataFrame, transcriber: Callable, settings: Settings = DEFAULTS, **more) -> tuple[DataFrame, int]:
    """(keys, lines) of handwritten items not done yet, and how many failed. The calls are made here, once."""
    pages = images.with_png(without(items, done).select(*KEYS, "content"), cap=settings.handwritten_max_side)
    seen = Observation()
    rows = written(models.transcribed(pages, transcriber, settings, png="png", **more), seen, n=F.count_if(F.col("status") != "ok"))
    return handwritten_lines(rows), seen.get["n"]


def parts(items: DataFrame, n: int, every: int) -> Iterator[DataFrame]:
    """The items in parts of about `every` for each core, by the hash of their keys. What a part gives is committed before
    the next one begins."""
    many = max(1, -(-n // (max(1, every) * items.sparkSession.sparkContext.defaultParallelism)))
    number = F.pmod(F.xxhash64(*KEYS, F.lit(many)), F.lit(many))
    return (items.where(number == k) for k in range(many))


def run(
    spark: SparkSession, items: DataFrame, folder: str, transcriber: Callable, scorer: Callable = models.stand_in_scorer, loaders: dict[str, Callable] | None = None, settings: Settings = DEFAULTS,
    fetch: Callable[[DataFrame], DataFrame] | None = None, host: Callable[[], AbstractContextManager] = nullcontext, order: str = "scan_pos", **more
) -> dict[str, int]:
    """The whole run over items (manifest columns, and content if fetch doesn't add it); its tables are kept below the
    folder, see sources.buckets.

    The items to do go through the stages in parts, and each part of each stage is committed when it is done: a run that
    breaks off has paid for one part of one stage in vain at most, and the next run goes on behind it. fetch adds content
    and error to a part's items. host is up from the first handwritten part on.

    The result counts the tables' rows (images, printed, handwritten), and of this run the items to do (todo), those
    with a cached decision (from_cache), decisions that are errors (undecided) and items not fetched or read (failed).
    All counts are gathered by the jobs that write.
    """
    decisions, printed, handwritten = (Buckets(spark, f"{folder}/{name}") for name in ("decisions", "printed", "handwritten"))
    counts = dict.fromkeys(("todo", "from_cache", "undecided", "failed"), 0)
    done = union_keys(printed.rows(LINE_STORE), handwritten.rows(LINE_STORE))
    seen = Observation()
    new = written(manifest(items.drop("content"), done, settings, order), seen, n=F.count("*"))
    counts["todo"] = seen.get["n"]
    given = [c for c in new.columns if c in (*KEYS, order, "file_id")]

    with ExitStack() as up:
        started = False
        for part in parts(new, counts["todo"], settings.decisions_save_every):
            seen = Observation()
            error = F.col("error").isNotNull() if fetch else F.lit(False)
            got = fetch(part) if fetch else items.join(part.select(*given), given, "left_semi")
            got = written(got, seen, bad=F.count_if(error), n=F.count("*"))
            counts["failed"] += seen.get["bad"]
            seen = Observation()
            found = classified(got.where(~error), decisions.rows(DECISION_STORE), scorer, settings).select(*KEYS, "decision", "cached")
            hands = F.count_if(F.coalesce(F.col("decision.is_handwritten"), F.lit(False)))
            found = written(found, seen, cached=F.count_if("cached"), undecided=F.count_if(F.col("decision.error").isNotNull()), hands=hands, n=F.count("*"))
            fresh, n = seen.get, seen.get["n"]
            counts["from_cache"] += fresh["cached"]
            counts["undecided"] += fresh["undecided"]
            if n > fresh["cached"]:
                decisions.put(found.where("not cached").select(*KEYS, "decision"))
                decisions.vacuum()
            print_, hand = classify.routed(got.where(~error).join(found.select(*KEYS, "decision"), KEYS))
            if n > fresh["hands"]:
                for some in parts(print_, n - fresh["hands"], settings.printed_save_every):
                    lines_, lost = read_printed(some, printed.rows(LINE_STORE), loaders, settings)
                    printed.put(lines_, new=True)
                    counts["failed"] += lost
            if fresh["hands"] and not started:
                up.enter_context(host())
                started = True
            for some in parts(hand, fresh["hands"], settings.handwritten_save_every) if fresh["hands"] else ():
                lines_, lost = read_handwritten(some, handwritten.rows(LINE_STORE), transcriber, settings, **more)
                handwritten.put(lines_, new=True)
                counts["failed"] += lost
            forget(got, found)
        printed.vacuum()
        handwritten.vacuum()
    a, b = printed.count(), handwritten.count()
    return {"images": a + b, "printed": a, "handwritten": b} | counts


def report(spark: SparkSession, folder: str) -> DataFrame:
    """One row an image of a run's stores: see stores.report."""
    return stores.report(*(stored(spark, f"{folder}/{name}", LINE_STORE) for name in ("printed", "handwritten")))
