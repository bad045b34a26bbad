"""Command line: python -m docflow run | preview | report. Settings come from the environment (see config)."""

from __future__ import annotations

import argparse
import functools
import json
import os
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from docflow.config import Settings
from docflow.operators import models
from docflow.plans import pipeline
from docflow.sources import listing, stores
from docflow.sources.manifest import image_files, manifest, only_images, union_keys, with_content


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="docflow", description="Reads document images into stores that can be taken up.")
    what = parser.add_subparsers(dest="what", required=True)
    for name, text in (("run", "fetch, classify, read printed pages, transcribe handwritten ones"), ("preview", "show the next items to do")):
        one = what.add_parser(name, help=text)
        one.add_argument("--store", required=True, help="folder of the stores")
        one.add_argument("--root", required=True, help="folder of the images, or the listing's root id")
        one.add_argument("--url", help="a paged listing to read images from, in place of a folder")
        one.add_argument("--key", default=os.environ.get("LISTING_API_KEY"), help="the listing's API key (or LISTING_API_KEY)")
    what.choices["preview"].add_argument("-n", type=int, default=5)
    one = what.add_parser("report", help="write one CSV row an image")
    one.add_argument("--store", required=True)
    one.add_argument("--out", required=True)
    return parser.parse_args(given)


def listed(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, str]:
    """The manifest's items, without content, and the column that orders them: a listing's own order, or files by path."""
    if args.url:
        listing.register(spark)
        more = {"key": args.key} if args.key else {}
        return only_images(spark.read.format("paged_listing").options(url=args.url, root=args.root, **more).load()), "scan_pos"
    return image_files(spark, args.root).drop("content"), "file_id"


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, int] | None:
    args, settings = arguments(given), Settings.from_env()
    spark = spark or SparkSession.builder.appName("docflow").getOrCreate()
    if args.what == "report":
        stores.write_report(pipeline.report(spark, args.store), args.out)
        return None
    items, order = listed(spark, args)
    if args.what == "preview":
        done = union_keys(*(pipeline.stored(spark, f"{args.store}/{name}", pipeline.LINE_STORE) for name in ("printed", "handwritten")))
        manifest(items, done, settings, order).orderBy(order).show(args.n, truncate=False)
        return None
    fetch = functools.partial(listing.downloaded, url=args.url, params={"key": args.key} if args.key else None, settings=settings) if args.url else with_content
    host = functools.partial(models.command_host, settings) if settings.manage_host else nullcontext
    counts = pipeline.run(spark, items, args.store, models.http_transcriber(settings), settings=settings, fetch=fetch, host=host, order=order)
    print(json.dumps(counts))
    return counts


if __name__ == "__main__":
    main()
