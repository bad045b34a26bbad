"""Printed or handwritten: ruled lines, whole-page score, then a vote of tiles by their ink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, Settings
from docflow.functions.geometry import segment_angle, segment_length
from docflow.schemas import KEYS


def ruled_lines(segments: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Per page: long horizontal and vertical segments, and whether they make it tabular.

    segments: keys, height, width, x1, y1, x2, y2. Horizontal is within 5 degrees, at least the fraction of the
    width; else vertical, within 5 degrees, at least the fraction of the height.
    """
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    share = settings.structural_min_fraction
    measured = segments.withColumn("__l", segment_length(*ends)).withColumn("__a", segment_angle(*ends))
    long = F.col("__l") >= F.floor(F.least("height", "width") * F.lit(share))
    across = long & ((F.col("__a") <= 5) | (F.col("__a") >= 175)) & (F.col("__l") >= F.col("width") * F.lit(share))
    down = long & ~across & F.col("__a").between(85, 95) & (F.col("__l") >= F.col("height") * F.lit(share))
    counted = measured.groupBy(*keys).agg(F.count_if(across).alias("horizontal"), F.count_if(down).alias("vertical"))
    h, v = F.col("horizontal"), F.col("vertical")
    least = settings.structural_min_lines
    tabular = (h >= least) & (v >= 1) if settings.structural_both_axes else h + v >= least
    return counted.withColumn("tabular", tabular & F.lit(settings.structural_enabled))


def tile_votes(tiles: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Per page: tiles that aren't blank, their ink, the ink of handwritten ones, and the ratio of these.

    tiles: keys, ink, p_printed, p_handwritten.
    """
    inked = F.col("ink") >= settings.min_tile_weight
    hand = inked & (F.col("p_handwritten") >= settings.handwritten_threshold) & (F.col("p_handwritten") - F.col("p_printed") >= settings.handwritten_margin)
    votes = tiles.groupBy(*keys).agg(
        F.count("*").alias("tiles"), F.count_if(inked).alias("non_blank_tiles"),
        F.coalesce(F.sum(F.when(inked, F.col("ink"))), F.lit(0.0)).alias("ink"), F.coalesce(F.sum(F.when(hand, F.col("ink"))), F.lit(0.0)).alias("hand_ink"),
    )
    return votes.withColumn("handwritten_ratio", F.when(F.col("ink") > 0, F.col("hand_ink") / F.col("ink")))


def page_shortcut(p: Column, h: Column, settings: Settings = DEFAULTS) -> Column:
    """The decision that whole-page probabilities allow, or null."""
    printed = (p >= settings.printed_shortcut_threshold) & (p - h >= settings.printed_shortcut_margin)
    hand = F.lit(settings.handwritten_shortcut_enabled) & (h >= settings.handwritten_shortcut_threshold) & (h - p >= settings.handwritten_shortcut_margin)
    return F.when(printed, "whole_page_printed").when(hand, "whole_page_handwritten")


def decided(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds the struct of a decision, from tabular, p_printed, p_handwritten and the votes (null where not needed)."""
    p, h, n = F.col("p_printed"), F.col("p_handwritten"), F.col("non_blank_tiles")
    early = page_shortcut(p, h, settings)
    none, short = F.coalesce("tiles", F.lit(0)) == 0, n < settings.min_non_blank_tiles
    blank = (n == 0) | (F.col("ink") <= 0)
    vote = F.col("handwritten_ratio") >= settings.handwritten_tile_ratio
    name = F.when(F.col("tabular"), "structural_table_override").when(early.isNotNull(), early).when(none, None).when(blank, "all_tiles_blank").when(short, "insufficient_tile_evidence").otherwise("tile_vote")
    voted = ~F.col("tabular") & early.isNull() & ~none & ~blank
    scored = ~F.col("tabular") & ~(early.isNull() & none)
    decision = F.struct(
        F.when(F.col("tabular"), False).when(early.isNotNull(), early == "whole_page_handwritten").when(voted & ~short, vote).otherwise(False).alias("is_handwritten"),
        F.lit(settings.fingerprint()).alias("_cfg"), name.alias("decision"),
        F.when(~F.col("tabular") & early.isNull() & none, "no_tiles").alias("reason"),
        F.when(voted & ~short, F.round("handwritten_ratio", 3)).alias("handwritten_ratio"), F.when(voted, n.cast("int")).alias("non_blank_tiles"),
        F.when(scored, F.round(p, 3)).alias("global_printed_prob"), F.when(scored, F.round(h, 3)).alias("global_handwritten_prob"),
        F.lit(None).cast("string").alias("error"),
    )
    return pages.withColumn("decision", decision)


def failed(message: Column, settings: Settings = DEFAULTS) -> Column:
    """The decision of a page that couldn't be classified: printed, with the error."""
    text = F.lit(None).cast("string")
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(False).alias("is_handwritten"), F.lit(settings.fingerprint()).alias("_cfg"), F.lit("error").alias("decision"), text.alias("reason"), none.alias("handwritten_ratio"),
        F.lit(None).cast("int").alias("non_blank_tiles"), none.alias("global_printed_prob"), none.alias("global_handwritten_prob"), message.alias("error"),
    )


def cascade(pages: DataFrame, tabular, page_scores, tile_scores, settings: Settings = DEFAULTS) -> DataFrame:
    """Decisions by stages, each on the pages that those before left open, as each is dearer than the last.

    tabular, page_scores and tile_scores take and give DataFrames with the keys: of (keys, tabular), (keys,
    p_printed, p_handwritten) and (keys, tile_row, tile_col, ink, p_printed, p_handwritten). tile_scores may add
    error: a row where it isn't null makes its page's decision one of failed().
    """
    lines = pages.join(tabular(pages), KEYS, "left").withColumn("tabular", F.coalesce("tabular", F.lit(False)))
    scores = page_scores(lines.where(~F.col("tabular")).select(*pages.columns))
    scored = lines.join(scores, KEYS, "left")
    open_ = scored.where(~F.col("tabular") & page_shortcut(F.col("p_printed"), F.col("p_handwritten"), settings).isNull())
    tiles = tile_scores(open_.select(*pages.columns))
    if "error" not in tiles.columns:
        return decided(scored.join(tile_votes(tiles, KEYS, settings), KEYS, "left"), settings).select(*pages.columns, "decision")
    votes = tile_votes(tiles.where("error is null"), KEYS, settings)
    errors = tiles.where("error is not null").groupBy(*KEYS).agg(F.min("error").alias("__error"))
    found = decided(scored.join(votes, KEYS, "left"), settings).join(errors, KEYS, "left")
    decision = F.when(F.col("__error").isNotNull(), failed(F.col("__error"), settings)).otherwise(F.col("decision"))
    return found.select(*pages.columns, decision.alias("decision"))


def cache_split(items: DataFrame, cache: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Items whose cached decision is of these settings, with it; and those to classify."""
    current = cache.where(F.col("decision._cfg") == settings.fingerprint()).select(*KEYS, "decision")
    both = items.join(current, KEYS, "left")
    return both.where("decision is not null"), both.where("decision is null").drop("decision")


def routed(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Printed and handwritten items; every item is in one of them."""
    hand = F.coalesce(F.col("decision.is_handwritten"), F.lit(False))
    return items.where(~hand), items.where(hand)
