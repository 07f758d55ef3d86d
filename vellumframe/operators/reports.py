"""Reports over files, pages, images and comments: shifted dates, placements, page sizes, trays and comment lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded
from .ordering import compact_ranges
from .running import along


def date_shift(taken: Column, created: Column, modified: Column, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0, override: dt.datetime | None = None) -> Column:
    """The date of a file, moved: when it was taken, else created, else modified. `override` takes the place of all."""
    if override is not None:
        return F.lit(override).cast("timestamp_ntz")
    total = days * 86_400 + hours * 3_600 + minutes * 60 + seconds
    return (F.coalesce(taken, created, modified) + F.expr(f"make_dt_interval(0, 0, 0, {total})")).cast("timestamp_ntz")


def placement_peaks(placements: DataFrame, image: str, page: str, dpi: str) -> DataFrame:
    """(image, page, dpi) a placement -> image, peak (0 without a positive one), n_pages, first_page and last_page."""
    pages = placements.groupBy(image, page).agg(F.max(dpi).alias("_d"))
    return pages.groupBy(image).agg(F.greatest(F.coalesce(F.max("_d"), F.lit(0)), F.lit(0)).alias("peak"), F.count(page).alias("n_pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))


def image_bytes_by_page(placements: DataFrame, images: DataFrame, image: str, page: str, size: str) -> DataFrame:
    """page, bytes, n_images: what each page's images weigh, an image counted once a page however often it is placed;
    images that are not listed weigh nothing and do not count."""
    once = placements.select(page, image).distinct().join(images.select(image, size), image)
    return once.groupBy(page).agg(F.sum(size).cast("long").alias("bytes"), F.count("*").alias("n_images"))


def with_page_size(pages: DataFrame, width: str, height: str, rotation: Column) -> DataFrame:
    """Adds width_pt and height_pt, whole points after rotation by quarter turns, and orientation: square where they
    differ by less than a point."""
    turned = F.pmod(F.round(F.coalesce(rotation, F.lit(0)) / 90), F.lit(2)) == 1
    w, h = (rounded(F.when(turned, F.col(a)).otherwise(F.col(b))).cast("long") for a, b in ((height, width), (width, height)))
    kind = F.when(F.abs(F.col("width_pt") - F.col("height_pt")) < 1, "square").when(F.col("width_pt") > F.col("height_pt"), "landscape").otherwise("portrait")
    return pages.withColumns({"width_pt": w, "height_pt": h}).withColumn("orientation", kind)


def group_by_size(sized: DataFrame, index: str) -> DataFrame:
    """with_page_size's rows -> a row a size: width_pt, height_pt, their millimetres to a tenth, orientation, n, first
    (index) and rank: most pages first, ties by the first page. with_page_size's own rows are the members."""
    g = sized.groupBy("width_pt", "height_pt", "orientation").agg(F.count("*").alias("n"), F.min(index).alias("first"))
    mm = lambda c: rounded(F.col(c) / (72 / 25.4), 1)
    out = along(g, [], [F.desc("n"), F.asc("first")], before={"rank": F.lit(1).cast("long")})
    return out.withColumn("rank", F.col("rank") + 1).withColumn("width_mm", mm("width_pt")).withColumn("height_mm", mm("height_pt"))


def source_tray(sources: DataFrame, pages: DataFrame, source: str, number: str, original: str) -> DataFrame:
    """Every source with its original and remaining pages: source, original, remaining, emptied, numbers (those left, runs
    as a-b)."""
    left = pages.groupBy(source).agg(F.count("*").alias("remaining"))
    runs = compact_ranges(pages.select(source, F.col(number).alias("pos")), source).withColumnRenamed("ranges", "numbers")
    out = sources.select(source, F.col(original).alias("original")).join(left, source, "left").join(runs, source, "left")
    return out.select(source, "original", F.coalesce("remaining", F.lit(0)).cast("long").alias("remaining"), F.col("remaining").isNull().alias("emptied"), F.coalesce("numbers", F.lit("")).alias("numbers"))


def split_by_source(tray: DataFrame, source: str, order: str) -> DataFrame:
    """source_tray's rows with an order -> the parts of a split: source, part (from 1, in order), pages, numbers, before
    (pages of all parts before) and total (of all). Sources without pages give no part."""
    kept = tray.filter("not emptied")
    one = F.lit(1).cast("long")
    out = along(kept, [], [order], before={"part": one, "before": F.col("remaining")}, total={"total": F.col("remaining")})
    return out.select(source, (F.col("part") + 1).alias("part"), F.col("remaining").alias("pages"), "numbers", "before", "total")


def comment_summary(threads: DataFrame, replies: DataFrame, thread: str, page: str, y: str, resolved: str) -> DataFrame:
    """Threads in order of page and place down the page: adds position (from 1), status (Resolved or Open) and replies."""
    n = replies.groupBy(thread).agg(F.count("*").alias("replies"))
    joined = threads.join(n, thread, "left").withColumn("replies", F.coalesce("replies", F.lit(0)).cast("long"))
    joined = joined.withColumn("status", F.when(F.coalesce(F.col(resolved), F.lit(False)), "Resolved").otherwise("Open"))
    return along(joined, [], [page, y, thread], before={"position": F.lit(1).cast("long")}).withColumn("position", F.col("position") + 1)
