"""Letterheads: where the band at the top of a first page ends, its lines, and texts without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def band(words: DataFrame, pages: DataFrame, rects: DataFrame) -> DataFrame:
    """doc, cut, by: where the letterhead ends, in points from the top; 0 and null where there is none.

    words: doc, top. pages: doc, width, height. rects: doc, place, x0, x1, top, bottom, filled. A filled banner at the top
    decides; else the widest gap between lines of the page's top, if it is clearly wider than the one in the middle.
    """
    limit = F.col("height") * fixed.BAND_FRACTION
    wide = F.col("filled") & (F.col("top") <= fixed.BANNER_TOP) & (F.col("x1") - F.col("x0") >= F.col("width") * fixed.BANNER_WIDTH) & (F.col("bottom") > fixed.BANNER_LEAST) & (F.col("bottom") <= limit)
    banners = rects.join(pages, "doc").filter(wide).groupBy("doc").agg(F.min_by("bottom", "place").alias("banner"))
    tops = words.join(pages, "doc").select("doc", F.round("top", 1).alias("t"), limit.alias("limit")).filter("t <= limit").select("doc", "t").distinct()
    by_top, by_gap = Window.partitionBy("doc").orderBy("t"), Window.partitionBy("doc").orderBy("gap", "before")
    gaps = tops.withColumn("before", F.lag("t").over(by_top)).filter("before is not null").withColumn("gap", F.col("t") - F.col("before"))
    gaps = gaps.withColumns({"r": F.row_number().over(by_gap), "n": F.count(F.lit(1)).over(Window.partitionBy("doc"))})
    widest = gaps.groupBy("doc").agg(F.max_by("gap", "r").alias("gap"), F.max_by("before", "r").alias("before"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("gap"))).alias("typical"))
    clear = (F.col("typical") > 0) & (F.col("gap") >= F.col("typical") * fixed.BAND_GAP)
    out = pages.select("doc").join(banners, "doc", "left").join(widest, "doc", "left")
    cut = F.coalesce("banner", F.when(clear, F.col("before") + F.col("gap") / 2), F.lit(0.0))
    return out.select("doc", cut.alias("cut"), F.when(F.col("banner").isNotNull(), "banner").when(clear, "gap").alias("by"))


def head_lines(words: DataFrame, bands: DataFrame, most: int = fixed.BAND_LINES) -> DataFrame:
    """doc, strip: the lines above the cut, words by their place in the line. words: doc, top, bottom, x0, text."""
    inside = words.join(bands.select("doc", "cut").filter("cut > 0"), "doc").filter("bottom <= cut")
    lines = inside.groupBy("doc", F.round("top", 1).alias("t")).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")).alias("line"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("t", "line"))), 1, most)
    return lines.groupBy("doc").agg(F.filter(F.transform(first, lambda x: x["line"]), lambda x: x != "").alias("strip"))


def stripped(text: Column, strip: Column) -> Column:
    """The text without the lines of strip, taken from its front while they match in order; blank lines between them go."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    start = F.struct(F.lit(0).alias("gone"), F.lit(0).alias("met"), F.lit(True).alias("on"))

    def step(s: Column, line: Column) -> Column:
        on = s["on"] & (s["met"] < F.size(strip))
        same = plain(line) == plain(F.get(strip, s["met"]))
        blank = plain(line) == ""
        goes = on & (blank | same)
        return F.struct((s["gone"] + goes.cast("int")).alias("gone"), (s["met"] + (on & ~blank & same).cast("int")).alias("met"), (s["on"] & (~on | goes)).alias("on"))

    lines = F.split(text, "\n", -1)
    gone = F.aggregate(lines, start, step, lambda s: s["gone"])
    rest = F.regexp_replace(F.array_join(F.slice(lines, gone + 1, F.greatest(F.size(lines), F.lit(1))), "\n"), r"^\n+", "")
    return F.when(F.coalesce(F.size(strip), F.lit(0)) > 0, rest).otherwise(text)
