"""Running headers, footers and stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PAGE_NUMBERS, block_signature, segment_signature

#: Pages on which a text at one place counts as repeated.
POSITION_PAGES = 4


def bands(glyphs: DataFrame, height: float = 792.0) -> DataFrame:
    """Per line: 1 in the top band, 2 in the bottom band, else 0, with its place to four points."""
    keys = ["doc_id", "page", "line"]
    one = glyphs.groupBy(*keys).agg(F.min("bottom").alias("low"), F.max("top").alias("high"), F.min("left").alias("x0"), F.max("y").alias("y"))
    band = F.when(F.col("low") > 0.88 * height, 1).when(F.col("high") < 0.12 * height, 2).otherwise(0)
    return one.select(*keys, band.alias("band"), F.round(F.col("x0") / 4).cast("long").alias("qx"), F.round(F.col("y") / 4).cast("long").alias("qy"))


def _band(low: Column, high: Column, height: Column) -> Column:
    return F.when(height <= 0, 0).when(low > 0.88 * height, 1).when(high < 0.12 * height, 2).otherwise(0)


def _clear(found: DataFrame, lines: DataFrame, distance: Column) -> DataFrame:
    """Those segments over or under which no other line of the page lies within the distance of their baseline."""
    other = lines.select("doc_id", "page", F.col("line").alias("_line"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y").alias("_y"))
    near = (F.col("_line") != F.col("line")) & (F.col("_x0") <= F.col("x1")) & (F.col("x0") <= F.col("_x1")) & (F.abs(F.col("_y") - F.col("y")) <= distance)
    hit = found.withColumn("_distance", distance).join(other, ["doc_id", "page"]).where(near).select("doc_id", "page", "line", "seg").distinct()
    return found.join(hit, ["doc_id", "page", "line", "seg"], "left_anti")


def strip_running(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """The segments that are no running chrome, of documents of three pages or more; others' stay.

    segments: doc_id, page, line, seg, t, x0, x1, y (the line's baseline), low, high (its box), size; pages: doc_id, page,
    width, height. A stamp is a text of 2 to 24 bytes in an outer margin, outside the bands, at one place of a quarter
    of the pages; where it stands clear, its segment goes. A line of the top or bottom band goes if all its segments
    repeat: their digit-folded text in that band of half the pages, or at one place of four and standing clear.
    """
    keys, place = ["doc_id", "page", "line", "seg"], [F.round(F.col("x0") / 4).cast("long").alias("qx"), F.round(F.col("y") / 4).cast("long").alias("qy")]
    count = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n")).where("n >= 3")
    rows = segments.join(pages.select("doc_id", "page", "width", "height").distinct(), ["doc_id", "page"]).join(count, "doc_id")
    line = Window.partitionBy("doc_id", "page", "line")
    rows = rows.withColumn("band", _band(F.min("low").over(line), F.max("high").over(line), F.col("height"))).select("*", *place, segment_signature(F.col("t")).alias("sig"), segment_signature(F.col("t"), False).alias("stamp"))
    box = lambda r: r.groupBy("doc_id", "page", "line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y"))

    margin = rows.where("band = 0 and width > 0 and (x1 < 0.15 * width or x0 > 0.85 * width) and octet_length(stamp) between 2 and 24")
    stamps = margin.groupBy("doc_id", "stamp", "qx", "qy", "n").agg(F.countDistinct("page").alias("k")).where("k >= greatest(3, ceil(n / 4))").select("doc_id", "stamp").distinct()
    gone = _clear(margin.join(stamps, ["doc_id", "stamp"], "left_semi").select(*keys, "x0", "x1", "y"), box(rows), F.lit(24.0)).select(*keys)
    rest = rows.join(gone, keys, "left_anti")

    signed = rest.where("band <> 0 and sig <> ''")
    texts = signed.groupBy("doc_id", "band", "sig", "n").agg(F.countDistinct("page").alias("k")).where("k >= greatest(3, ceil(n / 2))").select("doc_id", "band", "sig")
    places = signed.groupBy("doc_id", "band", "qx", "qy", "sig").agg(F.countDistinct("page").alias("k")).where(F.col("k") >= POSITION_PAGES).select("doc_id", "band", "qx", "qy", "sig")
    known = signed.join(texts, ["doc_id", "band", "sig"], "left_semi").select(*keys)
    placed = signed.join(texts, ["doc_id", "band", "sig"], "left_anti").join(places, ["doc_id", "band", "qx", "qy", "sig"], "left_semi")
    placed = _clear(placed.select(*keys, "x0", "x1", "y", "size"), box(rest), F.greatest(1.8 * F.col("size"), F.lit(14.0))).select(*keys)
    marks = signed.select(*keys).join(known.union(placed).withColumn("chrome", F.lit(1)), keys, "left")
    lines = marks.groupBy("doc_id", "page", "line").agg(F.count("*").alias("all"), F.count("chrome").alias("known")).where("all = known").select("doc_id", "page", "line")
    return segments.join(gone, keys, "left_anti").join(lines, ["doc_id", "page", "line"], "left_anti")


def strip_headers_footers(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The blocks but for page numbers and repeated texts of the top and bottom bands, in documents of two pages or more.

    blocks: doc_id, ord, page, kind, lines (their texts), low, high; pages: doc_id, page, height. A text repeats in its
    band on three pages and half of the document's; images stay.
    """
    count = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n")).where("n >= 2")
    rows = blocks.where("kind <> 'image'").join(pages.select("doc_id", "page", "height").distinct(), ["doc_id", "page"]).join(count, "doc_id")
    rows = rows.select("doc_id", "ord", "page", "n", _band(F.col("low"), F.col("high"), F.col("height")).alias("band"), block_signature(F.col("lines")).alias("sig")).where("band <> 0")
    again = rows.groupBy("doc_id", "band", "sig", "n").agg(F.countDistinct("page").alias("k")).where("k >= greatest(3, ceil(n / 2))").select("doc_id", "band", "sig")
    numbers = rows.where(F.col("sig").isin(*PAGE_NUMBERS)).select("doc_id", "ord")
    return blocks.join(rows.join(again, ["doc_id", "band", "sig"], "left_semi").select("doc_id", "ord").union(numbers), ["doc_id", "ord"], "left_anti")


def in_margin(x0: Column, x1: Column, width: Column) -> Column:
    """Wholly in the outer 15 % of the page's width."""
    return (width > 0) & ((x1 < 0.15 * width) | (x0 > 0.85 * width))


def segments_of(segments: Column, first: Column, last: Column) -> Column:
    """A line's segments, or the whole line where it has none."""
    return F.when(F.size(F.coalesce(segments, F.array().cast("array<long>"))) > 0, segments).otherwise(F.array(first, last))
