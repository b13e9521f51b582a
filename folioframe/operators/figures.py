"""Figure regions (doc_id, page, f_x0, f_y0, f_x1, f_y1, diagram) against the glyphs inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "page"]
#: Vector paths and scale of a form that is a diagram; ordinary glyphs that make a region prose.
PATHS, SCALE, PROSE = 12, 0.90, 25


def is_label() -> Column:
    """A glyph of a figure's lettering: tiny, or in a box over twice its size."""
    return (F.col("size") < 4) | (F.col("top") - F.col("bottom") > 2 * F.col("size"))


def is_diagram(paths: Column, a: Column, d: Column) -> Column:
    return (paths >= PATHS) & ((F.abs(a) + F.abs(d)) / 2 <= SCALE)


def _inside(dx: Column, dy: Column, strict: bool = False) -> Column:
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("bottom") + F.col("top")) / 2
    lo_x, hi_x, lo_y, hi_y = F.col("f_x0") + dx, F.col("f_x1") - dx, F.col("f_y0") + dy, F.col("f_y1") - dy
    return (x > lo_x) & (x < hi_x) & (y > lo_y) & (y < hi_y) if strict else (x >= lo_x) & (x <= hi_x) & (y >= lo_y) & (y <= hi_y)


def close(gap: float) -> Column:
    """Boxes a_* and b_* that overlap or lie within the gap of each other both ways."""
    c = F.col
    return (c("a_x0") - gap <= c("b_x1")) & (c("b_x0") - gap <= c("a_x1")) & (c("a_y0") - gap <= c("b_y1")) & (c("b_y0") - gap <= c("a_y1"))


def prose_regions(regions: DataFrame, glyphs: DataFrame) -> DataFrame:
    """regions with prose (ordinary glyphs within an inner frame) and holds_prose."""
    inset = [F.least(0.15 * (F.col(f"f_{c}1") - F.col(f"f_{c}0")), F.lit(40.0)) for c in "xy"]
    own = [*KEYS, "f_x0", "f_y0", "f_x1", "f_y1"]
    real = glyphs.where(~F.col("space") & ~is_label()).select(*KEYS, "left", "right", "bottom", "top")
    n = regions.select(*own).distinct().join(real, KEYS).where(_inside(*inset, True)).groupBy(*own).agg(F.count("*").alias("prose"))
    return regions.join(n, own, "left").fillna(0, ["prose"]).withColumn("holds_prose", F.col("prose") > PROSE)


def suppress_labels(glyphs: DataFrame, regions: DataFrame) -> DataFrame:
    """Glyphs less those inside a diagram, and less the lettering inside any other figure: a range anti-join by page."""
    r = regions.select(F.col("doc_id").alias("f_doc"), F.col("page").alias("f_page"), "f_x0", "f_y0", "f_x1", "f_y1", "diagram")
    on = (F.col("doc_id") == F.col("f_doc")) & (F.col("page") == F.col("f_page")) & _inside(F.lit(0.0), F.lit(0.0)) & (F.col("diagram") | is_label())
    return glyphs.join(r, on, "left_anti")


def render_boxes(regions: DataFrame, glyphs: DataFrame) -> DataFrame:
    """regions with r_y0 and r_y1: the edges less captions that graze them, those ordinary glyphs within a quarter of the
    height (80 points at most) of an edge, and 2 points; the region's own where under 4 points would be left."""
    c, own = F.col, [*KEYS, "f_x0", "f_y0", "f_x1", "f_y1"]
    real = glyphs.where(~c("space") & ~is_label()).select(*KEYS, "left", "right", "bottom", "top")
    x, y, band = (c("left") + c("right")) / 2, (c("bottom") + c("top")) / 2, F.least(0.25 * (c("f_y1") - c("f_y0")), F.lit(80.0))
    upper, lower = y > c("f_y1") - band, (y <= c("f_y1") - band) & (y < c("f_y0") + band)
    held = regions.select(*own).distinct().join(real, KEYS).where((x >= c("f_x0")) & (x <= c("f_x1")) & (y > c("f_y0")) & (y < c("f_y1")))
    cut = held.groupBy(*own).agg(F.min(F.when(upper, c("bottom") - 2)).alias("cut_top"), F.max(F.when(lower, c("top") + 2)).alias("cut_bottom"))
    rows = regions.join(cut, own, "left").withColumn("r_y1", F.least("f_y1", "cut_top")).withColumn("r_y0", F.greatest("f_y0", "cut_bottom"))
    kept = c("r_y1") > c("r_y0") + 4
    return rows.select(*regions.columns, F.when(kept, c("r_y0")).otherwise(c("f_y0")).alias("r_y0"), F.when(kept, c("r_y1")).otherwise(c("f_y1")).alias("r_y1"))


def page_backgrounds(images: DataFrame, glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """images (doc_id, page, img_no, x0, y0, x1, y1) that are scans of their page: 60 % of it either way, 55 % of its area,
    with 25 glyphs of a recognised text layer on them."""
    c, keys = F.col, [*KEYS, "img_no"]
    w, h = F.least("x1", "width") - F.greatest("x0", F.lit(0.0)), F.least("y1", "height") - F.greatest("y0", F.lit(0.0))
    large = images.join(pages.select(*KEYS, "width", "height"), KEYS).where((w >= 0.60 * c("width")) & (h >= 0.60 * c("height")) & (w * h >= 0.55 * c("width") * c("height")))
    ink = glyphs.where("ocr and not space").select(*KEYS, ((c("left") + c("right")) / 2).alias("cx"), ((c("bottom") + c("top")) / 2).alias("cy"))
    on = large.join(ink, KEYS).where(c("cx").between(c("x0"), c("x1")) & c("cy").between(c("y0"), c("y1")))
    return on.groupBy(*keys).agg(F.count("*").alias("glyphs")).where("glyphs >= 25")


def text_free_bands(spans: DataFrame, keys: list[str], least: float = 40.0) -> DataFrame:
    """keys, lo, hi: vertical stretches of `least` points or more between spans (lo, hi) of text."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("reach", F.max("hi").over(w))
    return rows.where(F.col("lo") - F.col("reach") >= least).select(*keys, F.col("reach").alias("lo"), F.col("lo").alias("hi"))
