"""Statistics of a page's lines, list levels and the places of ruled tables. A page is bounded by its paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def column_left(lines: DataFrame) -> DataFrame:
    """doc_id, page, left: the least x0 of lines of 15 glyphs or more, else of all lines, else 0."""
    return lines.groupBy(*PAGE).agg(F.coalesce(F.min(F.when(F.col("glyphs") >= 15, F.col("x0"))), F.min("x0"), F.lit(0.0)).alias("left"))


def region_stats(lines: DataFrame) -> DataFrame:
    """doc_id, page, x0, x1, size (median), step: the median distance of neighbouring baselines, of those over 0.1
    points and under 3 em; 1.2 em where there is none."""
    em = Window.partitionBy(*PAGE)
    rows = lines.select(*PAGE, "x0", "x1", "size", F.abs(F.col("baseline") - F.lag("baseline").over(em.orderBy(F.desc("baseline")))).alias("step"), F.median("size").over(em).alias("em"))
    usual = F.when((F.col("step") > 0.1) & (F.col("step") < 3 * F.col("em")), F.col("step"))
    one = rows.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("em").alias("size"), F.median(usual).alias("step"))
    return one.withColumn("step", F.coalesce("step", 1.2 * F.col("size")))


def robust_size(glyphs: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes (doc_id, page, line, size) with robust: the size, unless it is under half the median box height; then the
    tallest box. At least 1."""
    keys = [*PAGE, "line"]
    height = F.when(~F.col("space") & (F.col("top") > F.col("bottom")), F.col("top") - F.col("bottom"))
    boxes = glyphs.groupBy(*keys).agg(F.coalesce(F.median(height), F.lit(0.0)).alias("middle"), F.coalesce(F.max(height), F.lit(0.0)).alias("tallest"))
    size = F.when(F.col("size") >= 0.5 * F.col("middle"), F.col("size")).otherwise(F.col("tallest"))
    return sizes.join(boxes, keys).withColumn("robust", F.greatest(size, F.lit(1.0))).drop("middle", "tallest")


def list_levels(items: DataFrame, em: float) -> DataFrame:
    """items with level (from 0): a level begins where a marker lies over 0.9 em right of the last level's begin."""
    at = F.array_sort(F.collect_set("x0").over(Window.partitionBy(*PAGE)))
    begins = F.aggregate(at, F.expr("cast(array() as array<double>)"), lambda a, x: F.when((F.size(a) == 0) | (x > F.element_at(a, -1) + 0.9 * em), F.concat(a, F.array(x))).otherwise(a))
    near = F.filter(F.col("_begins"), lambda b: F.abs(F.col("x0") - b) <= 0.9 * em + 1e-6)
    rows = items.withColumn("_begins", begins)
    return rows.withColumn("level", F.greatest(F.array_position("_begins", F.element_at(near, 1)) - 1, F.lit(0))).drop("_begins")


def splice(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, table_no, ord: the first block of the page whose top is below the table's; null is the page's end."""
    b = blocks.select(*PAGE, "ord", F.col("y_top").alias("b_top"))
    return tables.join(b, PAGE, "left").groupBy(*PAGE, "table_no").agg(F.min(F.when(F.col("b_top") < F.col("y_top"), F.col("ord"))).alias("ord"))


def isolated(lines: DataFrame, distance: float = 24.0) -> DataFrame:
    """Lines that no other of the page overlaps from side to side with a baseline within `distance`: a range anti-join."""
    o = lines.select(*[F.col(c).alias(f"o_{c}") for c in (*PAGE, "line", "x0", "x1", "baseline")])
    same = (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page") == F.col("o_page")) & (F.col("line") != F.col("o_line"))
    return lines.join(o, same & (F.col("o_x0") <= F.col("x1")) & (F.col("x0") <= F.col("o_x1")) & (F.abs(F.col("baseline") - F.col("o_baseline")) <= distance), "left_anti")


def text_lines(glyphs: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, text_lines: baselines of a cell's glyphs that lie over 0.6 of the size above the one below."""
    step = F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("y"))
    return glyphs.where("not space").select(*keys, step.alias("step")).groupBy(*keys).agg(F.count_if(F.col("step").isNull() | (F.col("step") > 0.6 * max(size, 1.0))).alias("text_lines"))
