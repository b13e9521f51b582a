"""Ruling lines and the cells between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def grid_lines(rules: DataFrame, keys: list[str], chain: float = 2.5, touch: float = 3.5) -> DataFrame:
    """keys, cluster, at, lo, hi: rules (pos, lo, hi) chained by position, and their spans joined where they touch."""
    w = Window.partitionBy(*keys).orderBy("pos", "lo")
    new = F.coalesce(F.col("pos") - F.lag("pos").over(w) > chain, F.lit(True))
    rows = rules.withColumn("cluster", F.sum(new.cast("int")).over(w))
    within = Window.partitionBy(*keys, "cluster").orderBy("lo", "hi")
    reach = F.max("hi").over(within.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("lo") > reach + touch, F.lit(True))
    rows = rows.withColumn("piece", F.sum(F.col("apart").cast("int")).over(within)) if "apart" in rows.columns else rows.withColumn("apart", apart).withColumn("piece", F.sum(F.col("apart").cast("int")).over(within))
    at = rows.groupBy(*keys, "cluster").agg(F.avg("pos").alias("at"))
    spans = rows.groupBy(*keys, "cluster", "piece").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.join(at, [*keys, "cluster"]).select(*keys, F.col("cluster").cast("long").alias("cluster"), "at", "lo", "hi")


def glyph_cells(glyphs: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each glyph's first cell (row, col) that holds its centre: a range join inside a page."""
    inside = ((F.col("left") + F.col("right")) / 2 >= F.col("c_x0")) & ((F.col("left") + F.col("right")) / 2 < F.col("c_x1")) & ((F.col("bottom") + F.col("top")) / 2 >= F.col("c_y0")) & ((F.col("bottom") + F.col("top")) / 2 < F.col("c_y1"))
    j = glyphs.join(cells, keys).where(inside)
    return j.groupBy(*keys, "line", "seq").agg(F.min(F.struct("row", "col")).alias("cell")).select(*keys, "line", "seq", "cell.row", "cell.col")


def withhold(glyphs: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Glyphs that no table has taken."""
    return glyphs.join(used.select(*keys).distinct(), keys, "left_anti")


def lattices(across: DataFrame, down: DataFrame, keys: list[str], tol: float = 2.5) -> DataFrame:
    """keys, horizontal, rule_no, lattice: rules (at, lo, hi, rule_no) that cross, within `tol`, directly or through
    others, form a lattice, numbered by its least horizontal rule; rules that cross none are in none (null).

    Labels spread inside a page's own rules, which its paper bounds.
    """

    fields = [f for f in across.schema.fields if f.name in keys]
    schema = StructType([*fields, StructField("horizontal", BooleanType()), StructField("rule_no", LongType()), StructField("lattice", LongType())])
    cols = [*keys, F.col("rule_no").cast("long").alias("rule_no"), *[F.col(c).cast("double").alias(c) for c in ("at", "lo", "hi")]]
    rows = across.select(*cols, F.lit(True).alias("horizontal")).unionByName(down.select(*cols, F.lit(False).alias("horizontal"))).dropna(subset=["at", "lo", "hi", "rule_no"])

    def run(page):
        h, v = page[page.horizontal], page[~page.horizontal]
        fits = lambda at, lo, hi: (at >= lo - tol) & (at <= hi + tol)
        meet = fits(v["at"].to_numpy()[None, :], h["lo"].to_numpy()[:, None], h["hi"].to_numpy()[:, None]) & fits(h["at"].to_numpy()[:, None], v["lo"].to_numpy()[None, :], v["hi"].to_numpy()[None, :])
        far = float("inf")
        label = np.where(meet.any(axis=1), h["rule_no"].to_numpy(float), far)
        while len(h) and len(v):
            below = np.where(meet, label[:, None], far).min(axis=0)
            less = np.minimum(label, np.where(meet, below[None, :], far).min(axis=1))
            if (less == label).all():
                break
            label = less
        below = np.where(meet, label[:, None], far).min(axis=0) if len(h) else np.full(len(v), far)
        out = page[[*keys, "horizontal", "rule_no"]].copy()
        found = np.full(len(page), far)
        found[page.horizontal.to_numpy()], found[~page.horizontal.to_numpy()] = label, below
        return out.assign(lattice=[None if x == far else int(x) for x in found])[[f.name for f in schema.fields]]

    return rows.groupBy(*keys).applyInPandas(run, schema)


def path_rules(points: DataFrame, keys: list[str], width: float, height: float, off: float = 1.6, least: float = 6.0) -> DataFrame:
    """keys, obj, seg, horizontal, x0, y0, x1, y1: straight edges of paths (obj, seg, x, y, kind: move, line or curve, closes)
    along an axis, of `least` points or more, on the page; the edge that closes a path is one."""
    w, c = Window.partitionBy(*keys, "obj").orderBy("seg"), F.col
    # a path begins anew at each move
    part = points.withColumn("_part", F.sum((c("kind") == "move").cast("int")).over(w))
    inside = Window.partitionBy(*keys, "obj", "_part").orderBy("seg")
    rows = part.select(*keys, "obj", "seg", "x", "y", "kind", "closes", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.first("x").over(inside).alias("sx"), F.first("y").over(inside).alias("sy"))
    edge = lambda keep, *at: F.when(keep, F.struct(*[c(a).alias(n) for a, n in zip(at, ("ax", "ay", "bx", "by"))]))
    rows = rows.where("px is not null").select(*keys, "obj", "seg", F.explode(F.array_compact(F.array(edge(c("kind") == "line", "px", "py", "x", "y"), edge(c("closes"), "x", "y", "sx", "sy")))).alias("e")).select(*keys, "obj", "seg", "e.*")
    dx, dy = F.abs(c("bx") - c("ax")), F.abs(c("by") - c("ay"))
    h, v = (dy <= off) & (dx >= least), (dx <= off) & (dy >= least)
    mid = lambda a: (c(f"a{a}") + c(f"b{a}")) / 2
    ends = [F.when(h, F.least("ax", "bx")).otherwise(mid("x")), F.when(h, mid("y")).otherwise(F.least("ay", "by")), F.when(h, F.greatest("ax", "bx")).otherwise(mid("x")), F.when(h, mid("y")).otherwise(F.greatest("ay", "by"))]
    rules = rows.where(h | v).select(*keys, "obj", "seg", h.alias("horizontal"), *[e.alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"))])
    return rules.where((c("x1") >= -2) & (c("y1") >= -2) & (c("x0") <= width + 2) & (c("y0") <= height + 2))
