"""Lines, glyphs and page selections as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines on a page, line pitch, first baseline, left margin and advance of the plain typesetter, in points.
PAGE_LINES, PITCH, TOP, LEFT, ADVANCE = 45, 15, 750, 72, 5


def text_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, page, t: a row for each line of each text; null texts have none."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.floor(F.col("line") / PAGE_LINES).alias("page"), "t")


def line_size() -> Column:
    return F.when(F.col("line") == 0, 16.0).when((F.col("doc_id") + F.col("line")) % 7 == 0, 9.5).otherwise(10.0)


def typeset(lines: DataFrame) -> DataFrame:
    """Glyphs (doc_id, page, line, seq, ch, x, y, left, right, bottom, top, size, bold, space) of lines in a fixed pitch."""
    g = lines.select("doc_id", "page", "line", line_size().alias("size"), F.posexplode(F.split("t", "")).alias("seq", "ch"))
    x, y = F.lit(float(LEFT)) + F.col("seq") * float(ADVANCE), F.lit(float(TOP)) - (F.col("line") % PAGE_LINES) * float(PITCH)
    return g.where("ch <> ''").select("doc_id", "page", "line", F.col("seq").cast("long").alias("seq"), "ch", x.alias("x"), y.alias("y"), x.alias("left"), (x + 4.5).alias("right"), (y - 2.0).alias("bottom"), (y + 8.0).alias("top"), "size", ((F.col("doc_id") + F.col("line")) % 5 == 0).alias("bold"), (F.col("ch") == " ").alias("space"))


def page_spec(specs: DataFrame, column: str = "spec") -> DataFrame:
    """spec, page (0-based) of selections such as 1-3,7. Empty parts are passed over; a spec with any other part out of
    form or range selects nothing."""
    parts = F.filter(F.split(column, ","), lambda p: p != "")
    first, last = (lambda p, at: F.try_to_number(F.regexp_extract(p, "^([0-9]{1,8})(?:-([0-9]{1,8}))?$", at), F.lit("99999999")).cast("bigint") for _ in range(2))
    ends = F.transform(parts, lambda p: F.struct(first(p, 1).alias("a"), F.when(p.contains("-"), last(p, 2)).otherwise(first(p, 1)).alias("b")))
    good = lambda x: F.coalesce((x["a"] >= 1) & (x["b"] >= x["a"]) & (x["b"] - x["a"] < 100_000) & (x["b"] <= 10_000_000), F.lit(False))
    rows = specs.select(F.col(column).alias("spec"), ends.alias("ends")).where((F.size("ends") > 0) & F.forall("ends", good))
    rows = rows.select("spec", F.explode("ends").alias("e"))
    return rows.select("spec", F.explode(F.sequence(F.col("e.a") - 1, F.col("e.b") - 1)).alias("page")).distinct()


def select_pages(table: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows whose page is selected; an unknown page selects nothing."""
    return table.join(pages.select("page").distinct(), "page", "left_semi")
