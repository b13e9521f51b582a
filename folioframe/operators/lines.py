"""From glyphs to lines: body size, cuts, statistics, gaps, segments and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SIZE = 11.0
LINE = ("doc_id", "page", "line")


def body_size(glyphs: DataFrame) -> DataFrame:
    """The most frequent size, to a quarter point, of a document's glyphs; the least of equals."""
    q = F.when(~F.col("space"), F.round(F.col("size") * 4) / 4)
    return glyphs.groupBy("doc_id").agg(F.coalesce(F.mode(q, True), F.lit(DEFAULT_SIZE)).alias("body_size"))


def gap_cuts(spans: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, cut: the middle of each gap over `least` between spans (lo, hi)."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("reach", F.max("hi").over(w))
    return rows.where(F.col("lo") - F.col("reach") > least).select(*keys, ((F.col("lo") + F.col("reach")) / 2).alias("cut"))


def coverage_cuts(spans: DataFrame, keys: list[str], tolerance: int, least: float) -> DataFrame:
    """keys, cut: middles of stretches `least` wide or more that at most `tolerance` spans cross, with at least
    max(3, n/25) spans on either side. Needs four spans."""
    events = spans.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.*")
    steps = events.groupBy(*keys, "at").agg(F.sum("d").alias("d"), F.count_if(F.col("d") > 0).alias("opens"))
    w = Window.partitionBy(*keys).orderBy("at")
    every = Window.partitionBy(*keys)
    run = steps.select(*keys, "at", F.sum("d").over(w).alias("cover"), F.sum("opens").over(w).alias("begun"), F.sum("opens").over(every).alias("n"), F.lead("at").over(w).alias("next"))
    # islands of neighbouring stretches with little cover
    low = run.where(F.col("next").isNotNull()).withColumn("low", F.col("cover") <= tolerance)
    isle = low.withColumn("isle", F.sum((~F.col("low")).cast("int")).over(w)).where("low")
    one = isle.groupBy(*keys, "isle").agg(F.min("at").alias("lo"), F.max("next").alias("hi"), F.min("n").alias("n"), F.max("begun").alias("begun"), F.max("cover").alias("cover"))
    side = F.greatest(F.lit(3.0), F.col("n") / 25)
    ok = (F.col("hi") - F.col("lo") >= least) & (F.col("n") >= 4) & (F.col("begun") - F.col("cover") >= side) & (F.col("n") - F.col("begun") >= side)
    return one.where(ok).select(*keys, ((F.col("lo") + F.col("hi")) / 2).alias("cut"))


def line_estimate(glyphs: DataFrame) -> DataFrame:
    """Distinct baselines of a page, a step over half the median size apart."""
    w = Window.partitionBy("doc_id", "page").orderBy("y")
    em = glyphs.where("not space").groupBy("doc_id", "page").agg(F.median("size").alias("em"))
    ys = glyphs.where("not space").select("doc_id", "page", "y").distinct().join(em, ["doc_id", "page"])
    step = ys.withColumn("step", F.col("y") - F.lag("y").over(w))
    return step.groupBy("doc_id", "page").agg(F.count_if(F.col("step").isNull() | (F.col("step") > 0.5 * F.col("em"))).alias("lines"))


def line_stats(glyphs: DataFrame) -> DataFrame:
    """Per line: glyphs, size (median, at least 1), largest size, box, baseline of the glyphs near the largest. One pass:
    a line's sizes and baselines come together in the one aggregate, and a line is bounded by its page."""
    real = glyphs.where("not space")
    size = F.greatest(F.median("size"), F.lit(1.0))
    one = real.groupBy(*LINE).agg(F.count("*").alias("glyphs"), size.alias("size"), F.max("size").alias("largest"), F.min("left").alias("x0"), F.max("right").alias("x1"), F.collect_list(F.struct("size", "y")).alias("_g"))
    one = one.withColumn("size_max", F.when(F.col("largest") > 1.8 * F.col("size"), F.col("size")).otherwise(F.col("largest")))
    ys = F.array_sort(F.transform(F.filter("_g", lambda g: g["size"] >= 0.83 * F.col("size_max")), lambda g: g["y"]))
    one = one.withColumn("_ys", ys)
    middle = (F.get("_ys", F.floor((F.size("_ys") - 1) / 2).cast("int")) + F.get("_ys", F.floor(F.size("_ys") / 2).cast("int"))) / 2
    return one.select(*LINE, "glyphs", "size", "x0", "x1", "size_max", middle.alias("baseline"))


def gaps(glyphs: DataFrame) -> DataFrame:
    """Per non-space glyph: the distance to the one before it on its line, and whether a space glyph lies between."""
    w = Window.partitionBy(*LINE).orderBy("left", "seq")
    real = glyphs.where("not space")
    return real.select(*LINE, "seq", "ch", "left", "right", "size", "bold", (F.col("left") - F.lag("right").over(w)).alias("gap"), (F.col("seq") - F.lag("seq").over(w) > 1).alias("spaced"))


def word_gap(gap_rows: DataFrame, em: float) -> DataFrame:
    """Per line: the middle of the largest jump between its sorted gaps whose lower gap is within 0.6 em, if it is 0.11
    em or more and there are three gaps; else 0.28 em. Held within 0.18 and 0.9 em."""
    w = Window.partitionBy(*LINE).orderBy("gap")
    rows = gap_rows.where("gap is not null").select(*LINE, "gap", F.lag("gap").over(w).alias("below"), F.row_number().over(w).alias("rank"), F.count("*").over(Window.partitionBy(*LINE)).alias("n"))
    jump = F.when((F.col("below") <= 0.6 * em) & (F.col("gap") > F.col("below")), F.col("gap") - F.col("below"))
    one = rows.groupBy(*LINE).agg(F.max("n").alias("n"), F.max_by(F.struct(jump.alias("jump"), ((F.col("gap") + F.col("below")) / 2).alias("mid")), F.struct(F.coalesce(jump, F.lit(-1.0)), -F.col("rank"))).alias("best"))
    found = F.when((F.col("n") >= 3) & (F.col("best.jump") >= 0.11 * em), F.col("best.mid")).otherwise(0.28 * em)
    return one.select(*LINE, F.least(F.greatest(found, F.lit(0.18 * em)), F.lit(0.9 * em)).alias("word_gap"))


def segments(gap_rows: DataFrame) -> DataFrame:
    """Per line: its segments, parted by gaps over max(1.4 em, 10), with text. A blank stands where a space glyph does."""
    w = Window.partitionBy(*LINE).orderBy("left", "seq")
    wide = F.coalesce(F.col("gap") > F.greatest(1.4 * F.col("size"), F.lit(10.0)), F.lit(False))
    rows = gap_rows.withColumn("segment", F.sum(wide.cast("int")).over(w)).withColumn("piece", F.concat(F.when(F.coalesce(F.col("spaced"), F.lit(False)) & ~wide, " ").otherwise(""), F.col("ch")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "seq", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy(*LINE, "segment").agg(F.min("left").alias("first"), F.max("right").alias("last"), text.alias("text"))


def style_runs(gap_rows: DataFrame) -> DataFrame:
    """Runs of equal style on a line: islands over a change of bold."""
    w = Window.partitionBy(*LINE).orderBy("left", "seq")
    new = F.coalesce(F.col("bold") != F.lag("bold").over(w), F.lit(True))
    return gap_rows.withColumn("run", F.sum(new.cast("int")).over(w)).groupBy(*LINE, "run").agg(F.first("bold").alias("bold"), F.count("*").alias("glyphs"))


def token_spaces(gap_rows: DataFrame, em: float) -> DataFrame:
    """Gap rows with space: whether a blank goes before the glyph. A blank glyph or a gap over 0.28 em asks for one. It
    falls away inside a column where it parts digits or a hyphened token without a blank glyph, stands before . , : ;
    of a word (not before :=), or beside a double colon."""
    w = Window.partitionBy(*LINE).orderBy("left", "seq")
    word, c, a = "[A-Za-z0-9]", F.col("ch"), F.lag("ch").over(w)
    spaced = F.coalesce(F.col("spaced"), F.lit(False))
    after = F.when(F.lead("spaced").over(w), " ").otherwise(F.coalesce(F.lead("ch").over(w), F.lit("")))
    bound = (
        (a.rlike("[0-9]") & c.rlike("[0-9]") & ~spaced)
        | (a.rlike(word) & c.isin(".", ",", ":", ";") & ~((c == ":") & (after == "=")))
        | ((a == ":") & ((c == ":") | F.coalesce(F.lag("ch", 2).over(w) == ":", F.lit(False))))
        | (a.rlike(word) & (c == "-") & after.rlike(word) & ~spaced)
    )
    column = F.col("gap") > F.greatest(1.4 * F.col("size"), F.lit(10.0))
    asked = F.col("gap").isNotNull() & (spaced | (F.col("gap") > 0.28 * em))
    return gap_rows.withColumn("space", asked & (column | ~F.coalesce(bound, F.lit(False))))


def repair_ocr_layer(glyphs: DataFrame) -> DataFrame:
    """Glyphs with ocr, of pages with 20 inked ones or more, over half of them over 1.8 times as tall as their size: their
    sizes become heights, and a blank between two glyphs of one baseline is set between them."""
    order = Window.partitionBy("doc_id", "page").orderBy("line", "seq")
    w = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the whole page, in the one order: sorted once
    ink, tall = ~F.col("space"), (F.col("top") - F.col("bottom")) > 1.8 * F.col("size")
    rows = glyphs.withColumn("ocr", (F.count_if(ink).over(w) >= 20) & (F.count_if(ink & tall).over(w) * 2 > F.count_if(ink).over(w)))
    rows = rows.withColumn("size", F.when(F.col("ocr") & tall, F.col("top") - F.col("bottom")).otherwise(F.col("size")))
    before, after = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    tol = 0.45 * F.greatest(before("size"), after("size"), F.lit(1.0))
    moved = F.col("ocr") & F.col("space") & ~before("space") & ~after("space") & (F.abs(before("y") - after("y")) <= tol) & (after("left") >= before("right") - tol)
    rows = rows.select("*", F.coalesce(moved, F.lit(False)).alias("_moved"), before("right").alias("_right"), after("left").alias("_left"), before("y").alias("_y"))
    put = lambda c, x: F.when(F.col("_moved"), x).otherwise(F.col(c))
    return rows.withColumns({"right": put("right", F.greatest("_left", "_right")), "left": put("left", F.col("_right")), "y": put("y", F.col("_y"))}).drop("_moved", "_right", "_left", "_y")


def trailing_number(gap_rows: DataFrame) -> DataFrame:
    """Per line: digits of the number at its end that a blank glyph or a word gap sets off from ink before it; else 0."""
    w = Window.partitionBy(*LINE).orderBy("left", "seq")
    rows = gap_rows.select(*LINE, F.struct(F.row_number().over(w).alias("r"), F.col("ch").rlike("[0-9]").alias("digit"), (F.coalesce("spaced", F.lit(False)) | (F.col("gap") >= 0.28 * F.col("size"))).alias("apart")).alias("g"))
    one = rows.groupBy(*LINE).agg(F.array_sort(F.collect_list("g")).alias("gs"))
    stop = F.coalesce(F.array_max(F.transform(F.filter("gs", lambda x: ~x["digit"]), lambda x: x["r"])), F.lit(0))
    one = one.withColumn("stop", stop)
    set_off = (F.col("stop") > 0) & (F.size("gs") > F.col("stop")) & F.coalesce(F.get("gs", F.col("stop"))["apart"], F.lit(False))
    return one.select(*LINE, F.when(set_off, F.size("gs") - F.col("stop")).otherwise(0).cast("long").alias("digits"))
