"""Document passes over blocks (doc_id, ord, page, kind, text, size ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_depth, heading_key, is_caption, is_citation_lead, metadata_label, section_path


def heading_tiers(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """doc_id, tier, level: half-point buckets of sizes from 1.12 times the body's on, of texts of up to 220 characters, that hold
    at most 30 % of the document's characters; the largest is level 1, none is over 6."""
    rows = blocks.join(body, "doc_id").withColumn("tier", F.round(F.col("size") * 2) / 2)
    big = (F.col("size") >= 1.12 * F.col("body_size")) & F.length("text").between(1, 220)
    total = rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("total"))
    tiers = rows.where(big).groupBy("doc_id", "tier").agg(F.sum(F.length("text")).alias("chars")).join(total, "doc_id").where("chars <= 0.3 * total")
    level = F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("tier"))), F.lit(6))
    return tiers.select("doc_id", "tier", level.cast("long").alias("level"))


def vetoed(blocks: DataFrame) -> DataFrame:
    """blocks with veto: endings, citations, captions and keys that a document repeats three times are no headings."""
    again = F.count("*").over(Window.partitionBy("doc_id", heading_key(F.col("text"))))
    text = F.col("text")
    return blocks.withColumn("veto", text.rlike("[.,;:!?]$") | is_citation_lead(text) | is_caption(text) | (again >= 3))


def relocate_footnotes(blocks: DataFrame) -> DataFrame:
    """Numbered notes move to the end of their document, in order; their page becomes its last."""
    w = Window.partitionBy("doc_id")
    rank = F.row_number().over(w.orderBy(F.col("note"), "ord"))
    return blocks.withColumn("page", F.when(F.col("note"), F.max("page").over(w)).otherwise(F.col("page"))).withColumn("ord", rank.cast("long"))


def merge_pages(blocks: DataFrame) -> DataFrame:
    """Paragraphs that run over a page's end become one: the earlier does not end a sentence, and the later begins in
    lower case or the earlier ends in a hyphen, or the earlier in :: and the later begins a name; sizes, where there are any, differ by 8 % at most. doc_id, ord (the
    first's), page (the last's), parts, text."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before, page = F.lag("text").over(w), F.lag("page").over(w)
    plain = ~before.rlike("[.!?:;\u2019\u201d\"')\\]]$") & (before.rlike("[-\u00ad]$") | F.col("text").rlike("^[a-z]"))
    on = (F.col("page") == page + 1) & F.when(before.endswith("::"), F.col("text").rlike("^[A-Za-z0-9_]")).otherwise(plain)
    if "size" in blocks.columns:
        size, last = F.col("size"), F.lag("size").over(w)
        on &= F.abs(size - last) <= 0.08 * F.greatest(size, last)
    rows = blocks.withColumn("chain", F.sum((~F.coalesce(on, F.lit(False))).cast("int")).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "chain").agg(F.min("ord").alias("ord"), F.max("page").alias("page"), F.count("*").alias("parts"), F.array_join(parts, " ").alias("text")).drop("chain")


def place_images(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, img_no, ord: the block before which each figure goes: that of its page with the highest top below the
    figure's middle, else the first of a later page, else null (the end)."""
    b = blocks.select("doc_id", F.col("page").alias("b_page"), "ord", "y_top")
    b = b.withColumnRenamed("doc_id", "b_doc")
    j = images.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("b_page") >= F.col("page")), "left")
    same = (F.col("b_page") == F.col("page")) & (F.col("y_top") < F.col("y_mid"))
    one = j.groupBy("doc_id", "img_no").agg(F.max_by(F.when(same, F.col("ord")), F.when(same, F.struct("y_top", -F.col("ord")))).alias("here"), F.min(F.when(F.col("b_page") > F.col("page"), F.col("ord"))).alias("later"))
    return one.select("doc_id", "img_no", F.coalesce("here", "later").alias("ord"))


def dedupe_images(images: DataFrame) -> DataFrame:
    """images with number and path: equal pixels share the first's path; numbers follow first occurrence."""
    w = Window.partitionBy("doc_id", "pixels").orderBy("page", "obj").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct("page", "obj")).over(w)
    rows = images.withColumn("_first", first)
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_first"))
    return rows.withColumn("number", number.cast("long")).withColumn("path", F.concat(F.lit("image_"), F.col("number").cast("string"), F.lit(".png"))).drop("_first")


def merge_references(blocks: DataFrame) -> DataFrame:
    """A reference's entry that begins with [n] takes the blocks after it while its last one ends no sentence, the next
    is no entry, lies on the entry's page or the page after, and differs in size by 15 % of the larger at most.
    doc_id, ord and page (the entry's), parts, text."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    lead = F.coalesce(is_citation_lead(F.col("text")), F.lit(False))
    rows = blocks.select("doc_id", "ord", "page", "size", "text", lead.alias("lead"), F.lag("text").over(w).alias("before"))
    rows = rows.withColumn("entry", F.sum(F.col("lead").cast("int")).over(w))
    head = Window.partitionBy("doc_id", "entry").orderBy("ord")
    first = F.first(F.struct("page", "size")).over(head)
    on = F.col("before").rlike("[^.!? ] *$") & F.col("page").between(F.col("head.page"), F.col("head.page") + 1) & (F.abs(F.col("size") - F.col("head.size")) <= 0.15 * F.greatest("size", "head.size"))
    rows = rows.withColumn("head", first).withColumn("off", (~F.col("lead") & ~F.coalesce(on, F.lit(False))).cast("int"))
    apart = (F.col("entry") == 0) | (F.sum("off").over(head) > 0)
    rows = rows.withColumn("chain", F.when(apart, F.col("ord")).otherwise(F.first("ord").over(head)))
    parts = F.array_sort(F.collect_list(F.struct("ord", "page", "text")))
    one = rows.groupBy("doc_id", "chain").agg(F.count("*").alias("parts"), parts.alias("all"))
    return one.select("doc_id", F.col("chain").alias("ord"), F.col("all")[0]["page"].alias("page"), "parts", F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("text"))


def classify_headings(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """blocks (doc_id, ord, kind, text, first_line, last_line, n_lines, chars, size, bold, x0, x1) with heading (level from 1;
    0: none) and quote.

    Paragraphs of up to three lines and 220 characters from 1.12 times the body's size on take their size's tier; bold
    lines of body size the level below all tiers, 2 at least. Ends of sentences, references, captions and keys or labels
    that three candidates share are no titles; a larger sentence of two lines or more, set in from the column on both
    sides, is a quotation. Numbered headings nest by their numbers, from the shallowest on; bold numbered lines go one
    level below the heading of the number above theirs.
    """
    c = F.col
    rows = blocks.join(body, "doc_id").withColumn("_tier", F.round(c("size") * 2))
    para = c("kind") == "paragraph"
    large = para & (c("n_lines") <= 3) & c("chars").between(1, 220) & (c("size") >= 1.12 * c("body_size"))
    thick = para & (c("n_lines") == 1) & c("bold") & c("chars").between(1, 90) & (c("size") >= 0.98 * c("body_size")) & (c("size") < 1.12 * c("body_size"))
    rows = rows.withColumns({"_large": large, "_thick": thick})
    total = rows.groupBy("doc_id").agg(F.sum("chars").alias("_total"))
    tiers = rows.where("_large").groupBy("doc_id", "_tier").agg(F.sum("chars").alias("_chars")).join(total, "doc_id").where("_chars * 100 <= _total * 30")
    tiers = tiers.select("doc_id", "_tier", F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("_tier"))), F.lit(6)).alias("_level"))
    depth = tiers.groupBy("doc_id").agg(F.count("*").alias("_tiers"))
    rows = rows.join(tiers, ["doc_id", "_tier"], "left").join(depth, "doc_id", "left")
    # how often candidates share a key or a label
    key, label, cand = heading_key(c("text")), metadata_label(c("first_line")), c("_large") | c("_thick")
    rows = rows.withColumns({"_key": key, "_label": label})
    again = lambda k: F.count_if(cand).over(Window.partitionBy("doc_id", k))
    rows = rows.withColumns({"_keys": again("_key"), "_labels": again("_label")})
    titled = ~c("last_line").rlike("[.,;:!?] *$") & ~is_citation_lead(c("first_line")) & ~is_caption(c("first_line")) & (c("_keys") < 3) & ((c("_label") == "") | (c("_labels") < 3))
    rows = rows.withColumn("_titled", titled)
    sized = c("_large") & c("_level").isNotNull()
    level = F.when(sized & c("_titled"), c("_level")).when(~sized & c("_thick") & c("_titled"), F.greatest(F.least(F.coalesce("_tiers", F.lit(0)) + 1, F.lit(6)), F.lit(2))).otherwise(0)
    # the column, by the tenth and ninetieth of a hundred edges of longer paragraphs
    column = blocks.where("kind = 'paragraph' and n_lines >= 2").groupBy("doc_id").agg(F.array_sort(F.collect_list("x0")).alias("l"), F.array_sort(F.collect_list("x1")).alias("r"))
    column = column.select("doc_id", F.element_at("l", F.floor(F.size("l") / 10).cast("int") + 1).alias("_x0"), F.element_at("r", F.floor(F.size("r") * 9 / 10).cast("int") + 1).alias("_x1"))
    rows = rows.join(column, "doc_id", "left").withColumn("heading", level.cast("int"))
    width = c("_x1") - c("_x0")
    quote = sized & ~c("_titled") & (c("n_lines") >= 2) & c("last_line").rlike("[.!?]$") & (width > 0) & (c("x0") - c("_x0") >= 0.02 * width) & (c("_x1") - c("x1") >= 0.02 * width)
    rows = rows.withColumn("quote", F.coalesce(quote, F.lit(False)))
    rows = rows.withColumn("_depth", F.when(c("heading") > 0, heading_depth(c("first_line"))).otherwise(0))
    anchor = rows.where("_depth > 0").groupBy("doc_id").agg(F.min(F.struct("_depth", "heading")).alias("_a"))
    rows = rows.join(anchor, "doc_id", "left")
    nested = F.least(F.greatest(c("_a.heading") - c("_a._depth") + c("_depth"), F.lit(1)), F.lit(6))
    rows = rows.withColumn("heading", F.when(c("_depth") > 0, nested).otherwise(c("heading")))
    path = section_path(c("first_line"))
    rows = rows.withColumn("_path", path).withColumn("_parent", F.regexp_extract("_path", r"^(.*)\.[^.]+$", 1))
    parents = rows.where("heading > 0 and _path <> ''").groupBy("doc_id", F.col("_path").alias("_parent")).agg(F.min("heading").alias("_above"))
    rows = rows.join(parents, ["doc_id", "_parent"], "left")
    below = (c("heading") == 0) & para & c("bold") & (c("n_lines") == 1) & c("chars").between(1, 140) & (c("_parent") != "") & c("_above").isNotNull() & c("_titled")
    rows = rows.withColumn("heading", F.when(below, F.least(c("_above") + 1, F.lit(6))).otherwise(c("heading")))
    return rows.select(*blocks.columns, "heading", "quote")
