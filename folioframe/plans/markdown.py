"""Blocks to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def interior_words(lines: DataFrame) -> DataFrame:
    """doc_id, word: lower-case ASCII words that are neither first nor last on their line, each as often as it is there."""
    words = F.regexp_extract_all(X.ascii_lower(F.col("t")), F.lit("([a-z]+)"), F.lit(1))
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2))
    return lines.select("doc_id", F.explode(inner).alias("word"))


def vocabulary(lines: DataFrame) -> DataFrame:
    return interior_words(lines).distinct()


#: Prefixes that take no hyphen before their stem.
BOUND = tuple("multi inter intra trans super pseudo quasi semi anti counter hyper hypo poly mono proto ultra micro macro".split())


def hyphen_joins(lines: DataFrame, words: DataFrame, bound: tuple[str, ...] = BOUND) -> DataFrame:
    """doc_id, line, joined, kept: line ends in a hyphen before a lower-case word. The hyphen is kept where the left part is
    attested in `words` (doc_id, word) and no bound prefix, the joined word is not, and both parts have four letters or
    more; the right one may be shorter if it goes on with a hyphen."""
    w = Window.partitionBy("doc_id").orderBy("line")
    pairs = lines.select("doc_id", "line", "t", F.lead("t").over(w).alias("below"))
    pairs = pairs.where(F.col("t").rlike("[a-zA-Z]-$") & F.col("below").rlike("^[a-z]"))
    left, right = F.regexp_extract(X.ascii_lower(F.col("t")), "([a-z]+)-$", 1), F.regexp_extract(X.ascii_lower(F.col("below")), "^([a-z]+)", 1)
    pairs = pairs.select("doc_id", "line", left.alias("left"), right.alias("right"), F.col("below").rlike("^[A-Za-z]+[-\u2010][A-Za-z]").alias("goes_on"), F.concat(left, right).alias("joined"))
    # only words that are asked for are looked up in the vocabulary
    asked = pairs.select("doc_id", F.explode(F.array("left", "joined")).alias("word")).distinct()
    found = words.join(asked, ["doc_id", "word"], "left_semi").distinct()
    for c in ("left", "joined"):
        pairs = pairs.join(found.select("doc_id", F.col("word").alias(c), F.lit(True).alias(f"has_{c}")), ["doc_id", c], "left")
    known = lambda c: F.coalesce(F.col(f"has_{c}"), F.lit(False))
    kept = ~known("joined") & known("left") & (F.length("left") >= 4) & ((F.length("right") >= 4) | F.col("goes_on")) & ~F.col("left").isin(*bound)
    return pairs.select("doc_id", "line", "joined", kept.alias("kept"))


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, ord, page, kind, depth, text: a block for each line that holds text, of the kind its text shows."""
    t = F.col("t")
    kind = F.when(X.heading_depth(t) > 0, "heading").when(X.list_marker(t) != "", "list").when(X.is_caption(t), "caption").otherwise("paragraph")
    # each generated once: else every pattern below would hold the whole of what makes the text, more than a method can
    rows = lines.select("doc_id", F.col("line").alias("ord"), "page", F.explode(F.array("t")).alias("t")).where("trim(t) <> ''")
    made = F.struct(kind.alias("kind"), X.heading_depth(t).alias("depth"), X.list_marker(t).alias("marker"), "t")
    return rows.select("doc_id", "ord", "page", F.explode(F.array(made)).alias("b")).select("doc_id", "ord", "page", "b.*")


def block_markdown() -> Column:
    t = F.col("t")
    ordered = F.concat(F.regexp_extract(t, "^([0-9]{1,3})", 1), F.lit(". "))
    content = X.escape_line_start(X.escape_inline(F.trim(X.strip_marker(t))))
    item = F.concat(F.when(F.col("marker") == "ordered", ordered).otherwise("- "), content)
    return F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.col("depth"), F.lit(6))), F.lit(" "), X.escape_inline(F.trim(t)))).when(F.col("kind") == "list", item).otherwise(X.escape_line_start(X.escape_inline(F.trim(t))))


def assemble(parts: DataFrame, page_breaks: bool = False) -> DataFrame:
    """doc_id, markdown, blocks: parts (doc_id, ord, page, kind, part) in order with a blank line between, or a single
    line feed between list items; a rule where the page changes, if asked for. Empty parts are passed over first."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = parts.where("part <> ''")
    tight = (F.col("kind") == "list") & (F.lag("kind").over(w) == "list")
    sep = F.when(F.lag("kind").over(w).isNull(), "").when(F.coalesce(tight, F.lit(False)), "\n").otherwise("\n\n")
    if page_breaks:
        sep = F.when(F.lag("page").over(w) != F.col("page"), "\n\n---\n\n").otherwise(sep)
    rows = rows.select("doc_id", "ord", F.concat(sep, "part").alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("doc_id").agg(F.concat(body, F.lit("\n")).alias("markdown"), F.count("*").alias("blocks"))


def front_matter(docs: DataFrame) -> DataFrame:
    """doc_id, front: title, author and source where they are not empty, and always the page count."""
    field = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f"{name}: "), X.yaml_quote(F.col(name))))
    return docs.select("doc_id", F.concat(F.lit("---\n"), F.concat_ws("\n", field("title"), field("author"), field("source"), F.concat(F.lit("pages: "), F.col("pages").cast("string"))), F.lit("\n---\n")).alias("front"))


def to_markdown(lines: DataFrame, page_breaks: bool = False) -> DataFrame:
    return assemble(blocks(lines).withColumn("part", block_markdown()), page_breaks)
