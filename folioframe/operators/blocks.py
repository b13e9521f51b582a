"""From glyphs with regions and lines to blocks: a row for each line, then the blocks that a region's lines form."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LINE = ["doc_id", "page", "region", "line_no"]
#: Glyphs at a line's begin that are kept for its marker.
HEAD = 6


def line_table(glyphs: DataFrame) -> DataFrame:
    """A row for each line of glyphs (page_lines'): size (median, 1 at least), size_max, baseline, x0, x1, top, bottom,
    glyphs, bold and mono (shares over half), word_gap, text, segments, head (its first glyphs).

    All in one pass over the lines' glyphs, dealt once by page. A blank goes before a glyph after a blank glyph or a gap
    over word_gap, unless it would split a token: between digits or at a hyphen without a blank glyph, before . , : ; of a
    word but not :=, and around double colons; a column gap always parts.
    """
    c = F.col
    order = Window.partitionBy(*LINE).orderBy("left", F.when(c("space"), 0).otherwise(1), "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ink = ~c("space")
    rows = glyphs.where("line_no >= 0").select("*", F.last(F.when(ink, c("right")), True).over(before).alias("_right"), F.lag("space").over(order).alias("_after_blank"), F.lead("ch").over(order).alias("_next"))
    rows = rows.where(ink).withColumn("raised", (c("top") > c("bottom")) & (c("top") - c("y") < 0.30 * c("size")) & (c("y") - c("bottom") > 0.55 * c("size")))
    every = Window.partitionBy(*LINE)
    one = Window.partitionBy(*LINE).orderBy("left", "seq")
    rows = rows.select("*", F.greatest(F.median("size").over(every), F.lit(1.0)).alias("em"), F.max("size").over(every).alias("_most"), (c("left") - c("_right")).alias("gap"))
    gaps = F.array_sort(F.collect_list(F.greatest("gap", F.lit(0.0))).over(every))
    rows = rows.withColumn("largest", F.when(c("_most") <= 1.8 * c("em"), c("_most")).otherwise(c("em"))).withColumn("_gaps", gaps)
    # the middle of the largest jump between sorted gaps; the first of equals
    jump = F.aggregate(
        F.sequence(F.lit(2), F.size("_gaps")), F.struct(F.lit(0.0).alias("jump"), F.lit(0.0).alias("mid")),
        lambda a, i: F.when((F.element_at("_gaps", i) - F.element_at("_gaps", i - 1) > a["jump"]) & (F.element_at("_gaps", i - 1) <= 0.6 * c("em")), F.struct((F.element_at("_gaps", i) - F.element_at("_gaps", i - 1)).alias("jump"), ((F.element_at("_gaps", i) + F.element_at("_gaps", i - 1)) / 2).alias("mid"))).otherwise(a),
    )
    rows = rows.withColumn("_jump", F.when(F.size("_gaps") >= 3, jump))
    rows = rows.withColumn("word_gap", F.when(c("_jump.jump") >= 0.11 * c("em"), F.least(F.greatest(c("_jump.mid"), 0.18 * c("em")), 0.9 * c("em"))).otherwise(0.28 * c("em")))
    a, aa, ch, nx, word = F.lag("ch").over(one), F.lag("ch", 2).over(one), c("ch"), F.coalesce("_next", F.lit("")), "[A-Za-z0-9]"
    wide = c("gap") > F.greatest(1.4 * c("em"), F.lit(10.0))
    blank = F.coalesce("_after_blank", F.lit(False))
    bound = (
        (a.rlike("[0-9]") & ch.rlike("[0-9]") & ~blank) | (ch.isin(".", ",", ":", ";") & a.rlike(word) & ~((ch == ":") & (nx == "=")))
        | ((ch == ":") & (a == ":")) | ((a == ":") & (aa == ":")) | ((ch == "-") & a.rlike(word) & nx.rlike(word) & ~blank)
    )
    asked = c("gap").isNotNull() & (blank | (c("gap") > c("word_gap")) | wide)
    rows = rows.withColumn("_piece", F.concat(F.when(asked & (wide | ~F.coalesce(bound, F.lit(False))), " ").otherwise(""), ch)).withColumn("_wide", F.coalesce(wide, F.lit(False)).cast("int"))
    low = F.when(~c("raised") & (c("size") >= 0.83 * c("largest")), c("y"))
    text = F.array_sort(F.collect_list(F.struct("left", "seq", "_piece", "ch", "size", "y")))
    out = rows.groupBy(*LINE).agg(
        F.first("em").alias("size"), F.first("largest").alias("size_max"), F.coalesce(F.median(low), F.median(F.when(~c("raised"), c("y"))), F.lit(0.0)).alias("baseline"), F.min("left").alias("x0"), F.max("right").alias("x1"), F.max("top").alias("top"), F.min("bottom").alias("bottom"),
        F.count("*").alias("glyphs"), F.count_if("bold").alias("bold"), ((F.count_if("mono") * 2 > F.count("*")) & (F.count_if(X.is_cjk(F.ascii("ch"))) == 0)).alias("mono"), F.first("word_gap").alias("word_gap"), (F.sum("_wide") + 1).alias("segments"), text.alias("_all"),
    )
    return out.withColumn("text", F.array_join(F.transform("_all", lambda x: x["_piece"]), "")).withColumn("head", F.transform(F.slice("_all", 1, HEAD), lambda x: F.struct(x["ch"].alias("ch"), x["left"].alias("left"), x["size"].alias("size"), x["y"].alias("y")))).drop("_all")


MARKERS = (
    (re.compile(rf"[{X.BULLETS}{X.DASHES[1:]}-] +(?=\S)"), lambda m: ("-", False)),
    (re.compile(r"([0-9]{1,3})[.)] +(?=\S)"), lambda m: (m[1] + ".", True)),
    (re.compile(r"(?=(?:[A-Za-z]|[ivxlcdmIVXLCDM]{1,6})\) +\S)"), lambda m: ("-", False)),
)
NOTE = re.compile(r"[†‡§¶∗*]|[0-9]{1,3}")
ENTRY = re.compile(r" *\[[0-9]+\]")


@dataclass
class Row:
    """A line as the blocks see it; `cut` of its characters are a marker that goes."""

    no: int
    text: str
    x0: float
    x1: float
    baseline: float
    size: float
    mono: bool
    marker: str = ""
    ordered: bool = False
    note: str = ""
    cut: int = 0
    content: float = 0.0

    @classmethod
    def read(cls, r) -> Row:
        row = cls(int(r.line_no), r.text, r.x0, r.x1, r.baseline, r.size, bool(r.mono))
        ref = r.size_max or r.size
        # of one size and baseline, no glyph is raised
        head = [] if getattr(r, "even", False) and r.first[2] >= 0.82 * ref else list(r.head)
        raised = [g["size"] < 0.82 * ref and g["y"] - r.baseline > 0.10 * ref for g in head]
        n = 0
        while n < min(len(head), 3) and raised[n] and head[n]["ch"].isdigit() and head[n]["ch"].isascii():
            n += 1
        n = n or int(bool(head) and raised[0] and head[0]["ch"] in "†‡§¶∗*")
        # the note's text is a letter on the line itself
        if n and n < len(head) and not (head[n]["size"] < 0.82 * ref and abs(head[n]["y"] - r.baseline) > 0.06 * ref) and re.match(rf"[A-Za-z{X.GREEK}]", head[n]["ch"]):
            row.note = "".join(g["ch"] for g in head[:n])
            row.cut = len(r.text) - len(r.text[n:].lstrip())
            row.content = head[n]["left"]
            return row
        for form, name in MARKERS:
            m = form.match(r.text)
            if m:
                row.marker, row.ordered = name(m)
                head = head or list(r.head)
                row.cut, at = m.end(), len(m[0].replace(" ", ""))
                row.content = head[at]["left"] if at < len(head) else r.x0
                break
        return row


def middle(values: list[float]) -> float:
    """The median."""
    s, n = sorted(values), len(values)
    return float(s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2)


class Flow:
    """The blocks of a region's lines, from the top: each line goes on the open block or begins another."""

    def __init__(self, rows: list[Row]):
        sizes = [r.size for r in rows]
        steps = [a.baseline - b.baseline for a, b in zip(rows, rows[1:])]
        steps = [s for s in steps if s > 0.1]
        self.em = max(middle(sizes), 1.0) if sizes else 11.0
        usual = [s for s in steps if s < 3 * self.em] or steps
        self.step = middle(usual) if usual else 1.2 * self.em
        self.width = max(r.x1 for r in rows) - min(r.x0 for r in rows) if rows else 0.0
        self.blocks: list[dict] = []
        self.last: Row | None = None

    def add(self, row: Row) -> None:
        block = self.blocks[-1] if self.blocks else None
        entry = block is not None and block["kind"] == "paragraph" and ENTRY.match(block["rows"][0].text)
        # a dash that goes on a reference's hanging clause is no bullet
        if row.marker and not row.ordered and entry and row.text[:1] in X.DASHES and not self.last.text.endswith((".", "!", "?")) and row.x0 > block["x0"] + 1.2 * self.em:
            row.marker, row.cut = "", 0
        if block is None or self._ends(block, row):
            kind = "paragraph" if row.note else "list" if row.marker else "code" if row.mono else "paragraph"
            block = {"kind": kind, "rows": [], "x0": row.x0, "x1": row.x1, "content": row.content or row.x0, "blanks": {}}
            self.blocks.append(block)
        elif block["kind"] == "code":
            blank = int(np.floor((self.last.baseline - row.baseline) / self.step + 0.5)) - 1
            block["blanks"][row.no] = max(0, min(blank, 4))
        if block["rows"]:
            row.cut = 0
        block["rows"].append(row)
        block["x0"], block["x1"] = min(block["x0"], row.x0), max(block["x1"], row.x1)
        self.last = row

    def _ends(self, block: dict, row: Row) -> bool:
        last, item = self.last, block["kind"] == "list"
        gap, size = last.baseline - row.baseline, max(row.size, last.size)
        if row.marker or row.note or row.mono != (block["kind"] == "code"):
            return True
        if abs(row.size - last.size) > 0.15 * size or gap > 1.45 * self.step + 0.01 or gap > 2.1 * size:
            return True
        if block["kind"] == "code":
            return False
        inset = row.x0 > (block["content"] if item else block["x0"]) + 1.2 * self.em
        hangs = inset and (bool(ENTRY.match(block["rows"][0].text)) or not last.text.endswith((".", "!", "?")))
        short = not last.text.endswith(("-", "‐", "­")) and last.x1 < max(block["x1"], row.x1) - max(2.5 * self.em, 0.12 * self.width)
        if short and not hangs and not (item and abs(row.x0 - block["content"]) < self.em):
            return True
        return inset and not hangs or item and row.x0 < block["content"] - 1.2 * self.em

    def levels(self) -> list[int]:
        """Nesting of list items by their markers' places."""
        begins: list[float] = []
        for x in sorted(b["x0"] for b in self.blocks if b["kind"] == "list"):
            if not begins or x > begins[-1] + 0.9 * self.em:
                begins.append(x)
        return [next((i for i, x in enumerate(begins) if abs(b["x0"] - x) <= 0.9 * self.em + 1e-6), 0) if b["kind"] == "list" else 0 for b in self.blocks]


def form_blocks(lines: DataFrame) -> DataFrame:
    """line_table's rows with block (from 0 in their region), kind, marker, ordered, note, cut (characters of its marker),
    level and blanks (blank lines before a line of code). A region is bounded by its page."""
    extra = "block long, kind string, marker string, ordered boolean, note string, cut long, level long, blanks long"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields) + ", " + extra

    names = [n.split()[0] for n in extra.split(", ")]

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["region", "baseline", "x0"], ascending=[True, False, True], kind="stable")
        found = []
        lines = list(page.itertuples())
        for _, region in groupby(lines, key=lambda r: r.region):
            rows = [Row.read(r) for r in region]
            flow = Flow(rows)
            for r in rows:
                flow.add(r)
            for k, (b, level) in enumerate(zip(flow.blocks, flow.levels())):
                first = b["rows"][0]
                found += [(k, b["kind"], first.marker, first.ordered, first.note, r.cut, level, b["blanks"].get(r.no, 0)) for r in b["rows"]]
        return page.assign(**dict(zip(names, map(list, zip(*found)))))

    return lines.groupBy("doc_id", "page").applyInPandas(run, schema)


def join_lines(lines: DataFrame, words: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, text: a block's lines (t) as one text. A hyphen at a line's end before a lower-case letter goes, unless it is a
    compound's or an identifier's own; before a capital it stays; a url that runs on is not parted; else a blank stands
    between. `words` (doc_id, word) are those attested inside lines."""
    c, w = F.col, Window.partitionBy(*by).orderBy(*order)
    rows = lines.select(*by, *order, F.regexp_replace("t", " +$", "").alias("t")).withColumn("below", F.lead("t").over(w))
    lower = c("below").rlike("^[a-z]") & c("t").rlike("[-‐]$") | c("t").endswith("­")
    left, right = F.regexp_extract(X.ascii_lower(c("t")), "([a-z]+)[-‐­]$", 1), F.regexp_extract(X.ascii_lower(c("below")), "^([a-z]+)", 1)
    literal, gainsaid = X.literal_hyphen(c("t"), c("below"))
    rows = rows.select("*", F.coalesce(lower & c("below").isNotNull(), F.lit(False)).alias("wrap"), left.alias("left"), F.concat(left, right).alias("joined"), literal.alias("literal"), gainsaid.alias("gainsaid"), right.alias("right"))
    asked = rows.where("wrap").select("doc_id", F.explode(F.array("left", "joined", "gainsaid")).alias("word")).distinct()
    known = words.join(asked, ["doc_id", "word"], "left_semi").groupBy("doc_id").agg(F.collect_set("word").alias("_known"))  # those asked for alone
    rows = rows.join(known, "doc_id", "left")
    has = lambda x: F.coalesce(F.array_contains("_known", c(x)), F.lit(False))
    from ..plans.markdown import BOUND

    goes_on = c("below").rlike("^[A-Za-z]+[-‐][A-Za-z]")
    compound = has("left") & ~has("joined") & (F.length("left") >= 4) & ((F.length("right") >= 4) | goes_on) & ~c("left").isin(*BOUND)
    keep = compound | c("literal") & ~has("gainsaid")
    bare, plain = F.regexp_replace("t", "[-‐­]$", ""), F.regexp_replace("t", "‐$", "-")
    tight = c("t").rlike("[-‐]$") & c("below").rlike("^[A-Z]")
    piece = F.when(c("below").isNull(), c("t")).when(c("wrap"), F.concat(bare, F.when(keep, "-").otherwise(""))).when(tight, plain).when(X.url_wraps(c("t"), c("below")), c("t")).otherwise(F.concat("t", F.lit(" ")))
    parts = F.array_sort(F.collect_list(F.struct(*order, piece.alias("piece"))))
    return rows.groupBy(*by).agg(F.replace(F.array_join(F.transform(parts, lambda x: x["piece"]), ""), F.lit("­"), F.lit("")).alias("text"))
