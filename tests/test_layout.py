"""Layout queries against their SQL, and text expressions on small cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators import chrome, cluster, grid, passes
from folioframe.plans import markdown, registry
from folioframe.sources import typeset

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    r = duck.execute(registry.ORACLES[name])
    cols, want = [c[0] for c in r.description], r.fetchall()
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in got.select(*cols).collect())


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "column,value,want",
    [
        (X.heading_depth, "2.1 Setup", 2), (X.heading_depth, "2.1x", 0), (X.segment_signature, "Page 12 of 40", "page#of#"), (X.heading_key, " A-b  C. ", "a b c"),
        (X.metadata_label, "Key: v", "Key"), (X.metadata_label, "a::b", ""), (X.escape_line_start, "12. x", "12\\. x"), (X.code_span, "a``b", "```a``b```"), (X.ligatures, "ﬁn", "fin•"),
        (X.yaml_quote, 'a"b', '"a\\"b"'), (X.image_link, "a b.png", "![](<a b.png>)"), (X.script_braces, "ab", "{ab}"),
        (X.operator_macro, "sinh", "\\sinh"), (X.operator_macro, "sine", "sine"), (X.is_continuation_marker, " \u25bd ", True), (X.is_continuation_marker, " ", False), (X.keeps_hyphen, "a-b-", True), (X.keeps_hyphen, "ab-", False),
    ],
)
def test_text(spark, column, value, want):
    assert one(spark, value, column) == want


def test_styles_and_breaks(spark):
    row = spark.createDataFrame([(" a*b ", True, False, False)], "t string, b boolean, i boolean, m boolean")
    assert row.select(X.render_run(*map(F.col, "tbim")).alias("x")).first().x == " **a\\*b** "
    lines = spark.createDataFrame([(1, 0, 0, "- a"), (1, 1, 0, "- b"), (1, 2, 1, "c"), (2, 0, 0, " ")], "doc_id long, line long, page long, t string")
    got = {r.doc_id: r.markdown for r in markdown.to_markdown(lines, page_breaks=True).collect()}
    assert got == {1: "- a\n- b\n\n---\n\nc\n"}


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert typeset.text_lines(docs).count() == 1
    assert typeset.typeset(typeset.text_lines(docs)).count() == 0


def test_columns_are_read_one_by_one(spark):
    rows = [(1, 0, 700.0 - 12 * i, x + 6.0 * k, x + 6.0 * k + 5, 10.0, False, f"{c}{i}") for c, x in (("b", 300.0), ("a", 72.0)) for i in range(5) for k in range(6)]
    rows += [(1, 0, 500.0, 72.0 + 6 * k, 77.0 + 6 * k, 10.0, False, "foot") for k in range(40)] + [(1, 0, 400.0, 72.0, 77.0, None, True, "blank")]
    g = spark.createDataFrame(rows, "doc_id long, page long, y double, left double, right double, size double, space boolean, name string").selectExpr("*", "y as bottom", "y + 10 as top")
    got = {(r.region, r.line_no, r.name) for r in cluster.page_lines(g).collect()}
    regions = {n: r for r, line, n in got}
    assert [n for n in sorted(regions, key=lambda n: (regions[n], n)) if n != "blank"] == [f"{c}{i}" for c in "ab" for i in range(5)] + ["foot"]
    assert {n: line for r, line, n in got} == {f"{c}{i}": i for c in "ab" for i in range(5)} | {"foot": 0, "blank": -1}
    assert cluster.page_lines(g.where("false")).count() == 0


def test_lattices(spark):
    rule = "doc long, rule_no int, at double, lo double, hi double"
    # two grids side by side, joined on page 2 by a long rail; a rule that meets nothing
    across = [(d, i, 100.0 * i, 0.0, 50.0) for d in (1, 2) for i in range(3)] + [(d, 10 + i, 100.0 * i, 80.0, 120.0) for d in (1, 2) for i in range(3)] + [(1, 20, 500.0, 0.0, 9.0), (2, 21, 150.0, 0.0, 120.0)]
    down = [(d, n, float(x), 0.0, 200.0) for d in (1, 2) for n, x in enumerate((0, 50, 80, 122))] + [(3, 0, 1.0, 0.0, 9.0)]
    got = {(r.doc, r.horizontal, r.rule_no): r.lattice for r in grid.lattices(spark.createDataFrame(across, rule), spark.createDataFrame(down, rule), ["doc"]).collect()}
    assert len(got) == len(across) + len(down)
    assert {got[1, True, i] for i in range(3)} == {0} and {got[1, True, 10 + i] for i in range(3)} == {10}
    assert [got[1, False, n] for n in range(4)] == [0, 0, 10, 10]
    assert got[1, True, 20] is None and got[3, False, 0] is None
    assert {v for (d, _, n), v in got.items() if d == 2} == {0}


def test_cells_join_and_columns_match(spark):
    row = spark.createDataFrame([("a_", "b", [1.0, 9.0], [2.0, 11.9], [2.0], 5.0)], "l string, r string, a array<double>, b array<double>, c array<double>, s double")
    got = row.select(X.joins_tight(F.col("l"), F.col("r")).alias("x"), X.joins_tight(F.col("r"), F.col("r")).alias("y"), X.same_columns(F.col("a"), F.col("b"), F.col("s")).alias("z"), X.same_columns(F.col("a"), F.col("c"), F.col("s")).alias("n")).first()
    assert tuple(got) == (True, False, True, False)


def test_running_chrome(spark):
    # page, line, seg, text, x0, x1, y, low, high, size of ten pages: a head by chapter, a foot of two segments, a stamp
    rows = []
    for p in range(10):
        rows += [(p, 0, 0, "Chapter A" if p < 5 else f"Own head {'abcde'[p - 5]}", 72.0, 150.0, 760.0), (p, 1, 0, f"Page {p}", 72.0, 100.0, 30.0), (p, 1, 1, "Doc 17", 400.0, 450.0, 30.0)]
        rows += [(p, 2, 0, f"Result {p}", 72.0, 200.0, 500.0), (p, 3, 0, "The same sentence of the body", 72.0, 300.0, 400.0), (p, 3, 1, "STAMP", 560.0, 600.0, 400.0)]
        rows += [(p, 4, 0, "Name Size" if p < 4 else f"Top {'uvwxyz'[p - 4]}", 300.0, 380.0, 730.0), (p, 5, 0, f"cell {'abcdefghij'[p]}", 300.0, 380.0, 720.0)]
        rows += [(p, 6, 0, "Doc 17", 72.0, 100.0, 50.0), (p, 6, 1, f"but {'abcdefghij'[p]} stays", 110.0, 200.0, 50.0)]
    schema = "doc_id long, page long, line long, seg long, t string, x0 double, x1 double, y double, low double, high double, size double"
    segments = spark.createDataFrame([(1, *r, r[-1] - 2, r[-1] + 8, 10.0) for r in rows] + [(2, p, 0, 0, "Chapter A", 72.0, 150.0, 760.0, 758.0, 768.0, 10.0) for p in range(2)], schema)
    pages = spark.createDataFrame([(d, p, 612.0, 792.0) for d, n in ((1, 10), (2, 2)) for p in range(n)], "doc_id long, page long, width double, height double")
    got = sorted((r.doc_id, r.page, r.line, r.seg) for r in chrome.strip_running(segments, pages).collect())
    gone = {(1, p, 0, 0) for p in range(5)} | {(1, p, 1, s) for p in range(10) for s in (0, 1)} | {(1, p, 3, 1) for p in range(10)}
    assert got == sorted({(r.doc_id, r.page, r.line, r.seg) for r in segments.collect()} - gone)


def test_headers_and_footers_of_blocks(spark):
    rows = [(1, 3 * p + k, p, kind, [t], y, y + 10.0) for p in range(4) for k, (kind, t, y) in enumerate((("paragraph", "Running head" if p else "Title", 760.0), ("paragraph", "Running head", 400.0), ("image" if p == 3 else "paragraph", f"- {p} -", 20.0)))]
    blocks = spark.createDataFrame([*rows, (2, 0, 0, "paragraph", ["7"], 20.0, 30.0)], "doc_id long, ord long, page long, kind string, lines array<string>, low double, high double")
    pages = spark.createDataFrame([(1, p, 792.0) for p in range(4)] + [(2, 0, 792.0)], "doc_id long, page long, height double")
    assert sorted((r.doc_id, r.ord) for r in chrome.strip_headers_footers(blocks, pages).collect()) == [(1, 0), (1, 1), (1, 4), (1, 7), (1, 10), (1, 11), (2, 0)]


def test_sizes_and_bound_prefixes(spark):
    b = spark.createDataFrame([(1, 0, 0, "it goes", 10.0), (1, 1, 1, "on here", 10.5), (1, 2, 2, "in small", 8.0)], "doc_id long, ord long, page long, text string, size double")
    assert sorted((r.parts, r.text) for r in passes.merge_pages(b).collect()) == [(1, "in small"), (2, "it goes on here")]
    lines = spark.createDataFrame([(1, 0, "multi-"), (1, 1, "plicative self-"), (1, 2, "plicative")], "doc_id long, line long, t string")
    vocab = spark.createDataFrame([(1, w) for w in ("multi", "self", "plicative")], "doc_id long, word string")
    assert {r.line: r.kept for r in markdown.hyphen_joins(lines, vocab).collect()} == {0: False, 1: True}


def test_blocks_of_lists_notes_code_and_quotes(spark):
    """A page set by hand: nested bullets, a numbered item, a hanging reference, code with a blank line, a footnote."""
    from folioframe.plans import convert

    rows = [
        ("Plain words that make a line of text here", 72, 700, 10, False), ("and go on to the margin of the same one", 72, 688, 10, False),
        ("- first item of the list stands here", 72, 664, 10, False), ("- nested item below the first one", 90, 652, 10, False), ("3) third and last of the items is this", 72, 640, 10, False),
        ("[12] A. Author. A title of the work that", 72, 616, 10, False), ("goes on. And ends here in the year 1999", 96, 604, 10, False),
        ("x = 1", 72, 580, 10, True), ("y = 22", 72, 556, 10, True), ("Bound to be multi-", 72, 520, 10, False), ("plicative in the end of all", 72, 508, 10, False),
    ]
    glyphs, seq = [], 0
    for text, x, y, size, mono in rows:
        for i, ch in enumerate(text):
            glyphs.append((1, 0, seq, ch, float(y), x + 6.0 * i, x + 6.0 * i + 5, y - 2.0, y + 8.0, float(size), False, mono, ch == " "))
            seq += 1
    g = spark.createDataFrame(glyphs, "doc_id long, page long, seq long, ch string, y double, left double, right double, bottom double, top double, size double, bold boolean, mono boolean, space boolean")
    pages = spark.createDataFrame([(1, 0, 612.0, 792.0)], "doc_id long, page long, width double, height double")
    got = convert.convert(g, pages).first().markdown
    assert "Plain words that make a line of text here and go on to the margin of the same one" in got
    assert "- first item of the list stands here\n    - nested item below the first one\n3. third and last" in got
    assert "\\[12] A. Author. A title of the work that goes on. And ends here in the year 1999" in got
    assert "multiplicative in the end" in got and "```\nx = 1\n" in got
    assert convert.convert(g.limit(0), pages).count() == 0


def differences(spark, tmp_path, name, texts):
    """Rows in which a query over documents of these texts (doc_id, text) and its SQL differ."""
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, c = registry.QUERIES[name](spark, str(tmp_path)), duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    r = c.execute(registry.ORACLES[name])
    cols, want = [x[0] for x in r.description], r.fetchall()
    return sorted(set(map(repr, want)) ^ {repr(tuple(x)) for x in got.select(*cols).collect()}), len(want)


def test_capitals_are_one_character(spark, tmp_path):
    """Lines that begin with any character of the first planes: sharp s, ligatures, Greek with iota, new letters."""
    every = [chr(n) for n in range(32, 0x11000) if not 0xD800 <= n < 0xE000]
    assert differences(spark, tmp_path, "font_styles", [(4, "\n".join(c + "x" for c in every)), (5, "e\u0301\n\n\u00dfx")]) == ([], len(every) + 3)


def test_short_body_lines_are_no_stamps(spark, tmp_path):
    """A line of three letters at one place of every page, in the column and not in the margin; chapters beyond the 191st."""
    texts = [(d, "\n".join("Un." if i % 2 else f"line {i}" for i in range(60))) for d in (1, 2, 6)] + [(4, "\n".join(["x"] * 6006))]
    assert differences(spark, tmp_path, "running_chrome", texts)[0] == []


def test_ocr_spaces_deals_lines_not_glyphs(spark):
    """Pages are dealt before their lines become glyphs, and sorted once."""
    plan = registry.QUERIES["ocr_spaces"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert plan.count("- Sort [") == 1


def run_of(page, seq, text, x, y, step=6.0, size=10.0, bold=False, mono=False, ink=0.85):
    return page, seq, text, float(x), step, ink * step, float(y), y - 2.0, y + 0.8 * size, float(size), bold, mono


def set_documents(spark):
    """Documents as runs: lists, notes, code, hyphens, columns, chrome; and lines at random, tidy or of uneven runs."""
    import random

    from folioframe.operators import documents as D

    pick, made = random.Random(7), []
    lines = ["- first item of the list stands here", "goes on with an ident-", "ifier and more of it. 1 2 , 3 : = 4 :: x", "2.1 Setup", "see http://a.b/c/", "d/e and so on self - test", "[12] A. Author. A title of", "  set in by blanks", "Key: value", "multi-", "plicative", "end­", "ing here."]
    made.append((1, [run_of(0, 100 * i, t, 72 + 18 * (i == 1), 700 - 12 * i, mono=i > 10) for i, t in enumerate(lines)], 1))
    made.append((2, [run_of(0, 0, "1", 72, 704, 3.0, 6.0), run_of(0, 10, "Note of the page in small", 78, 700), run_of(0, 90, "   ", 72, 660), run_of(0, 95, "", 72, 650), run_of(0, 200, "A title larger than all", 72, 600, 9.0, 16.0), run_of(0, 300, "x中y mono", 72, 550, mono=True)], 1))
    chrome_ = [run_of(p, s, t, x, y) for p in range(6) for s, t, x, y in ((0, "Chapter A" if p < 4 else f"Own {p}x", 72, 760), (50, f"Page {p + 1}", 280, 30), (90, "STAMP", 560, 400 + 0.5 * (p == 5)))]
    columns = [run_of(p, 1000 * (c + 1) + 100 * k, f"{'abc'[p % 3]} column {c} row {k} of text", 72 + 260 * c, 700 - 12 * k - 24 * (k // 4)) for p in range(6) for c in (0, 1) for k in range(8)]
    made.append((3, chrome_ + columns, 6))
    words = ["the", "The", "word", "a", "12", "3.4", "x-", "-y", ":", "::", ":=", ",", "(b)", "www.a.b/", "end.", "I", "", "", "αβ", "data-set-", "{n-", "*", "iv)", "\U0001d400z"]
    for d in range(4, 40):
        runs, tidy, pages = [], d % 3 > 0, pick.randint(1, 5)
        for p in range(pages):
            y = 765.0
            for k in range(pick.randint(1, 16)):
                size = pick.choice([10.0, 10.0, 10.0, 9.0, 16.0, 11.4])
                y -= size * pick.choice([1.2, 1.2, 1.2, 1.8, 3.5, 0.9 if tidy else 0.2]) + pick.random() / 8
                text = pick.choice(["Running head", f"- {p + 1} -"]) if k == 0 and d % 2 else ("so " if tidy else "") + " ".join(pick.choices(words, k=pick.randint(1, 14)))
                runs.append(run_of(p, 1000 * k, text, 72 + pick.random() / 4 + pick.choice([0, 0, 0, 20, 20 if tidy else 480]), y, pick.choice([5.0, 5.5, 4.0 if tidy else 12.0, 2.5]), size, pick.random() < 0.2, False, pick.choice([0.85, 0.5, 1.1])))
        pick.shuffle(runs)
        made.append((d, runs, pages))
    made += [(50, [], 0), (51, [], 1)]
    rows = [(d, runs, [(p, 612.0, 792.0) for p in range(n)]) for d, runs, n in made]
    return spark.createDataFrame(rows, f"doc_id long, runs {D.array_type(D.RUN)}, pages {D.array_type(D.PAGE)}").repartition(2)


def test_documents_as_runs_equal_their_glyphs(spark):
    """Each document's Markdown is that of its glyphs dealt by page, whether it takes the steady way or not."""
    import numpy as np

    from folioframe.operators import documents as D
    from folioframe.plans import convert

    docs = set_documents(spark).cache()
    want = {r.doc_id: (r.markdown, r.blocks) for r in convert.convert(*D.glyph_rows(docs)).collect()}
    assert {r.doc_id: (r.markdown, r.blocks) for r in convert.convert_documents(docs).collect()} == want and len(want) == 39
    steady = 0
    for r in docs.collect():
        runs = sorted((x for x in r.runs if x.text), key=lambda x: x.page)
        arrays = {k: [x[k] for x in runs] if k == "text" else np.array([x[k] for x in runs]) for k in D.RUN}
        if runs:
            (lines,), (body,) = D.steady_lines(arrays, np.zeros(len(runs), int))
            slow, size = D.find_lines(arrays)
            if lines is not None:
                steady += 1
                shown = lambda x: (x.page, x.region, x.line_no, x.text, x.x0, x.x1, x.baseline, x.top, x.bottom, x.size, x.size_max, x.glyphs, x.bold, x.mono, x.head)
                assert body == size and list(map(shown, lines)) == list(map(shown, slow))
    assert 10 < steady < 35


def test_glyphs_to_markdown_deals_no_glyphs(spark):
    """From documents to blocks nothing is dealt, and no glyph is a row."""
    from folioframe.operators import documents as D
    from folioframe.plans import rules

    plan = D.blocks(rules.set_pages(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 1 and plan.index("MapInArrow") < plan.index("Generate explode(array(")


def test_rows_of_single_letters_are_no_columns(spark, tmp_path):
    """Set to the width, their blanks are wider than a gutter; pages of them, a row alone, and rows among prose."""
    letters = " ".join("a" * 14)
    texts = [(396, " ".join([letters] * 17)), (3, " ".join([letters] * 13)), (4, " ".join(["In of the inanin Thonst aonthrein thedtiou anon"] + ["A"] * 200)), (5, " ".join(["F r"] * 120)), (6, " ".join(["word and more"] * 60))]
    assert differences(spark, tmp_path, "glyphs_to_markdown", texts) == ([], 5)


def test_grids_stay_whole(spark):
    """Three columns of rows are a grid, under a larger line too; two columns and code are none."""
    schema = "doc_id long, page long, y double, left double, right double, size double, space boolean, mono boolean, ch string, bottom double, top double"

    def regions(columns, mono=False, head=False):
        rows = [(700.0 - 12 * i, x + 6.0 * k, 10.0, mono) for x in columns for i in range(4) for k in range(6)]
        rows += [(715.0, x + 8.0 * k, 14.0, False) for x in columns for k in range(4)] if head else []
        g = spark.createDataFrame([(1, 0, y, x, x + 5, size, False, fixed, "a", y - 2, y + 8) for y, x, size, fixed in rows], schema)
        return cluster.page_lines(g).select("region").distinct().count()

    assert regions((72.0, 200.0, 330.0)) == 1 and regions((72.0, 200.0, 330.0), head=True) == 1
    assert regions((72.0, 200.0)) == 2 and regions((72.0, 200.0, 330.0), mono=True) == 3
