"""Queries of the layout engine over the test tables, with the same in DuckDB's SQL.

Texts of `documents` stand for pages: a line is a line, 45 of them a page, set in a fixed pitch. As they hold hardly any
markers, numbers or hyphens, `marked` lines get them by (doc_id + line) modulo 12, alike in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chrome, cluster, figures, grid, lines, passes, regions
from ..sources import typeset as T
from . import markdown

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "document_markdown"

CASE = (
    "CASE (doc_id + line) % 12 WHEN 0 THEN concat('- ', t) WHEN 1 THEN concat('12) ', t) WHEN 2 THEN concat('2.1.3 ', t) WHEN 3 THEN concat('Figure 4: ', t) WHEN 4 THEN concat('[17] ', t) WHEN 5 THEN concat('# ', t) "
    "WHEN 6 THEN concat('Page ', cast(page + 1 as {s})) WHEN 7 THEN concat('**', t, '`x` ``y') WHEN 8 THEN concat('A.2 ', t) WHEN 9 THEN concat('Key: ', t) WHEN 10 THEN concat('iv) ', t) ELSE t END"
)
U, L = X.UPPER, X.LOWER
LINES = "l AS (SELECT doc_id, line, line // 45 AS page, t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents))"
MARKED = f"{LINES}, m AS (SELECT doc_id, line, page, {CASE.format(s='varchar')} AS t FROM l)"
SIZE = "CASE WHEN line = 0 THEN 16.0 WHEN (doc_id + line) % 7 = 0 THEN 9.5 ELSE 10.0 END::DOUBLE"
GLYPHS = f"""{LINES}, g AS (SELECT doc_id, page, line, seq, t[seq + 1] AS ch, 72.0::DOUBLE + 5 * seq AS x, 750.0::DOUBLE - 15 * (line % 45) AS y, 72.0::DOUBLE + 5 * seq AS "left", 76.5::DOUBLE + 5 * seq AS "right",
    748.0::DOUBLE - 15 * (line % 45) AS bottom, 758.0::DOUBLE - 15 * (line % 45) AS top, {SIZE} AS size, (doc_id + line) % 5 = 0 AS bold, t[seq + 1] = ' ' AS space FROM (SELECT *, unnest(range(length(t))) AS seq FROM l))"""
SIG = f"regexp_replace(translate(replace(t, ' ', ''), '{U}', '{L}'), '#?[0-9]+', '#', 'g')"


def docs(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def plain(spark, d):
    return T.text_lines(docs(spark, d).select("doc_id", "text"))


def marked(spark, d):
    return plain(spark, d).select("doc_id", "line", "page", F.expr(CASE.format(s="string")).alias("t"))


def glyphs(spark, d):
    return T.typeset(plain(spark, d))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {MARKED} SELECT doc_id, line, {SIG} AS sig, translate(replace(t, ' ', ''), '{U}', '{L}') AS stamp_sig, {SIG} || '|' AS block_sig FROM m")
def line_signatures(spark, d):
    t = F.col("t")
    return marked(spark, d).select("doc_id", "line", X.segment_signature(t).alias("sig"), X.segment_signature(t, False).alias("stamp_sig"), X.block_signature(F.array(t)).alias("block_sig"))


@query(
    f"""WITH {MARKED}, k AS (SELECT *, CASE WHEN regexp_matches(t, '^[{X.BULLETS}{X.DASHES[1:]}-] ') THEN 'bullet' WHEN regexp_matches(t, '^[0-9]{{1,3}}[.)] +') THEN 'ordered' WHEN regexp_matches(t, '^([A-Za-z]|[ivxlcdmIVXLCDM]{{1,6}})[)] ') THEN 'lettered' ELSE '' END AS marker FROM m)
    SELECT doc_id, line, marker, regexp_replace(t, '^(?:[{X.BULLETS}{X.DASHES[1:]}-] +|[0-9]{{1,3}}[.)] +)', '') AS content FROM k WHERE marker <> ''"""
)
def list_items(spark, d):
    t = F.col("t")
    return marked(spark, d).select("doc_id", "line", X.list_marker(t).alias("marker"), X.strip_marker(t).alias("content")).where("marker <> ''")


@query(
    f"""WITH {MARKED}, k AS (SELECT *, regexp_extract(t, '^ *([0-9]+(?:[.][0-9]+)*)', 1) AS num, length(regexp_extract(t, '^( *[0-9]+(?:[.][0-9]+)*)', 1)) AS n FROM m)
    SELECT doc_id, line, CASE WHEN num <> '' AND substring(t, n + 1, 1) IN (' ', '.', '') THEN len(string_split(num, '.')) ELSE 0 END::BIGINT AS depth, regexp_extract(t, '^ *((?:[A-Z][.])?[0-9]+(?:[.][0-9]+)*) +[^ ]', 1) AS path FROM k"""
)
def section_numbers(spark, d):
    t = F.col("t")
    return marked(spark, d).select("doc_id", "line", X.heading_depth(t).cast("long").alias("depth"), X.section_path(t).alias("path"))


@query(
    f"""WITH {MARKED}, k AS (SELECT *, ltrim(string_split(t, ':')[1]) AS head, len(string_split(t, ':')) > 1 AS colon, substring(t, length(string_split(t, ':')[1]) + 2, 1) AS nxt FROM m)
    SELECT doc_id, line, trim(regexp_replace(translate(t, '{U}', '{L}'), '[^a-z0-9]+', ' ', 'g')) AS key,
    CASE WHEN colon AND nxt IN ('', ' ') AND NOT regexp_matches(head, '[^A-Za-z0-9 _/()&,{X.GREEK}-]') AND regexp_matches(head, '[A-Za-z{X.GREEK}]') AND length(regexp_replace(head, '[{X.GREEK}]', '', 'g')) <= 40 THEN rtrim(regexp_replace(head, '[{X.GREEK}]', '', 'g')) ELSE '' END AS label,
    regexp_matches(t, '^ *[[][0-9]+[]]') AS citation, regexp_matches(t, '^ *(Figure|Table) [0-9]') AS caption FROM k"""
)
def line_predicates(spark, d):
    t = F.col("t")
    return marked(spark, d).select("doc_id", "line", X.heading_key(t).alias("key"), X.metadata_label(t).alias("label"), X.is_citation_lead(t).alias("citation"), X.is_caption(t).alias("caption"))


ESC = r"regexp_replace({t}, '([\\`*_\[<|~$])', '\\\1', 'g')"
START = r"regexp_replace(regexp_replace(regexp_replace({t}, '^([>+-])', '\\\1'), '^(#+)( |$)', '\\\1\2'), '^([0-9]{{1,9}})([.)])( |$)', '\1\\\2\3')"


@query(f"WITH {MARKED} SELECT doc_id, line, {START.format(t=ESC.format(t='t'))} AS md FROM m")
def md_escape(spark, d):
    return marked(spark, d).select("doc_id", "line", X.escape_line_start(X.escape_inline(F.col("t"))).alias("md"))


@query(
    f"""WITH {MARKED}, k AS (SELECT *, repeat('`', coalesce(list_max(list_transform(regexp_extract_all(t, '(`+)', 1), lambda x: length(x))), 0)::INTEGER + 1) AS mark, CASE WHEN regexp_matches(t, '^[` ]|[` ]$') THEN ' ' ELSE '' END AS pad FROM m)
    SELECT doc_id, line, mark || pad || t || pad || mark AS md FROM k"""
)
def code_spans(spark, d):
    return marked(spark, d).select("doc_id", "line", X.code_span(F.col("t")).alias("md"))


@query(
    "SELECT n.n_regionkey::BIGINT AS region, '| ' || concat_ws(' | ', 'nation', 'region') || ' |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(trim(n_name), '_', chr(92) || '_') || ' | ' || trim(r_name) || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation n JOIN region r ON n_regionkey = r_regionkey GROUP BY 1"
)
def gfm_tables(spark, d):
    j = docs(spark, d, "nation").join(docs(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = j.select(F.col("n_regionkey").cast("long").alias("region"), "n_nationkey", X.gfm_row([X.gfm_cell(F.col("n_name")), X.gfm_cell(F.col("r_name"))]).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]), "\n")
    return rows.groupBy("region").agg(F.concat(X.gfm_row([F.lit("nation"), F.lit("region")]), F.lit("\n| --- | --- |\n"), body).alias("md"))


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'A "' || lang || chr(92) END AS title, source, n_chars // 2000 + 1 AS pages FROM documents), q AS (SELECT doc_id, source, pages, title, replace(replace(title, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') AS esc FROM d)
    SELECT doc_id, '---' || chr(10) || CASE WHEN title <> '' THEN 'title: "' || esc || '"' || chr(10) ELSE '' END || 'source: "' || source || '"' || chr(10) || 'pages: ' || pages || chr(10) || '---' || chr(10) AS front FROM q"""
)
def front_matter(spark, d):
    x = docs(spark, d)
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit('A "'), "lang", F.lit("\\")))
    return markdown.front_matter(x.select("doc_id", title.alias("title"), F.lit("").alias("author"), "source", (F.floor(F.col("n_chars") / 2000) + 1).alias("pages")))


KIND = "CASE WHEN depth > 0 THEN 'heading' WHEN marker <> '' THEN 'list' WHEN regexp_matches(t, '^ *(Figure|Table) [0-9]') THEN 'caption' ELSE 'paragraph' END"


@query(
    f"""WITH {MARKED}, a AS (SELECT *, regexp_extract(t, '^ *([0-9]+(?:[.][0-9]+)*)', 1) AS num, length(regexp_extract(t, '^( *[0-9]+(?:[.][0-9]+)*)', 1)) AS n,
    CASE WHEN regexp_matches(t, '^[{X.BULLETS}{X.DASHES[1:]}-] ') THEN 'bullet' WHEN regexp_matches(t, '^[0-9]{{1,3}}[.)] +') THEN 'ordered' WHEN regexp_matches(t, '^([A-Za-z]|[ivxlcdmIVXLCDM]{{1,6}})[)] ') THEN 'lettered' ELSE '' END AS marker FROM m WHERE trim(t) <> ''),
    b AS (SELECT *, CASE WHEN num <> '' AND substring(t, n + 1, 1) IN (' ', '.', '') THEN len(string_split(num, '.')) ELSE 0 END AS depth FROM a), c AS (SELECT *, {KIND} AS kind, trim(regexp_replace(t, '^(?:[{X.BULLETS}{X.DASHES[1:]}-] +|[0-9]{{1,3}}[.)] +)', '')) AS content FROM b),
    e AS (SELECT doc_id, line, kind, CASE kind WHEN 'heading' THEN repeat('#', least(depth, 6)::INTEGER) || ' ' || {ESC.format(t="trim(t)")} WHEN 'list' THEN (CASE WHEN marker = 'ordered' THEN regexp_extract(t, '^([0-9]{{1,3}})', 1) || '. ' ELSE '- ' END) || {START.format(t=ESC.format(t="content"))} ELSE {START.format(t=ESC.format(t="trim(t)"))} END AS part FROM c),
    f AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM e WHERE part <> '')
    SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN kind = 'list' AND before = 'list' THEN chr(10) ELSE chr(10) || chr(10) END || part, '' ORDER BY line) || chr(10) AS markdown, count(*) AS blocks FROM f GROUP BY doc_id"""
)
def document_markdown(spark, d):
    return markdown.to_markdown(marked(spark, d))


WORDS = f"list_slice(w, 2, len(w) - 1)"
VOCAB = f"v AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS word FROM (SELECT doc_id, regexp_extract_all(translate(t, '{U}', '{L}'), '([a-z]+)', 1) AS w FROM {{src}}) WHERE len(w) > 2)"


@query(f"WITH {LINES}, {VOCAB.format(src='l')} SELECT doc_id, word FROM v")
def doc_vocabulary(spark, d):
    return markdown.vocabulary(plain(spark, d))


HYPHENED = "CASE WHEN (doc_id + line) % 3 = 0 THEN concat(CASE WHEN line % 5 = 0 THEN 'multi' WHEN line % 5 = 1 THEN 'It is' ELSE regexp_extract(t, '^(.*[a-z])[^a-zA-Z]*$', 1) END, '-') WHEN (doc_id + line) % 3 = 1 THEN concat(CASE WHEN line % 4 = 1 THEN 'to-' ELSE '' END, regexp_extract(t, '([a-z].*)$', 1)) ELSE t END"


@query(
    f"""WITH {LINES}, h AS (SELECT doc_id, line, {HYPHENED} AS t FROM l), {VOCAB.format(src='l')}, p AS (SELECT doc_id, line, t, lead(t) OVER (PARTITION BY doc_id ORDER BY line) AS below FROM h),
    q AS (SELECT doc_id, line, below, regexp_extract(translate(t, '{U}', '{L}'), '([a-z]+)-$', 1) AS a, regexp_extract(translate(below, '{U}', '{L}'), '^([a-z]+)', 1) AS b FROM p WHERE regexp_matches(t, '[a-zA-Z]-$') AND regexp_matches(below, '^[a-z]'))
    SELECT doc_id, line, a || b AS joined, length(a) >= 4 AND (length(b) >= 4 OR regexp_matches(below, '^[A-Za-z]+[-‐][A-Za-z]')) AND EXISTS (SELECT 1 FROM v WHERE v.doc_id = q.doc_id AND word = a) AND NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = q.doc_id AND word = a || b)
    AND a NOT IN ('multi', 'inter', 'intra', 'trans', 'super', 'pseudo', 'quasi', 'semi', 'anti', 'counter', 'hyper', 'hypo', 'poly', 'mono', 'proto', 'ultra', 'micro', 'macro') AS kept FROM q"""
)
def hyphen_joins(spark, d):
    x = plain(spark, d)
    return markdown.hyphen_joins(x.withColumn("t", F.expr(HYPHENED)), markdown.interior_words(x))


URL = "CASE line % 9 WHEN 0 THEN 'see http://example.org/a' WHEN 1 THEN concat('bc/', t) WHEN 2 THEN 'or (https://example.org/b.' WHEN 4 THEN concat('www.example.org/x', substring('/_a,', 1 + cast(line % 4 as {i}), 1)) WHEN 5 THEN concat(CASE WHEN doc_id % 2 = 0 THEN 'Next_' ELSE '?q=' END, t) WHEN 6 THEN 'x(ftp://a.b/c-' WHEN 7 THEN CASE WHEN doc_id % 3 = 0 THEN 'http://new.org' ELSE t END ELSE t END"


@query(
    f"""WITH {LINES}, h AS (SELECT doc_id, line, {URL.format(i='bigint')} AS t FROM l), p AS (SELECT doc_id, line, list_extract(string_split(rtrim(t), ' '), -1) AS w, lead(t) OVER (PARTITION BY doc_id ORDER BY line) AS nx FROM h)
    SELECT doc_id, line FROM p WHERE (contains(w, '://') OR w[1:4] = 'www.') AND NOT regexp_matches(nx, '^(www[.]|[A-Za-z]{{1,8}}://)') AND w[-1:] NOT IN ('.', '!', '?', ',', ':', ';', ')')
    AND nx[1:1] SIMILAR TO '[A-Za-z0-9/.~#?=&%+_-]' AND (nx[1:1] NOT SIMILAR TO '[A-Z]' OR w[-1:] IN ('/', '-', '_', '.', '=', '?', '&', '#', '%', '+', '~'))"""
)
def url_wraps(spark, d):
    from pyspark.sql import Window

    x = plain(spark, d).withColumn("t", F.expr(URL.format(i="int"))).withColumn("below", F.lead("t").over(Window.partitionBy("doc_id").orderBy("line")))
    return x.where(X.url_wraps(F.col("t"), F.col("below"))).select("doc_id", "line")


RUNON = "CASE (doc_id + line) % 5 WHEN 0 THEN concat(lower(substring(t, 1, 1)), substring(t, 2)) WHEN 1 THEN concat('Name', t) WHEN 2 THEN regexp_replace(t, '[.]$', '') WHEN 3 THEN regexp_replace(t, '.$', '::') ELSE t END"


@query(
    f"""WITH {LINES}, b AS (SELECT doc_id, line AS ord, line // 2 AS page, {RUNON} AS text, CASE WHEN line % 7 = 3 THEN 20.0 WHEN line % 7 = 5 THEN 10.5 ELSE 10.0 END::DOUBLE AS size FROM l),
    p AS (SELECT *, lag(text) OVER w AS pt, lag(page) OVER w AS pp, lag(size) OVER w AS ps FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    j AS (SELECT *, coalesce(page = pp + 1 AND abs(size - ps) <= 0.08 * greatest(size, ps) AND CASE WHEN pt[-2:] = '::' THEN regexp_matches(text, '^[A-Za-z0-9_]') ELSE pt[-1:] NOT IN ('.', '!', '?', ':', ';', '’', '”', '"', chr(39), ')', ']') AND (pt[-1:] IN ('-', chr(173)) OR regexp_matches(text, '^[a-z]')) END, false) AS runs FROM p),
    c AS (SELECT *, sum(CASE WHEN runs THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS chain FROM j)
    SELECT doc_id, min(ord) AS ord, max(page) AS page, count(*) AS parts, string_agg(text, ' ' ORDER BY ord) AS text FROM c GROUP BY doc_id, chain"""
)
def merge_pages(spark, d):
    size = F.when(F.col("line") % 7 == 3, 20.0).when(F.col("line") % 7 == 5, 10.5).otherwise(10.0)
    return passes.merge_pages(plain(spark, d).select("doc_id", F.col("line").alias("ord"), F.floor(F.col("line") / 2).alias("page"), F.expr(RUNON).alias("text"), size.alias("size")))


@query(
    f"WITH {LINES}, b AS (SELECT *, (doc_id + line) % 4 = 1 AS note FROM l) SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY note, line) AS ord, CASE WHEN note THEN max(page) OVER (PARTITION BY doc_id) ELSE page END AS page FROM b"
)
def relocate_footnotes(spark, d):
    b = plain(spark, d).select("doc_id", "line", F.col("line").alias("ord"), "page", ((F.col("doc_id") + F.col("line")) % 4 == 1).alias("note"))
    return passes.relocate_footnotes(b).select("doc_id", "line", "ord", "page")


@query(f'WITH {GLYPHS} SELECT doc_id, line, count(*) AS glyphs, sum(seq)::BIGINT AS seqs, min(x) AS x0, max("right") AS x1, min(bottom) AS bottom, max(top) AS top, sum(space::INT)::BIGINT AS spaces FROM g GROUP BY ALL')
def typeset_glyphs(spark, d):
    return glyphs(spark, d).groupBy("doc_id", "line").agg(F.count("*").alias("glyphs"), F.sum("seq").alias("seqs"), F.min("x").alias("x0"), F.max("right").alias("x1"), F.min("bottom").alias("bottom"), F.max("top").alias("top"), F.sum(F.col("space").cast("int")).alias("spaces"))


BODY = "body AS (SELECT doc_id, coalesce(first(s ORDER BY n DESC, s) FILTER (s IS NOT NULL), 11.0) AS body_size FROM (SELECT doc_id, CASE WHEN NOT space THEN round(size * 4) / 4 END AS s, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)"


@query(f"WITH {GLYPHS}, {BODY} SELECT doc_id, body_size::DOUBLE AS body_size FROM body")
def body_size(spark, d):
    return lines.body_size(glyphs(spark, d))


@query(
    f"""WITH {GLYPHS}, o AS (SELECT doc_id, page, line, count(*) AS glyphs, greatest(median(size), 1.0) AS size, max(size) AS largest, min("left") AS x0, max("right") AS x1, median(y) AS baseline FROM g WHERE NOT space GROUP BY ALL)
    SELECT doc_id, page, line, glyphs, size, x0, x1, CASE WHEN largest > 1.8 * size THEN size ELSE largest END AS size_max, baseline FROM o"""
)
def line_stats(spark, d):
    return lines.line_stats(glyphs(spark, d))


# glyphs set again with gaps: after every fourth letter 3 points, after every thirtieth 20
GAPPED = '"left" + 3 * (seq // 4) + 20 * (seq // 30)'


def _gapped(spark, d):
    shift = 3 * F.floor(F.col("seq") / 4) + 20 * F.floor(F.col("seq") / 30)
    return glyphs(spark, d).withColumn("left", F.col("left") + shift).withColumn("right", F.col("right") + shift)


GAPS = f"""{GLYPHS}, gg AS (SELECT * REPLACE ({GAPPED} AS "left", "right" + 3 * (seq // 4) + 20 * (seq // 30) AS "right") FROM g), gap AS (SELECT *, "left" - lag("right") OVER w AS gap, seq - lag(seq) OVER w > 1 AS spaced FROM gg WHERE NOT space WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY "left", seq))"""


@query(
    f"""WITH {GAPS}, s AS (SELECT *, lag(gap) OVER w AS below, row_number() OVER w AS rank, count(*) OVER (PARTITION BY doc_id, page, line) AS n FROM gap WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY gap)),
    j AS (SELECT *, CASE WHEN below <= 6.0 AND gap > below THEN gap - below END AS jump, (gap + below) / 2 AS mid FROM s),
    b AS (SELECT doc_id, page, line, max(n) AS n, first(jump ORDER BY coalesce(jump, -1) DESC, rank) AS jump, first(mid ORDER BY coalesce(jump, -1) DESC, rank) AS mid FROM j GROUP BY ALL)
    SELECT doc_id, page, line, least(greatest(CASE WHEN n >= 3 AND jump >= 0.11 * 10.0::DOUBLE THEN mid ELSE 0.28 * 10.0::DOUBLE END, 0.18 * 10.0::DOUBLE), 0.9 * 10.0::DOUBLE)::DOUBLE AS word_gap FROM b"""
)
def word_gap(spark, d):
    return lines.word_gap(lines.gaps(_gapped(spark, d)), 10.0)


@query(
    f"""WITH {GAPS}, s AS (SELECT *, coalesce(gap > greatest(1.4 * size, 10.0), false) AS wide FROM gap), r AS (SELECT *, sum(wide::INT) OVER (PARTITION BY doc_id, page, line ORDER BY "left", seq ROWS UNBOUNDED PRECEDING) AS segment, CASE WHEN coalesce(spaced, false) AND NOT wide THEN ' ' ELSE '' END || ch AS piece FROM s)
    SELECT doc_id, page, line, segment::BIGINT AS segment, min("left") AS first, max("right") AS last, string_agg(piece, '' ORDER BY "left", seq) AS text FROM r GROUP BY ALL"""
)
def line_segments(spark, d):
    return lines.segments(lines.gaps(_gapped(spark, d)))


@query(f"""WITH {GLYPHS}, s AS (SELECT * REPLACE (seq % 9 < 3 AS bold) FROM g WHERE NOT space), n AS (SELECT *, coalesce(bold <> lag(bold) OVER w, true) AS new FROM s WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY "left", seq)),
    r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, page, line ORDER BY "left", seq ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT doc_id, page, line, run::BIGINT AS run, first(bold) AS bold, count(*) AS glyphs FROM r GROUP BY ALL""")
def style_runs(spark, d):
    return lines.style_runs(lines.gaps(glyphs(spark, d).withColumn("bold", F.col("seq") % 9 < 3)))


SPANS = "sp AS (SELECT doc_id, page, (line * 37 % 400)::DOUBLE AS lo, (line * 37 % 400 + length(t) % 60 + 1)::DOUBLE AS hi FROM l)"


def _spans(spark, d):
    lo = F.col("line") * 37 % 400
    return plain(spark, d).select("doc_id", "page", lo.cast("double").alias("lo"), (lo + F.length("t") % 60 + 1).cast("double").alias("hi"))


@query(f"WITH {LINES}, {SPANS}, r AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, page ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp) SELECT doc_id, page, (lo + reach) / 2 AS cut FROM r WHERE lo - reach > 14")
def gap_cuts(spark, d):
    return lines.gap_cuts(_spans(spark, d), ["doc_id", "page"], 14.0)


@query(
    f"""WITH {LINES}, {SPANS}, e AS (SELECT doc_id, page, lo AS z, 1 AS d FROM sp UNION ALL SELECT doc_id, page, hi, -1 FROM sp), s AS (SELECT doc_id, page, z, sum(d) AS d, count(*) FILTER (d > 0) AS opens FROM e GROUP BY ALL),
    r AS (SELECT doc_id, page, z, sum(d) OVER w AS cover, sum(opens) OVER w AS begun, sum(opens) OVER (PARTITION BY doc_id, page) AS n, lead(z) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY doc_id, page ORDER BY z)),
    i AS (SELECT *, cover <= 1 AS low, sum((cover > 1)::INT) OVER (PARTITION BY doc_id, page ORDER BY z) AS isle FROM r WHERE nxt IS NOT NULL),
    o AS (SELECT doc_id, page, isle, min(z) AS lo, max(nxt) AS hi, min(n) AS n, max(begun) AS begun, max(cover) AS cover FROM i WHERE low GROUP BY ALL)
    SELECT doc_id, page, (lo + hi) / 2 AS cut FROM o WHERE hi - lo >= 14 AND n >= 4 AND begun - cover >= greatest(3.0, n / 25) AND n - begun >= greatest(3.0, n / 25)"""
)
def coverage_cuts(spark, d):
    return lines.coverage_cuts(_spans(spark, d), ["doc_id", "page"], 1, 14.0)


@query(f'WITH {GLYPHS}, o AS (SELECT doc_id, page, line, min(bottom) AS low, max(top) AS high, min("left") AS x0, max(y) AS y FROM g GROUP BY ALL) SELECT doc_id, page, line, CASE WHEN low > 0.88 * 792 THEN 1 WHEN high < 0.12 * 792 THEN 2 ELSE 0 END AS band, round(x0 / 4)::BIGINT AS qx, round(y / 4)::BIGINT AS qy FROM o')
def bands(spark, d):
    return chrome.bands(glyphs(spark, d))


TIERS = f"b AS (SELECT doc_id, page, line AS ord, t AS text, {SIZE} + CASE WHEN line % 11 = 3 THEN 4 WHEN line % 11 = 5 THEN 1.24 WHEN line % 11 = 7 THEN 1.5 ELSE 0 END AS size FROM l)"


@query(
    f"""WITH {LINES}, {TIERS}, r AS (SELECT *, round(size * 2) / 2 AS tier, 10.0 AS body FROM b), tot AS (SELECT doc_id, sum(length(text)) AS total FROM r GROUP BY 1),
    k AS (SELECT doc_id, tier, sum(length(text)) AS chars FROM r WHERE size >= 1.12 * body AND length(text) BETWEEN 1 AND 220 GROUP BY ALL)
    SELECT doc_id, tier, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY tier DESC), 6)::BIGINT AS level FROM k JOIN tot USING (doc_id) WHERE chars <= 0.3 * total"""
)
def heading_tiers(spark, d):
    x = plain(spark, d)
    size = T.line_size() + F.when(F.col("line") % 11 == 3, 4.0).when(F.col("line") % 11 == 5, 1.24).when(F.col("line") % 11 == 7, 1.5).otherwise(0.0)
    b = x.select("doc_id", "page", F.col("line").alias("ord"), F.col("t").alias("text"), size.alias("size"))
    return passes.heading_tiers(b, x.select("doc_id", F.lit(10.0).alias("body_size")).distinct())


@query(
    f"""WITH {MARKED} SELECT doc_id, line, regexp_matches(t, '[.,;:!?]$') OR regexp_matches(t, '^ *[[][0-9]+[]]') OR regexp_matches(t, '^ *(Figure|Table) [0-9]') OR count(*) OVER (PARTITION BY doc_id, trim(regexp_replace(translate(t, '{U}', '{L}'), '[^a-z0-9]+', ' ', 'g'))) >= 3 AS veto FROM m"""
)
def heading_vetoes(spark, d):
    return passes.vetoed(marked(spark, d).withColumn("text", F.col("t"))).select("doc_id", "line", "veto")


IMAGES = "im AS (SELECT doc_id, img_no, img_no % 2 AS page, 700.0::DOUBLE - 170 * img_no AS y_mid FROM (SELECT doc_id, unnest(range(doc_id % 4)) AS img_no FROM documents))"


@query(
    f"""WITH {LINES}, b AS (SELECT doc_id, page AS bp, line AS ord, 758.0::DOUBLE - 15 * (line % 45) AS y_top FROM l), {IMAGES}, j AS (SELECT im.*, bp, ord, y_top FROM im LEFT JOIN b ON im.doc_id = b.doc_id AND bp >= page)
    SELECT doc_id, img_no, coalesce(first(ord ORDER BY y_top DESC, ord) FILTER (bp = page AND y_top < y_mid), min(ord) FILTER (bp > page)) AS ord FROM j GROUP BY doc_id, img_no"""
)
def image_placement(spark, d):
    b = plain(spark, d).select("doc_id", "page", F.col("line").alias("ord"), (F.lit(758.0) - (F.col("line") % 45) * 15.0).alias("y_top"))
    im = docs(spark, d).select("doc_id", F.explode(F.expr("filter(sequence(0L, doc_id % 4), i -> i < doc_id % 4)")).alias("img_no"))
    im = im.select("doc_id", "img_no", (F.col("img_no") % 2).alias("page"), (F.lit(700.0) - F.col("img_no") * 170.0).alias("y_mid"))
    return passes.place_images(b, im)


@query(
    f"""WITH {LINES}, im AS (SELECT doc_id, page, line AS obj, md5(t) AS pixels FROM l), f AS (SELECT *, first_value(page) OVER w AS fp, first_value(obj) OVER w AS fo FROM im WINDOW w AS (PARTITION BY doc_id, pixels ORDER BY page, obj))
    SELECT doc_id, page, obj, dense_rank() OVER (PARTITION BY doc_id ORDER BY fp, fo)::BIGINT AS number, 'image_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY fp, fo) || '.png' AS path FROM f"""
)
def image_dedupe(spark, d):
    im = plain(spark, d).select("doc_id", "page", F.col("line").alias("obj"), F.md5("t").alias("pixels"))
    return passes.dedupe_images(im).select("doc_id", "page", "obj", "number", "path")


@query(
    f"""WITH {LINES}, r AS (SELECT doc_id, page, (line * 29 % 200)::DOUBLE / 2 AS pos, (line * 53 % 300)::DOUBLE AS lo, (line * 53 % 300 + length(t) % 40)::DOUBLE AS hi FROM l),
    c AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, page ORDER BY pos, lo ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id, page ORDER BY pos, lo) > 2.5, true) AS new FROM r)),
    p AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY doc_id, page, cluster ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3.5, true) AS apart FROM c),
    q AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id, page, cluster ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS piece FROM p), a AS (SELECT doc_id, page, cluster, avg(pos) AS mid FROM q GROUP BY ALL)
    SELECT doc_id, page, cluster::BIGINT AS cluster, round(mid, 6) AS "at", min(lo) AS lo, max(hi) AS hi FROM q JOIN a USING (doc_id, page, cluster) GROUP BY doc_id, page, cluster, mid, piece"""
)
def grid_lines(spark, d):
    lo = F.col("line") * 53 % 300
    r = plain(spark, d).select("doc_id", "page", ((F.col("line") * 29 % 200).cast("double") / 2).alias("pos"), lo.cast("double").alias("lo"), (lo + F.length("t") % 40).cast("double").alias("hi"))
    return grid.grid_lines(r, ["doc_id", "page"]).withColumn("at", F.round("at", 6))


CELLS = "SELECT r.range AS \"row\", c.range AS col, 72.0 + 100 * c.range AS x0, 172.0 + 100 * c.range AS x1, 600.0 - 50 * r.range AS y0, 650.0 - 50 * r.range AS y1 FROM range(3) r, range(3) c"


@query(
    f"""WITH {GLYPHS}, cells AS ({CELLS}), j AS (SELECT doc_id, page, line, seq, c.row, c.col FROM g JOIN cells c ON ("left" + "right") / 2 >= x0 AND ("left" + "right") / 2 < x1 AND (bottom + top) / 2 >= y0 AND (bottom + top) / 2 < y1)
    SELECT doc_id, page, "row", col, count(*) AS glyphs FROM j GROUP BY ALL"""
)
def glyph_cells(spark, d):
    g = glyphs(spark, d)
    c = g.select("doc_id", "page").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("id")).select("doc_id", "page", F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 3).cast("long").alias("col"))
    c = c.select("*", (72.0 + F.col("col") * 100).alias("c_x0"), (172.0 + F.col("col") * 100).alias("c_x1"), (600.0 - F.col("row") * 50).alias("c_y0"), (650.0 - F.col("row") * 50).alias("c_y1"))
    return grid.glyph_cells(g, c, ["doc_id", "page"]).groupBy("doc_id", "page", "row", "col").agg(F.count("*").alias("glyphs"))


SPEC = "CASE doc_id % 8 WHEN 0 THEN '1-3,7' WHEN 1 THEN '2' WHEN 2 THEN '5-4,9' WHEN 3 THEN 'x,4-6' WHEN 4 THEN ',3,,5-6,' WHEN 5 THEN '0,2' WHEN 6 THEN '2-100009' ELSE '7a' END"


@query(
    f"""WITH s AS (SELECT DISTINCT {SPEC} AS spec FROM documents), p AS (SELECT spec, unnest(list_filter(string_split(spec, ','), lambda x: x <> '')) AS part FROM s),
    q AS (SELECT spec, try_cast(string_split(part, '-')[1] AS BIGINT) AS a, try_cast(string_split(part, '-')[-1] AS BIGINT) AS b, regexp_full_match(part, '[0-9]{{1,8}}(-[0-9]{{1,8}})?') AS form FROM p),
    g AS (SELECT spec FROM q GROUP BY spec HAVING bool_and(form AND coalesce(a >= 1 AND b >= a AND b - a < 100000 AND b <= 10000000, false)))
    SELECT DISTINCT spec, unnest(range(a - 1, b)) AS page FROM q SEMI JOIN g USING (spec)"""
)
def page_spec(spark, d):
    return T.page_spec(docs(spark, d).select(F.expr(SPEC).alias("spec")).distinct())


@query(f"""WITH {LINES}, {VOCAB.format(src='l')} SELECT doc_id, line, page, t FROM l WHERE page IN (0, 2)""")
def page_filter(spark, d):
    return T.select_pages(plain(spark, d), T.page_spec(spark.createDataFrame([("1,3",)], "spec string"))).select("doc_id", "line", "page", "t")


@query(f"""WITH {GLYPHS}, em AS (SELECT doc_id, page, median(size) AS em FROM g WHERE NOT space GROUP BY ALL), y AS (SELECT DISTINCT doc_id, page, y FROM g WHERE NOT space), s AS (SELECT doc_id, page, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS step FROM y)
    SELECT doc_id, page, count(*) FILTER (step IS NULL OR step > 0.5 * em) AS lines FROM s JOIN em USING (doc_id, page) GROUP BY ALL""")
def line_estimate(spark, d):
    return lines.line_estimate(glyphs(spark, d))


@query(f"""WITH {GLYPHS} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) - 1 AS line_no, count(*) AS glyphs, y AS baseline FROM g GROUP BY doc_id, page, y HAVING bool_or(NOT space)""")
def clustered_lines(spark, d):
    found = cluster.page_lines(glyphs(spark, d).select("doc_id", "page", "y", "left", "right", "bottom", "top", "size", "space"), columns=False)
    return found.where("line_no >= 0").groupBy("doc_id", "page", "line_no").agg(F.count("*").alias("glyphs"), F.min("y").alias("baseline"))


FIGURES = "fig AS (SELECT DISTINCT doc_id, page, 100.0::DOUBLE AS f_x0, 300.0::DOUBLE AS f_y0, 400.0::DOUBLE AS f_x1, 420.0::DOUBLE AS f_y1, doc_id % 2 = 0 AS diagram FROM l)"
LABELLED = "lg AS (SELECT * REPLACE (CASE WHEN seq % 7 = 0 THEN 3.0 ELSE size END AS size) FROM g)"
MID = '("left" + "right") / 2 BETWEEN f_x0 + {i} AND f_x1 - {i} AND (bottom + top) / 2 BETWEEN f_y0 + {i} AND f_y1 - {i}'


def _labelled(spark, d):
    return glyphs(spark, d).withColumn("size", F.when(F.col("seq") % 7 == 0, 3.0).otherwise(F.col("size")))


def _figures(spark, d):
    boxes = [F.lit(v).alias(n) for n, v in (("f_x0", 100.0), ("f_y0", 300.0), ("f_x1", 400.0), ("f_y1", 420.0))]
    return plain(spark, d).select("doc_id", "page").distinct().select("*", *boxes, (F.col("doc_id") % 2 == 0).alias("diagram"))


@query(f"""WITH {GLYPHS}, {FIGURES}, {LABELLED}, n AS (SELECT doc_id, page, count(*) AS n FROM lg JOIN fig USING (doc_id, page) WHERE NOT space AND size >= 4 AND top - bottom <= 2 * size AND ("left" + "right") / 2 > 140.0 AND ("left" + "right") / 2 < 360.0 AND (bottom + top) / 2 > 318.0 AND (bottom + top) / 2 < 402.0 GROUP BY ALL)
    SELECT doc_id, page, diagram, coalesce(n, 0) AS prose, coalesce(n, 0) > 25 AS holds_prose FROM fig LEFT JOIN n USING (doc_id, page)""")
def figure_prose(spark, d):
    return figures.prose_regions(_figures(spark, d), _labelled(spark, d)).select("doc_id", "page", "diagram", "prose", "holds_prose")


@query(f"""WITH {GLYPHS}, {FIGURES}, {LABELLED} SELECT doc_id, page, line, count(*) AS glyphs FROM lg JOIN fig USING (doc_id, page) WHERE NOT ({MID.format(i=0)} AND (diagram OR size < 4 OR top - bottom > 2 * size)) GROUP BY ALL""")
def figure_labels(spark, d):
    return figures.suppress_labels(_labelled(spark, d), _figures(spark, d)).groupBy("doc_id", "page", "line").agg(F.count("*").alias("glyphs"))


@query(
    f"""WITH {MARKED}, b AS (SELECT doc_id, line AS ord, page, t, {SIZE} AS size, regexp_matches(t, '^ *[[][0-9]+[]]') AS lead, lag(t) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM m),
    e AS (SELECT *, sum(lead::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS entry FROM b), h AS (SELECT *, first_value(page) OVER w AS hp, first_value(size) OVER w AS hs, first_value(ord) OVER w AS ho FROM e WINDOW w AS (PARTITION BY doc_id, entry ORDER BY ord)),
    o AS (SELECT *, CASE WHEN lead OR coalesce(rtrim(before) <> '' AND rtrim(before)[-1:] NOT IN ('.', '!', '?') AND page BETWEEN hp AND hp + 1 AND abs(size - hs) <= 0.15 * greatest(size, hs), false) THEN 0 ELSE 1 END AS off FROM h),
    c AS (SELECT *, CASE WHEN entry = 0 OR sum(off) OVER (PARTITION BY doc_id, entry ORDER BY ord) > 0 THEN ord ELSE ho END AS chain FROM o)
    SELECT doc_id, chain AS ord, min(page) AS page, count(*) AS parts, string_agg(t, ' ' ORDER BY ord) AS text FROM c GROUP BY doc_id, chain"""
)
def merge_references(spark, d):
    return passes.merge_references(marked(spark, d).select("doc_id", F.col("line").alias("ord"), "page", T.line_size().alias("size"), F.col("t").alias("text")))


BOXES = f"""{GLYPHS}, bx AS (SELECT doc_id, page, line, count(*) AS glyphs, min("left") + 7 * (line % 4) AS x0, max("right") + 7 * (line % 4) AS x1, median(y) AS baseline, greatest(median(size), 1.0)::DOUBLE AS size FROM g WHERE NOT space GROUP BY doc_id, page, line)"""


def _boxes(spark, d):
    shift = 7 * (F.col("line") % 4)
    return lines.line_stats(glyphs(spark, d)).withColumn("x0", F.col("x0") + shift).withColumn("x1", F.col("x1") + shift)


@query(f"WITH {BOXES} SELECT doc_id, page, coalesce(min(x0) FILTER (glyphs >= 15), min(x0), 0.0)::DOUBLE AS \"left\" FROM bx GROUP BY ALL")
def column_left(spark, d):
    return regions.column_left(_boxes(spark, d))


@query(
    f"""WITH {BOXES}, s AS (SELECT *, lag(baseline) OVER (PARTITION BY doc_id, page ORDER BY baseline DESC) - baseline AS step FROM bx), e AS (SELECT doc_id, page, median(size) AS em FROM bx GROUP BY ALL)
    SELECT doc_id, page, min(x0) AS x0, max(x1) AS x1, em AS size, coalesce(median(step) FILTER (step > 0.1 AND step < 3 * em), 1.2 * em)::DOUBLE AS step FROM s JOIN e USING (doc_id, page) GROUP BY doc_id, page, em"""
)
def region_stats(spark, d):
    return regions.region_stats(_boxes(spark, d))


@query(f"""WITH {GLYPHS}, z AS (SELECT doc_id, page, line, any_value(doc_id % 3 + 4)::DOUBLE AS size, coalesce(median(top - bottom) FILTER (NOT space), 0) AS mid, coalesce(max(top - bottom) FILTER (NOT space), 0) AS tall FROM g GROUP BY ALL)
    SELECT doc_id, page, line, size, greatest(CASE WHEN size >= 0.5 * mid THEN size ELSE tall END, 1.0)::DOUBLE AS robust FROM z""")
def robust_size(spark, d):
    g = glyphs(spark, d)
    sizes = g.groupBy("doc_id", "page", "line").agg(F.first((F.col("doc_id") % 3 + 4).cast("double")).alias("size"))
    return regions.robust_size(g, sizes)


@query(
    f"""WITH {LINES}, it AS (SELECT doc_id, page, line, (72 + 6 * (line * 7 % 11))::DOUBLE AS x0 FROM l), x AS (SELECT doc_id, page, list_sort(list(DISTINCT x0)) AS ats FROM it GROUP BY ALL),
    b AS (SELECT doc_id, page, list_reduce(list_transform(ats, lambda v: [v]), lambda a, v: CASE WHEN v[1] > a[-1] + 0.9 * 10.0 THEN list_concat(a, v) ELSE a END) AS begins FROM x)
    SELECT doc_id, page, line, x0, greatest(coalesce(list_position(begins, list_filter(begins, lambda v: abs(x0 - v) <= 0.9 * 10.0 + 1e-6)[1]), 0) - 1, 0)::BIGINT AS level FROM it JOIN b USING (doc_id, page)"""
)
def list_levels(spark, d):
    x = (72 + 6 * (F.col("line") * 7 % 11)).cast("double")
    return regions.list_levels(plain(spark, d).select("doc_id", "page", "line", x.alias("x0")), 10.0)


@query(
    f"""WITH {LINES}, tb AS (SELECT DISTINCT doc_id, page, n AS table_no, 700.0::DOUBLE - 290 * n AS top FROM l, (SELECT unnest(range(3)) AS n)), b AS (SELECT doc_id, page, line AS ord, 758.0::DOUBLE - 15 * (line % 45) AS y_top FROM l)
    SELECT doc_id, page, table_no, min(ord) FILTER (y_top < top) AS ord FROM tb JOIN b USING (doc_id, page) GROUP BY ALL"""
)
def table_places(spark, d):
    x = plain(spark, d)
    tables = x.select("doc_id", "page").distinct().select("*", F.explode(F.expr("sequence(0L, 2L)")).alias("table_no")).withColumn("y_top", F.lit(700.0) - 290.0 * F.col("table_no"))
    return regions.splice(tables, x.select("doc_id", "page", F.col("line").alias("ord"), (F.lit(758.0) - (F.col("line") % 45) * 15.0).alias("y_top")))


@query(f"""WITH {BOXES}, k AS (SELECT * REPLACE (baseline + CASE WHEN line % 3 = 1 THEN 3000.0 * line ELSE 0 END AS baseline) FROM bx) SELECT doc_id, page, line FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.doc_id = k.doc_id AND o.page = k.page AND o.line <> k.line AND o.x0 <= k.x1 AND k.x0 <= o.x1 AND abs(o.baseline - k.baseline) <= 24)""")
def isolated_lines(spark, d):
    return regions.isolated(_boxes(spark, d).withColumn("baseline", F.col("baseline") + F.when(F.col("line") % 3 == 1, 3000.0 * F.col("line")).otherwise(0.0))).select("doc_id", "page", "line")


@query(
    f"""WITH {GAPS}, n AS (SELECT *, coalesce(spaced, false) AS sp, lag(ch) OVER w AS a, lag(ch, 2) OVER w AS aa, CASE WHEN lead(spaced) OVER w THEN ' ' ELSE coalesce(lead(ch) OVER w, '') END AS nx FROM gap WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY "left", seq)),
    b AS (SELECT *, coalesce((regexp_matches(a, '[0-9]') AND regexp_matches(ch, '[0-9]') AND NOT sp) OR (regexp_matches(a, '[A-Za-z0-9]') AND ch IN ('.', ',', ':', ';') AND NOT (ch = ':' AND nx = '=')) OR (a = ':' AND (ch = ':' OR coalesce(aa = ':', false))) OR (regexp_matches(a, '[A-Za-z0-9]') AND ch = '-' AND regexp_matches(nx, '[A-Za-z0-9]') AND NOT sp), false) AS bound FROM n)
    SELECT doc_id, page, line, seq, gap IS NOT NULL AND (sp OR gap > 0.28 * 10.0::DOUBLE) AND (gap > greatest(1.4 * size, 10.0) OR NOT bound) AS space FROM b"""
)
def token_spaces(spark, d):
    return lines.token_spaces(lines.gaps(_gapped(spark, d)), 10.0).select("doc_id", "page", "line", "seq", "space")


from . import rules  # noqa: E402, F401  its queries register themselves
