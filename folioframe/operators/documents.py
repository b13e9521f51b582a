"""Whole documents, given as runs of text, to blocks: a document's row holds its pages, so nothing is dealt anew.

A run is text set in one style with one advance. Its glyphs exist only here, as arrays of one document, and take the way
that convert.analyze goes over tables: regions, lines, running chrome, blocks, headers and footers. Both agree (tested).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import blocks as B
from . import chrome
from .cluster import DEPTH, GUTTER, GUTTER_EM, ROW_GAP, cjk, cluster, split
from .lines import DEFAULT_SIZE

RUN = {"page": "bigint", "seq": "bigint", "text": "string", "left": "double", "step": "double", "ink": "double", "y": "double", "bottom": "double", "top": "double", "size": "double", "bold": "boolean", "mono": "boolean"}
PAGE = {"page": "bigint", "width": "double", "height": "double"}
#: Documents whose blocks go back together.
SLICE = 64
LOWER = str.maketrans(X.UPPER, X.LOWER)
FACTS = {"ord": "bigint", "page": "bigint", "kind": "string", "indent": "bigint", "marker": "string", "label": "string", "size": "double", "bold": "boolean", "n_lines": "bigint", "chars": "bigint", "first_line": "string", "last_line": "string", "title": "string", "x0": "double", "x1": "double"}
WORDS = {"text": "string", "lines": "array<string>"}
ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def array_type(fields: dict[str, str]) -> str:
    return f"array<struct<{', '.join(f'{k}: {kind}' for k, kind in fields.items())}>>"


def struct_of(fields: dict[str, str], **values: Column) -> Column:
    return F.struct(*[values[k].cast(kind).alias(k) for k, kind in fields.items()])


def glyph_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The glyph and page tables of documents (doc_id, runs, pages), a row for each glyph and page."""
    r = docs.select("doc_id", F.inline("runs")).withColumnRenamed("seq", "first").withColumnRenamed("left", "x")
    g = r.select("*", F.posexplode(F.split("text", "")).alias("j", "ch")).where("ch <> ''")
    left = F.col("x") + F.col("j") * F.col("step")
    g = g.select("doc_id", "page", (F.col("first") + F.col("j")).alias("seq"), "ch", "y", left.alias("left"), (left + F.col("ink")).alias("right"), "bottom", "top", "size", "bold", "mono", (F.col("ch") == " ").alias("space"))
    return g, docs.select("doc_id", F.inline("pages"))


@dataclass
class Line:
    """A line's measures as line_table has them."""

    page: int
    region: int
    line_no: int
    text: str
    x0: float
    x1: float
    baseline: float
    top: float
    bottom: float
    size: float
    size_max: float
    glyphs: int
    bold: int
    mono: bool
    first: tuple  # characters, left edges, sizes and baselines of the first glyphs; one size and baseline for all

    @property
    def even(self) -> bool:
        return type(self.first[2]) is float

    @property
    def head(self) -> list[dict]:
        ch, left, size, y = self.first
        size, y = ([v] * len(ch) if self.even else v.tolist() for v in (size, y))
        return [{"ch": c, "left": a, "size": s, "y": b} for c, a, s, b in zip(ch, left.tolist(), size, y)]

    @cached_property
    def stamp(self) -> str:
        return self.text.replace(" ", "").translate(LOWER)

    @cached_property
    def signature(self) -> str:
        return re.sub("#?[0-9]+", "#", self.stamp)

    @cached_property
    def place(self) -> tuple[int, int]:
        return half_up(self.x0 / 4), half_up(self.baseline / 4)

    def band(self, height: float) -> int:
        return band(self.bottom, self.top, height)


def half_up(x: float) -> int:
    whole = int(abs(x))
    whole += abs(x) - whole >= 0.5
    return whole if x >= 0 else -whole


def band(low: float, high: float, height: float) -> int:
    return 0 if height <= 0 else 1 if low > 0.88 * height else 2 if high < 0.12 * height else 0


def middles(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Medians of the stretches, which hold a value at least."""
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    for i in np.flatnonzero(low != high):
        low[i] = np.median(values[starts[i] : ends[i]])
    return low


def find_lines(runs: dict) -> tuple[list[Line], float]:
    """Lines of a document in reading order, page by page, and its body size. runs: arrays by the names of RUN, text a
    list of strings, ordered by page."""
    codes = np.frombuffer("".join(runs["text"]).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    counts = np.fromiter(map(len, runs["text"]), int, len(runs["text"]))
    of = np.repeat(np.arange(len(counts)), counts)
    j = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    g = {c: runs[c][of] for c in ("y", "bottom", "top", "size")} | {"space": codes == 32}
    g["left"] = runs["left"][of] + j * runs["step"][of]
    g["right"] = g["left"] + runs["ink"][of]
    g |= {"mono": runs["mono"][of], "code": codes}
    ink = ~g["space"]
    sizes, often = np.unique(g["size"][ink], return_counts=True)
    sizes, back = np.unique([half_up(4 * x) / 4 for x in sizes.tolist()], return_inverse=True)
    often = np.bincount(back, often)
    body = float(sizes[np.argmax(often)]) if len(sizes) else DEFAULT_SIZE
    page = runs["page"][of]
    edges = [0, *(np.flatnonzero(np.diff(page)) + 1).tolist(), n] if n else [0]
    number, places = np.full(n, -1), []
    for a, b in zip(edges, edges[1:]):
        own = {c: v[a:b] for c, v in g.items()}
        for r, at in enumerate(split(own, np.arange(b - a))):
            line = cluster(own, at)
            number[a + at] = np.where(line >= 0, line + len(places), -1)
            places += [(int(page[a]), r, k) for k in range(int(line.max(initial=-1)) + 1)]
    if not places:
        return [], body
    seq = runs["seq"][of] + j
    order = np.lexsort((seq, ink, g["left"], number))
    order = order[np.searchsorted(number[order], 0) :]
    after_blank, following = np.zeros(len(order), bool), np.zeros(len(order), np.uint32)
    same = number[order[1:]] == number[order[:-1]]
    after_blank[1:] = g["space"][order[:-1]] & same
    following[:-1] = np.where(same, codes[order[1:]], 0)
    seen = ink[order]
    order, after_blank, following = order[seen], after_blank[seen], following[seen]
    line, ch = number[order], codes[order]
    y, size, left, right, top, bottom = (g[c][order] for c in ("y", "size", "left", "right", "top", "bottom"))
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    ends = np.append(starts[1:], len(line))
    counts = ends - starts
    spread = lambda v: np.repeat(v, counts)
    first = np.zeros(len(line), bool)
    first[starts] = True
    gap = np.where(first, 0.0, left - np.concatenate([[0.0], right[:-1]]))
    em, most = np.maximum(middles(size, starts, ends), 1.0), np.maximum.reduceat(size, starts)
    largest = np.where(most <= 1.8 * em, most, em)
    word_gap = word_gaps(np.maximum(gap, 0.0), line, starts, counts, em)
    wide = ~first & (gap > np.maximum(1.4 * spread(em), 10.0))
    before, second = np.concatenate([[0], ch[:-1]]), np.concatenate([[0, 0], ch[:-2]])
    before[first] = 0
    second[first | np.concatenate([[False], first[:-1]])] = 0
    asked = ~first & (after_blank | (gap > spread(word_gap)) | wide)
    at = np.flatnonzero(asked & ~wide)
    asked[at[bound(before[at], second[at], ch[at], following[at], after_blank[at])]] = False
    shift = np.cumsum(asked)
    out = np.full(len(ch) + int(shift[-1]), 32, np.uint32)
    out[np.arange(len(ch)) + shift] = ch
    text = out.tobytes().decode("utf-32-le", "surrogatepass")
    plain = ch.tobytes().decode("utf-32-le", "surrogatepass")
    raised = (top > bottom) & (top - y < 0.30 * size) & (y - bottom > 0.55 * size)
    level = (np.minimum.reduceat(y, starts) == np.maximum.reduceat(y, starts)) & ~np.logical_or.reduceat(raised, starts)
    bold, mono = np.add.reduceat(runs["bold"][of][order].astype(int), starts), np.add.reduceat(runs["mono"][of][order].astype(int), starts)
    foreign = ch >= 0x2E80
    lines, box = [], [np.minimum.reduceat(left, starts).tolist(), np.maximum.reduceat(right, starts).tolist(), np.maximum.reduceat(top, starts).tolist(), np.minimum.reduceat(bottom, starts).tolist()]
    for i, (a, b, e, big) in enumerate(zip(starts.tolist(), ends.tolist(), em.tolist(), largest.tolist())):
        if level[i]:
            base = float(y[a])
        else:
            flat = ~raised[a:b]
            low = flat & (size[a:b] >= 0.83 * big)
            low = low if low.any() else flat
            base = float(np.median(y[a:b][low])) if low.any() else 0.0
        fixed = bool(mono[i] * 2 > b - a) and not (foreign[a:b].any() and cjk(ch[a:b]).any())
        x0, x1, high, deep = (v[i] for v in box)
        h = min(b, a + B.HEAD)
        lines.append(Line(*places[int(line[a])], text[a + int(shift[a]) : b + int(shift[b - 1])], x0, x1, base, high, deep, e, big, b - a, int(bold[i]), fixed, (plain[a:h], left[a:h], size[a:h], y[a:h])))
    return lines, body


def weighted_median(values: np.ndarray, weights: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """By group: the median of values, each as often as its weight."""
    order = np.lexsort((values, group))
    upto, total = np.cumsum(weights[order]), np.bincount(group, weights, groups).astype(int)
    base = np.cumsum(total) - total
    low, high = (values[order][np.searchsorted(upto, base + at, "right")] for at in ((total - 1) // 2, total // 2))
    return (low + high) / 2


def steady_lines(runs: dict, doc: np.ndarray) -> tuple[list[list[Line] | None], list[float]]:
    """find_lines of many documents at once; None for one that needs find_lines itself. runs: of all, ordered by document
    and page; doc: each run's document, from 0.

    Where each run has ink and an advance over nought, and a region's runs lie further apart than lines join, a run is a
    line: bands are cut between runs, and a gutter is ruled out by counting how many glyphs cover points set closer
    than a gutter is wide. A document with anything else takes the other way whole.
    """
    docs = int(doc[-1]) + 1 if len(doc) else 0
    codes = np.frombuffer("".join(runs["text"]).encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.fromiter(map(len, runs["text"]), int, len(runs["text"]))
    seen = codes != 32
    begin = np.cumsum(counts) - counts
    upto = np.concatenate([[0], np.cumsum(seen)])
    glyphs = upto[begin + counts] - upto[begin]
    y, size, top, bottom = (runs[k] for k in ("y", "size", "top", "bottom"))
    odd_run = (glyphs == 0) | ~(runs["step"] > 0) | ~(runs["ink"] > 0) | ~(top > bottom) | (top - y < 0.30 * size) & (y - bottom > 0.55 * size) | ~(size > 0) | runs["mono"] | ~np.isfinite(runs["left"] + runs["step"] * counts + y)
    odd = np.bincount(doc, odd_run, docs) > 0
    sound = np.flatnonzero(~odd[doc])
    # bands, as far as they nest
    new = np.ones(len(sound), bool)
    if len(sound):
        new[1:] = (np.diff(doc[sound]) != 0) | (np.diff(runs["page"][sound]) != 0)
    group = np.cumsum(new) - 1
    sheet = group
    for _ in range(DEPTH if len(sound) else 0):
        em = weighted_median(size[sound], glyphs[sound], group, int(group.max()) + 1)
        order = np.lexsort((bottom[sound], group))
        lo, hi, own = bottom[sound][order], top[sound][order], group[order]
        value, rank = np.unique(hi, return_inverse=True)
        reach = value[np.maximum.accumulate(own * len(value) + rank) - own * len(value)]
        cut = np.zeros(len(order), bool)
        cut[1:] = (own[1:] == own[:-1]) & (lo[1:] - reach[:-1] > ROW_GAP * em[own[1:]])
        if not cut.any():
            break
        part = np.empty(len(order), int)
        part[order] = -np.cumsum(cut)
        order = np.lexsort((part, group))
        step = np.ones(len(order), bool)
        step[1:] = (np.diff(group[order]) != 0) | (np.diff(part[order]) != 0)
        group = np.empty(len(order), int)
        group[order] = np.cumsum(step) - 1
    # a region's runs from the top, each a line of its own
    order = np.lexsort((-y[sound], group))
    sound, group, sheet = sound[order], group[order], sheet[order]
    if len(sound):
        groups = int(group[-1]) + 1
        em, largest = weighted_median(size[sound], glyphs[sound], group, groups), np.maximum.reduceat(size[sound], np.searchsorted(group, np.arange(groups)))
        close = np.zeros(len(sound), bool)
        close[1:] = (group[1:] == group[:-1]) & (y[sound][:-1] - y[sound][1:] <= 0.5 * largest[group[1:]] + 1e-6)
        odd |= np.bincount(doc[sound], close, docs) > 0
    if not len(sound):
        return [None if x else [] for x in odd.tolist()], [DEFAULT_SIZE] * docs
    # glyphs of the runs in this order
    n = counts[sound]
    of = np.repeat(np.arange(len(sound)), n)
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    ch = codes[np.repeat(begin[sound], n) + j]
    inked = np.flatnonzero(ch != 32)
    of, j, c = of[inked], j[inked], ch[inked]
    n = glyphs[sound]
    starts = np.cumsum(n) - n
    left = runs["left"][sound][of] + j * runs["step"][sound][of]
    right = left + runs["ink"][sound][of]
    odd |= np.bincount(doc[sound], gutters(left, right, group, of, n, y[sound], em), docs) > 0
    out: list[list[Line] | None] = [None if x else [] for x in odd.tolist()]
    em = np.maximum(size[sound], 1.0)
    gap, blank = np.zeros(len(c)), np.zeros(len(c), bool)
    gap[1:], blank[1:] = left[1:] - right[:-1], inked[1:] - inked[:-1] > 1
    gap[starts] = 0.0
    blank[starts] = False
    flat = np.maximum(gap, 0.0)
    near = np.maximum.reduceat(np.where(blank, 0.0, flat), starts)
    least, most = np.minimum.reduceat(np.where(blank, flat, np.inf), starts), np.maximum.reduceat(np.where(blank, flat, 0.0), starts)
    spaced = np.isfinite(least)
    jump = np.where(spaced, least, 0.0) - near
    clear = spaced & (jump > near) & (jump > most - least) & (near <= 0.6 * em)
    found = (n >= 3) & (jump >= 0.11 * em)
    word_gap = np.where(clear & found, np.minimum(np.maximum((np.where(spaced, least, 0.0) + near) / 2, 0.18 * em), 0.9 * em), 0.28 * em)
    for i in np.flatnonzero(~clear & ~(~spaced & (near < 0.11 * em)) & (n >= 3)).tolist():
        word_gap[i] = word_gaps(flat[starts[i] : starts[i] + n[i]], np.zeros(n[i], int), np.zeros(1, int), n[i : i + 1], em[i : i + 1])[0]
    wide = gap > np.maximum(1.4 * em, 10.0)[of]
    asked = blank | (gap > word_gap[of]) | wide
    asked[starts] = False
    at = np.flatnonzero(asked & ~wide)
    at = at[(c[at] < 65) | (c[at - 1] == 58)]
    if len(at):
        a, x, first = c[at - 1], c[at], starts[of[at]]
        after = inked[at] + 1
        last = np.cumsum(counts[sound])[of[at]]
        nx = np.where(after < last, ch[np.minimum(after, len(ch) - 1)], 0)
        second = np.where(at - 2 >= first, c[at - 2], 0)
        asked[at[bound(a, second, x, nx, blank[at])]] = False
    shift = np.cumsum(asked)
    made = np.full(len(c) + int(shift[-1]), 32, np.uint32)
    made[np.arange(len(c)) + shift] = c
    text, plain = made.tobytes().decode("utf-32-le", "surrogatepass"), c.tobytes().decode("utf-32-le", "surrogatepass")
    ends = starts + n
    first_of = np.ones(len(sound), bool)
    first_of[1:] = sheet[1:] != sheet[:-1]
    region = group - group[np.maximum.accumulate(np.where(first_of, np.arange(len(sound)), 0))]
    first_of[1:] = group[1:] != group[:-1]
    line_no = np.arange(len(sound)) - np.maximum.accumulate(np.where(first_of, np.arange(len(sound)), 0))
    columns = [doc[sound], runs["page"][sound], region, line_no, starts, ends, starts + shift[starts], ends + shift[ends - 1], left[starts], right[ends - 1], y[sound], top[sound], bottom[sound], em, np.where(size[sound] <= 1.8 * em, size[sound], em), n, n * runs["bold"][sound], size[sound]]
    for k, page, region, no, a, e, ta, te, x0, x1, base, high, low, em_, big, count, bold, exact in zip(*(v.tolist() for v in columns)):
        if (found := out[k]) is not None:
            h = min(e, a + B.HEAD)
            found.append(Line(page, region, no, text[ta:te], x0, x1, base, high, low, em_, big, count, bold, False, (plain[a:h], left[a:h], exact, base)))
    quarter, back = np.unique(size[sound], return_inverse=True)
    quarter = np.array([half_up(4 * x) / 4 for x in quarter.tolist()])
    value, back = np.unique(quarter[back], return_inverse=True)
    often = np.bincount(doc[sound] * len(value) + back, n, docs * len(value)).reshape(docs, -1)
    bodies = [float(value[k]) if x[k] > 0 else DEFAULT_SIZE for x, k in zip(often, often.argmax(1))]
    return out, bodies


def gutters(left: np.ndarray, right: np.ndarray, group: np.ndarray, of: np.ndarray, n: np.ndarray, y: np.ndarray, em: np.ndarray) -> np.ndarray:
    """Runs of regions in which thin_cuts might find a gutter. Its stretch holds points set at a sixteenth of its least width,
    one after the other covered by no more glyphs than it tolerates; glyphs count a little narrower than they are."""
    runs_of = np.bincount(group)
    tolerance = 1 + np.bincount(group[1:], (group[1:] == group[:-1]) & (y[:-1] - y[1:] > 0.5 * em[group[1:]]), len(em)).astype(int)
    tolerance //= 12
    width = np.maximum(GUTTER, GUTTER_EM * em) / 16
    firsts = np.cumsum(runs_of) - runs_of
    starts = np.cumsum(n) - n
    low = np.minimum.reduceat(left[starts], firsts)
    high = np.maximum.reduceat(right[starts + n - 1], firsts)
    points = np.ceil((high - low) / width).astype(int) + 2
    points = np.minimum(points, 10_000)  # wider ones count as held
    base = np.cumsum(points) - points
    g = group[of]
    x0, w, most, offset = low[g], width[g], points[g] - 1, base[g]
    opens = np.minimum(np.ceil((left + 1e-6 - x0) / w).astype(int), most) + offset
    closes = np.minimum(np.ceil((right - 1e-6 - x0) / w).astype(int), most) + offset
    total = int(points.sum())
    cover = np.cumsum(np.bincount(opens, minlength=total) - np.bincount(closes, minlength=total))
    of_point = np.repeat(np.arange(len(points)), points)
    at = np.arange(total) - base[of_point]
    scarce = (cover <= tolerance[of_point]) & (at * width[of_point] <= (high - low)[of_point] + width[of_point])
    # the stretch has fifteen of them strictly inside
    row = np.cumsum(scarce)
    many = np.zeros(total, bool)
    many[13:] = (row[13:] - np.concatenate([[0], row[:-14]]) == 14) & (of_point[13:] == of_point[:-13])
    held = np.bincount(of_point, many, len(points)) > 0
    held |= points >= 10_000
    return held[group] & (np.add.reduceat(n, firsts) >= 4)[group]


def bound(a: np.ndarray, second: np.ndarray, c: np.ndarray, nx: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Whether a blank before the glyphs c, after a and second and before nx, would split a token."""
    digit = lambda c: (c >= 48) & (c <= 57)
    word = lambda c: digit(c) | (c >= 65) & (c <= 90) | (c >= 97) & (c <= 122)
    return digit(a) & digit(c) & ~blank | np.isin(c, [44, 46, 58, 59]) & word(a) & ~((c == 58) & (nx == 61)) | (c == 58) & (a == 58) | (a == 58) & (second == 58) | (c == 45) & word(a) & word(nx) & ~blank


def word_gaps(gap: np.ndarray, line: np.ndarray, starts: np.ndarray, counts: np.ndarray, em: np.ndarray) -> np.ndarray:
    """By line: the middle of the largest jump between its sorted gaps, the first of equals, within 0.18 and 0.9 em."""
    sorted_ = gap[np.lexsort((gap, line))]
    below = np.concatenate([[0.0], sorted_[:-1]])
    jump = np.where(below <= 0.6 * np.repeat(em, counts), sorted_ - below, 0.0)
    jump[starts] = 0.0
    best = np.maximum.reduceat(jump, starts)
    at = np.flatnonzero(jump == np.repeat(best, counts))
    at = at[np.searchsorted(at, starts)]
    mid = np.where(best > 0, (sorted_[at] + below[at]) / 2, 0.0)
    return np.where((counts >= 3) & (best >= 0.11 * em), np.minimum(np.maximum(mid, 0.18 * em), 0.9 * em), 0.28 * em)


def frequent(seen: dict, least: int) -> set:
    return {k for k, pages in seen.items() if len(pages) >= least}


def pages_of(keyed) -> dict:
    found = defaultdict(set)
    for key, page in keyed:
        found[key].add(page)
    return found


def strip_running(lines: list[Line], pages: dict[int, tuple[float, float]]) -> list[Line]:
    """chrome.strip_running of a document whose lines are one segment each."""
    n = len(pages)
    if n < 3:
        return lines
    banded, margin = [], []
    for r in lines:
        if r.page not in pages:
            continue
        width, height = pages[r.page]
        b = r.band(height)
        if b:
            banded.append((b, r))
        elif width > 0 and (r.x1 < 0.15 * width or r.x0 > 0.85 * width) and 2 <= len(r.stamp.encode()) <= 24:
            margin.append(r)
    stamps = {k[0] for k in frequent(pages_of(((r.stamp, r.place), r.page) for r in margin), max(3, -(-n // 4)))}
    by_page = defaultdict(list)
    for r in lines:
        if r.page in pages:
            by_page[r.page].append(r)

    def clear(r: Line, distance: float, gone: set) -> bool:
        return not any(o is not r and id(o) not in gone and o.x0 <= r.x1 and r.x0 <= o.x1 and abs(o.baseline - r.baseline) <= distance for o in by_page[r.page])

    gone = {id(r) for r in margin if r.stamp in stamps and clear(r, 24.0, set())}
    signed = [(b, r) for b, r in banded if r.signature]
    texts = frequent(pages_of(((b, r.signature), r.page) for b, r in signed), max(3, -(-n // 2)))
    places = frequent(pages_of(((b, r.place, r.signature), r.page) for b, r in signed), chrome.POSITION_PAGES)
    known = {id(r) for b, r in signed if (b, r.signature) in texts or (b, r.place, r.signature) in places and clear(r, max(1.8 * r.size, 14.0), gone)}
    return [r for r in lines if id(r) not in gone and id(r) not in known]


def literal_hyphen(head: str, tail: str) -> tuple[bool, str]:
    """text.literal_hyphen of two strings."""
    word = re.search("[^ ]*\\Z", re.sub("[-‐­]+\\Z", "", head))[0]
    depth = word.count("{") - word.count("}")
    piece = re.search("[-‐]([^-‐]*)\\Z", word)
    chain = bool(re.search("[-‐][A-Za-z0-9]*\\Z", word))
    right = re.match("[A-Za-z]+", tail)
    gainsaid = (piece[1] + right[0]).translate(LOWER) if chain and depth <= 0 and piece and piece[1] and right else ""
    return word != "" and (depth > 0 or chain), gainsaid


def url_wraps(head: str, tail: str) -> bool:
    """text.url_wraps of two strings."""
    last = head.rstrip(" ").rpartition(" ")[2]
    if not ("://" in last or last.startswith("www.")) or re.match(r"www\.|[A-Za-z]{1,8}://", tail) or re.search(r"[.!?,:;)]\Z", last):
        return False
    return bool(re.match(r"[A-Za-z0-9/.\-_~#?=&%+]", tail)) and not (re.match("[A-Z]", tail) and not re.search(r"[/\-_.=?&#%+~]\Z", last))


class Attested:
    """Lower-case words inside a document's lines, gathered when first asked for."""

    def __init__(self, lines: list[Line]):
        self.lines = lines

    @cached_property
    def words(self) -> set[str]:
        return {w for r in self.lines for w in re.findall("[a-z]+", r.text.translate(LOWER))[1:-1]}

    def __contains__(self, word: str) -> bool:
        return word in self.words


def join_lines(texts: list[str], words: Attested) -> str:
    """blocks.join_lines of one block."""
    from ..plans.markdown import BOUND

    texts, out = [t.rstrip(" ") for t in texts], []
    for t, below in zip(texts, [*texts[1:], None]):
        if below is None:
            out.append(t)
        elif re.match("[a-z]", below) and t.endswith(("-", "‐")) or t.endswith("­"):
            left, right = re.search("([a-z]+)[-‐­]\\Z", t.translate(LOWER)), re.match("[a-z]+", below.translate(LOWER))
            left, right = left[1] if left else "", right[0] if right else ""
            literal, gainsaid = literal_hyphen(t, below)
            goes_on = bool(re.match("[A-Za-z]+[-‐][A-Za-z]", below))
            compound = left in words and left + right not in words and len(left) >= 4 and (len(right) >= 4 or goes_on) and left not in BOUND
            out.append(t[:-1] + ("-" if compound or literal and gainsaid not in words else ""))
        elif t.endswith(("-", "‐")) and re.match("[A-Z]", below):
            out.append(t[:-1] + "-")
        elif url_wraps(t, below):
            out.append(t)
        else:
            out.append(t + " ")
    return "".join(out).replace("­", "")


def form_blocks(lines: list[Line], body: float) -> list[dict]:
    """Blocks in reading order, as convert.analyze has them, with low, high and signature."""
    words, found = Attested(lines), []
    for (page, _), region in groupby(lines, key=lambda r: (r.page, r.region)):
        own = sorted(region, key=lambda r: (-r.baseline, r.x0))
        by_no = {r.line_no: r for r in own}
        rows = [B.Row.read(r) for r in own]
        flow = B.Flow(rows)
        for r in rows:
            flow.add(r)
        for block, level in zip(flow.blocks, flow.levels()):
            lead, held = block["rows"][0], sorted(block["rows"], key=lambda r: r.no)
            own = [by_no[r.no] for r in held]
            texts, sizes = [r.text for r in own], [r.size for r in own]
            size, chars = max(B.middle(sizes), 1.0), sum(map(len, texts))
            bold = sum(r.bold for r in own) * 10 >= sum(r.glyphs for r in own) * 7
            made = {"page": page, "kind": block["kind"], "indent": level, "marker": lead.marker, "label": lead.note, "size": size, "bold": bold, "n_lines": len(own), "chars": chars, "x0": min(r.x0 for r in own), "x1": max(r.x1 for r in own)}
            made |= {"text": join_lines([t[r.cut :] for t, r in zip(texts, held)], words), "first_line": "", "last_line": "", "title": "", "lines": texts if block["kind"] == "code" else []}
            # texts that the headings' rules may ask for; of all others they read measures alone
            if made["kind"] == "paragraph" and (len(own) <= 3 and chars <= 220 and size >= 1.12 * body or len(own) == 1 and bold and chars <= 140):
                made |= {"first_line": texts[0], "last_line": texts[-1], "title": made["text"]}
            found.append((made, min(r.bottom for r in own), max(r.top for r in own), own))
    for i, (made, *_) in enumerate(found):
        made["ord"] = i + 1
    return found


def strip_headers_footers(found: list, pages: dict[int, tuple[float, float]]) -> list[dict]:
    """chrome.strip_headers_footers of a document."""
    n, signed = len(pages), {}
    if n >= 2:
        for made, low, high, own in found:
            b = band(low, high, pages[made["page"]][1]) if made["page"] in pages else 0
            if b:
                signed[made["ord"]] = (b, "".join(r.signature + "|" for r in own))
    page = {made["ord"]: made["page"] for made, *_ in found}
    again = frequent(pages_of((key, page[o]) for o, key in signed.items()), max(3, -(-n // 2)))
    return [made for made, *_ in found if not ((key := signed.get(made["ord"])) and (key in again or key[1] in X.PAGE_NUMBERS))]


def blocks(docs: DataFrame, strip: bool = True) -> DataFrame:
    """doc_id, body_size, facts and texts of each document's blocks; docs: doc_id, runs (RUN), pages (PAGE)."""
    fact, words = (pa.list_(pa.struct([(k, ARROW[kind]) for k, kind in fields.items()])) for fields in (FACTS, WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, pages = batch.column("runs"), batch.column("pages")
            at, page_at, fields, sheets = runs.offsets.to_numpy(), pages.offsets.to_numpy(), runs.values, pages.values
            for a in range(0, batch.num_rows, SLICE):
                sizes, facts, texts = [], [], []
                b = min(a + SLICE, batch.num_rows)
                held, sheet = fields.slice(at[a], at[b] - at[a]), sheets.slice(page_at[a], page_at[b] - page_at[a])
                doc = {k: held.field(k).to_numpy(zero_copy_only=False) for k in RUN if k != "text"}
                of, text = np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), held.field("text").to_pylist()
                full = np.fromiter(map(len, text), int, len(text)) > 0  # a run of no glyph is none
                order = np.lexsort((doc["page"], of))
                order = order[full[order]]
                of, doc = of[order], {k: v[order] for k, v in doc.items()} | {"text": [text[k] for k in order.tolist()]}
                known = list(zip(*(sheet.field(k).to_pylist() for k in PAGE)))
                lines, bodies = steady_lines(doc, of)
                for i in range(b - a):
                    found, body = (lines[i], bodies[i]) if i < len(lines) else ([], DEFAULT_SIZE)
                    if found is None:
                        own = slice(*np.searchsorted(of, [i, i + 1]))
                        found, body = find_lines({k: v[own] for k, v in doc.items()})
                    seen = {p: (w, h) for p, w, h in known[page_at[a + i] - page_at[a] : page_at[a + i + 1] - page_at[a]]}
                    made = form_blocks(strip_running(found, seen) if strip else found, body)
                    made = strip_headers_footers(made, seen) if strip else [x for x, *_ in made]
                    sizes.append(body)
                    facts.append([{k: x[k] for k in FACTS} for x in made])
                    texts.append([{k: x[k] for k in WORDS} for x in made])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.float64()), pa.array(facts, fact), pa.array(texts, words)], ["doc_id", "body_size", "facts", "texts"])

    return docs.select("doc_id", "runs", "pages").mapInArrow(run, f"doc_id bigint, body_size double, facts {array_type(FACTS)}, texts {array_type(WORDS)}")
