"""Regions and lines of a page, from its glyphs alone.

Both grow or split by what they have found so far, which no window frame expresses, so a page's glyphs are taken
together; a page is bounded by its paper, not by the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .lines import DEFAULT_SIZE

#: Cuts nest this deep; gaps between regions in em, and the least width of a gutter in em and points.
DEPTH, ROW_GAP, GUTTER_EM, GUTTER = 10, 2.6, 1.7, 14.0


def clear_cuts(lo: np.ndarray, hi: np.ndarray, least: float) -> np.ndarray:
    """Middles of the gaps over `least` that no span covers."""
    order = np.argsort(lo, kind="stable")
    reach, begin = np.maximum.accumulate(hi[order])[:-1], lo[order][1:]
    wide = begin - reach > least
    return (begin[wide] + reach[wide]) / 2


def thin_cuts(lo: np.ndarray, hi: np.ndarray, least: float, tolerance: float) -> np.ndarray:
    """Middles of inner stretches, `least` wide or more, that at most `tolerance` spans cover, with enough on each side."""
    if len(lo) < 4:
        return np.zeros(0)
    at = np.unique(np.concatenate([lo, hi]))
    cover = np.searchsorted(np.sort(lo), at[:-1], "right") - np.searchsorted(np.sort(hi), at[:-1], "right")
    edge = np.diff(np.concatenate([[False], cover <= tolerance, [False]]).astype(int))
    a, b = at[np.flatnonzero(edge == 1)], at[np.flatnonzero(edge == -1)]
    side = max(3, len(lo) / 25)
    left, right = np.searchsorted(np.sort(hi), a, "right"), len(lo) - np.searchsorted(np.sort(lo), b, "left")
    return ((a + b) / 2)[(b - a >= least) & (left >= side) & (right >= side)]


def cjk(codes: np.ndarray) -> np.ndarray:
    spans = (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0xAC00, 0xD7AF), (0x20000, 0x2FA1F)
    return np.logical_or.reduce([(codes >= a) & (codes <= b) for a, b in spans])


class GridLine:
    """A line as grids see it: its inked glyphs from left to right."""

    def __init__(self, g: dict[str, np.ndarray], at: np.ndarray):
        at = at[np.argsort(g["left"][at], kind="stable")]
        self.left, self.right, y, size, box = g["left"][at], g["right"][at], g["y"][at], g["size"][at], g["top"][at] - g["bottom"][at]
        self.x0, self.x1 = self.left.min(), self.right.max()
        em = max(float(np.median(size)), 1.0)
        boxes = box[box > 0]
        self.size = em if not len(boxes) or em >= 0.5 * np.median(boxes) else max(float(boxes.max()), 1.0)
        flat = ~((box > 0) & (g["top"][at] - y < 0.30 * size) & (y - g["bottom"][at] > 0.55 * size))
        low = flat & (size >= 0.83 * (size.max() if size.max() <= 1.8 * em else em))
        low = low if low.any() else flat
        self.baseline = float(np.median(y[low])) if low.any() else 0.0
        self.gap = self.left[1:] - self.right[:-1]
        wide = np.flatnonzero(self.gap > max(1.4 * em, 10.0))
        self.parts, self.parted = len(wide) + 1, len(wide) > 0
        self.inner = self.left[wide[0] + 1] if self.parted else np.inf
        self.mono = "mono" in g and bool(g["mono"][at].sum() * 2 > len(at)) and not cjk(g["code"][at]).any()

    def at(self, x: float, least: float) -> int:
        """0: x is beside the ink, 1: in a gap of `least` or more, 2: in a token."""
        hit, between = np.flatnonzero((self.left <= x) & (x <= self.right)), np.flatnonzero((self.right[:-1] < x) & (x < self.left[1:]))
        if len(between) and (not len(hit) or between[0] < hit[0]):
            return 1 if self.gap[between[0]] >= least else 2
        return 2 if len(hit) else 0

    def cells(self, cuts: list[float], least: float) -> int:
        """Columns that hold ink; only a gap of `least` leads from one to another."""
        column = np.searchsorted(cuts, (self.left + self.right) / 2, "right")
        held, now = set(), column[0]
        for c, gap in zip(column.tolist(), [0.0, *self.gap.tolist()]):
            now = c if gap >= least else now
            held.add(now)
        return len(held)


def column_bounds(lines: list[GridLine], size: float) -> list[float]:
    """Places that part the columns of rows: clean ones of two rows or more, or those of a third of the rows that cut as
    few; of several without a whole token between them, the one that cuts the fewest."""
    least, tol = max(6.0, 0.7 * size), max(3.0, 0.4 * size)
    tokens, middles = [], []
    for r in lines:
        gaps = np.flatnonzero(r.gap >= least)
        middles += ((r.right[gaps] + r.left[gaps + 1]) / 2).tolist()
        tokens += zip(r.left[[0, *(gaps + 1)]].tolist(), r.right[[*gaps, -1]].tolist())
    middles.sort()
    taken, i = [], 0
    while i < len(middles):
        j = i
        while j < len(middles) and middles[j] - middles[i] <= tol:
            j += 1
        x = sum(middles[i:j]) / (j - i)
        kinds = [r.at(x, least) for r in lines]
        support, cut = kinds.count(1), kinds.count(2)
        if (support >= 2 and cut == 0 or support * 3 >= len(lines) and cut * 3 <= len(lines) and support > cut) and (not taken or x - taken[-1][0] > tol):
            taken.append((x, cut))
        i = j
    bounds, i = [], 0
    while i < len(taken):
        j = i
        while j + 1 < len(taken) and not any(taken[j][0] < a and b < taken[j + 1][0] for a, b in tokens):
            j += 1
        bounds.append(min(taken[i : j + 1], key=lambda t: t[1])[0])
        i = j + 1
    return bounds


def grid_at(lines: list[GridLine], start: int) -> tuple[int, int]:
    """First line and the line after the last of the grid of three to twenty columns that begins at `start` or, past larger
    lines, below it; twice `start` if there is none."""
    first = lines[start]
    tol, end, x0, x1, inner = max(3.0, 0.4 * first.size), start + 1, first.x0, first.x1, first.inner
    goes_on = lambda r: not r.parted and inner < np.inf and r.x0 >= inner - tol
    while end < len(lines):
        r = lines[end]
        if r.mono or lines[end - 1].baseline - r.baseline > 2.0 * first.size or not r.parted and r.x1 - r.x0 > 0.55 * (x1 - x0) and not goes_on(r):
            break
        if r.parted:
            x0, x1, inner = min(x0, r.x0), max(x1, r.x1), min(inner, r.inner)
        end += 1
    while end - 1 > start and not (r := lines[end - 1]).parted:
        above = lines[end - 2]
        if inner < np.inf and r.x0 <= x0 + tol and r.x1 <= inner - tol or goes_on(r) and (above.parted or goes_on(above)):
            break
        end -= 1
    usual = lambda a: max(float(np.median([r.size for r in lines[a:end]])), 1.0)
    top = start
    while end - top > 2 and lines[top].size > 1.15 * usual(top):
        top += 1
    if end - top < 2:
        return start, start
    size, rows = usual(top), lines[top:end]
    cuts = column_bounds(rows, size)
    if not 3 <= len(cuts) + 1 <= 20 or sum(r.cells(cuts, max(6.0, 0.7 * size)) >= 2 for r in rows) < 2:
        return start, start
    return top, end


def tabular(g: dict[str, np.ndarray], at: np.ndarray) -> bool:
    """Whether over half of the lines of the glyphs `at` are rows of grids. Two columns are no grid: they are read one by
    one. A line that stands alone is a row if it has three parts."""
    number = np.where(g["space"][at], -1, cluster(g, at))
    lines = [GridLine(g, at[number == n]) for n in range(int(number.max(initial=-1)) + 1)]
    if len(lines) == 1:
        return lines[0].parts >= 3 and not lines[0].mono
    covered = i = 0
    while i < len(lines):
        top, end = grid_at(lines, i) if lines[i].parted and not lines[i].mono else (i, i)
        covered += end - top
        i = max(end, i + 1)
    return covered * 2 > len(lines)


def split(g: dict[str, np.ndarray], at: np.ndarray, depth: int = 0) -> list[np.ndarray]:
    """The glyphs `at` as regions in reading order: bands from top to bottom, else columns from left to right, unless most
    lines are rows of a grid."""
    real = at[~g["space"][at]]
    if depth >= DEPTH or len(real) < 2:
        return [at]
    em = float(np.median(g["size"][real]))
    cuts = clear_cuts(g["bottom"][real], g["top"][real], ROW_GAP * em)
    if len(cuts):
        part = -np.searchsorted(cuts, (g["bottom"] + g["top"])[at] / 2)
    else:
        ys = np.sort(g["y"][real])
        tolerance = (1 + np.count_nonzero(np.diff(ys) > 0.5 * em)) // 12
        cuts = thin_cuts(g["left"][real], g["right"][real], max(GUTTER, GUTTER_EM * em), tolerance)
        if len(cuts) and tabular(g, at):
            return [at]
        part = np.searchsorted(cuts, (g["left"] + g["right"])[at] / 2)
    if not len(cuts):
        return [at]
    return [r for p in np.unique(part) for r in split(g, at[part == p], depth + 1)]


def cluster(g: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Line numbers of the glyphs `at`, from the top; -1 on lines of spaces alone.

    From the top down, a glyph joins the line with the nearest mean baseline within half the larger size. Glyphs that
    follow each other at one height and in one size join together: the first draws the mean to it.
    """
    y, size, box = g["y"][at], g["size"][at], g["top"][at] - g["bottom"][at]
    raised = (box > 0) & (g["top"][at] - y < 0.30 * size) & (y - g["bottom"][at] > 0.55 * size)
    y = np.where(raised, (g["top"][at] + g["bottom"][at]) / 2, y)
    order = np.lexsort((~g["space"][at], g["left"][at], -y))
    ys, ss = y[order], size[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(ys) != 0) | (np.diff(ss) != 0)])) if len(at) else np.zeros(0, int)
    number, sums, counts, sizes, live = np.zeros(len(at), int), [], [], [], []
    for a, b in zip(starts, [*starts[1:], len(at)]):
        best, near = -1, np.inf
        for i in live:
            away = abs(sums[i] / counts[i] - ys[a])
            if away <= 0.5 * max(sizes[i], ss[a]) and away < near:
                best, near = i, away
        if best < 0:
            best = len(sums)
            sums, counts, sizes = [*sums, 0.0], [*counts, 0], [*sizes, 0.0]
            live.append(best)
        sums[best] += ys[a] * (b - a)
        counts[best] += b - a
        sizes[best] = max(sizes[best], ss[a])
        number[order[a:b]] = best
    x0 = [g["left"][at][number == i].min() for i in range(len(sums))]
    inked = [bool((~g["space"][at][number == i]).any()) for i in range(len(sums))]
    rank = {i: n for n, i in enumerate(sorted((i for i in range(len(sums)) if inked[i]), key=lambda i: (-sums[i] / counts[i], x0[i])))}
    return np.array([rank.get(i, -1) for i in range(len(sums))], int)[number] if len(at) else number


def page_lines(glyphs: DataFrame, columns: bool = True) -> DataFrame:
    """glyphs with region and line_no (-1: a line of spaces alone), both from 0 in reading order; null ids are one
    document. With columns=False a page is one region. Null sizes count as the default size; glyphs without a box or
    a baseline are dropped."""
    needed = ["y", "left", "right", "bottom", "top"]
    schema = StructType([*glyphs.schema.fields, StructField("region", LongType()), StructField("line_no", LongType())])

    def run(page: pd.DataFrame) -> pd.DataFrame:
        g = {c: page[c].to_numpy(float) for c in needed} | {"size": page["size"].fillna(DEFAULT_SIZE).to_numpy(float), "space": page["space"].fillna(False).to_numpy(bool)}
        if {"mono", "ch"} <= set(page.columns):
            g |= {"mono": page["mono"].fillna(False).to_numpy(bool), "code": page["ch"].map(lambda c: ord(c[0]) if c else 0).to_numpy(int)}
        region, line = np.zeros(len(page), int), np.zeros(len(page), int)
        every = np.arange(len(page))
        for r, at in enumerate(split(g, every) if columns else [every]):
            region[at], line[at] = r, cluster(g, at)
        return page.assign(region=region, line_no=line)

    return glyphs.dropna(subset=needed).groupBy("doc_id", "page").applyInPandas(run, schema)
