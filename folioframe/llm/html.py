"""Main text of HTML pages: wrapper induction over pages of a host, aligned by simple tree matching."""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, materialize, salted_join, tidied

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++|<)", re.S
)
NAMED = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head".split())
#: What an open element is closed by: a start tag of these, up to the nearest of the bounds.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset(["html"])),
}
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select option menu dialog svg head title textarea input label object embed canvas audio video noembed noframes xmp fieldset".split())
#: What a name in a class, id or role must end with to mark what is not the article, unless part of it says otherwise.
#: Only INNER counts inside an article: its own headers and notices belong to it.
INNER = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored sponsors promo promos comment comments commentlist disqus replies share sharing social related recommended recommendations newsletter subscribe signup cookie cookies consent widget widgets".split())
MARKS = INNER | frozenset(
    "promotion promoted banner banners gdpr notice notices alert popup modal overlay sidebar side sidenav rail menu menus nav navbar navigation breadcrumb breadcrumbs toolbar footer foot copyright disclaimer masthead topbar reply respond discussion follow trending "
    "subscription login search pagination pager skip complementary contentinfo header".split()
)
ARTICLE = frozenset("article post entry story content main body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Trees deeper than this are matched below it by their tags' path and their number along it.
DEEPEST = 1_000
#: Elements whose paths, down to this depth, are a page's layout; the pages from which a layout has a model page of its
#: own, and the most of these of a host. Pages of other layouts take the model that is most alike.
FRAMES, FRAME_DEPTH, LAYOUT_PAGES, LAYOUTS = frozenset("html body div section article main nav header footer aside table form center".split()), 4, 3, 8
#: Different pages that must agree, and their share of those that have the slot.
AGREE, SHARE = 2, 0.5
#: Slots of rotating notices: pages that have the slot, and the share of them whose text there is on AGREE pages or more.
ROTATING_PAGES, ROTATING = 4, 0.8
#: Characters of model pages up to which they are broadcast; else rows carry them.
MOST_BROADCAST = 32_000_000


class Node:
    """mark: 0 for what may be the article, 1 for what its names say isn't outside an article, 2 for anywhere."""

    __slots__ = ("tag", "mark", "children", "parent", "text", "number", "shape", "same")

    def __init__(self, tag: str, mark: int, parent):
        self.tag, self.mark, self.parent, self.children, self.text, self.number = tag, mark, parent, [], None, -1
        self.shape = self.same = -1


def parse(page: str) -> Node:
    """A tree of block elements; inline elements' text belongs to the block around them. Leaves hold blocks of text."""
    root = Node("#root", 0, None)
    at, end, pos, buffer = root, len(page), 0, []
    inline_drop = 0
    match = TOKEN.match

    def flush():
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                leaf = Node("#text", 0, at)
                leaf.text = text
                at.children.append(leaf)

    while pos < end:
        m = match(page, pos)
        pos = m.end()
        text = m[8]
        if text is not None:
            if not inline_drop:
                buffer.append(entities.unescape(text) if "&" in text else text)
            continue
        tag = m[3] or m[6]
        if tag is None:
            if m[1] and not inline_drop:
                buffer.append(m[1])
            continue
        tag, closing, rest = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if closing:
            if tag in BLOCK or tag in DROPPED:
                up = at
                while up is not root and up.tag != tag:
                    if up.tag in ("table", "td") and tag not in ("table", "tbody", "thead", "tfoot", "tr", "html", "body", "article", "main", "div", "section"):
                        up = root
                        break
                    up = up.parent
                if up is not root:
                    flush()
                    at = up.parent
            continue
        if tag in RAW and not rest.rstrip().endswith("/"):
            stop = RAW[tag].search(page, pos)
            pos = stop.end() if stop else end
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                buffer.append(" ")
            continue
        if tag not in BLOCK and tag not in DROPPED:
            if not rest or _mark(rest) < 2 or tag in VOID:
                continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if tag in BLOCK:  # a paragraph ends where a block begins
            up = at
            while up is not root and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            up = at
            while up is not root and up.tag not in bounds:
                if up.tag in ends:
                    at = up.parent
                up = up.parent
        node = Node(tag, _mark(rest) if rest else 0, at)
        at.children.append(node)
        at = node
        if tag not in BLOCK and tag not in DROPPED:  # a marked inline element: until its own end tag
            depth, close = 1, re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I)
            for x in close.finditer(page, pos):
                depth += -1 if x[1] else 1
                if not depth:
                    pos = x.end()
                    break
            at.parent.children.pop()
            at = at.parent
    flush()
    return root


def _mark(attributes: str) -> int:
    found = 0
    for m in NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = [p for p in re.split(r"[^a-z]+", name) if p]
            if parts and parts[-1] in MARKS and not ARTICLE.intersection(parts[:-1]):
                found = max(found, 2 if parts[-1] in INNER else 1)
    return found


class Shapes:
    """Numbers of subtrees that are alike in tags and marks, with the weights of their simple tree matching."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.held: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> None:
        """Sets each node's shape, and a number that only subtrees with equal texts share."""
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children)
        for node in reversed(order):
            node.shape = self._of((node.tag, node.mark, *[c.shape for c in node.children]))
            node.same = self._of((node.tag, node.mark, node.text, *[("=", c.same) for c in node.children]))

    def _of(self, key: tuple) -> int:
        if key not in self.known:
            self.known[key] = len(self.parts)
            self.parts.append(key)
        return self.known[key]

    def weight(self, a: int, b: int, depth: int = 0) -> int:
        """Nodes of the largest match of two shapes that keeps order and parents, with equal tags and marks; 0: none."""
        x, y = self.parts[a], self.parts[b]
        if x[:2] != y[:2]:
            return 0
        if a > b:
            a, b, x, y = b, a, y, x
        if (a, b) not in self.held:
            xs, ys = x[2:], y[2:]
            low = 0
            while low < min(len(xs), len(ys)) and xs[low] == ys[low]:
                low += 1
            high = 0
            while high < min(len(xs), len(ys)) - low and xs[-1 - high] == ys[-1 - high]:
                high += 1
            total = 1 + sum(self.weight(s, s, depth + 1) for s in (*xs[:low], *xs[len(xs) - high :])) if depth < DEEPEST else 1
            mid_x, mid_y = xs[low : len(xs) - high], ys[low : len(ys) - high]
            if mid_x and mid_y and depth < DEEPEST:
                kinds_x, kinds_y = list(dict.fromkeys(mid_x)), list(dict.fromkeys(mid_y))
                table = np.array([[self.weight(s, t, depth + 1) for t in kinds_y] for s in kinds_x])
                ix, iy = {s: i for i, s in enumerate(kinds_x)}, {s: i for i, s in enumerate(kinds_y)}
                total += int(_rows(table[[ix[s] for s in mid_x]][:, [iy[s] for s in mid_y]])[-1])
            self.held[a, b] = total
        return self.held[a, b]


def _rows(weights: np.ndarray, came: list | None = None) -> np.ndarray:
    """The best sums of an order-keeping match, by its last row; `came` gets, for each row, where a step down or to the
    right loses nothing."""
    above = np.zeros(weights.shape[1] + 1, np.int64)
    for w in weights:
        row = np.zeros_like(above)
        np.maximum(above[1:], above[:-1] + w, out=row[1:])
        np.maximum.accumulate(row, out=row)
        if came is not None:
            came.append((np.packbits(row == above), np.packbits(np.concatenate([[True], row[1:] == row[:-1]]))))
        above = row
    return above


def tree_match(a: Node, b: Node, shapes: Shapes) -> dict[int, Node]:
    """Simple tree matching: leaves of `a` with those of `b` in the largest match that keeps order and parents; a text
    that is equal, or a subtree, counts one more. Children that are equal at either end are matched first, which loses
    nothing; the rest is a table of rows, of which only the steps are kept."""
    pairs: dict[int, Node] = {}
    stack = [(a, b, 0)]
    while stack:
        x, y, depth = stack.pop()
        if x.text is not None:
            pairs[id(x)] = y
            continue
        if depth > DEEPEST:
            there = dict(paths(y))
            pairs.update((id(leaf), there[k]) for k, leaf in paths(x) if k in there)
            continue
        xs, ys = x.children, y.children
        low = 0
        while low < min(len(xs), len(ys)) and xs[low].same == ys[low].same:
            low += 1
        high = 0
        while high < min(len(xs), len(ys)) - low and xs[-1 - high].same == ys[-1 - high].same:
            high += 1
        stack += [(p, q, depth + 1) for p, q in zip(xs[:low], ys[:low])]
        if high:
            stack += [(p, q, depth + 1) for p, q in zip(xs[-high:], ys[-high:])]
        xs, ys = xs[low : len(xs) - high], ys[low : len(ys) - high]
        if not xs or not ys:
            continue
        if len(xs) == 1 == len(ys):
            if xs[0].tag == ys[0].tag and xs[0].mark == ys[0].mark:
                stack.append((xs[0], ys[0], depth + 1))
            continue
        kinds_x, kinds_y = (list(dict.fromkeys(n.shape for n in side)) for side in (xs, ys))
        table = 2 * np.array([[shapes.weight(s, t, depth + 1) for t in kinds_y] for s in kinds_x], np.int64)
        ix, iy = {s: i for i, s in enumerate(kinds_x)}, {s: i for i, s in enumerate(kinds_y)}
        weights = table[[ix[n.shape] for n in xs]][:, [iy[n.shape] for n in ys]]
        weights += (np.array([n.same for n in xs])[:, None] == np.array([n.same for n in ys])[None]) & (weights > 0)
        came: list = []
        _rows(weights, came)
        i, j = len(xs), len(ys)
        while i and j:
            up, left = came[i - 1]
            if up[j >> 3] >> (7 - (j & 7)) & 1:
                i -= 1
            elif left[j >> 3] >> (7 - (j & 7)) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                stack.append((xs[i], ys[j], depth + 1))
    return pairs


def paths(root: Node) -> list[tuple[tuple[int, int], Node]]:
    """Leaves with their tags' path from the root, as a hash, and their number among those of the same path."""
    out, seen, stack = [], {}, [(root, 0)]
    while stack:
        node, path = stack.pop()
        if node.text is not None:
            seen[path] = seen.get(path, -1) + 1
            out.append(((path, seen[path]), node))
        stack.extend((c, hash((path, c.tag, c.mark))) for c in reversed(node.children))
    return out


def layout(root: Node) -> frozenset[str]:
    """Paths of the elements that frame a page."""
    out, stack = set(), [(root, "", 0)]
    while stack:
        node, path, depth = stack.pop()
        for c in node.children:
            if c.tag in FRAMES and depth < FRAME_DEPTH:
                below = f"{path}/{c.tag}{'!' * c.mark}"
                out.add(below)
                stack.append((c, below, depth + 1))
    return frozenset(out)


def text_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def leaves(root: Node) -> list[tuple[Node, bool, bool]]:
    """(leaf, dropped by what its elements are, inside an article) in page order; leaves are numbered."""
    out, stack = [], [(root, False, False)]
    while stack:
        node, dropped, inside = stack.pop()
        if node.text is not None:
            node.number = len(out)
            out.append((node, dropped, inside))
            continue
        main = node.tag in ("article", "main")
        marked = node.mark > (1 if inside else 0) and not main and node.tag not in ("body", "html")
        dropped = dropped or node.tag in DROPPED or marked or (node.tag == "header" and not inside)
        inside = inside or (main and not dropped)
        stack.extend((c, dropped, inside) for c in reversed(node.children))
    return out


def align(page: Node, model: Node, shapes: Shapes) -> dict[int, int]:
    """Number of the model's leaf for each of the page's leaves that is matched."""
    pairs = tree_match(page, model, shapes)
    return {leaf.number: pairs[id(leaf)].number for leaf, _, _ in leaves(page) if id(leaf) in pairs}


def main_text(page: Node, template: dict[int, set[int]], matched: dict[int, int]) -> tuple[str, bool]:
    """Blocks of the article, or of the whole page where no element says it is one, but for the template's texts by
    slot; and whether the template took any. Where nothing would be left, first the template and then marks are passed over."""
    found = leaves(page)
    articles = any(inside and not dropped for _, dropped, inside in found)
    kept = [leaf for leaf, dropped, inside in found if not dropped and (inside or not articles)]
    own = [leaf for leaf in kept if text_hash(leaf.text) not in template.get(matched.get(leaf.number), ())] if template else kept
    if not kept:
        own = kept = [leaf for leaf, _, _ in found if not _unread(leaf)]
    return "\n".join(x.text for x in own or kept), len(own or kept) < len(kept)


def _unread(node: Node) -> bool:
    """Inside an element that holds no text of the article whatever its names."""
    while node is not None:
        if node.tag in DROPPED or node.mark == 2:
            return True
        node = node.parent
    return False


class Models:
    """Parsed model pages, kept for the hosts met last."""

    def __init__(self, most: int = 200):
        self.most, self.held, self.shapes = most, {}, Shapes()

    def get(self, text: str) -> tuple[Node, frozenset[str], list[str]]:
        key = (len(text), crc32(text.encode("utf-8", "surrogatepass")))
        if key not in self.held:
            if len(self.held) >= self.most or len(self.shapes.parts) > 200_000:
                self.held.clear()
                self.shapes = Shapes()
            tree = parse(text)
            self.shapes.number(tree)
            texts = [x.text for x, _, _ in leaves(tree)]
            self.held[key] = tree, layout(tree), texts
        return self.held[key]

    def nearest(self, page: Node, models: list[str]) -> int:
        """The place of the model whose layout is most like the page's; the first of equals."""
        if len(models) == 1:
            return 0
        own = layout(page)
        alike = [len(own & x) / max(len(own | x), 1) if own or x else 1.0 for x in (self.get(m)[1] for m in models)]
        return alike.index(max(alike))

    def match(self, page: Node, models: list[str]) -> tuple[int, dict[int, int]]:
        """The nearest model's place, and the page's leaves by its slots."""
        k = self.nearest(page, models)
        model = self.get(models[k])[0]
        self.shapes.number(page)
        return k, align(page, model, self.shapes)


def _with_models(rows: DataFrame, models: DataFrame, columns: list[str], extra: DataFrame | None = None, most: int | None = None):
    """Batches of `rows` (host, ...) beside each row's models and template slots: a frame and what reads its batches.

    The models go out by broadcast where they are small, else with the rows by a join in which hosts of many pages are
    dealt out.
    """
    held = models if extra is None else models.join(extra, "host", "left")
    size = held.agg(F.sum(F.expr("aggregate(models, 0L, (n, x) -> n + length(x))" + (" + 40 * coalesce(size(template), 0)" if extra is not None else "")))).first()[0] or 0
    if size <= (MOST_BROADCAST if most is None else most):
        sent = rows.sparkSession.sparkContext.broadcast({r["host"]: (r["models"], [x.asDict() for x in r["template"] or ()] if extra is not None else None) for r in held.collect()})

        def found(batch):
            for host in batch.column(0).to_pylist():
                yield sent.value.get(host, (None, None))

        return rows.select("host", *columns), found
    both = extra is not None
    joined = salted_join(rows, held, "host", hot_keys(rows, "host"), "page_id", how="left")

    def read(batch):
        yield from zip(batch.column(len(columns) + 1).to_pylist(), batch.column(len(columns) + 2).to_pylist() if both else repeat(None))

    return joined.select("host", *columns, "models", *(["template"] if both else [])), read


def extract(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars, wrapped (whether the template took any block) of every page.

    Pages of a host are grouped by layout. Each of its larger layouts has a model page, that of the smallest page_id
    with text, and so has the largest one however small. A page is aligned with the model most alike. A slot whose text
    two pages or more, and half of those that have it, share with the model is template; so are a slot's repeated texts
    where nearly all that stand there are repeated, as rotating notices are. Pages of the same html have one vote, so
    repeated pages keep their text. Pages of a host of their own, without url or host, are judged by their elements
    alone. Null and empty html gives an empty text. Repeated rows are extracted alike; rows of one page_id with
    different html are pages of their own, and of these the least html is the model.
    """
    host = F.lower(F.regexp_extract(F.col("url"), r"://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", F.when(host != "", host))

    def shapes(batches):
        for b in tidied(batches):
            found = []
            for page in b.column(2).to_pylist():
                tree = parse(page)
                text = any(not dropped for _, dropped, _ in leaves(tree))
                found.append(text_hash("\n".join(sorted(layout(tree)))) if text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["host", "page_id", "shape"])

    shaped = rows.where("host is not null and page_id is not null and html is not null").select("host", "page_id", "html").mapInArrow(shapes, "host string, page_id long, shape long").where("shape is not null")
    sized = shaped.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))
    sized = sized.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "page_id"))).where((F.col("place") == 1) | (F.col("n") >= LAYOUT_PAGES) & (F.col("place") <= LAYOUTS))
    first = materialize(sized.select("host", "page_id", "place"), "html-first")  # else pages would be dealt by host alone, as its aggregate is
    # several rows of one page_id: the least html that is not empty
    picked = rows.join(first, ["host", "page_id"]).where("html <> ''").groupBy("host", "place").agg(F.min("html").alias("model"))
    models = materialize(picked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "model"))), lambda x: x["model"]).alias("models")), "html-models")
    voters, read = _with_models(rows.where("html is not null"), models, ["html"], most=most)

    def vote(batches):
        held, votes = Models(), {}
        for b in tidied(batches):
            for host, page, (models, _) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), read(b)):
                if not models:
                    continue
                tree, code = parse(page), text_hash(page)
                k, found = held.match(tree, models)
                texts = held.get(models[k])[2]
                for leaf, dropped, _ in leaves(tree):
                    slot = found.get(leaf.number)
                    if slot is not None and not dropped:
                        votes[host, k, slot, text_hash(leaf.text), texts[slot] == leaf.text, code] = None
            if len(votes) > 100_000:
                yield out(votes)
                votes = {}
        if votes:
            yield out(votes)

    def out(votes):
        kinds = pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in votes], t) for i, t in enumerate(kinds)], ["host", "k", "slot", "code", "same", "page"])

    votes = voters.mapInArrow(vote, "host string, k int, slot int, code long, same boolean, page long").distinct()
    texts = votes.groupBy("host", "k", "slot", "code", "same").agg(F.count("*").alias("n"))
    # texts on fewer pages are only counted, so that a slot's list stays short
    slots = texts.groupBy("host", "k", "slot").agg(F.sum("n").alias("n"), F.max(F.when(F.col("same"), F.struct("n", "code"))).alias("own"), F.collect_list(F.when(F.col("n") >= AGREE, F.col("code"))).alias("codes"), F.sum(F.when(F.col("n") >= AGREE, F.col("n"))).alias("repeated"))
    fixed = F.coalesce((F.col("own.n") >= AGREE) & (F.col("own.n") >= SHARE * F.col("n")), F.lit(False))
    turning = (F.col("n") >= ROTATING_PAGES) & (F.coalesce("repeated", F.lit(0)) >= ROTATING * F.col("n"))
    slots = slots.select("host", F.struct("k", "slot", F.when(fixed, F.col("own.code")).alias("own"), F.when(turning, F.col("codes")).alias("codes")).alias("s")).where("s.own is not null or s.codes is not null")
    constant = materialize(slots.groupBy("host").agg(F.collect_list("s").alias("template")), "html-template")
    placed, read_both = _with_models(rows, models, ["page_id", "url", "html"], constant, most)

    def run(batches):
        held = Models()
        for b in tidied(batches):
            texts, wrapped = [], []
            for page, (models, slots) in zip(b.column(3).to_pylist(), read_both(b)):
                tree, found, template = parse(page or ""), {}, {}
                if slots:
                    k, found = held.match(tree, models)
                    template = {x["slot"]: {*(x["codes"] or ()), *([x["own"]] if x["own"] is not None else ())} for x in slots if x["k"] == k}
                text, less = main_text(tree, template, found)
                texts.append(text)
                wrapped.append(less)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(wrapped)], ["page_id", "url", "text", "n_chars", "wrapped"])

    return placed.mapInArrow(run, "page_id long, url string, text string, n_chars long, wrapped boolean")
