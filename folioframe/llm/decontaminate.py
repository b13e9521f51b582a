"""Benchmark decontamination by typed templates."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MODEL_CHUNK_CHARS, chunks, split_words, tidied

#: Words in a window, the share of an item's windows that a document must hold, and of its slots' uses that agree: all.
WINDOW, SIMILARITY, CONSISTENT = 5, 0.8, 1.0
#: Items whose windows are broadcast at a time; more items take more passes.
ITEMS_A_PASS = 50_000
NUMBER, NAME, UNIT = 1, 2, 3
UNITS = frozenset(
    "kg g mg lb lbs oz km m cm mm mi mile miles meter meters metre metres inch inches ft feet foot yard yards second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees liter liters litre litres ml l kmh mph "
    "kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres millimeter millimeters millimetre millimetres kilogram kilograms gram grams milligram milligrams pound pounds ounce ounces ton tons tonne tonnes stone "
    "gallon gallons quart quarts pint pints cup cups tablespoon tablespoons teaspoon teaspoons milliliter milliliters millilitre millilitres acre acres hectare hectares decade decades century centuries".split()
)
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMERALS = frozenset(["zero", *ONES, *"ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), *TENS, *(f"{t}-{o}" for t in TENS for o in ONES), *"dozen hundred thousand million billion trillion".split()])
NUMBER_WORD = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|e[+-]?\d+)?$")
EDGES = re.compile(r"^\W+|\W+$")
MULTIPLIER = np.uint64(0x100000001B3)


class Words:
    """What each distinct word gives: hash of its bare lower-case form, kind, and whether it ends a sentence."""

    def __init__(self, words: list[str]):
        import xxhash

        self.bare = [EDGES.sub("", w) for w in words]
        self.hash = np.array([xxhash.xxh3_64_intdigest(b.lower()) for b in self.bare], np.uint64)
        self.empty = np.array([not b for b in self.bare], bool)
        self.kind = np.array([NUMBER if NUMBER_WORD.match(b) or b.lower() in NUMERALS else UNIT if b.lower() in UNITS else NAME if b[:1].isupper() and not b.isupper() else 0 for b in self.bare], np.int8)
        self.ends = np.array([w.rstrip("\"')]}»”’")[-1:] in set(".!?:;") for w in words], bool)


def templates(words: Words, codes: np.ndarray, counts: np.ndarray, sizes: tuple[int, ...] = ()):
    """Windows of texts: hash, text, first token and the window's name-reading hash; and per token: code, kind, text.

    Tokens without letters or digits are passed over. Texts of fewer words than WINDOW are one window; with `sizes`,
    texts have all their windows of these sizes instead. A capital inside a sentence is a name; where a sentence begins
    it may be one or not, so windows with such a word are given in both readings. Windows with fewer than two literal
    words keep their own words, as a bare template would fit anything."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.ones(len(codes), bool)
    first[1:] = (owner[1:] != owner[:-1]) | words.ends[codes[:-1]]
    full = ~words.empty[codes]
    codes, owner, first = codes[full], owner[full], first[full]
    kind = words.kind[codes].copy()
    either = (kind == NAME) & first
    raw = words.hash[codes]
    before = np.concatenate([[0], np.cumsum(either)])
    n = np.bincount(owner, minlength=len(counts)) if len(owner) else np.zeros(len(counts), np.int64)
    starts = np.cumsum(n) - n
    hashes, at, names = [], [], []

    def hashed(begin, size, kind):
        token = np.where(kind == 0, raw, kind.astype(np.uint64))
        h, bare, literal = np.full(len(begin), size, np.uint64), np.full(len(begin), size, np.uint64), np.zeros(len(begin), np.int8)
        for j in range(size):
            h = (h ^ token[begin + j]) * MULTIPLIER
            h ^= h >> np.uint64(31)
            bare = (bare ^ raw[begin + j]) * MULTIPLIER
            bare ^= bare >> np.uint64(31)
            literal += kind[begin + j] == 0
        return np.where(literal >= min(2, size), h, ~bare)

    for size in sizes or range(1, WINDOW + 1):
        texts = np.flatnonzero(n >= size) if sizes or size == WINDOW else np.flatnonzero(n == size)
        if not len(texts):
            continue
        many = n[texts] - size + 1
        begin = np.repeat(starts[texts] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        h = hashed(begin, size, kind)
        hashes.append(h)
        at.append(begin)
        names.append(h)
        twice = before[begin + size] > before[begin]
        if twice.any():
            hashes.append(hashed(begin[twice], size, np.where(either, 0, kind)))
            at.append(begin[twice])
            names.append(h[twice])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), codes, kind, owner
    begin = np.concatenate(at)
    order = np.argsort(begin, kind="stable") if len(at) > 1 else slice(None)
    return np.concatenate(hashes)[order], owner[begin[order]], begin[order], np.concatenate(names)[order], codes, kind, owner


class Index:
    """Windows of a set of items, made on the driver and sent out."""

    def __init__(self, ids: list, texts: list[str | None]):
        words, codes, counts = split_words(pa.array(texts, pa.string()))
        table = Words(words)
        h, item, at, name, token_codes, kind, owner = templates(table, codes, counts)
        order = np.lexsort((at, item, h))
        self.ids, self.hash, self.item, self.at = ids, h[order], item[order], at[order]
        self.token = [table.bare[c].lower() for c in token_codes]
        self.kind, self.owner = kind, owner
        pairs, window = np.unique(np.stack([self.item.astype(np.uint64), name[order]]), axis=1, return_inverse=True) if len(h) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
        self.window = window.reshape(-1)
        self.windows = np.bincount(pairs[0].astype(np.int64), minlength=len(ids))
        words_in = np.bincount(owner, minlength=len(ids)) if len(owner) else np.zeros(len(ids), np.int64)
        self.sizes = tuple(sorted({*np.minimum(words_in[words_in > 0], WINDOW).tolist()})) or (WINDOW,)
        self.keys = np.unique(self.hash)
        self.first = np.searchsorted(self.hash, self.keys)
        self.last = np.searchsorted(self.hash, self.keys, "right")
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(13)).astype(np.int64) & (len(self.filter) - 1)] = True

    def matches(self, texts: pa.Array) -> list[tuple[int, int, float, float, bool]]:
        """(text, item, similarity, slots' consistency, same words) of every contaminated text."""
        words, codes, counts = split_words(texts)
        table = Words(words)
        h, text, at, _, token_codes, kind, _ = templates(table, codes, counts, self.sizes)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(13)).astype(np.int64) & (len(self.filter) - 1)])
        where = np.minimum(np.searchsorted(self.keys, h[maybe]), max(len(self.keys) - 1, 0))
        hit = self.keys[where] == h[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
        maybe, where = maybe[hit], where[hit]
        out = []
        bounds = np.flatnonzero(np.diff(text[maybe], prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(maybe)]):
            found: dict[int, dict[int, tuple[int, list[int]]]] = {}  # item, window: its first token and where it is held
            for m, k in zip(maybe[a:b].tolist(), where[a:b].tolist()):
                for x in range(self.first[k], self.last[k]):
                    found.setdefault(int(self.item[x]), {}).setdefault(int(self.window[x]), (int(self.at[x]), []))[1].append(int(at[m]))
            for item, hits in found.items():
                similarity = len(hits) / int(self.windows[item])
                if similarity >= SIMILARITY:
                    slots, same = self._slots(hits, table, token_codes, kind)
                    if slots >= CONSISTENT:
                        out.append((int(text[maybe[a]]), item, similarity, slots, same))
        return out

    def _slots(self, hits, table: Words, codes: np.ndarray, kind: np.ndarray) -> tuple[float, bool]:
        """Share of the item's slots that stand for one and the same value throughout, and whether all values are its own.

        A document may hold a window more than once: the place that most other windows' places agree with is followed,
        of equal ones that which continues the window before it.
        """
        votes: dict[str, dict[str, int]] = {}
        shifts = Counter(p - begin for begin, places in hits.values() for p in {*places})
        last, same = None, True
        for begin, places in sorted(hits.values()):
            place = min(places, key=lambda p: (-shifts[p - begin], abs((p - begin) - last) if last is not None else p))
            last = place - begin
            size = min(WINDOW, len(self.kind) - begin, len(kind) - place)
            for j in range(size):
                if self.owner[begin + j] == self.owner[begin] and self.kind[begin + j]:
                    value = table.bare[codes[place + j]].lower()
                    own = votes.setdefault(self.token[begin + j], {})
                    own[value] = own.get(value, 0) + 1
                    same &= value == self.token[begin + j]
        total = sum(sum(v.values()) for v in votes.values())
        return (sum(max(v.values()) for v in votes.values()) / total if total else 1.0), same


def _indexes(benchmark: DataFrame):
    """An Index for each slice of at most about ITEMS_A_PASS items. Null and empty items have no window."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    parts = -(-items.count() // ITEMS_A_PASS)
    for k in range(parts):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow()
        yield Index(got["item_id"].to_pylist(), got["text"].to_pylist())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, consistency, verbatim: a row for each document and item of which the document holds
    at least SIMILARITY of the template windows, with consistent slots. Null ids are reported as null; null and empty
    texts match nothing; repeated rows repeat."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, consistency double, verbatim boolean"
    out = None
    for index in _indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            for b in tidied(batches):
                ids = b.column(0)
                for i, j in chunks(b.column(1), MODEL_CHUNK_CHARS):
                    got = index.matches(b.column(1).slice(i, j - i))
                    if got:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([i + x[0] for x in got])), pa.array([index.ids[x[1]] for x in got], pa.int64()), *[pa.array([x[k] for x in got]) for k in (2, 3, 4)]], ["doc_id", "item_id", "similarity", "consistency", "verbatim"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns; judged where they lie, nothing is shuffled."""
    spark, place = docs.sparkSession, docs.columns.index("text")
    for index in _indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in tidied(batches):
                keep = np.ones(len(b), bool)
                texts = b.column(place).cast(pa.string())
                for i, j in chunks(texts, MODEL_CHUNK_CHARS):
                    for x in sent.value.matches(texts.slice(i, j - i)):
                        keep[i + x[0]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
