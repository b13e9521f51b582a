"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

A word's count in a class is the number of distinct words it follows there (Kneser-Ney's continuation count), so copies
of a text add nothing. Of that count a class keeps what exceeds the modified Kneser-Ney discount and a multiple of what
the counts of both classes together make us expect; all else goes to those shared counts, at one weight a class. So
ordinary and rare words have the same log ratio in both classes, and only words with evidence of their own differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MODEL_CHUNK_CHARS, carried, chunks, crc_mod, extended, hot_keys, materialize, release, salted_join, split_words, tidied
from .kneser_ney import discounts
from .labelled import labelled

#: How far from the shared expectation (0) to a word of that class alone (1) a count must lie to be kept.
BEYOND = 0.4
#: Words of a passage, by which its log-likelihood difference is divided.
PASSAGE = 24
THRESHOLD = 0.7
#: Words with evidence up to which they are broadcast: 16 bytes each.
MOST_BROADCAST = 2_000_000
START = 0


def word_keys(words: list[str]) -> np.ndarray:
    """Hashes of the words without the signs around them; START is never one."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.strip(".,;:!?\"'()[]{}«»“”‘’*_-…").encode("utf-8", "surrogatepass")) | 1 for w in words), np.uint64, len(words)).view(np.int64)


def keyed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of distinct words in lower case, each word's place among them, and each text's number of words."""
    words, codes, counts = split_words(pc.utf8_lower(texts))
    return word_keys(words), codes, counts


def contexts(rows: DataFrame) -> DataFrame:
    """cls, half, word, before: each pair of neighbouring words of column text, once a chunk; START before a text."""

    def run(batches):
        for b in tidied(batches):
            for i, j in chunks(b.column(2), MODEL_CHUNK_CHARS):
                part = b.slice(i, j - i)
                cls, half = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                keys, codes, counts = keyed_words(part.column(2))
                before = np.concatenate([[0], codes[:-1] + 1]) if len(codes) else codes
                firsts = (np.cumsum(counts) - counts)[counts > 0]
                before[firsts] = 0
                kind = np.repeat(2 * cls + half, counts)
                n = len(keys) + 1
                pairs = np.unique((kind * n + before) * n + codes)
                ahead = np.concatenate([[START], keys])
                found = pairs // n
                kinds = (found // n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kinds // 2), pa.array(kinds % 2), pa.array(keys[pairs % n]), pa.array(ahead[found % n])], ["cls", "half", "word", "before"])

    return rows.select("cls", "half", "text").mapInArrow(run, "cls int, half int, word long, before long")


def counted(rows: DataFrame) -> DataFrame:
    """word, n0, n1 (its continuation counts in both classes), h0, h1 (the same over the first half of the documents)."""
    each = contexts(rows).groupBy("word", "before", "cls").agg(F.min("half").alias("half"))
    one = lambda c, more=True: F.count_if((F.col("cls") == c) & more)
    return each.groupBy("word").agg(one(0).alias("n0"), one(1).alias("n1"), one(0, F.col("half") == 0).alias("h0"), one(1, F.col("half") == 0).alias("h1"))


class Model:
    """evidence: word, ratio (log ratio beyond that of all other words)."""

    def __init__(self, counts: DataFrame, names: tuple[str, str]):
        self.spark = counts.sparkSession
        c = counts.select("word", *[F.col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
        stats = c.agg(*[F.sum(f"c{i}").alias(f"m{i}") for i in (0, 1)], *[F.count_if(F.col(f"c{i}") == k).alias(f"k{i}{k}") for i in (0, 1) for k in (1, 2, 3, 4)]).first()
        self.totals = [float(stats[f"m{i}"] or 0) for i in (0, 1)]
        self.evidence = None
        if not all(self.totals):
            return
        both = sum(self.totals)
        shared = (F.col("c0") + F.col("c1")) / both
        for i in (0, 1):
            d = discounts(*[stats[f"k{i}{k}"] for k in (1, 2, 3, 4)])
            less = F.when(F.col(f"c{i}") >= 3, d[2]).when(F.col(f"c{i}") == 2, d[1]).otherwise(d[0])
            beyond = 1 + BEYOND * (both / self.totals[i] - 1)
            c = c.withColumn(f"kept{i}", F.greatest(F.col(f"c{i}") - less - beyond * self.totals[i] * shared, F.lit(0.0)))
        kept = materialize(c.where("kept0 > 0 or kept1 > 0").select("word", shared.alias("shared"), "kept0", "kept1"), "toxicity-kept")
        sums = kept.agg(F.sum("kept0"), F.sum("kept1")).first()
        rest = [1 - (sums[i] or 0.0) / self.totals[i] for i in (0, 1)]
        p = [F.col(f"kept{i}") / self.totals[i] + rest[i] * F.col("shared") for i in (0, 1)]
        self.evidence = kept.select("word", (F.log(p[1]) - F.log(p[0]) - float(np.log(rest[1] / rest[0]))).alias("ratio"))
        self.kept, self._sent, self._size = kept, None, None

    def size(self) -> int:
        if self._size is None:
            self._size = self.kept.count()
        return self._size

    def packed(self):
        if self._sent is None:
            got = self.evidence.toArrow()
            word, ratio = got["word"].to_numpy(), got["ratio"].to_numpy()
            order = np.argsort(word)
            self._sent = self.spark.sparkContext.broadcast((word[order], ratio[order]))
        return self._sent


def passage(places: np.ndarray, ratios: np.ndarray) -> float:
    """The largest sum of a passage that begins at a word with evidence, a word; 0 without any, and where all are less."""
    if not len(places):
        return 0.0
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    last = np.searchsorted(places, places + PASSAGE)
    return max(float((sums[last] - sums[: len(places)]).max()) / PASSAGE, 0.0)


def features(docs: DataFrame, model: Model, most: int | None = None) -> DataFrame:
    """docs with ratio: the length-normalised log-likelihood difference of the most toxic passage of column text."""
    if model.evidence is None:
        return docs.withColumn("ratio", F.lit(0.0))
    place, schema = docs.columns.index("text"), extended(docs, "ratio")
    if model.size() <= (MOST_BROADCAST if most is None else most):
        sent = model.packed()

        def run(batches):
            words, ratios = sent.value
            for b in tidied(batches):
                for i, j in chunks(b.column(place), MODEL_CHUNK_CHARS):
                    part = b.slice(i, j - i)
                    keys, codes, counts = keyed_words(part.column(place))
                    where = np.minimum(np.searchsorted(words, keys), max(len(words) - 1, 0))
                    known = words[where] == keys if len(words) else np.zeros(len(keys), bool)
                    at = np.flatnonzero(known[codes]) if len(codes) else np.zeros(0, np.int64)
                    values = ratios[where[codes[at]]] if len(at) else np.zeros(0)
                    starts = np.cumsum(counts) - counts
                    lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + counts)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([passage(at[x:y], values[x:y]) for x, y in zip(lo, hi)], pa.float64())], [*part.schema.names, "ratio"])

        return docs.mapInArrow(run, schema)

    def spread(batches):
        for b in tidied(batches):
            for i, j in chunks(b.column(1), MODEL_CHUNK_CHARS):
                keys, codes, counts = keyed_words(b.column(1).slice(i, j - i))
                owner = np.repeat(b.column(0).slice(i, j - i).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)), pa.array(keys[codes])], ["_row", "at", "word"])

    def gathered(batches):
        for b in tidied(batches):
            found = [passage(np.array([x["at"] for x in r]), np.array([x["ratio"] for x in r])) for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["_row", "ratio"])

    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "toxicity-docs")
    words = rows.select("_row", "text").mapInArrow(spread, "_row long, at long, word long")
    found = salted_join(words, model.evidence, "word", hot_keys(words, "word"), "at")
    sums = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "ratio"))).alias("x")).mapInArrow(gathered, "_row long, ratio double")
    return rows.join(sums, "_row", "left").fillna(0.0, ["ratio"]).select(*docs.columns, "ratio")


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope (0 at least) of a logistic curve with a slight ridge, by Newton's steps."""
    a, w = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    ridge = np.diag([1e-6, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 20 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    if w[1] < 0:
        rate = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        return float(np.log(rate / (1 - rate))), 0.0
    return float(w[0]), float(w[1])


class ToxicityClassifier:
    """Learns from labelled documents: the second half's differences under the first half's counts set the one offset
    and slope that turn a difference into a score; the final counts are both halves'. Without both labels every score
    is 0."""

    def fit(self, docs: DataFrame, labels: DataFrame, fold=None) -> ToxicityClassifier:
        found = labelled(docs, labels, "toxic", fold)
        rows = found.select("text", F.col("label").alias("cls"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))
        counts = materialize(counted(rows.where("cls in (0, 1)")), "toxicity-counts")
        self.model, self.curve = Model(counts, ("n0", "n1")), None
        first = Model(counts, ("h0", "h1"))
        if self.model.evidence is not None and first.evidence is not None:
            seen = features(rows.where("half = 1 and cls in (0, 1)").select("cls", "text"), first).select("cls", "ratio").toPandas()  # two numbers for each of them
            if 0 < seen.cls.sum() < len(seen):
                self.curve = calibrate(seen.ratio.to_numpy(), seen.cls.to_numpy().astype(float))
            release(first.kept)
        release(counts, found)
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with ratio and score (0 to 1)."""
        if self.curve is None:
            return docs.withColumn("ratio", F.lit(0.0)).withColumn("score", F.lit(0.0))
        return features(docs, self.model).withColumn("score", 1 / (1 + F.exp(-(self.curve[0] + self.curve[1] * F.col("ratio")))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, ratio of every document; learns only from ids whose crc32 mod 3 is not 1.

    Null and empty texts score what no evidence scores. Null ids are not held out. Repeated rows are scored alike. A text
    is read in one piece, however long. A score equal to THRESHOLD is predicted toxic.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = ToxicityClassifier().fit(docs, labels, crc_mod(F.col("doc_id"), 3) != 1).score(rows)
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "ratio")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with their columns, whatever these are called. Learns from every label."""
    own, back = carried(docs, "text")
    return back(ToxicityClassifier().fit(docs, labels).score(own).where(F.col("score") < THRESHOLD))
