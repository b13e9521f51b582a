"""Interpolated modified Kneser-Ney model over the characters of words.

A word is read as BOS x (N-1), its characters, EOS, so a model of a few million n-grams covers unseen words. A word that
equals the word before it is read as one symbol, REPEAT, so that the model itself finds repetition improbable. Counting,
discounts and probabilities are Spark aggregations and joins over n-grams dealt by hash: no key there has more rows
than the alphabet has symbols.

Logarithms are whole multiples of 1 / SCALE, so sums don't depend on their order, and both ways of scoring agree
exactly: each distinct word of a batch against the broadcast model, where that has at most MOST_BROADCAST n-grams, else
joins of distinct words with the n-gram tables.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MODEL_CHUNK_CHARS, Growing, WordCache, chunks, hot_keys, materialize, release, salted_join, split_words, tidied

BOS, EOS, REPEAT = "\x02", "\x03", "\x04"
#: What stands for a repeated word among words; no word holds a space.
REPEATED = "\x04 "
SCALE = 1 << 20
#: N-grams and contexts up to which the model is broadcast: at most 48 bytes each.
MOST_BROADCAST = 2_000_000
#: Words held by a counting task before they go out.
WORDS_HELD = 200_000
#: Words whose scores a scoring task keeps: some 150 bytes each.
WORDS_CACHED = 250_000
MIX, SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xCBF29CE484222325)


def clean(word: str) -> str:
    if word == REPEATED:
        return REPEAT
    return word.replace(BOS, " ").replace(EOS, " ").replace(REPEAT, " ") if BOS in word or EOS in word or REPEAT in word else word


def model_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """split_words(), with REPEATED in the place of each word that equals the one before in its text."""
    words, codes, counts = split_words(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    if again.any():
        codes = np.where(again, len(words), codes)
        words = [*words, REPEATED]
    return words, codes, counts


def with_words(rows: DataFrame) -> DataFrame:
    """rows with _words: the same words of column text, cleaned. The split stands by itself, so that it's done once a text."""
    split = rows.withColumn("_split", F.expr("filter(split(coalesce(text, ''), '[ \\t-\\r]+'), w -> w <> '')"))
    return split.withColumn("_words", F.expr(f"transform(_split, (w, i) -> if(i > 0 and get(_split, i - 1) = w, '{REPEAT}', translate(w, '{BOS}{EOS}{REPEAT}', '   ')))"))


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """part, g, n: top-order n-grams of column text, summed by column part (one of a few numbers)."""

    def run(batches):
        held: dict[int, Counter] = {}

        def out():
            for part, words in held.items():
                grams: dict[str, int] = {}
                for w, n in words.items():
                    s = BOS * (order - 1) + clean(w) + EOS
                    for i in range(len(s) - order + 1):
                        g = s[i : i + order]
                        grams[g] = grams.get(g, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), part, np.int32)), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["part", "g", "n"])
            held.clear()

        for batch in tidied(batches):
            for a, b in chunks(batch.column(1), MODEL_CHUNK_CHARS):
                parts, texts = batch.column(0).slice(a, b - a).to_numpy(), batch.column(1).slice(a, b - a)
                for part in np.unique(parts).tolist():
                    words, codes, _ = model_words(texts.filter(pa.array(parts == part)))
                    own = held.setdefault(part, Counter())
                    for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                        if n:
                            own[w] += n
                if sum(map(len, held.values())) > WORDS_HELD:
                    yield from out()
        yield from out()

    return texts.select(F.col("part").cast("int").alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, g string, n long").groupBy("part", "g").agg(F.sum("n").alias("n"))


class Model:
    """terms: k, g, lp (log probability of g's last symbol after the others); weights: k, ctx, lw (log weight of the
    lower order after ctx, which has k - 1 symbols); unseen: of a symbol that no order has. All in 1 / SCALE."""

    def __init__(self, spark: SparkSession, order: int, terms: DataFrame, unseen: int, weights: DataFrame):
        self.spark, self.order, self.terms, self.weights, self.unseen = spark, order, terms, weights, unseen
        self._packed = self._size = None

    def size(self) -> int:
        if self._size is None:
            self._size = self.terms.count() + self.weights.count()
        return self._size

    def packed(self):
        """Broadcast arrays: per order, sorted hashes of n-grams and contexts with their logs; hashed on the executors."""
        if self._packed is None:
            out = {}
            for name, df, text, value, less in (("lp", self.terms, "g", "lp", 0), ("lw", self.weights, "ctx", "lw", 1)):

                def hashed(batches, less=less):
                    for b in batches:
                        k, grams = b.column(0).to_numpy(), b.column(1).to_pylist()
                        h = np.zeros(len(k), np.uint64)
                        for o in np.unique(k):
                            at = np.flatnonzero(k == o)
                            h[at] = hash_rows(codes_of("".join([grams[i] for i in at.tolist()])).reshape(len(at), int(o) - less))
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64)), b.column(2)], ["k", "h", "v"])

                got = df.select(F.col("k").cast("int").alias("k"), text, F.col(value).cast("int").alias("v")).mapInArrow(hashed, "k int, h long, v int").toArrow()
                k, h, v = (got[c].to_numpy() for c in ("k", "h", "v"))
                for o in np.unique(k):
                    at = np.flatnonzero(k == o)
                    out[name, int(o)] = slots(h[at].view(np.uint64), v[at].astype(np.int32))
            self._packed = self.spark.sparkContext.broadcast((self.order, self.unseen, out))
        return self._packed

    def release(self) -> None:
        """Scratch tables and the broadcast go; nothing scores with the model any more."""
        release(self.terms, self.weights)
        if self._packed is not None:
            self._packed.unpersist()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hash_rows(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of symbols, never 0; the last symbol goes in first, so that longer n-grams go on."""
    h = np.full(len(codes), SEED, np.uint64)
    for j in range(codes.shape[1] - 1, -1, -1):
        h = longer(h, codes[:, j])
    return h | np.uint64(1)


def longer(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    h = (h ^ before.astype(np.uint64)) * MIX
    return h ^ (h >> np.uint64(29))


def slots(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table with open addressing, half full at most: keys (0: free) and values by place."""
    size = 1 << max(4, int(2 * len(keys) - 1).bit_length())
    held, out = np.zeros(size, np.uint64), np.zeros(size, np.int32)
    todo, place = np.arange(len(keys)), (keys >> np.uint64(7)).astype(np.int64) & (size - 1)
    while len(todo):
        free = held[place] == 0
        first = np.zeros(len(todo), bool)
        first[np.unique(place, return_index=True)[1]] = True
        put = free & first
        held[place[put]], out[place[put]] = keys[todo[put]], values[todo[put]]
        todo, place = todo[~put], (place[~put] + 1) & (size - 1)
    return held, out


def look_up(table: tuple[np.ndarray, np.ndarray] | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the table, and its value (0: none)."""
    found, value = np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    if table is None:
        return found, value
    keys, values = table
    todo, place = np.arange(len(wanted)), (wanted >> np.uint64(7)).astype(np.int64) & (len(keys) - 1)
    while len(todo):
        there = keys[place]
        hit = there == wanted[todo]
        found[todo[hit]], value[todo[hit]] = True, values[place[hit]]
        on = ~hit & (there != 0)
        todo, place = todo[on], (place[on] + 1) & (len(keys) - 1)
    return found, value


def log_of(p):
    return F.round(F.log(p) * SCALE).cast("long")


def train(texts: DataFrame, order: int = 5) -> Model:
    """Fit on rows (text). Null texts and empty tables count nothing."""
    grams = materialize(count_grams(texts.select(F.lit(0).alias("part"), "text"), order), "kn-grams")
    model = fit(grams, order)
    release(grams)
    return model


def fit(grams: DataFrame, order: int) -> Model:
    """Fit on rows (g, n) of count_grams(), of one part or several."""
    spark = grams.sparkSession
    levels = grams.select("g", "n", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("k"))
    parts = levels.groupBy("k", F.expr("substring(g, greatest(1, length(g) - k), least(k + 1, length(g)))").alias("with_left")).agg(F.sum("n").alias("n"))
    g = F.expr(f"if(k = {order}, with_left, substring(with_left, 2))")
    counts = parts.groupBy("k", g.alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("lefts"))
    raw = (F.col("k") == order) | F.col("g").startswith(BOS)
    counted = materialize(counts.select("k", "g", F.when(raw, F.col("n")).otherwise(F.col("lefts")).alias("c")), "kn-counts")
    of = {r.k: r for r in counted.groupBy("k").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count_distinct(F.expr("right(g, 1)")).alias("symbols")).collect()}
    case = F.create_map(*[F.lit(x) for k, r in of.items() for x in (k, discounts(r.n1, r.n2, r.n3, r.n4))]) if of else F.create_map(F.lit(0), F.lit([0.5, 1.0, 1.5]))
    counts = counted.withColumn("d", case[F.col("k")]).withColumn("ctx", F.expr("substring(g, 1, k - 1)"))
    of_c = F.expr("element_at(d, int(least(c, 3L)))")
    weights = counts.groupBy("k", "ctx").agg(F.sum("c").alias("total"), F.sum(of_c).alias("taken")).select("k", "ctx", "total", (F.col("taken") / F.col("total")).alias("w"))
    weights = materialize(weights.withColumn("lw", log_of(F.col("w"))), "kn-weights")
    kept = materialize(counts.withColumn("kept", F.greatest(F.lit(0.0), F.col("c") - of_c)).join(weights, ["k", "ctx"]).select("k", "g", (F.col("kept") / F.col("total")).alias("p"), "w"), "kn-kept")
    release(counted)
    terms, unseen = interpolated(kept, order, 1 / (of[1].symbols + 1 if 1 in of else 2))
    release(kept)
    return Model(spark, order, terms, unseen, weights.select("k", "ctx", "lw"))


def interpolated(kept: DataFrame, order: int, base: float) -> tuple[DataFrame, int]:
    """Terms from rows k, g, p (what the n-gram keeps) and w (weight of the next lower order): order by order, each
    n-gram joins the one without its first symbol, which has as many longer ones as there are symbols."""
    levels, below = [], None
    for o in range(1, order + 1):
        now = kept.where(F.col("k") == o)
        if below is None:
            now = now.select("k", "g", (F.col("p") + F.col("w") * base).alias("p"))
        else:
            lower = below.select(F.col("g").alias("tail"), F.col("p").alias("below"))
            now = now.join(lower, F.expr("substring(g, 2)") == F.col("tail")).select("k", "g", (F.col("p") + F.col("w") * F.col("below")).alias("p"))
        below = materialize(now, "kn-level")
        levels.append(below)
    every = levels[0]
    for x in levels[1:]:
        every = every.union(x)
    terms = materialize(every.select("k", "g", log_of(F.col("p")).alias("lp")), "kn-terms")
    release(*levels)
    return terms, round(float(np.log(base)) * SCALE)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney's three discounts; where counts of counts are too few, half a count each more."""
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), most) for d, most in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.95), (3 - 4 * y * n4 / n3, 2.95))]


class Scorer:
    """Log probabilities of words from a packed model."""

    def __init__(self, packed):
        self.order, self.unseen, self.tables = packed

    def words(self, words: list[str]) -> np.ndarray:
        """Rows of (log probability in 1 / SCALE, symbols read)."""
        n, pad = self.order, BOS * (self.order - 1)
        cleaned = [clean(w) for w in words]
        lengths = np.fromiter((len(w) + 1 for w in cleaned), np.int64, len(words))
        flat = codes_of("".join([pad + w + EOS for w in cleaned]))
        ends = np.cumsum(lengths + n - 1)
        at = np.repeat(ends - lengths, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        hashes = [np.full(len(flat), SEED, np.uint64)]  # by length, of the n-gram that ends at each symbol
        for k in range(1, n + 1):
            before = np.zeros_like(flat)
            before[k - 1 :] = flat[: len(flat) - k + 1]
            hashes.append(longer(hashes[-1], before))
        lp, todo = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(n, 0, -1):
            found, value = look_up(self.tables.get(("lp", k)), hashes[k][at[todo]] | np.uint64(1))
            lp[todo] += value
            todo = todo[~found]
            if not len(todo):
                break
            lp[todo] += look_up(self.tables.get(("lw", k)), hashes[k - 1][at[todo] - 1] | np.uint64(1))[1]
        lp[todo] += self.unseen
        total, e = np.concatenate([[0], np.cumsum(lp)]), np.cumsum(lengths)
        return np.stack([total[e] - total[e - lengths], lengths], axis=1)


class CachedScorer:
    """A Scorer whose words' rows are kept while a worker runs."""

    def __init__(self, packed):
        self.scorer = Scorer(packed)
        self.table = Growing(np.int64, 2)
        self.cache = WordCache(self._compute, self.table.reset, WORDS_CACHED)

    def _compute(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            self.table.add(self.scorer.words(words[at : at + 20_000]))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words' rows, each word's place among them, and each text's number of words."""
        words, codes, counts = model_words(texts)
        rows = self.cache.rows(words)
        return self.table.a[rows], codes, counts


def word_scores(model: Model, words: DataFrame) -> DataFrame:
    """word, lp, symbols of distinct cleaned words, by joins alone, for models too large to broadcast.

    Distinct windows fall back to distinct shorter ones, order by order, so a table meets each n-gram once; a shorter
    window serves at most as many longer ones as there are symbols.
    """
    n, pad = model.order, BOS * (model.order - 1)
    words = materialize(words.withColumn("_word", F.monotonically_increasing_id()), "kn-ids")
    # long words in pieces first, so that no row carries one along
    text = words.select("_word", F.concat(F.lit(pad), "word", F.lit(EOS)).alias("s"))
    pieces = text.select("_word", F.explode(F.expr(f"transform(sequence(0, (length(s) - {n}) div 64), j -> substring(s, j * 64 + 1, {63 + n}))")).alias("s"))
    at = pieces.select("_word", F.explode(F.expr(f"transform(sequence(1, length(s) - {n - 1}), i -> substring(s, i, {n}))")).alias("g"))
    wanted = {n: materialize(at.select("g").distinct(), "kn-wanted")}
    for k in range(n - 1, 0, -1):
        wanted[k] = materialize(wanted[k + 1].select(F.expr("substring(g, 2)").alias("g")).distinct(), "kn-wanted")
    empty = model.weights.where("k = 1").first()
    below = None
    for k in range(1, n + 1):
        got = wanted[k].join(model.terms.where(F.col("k") == k).select("g", "lp"), "g", "left")
        if k == 1:
            got = got.select("g", F.coalesce("lp", F.lit(model.unseen + (empty.lw if empty else 0)).cast("long")).alias("lp"))
        else:
            got = got.withColumn("ctx", F.expr(f"substring(g, 1, {k - 1})")).withColumn("tail", F.expr("substring(g, 2)"))
            got = got.join(model.weights.where(F.col("k") == k).select("ctx", "lw"), "ctx", "left").join(below.select(F.col("g").alias("tail"), F.col("lp").alias("less")), "tail")
            got = got.select("g", F.coalesce("lp", F.coalesce("lw", F.lit(0)) + F.col("less")).alias("lp"))
        below = materialize(got, "kn-scored")
    sums = at.join(below, "g").groupBy("_word").agg(F.sum("lp").alias("lp"), F.count("*").alias("symbols"))
    return sums.join(words, "_word").select("word", "lp", "symbols")


def joined_scores(model: Model, docs: DataFrame) -> DataFrame:
    """docs with nll and symbols, by joins: each document's distinct words with their numbers, common ones dealt out."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "kn-docs")
    words = with_words(rows.select("_row", "text")).select("_row", F.explode("_words").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("n"))
    words = materialize(words, "kn-doc-words")
    scores = materialize(word_scores(model, words.select("word").distinct()), "kn-words")
    found = salted_join(words, scores, "word", hot_keys(words, "word"), "_row")
    sums = found.groupBy("_row").agg(F.sum(F.col("n") * F.col("lp")).alias("lp"), F.sum(F.col("n") * F.col("symbols")).cast("double").alias("symbols"))
    out = rows.join(sums, "_row", "left").fillna(0, ["lp"]).fillna(0.0, ["symbols"])
    return out.withColumn("nll", -F.col("lp") / F.lit(float(SCALE))).select(*docs.columns, "nll", "symbols")
