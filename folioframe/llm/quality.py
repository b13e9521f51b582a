"""Quality by perplexity: a Kneser-Ney model of trusted text, with thresholds at each language's quantile."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import MODEL_CHUNK_CHARS, carried, chunks, extended, materialize, release, segment_sums, tidied
from .labelled import labelled, quantiles

#: Order of the character model; symbols of the language's mean that a short text's perplexity is drawn to.
ORDER, DRAWN = 5, 40.0
#: A language's limit is this quantile of its trusted documents' perplexities, each under a model of the others' half.
UPPER, LEAST_TRUSTED = 0.999, 30


def score(docs: DataFrame, model: kn.Model, most: int | None = None) -> DataFrame:
    """docs with nll (negative log probability) and symbols."""
    if model.size() > (kn.MOST_BROADCAST if most is None else most):
        return kn.joined_scores(model, docs)
    packed, place = model.packed(), docs.columns.index("text")

    def run(batches):
        scorer = kn.CachedScorer(packed.value)
        for b in tidied(batches):
            for i, j in chunks(b.column(place), MODEL_CHUNK_CHARS):
                part = b.slice(i, j - i)
                rows, codes, counts = scorer.batch(part.column(place))
                sums = segment_sums(rows[codes], counts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(-sums[:, 0] / kn.SCALE), pa.array(sums[:, 1])], [*part.schema.names, "nll", "symbols"])

    return docs.mapInArrow(run, extended(docs, "nll", "symbols"))


def drawn(nll, symbols, mean):
    return (nll + DRAWN * mean) / (symbols + DRAWN)


class QualityClassifier:
    """Trusted documents are those labelled 1. Their whole texts are counted. Each half of them is scored by a model of
    the other half, and the quantiles of those perplexities are the limits.

    Limits are per language; a null language, or one with fewer than LEAST_TRUSTED trusted documents, has the limit of
    all together. A perplexity equal to the limit passes. Without trusted documents nothing is rejected but empty texts.
    """

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityClassifier:
        rows = labelled(docs, labels, "quality", "label = 1")
        trusted = rows.select("doc_id", "lang", "text", (F.xxhash64("doc_id") % 2 == 0).alias("half"))
        grams = materialize(kn.count_grams(trusted.select(F.col("half").cast("int").alias("part"), "text"), ORDER), "kn-grams")
        halves = []
        for half in (0, 1):
            other = kn.fit(grams.where(F.col("part") != half), ORDER)
            halves.append(materialize(score(trusted.where(F.col("half").cast("int") == half).select("lang", "text"), other).where("symbols > 0").select("lang", "nll", "symbols"), "quality-trusted"))
            other.release()
        self.model = kn.fit(grams, ORDER)
        release(grams, rows)
        seen = halves[0].union(halves[1])
        sums = seen.groupBy("lang").agg(F.sum("nll").alias("nll"), F.sum("symbols").alias("symbols"), F.count("*").alias("n")).collect()
        means = {r.lang: r.nll / r.symbols for r in sums}
        total = seen.agg(F.sum("nll"), F.sum("symbols")).first()
        self.mean = total[0] / total[1] if total[1] else 0.0
        at = seen.select("lang", drawn(F.col("nll"), F.col("symbols"), self._lookup(means, self.mean)).alias("x"))
        self.limit = quantiles(at.withColumn("lang", F.lit("")), "lang", "x", UPPER).get("", float("inf"))
        often = [r.lang for r in sums if r.n >= LEAST_TRUSTED and r.lang is not None]
        self.limits = quantiles(at.where(F.col("lang").isin(often)), "lang", "x", UPPER) if often else {}
        self.means = {k: v for k, v in means.items() if k in self.limits}
        release(*halves)
        return self

    @staticmethod
    def _lookup(values: dict, other: float):
        known = [x for k, v in values.items() if k is not None for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.create_map(*known)[F.coalesce("lang", F.lit(""))], F.lit(other)) if known else F.lit(other)

    def decide(self, docs: DataFrame) -> DataFrame:
        """docs with perplexity (per symbol; null without words), limit, keep."""
        has_lang = "lang" in docs.columns
        rows = score(docs if has_lang else docs.withColumn("lang", F.lit(None).cast("string")), self.model)
        rows = rows.withColumn("x", drawn(F.col("nll"), F.col("symbols"), self._lookup(self.means, self.mean)))
        rows = rows.withColumn("y", self._lookup(self.limits, self.limit))
        keep = (F.col("symbols") > 0) & (F.col("x") <= F.col("y"))
        return rows.withColumn("perplexity", F.when(F.col("symbols") > 0, F.exp("x"))).withColumn("limit", F.exp("y")).withColumn("keep", keep)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, limit, keep of every document.

    Texts without words are rejected. Repeated rows are judged alike; null ids too. A text is read in one piece, however
    long; the batches around it are cut at about MODEL_CHUNK_CHARS characters.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    return QualityClassifier().fit(docs, labels).decide(rows).select("doc_id", "lang", "perplexity", "limit", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns, whatever these are called."""
    own, back = carried(docs, "text", "lang")
    return back(QualityClassifier().fit(docs, labels).decide(own).where("keep"))
