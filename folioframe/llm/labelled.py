"""Labelled documents, joined by broadcast of a bounded number of label rows at a time."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, materialize_all, release

#: Label rows broadcast at a time; more take more passes over the documents.
MOST_LABELS = 1_000_000
#: Parts that a range of values is cut into at a time.
BINS = 4096


def labelled(docs: DataFrame, labels: DataFrame, column: str, where=None) -> DataFrame:
    """doc_id, text, lang (where docs has it), label of the documents that `labels` has. Repeated labels: the largest. Null
    ids and labels: left out. Beyond MOST_LABELS labels the rows are written once, for release()."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    one = (one.where(where) if where is not None else one).groupBy("doc_id").agg(F.max("label").alias("label"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    passes = math.ceil(one.count() / MOST_LABELS)
    if passes <= 1:
        return texts.join(F.broadcast(one), "doc_id")
    one = materialize(one.withColumn("pass", F.pmod(F.xxhash64("doc_id"), F.lit(passes))), "labels")
    out = materialize_all((texts.join(F.broadcast(one.where(F.col("pass") == i).drop("pass")), "doc_id") for i in range(passes)), "labelled")
    release(one)
    return out


def quantiles(rows: DataFrame, by: str, value: str, q: float) -> dict:
    """percentile_disc of a double column by a column's values (strings, not null), from counts in ever narrower ranges,
    so that no task and no driver holds the values themselves."""
    b, v = F.col(by), F.col(value)
    every = rows.groupBy(b.alias("k")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()
    ranges, found = {r.k: (r.lo, r.hi, math.ceil(r.n * q)) for r in every}, {}  # and the value's rank in the range
    while True:
        found |= {k: lo for k, (lo, hi, _) in ranges.items() if lo == hi}
        ranges = {k: x for k, x in ranges.items() if k not in found}
        if not ranges:
            return found
        low, high = (F.create_map(*[F.lit(y) for k, x in ranges.items() for y in (k, x[i])])[b] for i in (0, 1))
        part = F.least(F.floor((v - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        bins = defaultdict(list)
        for r in rows.where((v >= low) & (v <= high)).groupBy(b.alias("k"), part.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect():
            bins[r.k].append((r.bin, r.n, r.lo, r.hi))
        for k, (_, _, rank) in list(ranges.items()):
            for _, n, lo, hi in sorted(bins[k]):
                if rank <= n:
                    ranges[k] = lo, hi, rank
                    break
                rank -= n
