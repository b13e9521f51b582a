"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied

#: Pivots, rows they are chosen from, and queries broadcast at a time; more queries take more passes over the rows.
PIVOTS, PIVOT_SAMPLE, QUERIES_A_PASS = 24, 400, 32_768
SCALE = 64.0
#: Queries and rows compared at a time, and candidates held before they are merged.
TILE, ROWS, HELD = 256, 1_024, 500_000
#: Components beyond this are valued with unbounded integers.
WIDE = 1 << 20


def quantize(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and floor(64 x) of vectors, shorter ones filled up with zeros; null or non-finite ones are left out."""
    ids, vectors = batch.column(0), batch.column(1)
    lists = vectors.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    valid = ~lists.is_null().to_numpy(zero_copy_only=False) & ~ids.is_null().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # a null component reads as NaN
    valid &= bad[offsets[1:]] == bad[offsets[:-1]]
    width = int(lengths[valid].max()) if valid.any() else 0
    rows = np.flatnonzero(valid)
    out = np.zeros((len(rows), width))
    at = np.repeat(offsets[rows] - (np.cumsum(lengths[rows]) - lengths[rows]), lengths[rows]) + np.arange(lengths[rows].sum())
    out[np.repeat(np.arange(len(rows)), lengths[rows]), np.arange(lengths[rows].sum()) - np.repeat(np.cumsum(lengths[rows]) - lengths[rows], lengths[rows])] = np.floor(SCALE * flat[at])
    return ids.to_numpy(zero_copy_only=False)[rows].astype(np.int64), out


def fit_width(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """To every pivot, never larger by rounding than the bound's slack allows for."""
    sq = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


def choose_pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Each next pivot is the farthest from those before."""
    if not len(x):
        return x
    picked = [int(np.argmax((x * x).sum(1)))]
    near = distances(x, x[picked])[:, 0]
    while len(picked) < min(n, len(x)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id, and what a score must reach to be among them."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.count, self.limit = np.zeros(n, np.int64), np.full(n, -np.inf)

    def merge(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes scores and ids of the queries q; equal pairs of a query count once."""
        if not len(q):
            return
        met, place = np.unique(q, return_inverse=True)
        old, at = np.nonzero(np.arange(self.k) < self.count[met][:, None])
        place = np.concatenate([old, place])
        scores, ids = np.concatenate([self.scores[met[old], at], scores]), np.concatenate([self.ids[met[old], at], ids])
        order = np.lexsort((ids, ~scores, place))
        place, scores, ids = place[order], scores[order], ids[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
        place, scores, ids = place[new], scores[new], ids[new]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        kept = rank < self.k
        place, scores, ids, rank = place[kept], scores[kept], ids[kept], rank[kept]
        self.scores[met[place], rank], self.ids[met[place], rank] = scores, ids
        self.count[met] = np.bincount(place, minlength=len(met))
        full = met[self.count[met] == self.k]
        self.limit[full] = np.maximum(self.limit[full], self.scores[full, -1])


def search(best: Best, query_ids, queries, query_dist, ids, rows, row_dist) -> None:
    """Values the rows whose bound reaches the k-th best of a query, for a tile of queries at a time: rows that none of
    them needs are left out."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = fit_width(queries, width), fit_width(rows, width)
    wide_r, wide_q = np.abs(rows).max(1, initial=0) > WIDE, np.abs(queries).max(1, initial=0) > WIDE
    found = []

    def take(*hits, least=0):
        found.extend([hits] if hits else [])
        if found and sum(len(x[0]) for x in found) >= least:
            best.merge(*(np.concatenate(x) for x in zip(*found)))
            found.clear()

    if wide_r.any() or wide_q.any():
        for q in range(len(queries)):
            some = np.flatnonzero((wide_q[q] | wide_r) & (ids != query_ids[q]))
            take(np.full(len(some), q), np.array([_exact(rows[i], queries[q]) for i in some.tolist()], np.int64), ids[some], least=HELD)
        take()
        ids, rows, row_dist = ids[~wide_r], rows[~wide_r], row_dist[~wide_r]
    mine = np.flatnonzero(~wide_q)
    if not len(rows) or not len(mine):
        return
    # single precision is enough for a lower bound, less what its rounding may have added
    near_q, near_r = query_dist[mine].astype(np.float32), np.ascontiguousarray(row_dist.T.astype(np.float32))
    slack = np.float32(1e-6) * (near_q.max(initial=0) + near_r.max(initial=0))
    q2, r2 = (queries[mine] ** 2).sum(1), (rows * rows).sum(1)
    once = np.unique(ids, return_index=True)[1]
    for a in range(0, len(mine), TILE):
        own, near = mine[a : a + TILE], near_q[a : a + TILE]
        limit, some = best.limit[own], slice(None)
        if np.isfinite(limit).all():
            low, apart = np.zeros((len(own), len(rows)), np.float32), np.empty((len(own), len(rows)), np.float32)
            for p in range(near.shape[1]):
                np.subtract(near[:, p, None], near_r[p], out=apart)
                np.maximum(low, np.abs(apart, out=apart), out=low)
            low -= slack
            np.maximum(low, 0, out=low)
            # a score is half of what two squares leave over the squared distance; rounded, they may lack a little
            reach = ((q2[a : a + TILE] * (1 + 1e-6) - 2 * limit)[:, None] + (r2 * (1 + 1e-6) + 1e-3)[None]).astype(np.float32)
            reach += np.float32(1e-6) * np.abs(reach)
            some = np.flatnonzero((np.multiply(low, low, out=low) <= reach).any(0))
            if not len(some):
                continue
        tile_ids, scores = ids[some], queries[own] @ rows[some].T
        scores[query_ids[own][:, None] == tile_ids] = -np.inf
        hits = scores >= limit[:, None]
        many = np.flatnonzero(hits.sum(1) > 4 * best.k)
        if len(many) and len(once) >= best.k:
            # the k-th best of these rows, each id taken once, is a limit already
            part = scores[many] if len(once) == len(ids) else scores[many][:, np.isin(np.arange(len(ids))[some], once)]
            if part.shape[1] >= best.k:
                limit[many] = np.maximum(limit[many], np.partition(part, -best.k, 1)[:, -best.k])
                hits[many] = scores[many] >= limit[many][:, None]
        hits &= np.isfinite(scores)
        q, r = np.nonzero(hits)
        take(own[q], scores[q, r].astype(np.int64), tile_ids[r], least=HELD)
    take()


def _exact(x: np.ndarray, y: np.ndarray) -> int:
    """Held to the range of a long."""
    return max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x, y) if a and b)))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every`, the k largest integer inner products with
    all other rows.

    Vectors null or with null or non-finite components, and null ids, take no part; shorter vectors count as filled up
    with zeros; repeated rows count once; rows that share the query's id are its own. Queries go out by broadcast,
    QUERIES_A_PASS at a time; rows stay where they lie, and each partition sends on its k best a query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = rows.where("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toArrow().combine_chunks().to_batches()
    chosen = quantize(sample[0])[1] if sample else np.zeros((0, 0))
    pivots = choose_pivots(chosen[np.abs(chosen).max(1, initial=0) <= WIDE])
    queries = rows.where(f"vec_id % {every} = 0 and embedding is not null").distinct()
    parts = -(-queries.count() // QUERIES_A_PASS)
    found = None
    for part in range(parts):
        got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toArrow().combine_chunks().to_batches()
        if not got:
            continue
        ids, q = quantize(got[0])
        # neighbours in a tile: those with the same nearest pivot need much the same rows
        width = max(q.shape[1], pivots.shape[1])
        near = distances(fit_width(q, width), fit_width(pivots, width))
        order = np.lexsort((ids, near.min(1), near.argmin(1))) if near.shape[1] else np.argsort(ids, kind="stable")
        sent = spark.sparkContext.broadcast((ids[order], q[order], pivots))

        def run(batches, sent=sent):
            ids, q, pivots = sent.value
            best, table = Best(len(ids), k), {}
            for b in tidied(batches):
                row_ids, x = quantize(b)
                for i in range(0, len(row_ids), ROWS):
                    width = max(q.shape[1], x.shape[1], pivots.shape[1])
                    if width not in table:
                        table[width] = distances(fit_width(q, width), fit_width(pivots, width))
                    part = x[i : i + ROWS]
                    search(best, ids, q, table[width], row_ids[i : i + ROWS], part, distances(fit_width(part, width), fit_width(pivots, width)))
            at, rank = np.nonzero(np.arange(k) < best.count[:, None])
            for i in range(0, len(at), 50_000):
                a, r = at[i : i + 50_000], rank[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], best.ids[a, r], best.scores[a, r])], ["query_id", "vec_id", "score"])

        one = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
