"""SimHash fingerprints linked within three bits through Golay codeword keys."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_join, tidied
from .components import components

#: Segments of the fingerprint: first bit and width. The last is filled up to 23 bits with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
SEED, SHINGLE, DISTANCE = 42, 3, 3
#: The Golay code's generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is 1 if it is set in over half the shingles' hashes. Null and wordless texts: 0."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    plain, digest = b" ".join(words), xxhash.xxh64_digest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(SHINGLE, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    hashes = b"".join([digest(plain[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())])
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65_536):
        part = np.frombuffer(hashes, np.uint8, -1)[8 * at : 8 * (at + 65_536)]
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long; with `hashed` also the text's hash."""

    def run(batches):
        for b in tidied(batches):
            seen: dict[str | None, int] = {}
            out = []
            for t in b.column(1).to_pylist():
                if t not in seen:
                    if len(seen) > 2_000:
                        seen.clear()
                    seen[t] = fingerprint(t)
                out.append(seen[t])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([F.xxhash64(text).alias("hash")] if hashed else []))
    return rows.mapInArrow(run, "doc_id long, fp long" + ", hash long" * hashed)


def _syndromes(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= ((v >> bit) & 1) * (GENERATOR << (bit - 11))
    return v


@cache
def _leaders() -> np.ndarray:
    """The error pattern of each of the 2048 syndromes: the code is perfect, so each has one of weight up to 3."""
    bits = 1 << np.arange(23, dtype=np.int64)
    errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    errors = np.array(errors, np.int64)
    out = np.full(2048, -1, np.int64)
    out[_syndromes(errors)] = errors
    assert (out >= 0).all()
    return out


@cache
def _neighbours(width: int) -> np.ndarray:
    """By syndrome, what turns a segment into each codeword to which a neighbour at one bit decodes; rows repeat their last."""
    lead, one = _leaders(), _syndromes(1 << np.arange(width, dtype=np.int64))
    found = [sorted({int(lead[s ^ x]) ^ (1 << i) for i, x in enumerate(one.tolist())}) for s in range(2048)]
    most = max(map(len, found))
    return np.array([x + x[-1:] * (most - len(x)) for x in found], np.int64)


def golay_keys(fp: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint. Any two within three bits have a key on the left of one equal to one on the right
    of the other, or the other way round.

    Of up to three errors in three segments either some segment has none and another one at most, or each has one. Where
    a segment has exactly one, the two sides' parities of it differ: the even side gives the codeword index of every
    neighbour at one bit, the odd side that of its own. So keys are: two whole segments; a whole segment and an index;
    three indices with the parities.
    """
    fp = fp.view(np.uint64)
    value, own, near, odd = [], [], [], []
    for first, width in SEGMENTS:
        v = ((fp >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = _syndromes(v)
        value.append(v)
        own.append(((v ^ _leaders()[s]) >> 11)[:, None])
        near.append((v[:, None] ^ _neighbours(width)[s]) >> 11)
        odd.append(np.bitwise_count(v) % 2 == 1)
    rows, keys = [], []

    def add(at: np.ndarray, grid: np.ndarray) -> None:
        grid = np.sort(grid, axis=1)
        fresh = np.ones(grid.shape, bool)
        fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
        rows.append(at[np.nonzero(fresh)[0]])
        keys.append(grid[fresh])

    every = np.arange(len(fp))
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        add(every, ((tag << 46) | (value[i] << 23) | value[j])[:, None])
    tag = 3
    for i in range(3):
        for j in range(3):
            if i != j:
                at = np.flatnonzero(odd[j] != left)
                add(at, (tag << 46) | (value[i][at, None] << 12) | (near if left else own)[j][at])
                tag += 1
    # the even first segment goes left; the parities of the others are the left side's
    at = np.flatnonzero(odd[0] != left)
    for p in range(4):
        want = [left, bool(p & 1) == left, bool(p & 2) == left]  # whether each segment is even on this side
        some = at[np.logical_and.reduce([odd[k][at] != want[k] for k in (1, 2)])]
        if not len(some):
            continue
        a, b, c = ((near if want[k] else own)[k][some] for k in range(3))
        add(some, ((tag << 46) | (p << 36) | (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]).reshape(len(some), -1))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(classes: DataFrame, left: bool, name: str) -> DataFrame:
    def run(batches):
        for b in tidied(batches):
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                rows, keys = golay_keys(fp[at : at + 4096], left)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at : at + 4096][rows])], ["key", name])

    return classes.select("fp").mapInArrow(run, f"key long, {name} long")


def links(classes: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) within three bits. Keys have 35 to 46 bits; those of two whole
    segments are shared by the distinct values of a third at most."""
    one, other = _keyed(classes, True, "x"), _keyed(classes, False, "y")
    close = (one.key == other.key) & (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE)
    return one.join(other, close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _components(fps: DataFrame) -> tuple[DataFrame, list[int]]:
    """class_fp, component_id, n_links of each distinct fingerprint of fps (doc_id, fp), and the fingerprints of many rows."""
    counted = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-classes")
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = [r.fp for r in counted.where(F.col("n") > max(total / 500, 1000)).select("fp").collect()]  # fewer than 500
    edges = materialize(links(counted), "simhash-links")
    found = components(edges)  # node, component: both fingerprints
    n = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    joined = counted.join(found.withColumnRenamed("node", "fp"), "fp", "left").join(n, "fp", "left")
    linked = joined.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = joined.join(linked, "component", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return materialize(named, "simhash-named"), hot


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id reachable), copies' n_links.

    Equal fingerprints are one class, so copies are never expanded into pairs; n_links counts the other classes
    within three bits. Rows without an id get their component's, which is null if no member has an id. Null and
    empty texts have fingerprint zero and link like any other. Repeated rows stay. A text is read in one piece.
    """
    fps = materialize(fingerprints(docs), "simhash-docs")
    named, hot = _components(fps)
    out = salted_join(fps.withColumn("_by", F.monotonically_increasing_id()), named, "fp", hot, "_by")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one row, with its columns: that of the smallest doc_id (a row without an id only where none has
    one), of those the one with the smallest fingerprint and then the smallest hash of its text."""
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash")]
    fps = materialize(fingerprints(docs, True).groupBy("doc_id", "hash", "fp").agg(F.count("*").alias("n")), "simhash-docs")
    named, hot = _components(fps)
    rows = salted_join(fps.withColumn("_by", F.xxhash64("doc_id", "hash")), named.select("fp", "component"), "fp", hot, "_by")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "hash"))
    first = materialize(rows.groupBy("component").agg(best.alias("b")).select("b.doc_id", "b.hash"), "simhash-first")
    lost = fps.alias("f").join(first.alias("g"), F.expr("f.doc_id <=> g.doc_id and f.hash = g.hash"), "left_anti").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_h"))
    lost = materialize(lost, "simhash-lost")
    many = materialize(fps.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_h")), "simhash-many")
    own = docs.withColumn("_hash", key[1])
    same = F.expr("cast(doc_id as long) <=> _id and _hash = _h")
    left = own.join(lost, same, "left_anti")
    if not many.limit(1).count():
        return left.drop("_hash")
    return left.join(many, same, "left_anti").unionByName(left.join(many, same, "left_semi").dropDuplicates(["doc_id", "_hash"])).drop("_hash")
