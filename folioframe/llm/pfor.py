"""Token ids in patched frame-of-reference blocks.

A file is a run of segments; a segment holds the ids of whole consecutive documents and ends with one line feed:

    "PFR1" | shard u4 | number in shard u4 | documents u4 | ids u8 | blocks u4 | bytes of blocks u8
    per document: null flag u1, doc_id i8, ids u4 | per block: start u4 | blocks

A block holds 128 ids (the last is filled up): minimum u4, width u1, exceptions u1, the lower `width` bits of each
id less the minimum, then the exceptions' positions u1 and their upper bits u4. The width holds `PERCENTILE`
per cent of the block's differences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, chunks, delete_path, materialize, scratch_path, tidied
from .tokens import shared_tokenizer

BLOCK, PERCENTILE = 128, 90
HEAD = np.dtype([("magic", "S4"), ("shard", "<u4"), ("seq", "<u4"), ("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4"), ("bytes", "<u8")])
DOC = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("n", "<u4")])
#: Ids after which a segment closes, and segments in a file.
SEGMENT_IDS, SEGMENTS_PER_FILE = 262_144, 48


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' bytes and each block's start in them."""
    n = -(-len(ids) // BLOCK)
    padded = np.empty(n * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    x = padded.reshape(n, BLOCK)
    low = x.min(axis=1)
    x = x - low[:, None]
    kept = np.partition(x, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.frexp(kept.astype(np.float64))[1].astype(np.int64)
    over = x >> np.minimum(width, 31).astype(np.uint32)[:, None]
    over[width == 32] = 0
    row, col = np.nonzero(over)
    found = np.bincount(row, minlength=n)
    sizes = 6 + BLOCK // 8 * width + 5 * found
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[starts + 4], out[starts + 5] = width, found
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        bits = np.unpackbits(x[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little", count=int(w))
        out[starts[at][:, None] + 6 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(found) - found)[row]
        base = starts[row] + 6 + BLOCK // 8 * width[row]
        out[base + nth] = col
        out[(base + found[row] + 4 * nth)[:, None] + np.arange(4)] = over[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, starts


def decode_blocks(data: np.ndarray, starts: np.ndarray, n_ids: int) -> np.ndarray:
    n = len(starts)
    low = data[starts[:, None] + np.arange(4)].view("<u4").reshape(n)
    width, found = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    x = np.zeros((n, BLOCK), np.uint32)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    for w in np.unique(width[width > 0]):
        at, bit = np.flatnonzero(width == w), np.arange(BLOCK) * w
        x[at] = (eight[starts[at][:, None] + 6 + (bit >> 3)] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << int(w)) - 1)
    row = np.repeat(np.arange(n), found)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(found) - found)[row]
        base = starts[row] + 6 + BLOCK // 8 * width[row]
        col = data[base + nth]
        high = data[(base + found[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4").reshape(-1)
        x[row, col] |= high << width[row].astype(np.uint32)
    return (x + low[:, None]).reshape(-1)[:n_ids]


def segment(shard: int, seq: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    body, starts = encode_blocks(ids)
    head = np.array([(b"PFR1", shard, seq, len(counts), len(ids), len(starts), len(body))], HEAD)
    docs = np.zeros(len(counts), DOC)
    docs["null"] = [d is None for d in doc_ids]
    docs["doc_id"] = [d or 0 for d in doc_ids]
    docs["n"] = counts
    return head.tobytes() + docs.tobytes() + starts.astype("<u4").tobytes() + body.tobytes()


def read_segments(content: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(shard, number, documents, ids) of each segment of a file."""
    at = 0
    while at < len(content):
        h = np.frombuffer(content, HEAD, 1, at)[0]
        assert h["magic"] == b"PFR1", f"no segment at byte {at}"
        at += HEAD.itemsize
        docs = np.frombuffer(content, DOC, int(h["docs"]), at)
        at += docs.nbytes
        starts = np.frombuffer(content, "<u4", int(h["blocks"]), at).astype(np.int64)
        at += 4 * len(starts)
        data = np.frombuffer(content, np.uint8, int(h["bytes"]), at)
        at += len(data) + 1
        yield int(h["shard"]), int(h["seq"]), docs, decode_blocks(data, starts, int(h["ids"]))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text and write the files, ascending in doc_id from shard to shard and inside each.

    Null texts are empty ones. Null ids come first. Equal ids stand in the order of their texts.
    """

    def encode(batches):
        from pyspark import TaskContext

        tok, shard, seq = shared_tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        names, counts, ids, held = [], [], [], 0
        for batch in tidied(batches, ("tokenizer", tokenizer)):
            texts, doc_ids = batch.column(1), batch.column(0).to_pylist()
            for a, b in chunks(texts):
                got, n = tok.documents(texts[a:b], end_id)
                ends = np.cumsum(n)
                while a < b:  # as many documents as close the segment
                    done = int(ends[-1] - n.sum()) if not len(n) else int(ends[0] - n[0])
                    take = min(len(n), int(np.searchsorted(ends, done + SEGMENT_IDS - held)) + 1)
                    names += doc_ids[a : a + take]
                    counts.append(n[:take])
                    ids.append(got[done : ends[take - 1]])
                    held += len(ids[-1])
                    a, n, ends = a + take, n[take:], ends[take:]
                    if held >= SEGMENT_IDS:
                        yield pa.RecordBatch.from_pydict({"data": pa.array([segment(shard, seq, names, np.concatenate(counts), np.concatenate(ids))], pa.binary())})
                        names, counts, ids, held, seq = [], [], [], 0, seq + 1
        if names:
            yield pa.RecordBatch.from_pydict({"data": pa.array([segment(shard, seq, names, np.concatenate(counts), np.concatenate(ids))], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blobs = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, "data binary")
    blobs.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard, segment."""

    def decode(batches):
        names = ["shard", "file_seq", "segment", "start_in_file", "file_ids", "doc_id", "n_tokens", "ids_crc32"]
        for batch in batches:
            for content in batch.column(0):
                rows, first, before = [], None, 0
                for shard, seq, docs, ids in read_segments(content.as_buffer()):
                    first = seq if first is None else first
                    ends = np.cumsum(docs["n"].astype(np.int64))
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - docs["n"]).tolist(), ends.tolist())]
                    rows.append((shard, seq, docs, ends, crc, before))
                    before += len(ids)
                for shard, seq, docs, ends, crc, base in rows:
                    n = len(docs)
                    cols = [np.full(n, shard), np.full(n, first), np.full(n, seq), base + ends - docs["n"], np.full(n, before), pa.array(docs["doc_id"], mask=docs["null"] == 1), docs["n"].astype(np.int64), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(pa.int64()) for c in cols], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = materialize(files.mapInArrow(decode, "shard long, file_seq long, segment long, start_in_file long, file_ids long, doc_id long, n_tokens long, ids_crc32 long"), "token-docs")
    # One row a file of some twelve million ids: small beside the documents at any size.
    sizes = rows.groupBy("shard", "file_seq").agg(F.max("file_ids").alias("file_ids")).toPandas().sort_values(["shard", "file_seq"])
    sizes["base"] = sizes["file_ids"].cumsum() - sizes["file_ids"]
    if sizes.empty:
        bases = spark.createDataFrame([], "shard long, file_seq long, base long")
    else:
        bases = spark.createDataFrame(pd.DataFrame({c: sizes[c].astype("int64") for c in ("shard", "file_seq", "base")}))
    return rows.join(bases, ["shard", "file_seq"]).select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


def token_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, keep_at: str | None = None) -> DataFrame:
    """Write the files (to `keep_at`, else to a shared scratch folder that is removed) and read each document back."""
    path = keep_at or scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    out = read_token_files(spark, path)
    if keep_at is None:
        delete_path(spark, path)
    return out
