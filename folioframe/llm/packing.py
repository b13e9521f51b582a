"""Hierarchical multi-length packing of documents into training sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, chunks, tidied
from .tokens import shared_tokenizer

#: Context sizes, powers of two. A document's last piece of (t/2, t] ids belongs to tier t; up to the least, to that.
TIERS = (256, 512, 1024, 2048)
#: Sequences are numbered from partition x this.
PER_PARTITION = 1 << 40
#: Step groups: each partition deals the sequences of a tier to them in turn, from a group that moves on with the
#: partition, so that each has about the same share of every tier however few a partition makes.
STEP_GROUPS = 8
#: Characters encoded at a time, and words whose ids a worker keeps.
PACK_CHUNK_CHARS, WORDS_KEPT = 8_000_000, 800_000
SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")] + [("tier", pa.int32()), ("step_group", pa.int32())])


class Packer:
    """Packs documents as they come; every sequence but the last few is full, and those are cut at powers of two.

    `add` takes document lengths and returns the pieces of the sequences that it has closed, as rows
    (document, start, length, sequence, offset, sequence's tokens, tier, step group). Shorter pieces wait in their tiers, at
    most `window` of them; then every tier is packed.
    """

    def __init__(self, window: int = 5_000, group: int = 0):
        self.window, self.sequence, self.group = window, 0, group
        self.dealt = dict[int, int]()  # sequences of a tier so far
        self.waiting: list[tuple[int, int, int]] = []  # length, document, start
        self.tail: list[tuple[int, int, int]] = []

    def _close(self, pieces: list[tuple[int, int, int]], tier: int) -> list[tuple]:
        out, at, total = [], 0, sum(p[0] for p in pieces)
        dealt = self.dealt.get(tier, 0)
        self.dealt[tier] = dealt + 1
        for n, doc, start in pieces:
            out.append((doc, start, n, self.sequence, at, total, tier, (self.group + dealt) % STEP_GROUPS))
            at += n
        self.sequence += 1
        return out

    def add(self, doc: int, length: int) -> list[tuple]:
        top, out, start = TIERS[-1], [], 0
        while length - start >= top:
            out += self._close([(top, doc, start)], top)
            start += top
        if length > start:
            self.waiting.append((length - start, doc, start))
        return out + self.pack() if len(self.waiting) >= self.window else out

    def pack(self) -> list[tuple]:
        """Largest tier first: each of its pieces opens a window of the tier's size; gaps take the longest waiting
        pieces of shorter tiers that fit, and at last a cut of the shortest tier's pieces. Those fill windows of the
        least size in turn."""
        least, out = TIERS[0], []
        pieces = sorted(self.waiting)
        self.waiting = []
        cut = bisect_right(pieces, (least, 1 << 62, 0))
        small, large = self.tail + pieces[:cut], pieces[cut:]
        self.tail = []
        while large:
            first = large.pop()
            tier = next(t for t in TIERS if t >= first[0])
            window, gap = [first], tier - first[0]
            while gap:
                at = bisect_right(large, (gap, 1 << 62, 0)) - 1
                if at >= 0:
                    window.append(large.pop(at))
                elif small:
                    n, doc, start = small.pop()
                    if n > gap:
                        small.append((n - gap, doc, start + gap))
                        n = gap
                    window.append((n, doc, start))
                elif large:  # nothing short is left: cut the shortest of the rest
                    n, doc, start = large.pop(0)
                    rest = (n - gap, doc, start + gap)
                    large.insert(bisect_right(large, rest), rest) if rest[0] > least else small.append(rest)
                    window.append((gap, doc, start))
                else:
                    break
                gap -= window[-1][0]
            if gap:
                self.tail = window
            else:
                out += self._close(window, tier)
        return out + self._fill(self.tail + small, least)

    def _fill(self, pieces: list[tuple[int, int, int]], size: int) -> list[tuple]:
        out, window, gap = [], [], size
        for n, doc, start in pieces:
            while n:
                take = min(n, gap)
                window.append((take, doc, start))
                n, start, gap = n - take, start + take, gap - take
                if not gap:
                    out += self._close(window, size)
                    window, gap = [], size
        self.tail = window
        return out

    def finish(self) -> list[tuple]:
        """The rest, in sequences of powers of two: no padding."""
        out = self.pack()
        left = sum(p[0] for p in self.tail)
        while left:
            size = 1 << (left.bit_length() - 1)
            rest, total = [], 0
            window = []
            for n, doc, start in self.tail:
                take = min(n, size - total)
                if take:
                    window.append((take, doc, start))
                if n > take:
                    rest.append((n - take, doc, start + take))
                total += take
            out += self._close(window, size)
            self.tail, left = rest, left - size
        return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, chunk: int = PACK_CHUNK_CHARS, words: int = WORDS_KEPT) -> DataFrame:
    """Pieces of all documents (SCHEMA). Each partition packs its own documents; nothing is shuffled. `chunk` characters
    are encoded at a time, and a worker keeps the ids of so many `words`: they set its memory and time, not the result.

    Null and empty texts are a document of the end id alone. Null ids and repeated rows are packed like others.
    `length` ids of a document from `start` stand at `offset` of a sequence of `sequence_tokens` ids, which needs
    no padding where that is a power of two, as it is for every sequence made here.
    """

    def pack(batches):
        from pyspark import TaskContext

        tok, part = shared_tokenizer(tokenizer, words), TaskContext.get().partitionId()
        packer = Packer(group=part)
        # of documents with ids not yet packed: doc_id, their last ids, where these begin, all ids, ids still to go
        held: dict[int, tuple] = {}
        number = 0

        def rows(found):
            cols = [[] for _ in SCHEMA]
            for doc, start, n, seq, at, total, tier, group in found:
                doc_id, ids, first, size, left = held[doc]
                for c, v in zip(cols, (doc_id, start, n, zlib.crc32(ids[4 * (start - first) : 4 * (start - first + n)]), size, part * PER_PARTITION + seq, at, total, tier, group)):
                    c.append(v)
                if left == n:
                    del held[doc]
                else:
                    held[doc] = doc_id, ids, first, size, left - n
            return batch_of(SCHEMA, cols)

        for batch in tidied(batches, ("tokenizer", tokenizer)):
            texts, doc_ids = batch.column(1), batch.column(0).to_pylist()
            for a, b in chunks(texts, chunk):
                ids, counts = tok.documents(texts[a:b], end_id)
                raw, at, found, before = memoryview(ids.astype("<u4").tobytes()), 0, [], number
                for doc_id, n in zip(doc_ids[a:b], counts.tolist()):
                    held[number] = doc_id, raw[4 * at : 4 * (at + n)], 0, n, n
                    found += packer.add(number, n)
                    number, at = number + 1, at + n
                if found:
                    yield rows(found)
                for doc in range(before, number):  # full windows are out, so what waits is short
                    if doc in held:
                        doc_id, ids, _, size, left = held[doc]
                        held[doc] = doc_id, bytes(ids[4 * (size - left) :]), size - left, size, left
        found = packer.finish()
        if found:
            yield rows(found)

    names = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in SCHEMA)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, names)
