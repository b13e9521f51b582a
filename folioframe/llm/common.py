"""What the operators of this subpackage share: tables, shared storage, and cached work per distinct word."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Characters handled at a time inside a worker, which bounds its memory; a single longer text is still taken whole.
CHUNK_CHARS = 4_000_000
#: The same for the language models, which hold several numbers for each word of a chunk.
MODEL_CHUNK_CHARS = 1_000_000


#: Rows and bytes in a batch between Spark and Python, which bound the memory of both; the larger ones are for operators
#: that hold little else, and save them cutting words apart twice.
BATCH, LARGE_BATCH = (2_500, 8_000_000), (10_000, 64_000_000)


def table(spark: SparkSession, sf_dir: str, name: str, batch: tuple[int, int] = BATCH) -> DataFrame:
    """A table; the session's batches between Spark and Python are made small enough for texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch[0])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch[1])
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets one beside its
    warehouse; any other must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/folioframe/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. release() removes it, else delete_scratch()."""
    return materialize_all([df], tag)


def materialize_all(frames: Iterable[DataFrame], tag: str) -> DataFrame:
    """The same for the rows of one or more frames of one schema, written one after the other."""
    path = None
    for df in frames:
        path = path or scratch_path(df.sparkSession, tag)
        df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    SCRATCH.append(path)
    return out


#: Folders written by materialize() that are still there.
SCRATCH: list[str] = []


def release(*frames: DataFrame) -> None:
    """Remove what materialize() wrote for these frames, which nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path in SCRATCH:
            SCRATCH.remove(path)
            delete_path(df.sparkSession, path)


def delete_scratch(spark: SparkSession, keep: Iterable[DataFrame] = (), since: int = 0) -> None:
    """Remove all scratch folders written after the first `since`, but for those of `keep`. Frames made from them are void."""
    kept = {getattr(df, "_scratch", None) for df in keep}
    for path in SCRATCH[since:]:
        if path not in kept:
            SCRATCH.remove(path)
            delete_path(spark, path)


def hot_keys(df: DataFrame, key: str, most: int = 500) -> list:
    """Values of a column that hold more than one in `most` of its rows: so there are fewer than `most` of them."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = df.count()
    return [r[0] for r in counts.where(F.col("_n") > total / most).select(key).collect() if r[0] is not None] if total > 50 * most else []


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, by: str, salts: int = 48, how: str = "inner") -> DataFrame:
    """Join on `key` (inner, or left, where null keys are dealt out too), with the left rows of hot keys dealt out by
    column `by`, and the right ones repeated for that."""
    if not hot and how == "inner":
        return left.join(right, key)
    is_hot, dealt = F.col(key).isin(hot) if hot else F.lit(False), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    left = left.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), dealt).otherwise(0))
    right = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def extended(df: DataFrame, *names: str) -> StructType:
    """The frame's schema with double columns after it."""
    return StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])


def carried(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with the columns `used` as strings (null where absent) and every other one under a name that cannot
    clash, and what gives the frame's own columns back. A column that is a string already is carried once."""
    picked, back, found = [], [], set()
    for i, f in enumerate(df.schema.fields):
        col = F.col(f"`{f.name.replace('`', '``')}`")
        once = f.name in used and isinstance(f.dataType, StringType)
        name = f.name if once else f"_own{i}"
        picked.append(col.alias(name))
        back.append((name, f.name))
        if once:
            found.add(f.name)
        elif f.name in used:
            picked.append(col.cast("string").alias(f.name))
            found.add(f.name)
    picked += [F.lit(None).cast("string").alias(u) for u in used if u not in found]
    return df.select(*picked), lambda out: out.select(*[F.col(a).alias(b) for a, b in back])


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def chunks(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters together."""
    first, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        total += n + 16
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


#: What tasks of one operator share in a worker process, under the operator's name.
SHARED: dict = {}


def shared(key, make: Callable):
    """What `make` gives, once for all tasks of a worker that ask for it in a row: the next operator's task drops it."""
    if key not in SHARED:
        SHARED.clear()
        SHARED[key] = make()
    return SHARED[key]


def tidied(batches: Iterable, key=None) -> Iterator:
    """A task's batches. Before the first, what other operators' tasks have left in the worker goes, and after the last
    one free memory goes back to the system, since workers and their memory outlive tasks; not so for an operator that
    shares something under `key`, whose next task takes that memory again."""
    others = [k for k in SHARED if k != key]
    for other in others:
        del SHARED[other]
    if others:
        _give_back()
    yield from batches
    if key is None:
        _give_back()


def _give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class WordCache:
    """Row numbers of distinct strings, whose values are worked out once while the cache holds them.

    `compute` turns new strings into values and appends them to the caller's arrays in the given order.
    The cache empties itself once it holds `most` strings, so a worker's memory stays bounded; with `keep`, which makes the
    caller's arrays those of the given rows, strings asked for most often stay, up to half as many.
    """

    def __init__(self, compute: Callable[[list[str]], None], clear: Callable[[], None], most: int = 600_000, keep: Callable[[np.ndarray], None] | None = None):
        self.index: dict[str, int] = {}
        self.compute, self.clear, self.most, self.keep = compute, clear, most, keep
        self.asked = Growing(np.uint16)

    def _drop(self) -> None:
        """Strings asked for again stay, the oftener asked for first, and count half of it from now on."""
        asked = self.asked.a[: self.asked.n]
        often = np.bincount(asked)
        least = max(1, len(often) - int(np.searchsorted(np.cumsum(often[::-1]), self.most // 2, "right")))
        kept = np.flatnonzero(asked >= least)
        self.keep(kept)
        self.index = dict(zip(compress(self.index, (asked >= least).tolist()), range(len(kept))))
        asked = asked[kept] // 2
        self.asked.reset()
        self.asked.add(asked)

    def rows(self, words: list[str]) -> np.ndarray:
        """For distinct words."""
        found = lambda: np.array(list(map(self.index.get, words, repeat(-1))), np.int64) if words else np.zeros(0, np.int64)
        out = found()
        at = np.flatnonzero(out < 0)
        if len(at) and len(self.index) + len(at) > self.most and self.index:
            if self.keep:
                self._drop()
                out = found()
                at = np.flatnonzero(out < 0)
            if not self.keep or len(self.index) + len(at) > self.most:
                self.index = {}
                self.clear()
                self.asked.reset()
                at = np.arange(len(words))
        if self.keep and len(at) < len(out):
            again = out[out >= 0]
            self.asked.a[again] = np.minimum(self.asked.a[again], 60_000) + 1
        if len(at):
            new = [words[i] for i in at.tolist()]
            self.compute(new)
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new))))
            out[at] = first + np.arange(len(at))
            if self.keep:
                self.asked.add(np.zeros(len(at), np.uint16))
        return out


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and each text's number of words (null: none).

    Words lie between white space (ASCII's six).
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    parts = pc.ascii_split_whitespace(texts)
    counts = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten().dictionary_encode()
    words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
    if "" in words:
        kept = codes != words.index("")
        counts = np.diff(np.concatenate([[0], np.cumsum(kept)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()])
        codes = codes[kept]
    return words, codes.astype(np.int64), counts


class Growing:
    """A numpy array that is appended to."""

    def __init__(self, dtype, width: int = 0):
        self.dtype, self.width = dtype, width
        self.reset()

    def reset(self) -> None:
        self.n, self.a = 0, np.empty((1024, self.width) if self.width else 1024, self.dtype)

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            room = max(2 * len(self.a), self.n + len(x))
            grown = np.empty((room, self.width) if self.width else room, self.dtype)
            grown[: self.n] = self.a[: self.n]
            self.a = grown
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values` (first axis); runs of length 0 give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
