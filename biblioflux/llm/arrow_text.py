"""Arrow and numpy building blocks shared by the text operators.

Columns reach Python as Arrow arrays (``arrow_udf`` / ``mapInArrow``); everything below works on whole
buffers, cut into pieces of a bounded number of bytes so that memory does not follow the batch's row count.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 512 << 10
#: Largest table, in bytes as estimated from its exact row count, that is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20
LEAST_ROW_BYTES = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


#: Rows of an Arrow batch at most: texts may be long, and two batches are held by each of an executor's tasks.
BATCH_ROWS = 250


def bound_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger; returns df."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; only a session in one process (tests) gets a folder of its own where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name made from ``name`` that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """The column of that name, dots and quotes in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but those named, whatever the case."""
    gone = {n.lower() for n in names}
    return [column(c) for c in df.columns if c.lower() not in gone]


def cut_lineage(df: DataFrame, *keys: str) -> DataFrame:
    """A reliable checkpoint in the shared folder: survives the loss of executors.

    With keys the rows are gathered by them first, so that a small result of many tasks is written in few files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df.repartition(*keys) if keys else df).checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A table as read, in at least as many parts as there are cores: a file of one row group would be one task's."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a (checkpointed, hence cheap to count) join side for broadcast if it is small enough.

    A row counts as row_bytes, and as LEAST_ROW_BYTES at least: what a hashed relation spends on the narrowest row.  Beyond that both sides are shuffled and this one is hashed, so that the wide side need not be sorted.
    """
    return F.broadcast(df) if df.count() * max(row_bytes, LEAST_ROW_BYTES) <= BROADCAST_BYTES else df.hint("shuffle_hash")


@functools.lru_cache(maxsize=1)
def _malloc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


def release() -> None:
    """Give freed memory back: workers live on between tasks, beside a heap that was sized without them."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def row_chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of whole rows holding about ``limit`` bytes each (one row may exceed it); after the last, memory is released."""
    n = len(arr)
    if not n:
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if pa.types.is_large_string(arr.type) else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield arr.slice(lo, min(hi, n) - lo)
        lo = min(hi, n)
    release()


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 row offsets into them; null rows are empty."""
    arr = arr.fill_null("")
    n = len(arr)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if pa.types.is_large_string(arr.type) else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = arr.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised over uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    k = 1
    while k < n:  # doubling
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row numbers of the maximal runs without ASCII white space."""
    ink = ~_SPACE[data]
    before = np.empty_like(ink)
    before[1:] = ink[:-1]
    before[:1] = False
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty_like(ink)
    after[:-1] = ink[1:]
    after[-1:] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    pow_ = powers(int(length.max()))
    first = np.repeat(starts, length)
    total = np.cumsum(length)
    rel = np.arange(int(total[-1])) - np.repeat(total - length, length)
    terms = (data[first + rel].astype(np.uint64) + np.uint64(1)) * pow_[rel]
    return mix(np.add.reduceat(terms, total - length) ^ (length.astype(np.uint64) * _MUL))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(h)-k+1 of them; empty if there are fewer words)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C55) + h[j : j + n]
    return mix(out)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def concat(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
