"""Helpers that the training-data operators share: shared storage, and hashing of words in bulk."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows and bytes of an Arrow batch at most: what an executor holds off its heap for each Python task.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed on them, and keep the session's Arrow batches small."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (path, ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session has none and runs on one machine (a local master, as in tests), one is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lettermill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: The folder of the work at hand, in the shared folder; empty outside ``scratch``.
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are deleted at the end: for work whose result has been written elsewhere by then."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(before)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{_SCRATCH.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A side of a join is broadcast up to so many bytes; beyond it, the join shuffles.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, width: int) -> DataFrame:
    """The stored table, to be broadcast if its rows of ``width`` bytes are known to be few."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


#: A key is a hub from so many rows on, and from so many of all rows that there are at most ``HUBS`` of them.
HUB_ROWS, HUBS = 10_000, 10_000


def hubs(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key, parts): keys that have a large share of ``total`` rows, by their numbers of rows (key, n), and the parts to cut each into.

    At most HUBS keys, whatever the data: each has total / HUBS rows or more. Parts are at most twice as many. None where no key can have so many rows.
    """
    if total < HUB_ROWS:
        return None
    limit = max(HUB_ROWS, -(-total // HUBS))
    return stored(counts.where(F.col("n") >= limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts")), "hubs")


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, by: str, heavy: DataFrame | None) -> DataFrame:
    """Inner join of rows with the one row of each key in ``keyed``; rows of a hub are parted by a hash of ``by``, and its keyed row goes to each part."""
    if heavy is None or heavy.isEmpty():
        return rows.join(keyed, key)
    heavy = F.broadcast(heavy.withColumnRenamed("parts", "__parts"))  # at most HUBS rows of two numbers
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(heavy, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    right = keyed.join(heavy, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")


#: Cached functions whose results a worker keeps from task to task, by the operator that needs them.
KEPT_IN_WORKERS: dict[str, Callable] = {}


def _trim() -> None:
    """Give free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def _forget(keeps: str) -> None:
    """Drop what other operators than ``keeps`` left in this worker."""
    left = [kept for name, kept in KEPT_IN_WORKERS.items() if name != keeps and kept.cache_info().currsize]
    for kept in left:
        kept.cache_clear()
    if left:
        _trim()


def released(run, keeps: str = ""):
    """The Arrow function ``run``, giving memory back to the system when its task ends: workers are used again.

    Before it begins, it drops what other operators than ``keeps`` left in the worker.
    """

    def task(batches):
        _forget(keeps)
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


# --- words of many texts at once ---------------------------------------------

#: Contract words "alnum": every byte but ASCII other than 0-9, A-Z, a-z.
ALNUM = np.ones(256, bool)
ALNUM[:128] = [chr(b).isalnum() for b in range(128)]
#: Contract words "spaced": every byte but space and \t \n \v \f \r.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_M = 0x9E3779B97F4A7C15 | 1
_INV = pow(_M, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a list of UTF-8 texts, found and hashed without a loop over words.

    ``start``/``end`` are byte offsets in ``data``; ``first`` has the index of each text's first
    word (one more entry than texts). A-Z count as a-z in hashes.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        self.data = b"".join(texts)
        size = np.array([len(t) for t in texts], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(self.data, np.uint8)
        inside = kind[raw]
        before = np.empty_like(inside)
        if len(inside):
            before[1:] = inside[:-1]
            before[0] = False
            before[edge[:-1][size > 0]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        if len(inside):
            after[:-1] = inside[1:]
            after[-1] = False
            after[edge[1:][size > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, edge)
        n = len(raw)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[raw] + np.uint64(1)) * _powers(_M, n), out=total[1:])
        value = (total[self.end] - total[self.start]) * _powers(_INV, n + 1)[self.start]
        self.hash = mixed(value + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1, lower-cased, one space between."""
        return b" ".join(self.data[s:e].lower() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def pieces(texts: list[bytes], limit: int = 1 << 20):
    """Runs (from, to) of texts of at most ``limit`` bytes, or of one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]
