"""What the operators share: scratch tables, Arrow slicing, hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

__all__ = ["FINE_BYTES", "LEAVING", "POWERS", "SLICE_BYTES", "U64", "Powers", "Scratch", "buckets", "components", "grouped", "mix", "partition", "prefix_hashes", "release", "ship", "slices", "text_bytes"]
U64 = np.uint64
#: Bytes of text handled at a time inside one Python worker.
SLICE_BYTES = 2_000_000
#: Bytes of text whose hashes a worker holds at a time: each byte takes some hundred bytes of arrays meanwhile.
FINE_BYTES = 500_000
#: Spark's setting that drops an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds of grouped work after which a worker gives memory back.
PAUSE = 0.5
#: What to call when a worker is done with a partition: each empties a cache.
LEAVING: list[Callable[[], None]] = []


class Scratch:
    """Parquet tables below ``spark.checkpoint.dir``, the folder that all executors share.

    They cut lineage: what was written survives the loss of executors. A folder of
    its own is made only where the session names none and runs on one machine (tests).
    Shuffle files of a written table go as soon as it is written.
    """

    def __init__(self, spark: SparkSession) -> None:
        ship(spark)
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(base)
        self.base = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def buckets(spark: SparkSession) -> int:
    """Number of parts that a blob shuffle deals to: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, for rolling hashes."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def shrink(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.concatenate([np.ones(1, U64), np.full(size - 1, self.base)]).cumprod(dtype=U64)
            self.down = np.concatenate([np.ones(1, U64), np.full(size - 1, self.inverse)]).cumprod(dtype=U64)
        return self.up[:n], self.down[:n]


POWERS = Powers(0x9E3779B97F4A7C15)
LEAVING.append(POWERS.shrink)
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library: it has its own way
    _trim = None


def release() -> None:
    """Gives a worker's caches, Arrow's unused pool and freed heap back, so that a reused worker holds nothing of earlier stages."""
    for forget in LEAVING:
        forget()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def partition(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a partition, then :func:`release`."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


_paused = 0.0


def rest() -> None:
    """:func:`release`, if the last one is PAUSE seconds ago."""
    global _paused
    if time.monotonic() - _paused > PAUSE:
        release()
        _paused = time.monotonic()


def grouped(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``run`` of a group, and :func:`release` every so often."""

    @wraps(run)
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        rest()
        return out

    return one


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 sums; ``(p[e] - p[s]) * down[s]`` is a hash of ``data[s:e]`` alone."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n + 1 offsets; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, at = text_bytes(col)
    first = 0
    while first < len(col):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges`` (a, b).

    Labels take the least label next to them, then the label of their label, until
    nothing changes; each round is a written table, none of it goes to the driver.
    """
    both = edges.select("a", "b").where("a <> b")
    both = scratch.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("other"))
        low = labels.join(near, "node").select("node", F.least("component", "other").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        nxt = scratch.save(low.join(up, "component").select("node", F.least("component", "upper").alias("component"), "was"), f"{name}-{k + 1}")
        changed = nxt.where("component <> was").limit(1).count()
        scratch.drop(f"{name}-{k}")
        labels, k = nxt.select("node", "component"), k + 1
        if not changed:
            scratch.drop(f"{name}-links")
            return labels
