"""What the operators of this subpackage share: readers, row keys, Arrow plumbing, checkpoints, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import shared_folder, sound_unions

#: Word separators of the contracts: space and \x09-\x0D.
SEPARATORS = " \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows and bytes of the Arrow slices that a function sees; keep a Python worker's memory bounded by the slice.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, behind which the worker hands back the memory it has freed: workers are reused, and what their allocators
    keep of one stage would add to what the next one needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other libraries return memory themselves
        if trim is not None:
            trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most BATCH_ROWS rows and about BATCH_BYTES, one row at least."""
    for batch in batches:
        rows = BATCH_ROWS
        if batch.num_rows:
            rows = max(1, min(rows, int(BATCH_BYTES * batch.num_rows // max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over small slices, so that what fn makes of long texts doesn't pile up in a worker. The size of the
    batches themselves is the session's own setting."""
    return df.mapInArrow(released(lambda batches: fn(slices(batches))), schema)


@contextlib.contextmanager
def no_cycles(end: Callable[[], None]) -> Iterator[None]:
    """Garbage collection off while caches without cycles grow; on again, after end(), however the task ends."""
    gc.disable()
    try:
        yield
    finally:
        end()
        gc.enable()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def saved(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that all executors share, with its lineage cut."""
    sound_unions(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Has shuffles and checkpoints removed that nothing refers to any more; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b: the smallest node of each one's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected `edges(a, b)`: root is the smallest node it can reach.

    Alternating large-star and small-star rounds, with partial minima before every shuffle; a star's hub
    is never collected, it is joined. Each round is checkpointed, so a lost executor costs one round.
    """
    e = saved(edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct())
    before = None
    for _ in range(most_rounds):
        both = e.union(e.selectExpr("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(low, "u").where("v > u").selectExpr("v u", "m v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = saved(large.join(least, "u").selectExpr("if(v = m, u, v) u", "m v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.countDistinct("u")).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.selectExpr("u node", "v root").union(e.selectExpr("v", "v").distinct())
