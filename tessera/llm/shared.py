"""Tables in the shared folder, fixed-size bitmaps of keys, and memory of executors and their Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import drop, folder, kept, place, remove

BITS = 26

__all__ = ["bitmap", "compact", "drop", "folder", "kept", "maybe", "place", "remove", "spare"]


def bitmap(df: DataFrame, key: Column, bits: int = BITS) -> np.ndarray:
    """Bits of the low ``bits`` bits of the given 64-bit keys: 2**bits / 8 bytes however many keys there are.

    ``maybe`` has no false negatives.  Past about 2**bits keys it stops to filter, and only costs time.
    """
    low = key.bitwiseAND(F.lit(2**bits - 1))
    rows = df.select(low.alias("k")).groupBy(F.shiftright("k", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(2**bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return out


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.int64) & (len(bits) * 64 - 1)
    return (bits[k >> 6] >> (k & 63)) & 1 == 1


def compact(spark: SparkSession) -> None:
    """Executors' JVMs collect, and give back to the system what is free: else a heap that one stage has filled stays as large beside the workers of the next.

    A task for each core, so that every executor has some.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def spare(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of mapInArrow, after which what its worker's allocators hold free goes back to the system: workers outlive tasks and stages."""

    def until(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return until
