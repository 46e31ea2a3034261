"""Noisy reads from barcodes, for tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sequences import BASES


def mutate(seq: str, p: tuple[float, float, float], length: int | None, rng: np.random.Generator, compat: bool) -> str:
    """One noisy copy.

    ``compat``: an insertion makes another more likely and rules out a deletion, and the other way round; the bound of a
    deletion is not added to that of an insertion, so that at equal rates deletions never come.  The copy is padded with
    random bases or cut to ``length``.  Otherwise the three errors exclude each other and the copy has the barcode's length.
    """
    ins, dele, sub = p
    # by the last error: the draws below which the next is an insertion, and else a deletion
    bounds = {"": (ins, dele), "+": (ins + dele, 0.0), "-": (0.0, ins + dele)} if compat else dict.fromkeys(("", "+", "-"), (ins, ins + dele))
    out: list[str] = []
    i, last = 0, ""
    while i < len(seq):
        u = rng.random()
        more, less = bounds[last]
        last = "+" if u < more else "-" if u < less else ""
        if last == "+":
            out.append(BASES[rng.integers(4)])
            continue
        if not last:
            out.append([b for b in BASES if b != seq[i]][rng.integers(3)] if u < ins + dele + sub else seq[i])
        i += 1
    length = len(seq) if length is None or not compat else length
    while len(out) < length:
        out.append(BASES[rng.integers(4)])
    return "".join(out[:length])


def simulate(barcodes: DataFrame, n: int, p: float = 0.2, length: int | None = None, mode: str = "compat", seed: int = 0) -> DataFrame:
    """n reads (read_id, name, seq, barcode_id), dealt round the barcodes by barcode_id; a third of p for each kind of error.  The same seed gives the same reads."""
    if mode not in ("compat", "independent"):
        raise ValueError(f"unknown mode {mode}")
    spark = barcodes.sparkSession
    count = barcodes.count()
    if not count:
        raise ValueError("the barcode set is empty")
    ranked = barcodes.rdd.map(lambda r: (r["barcode_id"], r["seq"])).sortByKey().zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1])).toDF("turn long, barcode_id long, b string")
    rows = spark.range(n).select(F.col("id").alias("read_id"), F.pmod("id", F.lit(count)).alias("turn")).join(ranked, "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("read_id").to_pylist()
            seqs = [mutate(s, (p / 3,) * 3, length, np.random.Generator(np.random.Philox(key=[seed, i])), mode == "compat") for i, s in zip(ids, batch.column("b").to_pylist(), strict=True)]
            names = [f"read_{i + 1}_from_barcode_{t + 1}" for i, t in zip(ids, batch.column("turn").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("read_id"), pa.array(names), pa.array(seqs), batch.column("barcode_id")], names=["read_id", "name", "seq", "barcode_id"])

    return rows.mapInArrow(run, "read_id long, name string, seq string, barcode_id long")
