"""Calls on a stream of reads.  Each read is called on its own, so the stream keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.calling import call


def call_stream(barcodes: DataFrame, reads: DataFrame, k: int = 4, **options) -> DataFrame:
    """A streaming DataFrame of calls of the streaming reads(read_id, seq); barcodes is static and its index is built once."""
    return call(barcodes, reads, k, plan="map", **options)
