"""Quality of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepted(threshold: int | None) -> Column:
    return F.col("distance1").isNotNull() & (F.lit(True) if threshold is None else F.col("distance1") <= threshold)


def precision(calls: DataFrame, truth: DataFrame, threshold: int | None = None) -> DataFrame:
    """(precision): correct among accepted reads; null if none is.  truth is (read_id, truth)."""
    both = calls.join(truth, "read_id").where(accepted(threshold))
    return both.agg((F.count_if(F.col("barcode1") == F.col("truth")) / F.nullif(F.count("*"), F.lit(0))).alias("precision"))


def recall(calls: DataFrame, threshold: int | None = None) -> DataFrame:
    """(recall): accepted among all reads, right or wrong."""
    return calls.agg((F.count_if(accepted(threshold)) / F.nullif(F.count("*"), F.lit(0))).alias("recall"))


def assigned_count(calls: DataFrame, threshold: int | None = None) -> DataFrame:
    return calls.agg(F.count_if(accepted(threshold)).alias("assigned"))


def run_report(calls: DataFrame, threshold: int | None = None) -> DataFrame:
    """(reads, assigned, percent)."""
    n = F.count_if(accepted(threshold))
    return calls.agg(F.count("*").alias("reads"), n.alias("assigned"), (100 * n / F.nullif(F.count("*"), F.lit(0))).alias("percent"))
