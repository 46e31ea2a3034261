"""The positional k-mer index as a DataFrame, and the joins on it.

Barcodes are (barcode_id int or long, seq), reads (read_id, seq).  Positions count from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.sequences import kmers

WINDOW = 5
CANDIDATES = 100


def kmer_explode(df: DataFrame, key: str, k: int, length: int, at: str = "pos") -> DataFrame:
    """(key, at, kmer) of the k-mers among the first ``length`` bases."""
    return df.select(key, F.posexplode(kmers(F.col("seq"), k, length)).alias(at, "kmer"))


def kmer_index(barcodes: DataFrame, k: int, length: int) -> DataFrame:
    """(kmer, pos, ids): barcode ids in ascending order."""
    return kmer_explode(barcodes, "barcode_id", k, length).groupBy("kmer", "pos").agg(F.sort_array(F.collect_list("barcode_id")).alias("ids"))


def windowed_index(barcodes: DataFrame, k: int, length: int, window: int = WINDOW) -> DataFrame:
    """(kmer, i, j, barcode_id): a row for every read position i from which the k-mer at j is within the window, so that the band join is an equi-join."""
    rows = kmer_explode(barcodes, "barcode_id", k, length, "j")
    reach = F.sequence(F.greatest(F.col("j") - window, F.lit(0)), F.least(F.col("j") + window, F.lit(length - k)))
    return rows.select("kmer", F.explode(reach).alias("i"), "j", "barcode_id")


def band_join(reads: DataFrame, barcodes: DataFrame, k: int, length: int, window: int = WINDOW) -> DataFrame:
    """(read_id, i, barcode_id, j) of equal k-mers at most ``window`` apart."""
    left = kmer_explode(reads, "read_id", k, length, "i")
    right = kmer_explode(barcodes, "barcode_id", k, length, "j")
    return left.join(right.hint("merge"), (left["kmer"] == right["kmer"]) & (F.abs(F.col("i") - F.col("j")) <= window)).select("read_id", "i", "barcode_id", "j")


def band_join_equi(reads: DataFrame, barcodes: DataFrame, k: int, length: int, window: int = WINDOW) -> DataFrame:
    """``band_join`` by equality; both sides are dealt out, as the exploded index is far larger than Spark takes it for, and would not fit a broadcast."""
    left = kmer_explode(reads, "read_id", k, length, "i")
    return left.join(windowed_index(barcodes, k, length, window).hint("merge"), ["kmer", "i"]).select("read_id", "i", "barcode_id", "j")


def pseudo_distance(reads: DataFrame, barcodes: DataFrame, k: int, length: int, window: int = WINDOW) -> DataFrame:
    """(read_id, barcode_id, pd): the sum of |i - j| - length over all matches."""
    rows = band_join_equi(reads, barcodes, k, length, window)
    return rows.groupBy("read_id", "barcode_id").agg(F.sum(F.abs(F.col("i") - F.col("j")) - length).cast("int").alias("pd"))


def top_candidates(scored: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The n rows of each read with the least pd, ties by barcode_id."""
    by = W.partitionBy("read_id").orderBy("pd", "barcode_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
