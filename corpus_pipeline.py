"""A corpus pipeline of five stages: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes what the one before it kept, written as Parquet and read back; all but the last return the columns of
documents.  Toxic documents, all but one of each group of near-duplicates and documents that share a passage with the
benchmark (of its items of ``ITEM_WORDS`` words or more) go; found secrets are blotted out in the texts; the last stage packs the texts into sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ngram_join, packing, secrets, toxicity
from tessera.llm.shared import compact, kept

#: Shorter benchmark items are common words that clean documents hold too.
ITEM_WORDS = 4


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.rejected_out(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.TAUGHT))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=ITEM_WORDS)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def rested(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, on executors that have given back what the one before it left free."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        compact(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", rested(remove_toxic)),
    ("ngram_join", rested(remove_near_duplicates)),
    ("decontamination", rested(remove_contaminated)),
    ("secrets", rested(blot_secrets)),
    ("packing", rested(pack)),
]

#: The first stage's classifier has no SQL form; tests hold the operators of the stages against brute force, a round trip or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
