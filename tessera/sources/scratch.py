"""Tables in the shared folder: they end a plan's lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.  Where none is set, a local session gets one of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    at = place(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._tessera_at = at
    return out


def remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*frames: DataFrame) -> None:
    """Delete tables that ``kept`` wrote and nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df._tessera_at)
