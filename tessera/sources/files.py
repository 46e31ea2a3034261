"""Readers and writers of barcode, read, assignment and cost files.

All files are read by Spark's text reader, so any store that Spark reads will
do.  Lines are numbered within their file from the counts of its splits; records
are put together within a split, and only those that cross a split's border are
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import distance
from tessera.functions.sequences import sanitize

COST_LINES = 100_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, record, header, seq): lines 1 and 2 of every ``size`` lines; what is left over at a file's end is dropped."""
    lines = _lines(spark, path)
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("lines", F.sum("n").over(W.partitionBy("file")))
    table = before.collect()  # a row for each split
    sent = spark.sparkContext.broadcast({(r["file"], r["split"]): (r["base"], r["lines"] // size) for r in table})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, head = None, 0, None
        for batch in batches:
            rows: list[tuple] = []
            for value, file, split in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (file, split):
                    if head is not None:
                        rows.append((key[0], head[0], head[1], None))
                    key, head = (file, split), None
                    n, whole = sent.value[key]
                record, part = divmod(n, size)
                n += 1
                if record >= whole:
                    continue
                if part == 0:
                    head = (record, value)
                elif part == 1:
                    rows.append((file, record, head[1] if head else None, value))
                    head = None
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "record", "header", "seq"])
        if head is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((key[0], head[0], head[1], None), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "record", "header", "seq"])

    out = lines.mapInArrow(run, "file string, record long, header string, seq string")
    whole = out.where("header is not null and seq is not null")
    torn = out.where("header is null or seq is null").groupBy("file", "record").agg(F.max("header").alias("header"), F.max("seq").alias("seq"))
    return whole.unionByName(torn)


def _name(header):
    """The header without its first character, up to the first blank."""
    return F.regexp_extract(header, "^.([^ \\t]*)", 1)


def read_barcodes(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """(barcode_id, name, seq) of a file of two lines a record; sequences are taken as they are.  One of another length than the first (or ``length``) is an error when it is read."""
    rows = records(spark, path, 2).select(F.col("record").alias("barcode_id"), _name(F.col("header")).alias("name"), "seq")
    if length is None:
        first = rows.orderBy("barcode_id").first()
        length = len(first["seq"]) if first else 0
    bad = F.raise_error(F.concat(F.lit("barcode of wrong length: "), "name"))
    return rows.withColumn("seq", F.when(F.length("seq") == length, F.col("seq")).otherwise(bad.cast("string")))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_id, name, seq) of four lines a record; all but ACGTacgt is erased from sequences.  read_id counts within a file."""
    rows = records(spark, path, 4)
    return rows.select("file", F.col("record").alias("read_id"), _name(F.col("header")).alias("name"), sanitize(F.col("seq")).alias("seq"))


def read_assignment(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(read, barcode, distance) from lines of three fields between tabs or semicolons; one empty field at the end is passed over, any other number is an error."""
    lines = _lines(spark, path)
    if header:
        n = F.monotonically_increasing_id()
        lines = lines.withColumn("n", n)
        top = lines.groupBy("file").agg(F.min(F.struct("split", "n")).alias("top"))
        lines = lines.join(F.broadcast(top), "file").where(F.struct("split", "n") != F.col("top"))
    f = F.split(F.regexp_replace("value", "[;\\t]$", ""), "[;\\t]", -1)
    bad = F.raise_error(F.concat(F.lit("corrupted line: "), "value"))
    f = F.when(F.size(f) == 3, f).otherwise(bad.cast("array<string>"))
    return lines.select(f.alias("f")).select(F.col("f")[0].alias("read"), F.col("f")[1].alias("barcode"), F.col("f")[2].cast("int").alias("distance"))


def read_costs(spark: SparkSession, path: str) -> tuple[int, ...]:
    """A cost table; a file of at most ``COST_LINES`` lines (more are an error), of which the triples up to the first bad number count."""
    lines = spark.read.text(path).limit(COST_LINES + 1).collect()
    if len(lines) > COST_LINES:
        raise ValueError(f"a cost file of more than {COST_LINES} lines: {path}")
    words = " ".join(r["value"] for r in lines).split()
    good: list[str] = []
    for x, y, c in zip(words[::3], words[1::3], words[2::3], strict=False):
        if not c.lstrip("-").isdigit():
            break
        good += [x, y, c]
    return distance.table(" ".join(good))


def assignment_lines(calls: DataFrame, reads: DataFrame, barcodes: DataFrame, threshold: int | None = None, trailing_tab: bool = True) -> DataFrame:
    """(read_id, value): a line for each read that is accepted; names come from reads(read_id, name) and barcodes(barcode_id, name)."""
    rows = calls.where(F.col("distance1").isNotNull() & (F.lit(True) if threshold is None else F.col("distance1") <= threshold))
    rows = rows.join(reads.select("read_id", F.col("name").alias("r")), "read_id").join(barcodes.select(F.col("barcode_id").alias("barcode1"), F.col("name").alias("b")), "barcode1")
    cells = [F.col("r"), F.col("b"), F.col("distance1").cast("string"), *([F.lit("")] if trailing_tab else [])]
    return rows.select("read_id", F.concat_ws("\t", *cells).alias("value"))


def write_assignment(lines: DataFrame, path: str, header: str | None = "read\tbarcode1\tdistance1") -> None:
    """Lines in the order of read_id, in files that each open with the header."""
    rows = lines.repartitionByRange("read_id").sortWithinPartitions("read_id").select("value")
    if header is None:
        return rows.write.text(path)
    name = header
    return rows.withColumnRenamed("value", name).write.option("header", True).option("quote", "").option("sep", "\x01").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def fastq_lines(reads: DataFrame) -> DataFrame:
    """(read_id, value): four lines of each of reads(read_id, name, seq), with the quality I throughout."""
    return reads.select("read_id", F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), F.repeat(F.lit("I"), F.length("seq"))).alias("value"))


def barcode_lines(barcodes: DataFrame) -> DataFrame:
    return barcodes.select("barcode_id", F.concat(F.lit("@"), "name", F.lit("\n"), "seq").alias("value"))


def write_lines(lines: DataFrame, key: str, path: str) -> None:
    lines.repartitionByRange(key).sortWithinPartitions(key).select("value").write.text(path)
