"""DNA tables derived from the star schema, alike in Spark and in DuckDB: customers are barcodes, orders noisy reads of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.calling import spread_out

LENGTH = 34
THRESHOLD = 9


def dna(x: str) -> str:
    """SQL for 34 bases derived from a string."""
    return f"substr(translate(concat(md5({x}), md5(concat({x}, 'x'))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, {LENGTH})"


def _light(text: str) -> tuple[str, str]:
    p1, p2 = "cast(1 + o_orderkey * 7 % 20 as int)", "cast(1 + o_orderkey * 3 % 10 as int)"
    s = dna(f"cast(o_custkey as {text})")
    tail = dna(f"concat('t', cast(o_orderkey as {text}))")
    inner = f"select o_orderkey as read_id, o_custkey as truth, {p1} as p1, {p2} as p2, {s} as s, {tail} as tl from orders"
    light = "substr(concat(substr(s, 1, p1 - 1), translate(substr(s, p1, 1), 'ACGT', 'CGTA'), substr(s, p1 + 1, p2), substr(s, p1 + p2 + 2), substr(tl, 1, 10)), 1, 34)"
    return inner, light


_CHANGE = "case when read_id % 4 <> 0 and (p * 7 + read_id) % (case read_id % 4 when 1 then 11 when 2 then 6 else 5 end) = 0 then translate(substr(light, p, 1), 'ACGT', 'GTAC') else substr(light, p, 1) end"
_INNER, _LIGHT = _light("varchar")
BARCODES = f"select c_custkey as barcode_id, {dna('cast(c_custkey as varchar)')} as seq from customer"
READS = f"select read_id, truth, array_to_string(list_transform(range(1, 35), lambda p: {_CHANGE}), '') as seq from (select read_id, truth, {_LIGHT} as light from ({_INNER}))"


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return t.selectExpr("c_custkey as barcode_id", f"{dna('cast(c_custkey as string)')} as seq", "concat('barcode', c_custkey) as name")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread_out(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    inner, light = _light("string")
    t = t.selectExpr(*[c.strip() for c in _columns(inner)]).selectExpr("read_id", "truth", f"{light} as light")
    return t.select("read_id", "truth", F.expr(f"array_join(transform(sequence(1, 34), p -> {_CHANGE}), '')").alias("seq"), F.expr("concat('read', read_id)").alias("name"))


def _columns(select: str) -> list[str]:
    """Top-level columns of ``select ... from orders``."""
    body, out, depth, last = select[len("select ") : select.rindex(" from ")], [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[last:i])
            last = i + 1
    return [*out, body[last:]]
