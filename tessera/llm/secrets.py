"""Secret scans with multipart credential linking, in DataFrame operations alone.

Base findings are reported wherever they are.  Weak candidates (a login-like
assignment, a bare 40-character token, a URL, an assigned secret too short for
a base finding) mean little alone; they are reported only where complementary
parts lie within one scope: an identifier near a secret, a secret near an
identifier, an endpoint near both.

Places are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.shared import kept

SCOPE = 256
#: Kinds in the order in which spans with one start are listed; the first three are base findings.
KINDS = ("assign", "access", "hex", "login", "bare", "endpoint")
BASE = 3
#: The weak kind after those: an assignment whose value has fewer than ``LEAST`` characters.
SHORT = len(KINDS)
LEAST = 8
#: Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LOGIN = r"""(?i)(user|username|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
BARE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+"""
SPANS = "array<struct<s:int,k:int,e:int>>"
CELLS = "array<struct<k:int,i:int,gap:int,hit:int,value:int,gap_b:int,hit_b:int>>"


def lengths(text: Column, pattern: str, kind: int) -> Column:
    """Of each leftmost non-overlapping match: kind, number, lengths of the gap before it, of itself and of its second group, and the first two in bytes.

    Lengths alone, whose running sums are places: no array grows match by match.
    """
    cells = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")]
    value = F.lit(0)
    if kind == 0:
        cells.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))

    def cell(x: Column, i: Column) -> Column:
        of = F.length(x["value"]) if kind == 0 else value
        return F.struct(F.lit(kind).alias("k"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), of.alias("value"), F.octet_length(x["gap"]).alias("gap_b"), F.octet_length(x["hit"]).alias("hit_b"))

    return F.when(text.rlike(pattern), F.transform(F.arrays_zip(*cells), cell)).otherwise(F.array().cast(CELLS))


def listed(of: Column) -> Column:
    """kind:start:end of the spans, by start and then kind, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, "short")))
    return F.array_join(F.transform(F.array_sort(of), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _found(docs: DataFrame, scope: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, dh) of every row of docs, and (doc_id, dh, k, s, e, sb, eb), sb and eb in bytes, of every base span and linked weak span of each different row."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("dh"), t.alias("text"))
    patterns = (ASSIGN, ACCESS, HEX, LOGIN, BARE, ENDPOINT)
    rows = kept(rows.select("doc_id", "dh", F.concat(*[lengths(F.col("text"), p, k) for k, p in enumerate(patterns)]).alias("cells")), "secrets")
    row, place = ["doc_id", "dh"], W.partitionBy("doc_id", "dh")
    cells = rows.where(F.size("cells") > 0).dropDuplicates(row).select(*row, F.inline("cells")).where("hit is not null")
    by = W.partitionBy("doc_id", "dh", "k").orderBy("i")
    p = cells.withColumns({"e": F.sum(F.col("gap") + F.col("hit")).over(by).cast("int"), "eb": F.sum(F.col("gap_b") + F.col("hit_b")).over(by).cast("int")})
    p = p.select(*row, F.when((F.col("k") == 0) & (F.col("value") < LEAST), SHORT).otherwise(F.col("k")).alias("k"), (F.col("e") - F.col("hit")).alias("s"), "e", (F.col("eb") - F.col("hit_b")).alias("sb"), "eb")
    # a weak span that a base span overlaps is none: one that starts no later and ends behind its start, or one that starts in it
    base = F.col("k") < BASE
    before = F.max(F.when(base, F.col("e"))).over(place.orderBy("s").rangeBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("s"))).over(place.orderBy(F.desc("s")).rangeBetween(W.unboundedPreceding, -1))
    p = p.withColumns({"before": before, "after": after}).where(base | ~(F.coalesce(F.col("before") > F.col("s"), F.lit(False)) | F.coalesce(F.col("after") < F.col("e"), F.lit(False))))
    p = kept(p.drop("before", "after"), "spans")
    # the interval join of weak spans with identifiers and secrets within their scope
    parts = p.select(*row, F.col("s").alias("ps"), F.col("k").isin(1, 3).alias("is_id"), F.col("k").isin(0, 2, 4, SHORT).alias("is_secret")).where("is_id or is_secret")
    parts = parts.withColumn("cell", F.explode(F.array(*[F.floor(F.col("ps") / scope) + k for k in (-1, 0, 1)])))
    weak = p.where(F.col("k") >= BASE).withColumn("cell", F.floor(F.col("s") / scope))
    near = weak.alias("w").join(parts.alias("p"), F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.dh") == F.col("p.dh")) & (F.col("w.cell") == F.col("p.cell")) & (F.abs(F.col("ps") - F.col("s")) <= scope))
    columns = [*row, "k", "s", "e", "sb", "eb"]
    near = near.groupBy(*[F.col(f"w.{c}").alias(c) for c in columns]).agg(F.max("is_id").alias("has_id"), F.max("is_secret").alias("has_secret"))
    keep = F.when(F.col("k") == 3, F.col("has_secret")).when(F.col("k").isin(4, SHORT), F.col("has_id")).otherwise(F.col("has_id") & F.col("has_secret"))
    return rows.select(*row), p.where(F.col("k") < BASE).select(columns).union(near.where(keep).select(columns))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, dh, base, weak) of every row: arrays of spans (s, k, e), k an index of KINDS or SHORT; dh is xxhash64 of the text.

    A null text is empty and has none.  Rows that are there twice give rows twice.
    """
    rows, found = _found(docs, scope)
    one = F.struct("s", "k", "e")
    lists = found.groupBy("doc_id", "dh").agg(F.collect_list(F.when(F.col("k") < BASE, one)).alias("base"), F.collect_list(F.when(F.col("k") >= BASE, one)).alias("weak")).toDF("c_id", "c_dh", "base", "weak")
    out = rows.join(lists, rows["doc_id"].eqNullSafe(lists["c_id"]) & (rows["dh"] == lists["c_dh"]), "left")
    return out.select("doc_id", "dh", *[F.coalesce(c, F.array().cast(SPANS)).alias(c) for c in ("base", "weak")])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with ``mark`` in place of every found span of their text; overlapping spans become one.  A null text stays null."""
    found = _found(docs, SCOPE)[1]
    by = W.partitionBy("doc_id", "dh").orderBy("s", "k")
    first = F.coalesce(F.col("s") >= F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    runs = found.withColumn("first", first).withColumn("run", F.sum(F.col("first").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "dh", "run").agg(F.min("sb").alias("sb"), F.max("eb").alias("eb"))
    cuts = kept(runs.groupBy("doc_id", "dh").agg(F.sort_array(F.collect_list(F.struct("sb", "eb"))).alias("c_cuts")).toDF("c_id", "c_dh", "c_cuts"), "cuts")
    both = docs.join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col("c_id")) & (F.xxhash64("text") == F.col("c_dh")), "left")
    data, c = F.col("text").cast("binary"), F.col("c_cuts")
    last = lambda i: F.when(i > 0, F.get(c, i - 1)["eb"]).otherwise(F.lit(0))
    parts = F.transform(c, lambda x, i: F.substring(data, last(i) + 1, x["sb"] - last(i)).cast("string"))
    tail = F.substring(data, F.get(c, F.size(c) - 1)["eb"] + 1, F.octet_length("text")).cast("string")
    clean = F.concat(F.array_join(parts, mark), F.lit(mark), tail)
    return both.select(*[F.when(c.isNotNull(), clean).otherwise(F.col("text")).alias("text") if name == "text" else F.col(name) for name in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "weak")).alias("spans"))
