"""Queries by name, each over its whole tables, and their DuckDB equivalents.

``brute_force_nn`` has none, as DuckDB takes minutes for all pairs; tests hold it against a scalar recurrence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distance as D
from tessera.functions import sequences as S
from tessera.operators import calling as C
from tessera.operators import index as I
from tessera.operators import metrics as M
from tessera.operators.simulate import simulate
from tessera.plans.fixtures import BARCODES, LENGTH, READS, THRESHOLD, barcodes, reads
from tessera.sources import files
from tessera.sources.scratch import place

#: gap 2, transition 1, transversion 3
COSTS = D.table("A - 2 C - 2 T - 2 G - 2 - A 2 - C 2 - T 2 - G 2 A G 1 G A 1 C T 1 T C 1 A C 3 C A 3 A T 3 T A 3 G C 3 C G 3 G T 3 T G 3")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# SQL of the parts

def _kmers(of: str, key: str, k: int, at: str) -> str:
    return f"select {key}, {at}, substr(seq, cast({at} + 1 as bigint), {k}) as kmer from (select {key}, seq, unnest(range(0, least(length(seq), {LENGTH}) - {k} + 1)) as {at} from ({of}))"


def _band(k: int) -> str:
    return f"select read_id, i, barcode_id, j from ({_kmers(READS, 'read_id', k, 'i')}) r join ({_kmers(BARCODES, 'barcode_id', k, 'j')}) b on r.kmer = b.kmer and abs(i - j) <= 5"


def _pd(k: int) -> str:
    return f"select read_id, barcode_id, cast(sum(abs(i - j) - {LENGTH}) as int) as pd from ({_band(k)}) group by 1, 2"


def _top(k: int) -> str:
    return f"select *, cast(row_number() over (partition by read_id order by pd, barcode_id) as int) as rank from ({_pd(k)}) qualify rank <= 100"


_SL = "cast(list_min(list_concat(list_transform(range(1, length(r) + 1), lambda n: levenshtein(b, substr(r, 1, n))), list_transform(range(0, length(b)), lambda n: levenshtein(substr(b, 1, n), r)))) as int)"
_TRUE = f"select read_id, b.seq as b, r.seq as r from ({READS}) r join ({BARCODES}) b on barcode_id = truth"


_WORD = 2**LENGTH - 1


def _measured(pairs: str, prefix: bool = True) -> str:
    """pairs(read_id, barcode_id, b, r) of LENGTH bases each, with their unit-cost distance: a column of the distance matrix is two words of differences."""
    mask = lambda x: f"list_sum(list_transform(range(0, {LENGTH}), lambda j: case when substr(b, j + 1, 1) = '{x}' then 1::bigint << j else 0 end))::bigint as m{x}"
    masks = f"select b, {', '.join(map(mask, 'ACGT'))} from (select distinct seq as b from ({BARCODES}))"
    t = f"select *, {_WORD}::bigint as up, 0::bigint as down, {LENGTH}::bigint as score, {LENGTH}::bigint as best from ({pairs}) join ({masks}) using (b)"
    for i in range(1, LENGTH + 1):
        t = f"select *, case substr(r, {i}, 1) when 'A' then mA when 'C' then mC when 'G' then mG else mT end as e from ({t})"
        t = f"select * exclude (e), ((xor((e & up) + up, up) | e | down) & {_WORD}) as diag from ({t})"
        t = f"select *, down | xor({_WORD}, diag | up) as rightw, up & diag as leftw from ({t})"
        t = f"select * exclude (rightw, leftw), (((rightw << 1) | 1) & {_WORD}) as rightw, ((leftw << 1) & {_WORD}) as leftw, (rightw >> {LENGTH - 1}) - (leftw >> {LENGTH - 1}) as more from ({t})"
        t = f"select * exclude (up, down, score, best, diag, rightw, leftw, more), leftw | xor({_WORD}, diag | down | rightw) as up, rightw & (diag | down) as down, score + more as score, least(best, score + more) as best from ({t})"
    row = f"list_min(list_transform(range(0, {LENGTH}), lambda j: {LENGTH} + bit_count(up & ((1::bigint << j) - 1)) - bit_count(down & ((1::bigint << j) - 1))))"
    return f"select read_id, barcode_id, cast({f'least(best, {row})' if prefix else 'score'} as int) as dist from ({t})"


def _weighed(pairs: str, prefix: bool = True) -> str:
    """pairs(read_id, barcode_id, b, r) with their distance by COSTS: gap 2, transition 1, transversion 3."""
    sub = "case when substr(b, j, 1) = substr(r, i + 1, 1) then 0 when substr(b, j, 1) || substr(r, i + 1, 1) in ('AG', 'GA', 'CT', 'TC') then 1 else 3 end"
    start = f"select read_id, barcode_id, b, r, 0 as i, list_transform(range(0, {LENGTH + 1}), lambda j: 2 * j) as d, 1000000::bigint as best from ({pairs})"
    without = f"select *, list_transform(range(0, {LENGTH + 1}), lambda j: case when j = 0 then d[1] + 2 else least(d[j] + {sub}, d[j + 1] + 2) - 2 * j end) as x from t where i < {LENGTH}"
    step = f"select read_id, barcode_id, b, r, i + 1, list_transform(range(0, {LENGTH + 1}), lambda j: 2 * j + list_min(x[1 : j + 1])) as d, least(best, list_min(list_transform(x, lambda y: y + {2 * LENGTH}))) as best from ({without})"
    last = f"least(best, list_min(d[1 : {LENGTH}]))" if prefix else f"d[{LENGTH + 1}]"
    return f"with recursive t as ({start} union all {step}) select read_id, barcode_id, cast({last} as int) as dist from t where i = {LENGTH}"


def _calls(k: int, measured=_measured) -> str:
    pairs = f"select t.read_id, t.barcode_id, b.seq as b, r.seq as r from ({_top(k)}) t join ({BARCODES}) b using (barcode_id) join ({READS}) r using (read_id)"
    ranked = f"select *, row_number() over (partition by read_id order by dist, barcode_id) as n from ({measured(pairs)})"
    best = f"select read_id, max(case when n = 1 then barcode_id end) as barcode1, max(case when n = 1 then dist end) as distance1, max(case when n = 2 then barcode_id end) as barcode2, max(case when n = 2 then dist end) as distance2 from ({ranked}) where n <= 2 group by read_id"
    return f"select r.read_id, barcode1, distance1, barcode2, distance2 from ({READS}) r left join ({best}) c on r.read_id = c.read_id"


def _two_step(large: int, small: int) -> str:
    columns = ", ".join(f"case when ok then l.{c} else s.{c} end as {c}" for c in ("barcode1", "distance1", "barcode2", "distance2"))
    return f"select read_id, {columns} from (select *, coalesce(distance1 <= {THRESHOLD}, false) as ok from ({_calls(large)})) l join ({_calls(small)}) s using (read_id)"


_TRUE_PAIRS = f"select read_id, truth as barcode_id, b, r from ({_TRUE.replace('read_id,', 'read_id, truth,', 1)})"


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return barcodes(spark, sf_dir), reads(spark, sf_dir)


def _true(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, r = _pair(spark, sf_dir)
    return r.select("read_id", "truth", F.col("seq").alias("r")).join(b.select(F.col("barcode_id").alias("truth"), F.col("seq").alias("b")), "truth")


# functions and sources


@query("select doc_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) as seq from documents")
def scan_reads_sanitize(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.sanitize(F.col("text")).alias("seq"))


@query(f"select barcode_id, translate(seq, 'ACTG', '0123') as code, seq as back from ({BARCODES})")
def encode_bases(spark, sf_dir):
    code = S.encode(F.col("seq"))
    return barcodes(spark, sf_dir).select("barcode_id", code.alias("code"), S.decode(code).alias("back"))


@query(f"select barcode_id, array_to_string(list_transform(range(1, 34, 4), lambda i: printf('%02X', cast(64 * (instr('ACTG', substr(s, i, 1)) - 1) + 16 * (instr('ACTG', substr(s, i + 1, 1)) - 1) + 4 * (instr('ACTG', substr(s, i + 2, 1)) - 1) + instr('ACTG', substr(s, i + 3, 1)) - 1 as int))), '') as packed from (select barcode_id, concat(seq, 'AA') as s from ({BARCODES}))")
def pack_2bit(spark, sf_dir):
    return barcodes(spark, sf_dir).select("barcode_id", S.pack(F.col("seq")).alias("packed"))


@query(f"select barcode_id, concat('barcode', barcode_id) as name, seq from ({BARCODES})")
def scan_barcodes(spark, sf_dir):
    """Barcodes written to a file and read back; the id is that of the name."""
    path = place(spark, "bc")
    files.write_lines(files.barcode_lines(barcodes(spark, sf_dir)), "barcode_id", path)
    back = files.read_barcodes(spark, path, LENGTH)
    return back.select(F.substring("name", 8, 20).cast("long").alias("barcode_id"), "name", "seq")


@query(f"select concat('read', read_id) as name, seq from ({READS})")
def scan_fastq(spark, sf_dir):
    path = place(spark, "fastq")
    files.write_lines(files.fastq_lines(reads(spark, sf_dir)), "read_id", path)
    return files.read_fastq(spark, path).select("name", "seq")


@query(f"select concat('read', read_id) as read, concat('barcode', truth) as barcode, 0 as distance from ({READS})")
def scan_assignment(spark, sf_dir):
    path = place(spark, "truth")
    lines = reads(spark, sf_dir).select("read_id", F.concat_ws("\t", "name", F.concat(F.lit("barcode"), "truth"), F.lit("0")).alias("value"))
    files.write_lines(lines, "read_id", path)
    return files.read_assignment(spark, path, header=False)


@query(f"select read_id, concat('@read', read_id, chr(10), seq, chr(10), '+', chr(10), repeat('I', length(seq))) as value from ({READS})")
def fastq_format(spark, sf_dir):
    return files.fastq_lines(reads(spark, sf_dir))


@query(f"select barcode_id, concat('@barcode', barcode_id, chr(10), seq) as value from ({BARCODES})")
def bc_format(spark, sf_dir):
    return files.barcode_lines(barcodes(spark, sf_dir))


# index and joins


@query(_kmers(BARCODES, "barcode_id", 7, "pos"))
def kmer_explode(spark, sf_dir):
    return I.kmer_explode(barcodes(spark, sf_dir), "barcode_id", 7, LENGTH)


@query(f"select kmer, pos, string_agg(barcode_id, ',' order by barcode_id) as ids from ({_kmers(BARCODES, 'barcode_id', 5, 'pos')}) group by 1, 2")
def kmer_index(spark, sf_dir):
    return I.kmer_index(barcodes(spark, sf_dir), 5, LENGTH).withColumn("ids", F.array_join("ids", ","))


@query(f"select kmer, i, j, barcode_id from (select kmer, j, barcode_id, unnest(range(greatest(j - 5, 0), least(j + 5, {LENGTH - 7}) + 1)) as i from ({_kmers(BARCODES, 'barcode_id', 7, 'j')}))")
def kmer_index_windowed(spark, sf_dir):
    return I.windowed_index(barcodes(spark, sf_dir), 7, LENGTH)


@query(_band(7))
def band_join(spark, sf_dir):
    b, r = _pair(spark, sf_dir)
    return C.band(r, b, 7, LENGTH)


@query(_band(7))
def band_join_equi(spark, sf_dir):
    b, r = _pair(spark, sf_dir)
    return C.band(r, b, 7, LENGTH)


@query(_pd(7))
def pseudo_distance(spark, sf_dir):
    b, r = _pair(spark, sf_dir)
    return C.scored(r, b, 7, LENGTH)


@query(_top(7))
def topk_candidates(spark, sf_dir):
    b, r = _pair(spark, sf_dir)
    return C.scored(r, b, 7, LENGTH, n=I.CANDIDATES)


@query(f"select read_id, arg_min(barcode_id, cast(pd as bigint) * 1000000000 + barcode_id) as barcode_id, min(pd) as pd from ({_pd(7)}) group by 1")
def argmin(spark, sf_dir):
    b, r = _pair(spark, sf_dir)
    return C.scored(r, b, 7, LENGTH, n=1).drop("rank")


# distances


@query(f"select read_id, cast(levenshtein(b, r) as int) as dist from ({_TRUE})")
def levenshtein(spark, sf_dir):
    return _true(spark, sf_dir).select("read_id", D.levenshtein(F.col("b"), F.col("r")).alias("dist"))


@query(f"select read_id, cast(least(levenshtein(b, r), 5) as int) as dist from ({_TRUE})")
def bounded_levenshtein(spark, sf_dir):
    return _true(spark, sf_dir).select("read_id", D.levenshtein(F.col("b"), F.col("r"), 5).alias("dist"))


@query(f"select read_id, {_SL} as dist from ({_TRUE})")
def sequence_levenshtein(spark, sf_dir):
    return _true(spark, sf_dir).select("read_id", D.sequence_levenshtein(F.col("b"), F.col("r")).alias("dist"))


@query(f"select read_id, least({_SL}, 4) as dist from ({_TRUE})")
def bounded_sequence_levenshtein(spark, sf_dir):
    return _true(spark, sf_dir).select("read_id", D.sequence_levenshtein(F.col("b"), F.col("r"), 4).alias("dist"))


@query(f"select read_id, cast(levenshtein(b, r) as int) as unit_cost from ({_TRUE})")
def weighted_levenshtein_unit(spark, sf_dir):
    return _true(spark, sf_dir).select("read_id", D.weighted_levenshtein(F.col("b"), F.col("r"), D.UNIT).alias("unit_cost"))


@query(f"select read_id, dist from ({_weighed(_TRUE_PAIRS, False)})")
def weighted_levenshtein(spark, sf_dir):
    return _true(spark, sf_dir).select("read_id", D.weighted_levenshtein(F.col("b"), F.col("r"), COSTS).alias("dist"))


@query(f"select read_id, {_SL} as unit_cost from ({_TRUE})")
def weighted_sequence_levenshtein_unit(spark, sf_dir):
    return _true(spark, sf_dir).select("read_id", D.weighted_sequence_levenshtein(F.col("b"), F.col("r"), D.UNIT).alias("unit_cost"))


@query(f"select read_id, dist from ({_weighed(_TRUE_PAIRS)})")
def weighted_sequence_levenshtein(spark, sf_dir):
    return _true(spark, sf_dir).select("read_id", D.weighted_sequence_levenshtein(F.col("b"), F.col("r"), COSTS).alias("dist"))


# calls


def _call(k: int, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.call(*_pair(spark, sf_dir), k, **options)

    return run


QUERIES |= {f"call_k{k}": _call(k) for k in (4, 5, 6, 7)}
QUERIES |= {"call_k7_levenshtein": _call(7, distance="levenshtein"), "call_k7_join": _call(7, plan="join"), "call_k7_weighted": _call(7, costs=COSTS)}
ORACLE |= {f"call_k{k}": _calls(k) for k in (4, 5, 6, 7)}
ORACLE |= {"call_k7_levenshtein": _calls(7, lambda pairs: _measured(pairs, False)), "call_k7_join": _calls(7), "call_k7_weighted": _calls(7, _weighed)}


@query(_calls(5))
def top2_assignment(spark, sf_dir):
    return C.call(*_pair(spark, sf_dir), 5)


@query(f"select read_id from ({_calls(7)}) where distance1 is null or distance1 > {THRESHOLD}")
def two_step_unassigned(spark, sf_dir):
    return C.unassigned(C.call(*_pair(spark, sf_dir), 7), THRESHOLD).select("read_id")


@query(_two_step(7, 4))
def two_step_7_4(spark, sf_dir):
    return C.run_method("7-4-mer-filter", *_pair(spark, sf_dir), THRESHOLD)


@query(_two_step(7, 5))
def two_step_7_5(spark, sf_dir):
    return C.run_method("7-5-mer-filter", *_pair(spark, sf_dir), THRESHOLD)


@query()
def brute_force_nn(spark, sf_dir):
    return C.nearest(*_pair(spark, sf_dir))


@query(f"select read_id, concat('read', read_id, chr(9), 'barcode', barcode1, chr(9), distance1, chr(9)) as value from ({_calls(7)}) where distance1 <= {THRESHOLD}")
def assign_output(spark, sf_dir):
    b, r = _pair(spark, sf_dir)
    return files.assignment_lines(C.call(b, r, 7), r, b, THRESHOLD)


@query(f"select read_id, concat('read', read_id, chr(9), 'barcode', truth, chr(9), {_SL}) as value from (select read_id, truth, b.seq as b, r.seq as r from ({READS}) r join ({BARCODES}) b on barcode_id = truth)")
def ground_truth_output(spark, sf_dir):
    b, r = _pair(spark, sf_dir)
    truth = _true(spark, sf_dir).select("read_id", F.col("truth").alias("barcode1"), D.sequence_levenshtein(F.col("b"), F.col("r")).alias("distance1"))
    return files.assignment_lines(truth, r, b, trailing_tab=False)


@query()
def simulate_reads(spark, sf_dir):
    of = barcodes(spark, sf_dir)
    return simulate(of, 2 * of.count())


# metrics


@query(f"select cast(count(*) filter (distance1 <= {THRESHOLD}) as bigint) as assigned from ({_calls(7)})")
def assigned_count(spark, sf_dir):
    return M.assigned_count(C.call(*_pair(spark, sf_dir), 7), THRESHOLD)


@query(f"select count(*) filter (barcode1 = truth) / nullif(count(*), 0) as precision from ({_calls(7)}) c join (select read_id, truth from ({READS})) t using (read_id) where distance1 <= {THRESHOLD}")
def precision(spark, sf_dir):
    b, r = _pair(spark, sf_dir)
    return M.precision(C.call(b, r, 7), r.select("read_id", "truth"), THRESHOLD)


@query(f"select count(*) filter (distance1 <= {THRESHOLD}) / nullif(count(*), 0) as recall from ({_calls(7)})")
def recall(spark, sf_dir):
    return M.recall(C.call(*_pair(spark, sf_dir), 7), THRESHOLD)


@query(f"select count(*) as reads, count(*) filter (distance1 <= {THRESHOLD}) as assigned, 100 * count(*) filter (distance1 <= {THRESHOLD}) / nullif(count(*), 0) as percent from ({_calls(7)})")
def run_report(spark, sf_dir):
    return M.run_report(C.call(*_pair(spark, sf_dir), 7), THRESHOLD)
