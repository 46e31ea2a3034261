import os
import pickle
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions import distance as D
from tessera.operators import calling, index, metrics
from tessera.operators.simulate import simulate

B1 = "CGTCCATCTTCATATGCGTCCTCGACTAGTGCTA"
#: read, Levenshtein, sequence Levenshtein, pseudo distance with k = 4 and 7
GOLDEN = [
    (B1, 0, 0, -1054, -952),
    ("CGTCCCTCTTCATATGCGTCCTCGACTAGTGCTA", 1, 1, -918, -748),
    ("CGTCCATCTTATATGCGTCCTCGACTAGTGCTAG", 2, 1, -927, -697),
    ("CGTTCCATCTTCATATGCGTCCTCGACTAGTGCT", 2, 1, -924, -825),
    (B1 + "ACGTACGT", 8, 0, -1054, -952),
    ("CGTCCATCTTCATATGCGTC", 14, 0, -578, -476),
    ("", 34, 0, None, None),
]


def dp(b, r, prefix, c=D.UNIT):
    c = D.square(c)
    d = np.zeros((len(r) + 1, len(b) + 1), int)
    for j in range(len(b)):
        d[0, j + 1] = d[0, j] + c[b[j], 4]
    for i in range(len(r)):
        d[i + 1, 0] = d[i, 0] + c[4, r[i]]
        for j in range(len(b)):
            d[i + 1, j + 1] = min(d[i, j] + c[r[i], b[j]], d[i, j + 1] + c[r[i], 4], d[i + 1, j] + c[4, b[j]])
    if not prefix:
        return d[-1, -1]
    return min(d[1:, -1].min(), d[-1, :-1].min()) if len(r) else 0


@pytest.mark.parametrize("prefix", [False, True])
def test_distances_equal_scalar_dp(prefix):
    rng = np.random.default_rng(1)
    costs = tuple(int(x) for x in rng.integers(0, 5, 25))
    b = [rng.integers(0, 4, rng.integers(1, 13)).astype(np.uint8) for _ in range(150)]
    r = [rng.integers(0, 4, rng.integers(0, 15)).astype(np.uint8) for _ in range(150)]
    assert D.pairs(b, r, None, prefix).tolist() == [dp(x, y, prefix) for x, y in zip(b, r, strict=True)]
    assert D.pairs(b, r, costs, prefix).tolist() == [dp(x, y, prefix, costs) for x, y in zip(b, r, strict=True)]


def test_golden(spark):
    bs, rs = D.codes([B1] * len(GOLDEN)), D.codes([g[0] for g in GOLDEN])
    assert D.pairs(bs, rs, None, False).tolist() == [g[1] for g in GOLDEN]
    assert D.pairs(bs, rs, None, True).tolist() == [g[2] for g in GOLDEN]
    barcodes = spark.createDataFrame([(0, B1)], "barcode_id long, seq string")
    reads = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "read_id long, seq string")
    for k, at in ((4, 3), (7, 4)):
        got = {r.read_id: r.pd for r in index.pseudo_distance(reads, barcodes, k, 34).collect()}
        assert got == {i: g[at] for i, g in enumerate(GOLDEN) if g[at] is not None}


def brute(barcodes, reads, k, n=100, window=5):
    out = {}
    for i, r in enumerate(reads):
        scored = []
        for j, b in enumerate(barcodes):
            s = sum(abs(x - y) - len(b) for x in range(min(len(r), len(b)) - k + 1) for y in range(max(0, x - window), min(x + window, len(b) - k) + 1) if r[x : x + k] == b[y : y + k] and set(r[x : x + k]) <= set("ACGT"))
            if s < 0:
                scored.append((s, j))
        code = D.codes([r])[0]
        best = sorted((int(dp(D.codes([barcodes[j]])[0], code, True)), j) for _, j in sorted(scored)[:n])[:2]
        best += [(None, None)] * (2 - len(best))
        out[i] = (best[0][1], best[0][0], best[1][1], best[1][0])
    return out


@pytest.mark.parametrize(("plan", "k"), [("map", 4), ("map", 5), ("map", 6), ("join", 4)])
def test_call_equals_brute_force(spark, plan, k):
    rng = random.Random(5)
    barcodes = ["".join(rng.choices("ACGT", k=12)) for _ in range(30)]
    barcodes[7] = barcodes[3]  # a tie
    barcodes[8] = barcodes[8][:5] + "N" + barcodes[8][6:]
    reads = ["", "AC", barcodes[3], barcodes[8], barcodes[1][:6] + "N" + barcodes[1][7:], barcodes[2] + "N-_", "-" + barcodes[4], "N" * 12, *["".join(c if rng.random() > 0.2 else rng.choice("ACGT") for c in rng.choice(barcodes)) + rng.choice(["", "GATT"]) for _ in range(40)]]
    b = spark.createDataFrame(list(enumerate(barcodes)), "barcode_id long, seq string")
    r = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    got = {x.read_id: tuple(x)[1:] for x in calling.call(b, r, k, n=5, plan=plan).collect()}
    assert got == brute(barcodes, reads, k, n=5)


def test_two_step_and_errors(spark):
    rng = random.Random(6)
    barcodes = ["".join(rng.choices("ACGT", k=20)) for _ in range(20)]
    reads = ["".join(c if rng.random() > 0.25 else rng.choice("ACGT") for c in rng.choice(barcodes)) for _ in range(40)]
    b = spark.createDataFrame(list(enumerate(barcodes)), "barcode_id long, seq string")
    r = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    rows = lambda df: {x.read_id: tuple(x)[1:] for x in df.collect()}
    large, small, both = rows(calling.call(b, r, 7)), rows(calling.call(b, r, 4)), rows(calling.two_step(b, r, 7, 4, 3))
    assert both == {i: large[i] if large[i][1] is not None and large[i][1] <= 3 else small[i] for i in large}
    with pytest.raises(ValueError, match="unknown method"):
        calling.run_method("9-mer-filter", b, r)
    with pytest.raises(ValueError, match="empty"):
        calling.call(b.where("false"), r)
    with pytest.raises(ValueError, match="lengths"):
        calling.call(b.union(spark.createDataFrame([(99, "ACG")], b.schema)), r)
    assert calling.call(b, r.where("false")).count() == 0
    assert metrics.recall(calling.call(b, r, 4).where("false")).first()[0] is None


def test_pieces_of_work(monkeypatch):
    rng = np.random.default_rng(7)
    codes, reads = rng.integers(0, 4, (60, 16)), rng.integers(0, 4, (200, 16))
    seqs = ["".join("ACTG"[c] for c in x) for x in codes]
    ix = calling.build(np.arange(60), seqs, 3, 16)
    whole = calling.candidates(ix, list(reads.astype(np.uint8)), 5, 7)
    monkeypatch.setattr(calling, "PIECE", 50)
    parts = calling.candidates(ix, list(reads.astype(np.uint8)), 5, 7)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_nearest_equals_brute_force(spark):
    rng = random.Random(9)
    barcodes = ["".join(rng.choices("ACGT", k=10)) for _ in range(20)]
    reads = ["", "ACN", *["".join(rng.choices("ACGT", k=rng.randint(1, 12))) for _ in range(30)]]
    b = spark.createDataFrame(list(enumerate(barcodes)), "barcode_id long, seq string")
    r = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    for name, prefix in (("levenshtein", False), ("sequence-levenshtein", True)):
        want = {i: min((int(dp(D.codes([x])[0], D.codes([s])[0], prefix)), j) for j, x in enumerate(barcodes))[::-1] for i, s in enumerate(reads)}
        assert {x.read_id: tuple(x)[1:] for x in calling.nearest(b, r, name).collect()} == want


@pytest.mark.parametrize("length", [7, 34, 66])
def test_nearest_of_many_without_workers(spark, length):
    """Barcodes of several blocks, copies among them, and reads near, far, short, long, null and with symbols that are no base; no pair goes through Python."""
    rng = random.Random(length)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    seqs = [dna(length) for _ in range(1100)]
    seqs += [*seqs[:4], "N" * length]
    ids = rng.sample(range(10**6), len(seqs))
    near = lambda: "".join(rng.choice(["", c, c, c, c, dna(1), c + dna(1)]) for c in rng.choice(seqs))
    reads = [None, "", "N", "A" * 63, "A" * 64, *seqs[-5:], *[near() for _ in range(20)], *[near() + dna(60) for _ in range(5)], *[dna(rng.randint(1, 90)) for _ in range(20)], *[x[: rng.randint(1, length)].lower() for x in seqs[:5]]]
    b = spark.createDataFrame(list(zip(ids, seqs, strict=True)), "barcode_id long, seq string")
    r = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    order = np.argsort(ids)
    code = np.stack(D.codes([seqs[i] for i in order]))
    for name, prefix in (("levenshtein", False), ("sequence-levenshtein", True)):
        want = {}
        for i, x in enumerate(reads):
            d = D.aligned(code, np.tile(D.codes([x])[0], (len(code), 1)), D.UNIT, prefix) if x else np.full(len(code), 0 if prefix else length)
            want[i] = (ids[order[d.argmin()]], int(d.min()))
        got = calling.nearest(b, r, name)
        assert {x.read_id: tuple(x)[1:] for x in got.collect()} == want
        assert "InArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_simulate(spark):
    b = spark.createDataFrame([(i, B1) for i in range(3)], "barcode_id long, seq string")
    rows = simulate(b, 9, length=40).collect()
    assert sorted(r.barcode_id for r in rows) == [0, 0, 0, 1, 1, 1, 2, 2, 2] and {len(r.seq) for r in rows} == {40}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, simulate(b, 9, length=40).collect()))
    assert {r.seq for r in simulate(b, 3, p=0).collect()} == {B1}


@pytest.mark.parametrize("plan", ["map", "join"])
def test_repeated_read_ids_and_lower_case(spark, plan):
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGT", k=20)) for _ in range(12)]
    b = spark.createDataFrame([(i, s.lower() if i % 2 else s) for i, s in enumerate(seqs)], "barcode_id long, seq string")
    reads = [(i % 4, s if i % 3 else s.lower()) for i, s in enumerate(seqs)] + [(0, seqs[0].lower()), (0, None)]
    r = spark.createDataFrame(reads, "read_id long, seq string")
    want = sorted((i % 4, i, 0) for i in range(12)) + [(0, 0, 0), (0, -1, -1)]
    for distance in ("levenshtein", "sequence-levenshtein"):
        got = calling.call(b, r, 4, distance, plan=plan).fillna(-1)
        assert got.columns == ["read_id", "barcode1", "distance1", "barcode2", "distance2"]
        assert sorted(tuple(x)[:3] for x in got.collect()) == sorted(want)
    twice = calling.two_step(b, spark.createDataFrame([(7, seqs[1]), (7, "A" * 20), (7, seqs[2])], r.schema), 7, 4, 3, plan=plan).fillna(-1)
    assert sorted(tuple(x)[:2] for x in twice.where("distance1 between 0 and 3").collect()) == [(7, 1), (7, 2)] and twice.count() == 3


def odd_pair(spark, plain):
    rng = random.Random(12)
    barcodes = ["".join(rng.choices("ACGT", k=14)) for _ in range(40)]
    if not plain:
        barcodes[3], barcodes[4] = barcodes[3].lower(), None
    reads = [(i % 25, s) for i, s in enumerate(["", None, "ACG", barcodes[0].lower(), "é" + barcodes[1], *["".join(c if rng.random() > 0.2 else rng.choice("ACGTN") for c in rng.choice(barcodes[5:])) for _ in range(30)]])]
    b = spark.createDataFrame([(i // 2 if not plain and i < 2 else i, s) for i, s in enumerate(barcodes)], "barcode_id int, seq string")
    return spark.createDataFrame([*reads, (None, barcodes[9]), (None, barcodes[9])], "read_id long, seq string"), b


@pytest.mark.parametrize("plain", [True, False])
def test_sent_index_gives_the_rows_of_the_joins(spark, plain):
    """Reads and barcodes with repeated ids, nulls, lower case and other symbols."""
    reads, b = odd_pair(spark, plain)
    same = lambda x, y: x.schema.simpleString() == y.schema.simpleString() and sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))
    for k in (2, 3):
        scored = index.pseudo_distance(reads, b, k, 14)
        assert same(calling.band(reads, b, k, 14), index.band_join(reads, b, k, 14))
        assert same(calling.scored(reads, b, k, 14), scored)
        assert same(calling.scored(reads, b, k, 14, n=5), index.top_candidates(scored, 5))


@pytest.mark.parametrize("sql", ["argmin", "band_join", "band_join_equi", "pseudo_distance", "topk_candidates", "top2_assignment", "call_k7_join"])
def test_exploded_index_is_not_broadcast(spark, sql):
    from tessera.plans import catalog

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    plan = catalog.QUERIES[sql](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "Generate" not in plan


@pytest.mark.parametrize("join", [index.band_join, index.band_join_equi])
def test_joins_deal_out_the_exploded_index(spark, join):
    plan = join(*odd_pair(spark, True), 3, 14)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_blocks_of_barcodes(spark, monkeypatch):
    reads, b = odd_pair(spark, True)
    for ks, threshold in (((3,), None), ((3, 2), 2)):
        rows = lambda plan, ks=ks, threshold=threshold: sorted(map(repr, calling._call(b, reads, ks, threshold, n=5, plan=plan).drop("seq").collect()))
        want = rows("map")
        monkeypatch.setattr(calling, "SENT", calling.index_bytes(40, 14, 2) // 4)
        assert rows("join") == want
        monkeypatch.undo()


@pytest.mark.parametrize("u", [np.uint32, np.uint64])
def test_candidates_met_often_are_enough(u):
    """Many postings a barcode, few, and more reads than 32-bit keys hold: always the best by brute force."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, (5000, 20)).astype(np.uint8)
    reads = [np.where(rng.random(20) < 0.1, rng.integers(0, 4, 20), codes[rng.integers(5000)]).astype(np.uint8) for _ in range(30)]
    for k in (3, 4, 5):
        ix = calling.indexed(np.arange(5000), codes, D.masks(codes), k)
        ix.post = ix.post.astype(u)
        x = calling.kmer_codes(codes, k)
        r, b, total = calling.scores(ix, reads, 5, 20)
        for i, read in enumerate(reads):
            y = calling.kmer_codes(read[None], k)[0]
            want = sum((20 - abs(p - q)) * (x[:, q] == y[p]) for p in range(len(y)) for q in range(len(y)) if abs(p - q) <= 5)
            best = np.lexsort((np.arange(5000), -want))[:20]
            best = best[want[best] > 0]
            assert b[r == i].tolist() == best.tolist() and total[r == i].tolist() == want[best].tolist()


@pytest.mark.parametrize("n", [3, 20, 4000])
def test_table_of_all_barcodes_gives_the_best(monkeypatch, n):
    """What is read off a table of -pd is what sorted postings give: few and all barcodes met, ties, reads of several lengths."""
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 4, (5000, 16)).astype(np.uint8)
    codes[40:80] = codes[:40]
    reads = [np.where(rng.random(16) < 0.1, rng.integers(0, 4, 16), codes[rng.integers(100)]).astype(np.uint8)[: rng.integers(2, 17)] for _ in range(40)]
    for k in (2, 3, 4):
        ix = calling.indexed(np.arange(5000), codes, D.masks(codes), k)
        used = []
        with monkeypatch.context() as m:
            m.setattr(calling, "MANY", 1 << 30)
            want = calling.scores(ix, reads, 5, n)
        with monkeypatch.context() as m:
            m.setattr(calling, "tallied", lambda *a, f=calling.tallied: used.append(1) or f(*a))
            got = calling.scores(ix, reads, 5, n)
        assert all((a == b).all() for a, b in zip(want, got, strict=True)) and (used or k == 4)


def test_join_plan_broadcasts_no_calls(spark, tmp_path):
    """Tables that are read are taken for a few kB, and what is called of them for less than it is."""
    rng = random.Random(13)
    spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=14))) for i in range(20)], "barcode_id long, seq string").write.parquet(f"{tmp_path}/b")
    b = spark.read.parquet(f"{tmp_path}/b")
    plan = calling.call(b, b.withColumnRenamed("barcode_id", "read_id"), 4, plan="join")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_indexes_are_made_where_they_are_used():
    """Sent are codes and ids, 42 bytes a barcode, not the indexes, of which one has 160 or more; what was made goes nowhere either."""
    rng = random.Random(14)
    seqs = ["".join(rng.choices("ACGT", k=34)) for _ in range(2000)]
    ids = np.array(rng.sample(range(10**6), 2000))
    sent = calling.Sent(pa.table({"barcode_id": ids, "seq": pa.chunked_array([seqs[:700], seqs[700:]])}), 34, 7, 5)
    steps = sent.steps
    data = pickle.dumps(sent)
    assert len(data) < 2000 * 45 and calling.index_bytes(2000, 34, 7, 5) > 10 * len(data)
    for ix, again, k in zip(steps, pickle.loads(data).steps, (7, 5), strict=True):
        want = calling.build(ids, seqs, k, 34)
        assert ix is sent.steps[(7, 5).index(k)] and ix.k == again.k == k and (ix.ids == np.sort(ids)).all()
        assert all((getattr(x, c) == getattr(want, c)).all() for x in (ix, again) for c in ("first", "post", "ids", "code", "masks"))


@pytest.mark.parametrize(("distance", "costs"), [("sequence-levenshtein", None), ("levenshtein", None), ("sequence-levenshtein", tuple(range(25)))])
def test_calls_of_the_jvm_are_those_of_the_workers(spark, distance, costs):
    """The map plan runs no Python on the executors, and gives the rows that its Python form gives."""
    rng = random.Random(8)
    seqs = ["".join(rng.choices("ACGT", k=20)) for _ in range(300)]
    barcodes = spark.createDataFrame([(7 * i % 300, s if i % 50 else s[:5] + "-N" + s[7:].lower()) for i, s in enumerate(seqs)], "barcode_id long, seq string")
    rows = [(i, s[: i % 12] + rng.choice("ACGTNx\U0001f600") + s[i % 12 + i % 2 :] + "ACGT" * (i % 40 == 3) * 20) for i, s in enumerate(seqs)]
    reads = spark.createDataFrame([*rows, (300, None), (301, ""), (302, "ACG"), (302, seqs[5])], "read_id long, seq string").repartition(3)
    for ks, n, threshold in (((3,), 10, None), ((5,), 100, None), ((6, 3), 20, 4)):
        df = calling._call(barcodes, reads, ks, threshold, distance, 5, n, costs, "map")
        assert "InArrow" not in df._jdf.queryExecution().executedPlan().toString()
        old = reads.mapInArrow(*calling._caller(calling._sent(barcodes, 20, *ks), distance, costs, 5, n, threshold))
        rows = [sorted(map(repr, x.collect())) for x in (df, old)]
        assert rows[0] == rows[1] and len(rows[0]) == 304


@pytest.mark.parametrize(("ks", "threshold"), [((4,), None), ((5,), None), ((7, 4), 5), ((7, 5), 5)])
def test_parts_of_many_barcodes(spark, monkeypatch, ks, threshold):
    """Barcodes of two parts, with equal sequences, other symbols and single bases throughout: the rows of a read at a time."""
    rng = np.random.default_rng(5)
    seqs = ["".join(x) for x in rng.choice(list("ACGT"), (17000, 20))]
    seqs[3:6], seqs[16500], seqs[16800:16803] = ["A" * 20, "NNNNNACGTACGTACGTAAC", "acgtacgtacgtacgtacgt"], seqs[0], ["A" * 20, seqs[1], seqs[2]]
    b = spark.createDataFrame([(int(i), s) for i, s in zip(rng.permutation(17000) + 7, seqs, strict=True)], "barcode_id long, seq string")
    some = [s[:p] + "T" + s[p + 2 :] + t for s, p, t in zip(seqs[:150], rng.integers(0, 18, 150).tolist(), "ACGTN" * 30, strict=True)]
    reads = spark.createDataFrame(list(enumerate([None, "", "ACG", "NNNN", "ACGT", "ACGTA", "A" * 20, "A" * 70, seqs[0].lower(), seqs[1] + seqs[2], *some, some[0]])), "read_id long, seq string").repartition(4)
    call = lambda: calling._call(b, reads, ks, threshold, n=20).drop("seq")
    got = call()
    assert "MapPartitions" in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(calling, "MANY", 1 << 30)
    want = call()
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
