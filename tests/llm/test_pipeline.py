import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import queries

SF = "/root/testdata/sf0.001"
NAMES = [name for name, _ in corpus_pipeline.STAGES]


#: Texts that the table lacks, under doc_ids of their own.
KEY = "AKIA" + "Q7" * 8
OWN = {
    10**12: None,
    10**12 + 1: "",
    10**12 + 2: f"the harbour opened late and über uns password = 'abcdefgh12' was written near {KEY} on the wall",
    10**12 + 3: f"seven boats carry {'0af3' * 10} across quiet rivers, api_key: ZZZZ0000yyyy and token=ABCDEFGHIJ end",
    10**12 + 4: "green hills and one short password: abc that names nothing else around it",
}


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def kept(spark):
    """Rows that go into each stage and, last, the pieces that come out; stages are run as corpus_pipeline.run runs them."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    like = docs.first().asDict()
    docs = docs.union(spark.createDataFrame([{**like, "doc_id": i, "text": t} for i, t in OWN.items()], docs.schema))
    out, columns = {NAMES[0]: {r.doc_id: r for r in docs.collect()}}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.kept(stage(spark, docs, SF), name)
        if k < len(NAMES) - 1:
            assert docs.columns == columns, name
            rows = docs.collect()
            out[NAMES[k + 1]] = {r.doc_id: r for r in rows}
            assert len(rows) == len(out[NAMES[k + 1]]), name  # doc_ids are unique in this table
        else:
            out["pieces"] = docs.collect()
    return out


def test_toxicity_stage(spark, kept):
    bad = {r.doc_id for r in queries.QUERIES["op10_toxicity"](spark, SF).collect() if r.predicted}
    assert bad and set(kept["ngram_join"]) - set(OWN) == set(kept["toxicity"]) - set(OWN) - bad
    assert set(OWN) <= set(kept["ngram_join"])


def test_near_duplicate_stage(kept):
    sets = {}
    for i, r in kept["ngram_join"].items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r.text))
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    assert any(find(i) != i for i in sets)  # else there is nothing to see
    assert set(kept["decontamination"]) == {find(i) for i in sets}


def test_decontamination_stage(spark, kept):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        if len(w) >= corpus_pipeline.ITEM_WORDS:
            n = min(10, len(w))
            windows |= {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
    bad = set()
    for i, r in kept["decontamination"].items():
        w = words(r.text)
        if any(tuple(w[p : p + n]) in windows for n in {len(x) for x in windows} for p in range(len(w) - n + 1)):
            bad.add(i)
    assert bad and set(kept["secrets"]) == set(kept["decontamination"]) - bad


def test_secrets_stage(kept):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    base = lambda t: [m[0] for m in assign.finditer(t) if len(m[1]) >= 8] + re.findall("AKIA[A-Z0-9]{12,}", t) + re.findall("[0-9a-f]{32,}", t)
    assert set(kept["packing"]) == set(kept["secrets"]) >= set(OWN)
    assert [len(base(t or "")) for t in OWN.values()] == [0, 0, 2, 3, 0]
    for i, r in kept["secrets"].items():
        after = kept["packing"][i]
        if r.text is None:
            assert after.text is None
            continue
        found = base(r.text)
        assert not found or "[SECRET]" in after.text
        for s in found:
            assert s not in after.text
        if after.text != r.text:  # all but the blotted spans is as it was
            between = ".+".join(map(re.escape, after.text.split("[SECRET]")))
            assert re.fullmatch(between, r.text, re.DOTALL)
        assert [after[c] for c in after.__fields__ if c not in ("text", "n_chars")] == [r[c] for c in r.__fields__ if c not in ("text", "n_chars")]


def test_packing_stage(kept):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: t.encode(r.text or "", add_special_tokens=False).ids + [0] for i, r in kept["packing"].items()}
    have, places = Counter(), defaultdict(list)
    for r in kept["pieces"]:
        a = ids[r.doc_id]
        assert r.doc_tokens == len(a) and zlib.crc32(np.array(a[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        have[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert have == Counter({i: len(a) for i, a in ids.items()})
    for s in places.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024


def test_run(spark, kept):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert ids == set(kept["packing"]) - set(OWN)


def test_registry():
    assert len(queries.QUERIES) == 10


def test_stages_begin_on_compacted_executors(spark, docs):
    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    for name in ("secrets", "packing"):  # these two run nothing before they are written
        before = collections()
        dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        assert collections() > before, name
