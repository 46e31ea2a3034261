import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import cover_tree, packing, tokens, toxicity, warc
from tessera.llm.graph import components
from tessera.llm.shared import place

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer


@pytest.mark.parametrize(("huge", "overlap"), [(1 << 15, 256), (300, 8)])
def test_token_counts(docs, rows, none, huge, overlap):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = tokens.token_counts(docs, path, huge=huge, overlap=overlap).collect()
    want = Counter()
    for i, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want[(i, len((x or "").encode()), n, n > 2048)] += 1
    assert Counter(map(tuple, got)) == want
    assert tokens.token_counts(none, path).count() == 0


def test_splice_of_odd_texts():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(2)
    for k in range(60):
        text = "".join(rng.choices(["a", "é", "é", " ", " ", "\n", "don't", "<|endoftext|>", "Σ", "12", "###", "x" * 50], [9, 2, 2, 5 * (k % 3 > 0), 2, 1, 3, 1, 2, 2, 2, 1], k=300))
        assert tokens.splice(t, text, 100, 8) == len(t.encode(text, add_special_tokens=False).ids)


def test_packing(spark, docs, rows, none):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["<|endoftext|> x", "a  b \n c", " lead", "tail ", "中文 text", "\u0085 x", " " * 1500 + "y"]
    more = spark.createDataFrame([(1000 + i, x, 1, 2, 0.5, "x") for i, x in enumerate(odd)], none.schema)
    texts = rows + [(1000 + i, x) for i, x in enumerate(odd)]
    got = packing.pack(docs.union(more), path).collect()
    ids = defaultdict(list)
    for i, x in texts:
        ids[i].append(t.encode(x or "", add_special_tokens=False).ids + [0])
    have, places = Counter(), defaultdict(list)
    for r in got:
        assert any(r.doc_tokens == len(a) and zlib.crc32(np.array(a[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for a in ids[r.doc_id])
        have[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert have == Counter({i: sum(map(len, a)) for i, a in ids.items()})
    for s in places.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(none, path).count() == 0


def test_packing_fills_bins():
    rng, p, rows = random.Random(1), packing.Packer(0, 1024), []
    for doc in range(3000):
        n = rng.randint(1, 3000)
        start = 0
        for size in packing.lengths(n):
            rows += p.add((doc, start, size, 0, n))
            start += size
        assert start == n
    rows += p.close()
    full = Counter()
    for r in rows:
        full[r[5]] += r[2]
    assert sum(1024 - n for n in full.values() if n & (n - 1)) < 0.003 * sum(full.values())


def test_toxicity(spark, none):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeiostrn", k=rng.randint(2, 6))) for _ in range(200)]
    rows = []
    for i in range(600):
        w = rng.choices(words, k=rng.randint(5, 80))
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(["wretch", "vermin"])
        rows.append((i, " ".join(w)))
    rows += [(600, None), (601, ""), (602, "a")]
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, "x") for i, t in rows], none.schema)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r.p for r in toxicity.score(df, model, "p").collect()}
    assert all(0 <= p <= 1 for p in got.values()) and len(got) == 603
    wrong = sum((got[i] >= 0.3) != (i % 5 == 0) for i in range(400, 600))
    assert wrong <= 6
    kept = toxicity.rejected_out(df, labels)
    assert kept.columns == df.columns and {600, 601, 602} <= {r.doc_id for r in kept.collect()}
    for few in (labels.where("false"), labels.where("toxic = 0")):
        assert toxicity.rejected_out(df, few).count() == 603
    assert toxicity.score(none, model, "p").count() == 0


def test_toxicity_of_many_words(spark, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeiostrnlmd", k=rng.randint(3, 7)))
    words, toxic = [word() for _ in range(300)], ["".join(rng.choices("bcfghjkpquvwxyz", k=8)) for _ in range(60)]
    rows = []
    for i in range(1200):
        w = rng.choices(words, k=rng.randint(5, 60))
        if i % 3 == 0:
            w[rng.randrange(len(w))] = toxic[i // 3 % 60]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, "x") for i, t in rows], none.schema)
    model = toxicity.fit(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(720)], "doc_id long, toxic int"))
    seen = {x.lower()[a : a + n] for _, x in rows[:720] for n in toxicity.GRAMS for a in range(len(x) - n + 1)}
    assert (model.slot >= 0).sum() > 0.95 * len(seen)  # some share a bucket
    got = {r.doc_id: r.p for r in toxicity.score(df, model, "p").collect()}
    assert sum(got[i] >= 0.3 for i in range(720, 1200, 3)) >= 155
    assert sum(got[i] < 0.3 for i in range(720, 1200) if i % 3) >= 305


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 6))
    rows = []
    for i in range(160):
        v = base[i % 8] * rng.uniform(0.1, 9) + rng.normal(size=6) * 0.08
        rows.append((i, v.tolist(), i % 3))
    rows += [(200 + i, rows[0][1], 0) for i in range(40)]  # copies
    rows += [(300, None, 0), (301, [0.0] * 6, 0), (302, [float("nan")] * 6, 0), (303, [None] * 6, 0), (304, rows[0][1], None), (305, [1.0, 2.0], 0), (306, [1.0, 2.0], 0), (307, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    link = defaultdict(set)
    for i, v, a in rows:
        for j, w, b in rows:
            if i < j and a == b and a is not None and v and w and len(v) == len(w) and None not in v + w:
                x, y = np.array(v), np.array(w)
                n = np.sqrt((x @ x) * (y @ y))
                if n > 0 and np.isfinite(n) and x @ y / n >= 0.98:
                    link[i].add(j)
                    link[j].add(i)
    comp = {}
    for i, *_ in rows:
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                for k in link[todo.pop()] - seen:
                    seen.add(k)
                    todo.append(k)
            comp |= dict.fromkeys(seen, min(seen))
    want = {(i, len(link[i]), comp[i], comp[i] == i) for i, *_ in rows}
    for block in (2048, 16):
        assert {tuple(r) for r in cover_tree.near_duplicates(df, block=block).collect()} == want
    assert cover_tree.near_duplicates(df.where("false")).count() == 0


def test_warc(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", inner), (6, "http://e", inner * 3 + "WARC/1.1\r\n"), (7, "http://f", "x" * 300000), (9, "http://a", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, sha string")
    got = {tuple(r) for r in warc.round_trip(df, place(spark, "warc")).collect()}
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(i, largest.get(h or "", 0))
    want = set()
    for i, _, h in pages:
        b, top = (h or "").encode(), largest[h or ""]
        want.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top == i else "revisit", None if top == i else top))
    assert got == want
    assert warc.round_trip(df.where("false"), place(spark, "warc")).count() == 0


def test_chain_rejects_what_no_chain_reaches():
    record = lambda body: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    inside = record(b"x")
    data = record(inside) + record(b"") + record(inside * 2)
    start = warc.chain(data)[0].tolist()
    assert start == [0, len(record(inside)), len(record(inside)) + len(record(b""))]
    assert warc.chain(b"junk" + data)[0].tolist() == [] and warc.chain(b"")[0].tolist() == []


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    up = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = sorted((find(a), find(b)))
            up[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
