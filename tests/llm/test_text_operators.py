import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import arrays, decontaminate, ngram_join, secrets, substring_dedup, suffix_dedup


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def spaced(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, none, width, num):
    sets = []
    for i, t in rows:
        w = spaced(low(t))
        sets.append((i, frozenset(tuple(w[p : p + width]) for p in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, width, num).collect())
    assert got == Counter((i, len(s), find(i)) for i, s in sets)
    assert ngram_join.ngram_components(none, width, num).count() == 0
    left = ngram_join.one_of_each(docs, width, num)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({find(i) for i, _ in sets})


def test_signatures_find_every_pair():
    rng = np.random.default_rng(3)
    for n in (1, 3, 6, 7, 9, 12, 25, 60, 300):
        for _ in range(60):
            a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            b = np.array(a)
            for _ in range(rng.integers(0, n // 6 + 2)):
                b[rng.integers(len(b))] = rng.integers(1, 2**63, dtype=np.uint64)
            b = np.unique(b[: len(b) - int(rng.integers(0, 2)) * (len(b) > 1)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                g, first = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
                sig, who = ngram_join.signatures(g, first, 85, 100)
                assert np.intersect1d(sig[who == 0], sig[who == 1]).size


def test_linked_sets_share_so_many_lists():
    rng = np.random.default_rng(4)
    more = 0
    for n in (6, 9, 14, 25, 60, 300):
        for _ in range(60):
            a = np.unique(rng.integers(1, 2**64, n, dtype=np.uint64))
            b = np.array(a)
            b[rng.integers(0, n, n // 13)] = rng.integers(1, 2**64, n // 13, dtype=np.uint64)
            b = np.unique(b)
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 85 * (len(a) + len(b) - both)
            g, first = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
            sig, who = ngram_join.signatures(g, first, 85, 100)
            common = np.intersect1d(sig[who == 0], sig[who == 1])
            need = ngram_join.shared(g, first, 85, 100).max(1)
            # of one scheme at least: sets of neighbouring bands have one in common
            assert any(np.count_nonzero(common & np.uint64(1) == p) >= need[p] for p in (0, 1))
            more += int((need > 1).any())
    assert more


def test_rarest_lists_leave_out_what_many_have(spark):
    """Twenty nodes share list 2 and two each a smaller one; each must share two lists with a partner, so no pair need meet in list 2."""
    rows = [(2, i, i, 2, 2) for i in range(20)] + [(4 + 2 * (i // 2), i, i, 2, 2) for i in range(20)]
    of = spark.createDataFrame(rows, "sig long, node long, component long, even long, odd long")
    left = ngram_join.rarest(of).collect()
    assert sorted((r.sig, r.node) for r in left) == [(4 + 2 * (i // 2), i) for i in range(20)]
    one = of.withColumn("even", of["odd"] * 0 + 1)
    assert ngram_join.rarest(one).count() == 40


@pytest.mark.parametrize("length", [40, 400])
def test_suffix_dedup(docs, rows, none, length):
    seen = Counter(b[p : p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                m[p : p + length] = True
        m = m[:-1]
        spans = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        want[(i, len(b), int(m.sum()), spans, sha(np.frombuffer(b, np.uint8)[~m].tobytes()))] += 1
    got = suffix_dedup.suffix_dedup(docs, length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got)
    assert suffix_dedup.suffix_dedup(none, length).count() == 0


def test_null_ids(spark, none):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text), (None, text + " more"), (4, text), (2**63 - 1, "x " + text)]
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, "x") for i, t in rows], none.schema)
    assert {r.component_id for r in ngram_join.ngram_components(df).collect()} == {4}
    assert {(r.doc_id, r.n_removed > 0) for r in suffix_dedup.suffix_dedup(df).collect()} == {(None, True), (4, True), (2**63 - 1, True)}
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()} == {(None, 200), (4, 0), (2**63 - 1, 200)}


def test_hash_is_sparks(spark):
    rows = [(1, 2, -3), (2**63 - 1, -(2**63), 0), (0, 0, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c long").selectExpr("xxhash64(a, b, c)").collect()]
    assert arrays.xxhash64(*np.array(rows, np.int64).T).tolist() == got


def test_levels():
    rng = np.random.default_rng(4)
    index, all_, got = suffix_dedup.Levels(), [], []
    for k in range(40):
        keys = rng.integers(0, 3000, 50, dtype=np.uint64)
        entry = np.arange(50 * k, 50 * k + 50)
        all_.append(keys)
        got.append(index.add(keys, entry))
    keys, got = np.concatenate(all_), np.concatenate(got)
    count = Counter(keys.tolist())
    assert sorted(got.tolist()) == [i for i, k in enumerate(keys.tolist()) if count[k] > 1]
    sizes = [len(x[0]) for x in index.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_substring_dedup(docs, rows, none):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = spaced(t or "")
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = Counter()
    for i, t in rows:
        w = spaced(t or "")
        m = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                m[p : p + 13] = [True] * 13
        want[(i, len(w), sum(m), sha(" ".join(x for x, y in zip(w, m, strict=True) if not y).encode()))] += 1
    got = substring_dedup.substring_dedup(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(sha(r.kept.encode()) == r.kept_sha256 for r in got)
    assert substring_dedup.substring_dedup(none).count() == 0


@pytest.mark.parametrize("block", [1 << 25, 400])
def test_decontaminate(spark, docs, rows, none, block):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    long = [t for _, t in rows if t and 30 < len(t.split()) < 130][:6]
    items = [(k, " ".join(t.upper().split()[3:25])) for k, t in enumerate(long)] + [(50, "one"), (51, "Two, words!"), (52, None), (53, ""), (54, "..."), (55, "no such thing here")]
    windows = defaultdict(set)
    for i, t in items:
        w = words.findall(low(t))
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(i)
    want, bad = Counter(), set()
    for i, t in rows:
        w = words.findall(low(t))
        m, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if hit := windows.get(tuple(w[p : p + n])):
                    found |= hit
                    m[p : p + n] = [True] * n
        want[(i, len(w), sum(m), len(found), sha(",".join(sorted(map(str, found))).encode()), any(m))] += 1
        bad |= {i} if any(m) else set()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_matches(docs, bench, block=block).mapInArrow(*decontaminate._digest()).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i not in bad)
    assert decontaminate.find_matches(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == len(rows)


def test_secrets(spark, none):
    key = "AKIA" + "Z" * 14
    texts = [None, "", f"ü token = 'abcdefgh12' {key} {'0af' * 12}", "token=secret:abcdefgh", "PassWord: short, API_KEY=\"0123456789\"", f"user: bob and {'aB3/' * 10} end", f"only {'aB3/' * 10} end", f"see https://x.example/y user=bob secret=ABCDEFGH9 {'.' * 600} https://far.example", "AKIAabc " + "f" * 31]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, "x") for i, t in rows], none.schema)
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    found = secrets.find_secrets(df).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i, t in rows:
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted((x.s, x.k, x.e) for x in by[i].base) == sorted(want), t
    weak = {i: sorted(secrets.KINDS[x.k] for x in r.weak) for i, r in by.items()}
    assert weak[5] == ["bare", "login"] and weak[6] == [] and weak[7] == ["endpoint", "login"]
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[0] is None and clean[6] == texts[6] and clean[2] == "ü [SECRET]' [SECRET] [SECRET]"
    assert secrets.redact(df).columns == df.columns and secrets.find_secrets(none).count() == 0


def test_secrets_of_key_value_pairs(spark, none):
    key, token = "AKIA" + "Z" * 14, "aB3/" * 10
    texts = [f"AWS_ACCESS_KEY_ID={key}\nAWS_SECRET_ACCESS_KEY={token}\n", f"AWS_SECRET_ACCESS_KEY={token}", "user: bob, password: hunter2", "password: hunter2", f"{key} secret={token}"]
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, "x") for i, t in enumerate(texts)], none.schema)
    weak = {r.doc_id: sorted((texts[r.doc_id][x.s : x.e], x.k) for x in r.weak) for r in secrets.find_secrets(df).collect()}
    assert weak == {0: [(token, 4)], 1: [], 2: [("password: hunter2", secrets.SHORT), ("user: bob", 3)], 3: [], 4: []}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[0] == "AWS_ACCESS_KEY_ID=[SECRET]\nAWS_SECRET_ACCESS_KEY=[SECRET]\n" and clean[1] == texts[1]
    assert clean[2] == "[SECRET], [SECRET]" and clean[3] == texts[3]


def test_short_items_and_clean_documents(spark, none):
    texts = ["all of the people", "a clean one of the many", "one two three four five"]
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, "x") for i, t in enumerate(texts)], none.schema)
    bench = spark.createDataFrame([(1, "of the"), (2, "two three four five")], "item_id long, text string")
    left = lambda **options: sorted(r.doc_id for r in decontaminate.decontaminate(df, bench, **options).collect())
    assert left() == [] and left(least=4) == [0, 1]


def test_null_items(spark, none):
    df = spark.createDataFrame([(1, "one two three", 1, 2, 0.5, "x")], none.schema)
    bench = spark.createDataFrame([(None, "one"), (-1, "two"), (5, "none of it")], "item_id long, text string")
    r = decontaminate.find_matches(df, bench).mapInArrow(*decontaminate._digest()).first()
    assert (r.n_hit, r.n_items, r.items_sha256) == (2, 2, sha(b"-1"))


def test_many_secrets_in_one_text(spark, none):
    n = 4000
    text = " ".join(f"ü https://x.example/{i} password=abcdefgh{i}" for i in range(n))
    df = spark.createDataFrame([(1, text, 1, 2, 0.5, "x"), (None, "secret: abcdefghi", 1, 2, 0.5, "x")], none.schema)
    got = {r.doc_id: (len(r.base), len(r.weak)) for r in secrets.find_secrets(df).collect()}
    assert got == {1: (n, 0), None: (1, 0)}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean == {1: " ".join(f"ü https://x.example/{i} [SECRET]" for i in range(n)), None: "[SECRET]"}


def test_long_sets_that_differ_too_much_make_no_pairs(spark, monkeypatch):
    """Sets of 1,500 that have some hundred elements of their own each, which short sketches don't tell from linked ones."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**9)}" for _ in range(1500)]

    def changed(share):
        return " ".join(w if rng.random() > share else f"w{rng.randrange(10**9)}" for w in base)

    texts = [changed(0.03) for _ in range(30)]
    texts += [texts[0] + " one more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, real = [], ngram_join.kept
    monkeypatch.setattr(ngram_join, "REPS", (None,))
    monkeypatch.setattr(ngram_join, "kept", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    monkeypatch.setattr(ngram_join, "drop", lambda *frames: None)
    rows = ngram_join.ngram_components(docs).collect()
    assert {r.component_id for r in rows if r.doc_id in (0, 30)} == {0}
    last = [df for name, df in made if name == "pairs"][-1]
    sets = {r.doc_id: set(zip(*(texts[r.doc_id].split()[k:] for k in range(4)), strict=False)) for r in rows}
    apart = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(1, 30) for j in range(i)]
    assert max(apart) < 0.8 and last.count() == 0


def test_workers_give_memory_back(monkeypatch):
    """After the last batch, and also where the reader ends early."""
    import ctypes

    from tessera.llm import shared, toxicity

    trimmed = []
    monkeypatch.setattr(ctypes, "CDLL", lambda name: type("libc", (), {"malloc_trim": staticmethod(trimmed.append)}))
    assert list(shared.spare(lambda batches: (2 * x for x in batches))(iter([1, 2]))) == [2, 4] and trimmed == [0]
    rows = shared.spare(lambda batches: (x for x in batches))(iter([1, 2]))
    assert next(rows) == 1 and len(trimmed) == 1
    rows.close()
    assert len(trimmed) == 2
    for run in (ngram_join._sets(4, 85, 100)[0], ngram_join._lists(4, 85, 100)[0], ngram_join._whole(4, None)[0], toxicity._score(None, "score"), toxicity._vectors(None)[0]):
        assert list(run(iter([]))) == []
    assert len(trimmed) == 7


def test_packing_and_decontamination_give_memory_back(monkeypatch):
    import ctypes

    import public_tokenizers

    from tessera.llm import decontaminate, packing

    trimmed = []
    monkeypatch.setattr(ctypes, "CDLL", lambda name: type("libc", (), {"malloc_trim": staticmethod(trimmed.append)}))
    list(packing._pack(public_tokenizers.path("byte_bpe_50k.json"), 1024)[0](iter([])))
    list(decontaminate._matches(type("sent", (), {"value": (None, None, None)}))[0](iter([])))
    assert len(trimmed) == 2
