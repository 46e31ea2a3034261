"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features are the distinct ``GRAMS``-character n-grams of a lower-cased text, hashed into ``2**BITS`` buckets.  A
bucket's ratio r is the log of its share of the toxic texts over its share of the others, both counts smoothed by
some number of texts of the mixture of all labels: a bucket that few texts have, of which most texts have many, gets a small r.
A text is the vector of r over its buckets, every bucket that a labelled text has.  A logistic regression on these vectors
gives the score.  Smoothing and ridge are those of ``SETTINGS`` with the least log loss on a fifth of the labelled texts, after
which all of them are fitted.

The vectors stay on the executors: each step of the fit is a pass over them that brings home a gradient per partition,
so the driver holds arrays of ``2**BITS`` numbers whatever the number and the lengths of the texts.

The fit takes at most ``SAMPLE`` labelled rows, those with the least hash of their doc_id: fewer labels are all taken.
Scoring covers every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays as A
from tessera.llm.shared import compact, kept, spare

GRAMS = (3, 4, 5, 6)
BITS = 20
SAMPLE = 20_000
#: Texts of smoothing, and ridge.
SETTINGS = ((1.0, 0.01), (100.0, 0.001))
#: Passes of the choice of a setting and of the last fit, partitions that send gradients, n-grams of a piece of work.
CHOICE, LAST = 12, 10
PARTS = 3
PIECE = 1 << 20
#: Groups of 2**16 slots.
HIGH = max(1, 2**BITS >> 16)
THRESHOLD = 0.3
#: Labels to learn from; the others are held out.
TAUGHT = "crc32(cast(doc_id as string)) % 4 <> 2"


@dataclass
class Model:
    slot: np.ndarray  # of each bucket, -1 for none
    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out, weight = [np.zeros(0)], np.where(self.slot >= 0, self.weight[self.slot], 0)
        for i, j, doc, bucket in present(column):
            out.append(self.bias + np.bincount(doc, weight[bucket], j - i))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30)))


def buckets(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every character n-gram, one array pair for each n."""
    buf = A.LOWER[buf]
    s, inverse = A.prefix(buf)
    char = np.flatnonzero((buf & 0xC0) != 0x80)
    first = np.searchsorted(char, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    end = np.append(char, len(buf))
    for n in GRAMS:
        if len(char) < n:
            continue
        b = char[: len(char) - n + 1]
        h = A.mix((s[end[n:]] - s[b]) * inverse[b] + A.U(n)) >> A.U(64 - BITS)
        ok = doc[: len(b)] == doc[n - 1 :]
        yield doc[: len(b)][ok], h[ok].astype(np.int64)


def present(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, text, bucket): each bucket of each text once, in order."""
    for i, j, buf, at in A.chunks(column):
        kind = np.int32 if (j - i) << BITS < 2**31 else np.int64
        got = [np.zeros(0, kind), *(doc.astype(kind) << kind(BITS) | h.astype(kind) for doc, h in buckets(buf, at))]
        both = np.concatenate(got)
        del got
        both.sort()
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        yield i, j, both >> kind(BITS), both & kind(2**BITS - 1)


def _bucket_counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 2**BITS), np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for i, _, doc, k in present(batch.column("text")):
                for c in (0, 1):
                    count[c] += np.bincount(k[toxic[i + doc] == c], minlength=2**BITS)
        k = np.flatnonzero(count.any(0))
        for a in range(0, len(k), 50_000):
            part = k[a : a + 50_000]
            yield pa.record_batch([pa.array(part), pa.array(count[0][part]), pa.array(count[1][part])], names=["bucket", "clean", "toxic"])

    return spare(run), "bucket long, clean long, toxic long"


def _vectors(slot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, doc, k in present(batch.column("text")):
                k = slot.value[k]  # every bucket here is one of those counted
                # per text: how many slots there are in each HIGH-th, then the low 16 bits of all
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                size = np.bincount(doc * HIGH + (k >> 16), minlength=(j - i) * HIGH).astype(np.uint32).view(np.uint16).reshape(j - i, -1)
                cells = np.insert(k.astype(np.uint16), np.repeat(cut[:-1], size.shape[1]), size.ravel())
                cut = (2 * cut + 4 * HIGH * np.arange(j - i + 1)).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cut), pa.py_buffer(cells)])
                yield pa.record_batch([batch.column("toxic").slice(i, j - i), batch.column("held").slice(i, j - i), sets], names=["toxic", "held", "slots"])

    return spare(run), "toxic int, held boolean, slots binary"


def _gradients(sent):
    """Of each (weight by slot, bias): the sum of the gradients of log loss over the rows that are not held out, and the log loss of both kinds of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, apart = sent.value
        n = len(models[0][0])
        grad, more = np.zeros((len(models), n)), np.zeros((len(models), 3))
        for batch in batches:
            toxic = batch.column("toxic").to_numpy().astype(float)
            learn = ~(batch.column("held").to_numpy(zero_copy_only=False) & apart)
            sets = batch.column("slots")
            cut = np.frombuffer(sets.buffers()[1], np.int32, len(sets) + 1, 4 * sets.offset) // 2
            data = np.frombuffer(sets.buffers()[2], np.uint16, cut[-1])
            a = 0
            while a < len(sets):
                b = max(a + 1, int(np.searchsorted(cut, cut[a] + PIECE, "right")) - 1)
                heads = np.zeros(cut[b] - cut[a], bool)
                heads[(cut[a:b, None] - cut[a] + np.arange(2 * HIGH)).ravel()] = True
                part = data[cut[a] : cut[b]]
                size, y = part[heads].view(np.uint32).reshape(b - a, HIGH).astype(np.int64), toxic[a:b]
                k = part[~heads] + np.repeat(np.tile(np.arange(HIGH, dtype=np.int32) << 16, b - a), size.ravel())
                row = np.repeat(np.arange(b - a), size.sum(1))
                for m, (weight, bias) in enumerate(models):
                    z = np.clip(bias + np.bincount(row, weight[k], b - a), -30, 30)
                    miss = np.where(learn[a:b], 1 / (1 + np.exp(-z)) - y, 0)
                    loss = np.logaddexp(0, z) - y * z
                    grad[m] += np.bincount(k, miss[row], n)
                    more[m] += miss.sum(), loss[learn[a:b]].sum(), loss[~learn[a:b]].sum()
                a = b
        for m in range(len(models)):
            yield pa.record_batch([pa.array([m]), pa.array([grad[m].astype(np.float32).tobytes()], pa.binary()), pa.array([more[m].tobytes()], pa.binary())], names=["model", "grad", "more"])

    return spare(run), "model long, grad binary, more binary"


class Descent:
    """L-BFGS with a diagonal start, told a loss and a gradient of its ``trial`` at a time."""

    def __init__(self, w: np.ndarray, ridge: float, scale: np.ndarray, spread: np.ndarray):
        """``scale``: of the features; ``spread``: their variance times that of the labels, both with the bias's at the end."""
        self.scale, curve = scale, (spread * scale**2).astype(np.float32)
        self.ridge = np.float32(ridge)
        curve[:-1] += self.ridge  # the bias has none
        self.start = 1 / curve
        self.w = self.trial = w
        self.pairs: list = []
        self.loss = self.held = np.inf
        self.slope, self.size = 0.0, 1.0  # of the trial; the first step is short, as n-grams of a word come together

    def tell(self, loss: float, grad: np.ndarray, held: float) -> None:
        loss += float(self.ridge * (self.trial[:-1] @ self.trial[:-1])) / 2
        grad[:-1] += self.ridge * self.trial[:-1]
        if loss <= self.loss + 1e-4 * self.size * self.slope:
            if np.isfinite(self.loss):
                s, y = self.trial - self.w, grad - self.grad
                if float(s @ y) > 1e-9 * float(y @ y):
                    self.pairs = [*self.pairs[-3:], (s, y)]
            self.w, self.loss, self.grad, self.held, self.size = self.trial, loss, grad, held, 1.0 if self.pairs else 1 / 64
            d, back = -grad, []
            for s, y in reversed(self.pairs):
                back.append(float(s @ d) / float(s @ y))
                d = d - np.float32(back[-1]) * y
            d = d * self.start
            if self.pairs:
                s, y = self.pairs[-1]
                d = d * np.float32(float(s @ y) / float((y * self.start) @ y))
            for (s, y), x in zip(self.pairs, reversed(back), strict=True):
                d = d + np.float32(x - float(y @ d) / float(s @ y)) * s
            self.step, self.slope = d, float(grad @ d)
        else:
            self.size /= 4
        self.trial = self.w + np.float32(self.size) * self.step


def logistic(rows: DataFrame, ratio, share: np.ndarray, of: dict) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on rows(toxic, held, slots) times ratio(smoothing); of: (toxic, held) to a number of rows."""
    sc = rows.sparkSession.sparkContext
    total = sum(of.values())
    parts = rows.coalesce(PARTS)

    def told(runs: list[Descent], passes: int, apart: bool) -> None:
        held = sum(n for (_, h), n in of.items() if h) * apart
        for _ in range(passes):
            sent = sc.broadcast(([((r.trial * r.scale)[:-1], float(r.trial[-1])) for r in runs], apart))
            grad, more = np.zeros((len(runs), len(share)), np.float32), np.zeros((len(runs), 3))
            got = parts.mapInArrow(*_gradients(sent)).toArrow()
            for m, g, x in (row for batch in got.to_batches() for row in zip(*batch.columns, strict=True)):
                grad[m.as_py()] += np.frombuffer(g.as_buffer(), np.float32)
                more[m.as_py()] += np.frombuffer(x.as_buffer())
            del got, m, g, x  # before the steps, which need room of their own
            sent.destroy()
            sc._jvm.System.gc()  # else the driver's heap fills with gradients of past passes, up to all that it may have
            for m, r in enumerate(runs):
                r.tell(more[m, 1] / (total - held), (np.append(grad[m], more[m, 0]) * r.scale / (total - held)).astype(np.float32), more[m, 2] / max(held, 1))

    p = sum(n for (y, _), n in of.items() if y) / total
    spread = (np.append(share * (1 - share), 1) * p * (1 - p)).astype(np.float32)
    w = np.zeros(len(spread), np.float32)
    w[-1] = np.log(p / (1 - p))
    runs = [Descent(w, ridge, np.append(ratio(prior), 1).astype(np.float32), spread) for prior, ridge in SETTINGS]
    told(runs, CHOICE, True)
    k = min(range(len(runs)), key=lambda m: runs[m].held)
    last = Descent(runs[k].w, SETTINGS[k][1], runs[k].scale, spread)
    last.pairs = runs[k].pairs
    del runs
    told([last], LAST, False)
    return (last.w * last.scale)[:-1].astype(float), float(last.w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels(doc_id, toxic) over docs(doc_id, text).

    Rows with a null label are left out; a doc_id with several labels is toxic if one says so.  Without labels, or with
    labels of one kind only, every text gets the share of toxic labels, or 0 without any, as its score.
    """
    spark = docs.sparkSession
    truth = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    truth = truth.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(truth), F.col("doc_id") == F.col("l_id")).select("text", F.expr("int(toxic > 0)").alias("toxic"), F.expr("pmod(xxhash64(l_id, 5), 5) = 0").alias("held"))
    texts = kept(texts, "labelled")
    split = {(r["toxic"], r["held"]): r["n"] for r in texts.groupBy("toxic", "held").agg(F.count("*").alias("n")).collect()}
    of = {y: sum(n for (t, _), n in split.items() if t == y) for y in {y for y, _ in split}}
    slot = np.full(2**BITS, -1, np.int32)
    if len(of) < 2:
        p = float(np.clip(next(iter(of), 0), 1e-9, 1 - 1e-9))
        return Model(slot, np.zeros(1), float(np.log(p / (1 - p))))
    counts = texts.mapInArrow(*_bucket_counts()).groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow().sort_by("bucket")  # slots have the order of buckets
    bucket, clean, toxic = (counts[c].to_numpy().astype(np.int32) for c in ("bucket", "clean", "toxic"))
    del counts
    part = of[1] / (of[0] + of[1])
    ratio = lambda prior: np.log(toxic / part + prior) - np.log(clean / (1 - part) + prior)
    slot[bucket] = np.arange(len(bucket))
    sent = spark.sparkContext.broadcast(slot)
    rows = texts.mapInArrow(*_vectors(sent)).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()  # by itself, so that no task runs two Python workers
    w, b = logistic(rows, ratio, ((clean + toxic) / (of[0] + of[1])).astype(np.float32), split)
    rows.unpersist()
    sent.unpersist()
    pa.default_memory_pool().release_unused()
    return Model(slot, w, b)


def _score(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.scores(batch.column("text")))], names=[*batch.schema.names, name])

    return spare(run)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs, all columns, with a score from 0 to 1 as column ``name`` at the end; a null text scores as an empty one.

    ``name`` must not be a column of docs.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), name), f"{schema}, `{name}` double")


def rejected_out(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, whose score by a model of the labels is below the threshold."""
    name = "score"
    while name in docs.columns:
        name += "_"
    model = fit(docs, labels)
    compact(docs.sparkSession)
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs, labels.where(TAUGHT))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
