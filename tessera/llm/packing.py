"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A document's ids are cut into whole sequences, then halves, quarters, ... of
the capacity down to a sixteenth, and a tail shorter than that.  Class k takes
the pieces whose length lies in (capacity / (k + 1), capacity / k], and each of
its bins a fixed number, k, of pieces.  The halved pieces fill their bins to the
last place; a tail bin has at most a sixteenth of padding.  Every task packs
what it reads alone, without a shuffle; what is in open bins at its end goes
into common bins, largest pieces first.

Ids are those of the ``tokenizers`` library for a byte-level BPE file.  Texts of
characters up to U+024F are encoded by tiktoken with the file's vocabulary as
ranks, which gives the same ids several times faster; texts with other
characters, whose classes differ between versions of Unicode, or with very long
runs of white space go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import spare
from tessera.llm.tokens import tokenizer

CAPACITY = 1024
FINEST = 16
END = b"\0\0\0\0"
#: The pre-tokens of the byte-level tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLOW = re.compile(r"[^\x00-\u024f]|\s{1000}")
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@cache
def ranks(path: str):
    """A tiktoken encoding with the vocabulary and special tokens of a byte-level BPE file."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    merged = {bytes(byte[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=merged, special_tokens=special)


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        self.path, self.fast = path, ranks(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [self.fast.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() if not SLOW.search(t) else None for t in texts]
        slow = [k for k, b in enumerate(out) if b is None]
        if slow:
            for k, e in zip(slow, tokenizer(self.path).encode_batch_fast([texts[k] for k in slow], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out


def lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """The pieces of n tokens: whole sequences, halvings down to a FINEST-th, and the tail."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= capacity // FINEST:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Packer:
    """Bins of one task.  ``add`` and ``close`` return finished rows of FIELDS."""

    def __init__(self, first: int, capacity: int) -> None:
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def bin(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        bin_ = self.open[k]
        bin_.append(piece)
        if len(bin_) < k:
            return []
        del self.open[k]
        return self.bin(bin_)

    def close(self) -> list[tuple]:
        out, bin_, full = [], [], 0
        for p in sorted(chain.from_iterable(self.open.values()), key=lambda p: -p[2]):
            if full + p[2] > self.capacity:
                out += self.bin(bin_)
                bin_, full = [], 0
            bin_.append(p)
            full += p[2]
        self.open.clear()
        return out + (self.bin(bin_) if bin_ else [])


def _pack(path: str, capacity: int):
    schema = pa.schema([(c, pa.int64()) for c in FIELDS])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(FIELDS), schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder, packer = Encoder(path), Packer((task.partitionId() if task else 0) << 40, capacity)
        for batch in batches:
            for k in range(0, len(batch), 500):
                part, rows = batch.slice(k, 500), []
                for doc, tokens in zip(part.column("doc_id").to_pylist(), encoder.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    tokens += END
                    view, start, n = memoryview(tokens), 0, len(tokens) // 4
                    for size in lengths(n, capacity):
                        rows += packer.add((doc, start, size, zlib.crc32(view[4 * start : 4 * (start + size)]), n))
                        start += size
                yield table(rows)
        yield table(packer.close())

    return spare(run), ", ".join(f"{c} long" for c in FIELDS)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids by the byte-level tokenizer file at ``path`` and id 0 after them; a null or empty text is that id
    alone.  Rows are packed one by one, so repeated rows and null doc_ids give pieces of their own.  sequence_id is unique
    over the result; each task numbers its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(*_pack(path, capacity))


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
