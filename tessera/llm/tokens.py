"""Token counts, with huge documents encoded in overlapping chunks.

The tokenizer drops white space and never joins characters across it, so the
place after ASCII white space is a stable boundary: what is left of it and what
is right of it encode alike whatever else the text holds.  Two uses:

*   texts of usual length are counted word by word, each distinct word encoded
    once by the library and kept in a table of bounded size;
*   a text of more than ``HUGE`` characters is encoded in overlapping chunks
    with offsets.  Neighbouring chunks are spliced at a stable boundary inside
    their overlap at which no token of either chunk crosses; where an overlap
    has none, it is widened until it has, up to the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUGE = 1 << 15
OVERLAP = 1 << 8
WORDS = 200_000
LIMIT = 2048
SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def splice(t, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text, from chunks of about ``chunk`` characters that overlap by ``overlap`` or more."""
    n = len(text)
    if n <= chunk + overlap:
        return len(t.encode(text, add_special_tokens=False))
    total, begin = 0, 0  # begin: the stable boundary up to which tokens are counted
    while n - begin > chunk + overlap:
        wide = overlap
        while True:
            end, back = min(n, begin + chunk + wide), begin + chunk
            if end == n:
                return total + len(t.encode(text[begin:], add_special_tokens=False))
            left = t.encode(text[begin:end], add_special_tokens=False).offsets
            right = t.encode(text[back:end], add_special_tokens=False).offsets
            at = _common(text, begin, left, back, right, end)
            if at is not None:
                break
            wide *= 2
        total += sum(1 for s, _ in left if begin + s < at)
        begin = at
    return total + len(t.encode(text[begin:], add_special_tokens=False))


def _common(text: str, begin: int, left: list, back: int, right: list, end: int) -> int | None:
    """A stable boundary in the overlap from which on both chunks have the same tokens."""
    m = SPACE.search(text, back, end - 1)
    while m:
        at = m.end()
        a = [(begin + s, begin + e) for s, e in left if begin + e > at]
        b = [(back + s, back + e) for s, e in right if back + e > at]
        if a == b and (not a or a[0][0] >= at):
            return at
        m = SPACE.search(text, at, end - 1)
    return None


def _counts(path: str, limit: int, huge: int, overlap: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = tokenizer(path), {}
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                texts = [x or "" for x in part.column("text").to_pylist()]
                raw = [x.encode() for x in texts]
                words = [() if len(x) > huge else b.split() for x, b in zip(texts, raw, strict=True)]
                new = list(set(chain.from_iterable(words)) - known.keys())
                if len(known) + len(new) > WORDS:
                    known = {}
                    new = list(set(chain.from_iterable(words)))
                known.update(zip(new, map(len, t.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)), strict=True))
                n = [splice(t, x, huge, overlap) if len(x) > huge else sum(map(known.__getitem__, w)) for x, w in zip(texts, words, strict=True)]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    return run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, huge: int = HUGE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row, by the tokenizer file at ``path``.

    For tokenizers that split at white space and drop it.  A null text is empty and has no tokens.  No begin, end or padding
    tokens are added; special strings inside a text count as the library takes them by default.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(*_counts(path, limit, huge, overlap))


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
