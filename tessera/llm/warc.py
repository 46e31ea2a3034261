"""WARC archives: written by Spark's text writer, read by verifying chains of record boundaries.

The magic that opens a record may as well stand inside a payload.  A reading
task takes every place with the magic as a candidate and, from its header's
Content-Length, the place of its successor.  Pointer jumping from the start of
the file keeps the candidates that a chain of records reaches; the others lie
inside payloads.

Each writing task makes one archive of the pages that it read, so archives are
no larger than the input's partitions, and a task reads whole ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import kept, place

LEAST = 0
MAGIC = b"WARC/1.1\r\n"
GAP = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
URN = "urn:tessera:page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
FIELDS = ["archive", "at", "record_type", "page_id", "refers_to", "payload_bytes", "payload_digest", "stated_digest"]


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: 20 bits of the hex digest are four digits."""
    letters, parts = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), []
    for k in range(8):
        v = F.conv(F.substring(F.sha1(text), 5 * k + 1, 5), 16, 10).cast("int")
        parts += [letters.substr(F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """A record per row of pages(page_id, url, html) into archives under ``path``.

    Of rows with equal payloads of at least ``least`` bytes, the one with the largest page_id is a response and the others
    revisit it; a null html is an empty payload.  Line breaks in a url are percent-encoded; a null url is empty.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"sha": F.sha1("html"), "n": F.octet_length("html")})
    small = kept(p.select("page_id", "sha", "n"), "digests")
    largest = small.groupBy("sha", "n").agg(F.max("page_id").alias("largest"))
    refers = small.join(largest, ["sha", "n"]).where((F.col("n") >= least) & (F.col("page_id") < F.col("largest"))).select("page_id", "sha", "largest").distinct().toDF("r_id", "r_sha", "refers_to")
    refers = kept(refers, "revisits")  # so that its size is known when the join is planned
    p = p.join(refers, (F.col("page_id") == F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left")
    digest = base32_sha1(F.col("html"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = lambda kind, *more: F.concat(F.lit(f"{MAGIC.decode()}WARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), urn("page_id"), F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, *more)
    http = F.concat(F.lit(HTTP), F.col("n").cast("string"), F.lit(GAP))
    response = F.concat(head("response", F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.col("n")).cast("string"), F.lit(GAP)), http, F.col("html"))
    revisit = head("revisit", F.lit("\r\nWARC-Refers-To: "), urn("refers_to"), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nContent-Length: 0{GAP}"))
    record = F.when(F.col("refers_to").isNull(), response).otherwise(revisit).alias("value")
    p.select(record).write.option("lineSep", GAP).text(path)


def chain(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, header end, end of block) of the records that a chain from the start of the file reaches."""
    at = [m.start() for m in re.finditer(re.escape(MAGIC), data)]
    start = np.array(at, np.int64)
    head, end = np.full(len(at), -1), np.full(len(at), -1)
    for k, s in enumerate(at):
        h = data.find(b"\r\n\r\n", s)
        size = re.search(rb"\r\nContent-Length: *(\d+)(?:\r\n|$)", data[s:h], re.IGNORECASE) if h >= 0 else None
        if size:
            e = h + 4 + int(size[1])
            if data[e : e + 4] == b"\r\n\r\n":
                head[k], end[k] = h, e
    # successors: another candidate, or the stop at len(at)
    nxt = np.searchsorted(start, end + 4)
    nxt[end < 0] = len(at)
    true = np.append(start, -1)[nxt] == end + 4
    nxt = np.append(np.where(true, nxt, len(at)), len(at))
    reach = np.zeros(len(at) + 1, bool)
    reach[0] = len(at) > 0 and at[0] == 0
    for _ in range(max(1, len(at)).bit_length()):
        reach[nxt[np.flatnonzero(reach)]] = True
        nxt = nxt[nxt]
    k = np.flatnonzero(reach[:-1] & (end >= 0))
    return start[k], head[k], end[k]


def _records():
    schema = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string())])

    def number(text: str | None) -> int | None:
        return int(text.removeprefix("<" + URN).removesuffix(">") or 0) if text and text != f"<{URN}>" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer().to_pybytes()
                rows = []
                for s, h, e in zip(*[x.tolist() for x in chain(data)], strict=True):
                    fields = dict(x.split(": ", 1) for x in data[s:h].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                    kind = fields.get("WARC-Type")
                    n = digest = None
                    if kind == "response":
                        body = data.find(b"\r\n\r\n", h + 4, e) + 4
                        n, digest = e - body, base64.b32encode(hashlib.sha1(memoryview(data)[body:e]).digest()).decode()
                    rows.append((name, s, kind, number(fields.get("WARC-Record-ID")), number(fields.get("WARC-Refers-To")), n, digest, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run, "archive string, at long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, stated_digest string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS of every record that a chain from its file's start reaches.  payload_bytes and payload_digest are of the payload that is there: null for a revisit."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(*_records())


def round_trip(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has the size and digest of the response that it refers to.  A response whose payload does not have its
    stated digest fails the read.
    """
    write_archives(pages, path, least)
    r = kept(read_archives(pages.sparkSession, path), "records")
    good = F.when(F.col("stated_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload in "), "archive")))
    response = r.where("record_type = 'response'").withColumn("payload_digest", good)
    target = response.select(F.col("page_id").alias("t_id"), F.col("payload_digest").alias("t_digest"), F.col("payload_bytes").alias("t_bytes")).distinct()
    revisit = r.where("record_type = 'revisit'").join(target, (F.col("refers_to") == F.col("t_id")) & (F.col("stated_digest") == F.col("t_digest")), "left")
    revisit = revisit.select("page_id", F.col("t_bytes").alias("payload_bytes"), F.col("t_digest").alias("payload_digest"), "record_type", "refers_to")
    return response.select(revisit.columns).union(revisit)


def op8(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), place(spark, "warc"))
