"""WARC archives, index first.

Writing: payload digests find repeated payloads; the record with the smallest
page_id of each payload is a response, later ones are revisits that name it.
Each task writes one archive of independently compressed records and emits an
index row (file, offset, length, url, digest, ...) per record.  Reading: the
selected index rows are sorted per archive, neighbouring byte ranges are
coalesced, and tasks read those ranges and parse the records in them.

A task writes under a name of its own attempt and its index rows carry that
name, so a retried or speculative task leaves an unused file behind but never a
wrong index.  Archives go through ``pyarrow.fs``, so the folder can be any store
that it opens.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common

_INDEX = ("file string, offset long, length long, page_id long, url string, digest string, "
          "record_type string, refers_to long, payload_bytes long")
_RECORDS = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
            "record_type string, refers_to long")
_DATE = "2000-01-01T00:00:00Z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id, url: str | None, html: str | None, refers_to=None, revisit: bool = False) -> tuple[bytes, str, int]:
    """One WARC/1.1 record, its payload's base32 SHA-1 and length.  A revisit
    has the HTTP header but no payload."""
    payload = (html or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest, len(payload)


#: Left as they are in a target URI; everything else is percent-encoded, % too, so that unquote gives the text back.
_URL_SAFE = ":/?#[]@!$&'()*+,;=~"


def parse(data: bytes) -> dict:
    """Fields of one uncompressed record; checks the payload against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if lines[0] != "WARC/1.1" or kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")

    def number(name):
        return int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"),
            "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
            "payload": payload if kind == "response" else None, "payload_bytes": number("X-Payload-Length"),
            "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID")}


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest hex, first): the pages whose payload of at least
    ``min_bytes`` bytes an earlier page_id has too.  Slim rows only; the first
    page of a payload is a minimum with map-side combine, so a payload that a
    third of all pages share is no large group.  A null page_id comes after
    every other; pages that share the smallest page_id of a payload are all
    responses."""
    html = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", F.sha1(html.cast("binary")).alias("__digest"), F.octet_length(html).alias("bytes"))
    slim = slim.filter(F.col("bytes") >= min_bytes).select("page_id", "__digest").distinct()
    first = (slim.groupBy("__digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("n"))
             .filter("n > 1 and __first is not null").select(F.col("__digest").alias("d"), "__first"))
    return (slim.join(first, F.col("__digest") == F.col("d"))
            .filter(~F.col("page_id").eqNullSafe(F.col("__first")))
            .select(F.col("page_id").alias("__page"), "__digest", "__first"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) and return the index.

    Null html is an empty payload, null url a record without a target URI.
    Rows that repeat a page_id are records of their own."""
    known = revisits(pages, min_bytes)
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("d"))
    rows = (rows.join(known, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("d") == F.col("__digest")), "left")
            .select("page_id", "url", "html", "__first"))

    def run(batches):
        out = where = name = None
        try:
            for batch in batches:
                index = {k: [] for k in ("file", "offset", "length", "page_id", "url", "digest", "record_type",
                                         "refers_to", "payload_bytes")}
                if batch.num_rows and out is None:
                    where, root = _open(folder)
                    where.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                    at = 0
                for i in range(batch.num_rows):
                    page_id, url, html, first = (c[i].as_py() for c in batch.columns)
                    data, digest, n = record(page_id, url, html, first, revisit=first is not None)
                    data = gzip.compress(data, level, mtime=0)
                    out.write(data)
                    for k, v in zip(index, (name, at, len(data), page_id, url, digest,
                                            "response" if first is None else "revisit", first, n)):
                        index[k].append(v)
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.string() if k in ("file", "url", "digest", "record_type") else pa.int64())
                     for k, v in index.items()], names=list(index))
        finally:
            if out is not None:
                out.close()

    return common.stash(rows.mapInArrow(run, _INDEX), "warc-index")


def read(selected: DataFrame, folder: str, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records of the index rows ``selected`` (rows of ``write``'s index).

    Ranges of one archive less than ``gap`` bytes apart are read together, up
    to about ``most`` bytes a read; a range is one row, so archives of any size
    spread over tasks."""
    by_offset = W.partitionBy("file").orderBy("offset")
    end = F.col("offset") + F.col("length")
    ranges = (selected.select("file", "offset", "length").distinct()
              .withColumn("new", F.coalesce(F.col("offset") - F.lag(end).over(by_offset) > gap, F.lit(True)).cast("long"))
              .withColumn("run", F.sum("new").over(by_offset))
              .withColumn("start", F.first("offset").over(W.partitionBy("file", "run").orderBy("offset")))
              .withColumn("part", F.floor((F.col("offset") - F.col("start")) / most))
              .groupBy("file", "run", "part")
              .agg(F.min("offset").alias("lo"), F.max(end).alias("hi"),
                   F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
              .select("file", "lo", "hi", "records"))

    def run(batches):
        kinds = dict(zip(("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"),
                         (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())))
        where, root = _open(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                name, lo, hi, records = (c[i].as_py() for c in batch.columns)
                with where.open_input_file(f"{root}/{name}") as f:
                    data = f.read_at(hi - lo, lo)
                rows = [parse(gzip.decompress(data[r["offset"] - lo:r["offset"] - lo + r["length"]])) for r in records]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()],
                                                 names=list(kinds))

    return ranges.mapInArrow(run, _RECORDS)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark, "warc")
    index = write(common.table(spark, sf_dir, "pages"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 of a digest: each 5 hex digits (20 bits) are 4 letters.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p),
r AS (SELECT *, [CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) for i in range(0, 8)] AS v FROM q)
SELECT page_id, payload_bytes,
       array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS BIGINT), 1)
                                         for s in [15, 10, 5, 0]], '') for x in v], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM r
"""
