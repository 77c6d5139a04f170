"""WARC archives with a two-level capture index.

Writing: each task writes its pages as gzip-compressed WARC/1.1 records, one
member a record, into files of its own in the shared folder; a payload that an
earlier page has already is written as a revisit of that page.  Indexing: keys
(reversed-host URLs) are range-partitioned and sorted; every range becomes one
index file of compressed blocks and a sparse directory with each block's first
key.  Reading: a key is bisected among the files' first keys, then in that
file's directory, then in one block; the record itself is one range read.

Files of attempts that didn't finish are never named in what a job returns, so
a lost executor costs only its running tasks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch_path, table, written

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_ENTRY = pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_SHARD = pa.schema([("path", pa.string()), ("first_key", pa.string()), ("first_id", pa.int64()), ("entries", pa.int64())])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a null identifier in keys; smaller than any other.
_NO_ID = -(2**63)


def _safe(url: str) -> str:
    return _UNSAFE.sub(lambda m: quote(m[0]), url)


def surt(url: str | None) -> str:
    """The URL with its host reversed, without scheme, fragment, user, ``www.`` and usual port; ``-`` for none."""
    if not url:
        return "-"
    url = _safe(url.strip())
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    at = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        at += f":{port}"
    return f"{at}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str) -> bytes:
    """One compressed record; ``refers_to`` makes it a revisit, whose block has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_safe(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    block = http + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda b: dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in b.decode().split("\r\n")[1:])
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = 1 << 30) -> DataFrame:
    """Write every row as a record under ``folder``; returns the captures (key, id, file, offset, length).

    Of equal payloads of at least ``least_bytes`` bytes the row with the
    smallest identifier is the response (all rows that repeat that identifier
    are), the others revisit it; a row whose identifier is null revisits the
    smallest there is, or is a response.  Null payloads are empty.  A task holds
    one Arrow batch of rows, so of very long pages as many as a batch has.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    marks = rows.where(F.octet_length("payload") >= least_bytes).select("id", F.sha2("payload", 256).alias("content"))
    firsts = written(marks.groupBy("content").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n"), "firsts")
    # The join's own table, so that Spark's skew join may deal the rows of a frequent payload to tasks; then (payload, id) is the key.
    found = written(marks.join(firsts, "content").where("id IS NULL OR id != refers_to"), "repeats")
    again = written(found.distinct(), "revisits")
    discard(firsts)
    discard(found)
    tagged = rows.withColumn("content", F.sha2("payload", 256)).alias("p").join(again.alias("r"), (F.col("p.content") == F.col("r.content")) & F.col("p.id").eqNullSafe(F.col("r.id")), "left").select("p.id", "url", "payload", "refers_to")

    def run(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        out = path = None
        at = 0
        try:
            for batch in batches:
                rows = []
                for i, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
                    member = record(i, url, payload, first, digest32(payload), date)
                    out.write(member)
                    rows.append((surt(url), _NO_ID if i is None else i, path, at, len(member)))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRY, strict=True)], schema=_ENTRY)
        finally:
            if out is not None:
                out.close()

    return written(tagged.mapInArrow(run, "key string, id long, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, block_entries: int = 256) -> DataFrame:
    """Sort captures into index files under ``folder``; returns a row (path, first_key, first_id, entries) a file."""
    sort = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "file", "offset")

    def run(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}"
        directory, held, at, first, total = [], [], 0, None, 0
        with fs.open_output_stream(f"{path}.idx", compression=None, buffer_size=1 << 20) as out:

            def flush():
                nonlocal at
                block = zlib.compress("\n".join("\t".join(map(str, e)) for e in held).encode(), 6)
                out.write(block)
                directory.append((held[0][0], held[0][1], at, len(block)))
                at += len(block)
                held.clear()

            for batch in batches:
                for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    first = first or e
                    held.append(e)
                    total += 1
                    if len(held) == block_entries:
                        flush()
            if held:
                flush()
        if first is not None:
            with fs.open_output_stream(f"{path}.dir") as out:
                out.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((path, first[0], first[1], total), _SHARD, strict=True)], schema=_SHARD)

    return written(sort.mapInArrow(run, "path string, first_key string, first_id long, entries long"), "index")


class IndexReader:
    """Looks captures up in index files, keeping one directory and one block."""

    def __init__(self, fs):
        self.fs = fs
        self.path = self.block_at = None
        self.files: OrderedDict = OrderedDict()

    def _open(self, path: str):
        if path not in self.files:
            if len(self.files) >= 32:
                self.files.popitem(last=False)[1].close()
            self.files[path] = self.fs.open_input_file(path)
        self.files.move_to_end(path)
        return self.files[path]

    def read(self, path: str, offset: int, length: int) -> bytes:
        return self._open(path).read_at(length, offset)

    def _block(self, k: int) -> list[tuple[str, int, str, int, int]]:
        if self.block_at != (self.path, k):
            _, _, offset, length = self.directory[k]
            lines = zlib.decompress(self.read(f"{self.path}.idx", offset, length)).decode().split("\n")
            self.block = [(key, int(i), file, int(at), int(n)) for key, i, file, at, n in (x.split("\t") for x in lines)]
            self.keys = [e[:2] for e in self.block]
            self.block_at = (self.path, k)
        return self.block

    def find(self, path: str, key: tuple[str, int]) -> list[tuple[str, int, int]]:
        """(file, offset, length) of all captures of the key in an index file."""
        if path != self.path:
            with self.fs.open_input_stream(f"{path}.dir") as f:
                self.directory = json.loads(f.read())
            self.path, self.first = path, [(d[0], d[1]) for d in self.directory]
        # A key may begin in the block before the first one that starts with it.
        k = max(0, bisect_right(self.first, key) - 1)
        while k > 0 and self.first[k] == key:
            k -= 1
        found = []
        while k < len(self.first) and self.first[k] <= key:
            block = self._block(k)
            at = bisect_right(self.keys, key)
            lo = at
            while lo > 0 and self.keys[lo - 1] == key:
                lo -= 1
            found += [e[2:] for e in block[lo:at]]
            k += 1
        return found


def read_captures(lookups: DataFrame, index: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload: bool = True) -> DataFrame:
    """Records of the captures that the rows (``id_col``, ``url_col``) name, one row a record.

    Columns: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, unless left out, payload (null for revisits).  A repeated
    lookup counts once; one that isn't archived gives no row.  A payload that
    doesn't have its recorded digest is an error.
    """
    files = sorted(((r["first_key"], r["first_id"]), r["path"]) for r in index.select("path", "first_key", "first_id").collect())  # a row a partition
    starts = [f[0] for f in files]

    def keyed(batches):
        for batch in batches:
            keys = [surt(u) for u in batch.column(1).to_pylist()]
            ids = [_NO_ID if i is None else i for i in batch.column(0).to_pylist()]
            shard = [max(0, bisect_right(starts, k) - 1) for k in zip(keys, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(keys, pa.string()), pa.array(ids, pa.int64())], names=["shard", "key", "id"])

    asked = lookups.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(keyed, "shard int, key string, id long")
    routed = asked.dropDuplicates(["shard", "key", "id"]).repartition("shard").sortWithinPartitions("shard", "key", "id")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload)

    def run(batches):
        fs, _ = _filesystem(folder)
        reader = IndexReader(fs)
        for batch in batches:
            rows, size = [], 0
            for shard, key, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for place in reader.find(files[shard][1], (key, i)) if files else ():
                    warc, http, body = parsed(reader.read(*place))
                    kind, digest, first = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc.get("X-Refers-To-Page")
                    if kind == "response" and (digest32(body) != digest or len(body) != int(http["Content-Length"])):
                        raise ValueError(f"record at {place}: its payload isn't the one recorded")
                    page = warc["X-Page-ID"]
                    row = (int(page) if page else None, warc["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, int(first) if first else None)
                    rows.append((*row, body if kind == "response" else None) if payload else row)
                    size += len(body) * payload
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return routed.mapInArrow(run, kinds)


def op4_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    index = write_index(write_archives(pages, folder), folder)
    return read_captures(pages, index, folder, payload=False).drop("url")


ORACLE = {
    "op4_indexed_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(w, lambda v: substr(a, (v >> 15) + 1, 1) || substr(a, ((v >> 10) & 31) + 1, 1) || substr(a, ((v >> 5) & 31) + 1, 1) || substr(a, (v & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
}
