"""WARC archives: writing with revisits, and reading by boundary-chain verification.

An archive is cut into byte ranges.  A task looks for record magic in its range and emits
(offset, successor) for whatever parses as a record header, however long; a payload may
hold such text too.  From the file's start, pointer jumping over these links reaches exactly the records
that the file consists of: what no chain reaches is a payload's content and is dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, byte_lengths, slices, table

MAGIC = b"WARC/1."
REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
ARCHIVE_BYTES = 256 << 20
READ_AHEAD = 64 << 10
START = re.compile(rb"WARC/1\.\d\r\n")
LENGTH = re.compile(rb"\r\n[Cc]ontent-[Ll]ength:[ \t]*(\d{1,18})[ \t]*(?=\r\n)")
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())


def record(page_id, url: bytes | None, kind: bytes, n: int, sha1: str, payload: bytes | None, refers_to) -> bytes:
    """One record; a revisit keeps the HTTP head, with the full payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + _urn(page_id), b"WARC-Date: 2000-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1))]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url))
    if payload is None:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _urn(refers_to)]
    body = http + (payload or b"")
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _packed(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, n, sha1, packed): payloads travel compressed."""

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, urls, pages_ = batch.columns
            for a, b in slices(byte_lengths(pages_)):
                data = [x or b"" for x in pages_[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], urls[a:b], pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha1(x).hexdigest() for x in data]), pa.array([squeeze.compress(x) for x in data], pa.binary())],
                    ["page_id", "url", "n", "sha1", "packed"],
                )

    return pages.select("page_id", F.col("url").cast("binary"), F.col("html").cast("binary")).mapInArrow(pack, "page_id long, url binary, n long, sha1 string, packed binary")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns (path, size, records) of each; run it once.

    Of payloads of at least 1000 bytes with one SHA-1, the record of the largest page_id is
    the response and the others revisit it (rows that repeat that id are responses too).
    File names are new for every attempt of a task, and only the files in the returned
    table count, so a lost or repeated task leaves no doubt.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    groups = pages.select("page_id", F.sha1(payload).alias("sha1_of")).where(F.octet_length(payload) >= REVISIT_BYTES).groupBy("sha1_of").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("members")).where("members > 1").drop("members")
    packed = _packed(pages)
    joined = packed.join(groups, packed["sha1"] == groups["sha1_of"], "left").drop("sha1_of")

    def write(batches):
        unpack = zstandard.ZstdDecompressor()
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        done, out, name, size, n = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, length, sha1, data, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc", 0, 0
                    out = where.open_output_stream(f"{root}/{name}")
                same = refers is None or refers == page_id
                made = record(page_id, url, b"response" if same else b"revisit", length, sha1, unpack.decompress(data, max_output_size=max(length, 1)) if same else None, refers)
                out.write(made)
                size, n = size + len(made), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        yield pa.RecordBatch.from_pylist([{"path": p, "size": s, "records": r} for p, s, r in done], pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return joined.select("page_id", "url", "n", "sha1", "packed", "refers_to").mapInArrow(write, "path string, size long, records long")


def _headers(data: bytes, stop: int, more=lambda at: b""):
    """(place, length of the header, of the block) wherever before stop a record's header can start.

    more(n) gives what follows the first n bytes, nothing at the end.  What is found for one
    place serves those after it, so a payload full of magic costs no more than its bytes.
    """
    end, found, at = -1, None, data.find(MAGIC)
    while 0 <= at < stop:
        if START.match(data, at):
            if end < at:
                seek = at
                while (end := data.find(b"\r\n\r\n", seek)) < 0 and (extra := more(len(data))):
                    seek = max(at, len(data) - 3)
                    data += extra
                if end < 0:
                    return
                found = LENGTH.search(data, at, end + 2)
            elif found and found.start() < at:
                found = LENGTH.search(data, at, end + 2)
            if found:
                yield at, end + 4 - at, int(found[1])
        at = data.find(MAGIC, at + 1)


def boundary_links(ranges: DataFrame) -> DataFrame:
    """(path, size, start, stop) -> (path, size, offset, successor) of every candidate."""

    def scan(batches):
        for batch in batches:
            for path, size, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as f:
                    data = f.read_at(min(size, stop + READ_AHEAD) - start, start)
                    more = lambda n, f=f, start=start, size=size: f.read_at(min(n, size - start - n), start + n)
                    links = [(start + at, start + at + head + block + 4) for at, head, block in _headers(data, stop - start, more)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(links), pa.string()), pa.array([size] * len(links), pa.int64()), *(pa.array([x[i] for x in links], pa.int64()) for i in (0, 1))], ["path", "size", "offset", "successor"])

    return ranges.select("path", "size", "start", "stop").mapInArrow(scan, "path string, size long, offset long, successor long")


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the candidates (offsets ascending) a chain from offset 0 reaches, by pointer jumping."""
    n = len(offset)
    at = np.searchsorted(offset, successor)
    jump = np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n) if n else at
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, bool)
    if n and offset[0] == 0:
        seen[0] = True
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        more[n] = False
        if (more == seen).all():
            return seen[:n]
        seen, jump = more, jump[jump]


def _chain(t: pa.Table) -> pa.Table:
    t = t.sort_by("offset")
    offset, successor = (t.column(c).to_numpy() for c in ("offset", "successor"))
    kept = reachable(offset, successor)
    whole = bool(kept.any()) and int(successor[kept][-1]) == t.column("size")[0].as_py()
    out = t.filter(pa.array(kept)).select(["path", "offset", "successor"])
    return out.append_column("whole", pa.array([whole] * len(out), pa.bool_()))


VERIFIED = "path string, offset long, successor long, whole boolean"


def verified(links: DataFrame) -> DataFrame:
    """Keeps the reachable candidates: (path, offset, successor, whole).

    whole: the chain ends at the file's end; else the archive is torn after its last record.
    A task gets one archive's links, 16 bytes a record.
    """
    return links.groupBy("path").applyInArrow(_chain, VERIFIED)


def complete(links: DataFrame, manifest: DataFrame) -> DataFrame:
    """verified(), and an error where an archive is torn or has not the records that were written."""

    def check(m: pa.Table, t: pa.Table) -> pa.Table:
        out = _chain(t)
        path, records = m.column("path")[0].as_py(), m.column("records")[0].as_py()
        if len(out) != records or not all(out.column("whole").to_pylist()):
            raise ValueError(f"{path}: {len(out)} of {records} records found, or the archive is torn")
        return out

    return manifest.select("path", "records").groupBy("path").cogroup(links.groupBy("path")).applyInArrow(check, VERIFIED)


def read_records(found: DataFrame) -> DataFrame:
    """(path, offset, successor) -> page_id, payload_bytes, payload_digest, record_type, refers_to, payload_ok."""

    def field(head: bytes, name: bytes) -> bytes | None:
        m = re.search(rb"(?i)\r\n" + name + rb":[ \t]*([^\r]*)", head)
        return m[1] if m else None

    def number(urn: bytes | None):
        m = re.match(rb"<urn:page:(-?\d+)>", urn or b"")
        return int(m[1]) if m else None

    def read(batches):
        for batch in batches:
            out, now, f = [], None, None
            order = pc.sort_indices(pa.Table.from_batches([batch]), sort_keys=[("path", "ascending"), ("offset", "ascending")])
            for path, offset, successor in zip(*(c.to_pylist() for c in batch.take(order).columns), strict=True):
                if path != now:
                    if f is not None:
                        f.close()
                    where, name = fs.FileSystem.from_uri(path)
                    now, f = path, where.open_input_file(name)
                data = f.read_at(successor - offset, offset)
                _, n_head, n_block = next(_headers(data, 1))
                head, block = data[:n_head], data[n_head : n_head + n_block]
                http, _, payload = block.partition(b"\r\n\r\n")
                kind = field(head, b"WARC-Type").decode()
                told = base64.b32decode(field(head, b"WARC-Payload-Digest").rpartition(b":")[2]).hex()
                sha1 = hashlib.sha1(payload).hexdigest() if kind == "response" else told
                size = len(payload) if kind == "response" else int(field(b"\r\n" + http, b"Content-Length"))
                out.append((number(field(head, b"WARC-Record-ID")), size, sha1, kind, number(field(head, b"WARC-Refers-To")), sha1 == told))
            if f is not None:
                f.close()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok"]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return found.select("path", "offset", "successor").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean")


def read_warc(archives: DataFrame) -> DataFrame:
    """(path, size) of uncompressed archives -> their records, found in parallel.

    With records, as write_warc() returns them, an archive that has not all of them is an error.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(RANGE_BYTES).cast("long"))
    ranges = archives.where("size > 0").select("path", "size", F.explode(starts).alias("start")).withColumn("stop", F.least(F.col("size"), F.col("start") + RANGE_BYTES))
    total = archives.agg(F.sum("size")).first()[0] or 0
    n = total // (4 * RANGE_BYTES) + 1  # so that no task reads more than some ranges, however small their links
    links = boundary_links(ranges.repartition(n, "path", "start"))
    found = complete(links, archives) if "records" in archives.columns else verified(links)
    return read_records(found.repartition(n, "path", F.floor(F.col("offset") / RANGE_BYTES)))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, and the archives read back.  A null html is an empty payload."""
    stash = Stash(spark, "warc")
    archives = stash.put(write_warc(table(spark, sf_dir, "pages"), f"{stash.root}/archives"), "manifest")
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS last_id, count(*) AS members FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN members > 1 AND last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN members > 1 AND last_id <> page_id THEN last_id END AS refers_to
FROM p LEFT JOIN g USING (digest)
"""
