"""WARC archives and media containers: round trips."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import media, warc
from papyra.llm.common import Stash

from ..conftest import SF
from ..oracle import assert_same

PAGES = "page_id long, url string, html string, path string, size long"


def pages():
    big, trap = "x" * 1000, "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40
    rows = [(1, "http://a/", big), (2, "http://b/\r\nEvil: 1", big), (3, None, big), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "u", None), (7, "u", ""), (8, "u", trap), (9, "u", trap), (10, "u", "é" * 600), (None, "u", big), (3, "again", big)]
    return [(*r, "clash", 7) for r in rows]


@pytest.mark.parametrize("range_bytes", [8 << 20, 700])
def test_warc_round_trip(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(warc, "RANGE_BYTES", range_bytes)
    stash = Stash(spark, "test")
    df = spark.createDataFrame(pages(), PAGES).repartition(2)
    archives = stash.put(warc.write_warc(df, f"{stash.root}/archives"), "manifest")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest, r.payload_ok) for r in warc.read_warc(archives).collect()))
    want = []
    for page_id, _, html, *_ in pages():
        data = (html or "").encode()
        same = [p for p, _, h, *_ in pages() if p is not None and (h or "").encode() == data]
        last = max(same) if len(data) >= 1000 and len([1 for _, _, h, *_ in pages() if (h or "").encode() == data]) > 1 else page_id
        kind = "response" if last == page_id else "revisit"
        want.append((page_id or 0, kind, last if kind == "revisit" else 0, len(data), hashlib.sha1(data).hexdigest(), True))
    assert got == sorted(want)


def test_warc_without_pages(spark):
    stash = Stash(spark, "test")
    archives = stash.put(warc.write_warc(spark.createDataFrame([], PAGES), f"{stash.root}/archives"), "manifest")
    assert warc.read_warc(archives).count() == 0


def test_torn_archive_keeps_what_is_whole(spark, tmp_path):
    one = warc.record(1, b"u", b"response", 3, hashlib.sha1(b"abc").hexdigest(), b"abc", None)
    path = tmp_path / "t.warc"
    path.write_bytes(one + one[:40])
    found = warc.verified(warc.boundary_links(spark.createDataFrame([(f"file://{path}", os.path.getsize(path), 0, os.path.getsize(path))], "path string, size long, start long, stop long"))).collect()
    assert [(r.offset, r.successor, r.whole) for r in found] == [(0, len(one), False)]


@pytest.mark.parametrize("range_bytes", [8 << 20, 50_000])
def test_headers_of_any_length(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(warc, "RANGE_BYTES", range_bytes)
    stash = Stash(spark, "test")
    rows = [(1, "u", "a", "", 0), (2, "data:," + "x" * 300_000, "b", "", 0), (3, " \0" * 40_000, "c", "", 0), (4, "u", "WARC/1.1\r\n" * 20_000, "", 0), (5, "u", "d", "", 0)]
    archives = stash.put(warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(1), f"{stash.root}/archives"), "manifest")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_warc(archives).collect()) == [(r[0], len(r[2])) for r in rows]


@pytest.mark.parametrize("damage", ["records + 1 AS records, size", "records, size - 1 AS size", "records, 3L AS size"])
def test_archives_that_lack_records_fail(spark, damage):
    stash = Stash(spark, "test")
    archives = stash.put(warc.write_warc(spark.createDataFrame(pages(), PAGES).repartition(1), f"{stash.root}/archives"), "manifest")
    with pytest.raises(Exception, match="records found"):
        warc.read_warc(archives.selectExpr("path", *damage.split(", "))).collect()


def test_warc_query(spark):
    assert_same(warc.op4_warc(spark, SF), warc.SQL, SF)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.randoms())
def test_pointer_jumping(n, rnd):
    offset = np.array(sorted(rnd.sample(range(1, 500), n)), np.int64)
    offset[0] = 0
    successor = np.array([rnd.choice([*offset[offset > o].tolist(), 999]) for o in offset], np.int64)
    want, at, index = set(), 0, {int(o): i for i, o in enumerate(offset)}
    while at in index:
        want.add(at)
        at = int(successor[index[at]])
    assert set(offset[warc.reachable(offset, successor)].tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_container_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and payload[: len(data)] == data and set(payload[len(data) :]) <= {255} and payload
    made = media.container(payload)
    t = media.tracks(made)[0]
    assert media.stored_bytes(made, t) == payload
    d = media.describe(made)
    assert d["codec"] == "raw " and d["duration"] == len(payload) and d["samples"] == len(payload) // 576
    assert all(made[o : o + n] == payload[k * 8 * 576 : k * 8 * 576 + 576] for k, (o, n) in enumerate(d["keyframes"]))


@pytest.mark.parametrize("data", [None, b"", b"\0\0\0\x08free", b"\xff" * 50, media.container(media.padded(b"x"))[:300]])
def test_media_that_is_none(data):
    d = media.describe(data)
    assert d["codec"] is None and d["error"]


def _replaced(data: bytes, kind: bytes, body: bytes) -> bytes:
    """A container with the body of its first box of a kind replaced, lengths as they were."""
    at = data.index(kind)
    return data[: at + 4] + body + data[at + 4 + len(body) :]


@pytest.mark.parametrize("kind,body", [(b"stsz", bytes(4) + b"\0\0\0\1" + b"\xff" * 4), (b"stsz", bytes(8) + b"\xff" * 4), (b"stsc", bytes(4) + b"\xff" * 4), (b"stsc", bytes(4) + b"\0\0\0\1" + b"\0\0\0\1" + b"\xff" * 4), (b"stco", bytes(4) + b"\xff" * 4), (b"stss", bytes(4) + b"\xff" * 4), (b"stss", bytes(8) + b"\0\0\0\1" + b"\0\0\0\0"), (b"stco", bytes(8) + b"\xff" * 4)])
def test_hostile_containers(kind, body):
    d = media.describe(_replaced(media.container(media.padded(b"x" * 20_000)), kind, body))
    assert d["error"] or d["samples"] is not None
    if kind in (b"stsz", b"stsc"):
        assert d["error"]


def test_compact_sizes():
    import struct

    for bits, sizes in ((4, [1, 15, 7]), (8, [200, 3, 9]), (16, [500, 1, 2])):
        raw = bytes([sizes[0] << 4 | sizes[1], sizes[2] << 4]) if bits == 4 else struct.pack(f">3{'B' if bits == 8 else 'H'}", *sizes)
        box = bytes(4) + struct.pack(">II", bits, 3) + raw
        assert media._sizes(box, b"stz2", 0, len(box)).tolist() == sizes


def test_fragments():
    """A movie without samples, and two fragments: one with sizes and flags of its own, one with defaults."""
    import struct

    empty = media._box(b"stbl", media._STSD, media._full(b"stts", bytes(4)), media._full(b"stsc", bytes(4)), media._full(b"stsz", bytes(8)), media._full(b"stco", bytes(4)))
    mdhd = media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0))
    tkhd = media._box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 3, 0, 0), bytes(60))
    trex = media._full(b"trex", struct.pack(">5I", 3, 1, 20, 5, 0x10000))
    movie = media._box(b"moov", media._box(b"trak", tkhd, media._box(b"mdia", mdhd, media._HDLR, media._box(b"minf", empty))), media._box(b"mvex", trex))

    def fragment(trun: bytes, payload: bytes) -> bytes:
        tfhd = media._box(b"tfhd", b"\0\2\0\0", struct.pack(">I", 3))
        size = 8 + 8 + len(tfhd) + len(trun)
        return media._box(b"moof", media._box(b"traf", tfhd, trun.replace(b"OFFS", struct.pack(">i", size + 8)))) + media._box(b"mdat", payload)

    own = media._box(b"trun", b"\0\0\6\1", struct.pack(">I", 2), b"OFFS", struct.pack(">4I", 3, 0, 4, 0x10000))
    plain = media._box(b"trun", b"\0\0\0\5", struct.pack(">I", 2), b"OFFS", struct.pack(">I", 0))
    data = movie + fragment(own, b"abcdefg") + fragment(plain, b"0123456789")
    t = media.tracks(data)[0]
    assert media.stored_bytes(data, t) == b"abcdefg0123456789" and t["sizes"].tolist() == [3, 4, 5, 5] and t["keys"].tolist() == [0, 2] and t["duration"] == 80
    d = media.describe(data)
    assert [data[o : o + n] for o, n in d["keyframes"]] == [b"abc", b"01234"]
    assert media.describe(data[:-3])["error"]


def test_media_query(spark):
    """op5 itself, against what it must store."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = media.op5_media(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        p = media.padded(docs[r.doc_id])
        made = media.container(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(made), hashlib.sha256(made).hexdigest())


def test_media_columns(spark):
    good = media.container(media.padded(b"abc"))
    df = spark.createDataFrame([(1, bytearray(good), "x"), (2, None, "y"), (3, bytearray(b"junk"), "z")], "id long, media binary, error string")
    rows = {r.id: r for r in media.media_columns(df).collect()}
    assert rows[1].codec == "raw " and rows[1].error is None and rows[1].keyframes[0].length == 576
    assert rows[2].codec is None and rows[3].codec is None


def test_media_digests(docs, texts):
    got = {r.doc_id: r for r in media.digests(media.stored(docs)).collect()}
    for doc_id, text in texts:
        p, r = media.padded(text), got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[15].media_sha256 == got[18].media_sha256 and got[15].feature == got[18].feature


def test_media_of_nothing(no_docs):
    assert media.digests(media.stored(no_docs)).count() == 0
