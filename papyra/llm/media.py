"""Media columns: ISO base media containers (MP4, MOV) described by their boxes.

The reader walks nested boxes, decodes the sample tables (stts, stsc, stsz or stz2,
stco/co64, stss) and the runs of movie fragments (moof, traf, tfhd, trun, with the defaults
of trex), and gives codec, timescale, duration, sample count and the byte ranges of the
keyframes.  Samples are never decoded: all comes from the tables, and the stored bytes are
only cut out by them.  Counts are held against the bytes there are before anything is made
of them, so a torn or hostile file is an error and costs no more than its size.  The writer
makes such a container around 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_lengths, slices, table

FRAME, RATE = 576, 8000
CHUNK_FRAMES, KEY_EVERY = 16, 8
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: Samples of one size, which need no table, that are told of one file.
MOST_SAMPLES = 1 << 26


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"qt  ", bytes(4), b"qt  ")
_HDLR = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
_SMHD = _full(b"smhd", bytes(4))
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1")))
#: 'raw ' is unsigned 8-bit linear sound, one channel.
_STSD = _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))


def padded(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of the frame."""
    return data + b"\xff" * (-len(data) % FRAME or (FRAME if not data else 0))


def container(payload: bytes) -> bytes:
    """A one-track container around frames of 576 8-bit samples; the length must fit them."""
    frames = len(payload) // FRAME
    ticks = frames * FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] if chunks > 1 else []
    if not runs or last != CHUNK_FRAMES:
        runs.append((chunks, last, 1))
    stsc = _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs))
    stts = _full(b"stts", struct.pack(">III", 1, frames, FRAME))
    stsz = _full(b"stsz", struct.pack(">II", FRAME, frames))
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    stss = _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes())
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, ticks, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
    tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
    mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks, 0x55C4, 0))

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        places = (first + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * FRAME).astype(">u8" if wide else ">u4")
        stco = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.tobytes())
        stbl = _box(b"stbl", _STSD, stts, stsc, stsz, stss, stco)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, _HDLR, _box(b"minf", _SMHD, _DINF, stbl))))

    wide = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(_FTYP) + len(moov(0)) + len(head)
    return b"".join((_FTYP, moov(first), head, payload))


def boxes(data, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, body start, body end) of every box, containers before what they hold."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("torn 64-bit box")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} leaves its container")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from boxes(data, body, stop, (*path, kind))
        start = stop


def _table(data, body: int, stop: int, width: int, kind: str = ">u4") -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, body + 4)
    if body + 8 + n * width * np.dtype(kind).itemsize > stop:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n * width, body + 8).astype(np.int64).reshape(n, width)


def _sizes(data, kind: bytes, body: int, stop: int) -> np.ndarray:
    """The samples' sizes: one for all, or a table of 32, 16, 8 or 4 bits each."""
    size, n = struct.unpack_from(">II", data, body + 4)
    if kind == b"stsz" and size:
        if n > min(MOST_SAMPLES, len(data) // size):
            raise ValueError("more samples than the file holds")
        return np.full(n, size, np.int64)
    bits = 32 if kind == b"stsz" else size & 0xFF
    if bits not in (4, 8, 16, 32) or body + 12 + -(-n * bits // 8) > stop:
        raise ValueError("a table of sizes is longer than its box")
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, -(-n // 2), body + 12)
        return np.stack((pairs >> 4, pairs & 15), axis=1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n, body + 12).astype(np.int64)


def _fields(data, body: int, names: list[tuple[int, str, str]]) -> tuple[dict, int]:
    """The optional fields that a full box's flags announce, in order, and where they end."""
    flags = int.from_bytes(data[body + 1 : body + 4], "big")
    out, at = {"flags": flags}, body + 4
    for bit, name, kind in names:
        if not bit or flags & bit:
            (out[name],) = struct.unpack_from(f">{kind}", data, at)
            at += struct.calcsize(f">{kind}")
    return out, at


_TFHD = [(0, "id", "I"), (0x1, "base", "Q"), (0x2, "description", "I"), (0x8, "duration", "I"), (0x10, "size", "I"), (0x20, "sample_flags", "I")]
_TRUN = [(0, "count", "I"), (0x1, "offset", "i"), (0x4, "first_flags", "I")]
NOT_A_KEY = 0x10000


def _run(data, body: int, stop: int, head: dict, moof: int, follow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(offsets, sizes, is a keyframe, duration) of a fragment's run; follow: where the run before it ended."""
    f, at = _fields(data, body, _TRUN)
    n, own = f["count"], [bit for bit in (0x100, 0x200, 0x400, 0x800) if f["flags"] & bit]
    if at + 4 * n * len(own) > stop or n > max(len(data), 1):
        raise ValueError("a run is longer than its box")
    rows = dict(zip(own, np.frombuffer(data, ">u4", n * len(own), at).astype(np.int64).reshape(n, len(own)).T, strict=True)) if own else {}
    sizes = rows.get(0x200, np.full(n, head.get("size", 0), np.int64))
    flags = rows.get(0x400, np.full(n, head.get("sample_flags", 0), np.int64)).copy()
    if n and "first_flags" in f:
        flags[0] = f["first_flags"]
    base = head.get("base", moof if head["flags"] & 0x20000 or "offset" in f else follow)
    start = base + f["offset"] if "offset" in f else follow
    ticks = int(rows[0x100].sum()) if 0x100 in rows else n * head.get("duration", 0)
    return start + np.cumsum(sizes) - sizes, sizes, flags & NOT_A_KEY == 0, ticks


def _in_chunks(t: dict) -> None:
    """The offsets of samples that lie in chunks."""
    sizes, chunks, runs = t["sizes"], t.get("chunks", np.zeros(0, np.int64)), t.get("stsc", np.zeros((0, 3), np.int64))
    reach = np.append(runs[1:, 0], len(chunks) + 1) - runs[:, 0] if len(runs) else np.zeros(0, np.int64)
    if (reach < 0).any() or reach.sum() != len(chunks) or (reach * runs[:, 1]).sum() != len(sizes):
        raise ValueError("sample tables disagree")
    per_chunk = np.repeat(runs[:, 1], reach)
    ends = np.cumsum(sizes)
    before = np.concatenate(([0], ends))[np.cumsum(per_chunk) - per_chunk]
    t["offsets"] = np.repeat(chunks - before, per_chunk) + ends - sizes


def tracks(data: bytes) -> list[dict]:
    """Each track's codec, timescale, duration and sample offsets, sizes and keyframes, fragments included."""
    found: list[dict] = []
    defaults: dict[int, dict] = {}
    runs: list[tuple] = []
    moof, head, follow = 0, None, 0
    for path, body, stop in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif kind == b"moof":
            moof, follow = body - 8, body - 8
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", data, body + 4)
            defaults[track] = {"duration": duration, "size": size, "sample_flags": flags}
        elif kind == b"tfhd":
            own, _ = _fields(data, body, _TFHD)
            head = defaults.get(own["id"], {}) | own
        elif kind == b"trun" and head is not None:
            runs.append((head["id"], *_run(data, body, stop, head, moof, follow)))
            follow = int(runs[-1][1][-1] + runs[-1][2][-1]) if len(runs[-1][1]) else follow
        if not found or b"trak" not in path:
            continue
        t = found[-1]
        if kind == b"tkhd":
            (t["id"],) = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, body + 20) if data[body] == 1 else struct.unpack_from(">II", data, body + 12)
        elif kind == b"stsd":
            t["codec"] = bytes(data[body + 12 : body + 16]).decode("latin-1")
        elif kind == b"stts":
            t["stts"] = _table(data, body, stop, 2)
        elif kind == b"stsc":
            t["stsc"] = _table(data, body, stop, 3)
        elif kind in (b"stsz", b"stz2"):
            t["sizes"] = _sizes(data, kind, body, stop)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(data, body, stop, 1, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stss":
            t["keys"] = _table(data, body, stop, 1)[:, 0] - 1
    for t in found:
        _in_chunks(t)
        t.setdefault("keys", np.arange(len(t["sizes"])))
        ticks = 0
        for track, offsets, sizes, key, lasts in runs:
            if track == t.get("id"):
                t["keys"] = np.concatenate((t["keys"], len(t["sizes"]) + np.flatnonzero(key)))
                t["offsets"], t["sizes"] = np.concatenate((t["offsets"], offsets)), np.concatenate((t["sizes"], sizes))
                ticks += lasts
        t["duration"] = t["duration"] or ticks
        sizes = t["sizes"]
        if len(sizes) and (t["offsets"].min() < 0 or (t["offsets"] + sizes).max() > len(data)):
            raise ValueError("a sample lies outside the file")
        if len(t["keys"]) and (t["keys"].min() < 0 or t["keys"].max() >= len(sizes)):
            raise ValueError("a keyframe that is no sample")
    return found


def stored_bytes(data: bytes, t: dict) -> bytes:
    """The samples of a track in order; neighbours are read as one run."""
    offsets, sizes = t["offsets"], t["sizes"]
    if not len(sizes):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, stops = np.concatenate(([0], breaks)), np.append(breaks, len(sizes)) - 1
    return b"".join(data[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(starts, stops, strict=True))


def describe(data: bytes | None) -> dict:
    """The features of the first track; a null, torn or trackless file has an error and nulls."""
    try:
        t = tracks(data or b"")[0]
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return {"codec": None, "timescale": None, "duration": None, "samples": None, "keyframes": None, "error": str(e) or type(e).__name__}
    keys = t["keys"]
    ranges = list(zip(t["offsets"][keys].tolist(), t["sizes"][keys].tolist(), strict=True))
    return {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["sizes"]), "keyframes": ranges, "error": None}


def media_columns(files: DataFrame, media: str = "media") -> DataFrame:
    """Every other column of files, and codec, timescale, duration, samples, keyframes, error.

    keyframes: array of (offset, length).  Columns of these names are replaced.  A null, torn
    or hostile file has an error and nulls; an empty table gives none.
    """
    names = ("codec", "timescale", "duration", "samples", "keyframes", "error")
    kept = [c for c in files.columns if c != media and c not in names]
    frame = files.select(*kept, files[media].cast("binary").alias(media))
    key = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
    kinds = dict(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(key), pa.string()), strict=True))

    def read(batches):
        for batch in batches:
            rows = [describe(x) for x in batch.column(len(kept)).to_pylist()]
            for r in rows:
                if r["keyframes"] is not None:
                    r["keyframes"] = [{"offset": a, "length": b} for a, b in r["keyframes"]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([r[n] for r in rows], kinds[n]) for n in names)], [*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != media), "codec string, timescale long, duration long, samples long, keyframes array<struct<offset:bigint,length:bigint>>, error string"])
    return frame.mapInArrow(read, schema)


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, media): each text, whole and padded, in a container; equal texts have equal ones.

    A null text is empty; repeated rows are stored each; other columns are left out.
    """

    def write(batches):
        for batch in batches:
            ids, texts = batch.columns
            for a, b in slices(byte_lengths(texts)):
                data = [x or b"" for x in texts[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array([len(x) for x in data], pa.int64()), pa.array([container(padded(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> what is read back from each container, as op5 states it.

    feature: codec, timescale, duration, sample count, keyframe count and byte ranges.
    """

    def read(batches):
        for batch in batches:
            out = []
            for doc_id, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = tracks(media)[0]
                payload = stored_bytes(media, t)
                keys = t["keys"]
                ranges = ",".join(f"{o}+{s}" for o, s in zip(t["offsets"][keys].tolist(), t["sizes"][keys].tolist(), strict=True))
                feature = f"{t['codec'].strip()} {t['timescale']} {t['duration']} {len(t['sizes'])} {len(keys)} {ranges}"
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a container, read back.  A null or empty text is one frame of 255s."""
    return digests(stored(table(spark, sf_dir, "documents")))
