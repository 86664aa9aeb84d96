"""Finding the passages that recur anywhere in a table, and bringing them to the documents that repeat them.

A window is W consecutive units (bytes or words) of one document; a unit is to be removed
if a window covering it also occurs earlier.  A window's seed is the K units inside it with
the least hash (the leftmost on ties), so equal windows have equal seeds.  K units that
very many places hold come after all others: a window at the edge of a common passage then
takes its seed from what is its own, and what shares a popular seed lies inside the passage,
alike everywhere.  Neighbouring windows with one seed make an occurrence: about
2 / (W - K + 2) of them for each unit.

1. `Corpus`: documents are dealt into groups of some megabytes, written once as a bucketed
   table, so that no later stage moves texts.
2. `occurrences`: each group turns its documents into occurrences (seed, fingerprint of the
   units that its windows cover, document, place).  Of equal ones it sends the first.
3. `compared`: a seed's occurrences meet.  Where it recurs, its first occurrence is asked to
   send its passage to every group that holds a later one.  Where surroundings differ, the
   windows that are alike are found first (`confirmed`), from the units (`segments`).
4. `passages`: groups cut out what was asked for; neighbouring passages travel as one.
5. `Corpus.solved`: a group's whole documents meet the passages that came from earlier
   ones.  What is removed is for the solver alone to find: it gets the documents and the
   passages, no ranges.

No stage compares pairs.  Seeds and fingerprints only nominate passages; the solver works
on the units themselves.  A passage that very many groups hold is handed on from group to
group, FAN at a time, so no group sends it to all; and a group of copies costs a seed's
bucket one occurrence for each group, however many copies a group holds.  Groups and seed
buckets follow the bytes of the table, so neither grows with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, flagged, fresh, mix64, popular_hashes, shuffle_partitions, word_hashes

BUCKET_BYTES, TASK_BYTES, SLICE_BYTES, FAN = 4 << 20, 64 << 20, 1 << 19, 256
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(1 << 63)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def spark_hash(ids: np.ndarray) -> np.ndarray:
    """Spark's hash() of longs (Murmur3, seed 42), so that both sides deal documents alike."""
    u = ids.astype(np.int64).view(np.uint64)
    h = np.full(len(u), 42, np.uint32)

    def rotl(x, r):
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    for k in ((u & _LOW).astype(np.uint32), (u >> np.uint64(32)).astype(np.uint32)):
        k = rotl(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotl(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


# --- packed columns -------------------------------------------------------------------
# Whole columns one after another, 64-bit ids and places as separate halves: the high
# halves are zeros nearly always, which the shuffle's compression takes out.  So are most
# versions v, but one doc_id may have any number of rows.

LAYOUT = {"seed": 5, "ctx": 6, "id": 8, "v": 8, "place": 2, "at": 4, "n": 1, "many": 1, "q": 4, "owner": 8, "vid": 4, "off": 4, "key": 5, "cls": 8, "other": 8, "size": 4, "mark": 8, "check": 8}


def _spans(names) -> list[tuple[str, int, int]]:
    """(column, first byte, last) of the parts of a packed row."""
    out = []
    for name in names:
        width = LAYOUT[name]
        half = width // 2 if width in (4, 8) else width
        out += [(name, 0, half), (name, half, width)][: 1 + (half < width)]
    return out


def _parts(columns: dict[str, np.ndarray]) -> list[tuple[int, bytes]]:
    """(bytes a value, all values) of each part of the columns."""
    raw = {k: np.ascontiguousarray(x.astype(np.int64)).view(np.uint8).reshape(len(x), 8) for k, x in columns.items()}
    return [(b - a, raw[name][:, a:b].tobytes()) for name, a, b in _spans(columns)]


def pack(**columns: np.ndarray) -> bytes:
    n = len(next(iter(columns.values())))
    return b"".join([n.to_bytes(8, "little"), *(x for _, x in _parts(columns))])


def unpack(rows: list[bytes], *names: str) -> dict[str, np.ndarray]:
    """The columns of packed rows, one after another; names as they were packed."""
    spans = _spans(names)
    found: list[list[bytes]] = [[] for _ in spans]
    total = 0
    for row in rows:
        n, at = int.from_bytes(row[:8], "little"), 8
        total += n
        for part, (_, a, b) in zip(found, spans, strict=True):
            end = at + n * (b - a)
            part.append(row[at:end])
            at = end
    out = {name: np.zeros((total, 8), np.uint8) for name in names}
    for part, (name, a, b) in zip(found, spans, strict=True):
        out[name][:, a:b] = np.frombuffer(b"".join(part), np.uint8).reshape(total, b - a)
    return {name: x.view(np.int64).ravel() for name, x in out.items()}


def counts(rows: list[bytes]) -> np.ndarray:
    """How many values each packed row has of each column."""
    return np.array([int.from_bytes(row[:8], "little") for row in rows], np.int64)


def dealt(key: np.ndarray, /, **columns: np.ndarray):
    """(key, packed columns) for each distinct key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    parts = _parts({k: x[order] for k, x in columns.items()})
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
        if b > a:
            yield int(key[a]), b"".join([(b - a).to_bytes(8, "little"), *(x[a * w : b * w] for w, x in parts)])


def eight_bytes(raw: bytes, kind: str) -> np.ndarray:
    """The eight bytes from every place on as one number."""
    x = np.empty(len(raw) - 7, np.uint64)
    for i in range(8):
        x[i::8] = np.frombuffer(raw, kind, (len(raw) - i) // 8, i)
    return x


# --- units -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Units:
    """What windows are made of: "bytes" or "words"; W units a window, K a seed.

    strict: only smaller doc_ids are earlier, not earlier places in the same document.
    """

    kind: str
    window: int
    seed: int
    strict: bool

    def pieces(self, text: bytes):
        """(first unit, units) of parts that overlap by W - 1, so that no part is large."""
        units = np.frombuffer(text, np.uint8) if self.kind == "bytes" else word_hashes(text.split())
        step = SLICE_BYTES if self.kind == "bytes" else SLICE_BYTES // 4
        for first in range(0, max(len(units) - self.window + 1, 0), step):
            yield first, units[first : first + step + self.window - 1]

    def cut(self, text: bytes, starts: list[int], counts: list[int]) -> list[bytes]:
        """The units from each start on."""
        if self.kind == "bytes":
            return [text[a : a + n] for a, n in zip(starts, counts, strict=True)]
        words = text.split()
        return [b" ".join(words[a : a + n]) for a, n in zip(starts, counts, strict=True)]

    def window_hashes(self, parts: list[bytes], windows: np.ndarray) -> np.ndarray:
        """A hash of every window of every part in turn; windows: how many each has."""
        w = self.window
        if self.kind == "bytes":
            x, steps = eight_bytes(b"".join([*parts, bytes(8)]), "<u8"), (*range(0, w - 7, 8), w - 8)
        else:
            x, steps = word_hashes(b" ".join(parts).split(b" ")), range(w)
        first = np.cumsum(windows + w - 1) - windows - w + 1
        at = np.arange(windows.sum()) + np.repeat(first - (np.cumsum(windows) - windows), windows)
        h = np.zeros(len(at), np.uint64)
        for i in steps:
            h = mix64(h ^ x[at + i]) * _A
        return h

    def _flat(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, units or 8-byte words at every place, hash of the K units from every place)."""
        k = self.seed
        gap = 96 if self.kind == "bytes" else 2 * self.window
        lengths = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + gap)))
        flat = np.zeros(starts[-1] + gap, np.uint8 if self.kind == "bytes" else np.uint64)
        for p, a in zip(parts, starts, strict=False):
            flat[a : a + len(p)] = p
        if self.kind == "bytes":
            x = eight_bytes(flat.tobytes(), "<u8")
            h = x[: len(x) - k + 8] * _A
            for at, m in zip(range(8, k, 8), (_B, _C, _A), strict=False):
                h ^= h >> np.uint64(32)
                h += x[at : len(x) - k + 8 + at] * m
        else:
            x = flat
            h = np.zeros(len(flat) - k + 1, np.uint64)
            for at in range(k):
                h *= _A
                h += x[at : at + len(h)]
        return starts, lengths, x, mix64(h)

    def hashes(self, texts: list[bytes]) -> np.ndarray:
        """The hashes of every K units in a row that are likely seeds: the lower half of them, made to fill the range."""
        parts = [p for t in texts for _, p in self.pieces(t)]
        starts, lengths, _, h = self._flat(parts)
        inside = np.zeros(len(h), bool)
        for a, n in zip(starts.tolist(), lengths.tolist(), strict=False):
            inside[a : a + n - self.seed + 1] = True
        return h[inside & (h < _HALF)] << np.uint64(1)

    def seeds(self, parts: list[np.ndarray], flags: np.ndarray) -> tuple[np.ndarray, ...]:
        """(part, first window, number of windows, seed, fingerprint) of every occurrence."""
        w, k = self.window, self.seed
        starts, lengths, x, h = self._flat(parts)
        least = ((h >> np.uint64(1)) & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        likely = np.flatnonzero(h < _HALF)
        popular = likely[flagged(flags, h[likely] << np.uint64(1))]
        least[popular] |= np.uint64(1 << 63)
        span, done = w - k + 1, 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        windows = np.maximum(lengths - w + 1, 0)
        part = np.repeat(np.arange(len(parts)), windows)
        at = np.arange(windows.sum()) + np.repeat(starts[:-1] - (np.cumsum(windows) - windows), windows)
        chosen = (least[at] & _LOW).astype(np.int64)
        run = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1]))) if len(chosen) else np.zeros(0, np.int64)
        count = np.diff(np.append(run, len(chosen)))
        first, seed, part = at[run], h[chosen[run]], part[run]
        units = count + w - 1
        ctx = units.astype(np.uint64) * _B
        if self.kind == "bytes":
            for i in range(0, 2 * w - k, 8):
                ctx ^= x[first + i] & _MASKS[np.clip(units - i, 0, 8)]
                ctx *= _A
                ctx ^= ctx >> np.uint64(31)
        else:
            for i in range(2 * w - k):
                ctx ^= np.where(i < units, x[first + i], np.uint64(0))
                ctx *= _A
                ctx ^= ctx >> np.uint64(31)
        return part, first - starts[part], count, seed, mix64(ctx)


# --- stages ------------------------------------------------------------------------------


def first_of(*sorted_columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _place(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where its group starts, place in it) of each row; new marks the groups' first rows."""
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
    return start, np.arange(len(new)) - start


def _rows(out: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in out], schema.field(i).type) for i in range(len(schema))], schema=schema)


def popular_seeds(docs: DataFrame, units: Units, rows: int) -> np.ndarray:
    bits = min(24, max(20 if units.kind == "words" else 22, rows.bit_length() + 2))
    return popular_hashes(docs.select(F.col("text").cast("binary")), units.hashes, bits)


def _documents(t: pa.Table, id_name: str, v_name: str, text_name: str):
    """(ids, v, texts) of a group's documents that have an id, in their order, each once."""
    ids, v = t.column(id_name), t.column(v_name).to_numpy()
    some = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
    ids = ids.fill_null(0).to_numpy()[some]
    order = np.lexsort((v[some], ids))
    ids, v, some = ids[order], v[some][order], some[order]
    keep = first_of(ids, v)
    texts = t.column(text_name).take(pa.array(some[keep])).to_pylist()
    return ids[keep], v[keep], [x or b"" for x in texts]


OCCURRENCES = "key int, packed binary"


def _occurrences(units: Units, n: int, shared):
    schema = pa.schema([("key", pa.int32()), ("packed", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        flags = shared.value
        q = t.column("q")[0].as_py()
        ids, v, texts = _documents(t, "doc_id", "v", "text")
        found, waiting, held = [], [], 0

        def flush():
            nonlocal waiting, held
            if waiting:
                part, at, count, seed, ctx = units.seeds([w[2] for w in waiting], flags)
                doc, base = np.array([w[0] for w in waiting]), np.array([w[1] for w in waiting])
                found.append((doc[part], at + base[part], count, seed, ctx))
            waiting, held = [], 0

        for d, text in enumerate(texts):
            for base, part in units.pieces(text):
                waiting.append((d, base, part))
                held += len(part) * (1 if units.kind == "bytes" else 8)
                if held >= SLICE_BYTES:
                    flush()
        flush()
        if not found:
            return _rows([], schema)
        doc, at, count, seed, ctx = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(seed ^ (ctx * _B), kind="stable")
        doc, at, count, seed, ctx = (x[order] for x in (doc, at, count, seed, ctx))
        new = first_of(seed, ctx)
        heads = np.flatnonzero(new)
        again = doc != doc[_place(new)[0]] if units.strict else ~new
        many = np.logical_or.reduceat(again, heads)
        doc, at, count, seed, ctx = (x[heads] for x in (doc, at, count, seed, ctx))
        bucket = ((seed >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
        return _rows(list(dealt(bucket, seed=seed, ctx=ctx, id=ids[doc], v=v[doc], at=at, n=count, many=many, q=np.full(len(at), q))), schema)

    return run


CUT, ASK, MEMBERS = 0, 1, 2
REPLIES = "key int, kind int, bucket int, packed binary"
_REPLIES = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])


def _parents(start: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Who hands a group's passage on to each member: a tree of FAN branches, its root the first member."""
    return start + np.maximum(place - 1, 0) // FAN


def _compared(units: Units):
    """A bucket's occurrences -> what is cut for whom; where a seed's surroundings differ, what is looked at more closely."""

    def meet(t: pa.Table) -> pa.Table:
        key = t.column("key")[0].as_py()
        c = unpack(t.column("packed").to_pylist(), "seed", "ctx", "id", "v", "at", "n", "many", "q")
        order = np.argsort(c["seed"], kind="stable")
        seed = c["seed"][order]
        new = first_of(seed)
        again = ~new | (c["many"][order] > 0)
        again[:-1] |= ~new[1:]
        c = {k: x[order[again]] for k, x in c.items()}
        order = np.lexsort([c[k] for k in ("at", "v", "id", "ctx", "seed") if k != "v" or c["v"].any()])
        c = {k: x[order] for k, x in c.items()}
        by_seed, by_ctx = first_of(c["seed"]), first_of(c["seed"], c["ctx"])
        start, place = _place(by_ctx)
        out = []
        # copies of one occurrence; a group with copies of its own first needs the passage too
        src = _parents(start, place)
        takes = c["q"][src] != c["q"] if units.strict else (place > 0) | (c["many"] > 0)
        src, to = src[takes], c["q"][takes]
        out += [(k, CUT, None, p) for k, p in dealt(c["q"][src], id=c["id"][src], v=c["v"][src], at=c["at"][src], n=c["n"][src], owner=c["id"][start[takes]], q=to)]
        # seeds with several surroundings
        heads = np.flatnonzero(by_seed)
        several = np.zeros(len(by_seed), bool)
        if len(heads):
            more = np.add.reduceat(by_ctx, heads) > 1
            if units.strict:  # what one group holds, its solver finds
                more &= np.maximum.reduceat(c["q"], heads) > np.minimum.reduceat(c["q"], heads)
            several = np.repeat(more, np.diff(np.append(heads, len(by_seed))))
        if several.any():
            vid = np.cumsum(by_ctx) - 1
            ask = several & by_ctx
            out += [(k, ASK, key, p) for k, p in dealt(c["q"][ask], id=c["id"][ask], v=c["v"][ask], at=c["at"][ask], n=c["n"][ask], vid=vid[ask])]
            out.append((key, MEMBERS, None, pack(vid=vid[several], id=c["id"][several], v=c["v"][several], at=c["at"][several], q=c["q"][several])))
        return _rows(out, _REPLIES)

    return meet


def _segments(units: Units, names: tuple[str, str, str]):
    """A group's documents and what buckets ask of them -> (bucket, packed, units)."""
    schema = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("units", pa.list_(pa.binary()))])

    def cut(d: pa.Table, w: pa.Table) -> pa.Table:
        if not len(w) or not len(d):
            return _rows([], schema)
        ids, v, texts = _documents(d, *names)
        place = {key: i for i, key in enumerate(zip(ids.tolist(), v.tolist(), strict=True))}
        packed = w.column("packed").to_pylist()
        c = unpack(packed, "id", "v", "at", "n", "vid")
        bucket = np.repeat(w.column("bucket").to_numpy(), counts(packed))
        doc = np.array([place[key] for key in zip(c["id"].tolist(), c["v"].tolist(), strict=True)], np.int64)
        order = np.argsort(doc, kind="stable")
        heads = np.flatnonzero(first_of(doc[order]))
        at, n, parts = c["at"][order].tolist(), (c["n"][order] + units.window - 1).tolist(), []
        for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            parts += units.cut(texts[int(doc[order[x]])], at[x:y], n[x:y])
        by_bucket = np.argsort(bucket[order], kind="stable")
        parts, out, upto = [parts[i] for i in by_bucket], [], 0
        for key, row in dealt(bucket[order], **{k: x[order] for k, x in c.items()}):
            size = int.from_bytes(row[:8], "little")
            out.append((key, row, parts[upto : upto + size]))
            upto += size
        return _rows(out, schema)

    return cut


def _confirmed(units: Units):
    """A bucket's segments and their members -> CUT rows of the windows that occur earlier in another surrounding."""

    def run(t: pa.Table, m: pa.Table) -> pa.Table:
        if not len(t) or not len(m):
            return _rows([], _REPLIES)
        c = unpack(t.column("packed").to_pylist(), "id", "v", "at", "n", "vid")
        data = t.column("units").combine_chunks().flatten().to_pylist()
        order = np.lexsort((c["at"], c["v"], c["id"]))
        c = {k: x[order] for k, x in c.items()}
        h = units.window_hashes([data[i] for i in order], c["n"])
        part = np.repeat(np.arange(len(order)), c["n"])
        base = np.cumsum(c["n"]) - c["n"]
        by_hash = np.argsort(h, kind="stable")
        start, _ = _place(first_of(h[by_hash]))
        first = np.empty(len(h), np.int64)
        first[by_hash] = by_hash[start]
        owner = part[first]
        hit = c["id"][owner] < c["id"][part] if units.strict else first != np.arange(len(h))
        if not hit.any():
            return _rows([], _REPLIES)
        edge = hit.copy()
        edge[1:] &= ~(hit[:-1] & (part[1:] == part[:-1]) & (first[1:] == first[:-1] + 1) & (owner[1:] == owner[:-1]))
        runs = np.flatnonzero(edge)
        size = np.bincount(np.cumsum(edge)[hit] - 1, minlength=len(runs))
        # members by variant, the first of each the one that sent its units
        g = unpack(m.column("packed").to_pylist(), "vid", "id", "v", "at", "q")
        order = np.lexsort((g["at"], g["v"], g["id"], g["vid"]))
        g = {k: x[order] for k, x in g.items()}
        heads = np.flatnonzero(first_of(g["vid"]))
        count = np.diff(np.append(heads, len(order)))
        slot = np.searchsorted(g["vid"][heads], c["vid"])  # of each part
        mine, theirs = heads[slot[part[runs]]], heads[slot[owner[runs]]]
        times = count[slot[part[runs]]]
        run_of = np.repeat(np.arange(len(runs)), times)
        place = np.arange(len(run_of)) - np.repeat(np.cumsum(times) - times, times)
        root = place == 0
        src = np.where(root, theirs[run_of], _parents(mine[run_of], place))
        off = np.where(root, first[runs][run_of] - base[owner[runs]][run_of], (runs - base[part[runs]])[run_of])
        to, own = g["q"][mine[run_of] + place], g["id"][theirs][run_of]
        takes = g["q"][src] != to if units.strict else np.ones(len(to), bool)
        src, off, size, to, own = src[takes], off[takes], size[run_of][takes], to[takes], own[takes]
        return _rows([(k, CUT, None, p) for k, p in dealt(g["q"][src], id=g["id"][src], v=g["v"][src], at=g["at"][src] + off, n=size, owner=own, q=to)], _REPLIES)

    return run


PASSAGES = "key int, packed binary, phrases binary, units array<binary>"


def _passages(units: Units, names: tuple[str, str, str]):
    """A group's documents and what is to be cut from them -> for each group: owners, phrases and units of passages."""
    schema = pa.schema([("key", pa.int32()), ("packed", pa.binary()), ("phrases", pa.binary()), ("units", pa.list_(pa.binary()))])

    def cut(d: pa.Table, w: pa.Table) -> pa.Table:
        if not len(w) or not len(d):
            return _rows([], schema)
        ids, v, texts = _documents(d, *names)
        place = {key: i for i, key in enumerate(zip(ids.tolist(), v.tolist(), strict=True))}
        c = unpack(w.column("packed").to_pylist(), "id", "v", "at", "n", "owner", "q")
        c["n"] = c["n"] + units.window - 1
        order = np.lexsort((c["n"], c["at"], c["v"], c["id"], c["owner"], c["q"]))
        c = {k: x[order] for k, x in c.items()}
        keep = first_of(*(c[k] for k in ("q", "owner", "id", "v", "at", "n")))
        c = {k: x[keep] for k, x in c.items()}
        # neighbours of one document for one group are one passage
        same = first_of(c["q"], c["owner"], c["id"], c["v"])
        stop = c["at"] + c["n"]
        block = np.cumsum(same) - 1
        reach = np.maximum.accumulate(stop + block * (1 << 40)) - block * (1 << 40)  # so far, in its document
        new = same.copy()
        new[1:] |= c["at"][1:] > reach[:-1]
        heads = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        ends = np.maximum.reduceat(stop, heads)
        split: dict[int, list] = {}
        out, target = [], c["q"][heads]
        cuts = np.flatnonzero(first_of(target))
        for a, b in zip(cuts, np.append(cuts, len(heads))[1:], strict=True):
            rows = slice(heads[a], heads[b] if b < len(heads) else len(which))
            parts = []
            for j in range(a, b):
                i = place[int(c["id"][heads[j]]), int(c["v"][heads[j]])]
                x, y = int(c["at"][heads[j]]), int(ends[j])
                if units.kind == "bytes":
                    parts.append(texts[i][x:y])
                else:
                    if i not in split:
                        split[i] = texts[i].split()
                    parts.append(b" ".join(split[i][x:y]))
            of = which[rows]
            phrases = pack(vid=of - a, off=c["at"][rows] - c["at"][heads[of]], size=c["n"][rows]) if units.kind == "words" else None
            out.append((int(target[a]), pack(owner=c["owner"][heads[a:b]]), phrases, parts))
        return _rows(out, schema)

    return cut


#: ids and texts of a group's documents, and the passages' (owner, text, its phrases as (offset, words)) -> for
#: each document None or the (start, stop) arrays of what is covered.  Bytes have no phrases.
Solver = Callable[[np.ndarray, list[bytes], list[tuple]], list]


def _received(p: pa.Table) -> list[tuple]:
    packed, phrases = p.column("packed").to_pylist(), p.column("phrases").to_pylist()
    owner, parts = unpack(packed, "owner")["owner"].tolist(), [x for row in p.column("units").to_pylist() for x in row]
    per: list[list] = [[] for _ in parts]
    if phrases and phrases[0] is not None:
        c, n = unpack(phrases, "vid", "off", "size"), counts(packed)
        which = c["vid"] + np.repeat(np.cumsum(n) - n, counts(phrases))
        for i, off, size in zip(which.tolist(), c["off"].tolist(), c["size"].tolist(), strict=True):
            per[i].append((off, size))
    return list(zip(owner, parts, per, strict=True))


class Corpus:
    """docs in groups of about group_bytes, as a table bucketed by group: stages meet them without moving texts.

    Rows that repeat a doc_id are told apart by a hash of their text; they are one
    document's versions, none earlier than another, and equal rows are one.  Rows without
    doc_id are never earlier than anything and keep all they have.
    """

    def __init__(self, docs: DataFrame, label: str, group_bytes: int):
        self.spark, self.stash = docs.sparkSession, Stash(docs.sparkSession, label)
        self.columns = docs.columns
        size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        self.rows, least = size[0], max(16, shuffle_partitions(self.spark))
        self.groups, self.buckets, self.tasks = (max(least, -(-(size[1] or 0) // x)) for x in (group_bytes, BUCKET_BYTES, TASK_BYTES))
        self.id, self.v, self.q, self.text = (fresh(docs, x) for x in ("id", "v", "q", "bytes"))
        repeats = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        out = docs.withColumn(self.id, F.col("doc_id").cast("long")).withColumn(self.v, F.xxhash64("text") if repeats else F.lit(0).cast("long"))
        spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text"), F.monotonically_increasing_id())).otherwise(F.xxhash64(self.id, self.v))
        out = out.withColumn(self.q, F.pmod(spread, F.lit(self.groups)).cast("int"))
        name = f"papyra_{uuid.uuid4().hex}"
        out.repartition(self.tasks, self.q).write.bucketBy(self.tasks, self.q).sortBy(self.q).format("parquet").option("compression", "snappy").option("path", f"{self.stash.root}/documents").saveAsTable(name)
        self.stash.release()
        self.table = self.spark.table(name)

    def slim(self) -> DataFrame:
        """q, doc_id, v and text of the documents that have an id."""
        return self.table.where("doc_id IS NOT NULL").select(F.col(self.q).alias("q"), F.col(self.id).alias("doc_id"), F.col(self.v).alias("v"), F.col("text").cast("binary").alias("text"))

    def meeting(self, left: DataFrame, right: DataFrame, columns: list[str], key: str = "key"):
        """left by group with right by key, which alone is moved."""
        return left.groupBy("q").cogroup(right.select(key, *columns).repartition(self.tasks, key).groupBy(key))

    def solved(self, units: Units, solve: Solver, finish, schema: str) -> DataFrame:
        """Runs the stages; finish(rows, None or covered ranges of each) makes the result.

        rows: an Arrow table of the columns of docs, text as bytes.
        """
        stash, slim, n, names = self.stash, self.slim(), self.buckets, ("doc_id", "v", "text")
        flags = self.spark.sparkContext.broadcast(popular_seeds(slim, units, self.rows))
        stash.release()
        found = slim.groupBy("q").applyInArrow(_occurrences(units, n, flags), OCCURRENCES)
        replies = stash.put(found.repartition(self.tasks, "key").groupBy("key").applyInArrow(_compared(units), REPLIES), "compared")
        stash.release()
        parts = self.meeting(slim, replies.where(F.col("kind") == ASK), ["bucket", "packed"]).applyInArrow(_segments(units, names), "bucket int, packed binary, units array<binary>")
        members = replies.where(F.col("kind") == MEMBERS).select("key", "packed")
        more = parts.repartition(self.tasks, "bucket").groupBy("bucket").cogroup(members.repartition(self.tasks, "key").groupBy("key")).applyInArrow(_confirmed(units), REPLIES)
        more = stash.put(more, "confirmed")
        stash.release()
        cuts = replies.where(F.col("kind") == CUT).unionByName(more)
        sent = stash.put(self.meeting(slim, cuts, ["packed"]).applyInArrow(_passages(units, names), PASSAGES), "passages")
        stash.release()
        id_name, v_name, columns = self.id, self.v, self.columns

        def end(d: pa.Table, p: pa.Table) -> pa.Table:
            ids, v, texts = _documents(d, id_name, v_name, "text")
            place = {key: i for i, key in enumerate(zip(ids.tolist(), v.tolist(), strict=True))}
            found = solve(ids, texts, _received(p))
            rows = [None if i is None else found[place[i, w]] for i, w in zip(d.column(id_name).to_pylist(), d.column(v_name).to_pylist(), strict=True)]
            return finish(d.select(columns), rows)

        left = self.table.select(F.col(self.q).alias(self.q), self.id, self.v, *[F.col(c).cast("binary").alias(c) if c == "text" else F.col(c) for c in columns])
        return left.groupBy(self.q).cogroup(sent.repartition(self.tasks, "key").groupBy("key")).applyInArrow(end, schema)


def mask(length: int, ranges) -> np.ndarray:
    """Which of a document's units the ranges cover."""
    steps = np.zeros(length + 1, np.int32)
    np.add.at(steps, ranges[0], 1)
    np.add.at(steps, ranges[1], -1)
    return np.cumsum(steps[:-1]) > 0
