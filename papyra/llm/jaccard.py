"""N-gram Jaccard join: every pair of documents whose word n-grams overlap enough, as components.

Documents of one shingle set are one class; links are sought between classes.  A class is
known by a 64-bit hash of its set; a second one tells whether two sets have the same, and
then all is hashed anew.

1. Size bands and the pigeonhole give candidates without loss.  Sets that link differ in
   at most H shingles, H by size band; a band splits the range of shingle hashes into
   H + 1 + e parts, so linked sets agree wholly in 1 + e parts at least.  A set emits a
   key for each non-empty part, in its own band and the one below (see Bands.keys for sets
   with more than e empty parts).  Shingles that very many documents hold are left out of
   the parts, lest one common passage make candidates of all that quote it.  A task links
   equal keys among its own rows to the least class and sends each key once, so a key
   that very many sets share stays small.
2. Where few classes share a key, each two of them are a pair of their own, which counts
   only where their sketches, some bytes a set, allow a link.  Shingles are then read for
   those classes alone that a pair or a larger key leaves together: chance meetings grow
   with the square of the table, and would soon bring in every document.
3. Candidates' components are cut into tiles of similar sizes.  In a tile, hashed bitmap
   signatures bound each overlap from above by bit counts; what passes is settled by
   intersecting the sorted shingle arrays.  A pair already joined through others is
   skipped, so a group of copies costs about one intersection a member.
4. Candidate components too large for a tile are parted by keys of two parts, which sets
   seldom share by chance; of what is then too large still, blocks are settled, then the
   blocks' leaders, then what is not in the largest component is compared with all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, buckets, byte_lengths, flagged, fresh, mix64, popular_hashes, slices, table, word_hashes
from .components import components
from .passages import dealt, first_of, pack, spark_hash, unpack

TILE, BUCKET_BYTES = 800, 16 << 20
#: Tiles in which what is apart meets all others are so many times larger: each is read once for each of the other side's.
CROSS = 2
#: Classes of a key that are compared two by two by their sketches; a key of more is a star around the least.
FEW = 8
#: In sets that may differ in fewer shingles a key of the second kind is one part.
FINER = 8
_C = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; lower case for A-Z only."""
    tokens = (text or b"").lower().split()
    h = word_hashes(tokens)
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out *= _C
        out += h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


class Bands:
    """Size bands for links of num / den: sizes of linked sets lie in one band or in two neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        self.parts: list[tuple[int, int]] = []

    def _grow(self, size: int) -> None:
        while self.edges[-1] <= size:
            low = self.edges[-1]
            high = max(low + 1, -(-low * self.den // self.num))
            most = (high - 1) * (self.den - self.num) // self.num
            spare = 0
            while most and spare < 64:
                k = most + 1 + spare
                rate = k * math.exp(-low / k)
                if 1 - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(spare + 1)) < 1e-4:
                    break
                spare += 1
            spare = max(spare, most * 3 // 10)  # room for parts whose shingles are all popular
            self.edges.append(high)
            self.parts.append((most, spare))

    def of(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def _parts(self, s: np.ndarray, band: int, salt: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(key of every part of a set's hash range, whether the part holds any)."""
        k = k or sum(self.parts[band]) + 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(s.copy()))))
        cuts = np.searchsorted(s, (np.arange(1, k, dtype=np.float64) * (2.0**64 / k)).astype(np.uint64))
        at = np.concatenate(([0], cuts, [len(s)]))
        value = (sums[at[1:]] - sums[at[:-1]]) ^ (np.arange(k, dtype=np.uint64) * _C + np.uint64((band << 40) + salt))
        return mix64(value), at[1:] > at[:-1]

    def keys(self, s: np.ndarray, popular: np.ndarray | None = None) -> np.ndarray:
        """The keys of a set; none where only equal sets can link.

        popular tells which shingles to leave out of the parts.  They differ no more
        without these, so 1 + e parts still agree; a set with more than e parts empty then
        also gives the keys of the whole set, and of its empty parts if these are too many.
        """
        out = [x for band in self._bands(s) for x in self._single(s, band, popular)]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _bands(self, s: np.ndarray) -> list[int]:
        own = self.of(len(s))
        return [band for band in (own, own - 1) if band >= 0 and self.parts[band][0]]

    def _single(self, s: np.ndarray, band: int, popular: np.ndarray | None) -> list[np.ndarray]:
        spare = self.parts[band][1]
        value, filled = self._parts(s if popular is None else s[~popular], band, 0)
        out = [value[filled]]
        if len(value) - filled.sum() > spare:
            value, filled = self._parts(s, band, 1 << 60)
            out.append(value if len(value) - filled.sum() > spare else value[filled])
        return out

    def finer(self, s: np.ndarray, popular: np.ndarray) -> np.ndarray:
        """Keys of a set that fewer others share by chance: each is of two parts.

        Of 2H + 1 parts linked sets agree in H + 1.  The parts make blocks; where more agree,
        and hold any, than there are blocks, two of them are in one block, and the keys are
        all twos of filled parts in a block.  Empty parts are met as in keys().  Where H is
        small, a key is one part, as a band has one kind of keys.
        """
        out = []
        for band in self._bands(s):
            most = self.parts[band][0]
            if most < FINER:
                out += self._single(s, band, popular)
                continue
            k = 2 * most + 1
            size = 4 if k > 64 else 8
            blocks = -(-k // size)
            a, b = np.triu_indices(size, 1)
            for salt, some in ((2 << 60, s[~popular]), (3 << 60, s)):
                value, filled = self._parts(some, band, salt, k)
                few = k - filled.sum() > most - blocks
                if few and salt == 3 << 60:
                    filled[:] = True
                value, filled = (np.append(x, np.zeros(blocks * size - k, x.dtype)).reshape(blocks, size) for x in (value, filled))
                out.append(mix64((value[:, a] * _C + value[:, b])[filled[:, a] & filled[:, b]]))
                if not few:
                    break
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> bytes:
    """How many hashes lie in each of 64 or more equal ranges, a byte each: sets differ in as many hashes at least as their counts do."""
    bits = max(6, (len(s) // 8).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(n: tuple[np.ndarray, np.ndarray], sketches: tuple[list[bytes], list[bytes]], num: int, den: int) -> np.ndarray:
    """Which pairs of sets of n hashes can link by their sketches; never false where they do."""
    width = np.array([[len(x) for x in side] for side in sketches])
    differ = np.zeros(len(n[0]), np.int64)
    for some in np.unique(width, axis=1).T if width.size else ():
        rows, least = np.flatnonzero((width == some[:, None]).all(0)), int(some.min())
        for at in range(0, len(rows), 2048):
            part = rows[at : at + 2048]
            x, y = (np.frombuffer(b"".join([side[i] for i in part]), np.uint8).reshape(len(part), least, -1).sum(2, dtype=np.int64) for side in sketches)
            differ[part] = np.abs(np.minimum(x, 255) - np.minimum(y, 255)).sum(1)
    return (den + num) * differ <= (den - num) * (n[0] + n[1])


def _ordered(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows, by the first column, then the next."""
    order = np.lexsort(columns[::-1])
    columns = [x[order] for x in columns]
    new = first_of(*columns)
    return [x[new] for x in columns]


def _meetings(key: np.ndarray, cls: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(key, class, whether the key is of more than FEW classes: the least stands for these; stars of such keys; pairs of the others).

    many tells which rows stand for more than FEW classes already.
    """
    order = np.lexsort((~many, cls, key))
    key, cls, many = key[order], cls[order], many[order]
    new = first_of(key, cls)
    key, cls, many = key[new], cls[new], many[new]
    start = np.flatnonzero(first_of(key))
    size = np.diff(np.append(start, len(key)))
    large = size > FEW
    if len(start):
        large |= np.logical_or.reduceat(many, start)
    wide, least = np.repeat(large, size), np.repeat(cls[start], size)
    other = wide & (cls != least)
    pairs = [np.zeros((2, 0), np.int64)]
    for k in range(2, FEW + 1):
        i, j = np.triu_indices(k, 1)
        at = start[(size == k) & ~large][:, None]
        pairs.append(np.stack((cls[at + i].ravel(), cls[at + j].ravel())))
    return key[~other], cls[~other], wide[~other], _ordered(least[other], cls[other]), _ordered(*np.concatenate(pairs, axis=1))


def _dealt_keys(n: int, key: np.ndarray, cls: np.ndarray):
    """(key, packed): local stars of large keys under 2n + q; keys by their bucket, a bucket's classes once, its keys with their class's place among them."""
    key, cls, many, stars, _ = _meetings(key, cls, np.zeros(len(key), bool))
    yield from ((2 * n + k, p) for k, p in dealt(spark_hash(stars[1]).astype(np.int64) % n, cls=stars[0], other=stars[1]))
    bucket = ((key >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, key, cls, many = bucket[order], key[order], cls[order], many[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.concatenate(([0], cuts)), np.append(cuts, len(bucket)), strict=True):
        if b > a:
            own, place = np.unique(cls[a:b], return_inverse=True)
            head = pack(cls=own)
            yield int(bucket[a]), np.int64(len(head)).tobytes() + head + pack(key=key[a:b], place=place, many=many[a:b])


def _unpacked_keys(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, classes, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for row in rows:
        n = 8 + int(np.frombuffer(row, np.int64, 1)[0])
        own, c = unpack([row[8:n]], "cls")["cls"], unpack([row[n:]], "key", "place", "many")
        keys.append(c["key"])
        classes.append(own[c["place"]])
        many.append(c["many"] > 0)
    return np.concatenate(keys), np.concatenate(classes), np.concatenate(many)


def _packed_sketches(n: int, sketches: dict[int, tuple[int, bytes]]):
    """(3n + q, packed): classes, sizes, sketches."""
    cls = np.array(list(sketches), np.int64)
    for q, places in _split(spark_hash(cls).astype(np.int64) % n):
        some = [sketches[int(c)] for c in cls[places]]
        yield 3 * n + q, pack(cls=cls[places], size=np.array([x[0] for x in some])) + b"".join(x[1] for x in some)


def _split(key: np.ndarray):
    """(key, its places) for each distinct key."""
    order = np.argsort(key, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(places):
            yield int(key[places[0]]), places


def _unpacked_sketches(rows: list[bytes]) -> dict[int, tuple[int, bytes]]:
    found = {}
    for row in rows:
        c = unpack([row[: 8 + 12 * int.from_bytes(row[:8], "little")]], "cls", "size")
        at = 8 + 12 * len(c["cls"])
        for cls, size in zip(c["cls"].tolist(), c["size"].tolist(), strict=True):
            width = 1 << max(6, (size // 8).bit_length())
            found[cls] = size, row[at : at + width]
            at += width
    return found


PAIRS, ROWS, EDGES, SKETCHES = range(4)


def popular_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Flags of shingles that very many documents hold: a passage of theirs would make candidates of them all.

    A false flag costs time, no link.  The counters follow the number of rows, up to 2^24.
    """
    bits = min(24, max(20, docs.count().bit_length() + 2))
    return popular_hashes(docs.select(F.col("text").cast("binary")), lambda texts: np.concatenate([shingles(x, words) for x in texts]), bits)


def _class_of(s: np.ndarray, salt: int) -> np.int64:
    return np.array(xxhash.xxh3_64_intdigest(s.tobytes(), salt), np.uint64).astype(np.int64)


def _signatures(docs: DataFrame, words: int, num: int, den: int, n: int, flags: np.ndarray, salt: int) -> DataFrame:
    """(key, packed): candidate keys by their bucket, documents under n + q, local stars under 2n + q, sketches under 3n + q."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches):
        bands, flags = Bands(num, den), shared.value
        for batch in batches:
            all_ids, texts, all_marks = batch.columns
            for a, b in slices(byte_lengths(texts), 8 << 20, 60_000):
                ids, marks = all_ids[a:b].to_numpy(), all_marks[a:b].to_numpy()
                cls, check, size, keys, owner, known = *np.zeros((3, b - a), np.int64), [], [], {}
                for i in range(b - a):
                    s = shingles(texts[a + i].as_py(), words)
                    size[i] = len(s)
                    if not len(s):
                        continue
                    cls[i] = c = _class_of(s, salt)
                    check[i] = np.array(xxhash.xxh64_intdigest(s.tobytes(), salt), np.uint64).astype(np.int64)
                    if int(c) not in known:
                        keys.append(bands.keys(s, flagged(flags, s)))
                        if len(keys[-1]):
                            known[int(c)] = len(s), sketch(s)
                        else:
                            known[int(c)] = None
                        owner.append(np.full(len(keys[-1]), c))
                rows = [(n + k, p) for k, p in dealt(spark_hash(ids).astype(np.int64) % n, id=ids, cls=cls, size=size, mark=marks, check=check)]
                if keys:
                    rows += [*_dealt_keys(n, np.concatenate(keys), np.concatenate(owner)), *_packed_sketches(n, {c: x for c, x in known.items() if x})]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["key", "packed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "mark").mapInArrow(run, "key int, packed binary")


def _met(found: DataFrame, n: int, tasks: int) -> DataFrame:
    """(kind, a, b, size, mark, check, sketch): documents (doc_id, class, size, mark, check), stars (least class, other), pairs (class, class), sketches (class, size)."""

    def meet(t: pa.Table) -> pa.Table:
        kind, rows = t.column("key")[0].as_py() // n, t.column("packed").to_pylist()
        size = mark = check = sketches = None
        kinds = kind
        if kind == ROWS:
            c = unpack(rows, "id", "cls", "size", "mark", "check")
            a, b, size, mark, check = (c[x] for x in ("id", "cls", "size", "mark", "check"))
        elif kind == EDGES:
            c = unpack(rows, "cls", "other")
            a, b = _ordered(c["cls"], c["other"])
        elif kind == SKETCHES:
            each = _unpacked_sketches(rows)
            a, b = np.array(list(each), np.int64), np.zeros(len(each), np.int64)
            size, sketches = np.array([x[0] for x in each.values()], np.int64), [x[1] for x in each.values()]
        else:
            *_, stars, pairs = _meetings(*_unpacked_keys(rows))
            a, b = (np.concatenate(x) for x in zip(stars, pairs, strict=True))
            kinds = np.repeat([EDGES, PAIRS], [len(stars[0]), len(pairs[0])])
        numbers = [pa.array(np.zeros(len(a), np.int64) if x is None else x, pa.int64()) for x in (a, b, size, mark, check)]
        return pa.table([pa.array(np.array(np.broadcast_to(kinds, len(a))), pa.int32()), *numbers, pa.nulls(len(a), pa.binary()) if sketches is None else pa.array(sketches, pa.binary())], ["kind", "a", "b", "size", "mark", "check", "sketch"])

    return found.repartition(tasks, "key").groupBy("key").applyInArrow(meet, "kind int, a long, b long, size long, mark long, check long, sketch binary")


def _edges(met: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): stars, and the pairs whose sketches (cls, n, sketch) allow a link."""

    def run(batches):
        for batch in batches:
            u, v, n_u, n_v, first, second = batch.columns
            for a, b in slices(byte_lengths(first), 1 << 20):
                n = tuple(x[a:b].to_numpy() for x in (n_u, n_v))
                keep = pa.array(may_link(n, (first[a:b].to_pylist(), second[a:b].to_pylist()), num, den), pa.bool_())
                yield pa.RecordBatch.from_arrays([u[a:b], v[a:b]], ["u", "v"]).filter(keep)

    ends = [F.col("a").alias("u"), F.col("b").alias("v")]
    pairs = met.where(F.col("kind") == PAIRS).select(ends).distinct()
    for x in "uv":  # pairs grow with the documents: one plan for every size
        pairs = pairs.join(sketches.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"of_{x}")).hint("merge"), x)
    apart = pairs.select("u", "v", "n_u", "n_v", "of_u", "of_v").mapInArrow(run, "u long, v long")
    return met.where(F.col("kind") == EDGES).select(ends).unionByName(apart)


# --- tiles -------------------------------------------------------------------------------


class Joined:
    """Union-find over places 0..n-1; a root is the least place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a
        return a != b


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set; about two bits for each shingle of the largest."""
    bits = 1 << min(16, max(6, int(2 * max(len(s) for s in sets)).bit_length()))
    out = []
    for a in range(0, len(sets), 64):
        some = sets[a : a + 64]
        flags = np.zeros((len(some), bits), bool)
        for row, s in zip(flags, some, strict=True):
            row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        out.append(np.packbits(flags, axis=1).view(np.uint64))
    return np.concatenate(out)


def _bits_apart(marks: np.ndarray, i: int, js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits only i has, and only each of js; some rows at a time, as they may be of 8 kB each."""
    out = np.empty((2, len(js)), np.int64)
    for a in range(0, len(js), 512):
        some = marks[js[a : a + 512]]
        out[0, a : a + 512] = np.bitwise_count(marks[i] & ~some).sum(1, dtype=np.int64)
        out[1, a : a + 512] = np.bitwise_count(some & ~marks[i]).sum(1, dtype=np.int64)
    return out[0], out[1]


def settle(sets: list[np.ndarray], joined: Joined, num: int, den: int, pairs=None) -> list[tuple[int, int]]:
    """Links of one tile that join what was apart; joined is updated.

    pairs(i) narrows the places to compare with i (all before it, by default).
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    sorted_n, marks, links = n[order], None, []
    for r in range(1, len(order)):
        i = int(order[r])
        low = np.searchsorted(sorted_n, -(-num * n[i] // den))
        js = order[low:r]
        if pairs is not None:
            js = js[pairs(i, js)]
        if not len(js):
            continue
        if marks is None:
            marks = bitmaps(sets)
        mine = joined.root(i)
        only_i, only_j = _bits_apart(marks, i, js)
        most = np.minimum(n[i] - only_i, n[js] - only_j)
        fit = den * most >= num * (n[i] + n[js] - most)
        js, most = js[fit], most[fit]
        for j in js[np.argsort(-most, kind="stable")].tolist():
            if joined.root(j) == joined.root(mine):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (n[i] + n[j] - both):
                joined.join(i, j)
                links.append((i, j))
    return links


def _groups(t: pa.Table, *names: str):
    """Slices of a table by equal values of the named columns."""
    t = t.sort_by([(x, "ascending") for x in names])
    new = np.flatnonzero(first_of(*[t.column(x).to_numpy() for x in names])) if len(t) else []
    for a, b in zip(new, np.append(new, len(t))[1:], strict=True):
        yield t.slice(a, b - a)


def _tile(num: int, den: int):
    """(group, block, cls, shingles) -> (group, cls, label): components inside each group and block."""

    def run(t: pa.Table) -> pa.Table:
        out = []
        for g in _groups(t, "group", "block"):
            cls = g.column("cls").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in g.column("shingles").to_pylist()]
            joined = Joined(len(sets))
            settle(sets, joined, num, den)
            label = cls[[joined.root(i) for i in range(len(sets))]]
            out.append((g.column("group").to_numpy(), cls, label))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["group", "cls", "label"])

    return run


def _cross(num: int, den: int):
    """(block, other, rest, label, shingles) -> (u, v): labels that a link between the rest and a block joins."""

    def run(t: pa.Table) -> pa.Table:
        label, rest = t.column("label").to_numpy(), t.column("rest").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        joined = Joined(len(sets))
        first: dict[int, int] = {}
        for i, x in enumerate(label.tolist()):
            joined.join(first.setdefault(x, i), i)
        links = settle(sets, joined, num, den, lambda i, js: (rest[js] != rest[i]) & (label[js] != label[i]))
        return pa.table([pa.array([int(label[x[s]]) for x in links], pa.int64()) for s in (0, 1)], ["u", "v"])

    return run


def _payload(docs: DataFrame, wanted: DataFrame, words: int, salt: int) -> DataFrame:
    """(group, cls, n, shingles) of the wanted classes, from one document each, whose id other rows may repeat."""

    def run(batches):
        for batch in batches:
            group, cls, texts = batch.columns
            for a, b in slices(byte_lengths(texts)):
                sets = [shingles(x, words) for x in texts[a:b].to_pylist()]
                same = [len(s) > 0 and _class_of(s, salt) == c for s, c in zip(sets, cls[a:b].to_numpy(), strict=True)]
                keep = pa.array([bool(x) for x in same], pa.bool_())
                yield pa.RecordBatch.from_arrays([group[a:b], cls[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["group", "cls", "n", "shingles"]).filter(keep)

    # candidates grow with the documents: one plan for every size, no broadcast of what happens to be small
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(wanted.hint("merge"), "doc_id")
    return joined.select("group", "cls", "text").mapInArrow(run, "group long, cls long, n long, shingles binary")


def _parted(stash: Stash, payload, wanted: DataFrame, met: DataFrame, num: int, den: int, tile: int, n: int, tasks: int, flags: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(payload, wanted): the wanted classes parted into candidate groups, with their shingles; those that nothing can link with are left out.

    payload: (doc_id, cls, group) -> the shingles.  Pairs are tried by their sketches first;
    groups of more than a tile are then parted by their sets' finer keys.
    """
    sketches = met.where(F.col("kind") == SKETCHES).select(F.col("a").alias("cls"), F.col("size").alias("n"), "sketch")
    group = stash.put(components(_edges(met, sketches, num, den), stash, "candidates").select(F.col("node").alias("cls"), F.col("component").alias("group")), "groups")
    wanted = wanted.drop("group").join(group, "cls")
    stash.release()
    payload = stash.put(payload(wanted), "payload")
    stash.release()
    big = stash.put(group.groupBy("group").agg(F.count("*").alias("members")).where(F.col("members") > tile).select("group"), "parted")
    if not big.limit(1).count():
        return payload, wanted
    shared = payload.sparkSession.sparkContext.broadcast(flags)

    def run(batches):
        bands, flags = Bands(num, den), shared.value
        for batch in batches:
            cls, packed = batch.columns
            for a, b in slices(byte_lengths(packed), 8 << 20, 60_000):
                sets = [np.frombuffer(x, np.uint64) for x in packed[a:b].to_pylist()]
                keys = [bands.finer(s, flagged(flags, s)) for s in sets]
                rows = [*_dealt_keys(n, np.concatenate(keys), np.repeat(cls[a:b].to_numpy(), [len(x) for x in keys]))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["key", "packed"])

    large = payload.join(big, "group", "left_semi")
    finer = stash.put(_met(large.select("cls", "shingles").mapInArrow(run, "key int, packed binary"), n, tasks), "finer_met")
    stash.release()
    group = stash.put(components(_edges(finer, sketches, num, den), stash, "finer").select(F.col("node").alias("cls"), F.col("component").alias("group")), "finer_groups")
    stash.release()
    large = stash.put(large.drop("group").join(group, "cls").select(payload.columns), "large")
    rest = [x.join(big, "group", "left_anti") for x in (payload, wanted)]
    return rest[0].unionByName(large), rest[1].select("cls", "group").unionByName(large.select("cls", "group"))


def _labels(stash: Stash, payload: DataFrame, wanted: DataFrame, num: int, den: int, tile: int, n: int) -> DataFrame:
    """(group, cls, n, shingles) of the wanted classes -> (cls, label): the components by true links."""
    counts = wanted.groupBy("group").agg(F.count("*").alias("members"))
    big = stash.put(counts.where(F.col("members") > tile), "big")
    small_tile = _tile(num, den)
    rest = payload.join(big.select("group"), "group", "left_anti")
    done = rest.select("group", F.lit(0).alias("block"), "cls", "shingles", F.pmod(F.hash("group"), F.lit(n)).alias("deal")).groupBy("deal").applyInArrow(small_tile, "group long, cls long, label long").select("cls", "label")
    if not big.limit(1).count():
        return done
    done = stash.put(done, "small")
    stash.release()
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int")
    large = payload.join(big, "group")
    per_band = large.groupBy("group", band.alias("band")).agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    spread = large.withColumn("band", band).join(per_band, ["group", "band"]).withColumn("block", F.pmod(F.hash("cls"), "blocks").cast("int"))
    spread = stash.put(spread.select("group", F.hash("band", "block").alias("block"), "cls", "n", "shingles"), "spread")
    label = stash.put(spread.groupBy("group", "block").applyInArrow(small_tile, "group long, cls long, label long"), "local")
    # the blocks' leaders, as long as that joins many
    for turn in range(6):
        heads = label.select("group", F.col("label").alias("cls")).distinct()
        parts = heads.groupBy("group").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
        leaders = spread.drop("block").join(heads, ["group", "cls"]).join(parts, "group").withColumn("block", F.pmod(F.hash("cls", F.lit(turn)), "blocks"))
        raised = leaders.select("group", "block", "cls", "shingles").groupBy("group", "block").applyInArrow(small_tile, "group long, cls long, label long")
        more = label.join(raised.select(F.col("cls").alias("label"), F.col("label").alias("higher")), "label", "left").select("group", "cls", F.coalesce("higher", "label").alias("label"))
        before = heads.count()
        label = stash.put(more, f"leaders{turn}")
        if label.select("label").distinct().count() > 0.8 * before:
            break
    # whatever is not in its group's largest component meets all the others
    sizes = label.groupBy("group", "label").agg(F.count("*").alias("members"))
    main = sizes.groupBy("group").agg(F.max_by("label", F.struct("members", "label")).alias("main"))
    tagged = spread.drop("block").join(label, ["group", "cls"]).join(main, "group").withColumn("rest", F.col("label") != F.col("main")).drop("main")
    apart = tagged.where("rest").groupBy("group").agg(F.ceil(F.count("*") / (CROSS * tile)).cast("int").alias("others"))
    tagged = tagged.join(apart, "group").join(big, "group").withColumn("blocks", F.ceil(F.col("members") / (CROSS * tile)).cast("int"))
    sides = tagged.select("group", "label", "shingles", F.lit(False).alias("rest"), F.pmod(F.hash("cls"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    moved = tagged.where("rest").select("group", "label", "shingles", F.lit(True).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.hash("cls"), "others").cast("int").alias("other"))
    edges = sides.unionByName(moved).groupBy("group", "block", "other").applyInArrow(_cross(num, den), "u long, v long")
    over = components(edges, stash, "labels").select(F.col("node").alias("label"), "component")
    label = label.join(over, "label", "left").select("cls", F.coalesce("component", "label").alias("label"))
    return done.unionByName(label)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, tile: int = TILE) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id), a row a row.

    Two texts link when den * |A and B| >= num * |A or B| for their sets of distinct
    word n-grams (a shorter text is one n-gram; without words it is linked with nothing).
    component_id is the smallest doc_id that links reach.  A null text has no words; rows
    that repeat a doc_id are told apart by their texts; a row without doc_id is linked with
    nothing and has no component_id; an empty table gives none; texts of any length count
    whole.  Other columns are left out.  Shingles are compared by 64-bit hashes, sets by two.
    """
    named = _linked(docs.where("doc_id IS NOT NULL").withColumn("mark", F.lit(0).cast("long")), words, num, den, tile)

    def counts(batches):
        for batch in batches:
            size = [len(shingles(x, words)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(size), pa.int64()), pa.array(size, pa.int64()), pa.nulls(len(size), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    unnamed = docs.where("doc_id IS NULL").select(F.col("text").cast("binary")).mapInArrow(counts, "doc_id long, n_shingles long, component_id long")
    return named.select("doc_id", "n_shingles", "component_id").unionByName(unnamed)


def firsts(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """docs with one row of each component that near_duplicates() finds: the least by (doc_id, hash of the text).

    Rows that repeat a doc_id are told apart by their texts, and go or stay each for itself;
    of rows with one doc_id and one text, one stays.  Rows without words are each a component,
    rows without doc_id all stay.  Texts are compared by 64-bit hashes.
    """
    mark = fresh(docs, "mark")
    stash, at = Stash(docs.sparkSession, "firsts"), ["doc_id", mark]
    named = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).where("doc_id IS NOT NULL")
    found = stash.put(_linked(named, words, num, den, TILE).select(F.col("doc_id"), F.col("mark").alias(mark), "component_id", "component_mark"), "found")
    stash.release()
    gone = found.where(f"doc_id <> component_id OR {mark} <> component_mark").select(at).distinct()
    kept = docs.withColumn(mark, F.xxhash64("text")).join(gone, at, "left_anti")
    again = found.where(f"doc_id = component_id AND {mark} = component_mark").groupBy(at).agg(F.count("*").alias("rows")).where("rows > 1").select(at)
    if again.limit(1).count():
        kept = kept.join(again, at, "left_anti").unionByName(kept.join(again, at, "left_semi").dropDuplicates(at))
    return kept.select(*docs.columns)


def _linked(named: DataFrame, words: int, num: int, den: int, tile: int) -> DataFrame:
    """(doc_id, text, mark) -> (doc_id, mark, n_shingles, component_id, component_mark), a row a row.

    component_mark is, with component_id, of the component's least row by (doc_id, mark).
    """
    spark = named.sparkSession
    stash = Stash(spark, "jaccard")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(buckets(spark), -(-size // BUCKET_BYTES))  # documents and keys of so many bytes of text meet in one group
    tasks = max(buckets(spark), -(-n // 8))
    flags, salt, alike = popular_shingles(named, words), 0, True
    while alike:
        met = stash.put(_met(_signatures(named, words, num, den, n, flags, salt), n, tasks), f"met{salt}")
        stash.release()
        rows = met.where(F.col("kind") == ROWS).select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("size").alias("n_shingles"), "mark", "check")
        classes = stash.put(rows.where("n_shingles > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "mark")).alias("least"), (F.min("check") != F.max("check")).alias("alike")), f"classes{salt}")
        alike = classes.where("alike").limit(1).count()
        salt += 1
    salt -= 1
    several = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count()

    def payload(wanted: DataFrame) -> DataFrame:
        found = _payload(named, wanted, words, salt)
        return found.dropDuplicates(["cls"]) if several else found  # rows that repeat a doc_id give one set

    wanted = classes.select(F.col("least.doc_id").alias("doc_id"), "cls", F.lit(0).cast("long").alias("group"))
    payload, wanted = _parted(stash, payload, wanted, met, num, den, tile, n, tasks, flags)
    stash.release()
    label = stash.put(_labels(stash, payload, wanted, num, den, tile, n).distinct(), "labels")
    stash.drop("payload", "large", "spread")
    stash.release()
    whole = classes.join(label, "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    least = whole.groupBy("label").agg(F.min("least").alias("least"))
    by_class = whole.select("cls", "label").join(least, "label").select("cls", F.col("least.doc_id").alias("component_id"), F.col("least.mark").alias("component_mark"))
    out = rows.where("n_shingles > 0").join(by_class, "cls").select("doc_id", "mark", "n_shingles", "component_id", "component_mark")
    alone = rows.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.col("mark").alias("component_mark"))
    return out.unionByName(alone)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def brute_force(rows: list[tuple[int, bytes]], words: int, num: int, den: int) -> dict[int, tuple]:
    """What near_duplicates must return, by all pairs of word tuples; for small tables of distinct ids."""
    sets = {}
    for doc_id, text in rows:
        t = text.lower().split()
        k = min(words, len(t))
        sets[doc_id] = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)} if t else set()
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and den * small >= num * large:
                both = len(sets[a] & sets[b])
                if den * both >= num * (small + large - both):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


#: Shingles as texts, pairs by a join on them, components as a closure: for tables of some thousands of documents.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, CASE WHEN l.u = r.other THEN l.v ELSE l.u END FROM reach r JOIN links l ON r.other = l.u OR r.other = l.v)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
