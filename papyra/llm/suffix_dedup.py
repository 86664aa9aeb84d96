"""Suffix-array de-duplication: bytes that an earlier document holds are removed.

A shard is a group of whole documents and the passages of earlier documents that they may
repeat (see passages.py).  All its suffixes are put in order, by prefix doubling until
those of 50 equal bytes stand together.  Neighbours compared byte by byte show where such a
run ends; who of a run belongs to a later document than its earliest is covered, so the first
copy stays whole.  How entries of 50 equal bytes go on tells nothing more.  Nothing else
removes a byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_memory, table
from .passages import Corpus, Units, eight_bytes, first_of

MATCH_BYTES = 50
UNITS = Units("bytes", MATCH_BYTES, 24, strict=True)
#: Text of one shard: what sorting it touches fits a core's cache.
SHARD_BYTES = 3 << 18


def previous_smaller(value: np.ndarray) -> np.ndarray:
    """The nearest earlier place with a strictly smaller value, or -1, by pointer jumping.

    All values between a place and its pointer are at least its own, so a pointer that is
    not smaller yet may take over that place's pointer.
    """
    at = np.arange(len(value)) - 1
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[value[at[open_]] >= value[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


#: How many suffixes are sorted again at a time.
PART = 1 << 15


def _sorted(*columns: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """(columns as one number, place before) of rows in the order of the columns; each is given with its bits.

    Where all fit, the place is the number's last bits, and sorting plain numbers is enough.
    """
    n = len(columns[0][0])
    place, key = n.bit_length(), columns[0][0].astype(np.uint64)
    for x, bits in columns[1:]:
        key <<= np.uint64(bits)
        key |= x.astype(np.uint64)
    if place + sum(bits for _, bits in columns) > 64:
        by = np.argsort(key)
        return key[by], by
    key <<= np.uint64(place)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    by = (key & np.uint64((1 << place) - 1)).view(np.int64)
    key >>= np.uint64(place)
    return key, by


def suffix_order(text: np.ndarray, least: int = 0) -> np.ndarray:
    """The places of a text in the order of the suffixes that begin there.

    Suffixes are sorted by as many first bytes as fit a number, bytes that the text has not
    left out of account.  Then prefix doubling: what is in the order of its first h bytes is
    put in that of its first 2 h by the rank of what follows; only suffixes that still have
    equals are sorted again.  With `least`, places are left out whose suffix shares fewer
    than h bytes with any other, h the last such depth up to least: they have no longer match.
    What shares `least` bytes then stands together, in any order.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    seen = np.flatnonzero(np.bincount(text, minlength=256))
    number, bits = np.zeros(256, np.uint8), len(seen).bit_length()
    number[seen] = np.arange(1, len(seen) + 1)  # 0 is behind the end
    h = max(1, (64 - n.bit_length()) // bits)
    key, held = np.concatenate((number[text], np.zeros(2 * h, np.uint8))).astype(np.uint64), 1
    while held < h:  # the codes of `held` bytes from each place, and of as many more as are wanted
        more = min(held, h - held)
        key = key[:-held] << np.uint64(more * bits) | key[held:] >> np.uint64((held - more) * bits)
        held += more
    key = key[:n]
    key, order = _sorted((key, h * bits))
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    del key
    size = np.diff(np.append(heads, n))
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.repeat(heads.astype(np.int32), size)
    place = np.flatnonzero(np.repeat(size > 1, size))
    at = order[place]
    chosen = order if least < h else None
    del order
    while len(at) and not 0 < least <= h:
        if chosen is None and 2 * h > least:
            chosen = at
        # parts of whole groups; ranks change when all are sorted, or some would be told apart by more than 2 h bytes
        new = np.flatnonzero(np.diff(rank[at])) + 1 if len(at) > PART else place[:0]
        cuts = new[np.searchsorted(new, np.arange(PART, len(at), PART)).clip(max=len(new) - 1)] if len(new) else new
        bounds = np.unique(np.concatenate(([0], cuts, [len(at)])))
        parts = [_doubled(rank, at[a:b], place[a:b], h, n) for a, b in zip(bounds, bounds[1:], strict=False)]
        at, ranks, alike = (np.concatenate(x) for x in zip(*parts, strict=True))
        rank[at] = ranks
        at, place = at[alike], place[alike]
        h *= 2
    if chosen is None:
        chosen = at
    return chosen[_sorted((rank[chosen], n.bit_length()))[1]]


def _doubled(rank: np.ndarray, at: np.ndarray, place: np.ndarray, h: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that share h bytes in the order of the next h: (places in the text, ranks, which still have equals).

    at: whole groups, in the order of their ranks; place: where these stand among all.  A
    suffix's rank is the place of the first of its equals.  Of one group no two end within
    their first h bytes, as they would differ in length.
    """
    old = rank[at]
    old -= old[0]
    then = rank[np.minimum(at + h, n)] + 1
    key, by = _sorted((old, int(old[-1]).bit_length()), (then, n.bit_length()))
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(heads, len(at)))
    return at[by], np.repeat(place[heads], size).astype(np.int32), np.repeat(size > 1, size)


def longest_previous_factors(strings: list[bytes], owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, length) of the longest match that begins in a string of a smaller owner.

    Of places with `most` bytes after them, and matches of `most` bytes, up to which a
    length is told.  The shard is all strings, with a byte between that UTF-8 has not.
    """
    lengths = np.array([len(x) for x in strings], np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    string = np.repeat(np.arange(len(strings), dtype=np.int32), lengths + 1)
    raw = b"\xff".join([*strings, bytes(most + 8)])
    at = suffix_order(np.frombuffer(raw, np.uint8), most)
    at = at[at < len(string)]
    which = string[at]
    whole = at - first[which] + most <= lengths[which]
    at, which = at[whole], which[whole]
    who = np.unique(owner, return_inverse=True)[1].astype(np.int32)[which]
    x, new = eight_bytes(raw, ">u8"), np.zeros(len(at), bool)
    for i in (*range(0, most - 7, 8), *([most - 8] if most % 8 else [])):
        new |= first_of(x[at + i])
    heads = np.flatnonzero(new)
    first_who = np.minimum.reduceat(who, heads) if len(heads) else who
    hit = np.zeros(len(string), bool)
    hit[at[who > np.repeat(first_who, np.diff(np.append(heads, len(at))))]] = True
    at = np.flatnonzero(hit)
    which = string[at]
    return which, at - first[which], np.full(len(at), most)


def _solve(ids: np.ndarray, texts: list[bytes], passages: list[tuple]) -> list:
    keep_memory()
    owner = np.concatenate((ids, np.array([p[0] for p in passages], np.int64)))
    which, at, _ = longest_previous_factors([*texts, *(p[1] for p in passages)], owner, MATCH_BYTES)
    cuts = np.searchsorted(which, np.arange(len(texts) + 1))
    return [(at[a:b], at[a:b] + MATCH_BYTES) if b > a else None for a, b in zip(cuts, cuts[1:], strict=False)]


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, kept (the bytes that stay), spans (removed runs, start and stop), n_bytes.

    A null text is empty; texts under 50 bytes stay whole, longer ones of any length are
    treated whole; rows that repeat a doc_id are versions of it and do not take from each
    other; rows without doc_id stay whole; an empty table gives none.  Other columns are
    left out.
    """
    schema = "doc_id long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def finish(d: pa.Table, found: list) -> pa.Table:
        n, spans, kept = [], [], []
        for text, ranges in zip(d.column("text").to_pylist(), found, strict=True):
            text = text or b""
            n.append(len(text))
            if ranges is None:
                spans.append([])
                kept.append(text)
                continue
            at = ranges[0]  # ascending, all of one length
            cut = np.flatnonzero(at[1:] > at[:-1] + MATCH_BYTES)
            first, last = at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + MATCH_BYTES).tolist()
            spans.append([{"start": a, "stop": b} for a, b in zip(first, last, strict=True)])
            kept.append(b"".join([text[a:b] for a, b in zip([0, *last], [*first, len(text)], strict=True)]))
        return pa.table([d.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return Corpus(docs.select("doc_id", "text"), "suffix", SHARD_BYTES).solved(UNITS, _solve, finish, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]]) -> dict[int, tuple]:
    """What op3 must return, by a dictionary of all windows; for small tables of distinct ids."""
    first: dict[bytes, int] = {}
    for doc_id, text in sorted(rows):
        for i in range(len(text) - MATCH_BYTES + 1):
            first.setdefault(text[i : i + MATCH_BYTES], doc_id)
    out = {}
    for doc_id, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - MATCH_BYTES + 1):
            if first[text[i : i + MATCH_BYTES]] < doc_id:
                gone[i : i + MATCH_BYTES] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(text) else 0
        out[doc_id] = (len(text), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(text, gone, strict=True) if not g)).hexdigest())
    return out


#: Texts as hexadecimal digits, two a byte: a window is 100 of them.
SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY part) AS first_id
  FROM (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS part FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 48)) AS i FROM texts) a) b),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows WHERE first_id < doc_id),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits) r GROUP BY doc_id, run),
kept AS (
  SELECT t.doc_id, count(*) AS spans, sum(b - a) AS removed,
         string_agg(substr(h, 2 * upto - 1, 2 * (a - upto)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) - 1) AS k
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS upto FROM runs) r JOIN texts t USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(from_hex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
