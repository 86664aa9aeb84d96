"""Substring de-duplication by repeated-phrase automata.

Recurring passages are confirmed and reach every group of documents that may hold them
(see passages.py), each cut into phrases of 20 words or some more.  A group's phrases are
compiled into Aho-Corasick automata (pyahocorasick), shards of bounded size, and all its
documents are streamed through every shard, whole.  The automata's hits alone decide what
is removed: a phrase that an earlier document owns, or that a document repeats of itself.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .passages import Corpus, Units, mask

WINDOW_WORDS = 20
UNITS = Units("words", WINDOW_WORDS, 8, strict=False)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words of the phrases that one automaton holds; its memory is some 100 bytes a word.
SHARD_WORDS = 400_000
#: Text of a group of documents.
GROUP_BYTES = 4 << 20


class Signs(dict):
    """word -> the signs it has in automata: two digits, or more, each with an alphabet of its own.

    An automaton's node looks through its children one by one, so one sign a word would
    make its root slow; and as a first digit is no second one, nothing matches half a word.
    Words that no phrase has are all alike.
    """

    def __init__(self, words):
        words = dict.fromkeys(words)
        self.digits = 2
        while 200**self.digits < len(words):
            self.digits += 1
        base = max(2, math.ceil(len(words) ** (1 / self.digits)))
        super().__init__((w, "".join([chr(1 + k * base + n // base**k % base) for k in range(self.digits)])) for n, w in enumerate(words))
        self.other = "\0" * self.digits

    def __missing__(self, word: bytes) -> str:
        return self.other

    def of(self, words: list[bytes]) -> str:
        return "".join(map(self.__getitem__, words))


def shards(passages: list[tuple], signs: Signs):
    """{phrase: least owner} for each shard; phrases in signs."""
    owners: dict[str, int] = {}
    d = signs.digits
    for owner, text, phrases in passages:
        whole = signs.of(text.split(b" "))
        for off, size in phrases:
            phrase = whole[off * d : (off + size) * d]
            if owners.setdefault(phrase, owner) > owner:
                owners[phrase] = owner
    held, room = {}, SHARD_WORDS * d
    for phrase, owner in owners.items():
        held[phrase] = owner
        room -= len(phrase)
        if room <= 0:
            yield held
            held, room = {}, SHARD_WORDS * d
    if held:
        yield held


def compile_shard(phrases: dict[str, int]):
    """(automaton, owners, lengths): a hit gives the number of the phrase."""
    import ahocorasick

    shard = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        shard.add_word(phrase, i)
    shard.make_automaton()
    return shard, list(phrases.values()), list(map(len, phrases))


def _solve(ids: np.ndarray, texts: list[bytes], passages: list[tuple]) -> list:
    found = [([], []) for _ in texts]
    signs = Signs(w for p in passages for w in p[1].split(b" "))
    for phrases in shards(passages, signs):
        shard, owners, lengths = compile_shard(phrases)
        for doc_id, text, (starts, stops) in zip(ids.tolist(), texts, found, strict=True):
            own = set()
            for end, phrase in shard.iter(signs.of(text.split())):
                owner = owners[phrase]
                if owner < doc_id or phrase in own:
                    starts.append(end + 1 - lengths[phrase])
                    stops.append(end + 1)
                elif owner == doc_id:
                    own.add(phrase)
    return [(np.array(a) // signs.digits, np.array(b) // signs.digits) if a else None for a, b in found]


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the covered words; each takes the white space after it along."""
    words = list(_WORD.finditer(text))
    turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for a, b in turns:
        out.append(text[at : words[a].start()])
        at = words[b].start() if b < len(words) else len(text)
    return b"".join([*out, text[at:]])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every column of docs, text without the words of recurring passages, and n_words, n_removed, kept_sha256.

    A null text has no words and stays null; documents under 20 words stay whole, longer
    ones of any length are treated whole; rows that repeat a doc_id are versions of it and
    do not take from each other; rows without doc_id stay whole; an empty table gives none.
    kept_sha256 is of the kept words joined by one space.  A column that has one of these
    names is replaced.
    """
    own = ("n_words", "n_removed", "kept_sha256")
    columns = [c for c in docs.columns if c not in own]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), "n_words long, n_removed long, kept_sha256 string"])

    def finish(d: pa.Table, found: list) -> pa.Table:
        texts, n, removed, sha = [], [], [], []
        for text, ranges in zip(d.column("text").to_pylist(), found, strict=True):
            words = (text or b"").split()
            n.append(len(words))
            if ranges is None:
                removed.append(0)
            else:
                gone = mask(len(words), ranges)
                removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                text = _cut(text, gone)
            texts.append(text)
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        out = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else d.column(c) for c in columns]
        return pa.table([*out, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], [*columns, *own])

    return Corpus(docs.select(*columns), "phrases", GROUP_BYTES).solved(UNITS, _solve, finish, schema)


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def brute_force(rows: list[tuple[int, bytes]]) -> dict[int, tuple]:
    """What op8 must return, by a dictionary of all windows; for small tables of distinct ids."""
    first: dict[tuple, tuple] = {}
    split = {i: t.split() for i, t in rows}
    for doc_id in sorted(split):
        words = split[doc_id]
        for i in range(len(words) - WINDOW_WORDS + 1):
            first.setdefault(tuple(words[i : i + WINDOW_WORDS]), (doc_id, i))
    out = {}
    for doc_id, words in split.items():
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - WINDOW_WORDS + 1):
            if first[tuple(words[i : i + WINDOW_WORDS])] < (doc_id, i):
                gone[i : i + WINDOW_WORDS] = True
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS place
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words) a) b),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM windows WHERE place > 1),
kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words) p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
