"""Mixture-controlled packing: sequences of fixed length with target shares of every source.

Documents are tokenised once.  Each packing task holds a share of all sources as queues
and fills one window after another by deficit round-robin: every window gives each source
its share of the window as credit and serves it what it has credit for, so while its queue
lasts a source has its share of every window, give or take two PIECEs.  What it could not
get, or got too much, stays with it: credits pass from window to window and, as prefix sums
of the tasks' token counts, from task to task, so the mixture holds over the whole order of
sequences and not only inside a task.

A task's last tokens fill sequences of descending powers of two, which need no padding.
Tasks follow the number of tokens alone.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, byte_lengths, shuffle_partitions, slices, table

SEQUENCE, PIECE, END_ID = 2048, 32, 1
#: Tokens of a group that is packed together, and groups of one task.
TASK_TOKENS, TASK_PARTS = 512 * SEQUENCE, 16


class Tokenizer:
    """ids of texts under a tokenizers file, by bounded tables of what was met before.

    The file's pre-tokenizer drops white space and never joins over it, so a text's ids
    are those of its parts between blanks in turn.  A part of Latin letters, digits and
    ASCII signs is cut here as the file's pattern cuts it, and its pieces go to the file's
    BPE model alone; any other part goes through the whole file.  Tables keep two
    generations, so that what is frequent stays.
    """

    LIMIT = 400_000
    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer as File

        self.file = File.from_file(path)
        self.model = self.file.model
        self.code = "H" if self.file.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        # for plain parts in lower case, letters and numbers are sets that can be told
        split = json.loads(self.file.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f"
        self.pieces = re.compile(split.replace(r"\p{L}", letters).replace(r"\p{N}", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be")).findall
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as themselves
        others = [i for i in range(256) if i not in signs]
        self.letters = {**{i: chr(i) for i in signs}, **{i: chr(256 + n) for n, i in enumerate(others)}}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.of_piece: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if len(self.of_piece) > self.LIMIT:
            self.of_piece.clear()
        shown = piece if piece.isascii() else "".join([self.letters[x] for x in piece.encode()])
        ids = self.of_piece[piece] = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def _part(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        if (text.isascii() and text.isprintable() or self.PLAIN.fullmatch(text)) and "<|" not in text:
            found = [self.of_piece.get(x) or self._piece(x) for x in self.pieces(text.lower())]
            return found[0] if len(found) == 1 else b"".join(found)
        return array(self.code, self.file.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, parts: set[bytes]) -> None:
        if len(self.known) > self.LIMIT:
            self.older, self.known = self.known, {}
        for p in parts.difference(self.known):
            ids = self.older.get(p)
            self.known[p] = self._part(p) if ids is None else ids

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian numbers of `width` bytes, the end id last."""
        split = [x.split() for x in texts]
        self.learn(set().union(*split))
        end = END_ID.to_bytes(self.width, "little")
        return [b"".join([*map(self.known.__getitem__, parts), end]) for parts in split]


_loaded: dict[str, Tokenizer] = {}


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, text) -> (place, doc_id, source, n, ids); a null text is empty; place: a hash of id and text."""

    def run(batches):
        if path not in _loaded:
            _loaded[path] = Tokenizer(path)
        t = _loaded[path]
        for batch in batches:
            place, doc_id, source, texts = batch.columns
            for a, b in slices(byte_lengths(texts)):
                ids = t.ids([x or b"" for x in texts[a:b].to_pylist()])
                yield pa.RecordBatch.from_arrays([place[a:b], doc_id[a:b], source[a:b], pa.array([len(x) // t.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["place", "doc_id", "source", "n", "ids"])

    return docs.select(F.xxhash64("doc_id", "text").alias("place"), F.col("doc_id").cast("long"), "source", F.col("text").cast("binary")).mapInArrow(run, "place long, doc_id long, source string, n long, ids binary")


def plan(tokens: DataFrame, shares: dict | None, stash: Stash) -> DataFrame:
    """(part, first_sequence, queues): each task's first sequence number, and every source's share and credit.

    shares: target proportions by source; by default the sources' shares of all tokens.
    """
    counts = stash.put(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "counts")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = counts.groupBy("part").agg(F.sum("n").alias("tokens"))
    # a row a task, as many as tasks: the one place where order over all of them is needed
    per_part = per_part.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).withColumn("first_sequence", F.coalesce(F.sum(F.floor(F.col("tokens") / SEQUENCE) + F.bit_count(F.col("tokens") % SEQUENCE)).over(w), F.lit(0)).cast("long"))
    if shares is None:
        total = counts.agg(F.sum("n")).first()[0] or 1
        share = counts.groupBy("source").agg((F.sum("n") / F.lit(float(total))).alias("share"))
    else:
        whole = float(sum(shares.values()))
        given = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v / whole))])
        share = counts.select("source").distinct().withColumn("share", F.coalesce(given[F.coalesce("source", F.lit(""))], F.lit(0.0)))
    had = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = share.withColumnRenamed("source", "s")
    rows = counts.withColumn("had", had).join(s, F.col("source").eqNullSafe(F.col("s"))).join(per_part, "part")
    queue = F.struct("source", "share", (F.col("share") * F.col("before") - F.col("had")).alias("credit"))
    return rows.groupBy("part", "first_sequence").agg(F.array_sort(F.collect_list(queue)).alias("queues"))


def fill(lengths: list[int], shares: list[float], credits: list[float], capacities: list[int], piece: int = PIECE):
    """Deficit round-robin: yields (window, queue, tokens) until the queues are empty.

    lengths: tokens in each queue; capacities must add up to theirs.  A window serves every
    queue its whole credit, within `piece` of the window's own share; a queue whose share is
    below `piece` waits until it has credit for one.  What is then free goes, a piece at a
    time, to those with most credit, and what is too much is taken from those with least.
    """
    left, share, credit = np.array(lengths, np.int64), np.array(shares, np.float64), np.array(credits, np.float64)
    for window, size in enumerate(capacities):
        due = share * size
        credit += due
        give = np.floor(np.clip(credit, np.maximum(due - piece, 0), due + piece)).astype(np.int64)
        give = np.minimum(np.where(give >= np.minimum(piece, left), give, 0), left)
        free = size - int(give.sum())
        while free < 0:
            for q in np.argsort(credit - give, kind="stable"):
                cut = min(piece, -free, int(give[q]))
                give[q] -= cut
                free += cut
                if not free:
                    break
        while free:
            for q in np.argsort(give - credit, kind="stable"):
                more = min(piece, free, int(left[q] - give[q]))
                give[q] += more
                free -= more
                if not free:
                    break
        credit -= give
        left -= give
        for q in np.flatnonzero(give).tolist():
            yield window, q, int(give[q])


def capacities(tokens: int) -> list[int]:
    rest = tokens % SEQUENCE
    return [SEQUENCE] * (tokens // SEQUENCE) + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def packed(docs: DataFrame, path: str, shares: dict | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, source, text) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    with_ids=False leaves ids out.

    Every id of every document lies in exactly one piece (a null or empty text is the end
    id alone; a text of any length is packed whole).  A null source is a source; rows that
    repeat a doc_id are packed each, in the order of their lengths and ids; a null doc_id is
    packed too; an empty table gives no pieces.  Other columns are left out.  ids are
    little-endian numbers of 16 bits, or of 32 where the vocabulary needs them.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "packing")
    tokens = stash.put(tokenised(docs, path), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, total // TASK_TOKENS)
    tasks = max(shuffle_partitions(spark), -(-parts // TASK_PARTS))
    tokens = tokens.withColumn("part", F.pmod("place", F.lit(parts)).cast("int")).drop("place")
    plans = plan(tokens, shares, stash)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"][: 9 if with_ids else 8]
    kinds = ([pa.int64()] * 7 + [pa.string(), pa.binary()])[: len(names)]

    def pack(t: pa.Table, p: pa.Table) -> pa.Table:
        out = []
        if len(t):
            first, queues = p.column("first_sequence")[0].as_py(), p.column("queues")[0].as_py()
            key, n = t.column("doc_id").fill_null(-1).to_numpy(), t.column("n").to_numpy()
            order = np.lexsort((n, key))
            if ((np.diff(key[order]) == 0) & (np.diff(n[order]) == 0)).any():
                order = np.lexsort(([zlib.crc32(x) for x in t.column("ids").to_pylist()], n, key))
            t = t.take(pa.array(order))
            doc, n_ids, data, source = t.column("doc_id").to_pylist(), t.column("n").to_pylist(), t.column("ids"), t.column("source").to_pylist()
            at = {q["source"]: i for i, q in enumerate(queues)}
            rows = [[] for _ in queues]
            for i, s in enumerate(source):
                rows[at[s]].append(i)
            lengths = [sum(n_ids[i] for i in r) for r in rows]
            waiting = [iter(r) for r in rows]
            now = [None] * len(rows)  # of each queue: its document, where it has got to, its ids, and these as 32-bit numbers
            window, used = -1, 0
            for w, q, take in fill(lengths, [x["share"] for x in queues], [x["credit"] for x in queues], capacities(sum(lengths))):
                if w != window:
                    window, used = w, 0
                while take:
                    if now[q] is None:
                        i = next(waiting[q])
                        raw = data[i].as_py()
                        width = len(raw) // n_ids[i]
                        now[q] = [i, 0, raw, width, memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())]
                    i, start, raw, width, wide = now[q]
                    stop = min(start + take, n_ids[i])
                    piece = (doc[i], start, stop - start, zlib.crc32(wide[4 * start : 4 * stop]), n_ids[i], first + w, used, source[i])
                    out.append((*piece, raw[width * start : width * stop]) if with_ids else piece)
                    used, take = used + stop - start, take - stop + start
                    now[q][1] = stop
                    if stop == n_ids[i]:
                        now[q] = None
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + (", ids binary" if with_ids else "")
    return tokens.repartition(tasks, "part").groupBy("part").cogroup(plans.repartition(tasks, "part").groupBy("part")).applyInArrow(pack, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("source")
