"""Semantic chunks of a parsed document's records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text

#: Characters of a chunk, how far it may run over, and the least of a body chunk.
TARGET, OVER, LEAST = 2000, 500, 500
#: How far apart two records of one sentence may stand in the text, and the least needle sought.
SENTENCE_GAP, LEAST_NEEDLE = 160, 12
BODY_TYPES, TABLE_TYPES = {"text", "ref_text"}, {"table_cells", "image_labels"}
_ENDED = re.compile(r"[.!?。！？]$")
_TAIL = re.compile(r"(?i)(?:</?(?:sup|sub)\b[^>]*>|\s)+$")


def search_key(c: Column) -> Column:
    """What of a text is compared when records are sought in it: Latin letters, digits and Han signs."""
    return F.regexp_replace(F.lower(F.regexp_replace(text(c), r"<[^>]+>", "")), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")


def positions(records: DataFrame, key: str, order: str, value: str, whole: str) -> DataFrame:
    """start and stop of each record in its document's search_key, or null.

    records: (key, order, value, whole), whole the document's text on every row.  Records
    are sought in their order, each behind the one found before it, so a document is one
    fold with the place reached as its state; needles under LEAST_NEEDLE are passed over.
    """
    rows = records.groupBy(key).agg(search_key(F.first(whole)).alias("_in"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), search_key(F.col(value)).alias("n")))).alias("_r"))
    found = F.expr(f"""aggregate(_r, named_struct('at', 1, 'out', cast(array() AS array<struct<o:bigint,start:int,stop:int>>)), (s, r) -> (
        CASE WHEN length(r.n) < {LEAST_NEEDLE} OR locate(r.n, _in, s.at) = 0
             THEN named_struct('at', s.at, 'out', s.out || array(named_struct('o', cast(r.o AS bigint), 'start', cast(NULL AS int), 'stop', cast(NULL AS int))))
             ELSE named_struct('at', locate(r.n, _in, s.at) + length(r.n), 'out', s.out || array(named_struct('o', cast(r.o AS bigint), 'start', locate(r.n, _in, s.at) - 1, 'stop', locate(r.n, _in, s.at) - 1 + length(r.n)))) END), s -> s.out)""")
    at = rows.select(key, F.explode(found).alias("f")).select(key, F.col("f.o").alias(order), "f.start", "f.stop")
    return records.join(at, [key, order], "left")


class _Packer:
    """Consecutive records in groups of about TARGET characters."""

    def __init__(self):
        self.groups: list[list] = []
        self.size = 0

    def fits(self, n: int) -> bool:
        total = self.size + n
        return total <= TARGET or (self.size >= TARGET / 2 and total <= TARGET + OVER)

    def put(self, row, n: int, together: bool = False) -> None:
        if self.groups and (together or self.fits(n)):
            self.groups[-1].append(row)
            self.size += n
        else:
            self.groups.append([row])
            self.size = n


def _body(rows: list, located: bool) -> list[list]:
    """Body records, a sentence that runs over two of them kept together unless a title stands between."""
    pack, before, title = _Packer(), None, False
    for r in rows:
        if r.type == "title":
            title = before is not None
            continue
        runs_on = before is not None and not title and not _ENDED.search(_TAIL.sub("", before.text))
        if runs_on and located:
            runs_on = pd.notna(before.start) and pd.notna(r.start) and 0 <= r.start - before.stop <= SENTENCE_GAP
        pack.put(r, len(r.text), runs_on)
        before, title = r, False
    return pack.groups


def _merged(groups: list[list]) -> list[list]:
    """Groups under LEAST characters go to the one before; the first to the one behind it."""
    small = lambda g: sum(len(r.text) for r in g) < LEAST
    if len(groups) > 1 and small(groups[0]):
        groups = [groups[0] + groups[1], *groups[2:]]
    out: list[list] = []
    for g in groups:
        if out and small(g):
            out[-1].extend(g)
        else:
            out.append(list(g))
    return out


def chunked(records: list, located: bool) -> list[list]:
    """The chunks of one document's records (type, text, start, stop, in their order).

    In reading order: all titles; body, by sentences; captions, notes and others; tables,
    each in the last chunk if that has room.
    """
    flow = [r for r in records if r.type not in TABLE_TYPES]
    known = sorted((r for r in flow if pd.notna(r.start)), key=lambda r: r.start)
    flow = known + [r for r in flow if pd.isna(r.start)]
    titles = [r for r in flow if r.type == "title"]
    groups = [titles] if titles else []
    groups += _merged(_body([r for r in flow if r.type in BODY_TYPES or r.type == "title"], located))
    rest = _Packer()
    for r in flow:
        if r.type not in BODY_TYPES and r.type != "title":
            rest.put(r, len(r.text))
    groups += rest.groups
    tail = _Packer()
    tail.groups = groups
    tail.size = sum(len(r.text) for r in groups[-1]) if groups else 0
    for r in records:
        if r.type in TABLE_TYPES:
            tail.put(r, len(r.text))
    return tail.groups


def semantic_chunks(records: DataFrame, key: str, order: str, whole: str | None = None) -> DataFrame:
    """(key, order, type, text and, if named, whole) -> (key, order, chunk, place): where each record is translated.

    Without the document's whole text the records' own order is the reading order.
    """
    if whole is None:
        rows = records.select(key, order, "type", "text", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"))
    else:
        rows = positions(records, key, order, "text", whole).select(key, order, "type", "text", "start", "stop")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order)
        t["text"] = t["text"].fillna("")
        found = chunked(list(t.itertuples(index=False)), whole is not None)
        return pd.DataFrame([(getattr(r, key), getattr(r, order), i, k) for i, g in enumerate(found) for k, r in enumerate(g)], columns=[key, order, "chunk", "place"])

    return rows.groupBy(key).applyInPandas(run, f"{key} long, {order} long, chunk int, place int")
