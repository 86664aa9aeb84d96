"""Markdown: blocks, image targets, texts cut to a size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import text

# --- blocks ---------------------------------------------------------------------------------
# A block is a run of lines that no blank line outside a fence interrupts.  What it is shows
# in its first sign, so each sign has one test.

_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_BY_SIGN = {
    **dict.fromkeys("`~", ("code", re.compile(r"`{3}|~{3}"))),
    "#": ("heading", re.compile(r"#{1,6}\s")),
    "|": ("table", re.compile(r"\|.*\|\s*\n\|?\s*:?-{3,}", re.S)),
    ">": ("quote", re.compile(r">")),
    "!": ("image", re.compile(r"!\[[^\]]*\]\([^)]+\)")),
    **dict.fromkeys("$\\", ("formula", re.compile(r"\$\$.*\$\$\Z|\\\[.*\\\]\Z", re.S))),
    **dict.fromkeys("-*+0123456789", ("list", re.compile(r"\s*(?:[-*+]|\d+[.)])\s"))),
}


def _numbered(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(number of the gaps so far, line): a gap is a blank line outside a fence."""
    gaps, fence = 0, ""
    for line in lines:
        if mark := _FENCE.match(line):
            sign = mark[1][0]
            fence = sign if not fence else fence if sign != fence else ""
        gaps += not fence and not line.strip()
        yield gaps, line


def block_kind(block: str) -> str:
    kind, test = _BY_SIGN.get(block.lstrip()[:1], ("paragraph", None))
    if test is None or not test.match(block):
        return "paragraph"
    return kind


def markdown_blocks(source: str) -> list[dict]:
    """index, kind, text, and start and stop in the cleaned text, of every block."""
    source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    source = re.sub(r"\n{4,}", "\n\n\n", re.sub(r"(?m)[ \t]+$", "", source)).strip() + "\n"
    out, at = [], 0
    for _, run in groupby(_numbered(source.split("\n")), key=lambda x: x[0]):
        lines = [line for _, line in run]
        size = sum(len(line) + 1 for line in lines)
        filled = next((i for i, line in enumerate(lines) if line.strip()), None)
        if filled is not None:
            block = "\n".join(lines[filled:]).rstrip()
            start = at + sum(len(line) + 1 for line in lines[:filled])
            out.append({"index": len(out), "kind": block_kind(block), "text": block, "start": start, "stop": start + len(block)})
        at += size
    return out


BLOCK = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])


@F.pandas_udf(T.ArrayType(BLOCK))
def markdown_blocks_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([markdown_blocks(x) for x in texts.fillna("")], dtype=object)


# --- image targets ----------------------------------------------------------------------------

_IMAGE = r"!\[[^\]]*\]\([^)]+\)"


def rewritten_targets(c: Column, resolve: Callable[[Column], Column]) -> Column:
    """The text with every image target replaced by resolve(target), white space around it gone.

    resolve is any Column function: a lookup in a map, a rule, or a UDF.
    """
    marks = F.regexp_extract_all(text(c), F.lit(f"({_IMAGE})"), F.lit(1))
    done = F.transform(marks, lambda m: F.concat(F.regexp_extract(m, r"^(!\[[^\]]*\]\()", 1), resolve(F.trim(F.regexp_extract(m, r"\]\(([^)]+)\)$", 1))), F.lit(")")))
    between = F.split(text(c), _IMAGE, -1)
    return F.array_join(F.transform(F.arrays_zip(between.alias("a"), done.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")


# --- cutting ------------------------------------------------------------------------------------


def split_text(c: Column, limit: int) -> Column:
    """A text in parts of at most `limit` characters, cut at line ends and sentence ends where it can be.

    White space that separates stays with the text, so the parts joined are the text.
    """
    piece = r"(?s)(\n+|(?<=[.!?。！？；;])\s+|.+?(?=\n|(?<=[.!?。！？；;])\s|\z))"
    pieces = F.regexp_extract_all(text(c), F.lit(piece), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def add(s: Column, p: Column) -> Column:
        over = (s["held"] != "") & (F.length(s["held"]) + F.length(p) > limit)
        done = F.when(over, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"])
        held = F.when(over, F.lit("")).otherwise(s["held"])
        full = F.floor((F.length(p) - 1) / limit).cast("int")
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0))), lambda k: F.substr(p, k * limit + 1, F.lit(limit)))
        return F.struct(
            F.when(full > 0, F.concat(done, cuts)).otherwise(done).alias("done"),
            F.when(full > 0, F.substr(p, full * limit + 1)).otherwise(F.concat(held, p)).alias("held"),
        )

    def end(s: Column) -> Column:
        return F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"])))

    whole = F.when(text(c) == "", F.array().cast("array<string>")).otherwise(F.array(text(c)))
    return F.when(F.length(text(c)) <= limit, whole).otherwise(F.aggregate(pieces, start, add, end))
