"""The layout solver's rules: what is body text, which column it stands in, and repairs of lines.

Boxes are four columns x0, y0, x1, y1 on rows that have a page (and document).  Rules that
look at pairs meet them by page; a page's boxes are few, so no pair leaves its page.  The few
rules whose result feeds back into the next pair are one fold a page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, text
from . import folds

# --- what a text is -----------------------------------------------------------------------------

#: How lines of metadata begin, and what they hold.
METADATA_LABELS = ["pacs", "keyword", "keywords", "doi"]
METADATA_LABELS_CJK = ["关键词", "关键字", "数字对象标识符"]
METADATA_STARTS = ["pacs numbers", "published under an exclusive license", "cite as:", "citation:", "submitted:", "accepted:", "published online:", "online publication:", "authors to whom correspondence", "author to whom correspondence"]
METADATA_PARTS = ["all rights reserved", "elsevier", "copyright"]
PROSE_STARTS = ["articles you may be interested in", "citation:", "view online:", "view table of contents:", "published by "]


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def metadata_like(c: Column) -> Column:
    """A line about a publication (keywords, identifiers, rights, dates), not of it."""
    t = strip(F.regexp_replace(text(c), r"\s+", " "))
    low = F.lower(t)
    labels = rf"^(?:{'|'.join(METADATA_LABELS)}|pacs\s*(?:编号|号|分类号|代码|编码)|{'|'.join(METADATA_LABELS_CJK)})\s*[:：]|^(?:©|\(c\)|ⓒ)"
    return low.rlike(labels) | _any([low.startswith(x) for x in METADATA_STARTS]) | _any([low.contains(x) for x in METADATA_PARTS])


def prose_like(c: Column, side: Column, top: Column, height: Column, lines: Column, page_height: Column) -> Column:
    """Running text: in a column, not at the page's head, of some lines, with words and sentences enough."""
    t = strip(F.regexp_replace(text(c), r"\s+", " "))
    low = F.lower(t)
    placed = side.isin("left", "right") & (top >= page_height * 0.25) & ((lines >= 2) | (height > page_height * 0.025))
    sentences = F.regexp_count(t, F.lit("[.!?。！？]"))
    latin = (F.regexp_count(t, F.lit("[A-Za-z][A-Za-z'-]{2,}")) >= 32) & (F.length(t) >= 180)
    han = F.regexp_count(t, F.lit(r"[\x{3400}-\x{9fff}]")) >= 80
    return (t != "") & ~metadata_like(c) & ~_any([low.startswith(x) for x in PROSE_STARTS]) & ~low.rlike(r"https?://|www\.") & placed & (sentences >= 2) & (latin | han)


# --- boxes ------------------------------------------------------------------------------------------


def _wide() -> Column:
    return F.col("x1") - F.col("x0")


def _high() -> Column:
    return F.col("y1") - F.col("y0")


def quads_overlap(a: Column, b: Column) -> Column:
    """Whether two quadrilaterals (arrays of four [x, y]) overlap: no edge's normal, of the two first edges of each, parts them.

    Touching is no overlap; other than four corners overlap nothing.
    """
    def normals(q: Column) -> Column:
        return F.filter(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.array(-(q[i + 1][1] - q[i][1]), q[i + 1][0] - q[i][0])), lambda n: (n[0] != 0) | (n[1] != 0))

    def span(q: Column, n: Column) -> Column:
        return F.transform(q, lambda p: p[0] * n[0] + p[1] * n[1])

    meets = lambda n: (F.array_max(span(a, n)) > F.array_min(span(b, n))) & (F.array_max(span(b, n)) > F.array_min(span(a, n)))
    return F.when((F.size(a) == 4) & (F.size(b) == 4), F.forall(F.concat(normals(a), normals(b)), meets)).otherwise(False)


def quad(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def shrunk(q: Column, factor: float = 0.8) -> Column:
    """A quadrilateral drawn towards its centre."""
    mean = lambda k: (q[0][k] + q[1][k] + q[2][k] + q[3][k]) / 4
    return F.transform(q, lambda p: F.array(mean(0) + (p[0] - mean(0)) * factor, mean(1) + (p[1] - mean(1)) * factor))


# --- columns ------------------------------------------------------------------------------------------


def column_keys(boxes: DataFrame, page: str, page_width: float) -> DataFrame:
    """column_key: column-<k> of the nearest anchor, full for boxes over 82 % of the page.

    Anchors are left edges of boxes of 12 to 82 % of the page, met from left to right: an
    edge within the tolerance of the last anchor draws it half way, another begins a new one.
    The tolerance is 8 % of those boxes' median width, from 8 to 20.
    """
    fit = (_wide() >= page_width * 0.12) & (_wide() <= page_width * 0.82)
    edges = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.when(fit, F.col("x0").cast("double")))).alias("_e"), F.median(F.when(fit, _wide())).alias("_m"))
    near = F.greatest(F.lit(8.0), F.least(F.lit(20.0), F.col("_m") * 0.08))

    def anchor(s: Column, x: Column) -> Column:
        last = F.element_at(s, -1)
        return F.when((F.size(s) == 0) | (F.abs(x - last) > near), F.concat(s, F.array(x))).otherwise(F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array((last + x) / 2)))

    anchors = edges.select(page, F.aggregate("_e", F.array().cast("array<double>"), anchor).alias("_a"))
    away = F.transform("_a", lambda a, i: F.struct(F.abs(F.col("x0") - a).alias("d"), i.alias("i")))
    nearest = F.concat(F.lit("column-"), F.array_min(away)["i"].cast("string"))
    joined = boxes.join(anchors, page, "left")
    return joined.withColumn("column_key", F.when((F.size("_a") == 0) | (_wide() > page_width * 0.82), "full").otherwise(nearest)).drop("_a")


def matches_column(anchor: str = "_") -> Column:
    """Whether a box lines up with an anchor box (columns with this prefix): both edges, or the left one and wide enough inside."""
    a = lambda n: F.col(anchor + n)
    wide = a("x1") - a("x0")
    near = F.greatest(F.lit(18.0), wide * 0.08)
    left = F.abs(F.col("x0") - a("x0")) <= near
    return left & ((F.abs(F.col("x1") - a("x1")) <= near) | ((F.col("x1") <= a("x1") + near) & (_wide() >= wide * 0.45)))


def promoted(boxes: DataFrame, page: str, page_width: float, page_height: float) -> DataFrame:
    """promoted: whether a box (with column_key, candidate and lines) is body text of its column.

    Candidates of several lines, high or wide ones, are; others are where they line up with
    such a seed of the same column.
    """
    seed = F.col("candidate") & ((F.col("lines") > 1) | (_high() > page_height * 0.035) | (_wide() > page_width * 0.48))
    rows = boxes.withColumn("_seed", seed)
    seeds = rows.where(F.col("_seed") & (F.col("column_key") != "full")).select(F.col(page).alias("_page"), F.col("column_key").alias("_key"), *[F.col(x).alias(f"_{x}") for x in ("x0", "x1")])
    lined = rows.where(~F.col("_seed")).join(seeds, (F.col(page) == F.col("_page")) & (F.col("column_key") == F.col("_key")) & matches_column(), "left_semi")
    hits = lined.select(page, "box", F.lit(True).alias("_lined"))
    return rows.join(hits, [page, "box"], "left").withColumn("promoted", F.col("_seed") | F.col("_lined").isNotNull()).drop("_seed", "_lined")


#: What a page's single column is known by, as shares of the page, and how far edges may stray.
SINGLE = {"wide": 0.72, "high": 0.025, "lines": 3, "left": 0.045, "right": 0.055, "short": 0.20}


def single_column(boxes: DataFrame, profiles: DataFrame, document: str, page: str, page_width: float, page_height: float) -> DataFrame:
    """role: body where a box has the document's column (left and right as shares of the page); inherited where a short one stands in it.

    boxes: (document, page, x0..y1, lines); profiles: (document, left, right), at most one a
    document.  A short box inherits on pages that have a body box and no lanes side by side,
    after the first page.  Other boxes have no role.
    """
    rows = boxes.join(profiles.select(document, F.col("left").alias("_l"), F.col("right").alias("_r")), document, "left")
    near = F.abs(F.col("x0") / page_width - F.col("_l")) <= SINGLE["left"]
    body = near & (F.abs(F.col("x1") / page_width - F.col("_r")) <= SINGLE["right"]) & (F.col("lines") >= SINGLE["lines"]) & (_high() / page_height >= SINGLE["high"]) & (_wide() / page_width >= SINGLE["wide"])
    rows = rows.withColumn("_body", F.coalesce(body, F.lit(False)))
    anchored = F.max("_body").over(Window.partitionBy(document, page))
    lane = (F.col("lines") >= SINGLE["lines"]) & (_wide() / page_width).between(0.18, 0.72) & (_high() / page_height >= SINGLE["high"])
    lanes = rows.where(lane).select(document, page, "x0", "y0", "x1", "y1")
    a, b = lanes.alias("a"), lanes.alias("b")
    over = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    low = F.least(F.col("a.y1") - F.col("a.y0"), F.col("b.y1") - F.col("b.y0"))
    beside = a.join(b, (F.col(f"a.{document}") == F.col(f"b.{document}")) & (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("b.x0") - F.col("a.x1") >= page_width * 0.035) & (low > 0) & (over >= low * 0.2))
    beside = beside.select(F.col(f"a.{document}").alias(document), F.col(f"a.{page}").alias(page), F.lit(True).alias("_lanes")).distinct()
    rows = rows.withColumn("_anchored", anchored).join(beside, [document, page], "left")
    inside = near & (F.col("x1") / page_width <= F.col("_r") + SINGLE["right"]) & (_wide() >= F.greatest(F.lit(1.0), (F.col("_r") - F.col("_l")) * page_width) * SINGLE["short"])
    short = F.col("lines").isin(1, 2) & F.col("_anchored") & F.col("_lanes").isNull() & (F.col(page) > 0) & F.coalesce(inside, F.lit(False))
    return rows.withColumn("role", F.when(F.col("_body"), "body").when(short, "inherited")).drop("_l", "_r", "_body", "_anchored", "_lanes")


def equation_dense(boxes: DataFrame, equations: DataFrame, page: str, page_height: float, most_lines: int = 4, reach: float = 28.0) -> DataFrame:
    """dense: short boxes with an equation close above and one close below, each over 35 % of the narrower one's width."""
    e = equations.select(F.col(page).alias("_page"), *[F.col(x).alias(f"_{x}") for x in ("x0", "y0", "x1", "y1")])
    small = (F.col("lines") <= most_lines) & (_high() <= max(54.0, page_height * 0.07))
    shared = F.least("x1", "_x1") - F.greatest("x0", "_x0") >= 0.35 * F.least(_wide(), F.col("_x1") - F.col("_x0"))
    near = lambda gap: gap.between(0, reach)
    above, below = near(F.col("y0") - F.col("_y1")), near(F.col("_y0") - F.col("y1"))
    hits = boxes.where(small).join(e, (F.col(page) == F.col("_page")) & shared & (above | below)).groupBy(page, "box").agg((F.max(above) & F.max(below)).alias("dense"))
    return boxes.join(hits, [page, "box"], "left").withColumn("dense", F.coalesce("dense", F.lit(False)))


def retreated(streams: DataFrame, page: str) -> DataFrame:
    """Streams (page, stream, column_key, x0..y1) with x0 and x1 drawn back where streams of two columns overlap.

    Pairs are met in the streams' order and share the middle of what both claim, if each
    keeps 20; a boundary once moved counts for the pairs after it, so a page is one fold.
    The n-th pairs of all pages with as many streams are one step.
    """
    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        x0, x1, top, bottom = (np.array(folds.numbers(t, c)) for c in ("x0", "x1", "y0", "y1"))
        keys = t.column("column_key").combine_chunks().dictionary_encode()
        known = np.array([bool(k) and k != "full" for k in keys.dictionary.to_pylist()] + [False])
        keys = keys.indices.fill_null(-1).to_numpy()
        some = np.flatnonzero(known[keys])
        page = np.searchsorted(starts, some, "right")
        new = np.flatnonzero(np.diff(page, prepend=-1))
        for m, at in folds.alike(np.diff(np.append(new, len(some))), new):
            for n in range(m):
                for k in range(n + 1, m):
                    i, j = some[at[:, n]], some[at[:, k]]
                    first = x0[i] <= x0[j]
                    a, b = np.where(first, i, j), np.where(first, j, i)
                    middle = (x1[a] + x0[b]) / 2
                    over = (keys[i] != keys[j]) & (np.minimum(bottom[i], bottom[j]) - np.maximum(top[i], top[j]) > 2) & (x1[a] > x0[b])
                    over &= (middle - x0[a] >= 20) & (x1[b] - middle >= 20)
                    x1[a[over]] = x0[b[over]] = middle[over]
        for c, x in (("x0", x0), ("x1", x1)):
            t = t.set_column(columns.index(c), c, pa.array(x, from_pandas=True))
        return t

    columns = [page, "stream", "column_key", "x0", "y0", "x1", "y1"]
    kinds = {f.name: f.dataType.simpleString() for f in streams.schema}
    return folds.folded(streams.select(columns), page, [F.asc_nulls_last("stream")], run, ", ".join(f"{c} {'double' if c in ('x0', 'x1') else kinds[c]}" for c in columns))


# --- lines --------------------------------------------------------------------------------------------


def collapsed_lines(blocks: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """(page, block, rows): of text blocks said to be one line, how many rows the recognised lines in them make, if over one.

    Lines whose centre lies in the block are met from the top; one whose middle lies in a
    row met before belongs to it.
    """
    b = blocks.where((F.col("type") == "text") & (F.col("lines") == 1)).select(F.col(page).alias("_page"), "block", *[F.col(x).alias(f"_{x}") for x in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = lines.join(b, F.col(page) == F.col("_page")).where(cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0"), F.col("_y1")))
    rows = inside.groupBy(page, "block").agg(F.array_sort(F.collect_list(F.struct((F.col("y0") + F.col("y1")).alias("s"), F.col("line").alias("k"), F.col("y0").alias("a"), F.col("y1").alias("b")))).alias("_r"))
    empty = F.array().cast("array<struct<a:double,b:double>>")
    kept = F.aggregate("_r", empty, lambda s, r: F.when(F.exists(s, lambda x: (r["s"] / 2 >= x["a"]) & (r["s"] / 2 <= x["b"])), s).otherwise(F.concat(s, F.array(F.struct(r["a"].cast("double").alias("a"), r["b"].cast("double").alias("b"))))))
    return rows.select(page, "block", F.size(kept).alias("rows")).where("rows > 1")


def first_line_indents(blocks: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """(page, block, indent): how far a block's first line begins right of the median of the others; 0 under 5, at most 18 % of its width or 10.

    A block of under three recognised lines has none.  Lines within 0.55 of the median
    height (2.5 to 6) of the highest centre are the first.
    """
    b = blocks.select(F.col(page).alias("_page"), "block", *[F.col(x).alias(f"_{x}") for x in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = lines.join(b, F.col(page) == F.col("_page")).where(cx.between(F.col("_x0") - 1.5, F.col("_x1") + 1.5) & cy.between(F.col("_y0") - 1.5, F.col("_y1") + 1.5)).withColumn("_c", cy)
    every = Window.partitionBy(page, "block")
    inside = inside.withColumn("_top", F.min("_c").over(every)).withColumn("_n", F.count("*").over(every)).withColumn("_h", F.median(_high()).over(every))
    first = F.abs(F.col("_c") - F.col("_top")) <= F.greatest(F.lit(2.5), F.least(F.lit(6.0), F.col("_h") * 0.55))
    sums = inside.where("_n >= 3").groupBy(page, "block").agg((F.min(F.when(first, F.col("x0"))) - F.median(F.when(~first, F.col("x0")))).alias("_i"), F.first(F.col("_x1") - F.col("_x0")).alias("_w"))
    some = F.when(F.col("_i") >= 5, F.round(F.least(F.col("_i"), F.greatest(F.lit(10.0), F.col("_w") * 0.18)), 2))
    return b.select(F.col("_page").alias(page), "block").join(sums.select(page, "block", some.alias("indent")), [page, "block"], "left").withColumn("indent", F.coalesce("indent", F.lit(0.0)))


def glossary_blocks(lines: DataFrame, page: str) -> DataFrame:
    """(page, block, glossary): whether a text block is a list of symbols and what they mean.

    lines: (page, block, line, spans), spans arrays of (type, content, x0, x1).  Of eight
    filled lines or more, four in five begin with a symbol (a formula of at most 64 signs or
    one letter) and go on with a text 16 or more to the right, behind it; symbols and texts
    begin within 14 and 20.
    """
    spans = F.filter("spans", lambda s: F.trim(s["content"]) != "")
    rows = lines.select(page, "block", spans.alias("s")).where("size(s) > 0")
    head, kind = F.col("s")[0], F.lower(F.col("s")[0]["type"])
    symbol = (kind.rlike("equation|formula") & (F.length(F.trim(head["content"])) <= 64)) | ((kind == "text") & F.trim(head["content"]).rlike(r"^[A-Za-zΑ-ω]$"))
    rest = F.get(F.filter(F.slice("s", F.lit(2), F.size("s")), lambda s: F.lower(s["type"]) == "text"), F.lit(0))
    hit = F.coalesce(symbol & (rest["x0"] - head["x0"] >= 16) & (rest["x0"] >= head["x1"]), F.lit(False))
    rows = rows.select(page, "block", hit.alias("hit"), head["x0"].alias("a"), rest["x0"].alias("b"))
    spread = lambda c: F.max(F.when(F.col("hit"), F.col(c))) - F.min(F.when(F.col("hit"), F.col(c)))
    found = (F.count("*") >= 8) & (F.count_if("hit") * 5 >= F.count("*") * 4) & (spread("a") <= 14) & (spread("b") <= 20)
    return rows.groupBy(page, "block").agg(F.coalesce(found, F.lit(False)).alias("glossary"))


def rotated_words(lines: DataFrame, page: str) -> DataFrame:
    """Lines (page, line, text, rotation, score, x0..y1) with single rotated words that stand over one another joined.

    In their order, words take the first one above them (its end within 0.6 of their width of
    the word's start, over 70 % of the narrower one's width).  A joined line is no single word
    any more, so a page is one fold; the n-th words of all pages with as many are one step.
    """
    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        x0, y0, x1, y1 = (folds.numbers(t, c) for c in ("x0", "y0", "x1", "y1"))
        word = pc.ascii_is_alpha(t.column("text")).fill_null(False).to_numpy() & (folds.numbers(t, "rotation") == -90)
        some = np.flatnonzero(word)
        page = np.searchsorted(starts, some, "right")
        new = np.flatnonzero(np.diff(page, prepend=-1))
        free, pairs = word, [np.zeros((2, 0), np.int64)]
        for m, at in folds.alike(np.diff(np.append(new, len(some))), new):
            if m == 1:
                continue
            for n in range(m):
                r = some[at[:, n]]
                found = np.full(len(r), -1)
                for k in range(m):
                    o = some[at[:, k]]
                    wide = np.minimum(x1[r] - x0[r], x1[o] - x0[o])
                    over, gap = np.minimum(x1[r], x1[o]) - np.maximum(x0[r], x0[o]), y0[r] - y1[o]
                    fit = (found < 0) & free[r] & free[o] & (k != n) & (over >= wide * 0.7) & (gap >= -0.002) & (gap <= wide * 0.6)
                    found[fit] = o[fit]
                pairs.append(np.stack((r, found))[:, found >= 0])
                free[pairs[-1].ravel()] = False
        pairs = np.concatenate(pairs, axis=1)
        r, o = pairs[:, np.argsort(pairs[0])]
        if not len(r):
            return t
        joined, kept = np.zeros(len(t), bool), np.ones(len(t), bool)
        joined[r], kept[o] = True, False
        low, high = t.take(r), t.take(o)
        put = {"text": pc.binary_join_element_wise(low.column("text"), high.column("text"), " "), "y0": high.column("y0")}
        put |= {c: pc.min_element_wise(low.column(c), high.column(c), skip_nulls=False) for c in ("score", "x0")}
        put["x1"] = pc.max_element_wise(low.column("x1"), high.column("x1"), skip_nulls=False)
        for c, values in put.items():
            t = t.set_column(columns.index(c), c, pc.replace_with_mask(t.column(c).combine_chunks(), pa.array(joined), values.combine_chunks()))
        return t.filter(pa.array(kept))

    columns = [page, "line", "text", "rotation", "score", "x0", "y0", "x1", "y1"]
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    return folds.folded(lines.select(columns), page, [F.asc_nulls_last("line")], run, ", ".join(f"{c} {kinds[c]}" for c in columns))


# --- style ----------------------------------------------------------------------------------------------

#: For body text and for references, how wide a sign is in font sizes, the least and largest
#: font, how far it may be stretched, line ratios (factor, least, most) and gaps between paragraphs tried.
BODY_STYLE = {"sign": 0.45, "fonts": (7.2, 10.6), "stretch": 1.5, "ratios": [(1.0, 0.0, 9.0), (0.95, 1.03, 9.0), (1.02, 0.0, 1.18), (0.98, 1.02, 9.0)], "gaps": [0.12, 0.16, 0.20]}
REFERENCE_STYLE = {"sign": 0.47, "fonts": (6.9, 8.8), "stretch": 1.4, "ratios": [(1.0, 0.0, 9.0), (0.96, 1.0, 9.0), (1.02, 0.0, 1.18)], "gaps": [0.10]}


class Streams:
    """The text streams of a document that one style must fit: boxes, and their paragraphs' lengths and indents."""

    def __init__(self, widths, heights, paragraphs, sign: float):
        self.heights, self.sign = np.array(heights, float), sign
        self.widths = np.maximum(12.0, np.array(widths, float))
        self.stream = np.repeat(np.arange(len(widths)), [len(p) for p in paragraphs])
        self.lengths = np.array([n for p in paragraphs for n, _ in p], float)
        self.indents = np.array([i for p in paragraphs for _, i in p], float)
        self.breaks = np.maximum(0, np.bincount(self.stream[self.lengths > 0], minlength=len(widths)) - 1)

    def used(self, font: float, ratio: float, gap: float) -> np.ndarray:
        """The height that each stream's text takes."""
        sign = max(1.0, font * self.sign)
        full = np.maximum(6.0, self.widths / sign)[self.stream]
        first = np.maximum(4.0, (self.widths[self.stream] - self.indents) / sign)
        more = np.where(self.lengths > first, np.floor((self.lengths - first + full - 1) / full), 0)
        lines = np.bincount(self.stream, np.where(self.lengths > 0, 1 + more, 0), len(self.widths))
        return lines * font * ratio + self.breaks * gap * font

    def fit(self, font: float, ratio: float, gap: float) -> bool:
        return bool((self.used(font, ratio, gap) <= self.heights).all())


def uniform_style(streams: Streams, font: float, ratio: float, style: dict, band: float) -> tuple[float, float]:
    """(font, line ratio) that fill the streams best: the least filled one counts most, then all, then a large font.

    For each ratio and gap of a small grid the largest font that fits is found by halving,
    and grows on, a fifth at a time, while every stream has more than `band` free below.
    """
    low, high = style["fonts"]
    best, found = -np.inf, (round(min(max(font, low), high), 2), round(ratio, 3))
    for r in sorted({round(min(max(ratio * f, a), b), 3) for f, a, b in style["ratios"]}):
        for gap in style["gaps"]:
            size, a, b = min(max(font, low), high), low, max(font, min(high, font * style["stretch"]))
            for _ in range(22):
                middle = (a + b) / 2
                if streams.fit(middle, r, gap):
                    size = a = middle
                else:
                    b = middle
            while size < high and (streams.heights - streams.used(size, r, gap)).clip(min=0).min() > band and streams.fit(min(high, size + 0.2), r, gap):
                size = min(high, size + 0.2)
            fill = np.minimum(1.0, streams.used(size, r, gap) / np.maximum(1.0, streams.heights))
            score = fill.min() * 2000 + fill.mean() * 260 + size * 20 - r * 4 - gap * 3
            if score > best:
                best, found = score, (round(size, 2), r)
    return found


def uniform_styles(streams: DataFrame, document: str, references: bool = False, page_height: float = 792.0) -> DataFrame:
    """(document, stream, width, height, font, ratio, paragraphs) -> (document, font, ratio): one style for all its streams.

    paragraphs: arrays of (length, indent); font and ratio: what the stream was measured to
    have, whose medians the search begins from.  A document is one search over its streams.
    """
    style = REFERENCE_STYLE if references else BODY_STYLE

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("stream")
        own = Streams(t["width"], t["height"], [[(p["length"], 0.0 if references else p["indent"]) for p in ps] for ps in t["paragraphs"]], style["sign"])
        font, ratio = uniform_style(own, float(t["font"].median()), float(t["ratio"].median()), style, max(6.0, page_height * 0.02))
        return pd.DataFrame([(t[document].iloc[0], font, ratio)], columns=[document, "font", "ratio"])

    return streams.groupBy(document).applyInPandas(run, f"{document} long, font double, ratio double")
