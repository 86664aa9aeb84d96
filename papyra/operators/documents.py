"""Parsed documents: raw pages of any producer to one form, and that form to pages of lines.

Raw results are JSON of unknown depth, so walking them is one vectorised function; all that
follows (formulas, images, projections, checks) is relational over the blocks it gives.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tex import math_tokens_udf
from ..functions.text import BLOCK_TYPES, TRANSLATABLE_TYPES, fnv32, relative_path, safe_stem, text, without_tex_wrappers
from .sequences import unique_paths

#: Where a raw result keeps its pages, and a page its blocks.
PAGE_KEYS = ["pages", "pdf_info", "layout", "page_info"]
BLOCK_KEYS = ["blocks", "para_blocks", "layout_dets"]
FORMULA_TYPES = ["interline_equation", "inline_equation", "formula"]


def raw_pages(c: Column) -> Column:
    """array of the pages of a raw result, as JSON: the result itself if it is an array, else the first array under PAGE_KEYS.

    What is no object among them is an empty one; text that is no JSON has no pages.
    """
    raw = F.try_parse_json(text(c))
    found = F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), *[F.try_variant_get(raw, f"$.{k}", "array<variant>") for k in PAGE_KEYS], F.expr("array()").cast("array<variant>"))
    return F.transform(found, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.to_json(x)).otherwise("{}"))


# --- normalised blocks ------------------------------------------------------------------------


def _number(value, otherwise=None):
    try:
        x = float(value)
    except (TypeError, ValueError):
        return otherwise
    return x if math.isfinite(x) else otherwise


def _corners(value) -> list[float] | None:
    """x0, y0, x1, y1 of a box given as an array or by names, its corners in order."""
    if isinstance(value, dict):
        value = [value.get(a, value.get(b)) for a, b in (("x0", "left"), ("y0", "top"), ("x1", "right"), ("y1", "bottom"))]
    if not isinstance(value, list) or len(value) < 4:
        return None
    x = [_number(v) for v in value[:4]]
    if None in x:
        return None
    return [min(x[0], x[2]), min(x[1], x[3]), max(x[0], x[2]), max(x[1], x[3])]


def _any(raw: dict, *names: str, otherwise=""):
    """The first of the named values that is filled."""
    return next((raw[n] for n in names if raw.get(n)), otherwise)


def _kind(raw: dict) -> str:
    name = str(_any(raw, "type", "block_type", "category", otherwise="text")).lower()
    name = "_".join(filter(None, name.replace("-", " ").split()))
    return BLOCK_TYPES.get(name, name)


def _code(raw: dict) -> str:
    """The lines of a code block and of those inside it, as they stand."""
    lines, waiting = [], [raw]
    while waiting:
        x = waiting.pop()
        if not isinstance(x, dict):
            continue
        for line in x.get("lines") or []:
            spans = line.get("spans") if isinstance(line, dict) else None
            if isinstance(line, dict):
                lines.append("".join(str(next((s[k] for k in ("content", "text", "value") if s.get(k) is not None), "")) for s in spans or [] if isinstance(s, dict)))
        waiting += reversed(x.get("blocks") or [])
    return "\n".join(lines).strip("\n")


def page_blocks(page: str, place: int) -> dict:
    """A raw page (JSON) -> page, width, height and its blocks, nested ones after what holds them."""
    raw = json.loads(page)
    at = next((raw[k] for k in ("page_idx", "page_index", "page_no", "page") if raw.get(k) is not None), place)
    from_zero = "page_idx" in raw or "page_index" in raw
    number = (0 if _number(at) is None else int(_number(at)) + from_zero) or place + 1
    size = raw.get("page_size") if isinstance(raw.get("page_size"), dict) else {}
    out, waiting = [], [(x, "") for x in reversed(next((raw[k] for k in BLOCK_KEYS if isinstance(raw.get(k), list)), []))]
    while waiting:
        x, parent = waiting.pop()
        if not isinstance(x, dict):
            continue
        kind, order = _kind(x), len(out)
        body = str((_code(x) if kind in ("code", "code_body") else "") or _any(x, "text", "content", "markdown", "html"))
        body = body.replace("\r\n", "\n").replace("\r", "\n")
        formulas = [str((f.get("id") or "") if isinstance(f, dict) else f) for f in next((x[k] for k in ("formula_ids", "formulas") if isinstance(x.get(k), list)), [])]
        block = {
            "id": str(_any(x, "id", "block_id", otherwise=f"p{number}-b{order}")),
            "type": kind,
            "text": body,
            "translated": str(_any(x, "translatedText", "translated_text")),
            "bbox": _corners(_any(x, "bbox", "box", "rect", otherwise=None)),
            "order": order,
            "translatable": kind in TRANSLATABLE_TYPES and bool(body.strip()),
            "image_path": str(_any(x, "image_path", "imagePath", "img_path", "path")),
            "formula_ids": [f for f in formulas if f],
            "reference_ids": [str(r) for r in x["reference_ids"]] if isinstance(x.get("reference_ids"), list) else [],
            "parent_id": str(x.get("parent_id") or parent or x.get("parentID") or ""),
            "code_language": str(_any(x, "guess_lang", "guessLang")),
        }
        out.append(block)
        inner = next((x[k] for k in ("blocks", "children") if isinstance(x.get(k), list)), [])
        waiting += [(y, block["id"]) for y in reversed(inner)]
    return {"page": number, "width": max(1.0, _number(raw.get("width") or size.get("width"), 1000.0)), "height": max(1.0, _number(raw.get("height") or size.get("height"), 1400.0)), "blocks": out}


_S, _A = T.StringType(), T.ArrayType
BLOCK = T.StructType([T.StructField(n, k) for n, k in (("id", _S), ("type", _S), ("text", _S), ("translated", _S), ("bbox", _A(T.DoubleType())), ("order", T.IntegerType()), ("translatable", T.BooleanType()), ("image_path", _S), ("formula_ids", _A(_S)), ("reference_ids", _A(_S)), ("parent_id", _S), ("code_language", _S))])
PAGE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("blocks", _A(BLOCK))])


@F.pandas_udf(PAGE)
def _page_udf(pages: pd.Series, places: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_blocks(p, int(i)) for p, i in zip(pages, places, strict=True)], columns=["page", "width", "height", "blocks"])


def normalised(documents: DataFrame, key: str, raw: str) -> DataFrame:
    """Raw layout results -> a row a block: key, place (of the page, from 0), page, width, height and the fields of BLOCK.

    A formula block without a formula id is given formula-<its id>.
    """
    pages = documents.select(key, F.posexplode(raw_pages(F.col(raw))).alias("place", "_page"))
    rows = pages.select(key, "place", _page_udf("_page", "place").alias("_p")).select(key, "place", "_p.page", "_p.width", "_p.height", F.explode("_p.blocks").alias("_b"))
    rows = rows.select(key, "place", "page", "width", "height", "_b.*")
    formula = F.col("type").isin(FORMULA_TYPES) & (F.trim("text") != "")
    own = F.array(F.coalesce(F.get("formula_ids", F.lit(0)), F.concat(F.lit("formula-"), F.col("id"))))
    return rows.withColumn("formula_ids", F.when(formula, own).otherwise(F.col("formula_ids")))


def formulas(blocks: DataFrame, key: str) -> DataFrame:
    """The formulas of normalised() blocks: key, id, tex, page, bbox, inline."""
    some = blocks.where(F.col("type").isin(FORMULA_TYPES) & (F.trim("text") != ""))
    return some.select(key, F.col("formula_ids")[0].alias("id"), without_tex_wrappers(F.col("text")).alias("tex"), "page", "bbox", (F.col("type") == "inline_equation").alias("inline"))


def page_images(blocks: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Images (key, id, page) with the place of the first page of that number, or null."""
    first = blocks.groupBy(key, "page").agg(F.min("place").alias("place"))
    return images.join(first, [key, "page"], "left")


# --- projection ----------------------------------------------------------------------------------


def estimated_block_lines(value: Column, bbox: Column) -> Column:
    """How many lines a block has by its height, and by its text if that says less."""
    by_text = F.ceil(F.length(text(value)) / F.greatest(F.lit(10.0), (bbox[2] - bbox[0]) / 4.2))
    by_height = F.greatest(F.lit(1), F.floor((bbox[3] - bbox[1]) / 9 + 0.5))
    return F.greatest(F.lit(1), F.least(by_height, F.when(by_text == 0, 1).otherwise(by_text))).cast("int")


def projected(blocks: DataFrame, key: str) -> DataFrame:
    """normalised() blocks -> a row a page: key, place, page_size and its blocks with lines and spans, in order.

    A formula block is one display span of its TeX; others are spans of text and inline
    formulas.  A block that has an id twice in its document, or no box, or an empty one, is
    an error, as it would be drawn wrongly.
    """
    per_id = Window.partitionBy(key, "id")
    box = F.col("bbox")
    checked = blocks.withColumn("_n", F.count("*").over(per_id))
    good = (F.col("_n") == 1) & (F.col("id") != "") & F.coalesce((box[2] > box[0]) & (box[3] > box[1]), F.lit(False))
    checked = checked.withColumn("_ok", F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("a block without an own id or box: "), F.col("id"))).cast("boolean")))
    spans = F.when(F.col("type").isin("interline_equation", "formula"), F.array(F.struct(F.lit("interline_equation").alias("type"), without_tex_wrappers(F.col("text")).alias("content")))).otherwise(
        F.transform(math_tokens_udf("text"), lambda t: F.when(t["kind"] == "math", F.struct(F.lit("inline_equation").alias("type"), t["tex"].alias("content"))).otherwise(F.struct(F.lit("text").alias("type"), t["text"].alias("content"))))
    )
    block = F.struct("order", "id", "type", "bbox", "translatable", estimated_block_lines(F.col("text"), box).alias("lines"), spans.alias("spans"))
    rows = checked.where("_ok").select(key, "place", "width", "height", block.alias("b"))
    return rows.groupBy(key, "place").agg(F.array(F.first("width"), F.first("height")).alias("page_size"), F.array_sort(F.collect_list("b")).alias("blocks"))


# --- archives --------------------------------------------------------------------------------------


def safe_path(path: Column) -> Column:
    """A relative path of safe names without . and .. steps, or null where .. leaves the root or nothing is left."""
    return F.array_join(F.transform(F.split(relative_path(path), "/"), lambda x: safe_stem(x, "entry", 120)), "/")


def shortened(path: Column, most: int) -> Column:
    """A path of at most `most` characters: a long one keeps its last two folders, or none, and has its hash."""
    parts = F.split(path, "/")
    file, h = F.element_at(parts, -1), fnv32(path)
    stem, dot = F.regexp_extract(file, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(file, r"^.+(\.[^.]*)$", 1)
    name = F.concat(safe_stem(stem, "file", 48), F.lit("_"), h, F.left(dot, F.lit(16)))
    folders = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.least(F.size(parts) - 1, F.lit(2)))
    compact = F.array_join(F.concat(F.transform(folders, lambda x: safe_stem(x, "dir", 36)), F.array(name)), "/")
    return F.when(F.length(path) <= most, path).when(F.length(compact) <= most, compact).otherwise(F.concat(h, F.lit("/"), name))


def extraction_plan(entries: DataFrame, archive: str, order: str, most_files: int = 20_000, most_bytes: int = 4 << 30, most_path: int = 220) -> DataFrame:
    """entries (archive, order, name, directory, size) -> files with relative_path, and error where an archive is refused.

    Names are made safe, the folder that all share is dropped, long paths are shortened and
    what is left alike (case aside) is numbered.  An archive is refused whole: over
    most_files files, over most_bytes unpacked, or with a path that leaves it or is empty.
    """
    every = Window.partitionBy(archive)
    files = entries.where("NOT directory").withColumn("_path", safe_path(F.col("name")))
    bad = F.max(F.col("_path").isNull()).over(every)
    files = files.withColumn("error", F.when(F.count("*").over(every) > most_files, "too many files").when(F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).over(every) > most_bytes, "too many bytes").when(bad, "unsafe path"))
    low, high = F.split(F.min("_path").over(every), "/"), F.split(F.max("_path").over(every), "/")
    files = files.withColumn("_low", low).withColumn("_high", high)
    agree = F.filter(F.sequence(F.lit(0), F.least(F.size("_low"), F.size("_high"))), lambda n: F.slice("_low", F.lit(1), n) == F.slice("_high", F.lit(1), n))
    files = files.withColumn("_n", F.array_max(agree))
    parts = F.split("_path", "/")
    files = files.withColumn("_least", F.min(F.size(parts)).over(every))  # where a file is the shared prefix itself, nothing is dropped
    within = F.when(F.col("_least") > F.col("_n"), F.array_join(F.slice(parts, F.col("_n") + 1, F.size(parts)), "/")).otherwise(F.col("_path"))
    files = files.withColumn("_short", shortened(within, most_path))
    named = unique_paths(files.withColumnRenamed("name", "source_name"), archive, order, "_short")
    return named.select(archive, order, "source_name", F.when(F.col("error").isNull(), F.col("name")).alias("relative_path"), "error")
