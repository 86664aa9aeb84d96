"""Parsers of bibliographic and streamed texts into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import doi, strip, text


def bibtex_entries(c: Column) -> Column:
    """array of (type, key, fields): a map of lower-case names to values without braces."""
    p = r"(?is)@([a-z]+)\s*\{\s*([^,]+),(.*?)\}(?=\s*@|\s*$)"
    part = lambda n: F.regexp_extract_all(text(c), F.lit(p), F.lit(n))
    q = r"(?s)([A-Za-z][\w-]*)\s*=\s*(?:\{(.*?)\}(?=\s*(?:,|$))|\"(.*?)\"|([^,\n{\"]+))"

    def fields(body: Column) -> Column:
        got = lambda n: F.regexp_extract_all(body, F.lit(q), F.lit(n))
        value = F.transform(F.arrays_zip(got(2).alias("a"), got(3).alias("b"), got(4).alias("c")), lambda x: F.regexp_replace(strip(F.concat(x["a"], x["b"], x["c"])), r"[{}]", ""))
        return F.map_from_arrays(F.transform(got(1), lambda x: F.lower(x)), value)

    zipped = F.arrays_zip(part(1).alias("type"), part(2).alias("key"), part(3).alias("body"))
    return F.transform(zipped, lambda x: F.struct(F.lower(x["type"]).alias("type"), strip(x["key"]).alias("key"), fields(x["body"]).alias("fields")))


CSL = "array<struct<title:string,DOI:string,URL:string,type:string,`container-title`:string,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<literal:string,given:string,family:string>>,volume:string,issue:string,page:string,publisher:string>>"


def csl_items(c: Column) -> Column:
    """array of records of a CSL-JSON array (or single object)."""
    array = F.when(text(c).rlike(r"^\s*\["), text(c)).otherwise(F.concat(F.lit("["), text(c), F.lit("]")))
    names = lambda authors: F.filter(F.transform(F.coalesce(authors, F.array()), lambda a: F.coalesce(F.nullif(F.trim(text(a["literal"])), F.lit("")), F.trim(F.concat_ws(" ", a["given"], a["family"])))), lambda n: n != "")
    rows = F.from_json(array, CSL)
    return F.transform(
        rows,
        lambda r: F.struct(
            F.trim(text(r["title"])).alias("title"),
            doi(r["DOI"], keep_case=True).alias("doi"),
            F.coalesce(F.nullif(F.trim(text(r["type"])), F.lit("")), F.lit("article-journal")).alias("type"),
            F.trim(text(r["container-title"])).alias("container_title"),
            F.get(F.get(r["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("issued"),
            names(r["author"]).alias("author"),
        ),
    )


def atom_entries(c: Column) -> Column:
    """array of (id, title, published, authors) of an Atom feed."""
    tag = lambda body, name: strip(F.regexp_replace(F.regexp_replace(F.regexp_extract(body, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"\s+", " "))
    entries = F.regexp_extract_all(text(c), F.lit(r"(?is)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))
    return F.transform(entries, lambda e: F.struct(tag(e, "id").alias("id"), tag(e, "title").alias("title"), tag(e, "published").alias("published"), F.regexp_extract_all(e, F.lit(r"(?is)<name>\s*(.*?)\s*</name>"), F.lit(1)).alias("authors")))


def sse_frames(c: Column) -> Column:
    """array of (event, data) of a server-sent event text; frames without data are left out."""
    norm = F.regexp_replace(text(c), r"\r\n?", "\n")

    def frame(raw: Column) -> Column:
        lines = F.split(raw, "\n")
        events = F.filter(lines, lambda x: x.startswith("event:"))
        data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substr(x, F.lit(6))))
        name = F.trim(F.substr(F.coalesce(F.get(events, F.size(events) - 1), F.lit("event:")), F.lit(7)))
        return F.struct(F.coalesce(F.nullif(name, F.lit("")), F.lit("message")).alias("event"), F.size(data).alias("n"), F.array_join(data, "\n").alias("data"))

    frames = F.filter(F.transform(F.split(norm, r"\n\n+"), frame), lambda f: f["n"] > 0)
    return F.transform(frames, lambda f: F.struct(f["event"].alias("event"), f["data"].alias("data")))


def ocr_pages(c: Column) -> Column:
    """array of page texts of an OCR result: one JSON object, or a line each."""
    body = F.regexp_replace(text(c), "^﻿", "")
    schema = "struct<errorCode:int,result:struct<layoutParsingResults:array<string>>>"
    whole = F.from_json(body, schema)
    filled = F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "")
    by_line = (F.size(filled) > 1) & F.forall(filled, lambda x: F.trim(x).rlike(r"^\{.*\}$"))
    rows = F.when(by_line, F.transform(filled, lambda x: F.from_json(x, schema))).otherwise(F.array(whole))
    good = F.filter(rows, lambda r: F.coalesce(r["errorCode"], F.lit(0)) == 0)
    return F.flatten(F.transform(good, lambda r: F.coalesce(r["result"]["layoutParsingResults"], F.array().cast("array<string>"))))


def usage(c: Column) -> Column:
    """Token counters of a model's usage JSON, whatever its names are."""
    def first(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(text(c), f"$.{p}").try_cast("long") for p in paths], F.lit(0).cast("long"))

    i, o = first("input_tokens", "total_input_tokens", "prompt_tokens", "inputTokenCount"), first("output_tokens", "total_output_tokens", "completion_tokens", "outputTokenCount")
    total = first("total_tokens", "totalTokenCount")
    return F.struct(i.alias("input"), o.alias("output"), F.when(total > 0, total).otherwise(i + o).alias("total"), first("cached_input_tokens", "total_cached_tokens", "prompt_tokens_details.cached_tokens").alias("cached"), first("reasoning_tokens", "total_thought_tokens", "completion_tokens_details.reasoning_tokens").alias("reasoning"))


def message_text(parts: Column, images: str | None = None) -> Column:
    """The text of a message of many parts (type, text, url); images is shown for others if given."""
    shown = F.transform(parts, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(images)))
    return F.trim(F.array_join(F.filter(shown, lambda x: x.isNotNull()), "\n"))


def candidates(records: DataFrame, source: str) -> DataFrame:
    """Provider records (title, doi, arxiv, pmid, year, venue, abstract, citations, open_access) as one schema."""
    filled = lambda n: F.trim(text(F.col(n)))
    key = F.coalesce(F.nullif(doi(F.col("doi")), F.lit("")), F.nullif(filled("arxiv"), F.lit("")), F.nullif(filled("pmid"), F.lit("")), F.concat(F.lit(source + ":"), F.lower(filled("title"))))
    return records.select(
        key.alias("candidate_id"),
        filled("title").alias("title"),
        F.col("year").cast("int").alias("year"),
        filled("venue").alias("venue"),
        F.struct(doi(F.col("doi")).alias("doi"), F.lower(filled("arxiv")).alias("arxiv"), filled("pmid").alias("pmid")).alias("identifiers"),
        filled("abstract").alias("abstract"),
        F.coalesce(F.col("citations"), F.lit(0)).cast("long").alias("citations"),
        F.coalesce("open_access", F.lit(False)).alias("open_access"),
        F.array(F.lit(source)).alias("sources"),
    )
