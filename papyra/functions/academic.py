"""Conventions of papers in their translation: citation marks and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

#: Words after which a number behind a point or comma is a citation.
CITING_WORDS = ["and", "or", "with", "thereby", "while", "including", "contraction", "collapse", "investigat(?:e|ed|es|ing)", r"investi-\s*gating", "as", "stud(?:y|ied|ies)", "report(?:ed|s)?", "demonstrat(?:e|ed|es|ing)", "show(?:ed|s)?", "observ(?:e|ed|es|ing)", "analy[sz](?:e|ed|es|ing)"]
#: Headings and their Chinese.
HEADINGS = {
    "ABSTRACT": "摘要", "AFFILIATIONS": "作者单位", "ACKNOWLEDGMENTS": "致谢", "ACKNOWLEDGEMENTS": "致谢", "REFERENCES": "参考文献",
    "CONFLICT OF INTEREST": "利益冲突声明", "DATA AVAILABILITY": "数据可用性", "AUTHOR CONTRIBUTIONS": "作者贡献", "FUNDING": "资金支持", "SUPPLEMENTARY MATERIAL": "补充材料",
    "INTRODUCTION": "引言", "METHODOLOGY": "方法", "METHOD": "方法", "METHODS": "方法", "MATERIALS AND METHODS": "材料与方法",
    "RESULTS": "结果", "DISCUSSION": "讨论", "ANALYSIS AND DISCUSSION": "分析与讨论", "RESULTS AND DISCUSSION": "结果与讨论", "CONCLUSIONS": "结论", "CONCLUSION": "结论",
}


def citation_markup(c: Column) -> Column:
    """Numbers that cite, behind a name or a point before a word that goes on, as superscripts; a text that has some stays."""
    numbers = r"\d{1,3}(?:\s*[–-]\s*\d{1,3})?(?:\s*,\s*\d{1,3})*"
    after_name = F.regexp_replace(text(c), r"\b([A-Z][a-z]+)\s+(\d{1,3})(?=\s+[a-z])", "$1 <sup>$2</sup>")
    behind = rf"(?<=[A-Za-z)])([.,;])\s+({numbers})(?=\s+(?:[A-Z][a-z]|(?:{'|'.join(CITING_WORDS)})\b))"
    marked = F.regexp_replace(after_name, behind, "$1 <sup>$2</sup>")
    # white space inside a mark goes
    tight = F.regexp_replace(marked, r"(?<=<sup>[\d,–-]{0,40})\s+(?=[\d,–\s-]{0,40}</sup>)", "")
    return F.when(F.lower(text(c)).contains("<sup"), text(c)).otherwise(tight)


def to_chinese(language: Column) -> Column:
    return F.lower(text(language)).rlike("zh|中文|汉语|简体|繁体")


def heading_translation(source: Column, language: Column) -> Column:
    """A known heading's Chinese, with its number if it has one; else the empty text."""
    words = F.upper(F.trim(F.regexp_replace(text(source), r"\s+", " ")))
    known = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    number, rest = F.regexp_extract(words, r"^((?:[IVXLCDM]+|[A-Z])\.) (.+)$", 1), F.regexp_extract(words, r"^((?:[IVXLCDM]+|[A-Z])\.) (.+)$", 2)
    found = F.coalesce(known[words], F.when(number != "", F.concat_ws(" ", number, known[rest])).otherwise(""))
    return F.when(to_chinese(language) & (known[words].isNotNull() | known[rest].isNotNull()), found).otherwise("")


def academic_text(source: Column, translated: Column, language: Column) -> Column:
    """A translated record as a paper has it: a known heading by the table, else the text with its citation marks."""
    heading = heading_translation(source, language)
    return F.when(heading != "", heading).otherwise(F.when(to_chinese(language), citation_markup(F.trim(text(translated)))).otherwise(F.trim(text(translated))))
