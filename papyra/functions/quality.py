"""Quality control of translated records."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import cjk_count, compare_capitals, compare_text, equation_numbers, formula_issue, latin_count, text, translatable, visible_length


def overexpanded(source: Column, translated: Column) -> Column:
    n, m = F.greatest(visible_length(source), F.lit(1)), visible_length(translated)
    to_latin = (cjk_count(source) > latin_count(source)) & ~(cjk_count(translated) > latin_count(translated))
    return F.when(to_latin, m > F.greatest(F.lit(160.0), n * 7.0)).otherwise(m > F.greatest(F.lit(120.0), n * 5.5))


def untranslated(source: Column, translated: Column, kind: Column, to_cjk: bool) -> Column:
    # in capitals too: these write some letters as two, as in STRASSE, which lower case does not take back
    same = (compare_text(source) == compare_text(translated)) | (compare_capitals(source) == compare_capitals(translated))
    latin = latin_count(translated)
    if to_cjk:
        title = (latin_count(source) >= 4) & same & (cjk_count(translated) < 2)
        body = same | ((latin > 50) & (cjk_count(translated) < F.greatest(F.lit(2.0), latin / 16)))
        checked = F.when(kind == "title", title).otherwise(body)
    else:
        checked = same & (cjk_count(source) >= 4) & (cjk_count(source) > latin_count(source))
    return F.when(F.trim(text(translated)) == "", True).when(~(translatable(source) | (cjk_count(source) > 0)), False).otherwise(checked)


def with_equation_numbers(source: Column, translated: Column) -> Column:
    """The translation, with the source's (n.n) that it lacks appended."""
    missing = F.filter(F.transform(equation_numbers(source), lambda x: F.concat(F.lit("("), x, F.lit(")"))), lambda x: ~text(translated).contains(x))
    return F.trim(F.concat_ws(" ", text(translated), F.array_join(missing, " ")))


def retry_reasons(records: DataFrame, source: str, translated: str, kind: str, to_cjk: bool) -> DataFrame:
    """records with reasons: what each must be tried again for, in a fixed order."""
    s, t = F.col(source), F.col(translated)
    issue = F.nullif(formula_issue(s, t), F.lit(""))
    reasons = F.array_compact(F.array(F.when(untranslated(s, t, F.col(kind), to_cjk), "untranslated"), F.when(overexpanded(s, t), "overexpanded"), issue))
    return records.withColumn("reasons", reasons)


def reason_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _bigrams(t: str) -> tuple[np.ndarray, np.ndarray]:
    """(bigram, count) of the characters but white space of a text."""
    signs = np.frombuffer(re.sub(r"\s+", "", t.lower()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique(signs[:-1] << np.uint64(32) | signs[1:], return_counts=True)


def bigram_coverage(source: str, extracted: str) -> float | None:
    """The share of a source's character bigrams, with their counts, that the extracted text has; null if it has none."""
    (a, n), (b, m) = _bigrams(source), _bigrams(extracted)
    if not len(a):
        return None
    at = np.searchsorted(b, a).clip(max=max(len(b) - 1, 0))
    there = b[at] == a if len(b) else np.zeros(len(a), bool)
    return float(np.minimum(n, np.where(there, m[at] if len(b) else 0, 0)).sum() / n.sum())


@F.pandas_udf(T.DoubleType())
def bigram_coverage_udf(source: pd.Series, extracted: pd.Series) -> pd.Series:
    return pd.Series([bigram_coverage(a, b) for a, b in zip(source.fillna(""), extracted.fillna(""), strict=True)], dtype="float64")
