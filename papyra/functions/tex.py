"""Formulas: where they are in a text, and their TeX made comparable or readable."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import with_equation_numbers
from .text import delimiter_balance, strip, text, without_tex_wrappers

# --- tokens ---------------------------------------------------------------------------------
# A delimiter counts where an even number of backslashes stands before it.

_EVEN = r"(?<!\\)(?:\\\\)*+"
_NEXT = re.compile(rf"(`++)|{_EVEN}(\\\(|\\\[|\$\$|\$)")
_ENDS = {"$": re.compile(_EVEN + r"(\$)"), "$$": re.compile(_EVEN + r"(\$\$)"), r"\(": re.compile(_EVEN + r"(\\\))"), r"\[": re.compile(_EVEN + r"(\\\])")}


def math_tokens(source: str) -> list[dict]:
    """kind ("text" or "math"), text, and of formulas tex and display, in order.

    Code spans, of any number of backticks, are text; one that does not end reaches to the
    end.  A formula without body, or a $ formula over line ends, is none.
    """
    out, plain, at = [], 0, 0
    while m := _NEXT.search(source, at):
        if m[1]:
            end = source.find(m[1], m.end())
            at = len(source) if end < 0 else end + len(m[1])
            continue
        end = _ENDS[m[2]].search(source, m.end())
        tex = source[m.end() : end.start(1)].strip() if end else ""
        if not tex or (m[2] == "$" and "\n" in tex):
            at = m.end()
            continue
        if plain < m.start(2):
            out.append({"kind": "text", "text": source[plain : m.start(2)], "tex": None, "display": None})
        out.append({"kind": "math", "text": source[m.start(2) : end.end()], "tex": tex, "display": m[2] in ("$$", r"\[")})
        plain = at = end.end()
    if plain < len(source):
        out.append({"kind": "text", "text": source[plain:], "tex": None, "display": None})
    return out


TOKEN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tex", T.StringType()), T.StructField("display", T.BooleanType())])


@F.pandas_udf(T.ArrayType(TOKEN))
def math_tokens_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([math_tokens(x) for x in texts.fillna("")], dtype=object)


# --- commands ---------------------------------------------------------------------------------

#: What commands show as.
SYMBOLS = {"mu": "μ", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "cdot": "·", "times": "×", "le": "≤", "ge": "≥", "neq": "≠", "pm": "±", "prime": "′", "star": "*"}


def command_text(c: Column) -> Column:
    """What a command, with or without its backslash, shows as; others as they are."""
    name = F.regexp_replace(text(c), r"^\\", "")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])[name], text(c))


def readable_tex(c: Column) -> Column:
    """A formula as plain text: symbols shown, other commands by their names, no braces."""
    shown = reduce(lambda x, kv: F.regexp_replace(x, rf"\\{kv[0]}(?![A-Za-z])", kv[1]), SYMBOLS.items(), without_tex_wrappers(c))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(shown, r"\\([A-Za-z]+)", "$1"), r"[{}]", ""), r"\s+", " "))


def braced(c: Column, start: Column) -> Column:
    """(text, end) of the braces that open at place `start` (from 0) and match; null if they do not.

    A brace after a backslash is no brace.  The depth after every brace is a running sum, so
    the match is the first brace where it is back at zero.
    """
    rest = F.substr(text(c), start + 1)
    signs = F.regexp_extract_all(rest, F.lit(r"(?s)((?<!\\)[{}]|[^{}]|(?<=\\)[{}])"), F.lit(1))
    steps = F.transform(signs, lambda x, i: F.when((x == "{") & ((i == 0) | (F.get(signs, i - 1) != "\\")), 1).when((x == "}") & ((i == 0) | (F.get(signs, i - 1) != "\\")), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).cast("int").alias("end"))
    done = F.aggregate(steps, zero, lambda s, x: F.struct((s["depth"] + x).alias("depth"), (s["at"] + 1).alias("at"), F.when((s["end"] == 0) & (s["depth"] + x == 0), s["at"] + 1).otherwise(s["end"]).alias("end")), lambda s: s["end"])
    return F.when(rest.startswith("{") & (done > 0), F.struct(F.substr(rest, F.lit(2), done - 2).alias("text"), (start + done).cast("int").alias("end")))


# --- comparing and repairing --------------------------------------------------------------------

_LABEL = re.compile(r"(?i)(?:\\[,;:!]\s*|[,;:]\s+|\s+)\((?:i{1,3}|iv|v|[a-c])\)\s*$")
_REWRITES = [(re.compile(p), by) for p, by in ((r"\{\s*\{([^{}]*)\}\s*\}", r"{\1}"), (r"\\mathrm\s*\{([^{}]*)\}", r"\1"), (r"\\mathrm\s+([A-Za-z])", r"\1"), (r"\\mathrm(?=[A-Za-z])", ""))]


def comparable_tex(source: str) -> str:
    """A formula's body for comparing: no redundant braces, roman fonts, subequation label, white space or points.

    The rewrites run until none changes anything; each shortens the text.
    """
    out = re.sub(r"(?i)&(?:amp;)?(lt|gt);", lambda m: "<" if m[1].lower() == "lt" else ">", unicodedata.normalize("NFKC", source))
    out = _LABEL.sub("", " ".join(out.split()))
    before = None
    while out != before:
        before = out
        for pattern, by in _REWRITES:
            out = pattern.sub(by, out)
    return re.sub(r"[\s,.;:，。；：、]+", "", out)


@F.pandas_udf(T.StringType())
def comparable_tex_udf(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(comparable_tex)


def plain_relations(c: Column) -> Column:
    """Entities of <, >, ≤ and ≥ as signs."""
    return reduce(lambda x, kv: F.regexp_replace(x, kv[0], kv[1]), (("(?i)&lt;|＆lt；", "<"), ("(?i)&gt;|＆gt；", ">"), ("(?i)&le;", "≤"), ("(?i)&ge;", "≥")), text(c))


def neutral_tex(c: Column) -> Column:
    """A text whose delimiters do not balance, with them made plain signs; else as it is."""
    plain = reduce(lambda x, kv: F.regexp_replace(x, kv[0], kv[1]), ((r"(?<!\\)\$", r"\\\$"), (r"(?s)\\\[(?!.*\\\])", "["), (r"(?s)\\\](?!.*\\\[)", "]")), text(c))
    return F.when(delimiter_balance(c)["ok"], text(c)).otherwise(plain)


def repaired(source: Column, translated: Column) -> Column:
    """A translated record's text: signs for entities, stray delimiters plain, lost equation numbers back."""
    return strip(with_equation_numbers(source, neutral_tex(plain_relations(translated))))
