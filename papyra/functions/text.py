"""Text functions of documents and bibliographic records, as Column expressions.

All are built-in expressions, so they stay inside generated code.  A null input is the
empty text, as everywhere in the document model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, F.lit(s[0]), F.lit(s[1])), steps, text(c))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return _chain(c, (r"^\s+", ""), (r"\s+$", ""))


# --- names, titles, identifiers ---------------------------------------------------------


def title_key(c: Column) -> Column:
    """Lower case, every run of other than letters and numbers one blank."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}]+", " "))


def import_title_key(c: Column) -> Column:
    """As title_key, of a-z, 0-9 and Han signs only: accented letters separate."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\x{3400}-\x{9fff}]+", " "))


def doi(c: Column, keep_case: bool = False) -> Column:
    out = _chain(strip(c), (r"(?i)^https?://(?:dx\.)?doi\.org/", ""), (r"(?i)^doi:\s*", ""), (r"[\s\]}>,.;]+$", ""))
    return out if keep_case else F.lower(out)


def arxiv_id(c: Column) -> Column:
    return F.lower(_chain(strip(c), (r"(?i)^https?://arxiv\.org/abs/", ""), (r"(?i)^arxiv:", ""), (r"(?i)v\d+$", "")))


def year(c: Column) -> Column:
    """The first year from 1800 to 2199 in a text, or null."""
    return F.nullif(F.regexp_extract(text(c), r"\b((?:18|19|20|21)\d{2})\b", 1), F.lit("")).cast("int")


def work_id(c: Column) -> Column:
    """The W-number at the end of a work's address."""
    return F.upper(F.regexp_extract(text(c), r"(?i)(W\d+)$", 1))


def creator_name(name: Column, first: Column, last: Column) -> Column:
    joined = F.trim(F.concat_ws(" ", F.nullif(text(first), F.lit("")), F.nullif(text(last), F.lit(""))))
    return F.coalesce(F.nullif(F.trim(text(name)), F.lit("")), joined)


def bare_identifier(c: Column) -> Column:
    """An identifier without its scheme, lower case."""
    return _chain(F.lower(strip(c)), (r"^doi:\s*", ""), (r"^arxiv:\s*", ""), (r"^pmid:\s*", ""))


def safe_id(c: Column) -> Column:
    return F.left(F.regexp_replace(text(c), r"[^A-Za-z0-9._:-]+", "-"), F.lit(160))


def document_key(library: Column, key: Column) -> Column:
    return F.concat_ws("-", library.cast("string"), key)


# --- markdown ---------------------------------------------------------------------------


def clean_markdown(c: Column) -> Column:
    out = _chain(c, (r"\r\n?", "\n"), ("\\x00", ""), (r"(?m)[ \t]+$", ""), (r"\n{4,}", "\n\n\n"))
    return F.concat(strip(out), F.lit("\n"))


def block_text(c: Column) -> Column:
    """What of a markdown block is translated: nothing of code and images, no heading or list mark."""
    t = strip(c)
    bare = _chain(c, (r"^#{1,6}\s+", ""), (r"^\s*(?:[-*+]|\d+[.)])\s+", ""), (r"!\[[^\]]*\]\([^)]+\)", ""))
    return F.when(t.rlike(r"^(```|~~~)") | t.rlike(r"^!\[[^\]]*\]\([^)]+\)\s*$"), "").otherwise(strip(bare))


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))


def image_references(c: Column) -> Column:
    """array of (alt, target)."""
    p = F.lit(r"!\[([^\]]*)\]\(([^)]+)\)")
    return F.zip_with(F.regexp_extract_all(text(c), p, F.lit(1)), F.regexp_extract_all(text(c), p, F.lit(2)), lambda a, t: F.struct(a.alias("alt"), F.trim(t).alias("target")))


def split_cells(line: Column) -> Column:
    """The cells of a pipe-table line; an escaped pipe does not separate."""
    bare = _chain(strip(line), (r"^\|", ""), (r"(?<!\\)\|$", ""))
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda x: F.regexp_replace(F.trim(x), r"\\\|", "|"))


def is_separator_row(line: Column) -> Column:
    return F.forall(split_cells(line), lambda x: x.rlike(r"^:?-{3,}:?$"))


def without_images_and_details(c: Column) -> Column:
    return strip(_chain(c, (r"(?is)<details\b[^>]*>.*?</details>", ""), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\n{3,}", "\n\n")))


def marker_found(c: Column, digits: str, marker: str) -> Column:
    """The marker itself, or its digits with separators between them."""
    return text(c).contains(marker) | text(c).rlike(r"[\s_\-.,:;|/\\]*".join(digits))


# --- formulas ---------------------------------------------------------------------------


def delimiter_balance(c: Column) -> Column:
    """(ok, inline, display, brackets): counts of $, $$ and of \\[ less \\]."""
    value = F.regexp_replace(text(c), r"\\\$", "")
    display = F.regexp_count(value, F.lit(r"\$\$"))
    inline = F.regexp_count(F.regexp_replace(value, r"\$\$", ""), F.lit(r"\$"))
    brackets = F.regexp_count(value, F.lit(r"\\\[")) - F.regexp_count(value, F.lit(r"\\\]"))
    return F.struct(((display % 2 == 0) & (inline % 2 == 0) & (brackets == 0)).alias("ok"), inline.alias("inline"), display.alias("display"), brackets.alias("brackets"))


def without_tex_wrappers(c: Column) -> Column:
    return strip(_chain(strip(c), (r"^\$\$|\$\$$", ""), (r"^\\\[|\\\]$", ""), (r"^\\\(|\\\)$", ""), (r"^\$|\$$", "")))


def equation_numbers(c: Column) -> Column:
    """The numbers in parentheses, such as 2.3 of (2.3)."""
    return F.regexp_extract_all(text(c), F.lit(r"\((\d+(?:\.\d+)*)\)"), F.lit(1))


def formula_issue(source: Column, translated: Column) -> Column:
    p = F.lit(r"(?s)\$[^$]+\$|\\\(.*?\\\)")
    lost = F.regexp_count(text(translated), p) < F.regexp_count(text(source), p)
    return F.when(lost, "inline-formula-missing").when(~delimiter_balance(translated)["ok"], "inline-formula-unbalanced").otherwise("")


# --- HTML -------------------------------------------------------------------------------


def html_text(c: Column) -> Column:
    """Breaks as line ends, no tags, the common entities decoded."""
    out = _chain(c, (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", ""), (r"(?i)&nbsp;", " "), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&amp;", "&"))
    return strip(_chain(out, (r"[ \t]+", " ")))


def html_table_rows(c: Column) -> Column:
    """array of rows, each an array of cell texts; rows without cells are left out."""
    rows = F.regexp_extract_all(text(c), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), html_text))
    return F.filter(cells, lambda r: F.size(r) > 0)


def plain_text(c: Column) -> Column:
    return strip(_chain(c, (r"<[^>]+>", " "), (r"\s+", " ")))


# --- comparing --------------------------------------------------------------------------

HAN = r"[\x{4e00}-\x{9fff}]"
CJK = r"[\x{3400}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"


def cjk_count(c: Column, han_only: bool = False) -> Column:
    return F.regexp_count(text(c), F.lit(HAN if han_only else CJK))


def latin_count(c: Column) -> Column:
    return F.regexp_count(text(c), F.lit("[A-Za-z]"))


def expects_cjk(language: Column) -> Column:
    return F.lower(text(language)).rlike("zh|chinese|ja|japanese|ko|korean|中文|日本|日文|韩")


def compare_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(text(c)), r"[\p{P}\p{S}\s]+", "")


def compare_capitals(c: Column) -> Column:
    return F.regexp_replace(F.upper(text(c)), r"[\p{P}\p{S}\s]+", "")


def visible_length(c: Column) -> Column:
    return F.length(_chain(c, (r"\$[^$]*\$", ""), (r"<[^>]+>", ""), (r"\s+", "")))


def translatable(c: Column) -> Column:
    return text(c).rlike(r"[A-Za-z]{3,}")


#: Words of affiliations.
AFFILIATION_WORDS = ["university", "institute", "department", "laboratory", "school", "college", "hospital"]
AFFILIATION_WORDS_CJK = ["大学", "学院", "研究所", "实验室"]


def affiliation_like(c: Column) -> Column:
    return text(c).rlike(rf"(?i)\b(?:{'|'.join(AFFILIATION_WORDS)})\b|{'|'.join(AFFILIATION_WORDS_CJK)}")


def byline_like(c: Column) -> Column:
    """A short line with a personal name, an ORCID or a footnote sign, which does not end as a sentence does."""
    t = strip(c)
    named = t.rlike(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b") | F.lower(t).rlike(r"\b[a-z]{2,}\s+[a-z]{2,}\b|\borcid\b|[*†‡]")
    return (F.length(t) < 260) & named & ~t.rlike(r"[.!?。！？]$")


def bibliography_like(c: Column) -> Column:
    return text(c).rlike(r"^\s*\[\d+\]\s") | text(c).rlike(r"(?i)\b(doi:|et al\.|vol\.|pp\.)")


def head_with_notice(c: Column, most: int) -> Column:
    n = F.length(text(c))
    return F.when(n > most, F.concat(F.left(text(c), F.lit(most)), F.lit("… ["), n.cast("string"), F.lit(" characters]"))).otherwise(text(c))


def head_and_tail(c: Column, most: int) -> Column:
    """Of a long text 72 % of the room from its head and the rest from its tail."""
    head = int(most * 0.72)
    return F.when(F.length(text(c)) > most, F.concat(F.left(text(c), F.lit(head)), F.lit("\n…\n"), F.right(text(c), F.lit(most - head)))).otherwise(text(c))


# --- secrets and paths --------------------------------------------------------------------


def redacted(c: Column) -> Column:
    """Values of keys that name a secret are masked."""
    return F.regexp_replace(text(c), r"(?i)\b(api[-_]?key|authorization|password|secret|token)\b(\s*[:=]\s*)\S+", "$1$2[REDACTED]")


#: What stands for a local path.
PATH_NOTICE = "[本地路径已隐藏]"


def without_local_paths(c: Column) -> Column:
    """Lines without what follows from their first drive or share path on; web addresses are no paths.

    A line is what lies between its addresses, and the addresses: the first part with a path
    ends it.
    """
    address, path = r"(?i)(https?:[\\/]+[^\s<>'\"]+)", r"[A-Za-z]:[\\/]|\\\\[^\s\\/:*?\"<>|]+\\"

    def line(x: Column) -> Column:
        parts = F.arrays_zip(F.split(x, address, -1).alias("part"), F.regexp_extract_all(x, F.lit(address), F.lit(1)).alias("web"))
        start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

        def add(s: Column, p: Column) -> Column:
            hit = p["part"].rlike(path)
            kept = F.when(hit, F.concat(F.regexp_extract(p["part"], rf"^(.*?)(?:{path})", 1), F.lit(PATH_NOTICE))).otherwise(F.concat(p["part"], F.coalesce(p["web"], F.lit(""))))
            return F.when(s["done"], s).otherwise(F.struct(F.concat(s["out"], kept).alias("out"), hit.alias("done")))

        return F.aggregate(parts, start, add, lambda s: s["out"])

    lines = F.split(text(c), r"(?<=\n)|(?<=\r)(?!\n)", -1)
    return F.array_join(F.transform(lines, lambda x: F.concat(line(F.regexp_replace(x, r"[\r\n]+$", "")), F.regexp_extract(x, r"([\r\n]*)$", 1))), "")


def extension(path: Column) -> Column:
    clean = _chain(path, (r"[?#].*$", ""), (r"\\", "/"))
    name = F.regexp_extract(clean, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


#: The kinds of input files.
INPUT_KINDS = {
    "pdf": [".pdf"],
    "image": [".png", ".jpg", ".jpeg", ".jp2", ".webp", ".gif", ".bmp"],
    "office": [".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx"],
    "html": [".html", ".htm"],
    "markdown": [".md", ".markdown"],
    "text": [".txt"],
}


def input_kind(path: Column) -> Column:
    e = extension(path)
    return reduce(lambda out, kind: out.when(e.isin(kind[1]), kind[0]), list(INPUT_KINDS.items())[1:], F.when(e.isin(INPUT_KINDS["pdf"]), "pdf")).otherwise("unsupported")


#: Signs that file systems refuse, and names that one of them reserves.
REFUSED_SIGNS = '<>:"/\\|?*' + "".join(map(chr, range(32)))
RESERVED_NAMES = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]


def safe_stem(c: Column, fallback: str = "document", most: int = 96) -> Column:
    """A file name that every file system takes; an empty or reserved one, and a long one, gets its hash."""
    given = text(c)
    words = F.split(F.rtrim(F.translate(given, REFUSED_SIGNS, "_" * len(REFUSED_SIGNS)), F.lit(". ")), r"\s+")
    name = F.array_join(F.filter(words, lambda w: w != ""), " ")
    no_name = (name == "") | F.lower(F.substring_index(name, ".", 1)).isin(RESERVED_NAMES)
    name = F.when(no_name, F.concat(F.lit(f"{fallback}_"), fnv32(F.when(given == "", fallback).otherwise(given)))).otherwise(name)
    return F.when(F.length(name) <= most, name).otherwise(F.concat_ws("_", F.left(name, F.lit(most - 9)), fnv32(name)))


def relative_path(path: Column) -> Column:
    """A path without . and .. steps, or null where .. leaves the root or nothing is left."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text(path), r"\\", "/"), "/"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    done = F.aggregate(parts, start, lambda s, x: F.when(x != "..", F.struct(F.concat(s["at"], F.array(x)).alias("at"), s["out"].alias("out"))).otherwise(F.struct(F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["out"] | (F.size(s["at"]) == 0)).alias("out"))))
    return F.when(~done["out"] & (F.size(done["at"]) > 0), F.array_join(done["at"], "/"))


# --- hashes -------------------------------------------------------------------------------


def fnv32(c: Column) -> Column:
    """FNV-1a of 32 bits over code points, as 8 hexadecimal digits."""
    signs = F.filter(F.split(text(c), ""), lambda x: x != "")
    code = lambda x: F.ascii(x).cast("long")  # noqa: E731  the code point of a one-sign text
    h = F.aggregate(signs, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(code(x)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


#: Start values and multipliers of the two lanes.
LANES = {"a": (0x811C9DC5, 0x01000193), "b": (0x9E3779B9, 0x85EBCA6B)}


def utf16_units(c: Column) -> Column:
    """array of the numbers of a text's UTF-16 units."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text(c), "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))


def fingerprint(c: Column) -> Column:
    """Two 32-bit lanes over UTF-16 units, as 16 hexadecimal digits; line ends are normalised first.

    The second lane's multiplier is applied in halves of 16 bits, so no product leaves 64.
    """
    low, half = F.lit(0xFFFFFFFF).cast("long"), F.lit(0xFFFF).cast("long")
    (a0, am), (b0, bm) = LANES["a"], LANES["b"]
    start = F.struct(F.lit(a0).cast("long").alias("a"), F.lit(b0).cast("long").alias("b"), F.lit(0).cast("long").alias("i"))

    def times(x: Column, m: int) -> Column:
        upper = (x * F.lit(m >> 16).cast("long")).bitwiseAND(half)
        return (F.shiftleft(upper, 16) + x * F.lit(m & 0xFFFF).cast("long")).bitwiseAND(low)

    def step(s: Column, u: Column) -> Column:
        i = s["i"] + 1
        return F.struct(times(s["a"].bitwiseXOR(u), am).alias("a"), times(s["b"].bitwiseXOR((u + i * 131).bitwiseAND(low)), bm).alias("b"), i.alias("i"))

    clean = _chain(c, (r"\r\n?", "\n"), ("\\x00", ""))
    lane = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(utf16_units(clean), start, step, lambda s: F.concat(lane(s["a"]), lane(s["b"])))


def version_key(c: Column) -> Column:
    """Numeric parts of a version, for comparing as an array."""
    return F.transform(F.split(F.regexp_replace(text(c), r"^[vV]|[-+].*$", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def bytes_text(n: Column) -> Column:
    size = n.cast("double")
    kb, mb, gb = size / 1024, size / 1048576, size / 1073741824
    fmt = lambda x: F.round(x, 1).cast("string")
    return F.when(size < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(kb < 1024, F.concat(fmt(kb), F.lit(" KB"))).when(mb < 1024, F.concat(fmt(mb), F.lit(" MB"))).otherwise(F.concat(fmt(gb), F.lit(" GB")))


def boolean_option(c: Column, fallback: bool) -> Column:
    t = F.lower(F.trim(text(c)))
    return F.when(t == "", fallback).otherwise(~t.isin("false", "0", "no", "off"))


def retry_delay(attempt: Column, base: int = 1000, most: int = 30000) -> Column:
    return F.least(F.lit(most).cast("double"), F.lit(base) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def retryable_status(status: Column) -> Column:
    return status.isin(408, 425, 429) | (status >= 500)


#: Names of languages and their codes.
LANGUAGE_CODES = {"english": "en", "german": "de", "deutsch": "de", "french": "fr", "spanish": "es", "chinese": "zh", "简体中文": "zh", "japanese": "ja", "korean": "ko", "russian": "ru"}


def language_code(c: Column) -> Column:
    t = F.lower(F.trim(text(c)))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])[t], t)


#: Other names of block types.
BLOCK_TYPES = {"paragraph": "text", "body": "text", "heading": "title", "equation": "interline_equation", "figure": "image", "table_foot_note": "table_footnote"}
#: Types of blocks that are translated.
TRANSLATABLE_TYPES = ["title", "text", "table_caption", "table_footnote", "chart_caption", "image_caption", "image_footnote", "ref_text"]


def block_type(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("text"))), r"[\s-]+", "_")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in BLOCK_TYPES.items() for x in kv])[t], t)


def content_kind(kind: Column, type_: Column, formula: Column) -> Column:
    return F.when(kind == "image", "figure").when(kind == "table", "table").when(formula | text(type_).rlike("(?i)formula"), "formula").otherwise("text")


def chat_role(c: Column) -> Column:
    return F.when(c.isin("assistant", "system"), c).otherwise("user")


def ends_sentence(c: Column) -> Column:
    return F.trim(text(c)).rlike(r"[.!?。！？][\])}\"'”’」』）】]?$")


def tex_segments(c: Column) -> Column:
    """Commands and the texts between them, in order."""
    return F.regexp_extract_all(text(c), F.lit(r"(\\[A-Za-z]+|\\.|[^\\]+)"), F.lit(1))


def placeholders_kept(source: Column, translated: Column) -> Column:
    """Whether a translation has the source's ⟦n⟧, each as often, and no others."""
    marks = lambda c: F.array_sort(F.regexp_extract_all(text(c), F.lit(r"(⟦\d+⟧)"), F.lit(1)))
    return marks(source) == marks(translated)


def common_prefix(paths: Column) -> Column:
    """The folder that all paths of an array share: of the least and the greatest, as far as their parts agree."""
    low, high = F.split(F.array_min(paths), "/"), F.split(F.array_max(paths), "/")
    n = F.least(F.size(low), F.size(high)) - 1
    upto = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: F.slice(low, F.lit(1), k) == F.slice(high, F.lit(1), k))
    return F.array_join(F.slice(low, F.lit(1), F.array_max(upto)), "/")


def note_text(c: Column) -> Column:
    """A note's text: no tags or CDATA marks, entities decoded, white space collapsed."""
    out = _chain(c, (r"<!\[CDATA\[|\]\]>", ""), (r"<[^>]+>", " "), (r"(?i)&nbsp;", " "), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;", '"'), (r"(?i)&amp;", "&"), (r"\s+", " "))
    return strip(out)


def estimated_lines(c: Column, width: Column, size: Column) -> Column:
    """How many lines a text needs: Han and kana signs are one size wide, others 0.56 of it."""
    cjk = cjk_count(c)
    units = cjk * 1.0 + (F.length(text(c)) - cjk) * 0.56
    return F.greatest(F.lit(1), F.ceil(units * size / width)).cast("int")


def quality_issues(source: Column, translated: Column) -> Column:
    """What is wrong with a translation, by rule: numbers lost, markup lost, links lost, left blank, repeated marks."""
    count = lambda c, p: F.regexp_count(text(c), F.lit(p))
    rules = [
        ("blank", F.trim(text(translated)) == ""),
        ("numbers", count(translated, r"\d+") < count(source, r"\d+")),
        ("links", count(translated, r"https?://") < count(source, r"https?://")),
        ("citations", count(translated, r"\[\d+\]") < count(source, r"\[\d+\]")),
        ("formula", formula_issue(source, translated) != ""),
        ("repeated", text(translated).rlike(r"([!?。！？,，])\1{2,}")),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def toc_entry(line: Column) -> Column:
    """(number, title, page) of a contents line, or null."""
    p = r"(?i)^\s*(\d+(?:\.\d+)*\.?)\s+(.+?)\s*(?:\.{2,}|…{2,}|·{2,}|-{3,})\s*(\d+|[ivxlcdm]+)\s*$"
    part = lambda n: F.regexp_extract(line, p, n)
    return F.when(line.rlike(p), F.struct(part(1).alias("number"), part(2).alias("title"), part(3).alias("page")))
