"""Queries of the text functions, each over a whole table of the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import load, query


def scalar(name: str, table: str, key: str, source: str, function, sql: str) -> None:
    """value = function(source) for every row; source and sql are SQL, sql over a column s."""

    @query(name, f"SELECT {key}, {sql} AS value FROM (SELECT {key}, {source} AS s FROM {table}) t")
    def run(spark, sf_dir):
        keys = key.split(", ")
        return load(spark, sf_dir, table).select(*keys, F.expr(source).alias("s")).select(*keys, function(F.col("s")).alias("value"))


def _g(pattern: str, by: str, over: str = "s") -> str:
    return f"regexp_replace({over}, '{pattern}', '{by}', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


DOC = ("documents", "doc_id", "text")
PAGE = ("pages", "page_id", "html")
ID = "CAST(doc_id AS STRING)"

scalar("sf01_title_key", *DOC, T.title_key, r"trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g'))")
scalar("sf02_import_title_key", *DOC, T.import_title_key, r"trim(regexp_replace(lower(s), '[^a-z0-9\x{3400}-\x{9fff}]+', ' ', 'g'))")
DOIS = f"CASE doc_id % 4 WHEN 0 THEN ' https://doi.org/10.5555/AbC.' || {ID} || '.' WHEN 1 THEN 'doi: 10.5555/X' || {ID} || '];' WHEN 2 THEN 'HTTP://dx.doi.org/10.1/' || {ID} ELSE '10.9/' || {ID} || ' >' END"
scalar("sf03_doi", "documents", "doc_id", DOIS, T.doi, r"lower(regexp_replace(regexp_replace(regexp_replace(" + _strip("s") + r", '(?i)^https?://(?:dx\.)?doi\.org/', ''), '(?i)^doi:\s*', ''), '[\s\]}>,.;]+$', ''))")
ARXIV = f"CASE doc_id % 3 WHEN 0 THEN 'https://arxiv.org/abs/2101.' || {ID} || 'v2' WHEN 1 THEN ' arXiv:Math.GT/' || {ID} ELSE {ID} || 'V3' END"
scalar("sf04_arxiv_id", "documents", "doc_id", ARXIV, T.arxiv_id, r"lower(regexp_replace(regexp_replace(regexp_replace(" + _strip("s") + r", '(?i)^https?://arxiv\.org/abs/', ''), '(?i)^arxiv:', ''), '(?i)v\d+$', ''))")
scalar("sf05_year", "events", "event_id", "'on ' || CAST(ts AS STRING) || ' x' || CAST(event_id AS STRING)", T.year, r"CAST(nullif(regexp_extract(s, '\b((?:18|19|20|21)\d{2})\b', 1), '') AS INTEGER)")
scalar("sf06_work_id", "documents", "doc_id", f"CASE WHEN doc_id % 2 = 0 THEN 'https://works.example/w' || {ID} ELSE 'A' || {ID} || '/' END", T.work_id, r"upper(regexp_extract(s, '(?i)(W\d+)$', 1))")
scalar("sf08_clean_markdown", *DOC, T.clean_markdown, _strip(_g(r"\n{4,}", "\n\n\n", _g(r"(?m)[ \t]+$", "", _g(r"\r\n?", "\n")))) + " || chr(10)")
LINE = "CASE doc_id % 5 WHEN 0 THEN '## ' || text WHEN 1 THEN '- ' || text WHEN 2 THEN '![x](a.png)' WHEN 3 THEN '12) see ![y](b.png) ' || text ELSE text END"
scalar("sf10_block_text", "documents", "doc_id", LINE, T.block_text, r"CASE WHEN regexp_matches(" + _strip("s") + r", '^(```|~~~)') OR regexp_matches(" + _strip("s") + r", '^!\[[^\]]*\]\([^)]+\)\s*$') THEN '' ELSE " + _strip(r"regexp_replace(regexp_replace(regexp_replace(s, '^#{1,6}\s+', ''), '^\s*(?:[-*+]|\d+[.)])\s+', ''), '!\[[^\]]*\]\([^)]+\)', '', 'g')") + " END")
MATH = "text || CASE doc_id % 4 WHEN 0 THEN ' $x$ and $$y$$' WHEN 1 THEN ' $x' WHEN 2 THEN ' $$a \\[ b' ELSE ' \\[c\\]' END"
MATH_SQL = MATH
MATH_SPARK = MATH.replace("\\", "\\\\")


@query("sf14_delimiter_balance", "SELECT doc_id, d % 2 = 0 AND i % 2 = 0 AND b = 0 AS ok, i AS inline, d AS display, b AS brackets FROM (SELECT doc_id, CAST(len(regexp_extract_all(s, '\\$\\$')) AS INTEGER) AS d, CAST(len(regexp_extract_all(replace(s, '$$', ''), '\\$')) AS INTEGER) AS i, CAST(len(regexp_extract_all(s, '\\\\\\[')) - len(regexp_extract_all(s, '\\\\\\]')) AS INTEGER) AS b FROM (SELECT doc_id, " + MATH_SQL + " AS s FROM documents))")
def delimiter_balance(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.delimiter_balance(F.expr(MATH_SPARK)).alias("b")).select("doc_id", "b.*")


scalar("sf20_html_text", *PAGE, T.html_text, _strip(_g(r"[ \t]+", " ", "replace(" + _g("(?i)&gt;", ">", _g("(?i)&lt;", "<", _g("(?i)&nbsp;", " ", _g("<[^>]+>", "", _g(r"(?i)<br\s*/?>", "\n"))))) + ", '&amp;', '&')")))
scalar("sf47_plain_text", *PAGE, T.plain_text, _strip(_g(r"\s+", " ", _g("<[^>]+>", " "))))
scalar("sf32_sha256", *DOC, lambda c: F.sha2(T.text(c), 256), "sha256(s)")
scalar("sf38_latin_count", *DOC, T.latin_count, "CAST(len(regexp_extract_all(s, '[A-Za-z]')) AS INTEGER)")
scalar("sf38_cjk_count", "documents", "doc_id", "CASE WHEN doc_id % 7 = 0 THEN '汉字カナ' || text ELSE text END", T.cjk_count, r"CAST(len(regexp_extract_all(s, '[\x{3400}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]')) AS INTEGER)")
scalar("sf40_compare_text", *DOC, T.compare_text, r"regexp_replace(lower(s), '[\p{P}\p{S}\s]+', '', 'g')")
scalar("sf41_visible_length", *DOC, T.visible_length, "CAST(length(" + _g(r"\s+", "", _g("<[^>]+>", "", _g(r"\$[^$]*\$", ""))) + ") AS INTEGER)")
scalar("sf42_equation_numbers", "documents", "doc_id", f"'by (1.' || {ID} || ') and (2.3), not (4)' || text", lambda c: F.array_join(T.equation_numbers(c), ","), r"array_to_string(regexp_extract_all(s, '\((\d+(?:\.\d+)*)\)', 1), ',')")
scalar("sf48_head_with_notice", *DOC, lambda c: T.head_with_notice(c, 800), "CASE WHEN length(s) > 800 THEN left(s, 800) || '… [' || CAST(length(s) AS VARCHAR) || ' characters]' ELSE s END")
scalar("sf48_head_and_tail", *DOC, lambda c: T.head_and_tail(c, 1000), "CASE WHEN length(s) > 1000 THEN left(s, 720) || chr(10) || '…' || chr(10) || right(s, 280) ELSE s END")
scalar("sf49_redacted", *DOC, T.redacted, r"regexp_replace(s, '(?i)\b(api[-_]?key|authorization|password|secret|token)\b(\s*[:=]\s*)\S+', '\1\2[REDACTED]', 'g')")
scalar("sf50_safe_id", "pages", "page_id", "url", T.safe_id, "left(regexp_replace(s, '[^A-Za-z0-9._:-]+', '-', 'g'), 160)")
scalar("sc24_input_kind", "pages", "page_id", "url || CASE page_id % 6 WHEN 0 THEN '.PDF?x=1' WHEN 1 THEN '/a.jpeg' WHEN 2 THEN '/b.docx#t' WHEN 3 THEN '/.md' WHEN 4 THEN '/c.markdown' ELSE '' END", T.input_kind, r"CASE regexp_extract(regexp_extract(regexp_replace(lower(s), '[?#].*$', ''), '([^/]*)$', 1), '^.+(\.[^.]*)$', 1) WHEN '.pdf' THEN 'pdf' WHEN '.png' THEN 'image' WHEN '.jpg' THEN 'image' WHEN '.jpeg' THEN 'image' WHEN '.jp2' THEN 'image' WHEN '.webp' THEN 'image' WHEN '.gif' THEN 'image' WHEN '.bmp' THEN 'image' WHEN '.doc' THEN 'office' WHEN '.docx' THEN 'office' WHEN '.ppt' THEN 'office' WHEN '.pptx' THEN 'office' WHEN '.xls' THEN 'office' WHEN '.xlsx' THEN 'office' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown' WHEN '.txt' THEN 'text' ELSE 'unsupported' END")
scalar("sf52_boolean_option", "documents", "doc_id", "CASE doc_id % 6 WHEN 0 THEN 'FALSE' WHEN 1 THEN ' 0 ' WHEN 2 THEN 'off' WHEN 3 THEN '' WHEN 4 THEN 'yes' ELSE 'false ' END", lambda c: T.boolean_option(c, True), "CASE WHEN trim(s) = '' THEN TRUE ELSE lower(trim(s)) NOT IN ('false', '0', 'no', 'off') END")
scalar("sf64_retry_delay", "events", "event_id", "CAST(event_id % 9 + 1 AS INT)", T.retry_delay, "CAST(least(30000.0, 1000 * pow(2.0, s - 1)) AS BIGINT)")
scalar("sf64_retryable_status", "events", "event_id", "CAST(400 + event_id % 120 AS INT)", T.retryable_status, "s IN (408, 425, 429) OR s >= 500")
scalar("sf65_language_code", "documents", "doc_id", "CASE doc_id % 4 WHEN 0 THEN ' Deutsch' WHEN 1 THEN 'English' WHEN 2 THEN lang ELSE 'Klingon' END", T.language_code, "CASE lower(trim(s)) WHEN 'deutsch' THEN 'de' WHEN 'english' THEN 'en' ELSE lower(trim(s)) END")
scalar("fl13_translatable", *DOC, T.translatable, "regexp_matches(s, '[A-Za-z]{3,}')")
scalar("fl14_bibliography_like", *DOC, T.bibliography_like, r"regexp_matches(s, '^\s*\[\d+\]\s') OR regexp_matches(s, '(?i)\b(doi:|et al\.|vol\.|pp\.)')")
scalar("fl14_affiliation_like", "documents", "doc_id", "CASE doc_id % 5 WHEN 0 THEN 'City HOSPITAL, ' || text WHEN 1 THEN '某大学 ' || text WHEN 2 THEN 'universityx' ELSE text END", T.affiliation_like, r"regexp_matches(s, '(?i)\b(university|institute|department|laboratory|school|college|hospital)\b|大学|学院|研究所|实验室')")
scalar("sf39_expects_cjk", "documents", "doc_id", "CASE doc_id % 3 WHEN 0 THEN 'Chinese' WHEN 1 THEN 'ja' ELSE lang END", T.expects_cjk, "regexp_matches(lower(s), 'zh|chinese|ja|japanese|ko|korean')")
scalar("sf62_compact_reference", "documents", "doc_id", "'<details>x' || chr(10) || 'y</details>![a](b)' || text", T.without_images_and_details, _strip(_g(r"\n{3,}", "\n\n", _g(r"!\[[^\]]*\]\([^)]+\)", "", _g(r"(?is)<details\b[^>]*>.*?</details>", "")))))
scalar("sf23_split_cells", "documents", "doc_id", "'| ' || substr(source, 1, 9) || ' | a\\\\|b | ' || lang || ' |'", lambda c: F.array_join(T.split_cells(c), "~"), "source || '~a|b~' || lang".replace("source", "regexp_extract(s, '\\| (\\w+)', 1)").replace("lang", "regexp_extract(s, '(\\w+) \\|$', 1)"))
scalar("sf66_bytes_text", "documents", "doc_id", "n_chars * 37", T.bytes_text, "CASE WHEN s < 1024 THEN CAST(s AS VARCHAR) || ' B' WHEN s / 1024.0::DOUBLE < 1024 THEN CAST(round(s / 1024.0::DOUBLE, 1) AS VARCHAR) || ' KB' ELSE CAST(round(s / 1048576.0::DOUBLE, 1) AS VARCHAR) || ' MB' END")
scalar("sf30_fnv32", "documents", "doc_id", "text", T.fnv32, "lower(lpad(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(list_filter(string_split(s, ''), lambda x: x <> ''), lambda x: unicode(x)::UBIGINT)), lambda h, x: ((xor(h, x) * 16777619::UBIGINT) & 4294967295::UBIGINT)::UBIGINT)), 8, '0'))")
scalar("sf34_relative_path", "documents", "doc_id", "CASE doc_id % 4 WHEN 0 THEN 'a/./' || lang || '/../' || source || '/x.md' WHEN 1 THEN '../' || source WHEN 2 THEN source || '/../../y' ELSE ' ' || lang || ' // z ' END", T.relative_path, "CASE doc_id % 4 WHEN 0 THEN 'a/' || regexp_extract(s, '/(\\w+)/x.md$', 1) || '/x.md' WHEN 3 THEN trim(string_split(s, '//')[1]) || '/z' END")


@query("sf12_image_references", r"SELECT doc_id, pos, alt, target FROM (SELECT doc_id, unnest(range(1, 3)) AS pos, lang || '1' AS a1, source AS t1, text FROM documents) t, LATERAL (SELECT CASE pos WHEN 1 THEN a1 ELSE '' END AS alt, CASE pos WHEN 1 THEN t1 || '.png' ELSE 'b c.gif' END AS target) u")
def image_references(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.expr("'x ![' || lang || '1]( ' || source || '.png ) and ![](b c.gif) ' || replace(substr(text, 1, 50), '!', '')").alias("s"))
    return docs.select("doc_id", F.posexplode(T.image_references(F.col("s"))).alias("pos", "r")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "r.alt", "r.target")


@query("sf21_html_table_rows", r"""
SELECT page_id, CAST(r.i - 1 AS INTEGER) AS row, array_to_string(list_transform(regexp_extract_all(r.x, '(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>', 1), lambda c: regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', '')), '|') AS cells
FROM (SELECT page_id, unnest(list_filter(regexp_extract_all('<table><tr><th>k</th><th>v</th></tr><tr></tr><tr><td>' || CAST(page_id AS VARCHAR) || '</td><td><b>' || url || '</b> </td></tr></table>', '(?is)<tr\b[^>]*>(.*?)</tr>', 1), lambda x: regexp_matches(x, '(?i)<t[dh]'))) AS x, unnest(range(1, 3)) AS i FROM pages) r
""")
def html_table_rows(spark, sf_dir):
    html = F.expr("'<table><tr><th>k</th><th>v</th></tr><tr></tr><tr><td>' || CAST(page_id AS STRING) || '</td><td><b>' || url || '</b> </td></tr></table>'")
    return load(spark, sf_dir, "pages").select("page_id", F.posexplode(T.html_table_rows(html)).alias("row", "c")).select("page_id", "row", F.array_join("c", "|").alias("cells"))


@query("sf68_version_order", "SELECT event_id, CASE WHEN a[1] <> b[1] THEN sign(a[1] - b[1]) WHEN a[2] <> b[2] THEN sign(a[2] - b[2]) ELSE sign(a[3] - b[3]) END AS cmp FROM (SELECT event_id, [event_id % 3, event_id % 12, event_id % 5] AS a, [1, 9, 2] AS b FROM events)")
def version_order(spark, sf_dir):
    a = T.version_key(F.expr("'v' || (event_id % 3) || '.' || (event_id % 12) || '.' || (event_id % 5) || '-beta'"))
    b = T.version_key(F.lit("1.9.2"))
    return load(spark, sf_dir, "events").select("event_id", F.when(a > b, 1).when(a < b, -1).otherwise(0).cast("tinyint").alias("cmp"))


@query("sf07_creator_name", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment || ' ' END || CAST(c_nationkey AS VARCHAR)) END AS name FROM customer")
def creator_name(spark, sf_dir):
    name = F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE ' ' END")
    return load(spark, sf_dir, "customer").select("c_custkey", T.creator_name(name, F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END"), F.col("c_nationkey")).alias("name"))


TYPES = "CASE doc_id % 6 WHEN 0 THEN 'Heading' WHEN 1 THEN 'table foot-note' WHEN 2 THEN 'EQUATION' WHEN 3 THEN '' WHEN 4 THEN 'figure' ELSE lang END"
scalar("pj11_block_type", "documents", "doc_id", TYPES, T.block_type, "CASE doc_id % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'table_footnote' WHEN 2 THEN 'interline_equation' WHEN 3 THEN 'text' WHEN 4 THEN 'image' ELSE s END")
scalar("pj17_chat_role", "conversations", "conv_id, turn", "CASE turn % 3 WHEN 0 THEN 'tool' ELSE role END", T.chat_role, "CASE WHEN s IN ('assistant', 'system') THEN s ELSE 'user' END")
scalar("ge02_ends_sentence", *DOC, T.ends_sentence, r"regexp_matches(trim(s), '[.!?。！？][\])}\"''”’」』）】]?$')")


VISIBLE = "length(regexp_replace(regexp_replace(regexp_replace({}, '\\$[^$]*\\$', '', 'g'), '<[^>]+>', '', 'g'), '\\s+', '', 'g'))"


@query("fl16_overexpanded", f"SELECT doc_id, {VISIBLE.format('t')} > greatest(120.0, 5.5 * greatest(1, {VISIBLE.format('text')})) AS value FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN repeat(text, 6) WHEN 1 THEN repeat(text, 5) ELSE text END AS t FROM documents) d")
def overexpanded(spark, sf_dir):
    from ..functions import quality

    t = F.expr("CASE doc_id % 3 WHEN 0 THEN repeat(text, 6) WHEN 1 THEN repeat(text, 5) ELSE text END")
    return load(spark, sf_dir, "documents").select("doc_id", quality.overexpanded(F.col("text"), t).alias("value"))


@query("fl15_untranslated", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN TRUE WHEN NOT regexp_matches(text, '[A-Za-z]{3,}') THEN FALSE WHEN doc_id % 3 = 1 THEN TRUE ELSE regexp_replace(lower(text), '[\\p{P}\\p{S}\\s]+', '', 'g') = '' END AS value FROM documents")
def untranslated(spark, sf_dir):
    from ..functions import quality

    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", quality.untranslated(F.col("text"), F.expr("CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN upper(text) || '!' ELSE '译文' END"), F.lit("text"), True).alias("value"))


@query("ag06_reason_counts", "SELECT 'untranslated' AS reason, count(*) AS n FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 'inline-formula-missing', count(*) FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT 'inline-formula-unbalanced', count(*) FROM documents WHERE doc_id % 4 = 2")
def reason_counts(spark, sf_dir):
    from ..functions import quality

    r = load(spark, sf_dir, "documents").select(F.expr("CASE doc_id % 4 WHEN 1 THEN 'abc $x$ def' ELSE 'abc def' END").alias("s"), F.expr("CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '译文译文' WHEN 2 THEN '译文 $x' ELSE '译文' END").alias("t"), F.lit("text").alias("k"))
    return quality.reason_counts(quality.retry_reasons(r, "s", "t", "k", True))


@query("sf42_with_equation_numbers", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'see (1.2) (' || CAST(doc_id AS VARCHAR) || ')' ELSE 'see (1.2)' END AS value FROM documents")
def with_equation_numbers(spark, sf_dir):
    from ..functions import quality

    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", quality.with_equation_numbers(F.expr("CASE WHEN doc_id % 2 = 0 THEN '(1.2) and (' || doc_id || ')' ELSE '(1.2)' END"), F.lit("see (1.2)")).alias("value"))


@query("ag12_bigram_coverage", "WITH p AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', '', 'g') AS a, regexp_replace(lower(substr(text, 50)), '\\s+', '', 'g') AS b FROM documents), x AS (SELECT doc_id, substr(a, i, 2) AS g, count(*) AS n FROM (SELECT *, unnest(range(1, length(a))) AS i FROM p) q GROUP BY 1, 2), y AS (SELECT doc_id, substr(b, i, 2) AS g, count(*) AS m FROM (SELECT *, unnest(range(1, length(b))) AS i FROM p) q GROUP BY 1, 2), c AS (SELECT doc_id, CAST(sum(least(n, coalesce(m, 0))) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS coverage FROM x LEFT JOIN y USING (doc_id, g) GROUP BY 1) SELECT doc_id, coverage FROM documents LEFT JOIN c USING (doc_id)")
def bigram_coverage(spark, sf_dir):
    """Whole texts against themselves without their first 49 signs."""
    from ..functions import quality

    return load(spark, sf_dir, "documents").select("doc_id", quality.bigram_coverage_udf(F.col("text"), F.substr("text", F.lit(50))).alias("coverage"))


@query("sf22_table_grid", "SELECT page_id, r AS row, c AS column, CASE WHEN r = 0 AND c = 0 THEN 'a' WHEN r = 0 THEN url WHEN c = 1 THEN CAST(page_id AS VARCHAR) ELSE 'z' END AS text FROM pages, (VALUES (0, 0), (0, 1), (1, 1), (1, 2)) t(r, c)")
def table_grid(spark, sf_dir):
    from ..functions import parsing

    h = F.expr("'<table><tr><td rowspan=2>a</td><td colspan=2> ' || url || '</td></tr><tr><td>' || page_id || '</td><td>z</td></tr></table>'")
    return load(spark, sf_dir, "pages").select("page_id", F.explode(parsing.table_grid_udf(h)).alias("c")).select("page_id", "c.row", "c.column", "c.text")


@query("sf26_json_objects", "SELECT event_id, '{\"a\":' || CAST(event_id AS VARCHAR) || '}' AS object FROM events")
def json_objects(spark, sf_dir):
    from ..functions import parsing

    s = F.expr("concat('noise {\"list\":[{\"a\":', event_id, '},{\"b\":\"cut')")
    return load(spark, sf_dir, "events").select("event_id", F.explode(parsing.json_objects_udf(s)).alias("object"))


@query("sf28_stable_json", "SELECT event_id, '{\"a\":[1,{\"c\":2,\"d\":3}],\"z\":' || CAST(event_id AS VARCHAR) || '}' AS value FROM events")
def stable_json(spark, sf_dir):
    from ..functions import parsing

    return load(spark, sf_dir, "events").select("event_id", parsing.stable_json_udf(F.expr("concat('{\"z\": ', event_id, ', \"a\": [1, {\"d\": 3, \"c\": 2}]}')")).alias("value"))


@query("pj22_redacted_json", "SELECT event_id, '{\"Api-Key\":\"[REDACTED]\",\"in\":[{\"token\":\"[REDACTED]\",\"n\":' || CAST(event_id AS VARCHAR) || '}]}' AS value FROM events")
def redacted_json(spark, sf_dir):
    from ..functions import parsing

    return load(spark, sf_dir, "events").select("event_id", parsing.redacted_json_udf(F.expr("concat('{\"Api-Key\": {\"x\": 1}, \"in\": [{\"token\": 5, \"n\": ', event_id, '}]}')")).alias("value"))


PATHS = "CASE doc_id % 5 WHEN 0 THEN 'see C:/a b' || chr(10) || source WHEN 1 THEN 'http://x.y/C:/q \\\\srv\\share\\f http://z' WHEN 2 THEN 'http:\\\\doi.org\\10.1 ' || lang WHEN 3 THEN 'a \\\\ b = 1' ELSE text END"


@query("sf49_without_local_paths", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'see [本地路径已隐藏]' || chr(10) || source WHEN 1 THEN 'http://x.y/C:/q [本地路径已隐藏]' WHEN 2 THEN 'http:\\\\doi.org\\10.1 ' || lang WHEN 3 THEN 'a \\\\ b = 1' ELSE text END AS value FROM documents")
def without_local_paths(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.without_local_paths(F.expr(PATHS.replace("\\", "\\\\"))).alias("value"))


@query("sf59_protected", "SELECT doc_id, 'see ⟦0⟧ at ⟦1⟧ end' AS text, '$x' || CAST(doc_id AS VARCHAR) || '$|https://a.b/c' AS kept FROM documents")
def protected(spark, sf_dir):
    from ..functions import parsing

    p = parsing.protect_udf(F.expr("'see $x' || doc_id || '$ at https://a.b/c end'"))
    return load(spark, sf_dir, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.text", F.array_join("p.kept", "|").alias("kept"))
