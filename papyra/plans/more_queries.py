"""Further queries of text, sequence and layout functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as T
from ..operators import layout, library, sequences
from .library_queries import BOX, _page_boxes
from .registry import load, query


def docs(spark, sf_dir):
    return load(spark, sf_dir, "documents")


@query("sf19_tex_segments", r"SELECT doc_id, array_to_string(['\frac', '{' || lang || '}', '\,', 'x'], '|') AS value FROM documents")
def tex_segments(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.tex_segments(F.expr(r"'\\frac{' || lang || '}\\,x'")), "|").alias("value"))


@query("sf24_placeholders", "SELECT doc_id, doc_id % 3 = 0 AS kept FROM documents")
def placeholders(spark, sf_dir):
    t = F.expr("CASE doc_id % 3 WHEN 0 THEN 'b ⟦1⟧ a ⟦0⟧' WHEN 1 THEN '⟦0⟧ ⟦0⟧ ⟦1⟧' ELSE '⟦0⟧' END")
    return docs(spark, sf_dir).select("doc_id", T.placeholders_kept(F.lit("a ⟦0⟧ b ⟦1⟧"), t).alias("kept"))


@query("sf36_common_prefixes", "SELECT doc_id, 'a/' || lang AS prefix FROM documents")
def common_prefixes(spark, sf_dir):
    p = F.expr("array('a/' || lang || '/x/1', 'a/' || lang || '/y', 'a/' || lang || '/x/2')")
    return docs(spark, sf_dir).select("doc_id", T.common_prefix(p).alias("prefix"))


@query("sf51_note_texts", "SELECT doc_id, lang || ' & \"' || source || '\" <b>' AS value FROM documents")
def note_texts(spark, sf_dir):
    s = F.expr("'<p><![CDATA[' || lang || ']]>&nbsp;&amp;<br/> &quot;' || source || '&quot; &lt;b&gt;</p>'")
    return docs(spark, sf_dir).select("doc_id", T.note_text(s).alias("value"))


@query("sf57_estimated_lines", "SELECT doc_id, CAST(greatest(1, ceil(length(text) * 0.56::DOUBLE * 10.0::DOUBLE / 300.0::DOUBLE)) AS INTEGER) AS lines FROM documents")
def estimated_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.estimated_lines(F.col("text"), F.lit(300.0), F.lit(10.0)).alias("lines"))


@query("sf60_quality_issues", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'blank,numbers,citations' WHEN 1 THEN 'citations,repeated' ELSE '' END AS issues FROM documents")
def quality_issues(spark, sf_dir):
    t = F.expr("CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '12 3!!!' ELSE '[12] 3' END")
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.quality_issues(F.lit("see [12] and 3"), t), ",").alias("issues"))


@query("sf58_decoded", "SELECT doc_id, lang || ' é<' AS value FROM documents")
def decoded(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", parsing.decoded_udf(F.expr("lang || ' &eacute;&#60;'")).alias("value"))


@query("sf53_common_areas", "SELECT l_orderkey, l_partkey, l_linenumber, least(l_quantity, 20.0) * 2 AS area FROM lineitem")
def common_areas(spark, sf_dir):
    from ..operators import geometry

    d = lambda x: F.lit(float(x))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", geometry.overlap(geometry.box(d(0), d(0), F.col("l_quantity"), d(2)), geometry.box(d(0), d(0), d(20), d(9))).alias("area"))


LANES = "lower(lpad(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(u, lambda x: x::UBIGINT)), lambda h, x: ((xor(h, x) * 16777619::UBIGINT) & 4294967295::UBIGINT)::UBIGINT)), 8, '0')) || lower(lpad(to_hex(list_reduce(list_prepend(2654435769::UBIGINT, list_transform(u, lambda x, i: ((x + i * 131) & 4294967295)::UBIGINT)), lambda h, x: ((xor(h, x) * 2246822507::UBIGINT) & 4294967295::UBIGINT)::UBIGINT)), 8, '0'))"


def print_of(json: str) -> str:
    """SQL: the fingerprint of a text without signs beyond 16 bits, of every row of documents."""
    return f"SELECT doc_id, {LANES} AS value FROM (SELECT doc_id, list_transform(string_split({json}, ''), lambda c: unicode(c)) AS u FROM documents) d"


@query("sf63_quote_identities", print_of("""'{"blockID":"b' || CAST(doc_id AS VARCHAR) || '","documentID":"d1","kind":"text","page":' || CAST(doc_id % 9 AS VARCHAR) || ',"side":"source","text":"' || lang || ' ' || source || '"}'"""))
def quote_identities(spark, sf_dir):
    """Six fields, in the order of their names."""
    six = F.struct(F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("blockID"), F.lit("d1").alias("documentID"), F.lit("text").alias("kind"), (F.col("doc_id") % 9).alias("page"), F.lit("source").alias("side"), F.concat_ws(" ", "lang", "source").alias("text"))
    return docs(spark, sf_dir).select("doc_id", T.fingerprint(F.to_json(six)).alias("value"))


@query("sf35_unique_paths", "SELECT conv_id, turn, role || CASE WHEN n > 1 THEN ' (' || CAST(n AS VARCHAR) || ')' ELSE '' END || '.md' AS name FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) q")
def unique_paths(spark, sf_dir):
    p = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(".md")).alias("path"))
    return sequences.unique_paths(p, "conv_id", "turn", "path").select("conv_id", "turn", "name")


FNV = "lower(lpad(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x)::UBIGINT)), lambda h, x: ((xor(h, x) * 16777619::UBIGINT) & 4294967295::UBIGINT)::UBIGINT)), 8, '0'))"


@query("wn09_chunk_table", f"SELECT conv_id, turn, CAST(e - length(text) AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", '[[CHUNK_END_' || lpad(CAST(n AS VARCHAR), 4, '0') || '_' || {FNV} || ']]' AS marker FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) q")
def chunk_table(spark, sf_dir):
    return sequences.chunk_table(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "start", "end", "marker")


@query("wn11_page_ranges", """
WITH RECURSIVE p AS (SELECT user_id % 5 AS d, event_id AS page, value AS score, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id % 5) AS total FROM events),
e AS (SELECT p.d, p.i AS first, CASE WHEN p.i + 200 >= p.total THEN p.total - 1 ELSE max(CASE WHEN q.i = b.i THEN q.i END) END AS last
      FROM p JOIN p q ON q.d = p.d AND q.i BETWEEN p.i + 180 AND p.i + 199 JOIN (SELECT p.d, p.i AS f, arg_max(q.i, struct_pack(s := q.score, i := q.i)) AS i FROM p JOIN p q ON q.d = p.d AND q.i BETWEEN p.i + 180 AND p.i + 199 GROUP BY 1, 2) b ON b.d = p.d AND b.f = p.i GROUP BY p.d, p.i, p.total
      UNION ALL SELECT d, i, total - 1 FROM p WHERE i + 180 >= total),
r AS (SELECT d, 0 AS part, first, last FROM e WHERE first = 0 UNION ALL SELECT e.d, r.part + 1, e.first, e.last FROM r JOIN e ON e.d = r.d AND e.first = r.last + 1)
SELECT r.d AS document_id, part, a.page AS first, z.page AS last FROM r JOIN p a ON a.d = r.d AND a.i = r.first JOIN p z ON z.d = r.d AND z.i = r.last""")
def page_ranges(spark, sf_dir):
    p = load(spark, sf_dir, "events").selectExpr("user_id % 5 AS document_id", "event_id AS page", "value AS score")
    return sequences.page_ranges(p, "document_id", "page", "score")


@query("wn18_toc_entries", r"SELECT doc_id, regexp_extract(line, p, 1) AS number, regexp_extract(line, p, 2) AS title, regexp_extract(line, p, 3) AS page FROM (SELECT doc_id, unnest(string_split(' 1.' || CAST(doc_id AS VARCHAR) || '  ' || lang || ' ..... xiv ' || chr(10) || text, chr(10))) AS line, '(?i)^\s*(\d+(?:\.\d+)*\.?)\s+(.+?)\s*(?:\.{2,}|…{2,}|·{2,}|-{3,})\s*(\d+|[ivxlcdm]+)\s*$' AS p FROM documents) l WHERE regexp_matches(line, p)")
def toc_entries(spark, sf_dir):
    """Every line of every text, after one that is an entry."""
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split(F.expr("' 1.' || doc_id || '  ' || lang || ' ..... xiv ' || chr(10) || text"), "\n")).alias("line"))
    return lines.select("doc_id", T.toc_entry(F.col("line")).alias("e")).where("e IS NOT NULL").select("doc_id", "e.*")


@query("jn19_captions", "WITH w AS (SELECT conv_id, turn, lag(role, 1) OVER o AS b1, lag(role, 2) OVER o AS b2, lead(role, 1) OVER o AS a1, lead(role, 2) OVER o AS a2 FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CASE WHEN 'user' IN (b1, b2, a1, a2) THEN 'user' END AS near FROM w")
def captions(spark, sf_dir):
    return sequences.first_near(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "^user$", 2).select("conv_id", "turn", "near")


@query("jn10_unique_matches", "SELECT l_orderkey, l_partkey FROM (SELECT o.l_orderkey, p.l_partkey, count(*) OVER (PARTITION BY o.l_orderkey) AS n FROM (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) o JOIN lineitem p ON o.l_orderkey = p.l_orderkey AND o.q = p.l_quantity) m WHERE n = 1")
def unique_matches(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    top = li.groupBy("l_orderkey").agg(F.max("l_quantity").alias("l_quantity"))
    one = li.join(top, ["l_orderkey", "l_quantity"]).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.first("l_partkey").alias("l_partkey"))
    return one.where("n = 1").select("l_orderkey", "l_partkey")


@query("sk10_workspace_export", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def workspace_export(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "event_type")))).alias("json"))
    return rows.select("user_id", F.json_array_length("json").cast("long").alias("n"))


@query("ge13_region_unions", f"WITH b AS ({BOX}) SELECT page, min(x0) - 1 AS x0, max(x1) + 1 AS x1 FROM b WHERE (x0 + x1) / 2 BETWEEN 8 AND 42 AND (y0 + y1) / 2 BETWEEN 8 AND 32 GROUP BY 1")
def region_unions(spark, sf_dir):
    b = _page_boxes(spark, sf_dir)
    regions = b.select("page").distinct().selectExpr("page", "1 AS region", "10.0D AS x0", "10.0D AS y0", "40.0D AS x1", "30.0D AS y1")
    hits = layout.boxes_in_region(b, regions, "page", 2.0).join(b, ["page", "box"])
    return hits.groupBy("page").agg((F.min("x0") - 1).alias("x0"), (F.max("x1") + 1).alias("x1"))


@query("ge27_image_numbers", "SELECT page_id, CAST(n AS INTEGER) AS n, printf('IMAGE_%03d', n) AS label, CASE n WHEN 1 THEN 'a.png' ELSE 'b.png' END AS target FROM pages, (VALUES (1), (2)) t(n)")
def image_numbers(spark, sf_dir):
    refs = T.image_references(F.concat(F.lit("![x](a.png) and ![](b.png) "), F.regexp_replace("html", r"[!\[\]()]", "")))
    rows = load(spark, sf_dir, "pages").select("page_id", F.posexplode(refs).alias("pos", "r"))
    return rows.select("page_id", (F.col("pos") + 1).alias("n"), F.format_string("IMAGE_%03d", F.col("pos") + 1).alias("label"), "r.target")


@query("sf70_valid_diagrams", f"SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 <> 1 AS valid FROM documents")
def valid_diagrams(spark, sf_dir):
    """A diagram counts while it is complete and made from what its source now is."""
    now = T.fingerprint(F.col("text"))
    made = F.when(F.col("doc_id") % 3 == 0, T.fingerprint(F.concat("text", F.lit(" ")))).otherwise(T.fingerprint(F.regexp_replace("text", "\n", "\r\n")))
    status = F.when(F.col("doc_id") % 4 == 1, "partial").otherwise("complete")
    return docs(spark, sf_dir).select("doc_id", library.current_translation(status, made, now).alias("valid"))


@query("sf46_formulas_replaced", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'y' ELSE p_name END AS tex, p_partkey % 4 = 0 AS changed FROM part")
def formulas_replaced(spark, sf_dir):
    f = load(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS tex")
    return library.formulas_replaced(f, f.where("id % 4 = 0").selectExpr("id", "'y' AS tex"))


@query("sf27_partial_json", "SELECT event_id, pos, '{\"n\":' || CAST(pos AS VARCHAR) || '}' AS object FROM events, (VALUES (0), (1)) t(pos)")
def partial_json(spark, sf_dir):
    s = F.expr("concat('{\"items\":[{\"n\":0},{\"n\":1},{\"n\":', event_id)")
    return load(spark, sf_dir, "events").select("event_id", F.posexplode(parsing.json_objects_udf(s)).alias("pos", "object"))


@query("sf31_document_fingerprints", print_of("""'{"formulas":[],"images":[],"markdown":"' || lang || '","pages":[{"blocks":[{"bbox":[0,1],"id":"b' || CAST(doc_id AS VARCHAR) || '","order":0,"text":"' || source || '","type":"text"}],"height":2,"page":1,"width":1}]}'"""))
def document_fingerprints(spark, sf_dir):
    """Stable JSON of what counts of a document: names in order, whatever order they came in."""
    raw = F.concat(F.lit('{"markdown": "'), F.col("lang"), F.lit('", "pages": [{"page": 1, "width": 1, "height": 2, "blocks": [{"type": "text", "id": "b'), F.col("doc_id").cast("string"), F.lit('", "text": "'), F.col("source"), F.lit('", "bbox": [0, 1], "order": 0}]}], "images": [], "formulas": []}'))
    return docs(spark, sf_dir).select("doc_id", T.fingerprint(parsing.stable_json_udf(raw)).alias("value"))


@query("wn07_sentence_groups", r"""
WITH RECURSIVE s AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents) d),
r AS (SELECT doc_id, i, 0 AS chunk, length(t) + 1 AS size FROM s WHERE i = 1
      UNION ALL SELECT s.doc_id, s.i, CASE WHEN r.size + length(s.t) + 1 > 1000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size + length(s.t) + 1 > 1000 THEN length(s.t) + 1 ELSE r.size + length(s.t) + 1 END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
SELECT r.doc_id, chunk, string_agg(t, ' ' ORDER BY r.i) AS text FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i GROUP BY 1, 2""")
def sentence_groups(spark, sf_dir):
    """Whole sentences in chunks of at most 1000 signs, a longer sentence alone."""
    s = F.split("text", r"(?<=[.!?。！？])\s+")
    d = docs(spark, sf_dir).select("doc_id", F.arrays_zip(s.alias("s"), sequences.greedy_groups(F.transform(s, lambda x: F.length(x)), 1000, 1 << 30, 1).alias("g")).alias("x"))
    rows = d.select("doc_id", F.explode(F.transform("x", lambda x, i: F.struct(x["g"].alias("chunk"), i.alias("i"), x["s"].alias("s")))).alias("x")).groupBy("doc_id", "x.chunk").agg(F.array_sort(F.collect_list(F.struct("x.i", "x.s"))).alias("p"))
    return rows.select("doc_id", "chunk", F.array_join(F.transform("p", lambda p: p["s"]), " ").alias("text"))


LINES_OF = "array(named_struct('spans', array(named_struct('type', 'text', 'content', ''), named_struct('type', 'inline_Equation', 'content', lang))), named_struct('spans', array(named_struct('type', 'interline_formula', 'content', source))))"


@query("ge05_formula_spans", "SELECT doc_id, lang || ',' || source AS spans FROM documents")
def formula_spans(spark, sf_dir):
    spans = layout.spans_of(F.expr(LINES_OF), "equation|formula|latex")
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(spans, lambda s: s["content"]), ",").alias("spans"))


@query("ge06_image_paths", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own.png' ELSE lang END AS path FROM documents")
def image_paths(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", layout.first_filled(F.expr("CASE WHEN doc_id % 2 = 0 THEN 'own.png' ELSE '' END"), F.expr(LINES_OF)).alias("path"))


@query("jn15_within_band", "SELECT a.user_id, a.event_id AS caption, b.event_id AS \"table\" FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND abs(a.value - b.value) < 3.5")
def within_band(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return layout.within_band(e.where("event_id % 2 = 0").selectExpr("user_id", "event_id AS caption", "value AS bottom"), e.where("event_id % 2 = 1").selectExpr("user_id", "event_id AS table", "value AS top"), "user_id", 3.5)


@query("jn13_back_mapped", "SELECT event_id AS page, 1 AS item, CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS block, 5.0::DOUBLE AS x, 2.0::DOUBLE AS y FROM events")
def back_mapped(spark, sf_dir):
    from ..operators import geometry

    d = lambda x: F.lit(float(x))
    left = F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(100.0)
    e = load(spark, sf_dir, "events")
    lines = e.select(F.col("event_id").alias("page"), F.lit(1).alias("item"), geometry.box(left + 5, d(2), left + 40, d(12)).alias("b"))
    cells = e.select(F.col("event_id").alias("page"), F.explode(F.array(F.struct(F.lit("a").alias("block"), geometry.box(d(0), d(0), d(90), d(50)).alias("bb")), F.struct(F.lit("b").alias("block"), geometry.box(d(100), d(0), d(190), d(50)).alias("bb")))).alias("c")).select("page", "c.*")
    return layout.back_mapped(lines, cells, 60.0)


@query("ge20_local_right_edges", "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id % 100 RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS \"right\" FROM events")
def local_right_edges(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type", "event_id % 100 AS y0", "value AS x1")
    return layout.local_right_edge(e, "user_id", "event_type", 10).select("user_id", "event_id", "right")


@query("ag14_densest_profiles", "WITH c AS (SELECT user_id % 20 AS d, event_id % 9 AS page, event_id % 3 * 10 AS l, event_id % 3 * 10 + 50 AS r FROM events), g AS (SELECT d, l, r, count(*) AS n, count(DISTINCT page) AS p FROM c GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, l, r) AS k FROM g WHERE n >= 3 AND p >= 2) SELECT d, CAST(l AS DOUBLE) AS \"left\", CAST(r AS DOUBLE) AS \"right\", n FROM b WHERE k = 1")
def densest_profiles(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("user_id % 20 AS d", "event_id % 9 AS page", "event_id % 3 * 10 AS x0", "event_id % 3 * 10 + 50 AS x1")
    return layout.densest_profile(e, "d", 5.0)
