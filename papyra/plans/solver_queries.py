"""Queries of the layout solver's rules, over pages of eight boxes made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout, solver
from .registry import load, query

#: Two columns of boxes a page, in SQL that Spark and DuckDB share.
BOX_COLUMNS = [
    "CAST(floor(event_id / 8) AS BIGINT) AS page",
    "event_id % 8 AS box",
    "CAST(CASE WHEN event_id % 16 = 15 THEN 20 ELSE event_id % 2 * 300 + event_id % 5 * 3 + 20 END AS DOUBLE) AS x0",
    "CAST(event_id % 8 * 60 AS DOUBLE) AS y0",
    "CAST(CASE WHEN event_id % 16 = 15 THEN 580 ELSE event_id % 2 * 300 + event_id % 5 * 3 + 200 + event_id % 3 * 40 END AS DOUBLE) AS x1",
    "CAST(event_id % 8 * 60 + 15 + event_id % 4 * 12 AS DOUBLE) AS y1",
    "CAST(event_id % 4 + 1 AS INT) AS lines",
]
BOXES = f"(SELECT {', '.join(BOX_COLUMNS)} FROM events)"
WIDTH, HEIGHT = 600.0, 840.0


def boxes(spark, sf_dir):
    return load(spark, sf_dir, "events").selectExpr(*BOX_COLUMNS)


PUBLISHER = "CASE doc_id % 9 WHEN 0 THEN 'Keywords: a, b' WHEN 1 THEN 'PACS 编号：12' WHEN 2 THEN 'Published Online: 3 May' WHEN 3 THEN '(c) 2020 ' || source WHEN 4 THEN '关键词: ' || lang WHEN 5 THEN 'x (All Rights reserved)' WHEN 6 THEN 'DOI 10.1/x' ELSE text END"


@query("fl23_metadata_lines", f"SELECT doc_id, doc_id % 9 < 6 OR (doc_id % 9 > 6 AND (regexp_matches(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '^(?:pacs|keyword|keywords|doi)\\s*[:：]|^(?:pacs numbers|published under an exclusive license|cite as:|citation:|submitted:|accepted:|published online:|online publication:|authors? to whom correspondence)|all rights reserved|elsevier|copyright|^(?:©|\\(c\\))'))) AS metadata FROM documents")
def metadata_lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", solver.metadata_like(F.expr(PUBLISHER)).alias("metadata"))


@query("fl23_prose", r"SELECT doc_id, doc_id % 3 <> 2 AND NOT contains(lower(text), 'http') AND NOT contains(lower(text), 'www.') AND NOT contains(lower(text), 'all rights reserved') AND NOT contains(lower(text), 'elsevier') AND NOT contains(lower(text), 'copyright') AND len(regexp_extract_all(text, '[.!?。！？]')) >= 2 AND len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]{2,}')) >= 32 AND length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 180 AS prose FROM documents")
def prose(spark, sf_dir):
    top = F.when(F.col("doc_id") % 3 == 2, 100.0).otherwise(300.0)
    p = solver.prose_like(F.col("text"), F.lit("left"), top, F.lit(50.0), F.lit(4), F.lit(HEIGHT))
    return load(spark, sf_dir, "documents").select("doc_id", p.alias("prose"))


@query("fl14_byline_like", r"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE ELSE FALSE END AS value FROM documents")
def byline_like(spark, sf_dir):
    c = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Anna Berg' WHEN 1 THEN 'Anna Berg wrote.' WHEN 2 THEN 'x1† ' ELSE '12 34' END")
    return load(spark, sf_dir, "documents").select("doc_id", T.byline_like(c).alias("value"))


@query("sf54_quads", "SELECT event_id, event_id % 30 < 20 AS straight, abs(event_id % 30 - 10) < 10 AS diamond, abs(event_id % 30 - 10) < 8 AS shrunk FROM events")
def quads(spark, sf_dir):
    d = lambda x: F.lit(float(x))
    x = (F.col("event_id") % 30).cast("double")
    a = solver.quad(d(0), d(0), d(20), d(20))
    moved = solver.quad(x, d(5), x + 20, d(25))
    lozenge = lambda m: F.array(F.array(m, d(0)), F.array(m + 5, d(5)), F.array(m, d(10)), F.array(m - 5, d(5)))
    return load(spark, sf_dir, "events").select("event_id", solver.quads_overlap(a, moved).alias("straight"), solver.quads_overlap(lozenge(d(10)), lozenge(x)).alias("diamond"), solver.quads_overlap(solver.shrunk(lozenge(d(10))), solver.shrunk(lozenge(x))).alias("shrunk"))


@query("jn17_column_keys", f"SELECT page, box, CASE WHEN x1 - x0 > {WIDTH} * 0.82 THEN 'full' WHEN x0 < 200 THEN 'column-0' ELSE 'column-1' END AS column_key FROM {BOXES} b")
def column_keys(spark, sf_dir):
    return solver.column_keys(boxes(spark, sf_dir), "page", WIDTH).select("page", "box", "column_key")


@query("ge14_promoted", f"""
WITH b AS (SELECT *, CASE WHEN x1 - x0 > {WIDTH} * 0.82 THEN 'full' WHEN x0 < 200 THEN 'column-0' ELSE 'column-1' END AS k, box % 3 <> 0 AS candidate FROM {BOXES} q),
s AS (SELECT *, candidate AND (lines > 1 OR y1 - y0 > {HEIGHT} * 0.035 OR x1 - x0 > {WIDTH} * 0.48) AS seed FROM b)
SELECT page, box, seed OR EXISTS (SELECT 1 FROM s a WHERE a.page = s.page AND a.seed AND a.k = s.k AND a.k <> 'full' AND abs(s.x0 - a.x0) <= greatest(18.0, (a.x1 - a.x0) * 0.08) AND (abs(s.x1 - a.x1) <= greatest(18.0, (a.x1 - a.x0) * 0.08) OR (s.x1 <= a.x1 + greatest(18.0, (a.x1 - a.x0) * 0.08) AND s.x1 - s.x0 >= (a.x1 - a.x0) * 0.45))) AS promoted FROM s""")
def promoted(spark, sf_dir):
    b = solver.column_keys(boxes(spark, sf_dir), "page", WIDTH).withColumn("candidate", F.col("box") % 3 != 0)
    return solver.promoted(b, "page", WIDTH, HEIGHT).select("page", "box", "promoted")


WIDE = "(SELECT CAST(floor(event_id / 40) AS BIGINT) AS doc, CAST(floor(event_id / 8) AS BIGINT) % 5 AS page, event_id % 8 AS box, CAST(60 + event_id % 4 * 5 AS DOUBLE) AS x0, CAST(event_id % 8 * 60 AS DOUBLE) AS y0, CAST(CASE WHEN event_id % 6 = 0 THEN 250 ELSE 530 + event_id % 3 * 5 END AS DOUBLE) AS x1, CAST(event_id % 8 * 60 + 30 AS DOUBLE) AS y1, CAST(event_id % 5 + 1 AS INT) AS lines FROM events)"


@query("ge16_single_column", f"""
WITH r AS (SELECT *, abs(x0 / 600 - 0.1) <= 0.045 AND abs(x1 / 600 - 0.9) <= 0.055 AND lines >= 3 AND (y1 - y0) / 840 >= 0.025 AND (x1 - x0) / 600 >= 0.72 AS body FROM {WIDE} w),
a AS (SELECT *, max(CAST(body AS INT)) OVER (PARTITION BY doc, page) AS anchored FROM r)
SELECT doc, page, box, CASE WHEN body THEN 'body' WHEN lines IN (1, 2) AND anchored = 1 AND page > 0 AND abs(x0 / 600 - 0.1) <= 0.045 AND x1 / 600 <= 0.955 AND x1 - x0 >= 480 * 0.2 THEN 'inherited' END AS role FROM a""")
def single_column(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    b = e.selectExpr("CAST(floor(event_id / 40) AS BIGINT) AS doc", "CAST(floor(event_id / 8) AS BIGINT) % 5 AS page", "event_id % 8 AS box", "CAST(60 + event_id % 4 * 5 AS DOUBLE) AS x0", "CAST(event_id % 8 * 60 AS DOUBLE) AS y0", "CAST(CASE WHEN event_id % 6 = 0 THEN 250 ELSE 530 + event_id % 3 * 5 END AS DOUBLE) AS x1", "CAST(event_id % 8 * 60 + 30 AS DOUBLE) AS y1", "CAST(event_id % 5 + 1 AS INT) AS lines")
    profiles = b.select("doc").distinct().selectExpr("doc", "0.1D AS left", "0.9D AS right")
    return solver.single_column(b, profiles, "doc", "page", 600.0, 840.0).select("doc", "page", "box", "role")


@query("ge19_equation_dense", f"""
WITH b AS (SELECT * FROM {BOXES} q), e AS (SELECT * FROM b WHERE box % 3 = 1), h AS (
  SELECT s.page, s.box, max(CASE WHEN s.y0 - e.y1 BETWEEN 0 AND 28 THEN 1 ELSE 0 END) AS up, max(CASE WHEN e.y0 - s.y1 BETWEEN 0 AND 28 THEN 1 ELSE 0 END) AS down
  FROM b s JOIN e ON s.page = e.page AND least(s.x1, e.x1) - greatest(s.x0, e.x0) >= 0.35 * least(s.x1 - s.x0, e.x1 - e.x0)
  WHERE s.lines <= 4 AND s.y1 - s.y0 <= greatest(54.0, {HEIGHT} * 0.07) GROUP BY 1, 2)
SELECT page, box, coalesce(up + down = 2, FALSE) AS dense FROM b LEFT JOIN h USING (page, box)""")
def equation_dense(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return solver.equation_dense(b, b.where("box % 3 = 1"), "page", HEIGHT).select("page", "box", "dense")


@query("ge21_retreated", "SELECT event_id AS page, s AS stream, CASE s WHEN 1 THEN CASE WHEN event_id % 40 BETWEEN 1 AND 39 THEN 280 + event_id % 40 / 2.0 ELSE 280 END WHEN 0 THEN 20 ELSE 20 END::DOUBLE AS x0, CASE s WHEN 0 THEN CASE WHEN event_id % 40 BETWEEN 1 AND 39 THEN 280 + event_id % 40 / 2.0 ELSE 280 END WHEN 1 THEN 560 ELSE 590 END::DOUBLE AS x1 FROM events, (VALUES (0), (1), (2)) t(s)")
def retreated(spark, sf_dir):
    rows = "stack(3, 0, 'column-0', 20D, 0D, CAST(280 + event_id % 40 AS DOUBLE), 300D, 1, 'column-1', 280D, 100D, 560D, 400D, 2, 'full', 20D, 0D, 590D, 800D) AS (stream, column_key, x0, y0, x1, y1)"
    return solver.retreated(load(spark, sf_dir, "events").selectExpr("event_id AS page", rows), "page").select("page", "stream", "x0", "x1")


@query("ge11_collapsed_lines", "SELECT event_id AS page, 1::BIGINT AS block, CAST(2 + event_id % 3 AS INTEGER) AS rows FROM events WHERE event_id % 4 <> 0")
def collapsed_lines(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    blocks = e.selectExpr("event_id AS page", "1L AS block", "'text' AS type", "CASE WHEN event_id % 4 = 0 THEN 3 ELSE 1 END AS lines", "10D AS x0", "10D AS y0", "200D AS x1", "100D AS y1")
    # every row twice, side by side, the second a little lower; and one line outside
    lines = e.selectExpr("event_id AS page", "explode(sequence(0, 2 * (2 + event_id % 3))) AS k").selectExpr("page", "k AS line", "CASE WHEN k % 2 = 0 THEN 12D ELSE 110D END AS x0", "CASE WHEN k = 2 * (2 + page % 3) THEN 500D ELSE 12D + 18 * floor(k / 2) + k % 2 * 2 END AS y0")
    return solver.collapsed_lines(blocks, lines.selectExpr("*", "x0 + 60 AS x1", "y0 + 12 AS y1"), "page")


@query("ge12_first_line_indents", "SELECT event_id AS page, 1::BIGINT AS block, CASE WHEN event_id % 5 = 0 OR event_id % 40 < 5 THEN 0 ELSE least(event_id % 40, 190 * 0.18) END::DOUBLE AS indent FROM events")
def first_line_indents(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    blocks = e.selectExpr("event_id AS page", "1L AS block", "10D AS x0", "10D AS y0", "200D AS x1", "100D AS y1")
    lines = e.selectExpr("event_id AS page", "explode(sequence(0, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 3 END)) AS line").selectExpr("*", "CAST(CASE WHEN line = 0 THEN 10 + page % 40 ELSE 10 END AS DOUBLE) AS x0", "12D + 20 * line AS y0", "200D AS x1", "24D + 20 * line AS y1")
    return solver.first_line_indents(blocks, lines, "page")


@query("ge04_glossaries", "SELECT event_id AS page, 1::BIGINT AS block, event_id % 4 <> 1 AND event_id % 3 <> 2 AS glossary FROM events")
def glossaries(spark, sf_dir):
    # ten lines, or seven (a third); of one page in four two lines in five are no entries
    span = lambda kind, content, x0, x1: f"named_struct('type', '{kind}', 'content', {content}, 'x0', CAST({x0} AS DOUBLE), 'x1', CAST({x1} AS DOUBLE))"
    plain = f"array({span('text', repr('plain words'), 20, 200)})"
    formula = f"array({span('inline_equation', 'concat(\'a_\', line)', '20 + line', '30 + line')}, {span('text', repr(' '), 31, 32)}, {span('Text', repr('meaning'), '60 + line', 90)})"
    letter = f"array({span('text', repr('x'), 20, 25)}, {span('text', repr('meaning'), 62, 90)})"
    lines = load(spark, sf_dir, "events").selectExpr("event_id AS page", "explode(sequence(1, CASE WHEN event_id % 3 = 2 THEN 7 ELSE 10 END)) AS line")
    lines = lines.selectExpr("page", "1L AS block", "line", f"CASE WHEN page % 4 = 1 AND line % 5 < 2 THEN {plain} WHEN line % 2 = 0 THEN {formula} ELSE {letter} END AS spans")
    return solver.glossary_blocks(lines, "page")


@query("ge24_rotated_words", "SELECT event_id AS page, t.line, CASE t.line WHEN 0 THEN CASE event_id % 3 WHEN 0 THEN 'Low Up' ELSE 'Low' END WHEN 1 THEN 'Up' ELSE 'x1' END AS text, CASE WHEN t.line = 0 AND event_id % 3 = 0 THEN 0.5 WHEN t.line = 1 THEN 0.5 ELSE 0.9 END::DOUBLE AS score FROM events, (VALUES (0), (1), (2)) t(line) WHERE NOT (event_id % 3 = 0 AND t.line = 1)")
def rotated_words(spark, sf_dir):
    rows = "stack(3, 0, 'Low', -90, 0.9D, 10D, 40D, 20D, 70D, 1, 'Up', CASE WHEN event_id % 3 = 2 THEN 0 ELSE -90 END, 0.5D, 11D, 5D, 21D, CASE WHEN event_id % 3 = 1 THEN 20D ELSE 36D END, 2, 'x1', -90, 0.9D, 10D, 72D, 20D, 99D) AS (line, text, rotation, score, x0, y0, x1, y1)"
    return solver.rotated_words(load(spark, sf_dir, "events").selectExpr("event_id AS page", rows), "page").select("page", "line", "text", "score")


@query("jn10_table_blocks", f"""
WITH b AS (SELECT * FROM {BOXES} q), k AS (SELECT page, box, x0 - box % 2 * 300 AS a, y1 - y0 AS h FROM b)
SELECT t.page, t.box AS row, CASE WHEN n = 1 THEN o END AS block FROM k t JOIN (SELECT page, a, h, count(*) AS n, min(box) AS o FROM k GROUP BY 1, 2, 3) g ON t.page = g.page AND t.a = g.a AND t.h = g.h""")
def table_blocks(spark, sf_dir):
    """Boxes moved to the left margin and the page's head, so that some are alike; rows carry them a hundredth off."""
    bbox = lambda off: F.array(F.col("x0") - F.col("box") % 2 * 300 + off, F.lit(0.0), F.lit(0.0), F.col("y1") - F.col("y0") - off)
    b = boxes(spark, sf_dir)
    rows = b.select("page", F.col("box").alias("row"), bbox(0.01).alias("bbox"))
    return layout.matched_by_box(rows, b.select("page", F.col("box").alias("block"), bbox(0.0).alias("bbox")), "page").select("page", "row", "block")


RUNS = f"SELECT page, box, x0, y0, coalesce(y0 - lag(y1) OVER w <= 40.0 AND abs(x0 - lag(x0) OVER w) <= 310.0, FALSE) AS joined FROM {BOXES} q WINDOW w AS (PARTITION BY page ORDER BY y0, x0)"


@query("ge18_adjacent_boxes", RUNS.replace("page, box, x0, y0, coalesce", "page, box, coalesce"))
def adjacent_boxes(spark, sf_dir):
    """Lines go on where both the gap above and the shift to the side are small."""
    return layout.adjacent(boxes(spark, sf_dir), ["page"], "y0", "y1", "x0", 40.0, 310.0).select("page", "box", "joined")


@query("wn17_merged_boxes", f"WITH j AS ({RUNS}), r AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y0, x0) AS run FROM j) SELECT page, CAST(run AS BIGINT) AS run, string_agg('t' || CAST(box AS VARCHAR), ' ' ORDER BY y0) AS text, CAST(count(*) AS INTEGER) AS lines FROM r GROUP BY 1, 2")
def merged_boxes(spark, sf_dir):
    lines = boxes(spark, sf_dir).withColumn("text", F.concat(F.lit("t"), F.col("box").cast("string")))
    return layout.merged_lines(layout.adjacent(lines, ["page"], "y0", "y1", "x0", 40.0, 310.0), ["page"], "y0", "text").select("page", "run", "text", "lines")


@query("ge22_uniform_styles")
def uniform_styles(spark, sf_dir):
    """Every document's lines as the paragraphs of three streams."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.named_struct(F.lit("length"), F.length(x), F.lit("indent"), F.lit(8.0)))
    d = load(spark, sf_dir, "documents").select("doc_id", lines.alias("l"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("stream"))
    part = F.filter("l", lambda x, i: i % 3 == F.col("stream"))
    height = F.aggregate(part, F.lit(20.0), lambda s, x: s + F.ceil(x["length"] / 50.0) * 11.0)
    s = d.select("doc_id", "stream", F.lit(230.0).alias("width"), height.alias("height"), (F.lit(8.0) + F.col("stream") * 0.4).alias("font"), F.lit(1.15).alias("ratio"), part.alias("paragraphs"))
    return solver.uniform_styles(s, "doc_id")
