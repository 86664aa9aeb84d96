"""Queries of parsers, readers' planning and streams, over texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import parsers, readers
from ..streaming import streams
from .registry import load, query


@query("sc18_bibtex", "SELECT s_suppkey, 'book' AS type, 'k' || CAST(s_suppkey AS VARCHAR) AS key, s_name AS title, CAST(s_nationkey AS VARCHAR) AS year FROM supplier UNION ALL SELECT s_suppkey, 'misc', 'z', 'x y', NULL FROM supplier")
def bibtex(spark, sf_dir):
    s = F.expr("'@Book{ k' || s_suppkey || ',\n Title = {' || s_name || '},\n year = \"' || s_nationkey || '\"\n}\n@misc{z, title = {x {y}}}'")
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.explode(parsers.bibtex_entries(s)).alias("e"))
    return rows.select("s_suppkey", "e.type", "e.key", F.col("e.fields")["title"].alias("title"), F.col("e.fields")["year"].alias("year"))


@query("sc19_csl", "SELECT c_custkey, c_name AS title, '10.1/X' AS doi, 'article-journal' AS type, 2000 + c_nationkey AS issued, 'A B;' || c_mktsegment AS author FROM customer")
def csl(spark, sf_dir):
    s = F.expr("""'[{"title":" ' || c_name || '","DOI":"https://doi.org/10.1/X.","issued":{"date-parts":[[' || (2000 + c_nationkey) || ',1]]},"author":[{"given":"A","family":"B"},{"literal":"' || c_mktsegment || '"},{}]}]'""")
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.explode(parsers.csl_items(s)).alias("r"))
    return rows.select("c_custkey", "r.title", "r.doi", "r.type", "r.issued", F.array_join("r.author", ";").alias("author"))


@query("sc21_atom", "SELECT doc_id, lang || ' & ' || source AS title, 'u' || CAST(doc_id AS VARCHAR) AS id, 'A B|C' AS authors FROM documents")
def atom(spark, sf_dir):
    s = F.expr("'<feed><title>no</title><entry><id> u' || doc_id || '</id><title><![CDATA[' || lang || ' &\n ' || source || ']]></title><author><name> A B </name></author><author><name>C</name></author></entry></feed>'")
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(parsers.atom_entries(s)).alias("e"))
    return rows.select("doc_id", "e.title", "e.id", F.array_join("e.authors", "|").alias("authors"))


@query("sc25_sse_frames", "SELECT conv_id, turn, role AS event, 'a' || chr(10) || 'b' || CAST(turn AS VARCHAR) AS data FROM conversations UNION ALL SELECT conv_id, turn, 'message', 'x' FROM conversations")
def sse_frames(spark, sf_dir):
    s = F.expr("'event: ' || role || '\r\ndata: a\r\ndata:b' || turn || '\r\n\r\n\r\nevent: none\n\ndata: x\n\n'")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(parsers.sse_frames(s)).alias("f")).select("conv_id", "turn", "f.*")


@query("sc12_ocr_pages", "SELECT conv_id, turn, 'p' || CAST(turn AS VARCHAR) || ';q' AS pages FROM conversations")
def ocr_pages(spark, sf_dir):
    s = F.expr("""'{"errorCode":0,"result":{"layoutParsingResults":["p' || turn || '"]}}\n{"errorCode":7,"result":{"layoutParsingResults":["bad"]}}\n{"errorCode":0,"result":{"layoutParsingResults":["q"]}}'""")
    one = F.expr("""'{"errorCode":0,"result":{"layoutParsingResults":["p' || turn || '","q"]}}'""")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(parsers.ocr_pages(F.when(F.col("turn") % 2 == 0, s).otherwise(one)), ";").alias("pages"))


@query("pj19_usage", "SELECT event_id, event_id % 50 AS input, event_id % 7 AS output, event_id % 50 + event_id % 7 AS total, event_id % 3 AS cached, 0::BIGINT AS reasoning FROM events")
def usage(spark, sf_dir):
    s = F.expr("""CASE WHEN event_id % 2 = 0 THEN '{"prompt_tokens":' || event_id % 50 || ',"completion_tokens":' || event_id % 7 || ',"prompt_tokens_details":{"cached_tokens":' || event_id % 3 || '}}' ELSE '{"input_tokens":' || event_id % 50 || ',"output_tokens":' || event_id % 7 || ',"total_tokens":0,"cached_input_tokens":' || event_id % 3 || '}' END""")
    return load(spark, sf_dir, "events").select("event_id", parsers.usage(s).alias("u")).select("event_id", "u.*")


@query("pj18_message_text", "SELECT conv_id, turn, trim(role || chr(10) || '[image]' || chr(10) || text) AS display, trim(role || chr(10) || text) AS full FROM conversations")
def message_text(spark, sf_dir):
    parts = F.expr("array(named_struct('type', 'text', 'text', role), named_struct('type', 'image_url', 'text', NULL), named_struct('type', 'text', 'text', text))")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", parsers.message_text(parts, "[image]").alias("display"), parsers.message_text(parts).alias("full"))


@query("pj01_candidates", "SELECT CASE WHEN doc_id % 2 = 0 THEN '10.5/a' || CAST(doc_id AS VARCHAR) ELSE 'own:' || lower(source) END AS candidate_id, source AS title, lang AS venue, doc_id % 9 AS citations FROM documents")
def candidates(spark, sf_dir):
    r = load(spark, sf_dir, "documents").selectExpr("' ' || source AS title", "CASE WHEN doc_id % 2 = 0 THEN 'doi:10.5/A' || doc_id END AS doi", "'' AS arxiv", "CAST(NULL AS STRING) AS pmid", "2000 AS year", "lang AS venue", "text AS abstract", "doc_id % 9 AS citations", "CAST(NULL AS BOOLEAN) AS open_access")
    return parsers.candidates(r, "own").select("candidate_id", "title", "venue", "citations")


@query("sc03_cards", "SELECT c_custkey, c_name AS title FROM customer WHERE c_custkey % 5 <> 0")
def cards(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity"), F.expr("""CASE WHEN c_custkey % 5 = 0 THEN '{"title": ' ELSE '{"title":"' || c_name || '"}' END""").alias("payload"))
    return readers.cards(rows, "title string").select(F.col("identity").alias("c_custkey"), "card.title")


@query("sc14_multi_part", "SELECT o_custkey, o_orderkey % 3 AS part, o_orderkey, o_orderkey % 4 + coalesce((SELECT sum(m) FROM (SELECT max(o_orderkey % 4) + 1 AS m FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderkey % 3 < o.o_orderkey % 3 GROUP BY i.o_orderkey % 3)), 0) AS page_index FROM orders o")
def multi_part(spark, sf_dir):
    parts = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 3).alias("part"), "o_orderkey", (F.col("o_orderkey") % 4).alias("page_index"))
    return readers.multi_part_pages(parts).select(F.col("document_id").alias("o_custkey"), "part", "o_orderkey", "page_index")


@query("sc16_archive_roots", "SELECT c_custkey, '' AS root, CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 10 END AS score FROM customer")
def archive_roots(spark, sf_dir):
    paths = F.expr("CASE WHEN c_custkey % 2 = 0 THEN array('a/b/full.md', 'a/b/x_model.json', 'a/b/images/1.png', 'z.txt') ELSE array('a/full.md', 'a/x.txt') END")
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.explode(paths).alias("path"))
    return readers.archive_roots(rows, "c_custkey", "path").select("c_custkey", "root", F.col("score").cast("int").alias("score"))


@query("sm01_frames", "SELECT CAST(conv_id AS VARCHAR) AS stream, 'message' AS event, role AS data FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations) c WHERE turn = f")
def frames(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("seq"), F.expr("'data: ' || role || '\n\nda'").alias("chunk"))
    return streams.frames_of_batch(c)


@query("sm02_replies", "SELECT CAST(conv_id AS VARCHAR) AS stream, string_agg(role, '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def replies(spark, sf_dir):
    e = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("seq"), F.to_json(F.struct(F.lit("APPEND").alias("op"), F.col("role").alias("value"))).alias("record"))
    return streams.replies(e)


@query("sm05_step_events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS text, CASE WHEN event_id % 2 = 1 THEN event_type END AS reasoning, CAST(NULL AS BIGINT) AS total_tokens FROM events")
def step_events(spark, sf_dir):
    s = F.expr("""CASE WHEN event_id % 2 = 0 THEN '{"type":"step.delta","delta":{"type":"text","text":"' || event_type || '"}}' ELSE '{"delta":{"type":"thought_summary","content":{"text":"' || event_type || '"}}}' END""")
    return load(spark, sf_dir, "events").select("event_id", streams.step_events(s).alias("e")).select("event_id", "e.*")


@query("sm15_progress", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, greatest(0.0, least(100.0, arg_max(value, ts))) AS value FROM (SELECT DISTINCT ON (ts, event_type) * FROM events ORDER BY ts, event_type, event_id) e GROUP BY 1, 2")
def progress(spark, sf_dir):
    from ..operators.records import first_by

    e = first_by(load(spark, sf_dir, "events").select("ts", "event_type", "value", "event_id"), ["ts", "event_type"], [F.col("event_id")])
    return streams.progress(e, "ts", "10 minutes", "1 minute", "event_type", "value")


@query("sm14_packed_batches", """
WITH RECURSIVE s AS (SELECT conv_id, turn, text, CAST(octet_length(encode(text)) AS BIGINT) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations),
r AS (SELECT conv_id, turn, text, n, b AS size, 0 AS batch FROM s WHERE n = 1
      UNION ALL SELECT s.conv_id, s.turn, s.text, s.n, CASE WHEN r.size + s.b > 900 THEN s.b ELSE r.size + s.b END, CASE WHEN r.size + s.b > 900 THEN r.batch + 1 ELSE r.batch END FROM r JOIN s ON s.conv_id = r.conv_id AND s.n = r.n + 1)
SELECT conv_id, turn, text, batch FROM r""")
def packed_batches(spark, sf_dir):
    return streams.packed_batches(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 900)
