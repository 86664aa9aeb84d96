"""Queries of the named operations, over a workspace made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import workspace
from .registry import load, query

ITEM_COLUMNS = [
    "CAST(c_custkey AS BIGINT) AS id", "1 AS library_id", "'article' AS item_type", "c_name AS title", "'on ' || c_mktsegment AS abstract", "c_mktsegment AS creator",
    "'J' || CAST(c_nationkey AS STRING) AS publication", "'10.1/' || CAST(c_custkey AS STRING) AS doi", "CAST(1990 + c_custkey % 30 AS STRING) AS date", "c_custkey % 10 = 0 AS deleted", "c_nationkey AS nation",
]
ITEMS = f"(SELECT {', '.join(ITEM_COLUMNS)} FROM customer)".replace("STRING", "VARCHAR")
LINES = "(SELECT doc_id AS document_id, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) d)"


def frames(spark, sf_dir) -> workspace.Frames:
    items = load(spark, sf_dir, "customer").selectExpr(*ITEM_COLUMNS).withColumn("tags", F.array("creator", "publication"))
    lines = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.col("pos") % 7 == 3, "image").when(F.col("pos") % 7 == 5, "table").otherwise("text")
    blocks = lines.select("document_id", (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"), (F.col("pos") % 10).alias("place"), F.concat(F.lit("b"), F.col("pos").cast("string")).alias("block_id"), kind.alias("type"), "text")
    made = blocks.where("document_id % 2 = 0").select("document_id", "block_id", F.upper("text").alias("text"), T.fingerprint(F.col("text")).alias("fingerprint"), F.when(F.col("place") < 8, "complete").otherwise("partial").alias("status"))
    regions = load(spark, sf_dir, "region").selectExpr("r_regionkey + 1000L AS id", "CAST(NULL AS BIGINT) AS parent", "r_name AS name")
    nations = load(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_regionkey + 1000L AS parent", "n_name AS name")
    events = load(spark, sf_dir, "events")
    return {
        "items": items,
        "libraries": load(spark, sf_dir, "region").selectExpr("r_regionkey AS id", "r_name AS name"),
        "collections": regions.unionByName(nations),
        "members": items.select(F.col("nation").alias("collection_id"), "id"),
        "blocks": blocks,
        "translations": made,
        "messages": load(spark, sf_dir, "conversations").selectExpr("conv_id AS session_id", "turn AS at", "role", "text"),
        "annotations": events.selectExpr("event_id AS id", "user_id AS item_id", "CAST(event_id % 9 AS INT) AS page", "event_id AS place", "event_type AS type", "'red' AS color", "props AS text", "CAST(event_id % 3 AS STRING) AS comment"),
        "artifacts": events.selectExpr("event_id AS id", "user_id AS document_id", "event_type AS kind", "ts AS updated", "props AS body"),
        "jobs": events.selectExpr("user_id AS id", "'parse' AS kind", "CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'failed' END AS status", "event_id AS at"),
    }


def tool(name: str, sql: str, *columns: str, suffix: str = "", **arguments):
    """Registers ud08_<name>: the operation's columns over the whole workspace."""

    @query(f"ud08_{name}{suffix}", sql)
    def run(spark, sf_dir):
        return workspace.call(name, frames(spark, sf_dir), **arguments).select(*columns)


tool("list_libraries", "SELECT r_regionkey AS id, r_name AS name FROM region", "id", "name")
tool("list_collections", "SELECT n_nationkey::BIGINT AS id, r_name || ' > ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey + 1000, r_name FROM region", "id", "path")
tool("get_collection", "SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 1002", "id", id=1002)
tool("search_collections", "SELECT n_nationkey::BIGINT AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name || ' > ' || n_name), 'a') UNION ALL SELECT r_regionkey + 1000 FROM region WHERE contains(lower(r_name), 'a')", "id", query=" A ")
tool("get_collection_items", f"SELECT id, (SELECT count(*) FROM {ITEMS} i WHERE nation = 7 AND NOT deleted) AS total FROM {ITEMS} i WHERE nation = 7 AND NOT deleted ORDER BY lower(title), id LIMIT 20 OFFSET 3", "id", "total", id=7, offset=3, limit=20)
tool("search_items", f"WITH m AS (SELECT id, title, (CASE WHEN contains(lower(title), 'machinery') THEN 12 ELSE 0 END) + CASE WHEN lower(creator) = 'machinery' THEN 9 ELSE 0 END + CASE WHEN contains(lower(abstract), 'machinery') THEN 5 ELSE 0 END AS score FROM {ITEMS} i WHERE NOT deleted AND (contains(lower(title || ' ' || abstract || ' ' || creator), 'machinery')) AND CAST(date AS INT) BETWEEN 1995 AND 2005) SELECT id, CAST(score AS INTEGER) AS score, (SELECT count(*) FROM m) AS total FROM m ORDER BY score DESC, lower(title), id LIMIT 500", "id", "score", "total", query="Machinery", year_from=1995, year_to=2005, limit=500)
tool("get_papers_status", f"SELECT document_id, count(*) AS blocks, count(DISTINCT floor(pos / 10)) AS pages, count(*) FILTER (WHERE pos % 7 = 3) AS figures, count(*) FILTER (WHERE pos % 7 = 5) AS tables, count(*) FILTER (WHERE document_id % 2 = 0 AND pos % 10 < 8) AS translated FROM {LINES} l GROUP BY 1", "document_id", "blocks", "pages", "figures", "tables", "translated")
tool("get_storage_summary", f"SELECT CASE WHEN pos % 7 = 3 THEN 'image' WHEN pos % 7 = 5 THEN 'table' ELSE 'text' END AS type, count(*) AS blocks, count(DISTINCT document_id) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM {LINES} l GROUP BY 1", "type", "blocks", "documents", "bytes")
tool("list_chat_sessions", "SELECT conv_id AS session_id, max(turn) AS updated, count(*) AS messages FROM conversations GROUP BY 1 ORDER BY updated DESC, session_id LIMIT 50", "session_id", "updated", "messages")
tool("delete_chat_turn", "SELECT conv_id AS session_id, turn AS at FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations) c WHERE NOT (conv_id = 1 AND t = 1)", "session_id", "at", session=1, turn=1)
tool("list_annotations", "SELECT event_id AS id FROM events WHERE user_id = 3 AND contains(lower(props || ' ' || CAST(event_id % 3 AS VARCHAR)), '1') ORDER BY event_id % 9, event_id LIMIT 500", "id", item=3, query="1", limit=500)
tool("list_jobs", "SELECT user_id AS id, event_id AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) e WHERE n = 1 AND event_id % 3 = 1 ORDER BY event_id DESC LIMIT 200", "id", "at", status="running", limit=200)
tool("cancel_job", "SELECT user_id AS id, event_id AS at, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'failed' END AS status FROM events UNION ALL SELECT 4, 999999, 'cancelled' FROM (SELECT max(event_id) AS m FROM events WHERE user_id = 4) l WHERE m % 3 < 2", "id", "at", "status", id=4, at=999999)
tool("process_items", f"SELECT id, d.document_id IS NULL AS parse, d.document_id IS NULL OR t < n AS translate FROM {ITEMS} i LEFT JOIN (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE document_id % 2 = 0 AND pos % 10 < 8) AS t FROM {LINES} l GROUP BY 1) d ON id = d.document_id", "id", "parse", "translate")
tool("literature_graph", f"SELECT DISTINCT 'paper:' || CAST(id AS VARCHAR) AS source, target, kind FROM (SELECT id, 'author:' || lower(creator) AS target, 'written_by' AS kind FROM {ITEMS} i UNION ALL SELECT id, 'topic:' || lower(creator), 'about' FROM {ITEMS} i UNION ALL SELECT id, 'topic:' || lower(publication), 'about' FROM {ITEMS} i UNION ALL SELECT id, 'venue:' || lower(publication), 'published_in' FROM {ITEMS} i) e", "source", "target", "kind")


@query("ud08_read_pages", f"SELECT document_id, page, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM (SELECT *, CAST(floor(pos / 10) + 1 AS INTEGER) AS page FROM {LINES} l WHERE document_id = 5) p GROUP BY 1, 2")
def read_pages(spark, sf_dir):
    """One document's pages: the point lookup that the operation is."""
    return workspace.call("read_pages", frames(spark, sf_dir), document=5, most=1 << 30)


@query("ud08_literature_import", f"SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM {ITEMS} i WHERE id = p_partkey AND NOT deleted)")
def literature_import(spark, sf_dir):
    candidates = load(spark, sf_dir, "part").selectExpr("p_partkey", "'unheard of ' || p_partkey AS title", "CASE WHEN p_partkey % 3 = 0 THEN 'https://doi.org/10.1/' || p_partkey ELSE '' END AS doi")
    return workspace.call("literature_import", frames(spark, sf_dir), candidates=candidates).select("p_partkey")
