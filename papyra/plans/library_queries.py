"""Queries of library and layout operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import geometry, graphs, layout, library, records, search, sequences
from ..sources import readers
from .record_queries import CARDS, cards
from .registry import load, query

ITEM_COLUMNS = ["c_custkey AS id", "c_nationkey % 3 AS library_id", "c_custkey % 7 = 0 AS deleted", "c_name AS title", "c_mktsegment AS publication", "CASE c_custkey % 4 WHEN 0 THEN 'attachment' WHEN 1 THEN 'note' ELSE 'article' END AS item_type", "CAST(1990 + c_nationkey AS STRING) || '-05-01' AS date", "c_acctbal AS balance"]
ITEMS = f"(SELECT {', '.join(ITEM_COLUMNS)} FROM customer)"


def items(spark, sf_dir):
    return load(spark, sf_dir, "customer").selectExpr(*ITEM_COLUMNS)


@query("sc01_corpus", "SELECT d.doc_id AS document_id, CASE WHEN d.doc_id % 3 <> 0 THEN d.lang END AS source, CASE WHEN l.doc_id IS NOT NULL THEN 't' || CAST(l.toxic AS VARCHAR) END AS translation FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 3 <> 0 OR l.doc_id IS NOT NULL")
def corpus(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    source = d.where("doc_id % 3 <> 0").selectExpr("doc_id AS document_id", "lang AS source")
    made = load(spark, sf_dir, "labels").selectExpr("doc_id AS document_id", "explode(array(struct('b' AS name, 't' || toxic AS translation), struct('a' AS name, ' ' AS translation))) AS x").select("document_id", "x.*")
    titles = d.selectExpr("doc_id AS document_id", "CAST(NULL AS STRING) AS title")
    return readers.corpus(source, made, titles).select("document_id", "source", "translation")


@query("sc02_current_version", "SELECT doc_id FROM labels WHERE quality = 1")
def current_version(spark, sf_dir):
    return library.current_version(load(spark, sf_dir, "labels").withColumnRenamed("quality", "schema_version"), 1).select("doc_id")


@query("sc04_items", f"SELECT id FROM {ITEMS} i WHERE library_id = 1 AND NOT deleted")
def item_scan(spark, sf_dir):
    return library.items(items(spark, sf_dir), 1).select("id")


@query("sc05_collections", "SELECT n_nationkey, n_regionkey FROM nation")
def collections(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")


@query("sc06_libraries", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0")
def libraries(spark, sf_dir):
    return load(spark, sf_dir, "region").where("r_regionkey <> 0").select("r_regionkey", "r_name")


@query("sc23_container_formats", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' ELSE 'unknown' END AS format FROM documents")
def container_formats(spark, sf_dir):
    body = F.expr("CASE doc_id % 3 WHEN 0 THEN CAST('%PDF-1.7' AS BINARY) WHEN 1 THEN X'504B030414' ELSE CAST(lang AS BINARY) END")
    return load(spark, sf_dir, "documents").select("doc_id", readers.container_format(body).alias("format"))


@query("pj02_authors", "SELECT id, title || ';A B' AS authors FROM " + ITEMS + " i")
def authors(spark, sf_dir):
    rows = F.expr("array(named_struct('name', ' ' || title, 'first', NULL, 'last', NULL), named_struct('name', '', 'first', 'A', 'last', 'B'), named_struct('name', NULL, 'first', NULL, 'last', NULL))")
    return items(spark, sf_dir).select("id", F.array_join(library.authors(rows), ";").alias("authors"))


@query("pj03_cards", "SELECT id, title, CAST(substr(date, 1, 4) AS INTEGER) AS year, '10.1/a' || CAST(id AS VARCHAR) AS doi FROM " + ITEMS + " i")
def item_cards(spark, sf_dir):
    c = library.card(F.col("title"), F.array("publication"), F.col("date"), F.expr("'doi:10.1/A' || id"), F.array("publication"))
    return items(spark, sf_dir).select("id", c.alias("c")).select("id", "c.metadata.title", "c.metadata.year", "c.identifiers.doi")


@query("pj04_overlay", "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN 'new' END, title) AS title, CASE WHEN id % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS sources FROM " + ITEMS + " i")
def overlay(spark, sf_dir):
    new = F.when(F.col("id") % 2 == 0, "new")
    more = F.when(F.col("id") % 2 == 0, F.array(F.lit("b"), F.lit("c")))
    return items(spark, sf_dir).select("id", records.overlaid(new, F.col("title")).alias("title"), F.array_join(library.joined_sets(F.array(F.lit("a"), F.lit("b")), more), ",").alias("sources"))


@query("pj05_search_text", f"SELECT id, lower(title || ' ' || abstract || ' ' || venue) AS value FROM {CARDS} c")
def search_text(spark, sf_dir):
    return cards(spark, sf_dir).select("id", library.search_text(F.col("title"), F.col("abstract"), F.col("venue")).alias("value"))


@query("pj06_index_text", f"SELECT id, lower(title || ' ' || author || ' ' || tag || ' ' || doi) AS value FROM {CARDS} c")
def index_text(spark, sf_dir):
    return cards(spark, sf_dir).select("id", library.search_text(*[F.col(x) for x in ("title", "author", "tag", "doi")]).alias("value"))


@query("pj07_item_records", "SELECT id, title, r_name AS collection, coalesce(n, 0) AS attachments FROM (SELECT c_custkey AS id, c_name AS title, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) i LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON id = o_custkey")
def item_records(spark, sf_dir):
    c, n, r = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    files = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    base = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("r_name").alias("collection"))
    return base.join(files, "id", "left").select("id", "title", "collection", F.coalesce("n", F.lit(0)).cast("long").alias("attachments"))


@query("pj08_brief_items", f"SELECT id, title, CAST(substr(date, 1, 4) AS INTEGER) AS year FROM {ITEMS} i WHERE item_type = 'article'")
def brief_items(spark, sf_dir):
    return items(spark, sf_dir).where(library.regular(F.col("item_type"))).select("id", "title", T.year(F.col("date")).alias("year"))


@query("pj09_annotations", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS INTEGER) END AS page, CASE WHEN event_id % 3 = 0 THEN '{\"x\":1}' END AS position, event_id % 5 <> 0 AS has_comment FROM events")
def annotations(spark, sf_dir):
    a = library.annotation(F.expr("CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE 'iv' END"), F.expr("CASE WHEN event_id % 3 = 0 THEN '{\"x\":1}' ELSE '{x' END"), F.expr("CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'note' END"))
    return load(spark, sf_dir, "events").select("event_id", a.alias("a")).select("event_id", "a.*")


@query("pj10_flat_blocks", "SELECT doc_id, CAST(p AS INTEGER) AS page, CAST(i AS INTEGER) AS place, CAST(p * 2 + i + 1 AS INTEGER) AS ordinal, CASE i WHEN 0 THEN lang ELSE source END AS block FROM documents, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(p, i)")
def flat_blocks(spark, sf_dir):
    pages = load(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("blocks"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page"))
    return library.flat_blocks(pages, "doc_id", "blocks").select("doc_id", "page", "place", "ordinal", "block")


@query("pj13_scaled_lines", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 0.5 END AS x1 FROM lineitem")
def scaled_lines(spark, sf_dir):
    d = lambda x: F.lit(float(x))
    h = F.when(F.col("l_linenumber") % 2 == 0, 400.0).otherwise(500.0)
    b = library.scaled_line(d(0), d(0), F.col("l_quantity"), d(1), d(200), d(200), d(100), h / 4)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", b["x1"].alias("x1"))


@query("pj16_light_status", "SELECT doc_id, n_chars > 2000 AS long, doc_id IN (SELECT doc_id FROM labels) AS translated FROM documents")
def light_status(spark, sf_dir):
    made = load(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("t"))
    return load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(made, "doc_id", "left").select("doc_id", (F.col("n_chars") > 2000).alias("long"), F.coalesce("t", F.lit(False)).alias("translated"))


@query("pj20_evidence", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fulltext' WHEN 1 THEN 'abstract' ELSE 'metadata' END AS level, NOT (event_id % 3 = 0 AND event_id % 2 = 0) AS valid FROM events")
def evidence(spark, sf_dir):
    e = library.evidence(F.expr("CASE event_id % 3 WHEN 0 THEN 'FullText' WHEN 1 THEN 'abstract' ELSE 'guess' END"), F.lit("d1"), F.expr("CASE WHEN event_id % 2 = 1 THEN 3 END"), F.lit(""))
    return load(spark, sf_dir, "events").select("event_id", e.alias("e")).select("event_id", "e.*")


@query("pj21_manifests", "SELECT event_id, 3 AS schema_version, 'd' || CAST(event_id AS VARCHAR) AS document_id, event_type AS fingerprint FROM events")
def manifests(spark, sf_dir):
    p = F.expr("""CASE WHEN event_id % 2 = 0 THEN concat('{"documentId":"d', event_id, '","fingerprint":"', event_type, '"}') ELSE concat('{"document_id":"d', event_id, '","source_fingerprint":"', event_type, '"}') END""")
    return load(spark, sf_dir, "events").select("event_id", library.manifest(p).alias("m")).select("event_id", "m.*")


@query("pj23_updated_items", f"SELECT id, CASE WHEN id % 10 = 0 THEN 'T' || CAST(id AS VARCHAR) ELSE title END AS title, item_type FROM {ITEMS} i")
def updated_items(spark, sf_dir):
    i = items(spark, sf_dir).select("id", "title", "item_type")
    values = i.where("id % 10 = 0").selectExpr("id", "'T' || id AS title", "'hacked' AS item_type")
    return library.updated(i, values, "id")


@query("fl02_field_values", f"SELECT id, title AS a, publication AS b, '' AS c FROM {ITEMS} i")
def field_values(spark, sf_dir):
    i = items(spark, sf_dir)
    return i.select("id", F.array_join(library.field_values(i, "Title"), ",").alias("a"), F.array_join(library.field_values(i, "publication-title"), ",").alias("b"), F.array_join(library.field_values(i, "creators"), ",").alias("c"))


@query("fl04_matching_items", f"SELECT id FROM {ITEMS} i WHERE (contains(lower(title), '1') OR contains(lower(publication), '1')) AND lower(publication) = 'building' AND CAST(substr(date, 1, 4) AS INT) BETWEEN 1995 AND 2008 AND NOT deleted")
def matching_items(spark, sf_dir):
    return library.matching(items(spark, sf_dir), "1", equals={"journal": "Building"}, year_from=1995, year_to=2008, deleted=False).select("id")


@query("fl08_corpus_filters", "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3' AND n_chars > 500")
def corpus_filters(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(search.all_of([F.col("lang") == "de", F.array_contains(F.array("source"), "src3"), F.col("n_chars") > 500])).select("doc_id")


@query("fl11_annotations", "SELECT event_id FROM events WHERE contains(lower(props), '1') AND event_type IN ('click', 'view') AND value > 10")
def annotation_filter(spark, sf_dir):
    return load(spark, sf_dir, "events").where(F.lower("props").contains("1") & F.col("event_type").isin("click", "view") & (F.col("value") > 10)).select("event_id")


@query("fl12_regular_items", f"SELECT id FROM {ITEMS} i WHERE item_type = 'article'")
def regular_items(spark, sf_dir):
    return items(spark, sf_dir).where(library.regular(F.col("item_type"))).select("id")


@query("fl18_retry_set", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1)")
def retry_set(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    return library.distinct_hits([d.where("doc_id % 4 = 0"), d.where("doc_id % 4 = 1"), d.where("doc_id % 8 = 0")], "doc_id")


@query("fl19_furniture", "SELECT doc_id, doc_id % 4 IN (0, 1) AS furniture FROM documents")
def furniture(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", library.furniture(F.expr("CASE doc_id % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'page_number' ELSE 'text' END")).alias("furniture"))


@query("fl20_boxes", "SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity, l_tax) AS x0, greatest(l_quantity, l_tax) AS x1, l_linenumber % 3 <> 0 AS valid FROM lineitem")
def valid_boxes(spark, sf_dir):
    b = geometry.box(F.col("l_quantity"), F.when(F.col("l_linenumber") % 3 != 0, 1.0), F.col("l_tax"), F.when(F.col("l_linenumber") % 3 != 0, 2.0))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", b["x0"].alias("x0"), b["x1"].alias("x1"), F.coalesce(geometry.valid(b), F.lit(False)).alias("valid"))


@query("fl21_current", "SELECT doc_id, quality = 1 AND toxic = 0 AS current FROM labels")
def current(spark, sf_dir):
    return load(spark, sf_dir, "labels").select("doc_id", library.current_translation(F.when(F.col("quality") == 1, "complete").otherwise("partial"), F.lit("0"), F.col("toxic").cast("string")).alias("current"))


@query("jn02_indexed_semi_join", r"SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS t FROM documents) q WHERE starts_with(t, 'heit') AND length(t) > 1)")
def indexed_semi_join(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    hits = search.prefix_candidates(search.inverted_index(d, "doc_id", "text"), "doc_id", "heit")
    return d.join(hits, "doc_id", "left_semi").select("doc_id", "source")


@query("jn03_parents_of_hits", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') OR c_custkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def parents_of_hits(spark, sf_dir):
    hits = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS id", "o_custkey AS parent_id")
    return library.parents_of_hits(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), hits)


@query("jn07_tree", "SELECT n_name AS name, r_name || ' > ' || n_name AS path, 1 AS depth FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name, 0 FROM region")
def tree(spark, sf_dir):
    r = load(spark, sf_dir, "region").selectExpr("r_regionkey + 1000L AS id", "CAST(NULL AS BIGINT) AS up", "r_name AS name")
    n = load(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_regionkey + 1000L AS up", "n_name AS name")
    t = r.unionByName(n)
    return graphs.paths(t, "id", "up", "name", 8).join(t.select("id", "name"), "id").select("name", "path", "depth")


@query("jn09_formula_blocks", "SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1")
def formula_blocks(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    holders = li.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("held")).withColumn("at", F.col("l_orderkey"))
    return library.first_holder(li.select("l_partkey").distinct(), holders, "l_partkey", "held", "l_orderkey", "at").select("l_partkey", "l_orderkey")


@query("jn11_located", "WITH q AS (SELECT doc_id, text, doc_id % 2 = 0 AS named FROM documents WHERE length(text) > 50), o AS (SELECT doc_id, 0 AS b, substr(text, 1, CAST(floor(length(text) / 2) AS INT)) AS t FROM q UNION ALL SELECT doc_id, 1, substr(text, CAST(floor(length(text) / 2) AS INT) + 1) FROM q) SELECT doc_id AS quote, CASE WHEN named THEN 1 ELSE (SELECT min(b) FROM o WHERE o.doc_id = q.doc_id AND contains(o.t, left(substr(q.text, CAST(floor(length(q.text) / 2) AS INT) + 1), 80))) END AS found FROM q")
def located(spark, sf_dir):
    """Documents in two blocks; every second quote, the second block itself, names a block that is not there."""
    half = "CAST(floor(length(text) / 2) AS INT)"
    d = load(spark, sf_dir, "documents").where("length(text) > 50")
    blocks = d.selectExpr("doc_id AS document_id", "0 AS block_id", "0 AS place", f"substr(text, 1, {half}) AS text").unionByName(d.selectExpr("doc_id AS document_id", "1 AS block_id", "1 AS place", f"substr(text, {half} + 1) AS text"))
    quotes = d.selectExpr("doc_id AS quote", "doc_id AS document_id", "CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 9 END AS block_id", f"substr(text, {half} + 1) AS text")
    return library.located(quotes, blocks).select("quote", "found")


@query("jn16_nearest_rows", "WITH i AS (SELECT user_id, event_id AS item, value AS v FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id, event_id AS r, value AS w FROM events WHERE event_id % 2 = 1), h AS (SELECT i.user_id, item, r, row_number() OVER (PARTITION BY i.user_id, item ORDER BY abs(v - w), r) AS n FROM i JOIN r ON i.user_id = r.user_id AND abs(v - w) <= 5.0) SELECT user_id, item, r AS row FROM h WHERE n = 1")
def nearest_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    i = e.where("event_id % 2 = 0").selectExpr("user_id", "event_id AS item", "value")
    r = e.where("event_id % 2 = 1").selectExpr("user_id", "event_id AS row", "value")
    return layout.nearest_row(i, r, "user_id", "value", 5.0)


@query("jn20_resolved_assets", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'images/A.png' WHEN 1 THEN 'x/only.png' END AS path FROM documents")
def resolved_assets(spark, sf_dir):
    paths = spark.createDataFrame([("images/A.png",), ("x/only.png",), ("p/two.png",), ("q/two.png",)], "path string")
    wanted = load(spark, sf_dir, "documents").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'IMAGES/a.png' WHEN 1 THEN 'gone/Only.png' ELSE 'two.png' END").alias("target"))
    return library.resolved(wanted, paths, "target", "path").select("doc_id", "path")


@query("jn22_matrix", f"SELECT a.id, b.title FROM {CARDS} a LEFT JOIN {CARDS} b ON a.citations * 10 = b.id")
def matrix(spark, sf_dir):
    c = cards(spark, sf_dir)
    return c.select("id", (F.col("citations") * 10).alias("k")).join(c.select(F.col("id").alias("k"), "title"), "k", "left").select("id", "title")


@query("jn24_cited", "SELECT doc_id, n, '[' || CAST(n + 1 AS VARCHAR) || ']' AS marker, CASE n WHEN 1 THEN lang WHEN 2 THEN source END AS reference FROM documents, (VALUES (1), (2), (3)) t(n)")
def cited(spark, sf_dir):
    c = library.cited(F.lit("a [2] b [3], [4]"), r"\[\d+\]", F.array("lang", "source"))
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(c).alias("c")).select("doc_id", "c.*")


@query("jn25_endpoints", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Node-1' WHEN 1 THEN 'node 2' END AS source_id FROM documents")
def endpoints(spark, sf_dir):
    nodes = spark.createDataFrame([("Node-1",), ("node 2",), ("x-1",), ("X1",)], "id string")
    edges = load(spark, sf_dir, "documents").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'Node-1' WHEN 1 THEN 'NODE2' ELSE 'x 1' END").alias("source"))
    return library.endpoints(edges, nodes, "source").select("doc_id", "source_id")


@query("jn26_translate_queue", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem GROUP BY 1) p ON o_orderkey = l_orderkey WHERE s IS NULL OR s = 'O'")
def translate_queue(spark, sf_dir):
    parsed = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("s")).select("o_orderkey", F.when(F.col("s") == "O", "completed").otherwise("failed").alias("status"))
    return library.translatable_queue(load(spark, sf_dir, "orders"), parsed, "o_orderkey").select("o_orderkey")


@query("ag03_first_wins", f"SELECT doi, min(id) AS id FROM {CARDS} c GROUP BY 1")
def first_wins(spark, sf_dir):
    return records.first_by(cards(spark, sf_dir), ["doi"], [F.col("id")]).select("doi", "id")


@query("ag04_batch_items", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def batch_items(spark, sf_dir):
    return records.first_by(load(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")]).agg(F.count("*").alias("n"))


@query("ag08_signature", "SELECT count(*) AS n, CAST(count(*) AS VARCHAR) || ':' || CAST(bit_xor(h) AS VARCHAR) || ':' || CAST(sum(h) AS VARCHAR) AS signature FROM (SELECT CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || chr(31) || c_name || chr(31) || CAST(c_nationkey AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM customer) c")
def signature(spark, sf_dir):
    return library.signature(load(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_nationkey")


SPELT = "CASE WHEN c_custkey % 7 = 0 THEN replace(c_mktsegment, 'U', 'V') WHEN c_custkey % 11 = 0 THEN substr(c_mktsegment, 2) WHEN c_custkey % 13 = 0 THEN substr(c_mktsegment, 1, 2) || 'Q' || substr(c_mktsegment, 3) ELSE c_mktsegment END"


@query("ag13_majority_spelling", f"WITH l AS (SELECT {SPELT} AS label, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT a.label, c.label AS better, row_number() OVER (PARTITION BY a.label ORDER BY c.n DESC, c.label DESC) AS k FROM l a JOIN l c ON c.n > a.n AND right(a.label, 2) = right(c.label, 2) AND levenshtein(a.label, c.label) <= 2) SELECT l.label, coalesce(better, l.label) AS corrected FROM l LEFT JOIN b ON l.label = b.label AND k = 1")
def majority_spelling(spark, sf_dir):
    return library.majority_spelling(load(spark, sf_dir, "customer").select(F.expr(SPELT).alias("label")), "label")


@query("ag16_distinct_values", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1")
def distinct_values(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("ag18_batch_plan", "SELECT count(*) FILTER (WHERE quality = 0) AS to_parse, count(*) FILTER (WHERE toxic = 0) AS to_translate, count(DISTINCT CASE WHEN quality = 0 OR toxic = 0 THEN doc_id END) AS documents FROM labels")
def batch_plan(spark, sf_dir):
    return library.batch_plan(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("parsed"), (F.col("toxic") == 1).alias("translated")))


@query("ag20_line_summary", "SELECT source, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY 1")
def line_summary(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query("wn13_role_ordinals", "SELECT conv_id, role, max(n) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) q GROUP BY 1, 2")
def role_ordinals(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return load(spark, sf_dir, "conversations").select("conv_id", "role", n.alias("n")).groupBy("conv_id", "role").agg(F.max("n").cast("long").alias("messages"))


@query("wn15_lines_by_baseline", """
WITH RECURSIVE s AS (SELECT user_id AS page, event_id AS item, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events),
r AS (SELECT page, item, n, v AS base, 0 AS line FROM s WHERE n = 1
      UNION ALL SELECT s.page, s.item, s.n, CASE WHEN s.v - r.base <= 3.0 THEN r.base ELSE s.v END, CASE WHEN s.v - r.base <= 3.0 THEN r.line ELSE r.line + 1 END FROM r JOIN s ON s.page = r.page AND s.n = r.n + 1)
SELECT page, item, line FROM r""")
def lines_by_baseline(spark, sf_dir):
    i = load(spark, sf_dir, "events").selectExpr("user_id AS page", "event_id AS item", "value AS baseline", "10.0D AS size")
    return sequences.lines_by_baseline(i, "page")


@query("wn16_column_anchors", "WITH j AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER w > 3.0 OR lag(value) OVER w IS NULL THEN 1 ELSE 0 END AS j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)) SELECT user_id, event_id AS item, CAST(sum(j) OVER (PARTITION BY user_id ORDER BY value, event_id) AS BIGINT) AS anchor FROM j")
def column_anchors(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("user_id", "event_id AS item", "value")
    return layout.column_anchors(e, "user_id", "value", 3.0).select("user_id", "item", "anchor")


@query("wn17_merged_lines", "WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN value - lag(value) OVER w <= 8.0 THEN 0 ELSE 1 END AS b, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY value, event_id) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS lines FROM r GROUP BY 1, 2")
def merged_lines(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("user_id", "value AS top", "value AS bottom", "event_id AS left", "event_type AS text")
    return layout.merged_lines(layout.adjacent(e, ["user_id"], "top", "bottom", "left", 8.0, 1e12), ["user_id"], "top", "text").select("user_id", "run", F.col("lines").cast("long").alias("lines"))


@query("st01_library_sort", f"SELECT id, title FROM {ITEMS} i ORDER BY lower(publication), id LIMIT 100")
def library_sort(spark, sf_dir):
    return items(spark, sf_dir).orderBy(library.natural_key(F.col("publication")), "id").limit(100).select("id", "title")


@query("st04_annotation_order", "SELECT event_id, user_id * 1000000 + event_id AS place FROM events ORDER BY place LIMIT 200")
def annotation_order(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", library.reading_order(F.col("user_id"), F.col("event_id")).alias("place")).orderBy("place").limit(200)


@query("st05_top_candidates", f"SELECT id, score FROM {CARDS} c ORDER BY score DESC, title, id LIMIT 50")
def top_candidates(spark, sf_dir):
    return library.listing(cards(spark, sf_dir), [F.col("score").desc(), F.col("title"), F.col("id")], 50).select("id", "score")


@query("st06_second_page", f"SELECT id, score FROM {CARDS} c ORDER BY score DESC, id LIMIT 50 OFFSET 50")
def second_page(spark, sf_dir):
    return search.page_of(cards(spark, sf_dir), [F.col("score").desc(), F.col("id")], 50, 50).select("id", "score")


@query("st07_discovered", f"SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, row_number() OVER (ORDER BY score DESC, id) <= 10 AS shortlisted FROM {CARDS} c ORDER BY score DESC, id LIMIT 20")
def discovered(spark, sf_dir):
    return library.discovered(cards(spark, sf_dir), "id", "score").select("id", "rank", "shortlisted")


@query("st08_jobs", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 200")
def jobs(spark, sf_dir):
    return library.listing(load(spark, sf_dir, "events"), [F.col("ts").desc(), F.col("event_id")], 500, event_type="click").select("event_id")


@query("st09_artifacts", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def artifacts(spark, sf_dir):
    return library.listing(load(spark, sf_dir, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 30, o_orderstatus="O").select("o_orderkey")


@query("st10_sessions", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1 ORDER BY CASE WHEN user_id = 7 THEN 0 ELSE 1 END, 2 DESC LIMIT 50")
def sessions(spark, sf_dir):
    last = library.latest(load(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")
    return last.orderBy(F.when(F.col("user_id") == 7, 0).otherwise(1), F.col("event_id").desc()).limit(50)


@query("st12_evidence_per_paper", "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)) q WHERE n <= 3")
def evidence_per_paper(spark, sf_dir):
    papers = load(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("l_orderkey"))
    found = load(spark, sf_dir, "lineitem").join(F.broadcast(papers), "l_orderkey", "left_semi")
    return records.retained(found, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_partkey")], 3).select("l_orderkey", "l_partkey")


@query("st13_capped_hits", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 200")
def capped_hits(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(F.lower("text").contains("tion")).orderBy("doc_id").limit(200).select("doc_id", "source")


@query("sr02_blank_tokens", r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda x: x <> '')) AS n FROM documents")
def blank_tokens(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(search.blank_tokens(F.col("text"))).cast("long").alias("n"))


@query("sr04_content_kinds", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'formula' ELSE 'text' END AS kind FROM documents")
def content_kinds(spark, sf_dir):
    k = T.content_kind(F.expr("CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'table' ELSE 'x' END"), F.expr("CASE doc_id % 4 WHEN 2 THEN 'InterlineFormula' ELSE 'text' END"), F.lit(False))
    return load(spark, sf_dir, "documents").select("doc_id", k.alias("kind"))


@query("sr05_snippets", "SELECT doc_id, substr(text, greatest(greatest(instr(lower(text), 'und') - 1, 0) - 180, 0) + 1, greatest(instr(lower(text), 'und') - 1, 0) + 520 - greatest(greatest(instr(lower(text), 'und') - 1, 0) - 180, 0)) AS snippet FROM documents")
def snippets(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", search.snippet(F.col("text"), "und").alias("snippet"))


@query("sr11_formulas", "SELECT p_partkey FROM part WHERE contains(lower(CAST(p_partkey AS VARCHAR) || ' ' || p_name), '12')")
def formulas(spark, sf_dir):
    return load(spark, sf_dir, "part").where(library.search_text(F.col("p_partkey").cast("string"), F.col("p_name")).contains("12")).select("p_partkey")


@query("sr12_label_references", """
WITH p AS (SELECT page_id, string_split(lower(html || ' see Fig. ' || CAST(page_id % 7 AS VARCHAR) || ', FIG. 3'), 'fig. 3') AS parts FROM pages)
SELECT page_id, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 6 * (i - 1) AS INTEGER) AS position FROM (SELECT *, unnest(range(1, least(len(parts), 21))) AS i FROM p) z""")
def label_references(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.expr("html || ' see Fig. ' || page_id % 7 || ', FIG. 3'").alias("t"))
    return search.occurrences(p, "page_id", "t", "Fig. 3", 20).select("page_id", "position")


@query("sr13_collection_search", "SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(n_name || ' ' || r_name || ' > ' || n_name), 'asia')")
def collection_search(spark, sf_dir):
    n = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.where(library.search_text(F.col("n_name"), F.concat_ws(" > ", "r_name", "n_name")).contains("asia")).select("n_nationkey")


@query("sr14_staged_discovery", f"WITH a AS (SELECT id, lower(doi) AS key, score + CASE WHEN in_library THEN 0.5 ELSE 0.0 END AS s FROM {CARDS} c), d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, id) AS n FROM a) SELECT id, CAST(s AS DOUBLE) AS s FROM d WHERE n = 1 ORDER BY s DESC, id LIMIT 20")
def staged_discovery(spark, sf_dir):
    c = cards(spark, sf_dir).withColumn("s", F.col("score") + F.when(F.col("in_library"), 0.5).otherwise(0.0)).withColumn("key", F.lower("doi"))
    best = records.first_by(c, ["key"], [F.col("s").desc(), F.col("id")])
    return library.discovered(best, "id", "s").select("id", "s")


@query("sr15_seed_kinds", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'pmid' ELSE 'title' END AS kind FROM documents")
def seed_kinds(spark, sf_dir):
    s = F.expr("CASE doc_id % 4 WHEN 0 THEN 'https://doi.org/10.5/x' WHEN 1 THEN 'arXiv:2101.00001v2' WHEN 2 THEN '1234567' ELSE lang || ' words' END")
    return load(spark, sf_dir, "documents").select("doc_id", library.seed_kind(s).alias("kind"))


@query("sr16_neighbours", "SELECT DISTINCT l_orderkey AS seed, l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def one_hop(spark, sf_dir):
    edges = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS source", "l_partkey AS target", "'cites' AS kind")
    seeds = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return graphs.neighbours(edges, seeds).select("seed", "target")


@query("sr18_tree_faults", "SELECT 'unknown_parent' AS fault, 0 AS n UNION ALL SELECT 'unreached', 0 UNION ALL SELECT 'repeated', 0 UNION ALL SELECT 'roots', 1")
def tree_faults(spark, sf_dir):
    t = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("up")).where("id > 0")
    return graphs.tree_faults(t, "id", "up")


@query("sr19_edge_faults", "WITH e AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey ELSE n_regionkey END AS s, CASE WHEN n_nationkey = n_regionkey THEN n_regionkey ELSE (n_regionkey + 1) % 5 END AS t FROM nation) SELECT 'repeated' AS fault, 0 AS n UNION ALL SELECT 'unknown_end', count(DISTINCT (s, t)) FROM e WHERE s > 4 UNION ALL SELECT 'loop', count(*) FROM e WHERE s = t")
def edge_faults(spark, sf_dir):
    nodes = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    source = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey")).otherwise(F.col("n_regionkey"))
    target = F.when(F.col("n_nationkey") == F.col("n_regionkey"), F.col("n_regionkey")).otherwise((F.col("n_regionkey") + 1) % 5)
    return library.edge_faults(nodes, load(spark, sf_dir, "nation").select(source.alias("source"), target.alias("target")))


@query("so01_union", "SELECT doc_id, source AS name FROM documents UNION ALL SELECT c_custkey, c_name FROM customer")
def union(spark, sf_dir):
    return records.union_all([load(spark, sf_dir, "documents").selectExpr("doc_id", "source AS name"), load(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "c_name AS name")])


@query("so02_union_distinct", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def union_distinct(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey")
    return library.distinct_hits([c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0")], "c_custkey")


@query("so03_set_union", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'en,x' ELSE lang || ',x,en' END AS value FROM documents")
def set_union(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(library.joined_sets(F.array(F.col("lang"), F.lit("x")), F.array(F.lit("x"), F.lit("en"))), ",").alias("value"))


@query("so04_set_difference", "SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE lang END AS value FROM documents")
def set_difference(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(library.without(F.array(F.col("lang"), F.lit("x")), F.array(F.lit("x"), F.lit("en"))), ",").alias("value"))


@query("so05_set_insertion", "SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS n FROM documents")
def set_insertion(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(library.joined_sets(F.array("lang"), F.array(F.lit("en")))).alias("n"))


@query("so06_multiset_intersection", "SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') q GROUP BY 1")
def multiset_intersection(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersectAll(li.where("l_returnflag = 'N'").select("l_partkey")).groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("sm08_uncached_chunks", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def uncached_chunks(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.join(c.where("conv_id % 3 = 0").select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("sf53_box_ratios", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2.0 AS area, least(1.0, 10.0 / l_quantity) AS ratio FROM lineitem")
def box_ratios(spark, sf_dir):
    d = lambda x: F.lit(float(x))
    a, b = geometry.box(d(0), d(0), F.col("l_quantity"), d(2)), geometry.box(d(0), d(0), d(10), d(5))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", geometry.area(a).alias("area"), geometry.contained_ratio(a, b).alias("ratio"))


@query("sf56_edit_distance", "SELECT doc_id, levenshtein(lang, source) AS n FROM documents")
def edit_distance(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.levenshtein("lang", "source").cast("long").alias("n"))


@query("sf37_document_keys", "SELECT doc_id, CAST(doc_id AS VARCHAR) || '-' || upper(source) AS key FROM documents")
def document_keys(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.document_key(F.col("doc_id"), F.upper("source")).alias("key"))


FNV = "lower(lpad(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(list_filter(string_split({}, ''), lambda x: x <> ''), lambda x: unicode(x)::UBIGINT)), lambda h, x: ((xor(h, x) * 16777619::UBIGINT) & 4294967295::UBIGINT)::UBIGINT)), 8, '0'))"
LONG_NAME = "repeat('n', 90) || '-' || source || '-' || CAST(doc_id AS VARCHAR)"


@query("sf33_safe_stems", f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a_b_ c' WHEN 1 THEN 'document_' || {FNV.format("'CON.' || source")} WHEN 2 THEN CASE WHEN length({LONG_NAME}) > 96 THEN left({LONG_NAME}, 87) || '_' || {FNV.format(LONG_NAME)} ELSE {LONG_NAME} END ELSE source END AS stem FROM documents")
def safe_stems(spark, sf_dir):
    s = F.expr("CASE doc_id % 4 WHEN 0 THEN ' a/b:  c.. ' WHEN 1 THEN 'CON.' || source WHEN 2 THEN repeat('n', 90) || '-' || source || '-' || doc_id ELSE source END")
    return load(spark, sf_dir, "documents").select("doc_id", T.safe_stem(s).alias("stem"))


@query("sf13_markers", "SELECT doc_id, doc_id % 3 <> 2 AS found FROM documents")
def markers(spark, sf_dir):
    s = F.expr("CASE doc_id % 3 WHEN 0 THEN 'x [[END_0042]]' WHEN 1 THEN 'x END 0 0-4_2 y' ELSE 'END_004' END")
    return load(spark, sf_dir, "documents").select("doc_id", T.marker_found(s, "0042", "[[END_0042]]").alias("found"))


@query("sf15_tex_bodies", "SELECT doc_id, lang AS body FROM documents")
def tex_bodies(spark, sf_dir):
    s = F.expr(r"CASE doc_id % 4 WHEN 0 THEN '$$' || lang || '$$' WHEN 1 THEN '\\[ ' || lang || ' \\]' WHEN 2 THEN '\\(' || lang || '\\)' ELSE '$' || lang || '$' END")
    return load(spark, sf_dir, "documents").select("doc_id", T.without_tex_wrappers(s).alias("body"))


@query("sf43_formula_issues", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'inline-formula-missing' WHEN 1 THEN 'inline-formula-unbalanced' ELSE '' END AS issue FROM documents")
def formula_issues(spark, sf_dir):
    t = F.expr("CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN '$x$ and $y' ELSE 'see $x$' END")
    return load(spark, sf_dir, "documents").select("doc_id", T.formula_issue(F.lit("a $x$"), t).alias("issue"))


# --- layout ----------------------------------------------------------------------------------------


@query("ge03_record_kinds", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'body' WHEN 1 THEN 'caption' WHEN 2 THEN 'table-note' ELSE 'code' END AS kind FROM documents")
def record_kinds(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", layout.record_kind(F.expr("CASE doc_id % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'image_caption' WHEN 2 THEN 'table_footnote' ELSE 'code' END")).alias("kind"))


@query("ge07_page_sizes", "SELECT l_orderkey, greatest(595.0, max(l_quantity) * 20) AS width, 842.0::DOUBLE AS height FROM lineitem GROUP BY 1")
def page_sizes(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") * 20).alias("w"))
    no = F.lit(None).cast("double")
    return g.select("l_orderkey", layout.page_size(no, no, F.col("w"), F.lit(10.0)).alias("p")).select("l_orderkey", "p.*")


@query("ge08_font_sizes", "SELECT event_id, greatest(5.5, least(18.0, value / greatest(1, event_id % 3) * 0.72)) AS size FROM events")
def font_sizes(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", layout.font_size(F.col("value"), F.col("event_id") % 3).alias("size"))


@query("ge09_page_boxes", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 100.0 ELSE l_quantity + 2 END AS x0 FROM lineitem")
def page_boxes(spark, sf_dir):
    x = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).otherwise(F.col("l_quantity") + 2)
    b = F.array(x, x, x, x)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", layout.page_box(b, F.lit(100.0), F.lit(200.0))[0].alias("x0"))


BOX = "SELECT user_id AS page, event_id AS box, value AS x0, event_id % 50 * 1.0::DOUBLE AS y0, value + 10 AS x1, event_id % 50 + 8.0::DOUBLE AS y1 FROM events WHERE value IS NOT NULL"


def _page_boxes(spark, sf_dir):
    return load(spark, sf_dir, "events").where("value IS NOT NULL").selectExpr("user_id AS page", "event_id AS box", "value AS x0", "event_id % 50 * 1.0D AS y0", "value + 10 AS x1", "event_id % 50 + 8.0D AS y1")


@query("ge10_boxes_in_region", f"WITH b AS ({BOX}) SELECT page, 1 AS region, box FROM b WHERE (x0 + x1) / 2 BETWEEN 8 AND 42 AND (y0 + y1) / 2 BETWEEN 8 AND 32")
def boxes_in_region(spark, sf_dir):
    b = _page_boxes(spark, sf_dir)
    regions = b.select("page").distinct().selectExpr("page", "1 AS region", "10.0D AS x0", "10.0D AS y0", "40.0D AS x1", "30.0D AS y1")
    return layout.boxes_in_region(b, regions, "page", 2.0)


@query("ge15_parallel_lanes", f"WITH b AS ({BOX}) SELECT DISTINCT a.page FROM b a JOIN b ON a.page = b.page WHERE b.x0 - a.x1 >= 100 * 0.035 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= least(a.y1 - a.y0, b.y1 - b.y0) * 0.2")
def parallel_lanes(spark, sf_dir):
    return layout.parallel_lanes(_page_boxes(spark, sf_dir), "page", 100.0)


@query("ge17_unblocked_pairs", f"WITH b AS ({BOX}), p AS (SELECT page, box, y1 AS upper_y1, y1 + 12 AS lower_y0, x0, x1 FROM b) SELECT page, box FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = p.page AND b.y0 >= upper_y1 AND b.y1 <= lower_y0 AND least(p.x1, b.x1) - greatest(p.x0, b.x0) >= (p.x1 - p.x0) * 0.18)")
def unblocked_pairs(spark, sf_dir):
    b = _page_boxes(spark, sf_dir)
    pairs = b.selectExpr("page", "box", "y1 AS upper_y1", "y1 + 12 AS lower_y0", "x0", "x1")
    return layout.blocked(pairs, b, "page").select("page", "box")


@query("ge18_adjacent_lines", "SELECT user_id, event_id AS left, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) <= 8.0, FALSE) AS joined FROM events")
def adjacent_lines(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("user_id", "value AS top", "value AS bottom", "event_id AS left")
    return layout.adjacent(e, ["user_id"], "top", "bottom", "left", 8.0, 1e12).select("user_id", "left", "joined")


@query("ge25_good_lines", "SELECT event_id, value / 100 >= 0.85 AND event_id % 40 >= 15 AS good FROM events")
def good_lines(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", layout.good_lines(F.col("value") / 100, F.col("event_id") % 40, F.lit(10), F.col("event_type")).alias("good"))


@query("ge26_shelves", """
WITH RECURSIVE c AS (SELECT l_orderkey AS page, l_partkey AS crop, CAST(l_quantity * 10 AS BIGINT) AS w, l_suppkey % 90 + 10 AS h FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY h DESC, w DESC, crop) AS n FROM c),
r AS (SELECT page, crop, n, w, h, 0 AS sheet, 0::BIGINT AS x, 0::BIGINT AS y, h AS shelf FROM s WHERE n = 1
      UNION ALL SELECT page, crop, n, w, h, CASE WHEN over THEN sheet + 1 ELSE sheet END, CASE WHEN over THEN 0 ELSE x END, CASE WHEN over THEN 0 ELSE y END, CASE WHEN over THEN h ELSE greatest(shelf, h) END
      FROM (SELECT *, y > 0 AND y + h > 976 AS over FROM (
        SELECT s.page, s.crop, s.n, s.w, s.h, r.sheet, CASE WHEN r.x + r.w + 8 + s.w > 688 THEN 0 ELSE r.x + r.w + 8 END AS x, CASE WHEN r.x + r.w + 8 + s.w > 688 THEN r.y + r.shelf + 8 ELSE r.y END AS y, CASE WHEN r.x + r.w + 8 + s.w > 688 THEN 0 ELSE r.shelf END AS shelf
        FROM r JOIN s ON s.page = r.page AND s.n = r.n + 1) a) b)
SELECT page, crop, sheet, x, y FROM r""")
def shelves(spark, sf_dir):
    return layout.shelves(load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_partkey AS crop", "CAST(l_quantity * 10 AS BIGINT) AS w", "CAST(l_suppkey % 90 + 10 AS BIGINT) AS h"), "page")


@query("ge28_id_batches", "SELECT count(DISTINCT l_partkey) AS ids, 50 AS most FROM lineitem")
def id_batches(spark, sf_dir):
    b = layout.id_batches(load(spark, sf_dir, "lineitem"), "l_partkey").groupBy("batch").agg(F.count("*").alias("n"))
    return b.agg(F.sum("n").alias("ids"), F.greatest(F.max("n"), F.lit(50)).cast("int").alias("most"))
