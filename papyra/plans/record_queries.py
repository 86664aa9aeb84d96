"""Queries of search, records, sequences, geometry and graphs, over records made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import geometry, graphs, records, search, sequences
from .registry import load, query

#: Bibliographic cards over documents, in SQL that Spark and DuckDB share.
CARD_COLUMNS = [
    "doc_id AS id",
    "substr(text, 1, 60) AS title",
    "substr(text, 61) AS abstract",
    "lang || ' ' || source AS author",
    "source AS venue",
    "lang AS tag",
    "CAST(1990 + doc_id % 35 AS INT) AS year",
    "doc_id % 97 AS citations",
    "doc_id % 3 = 0 AS open_access",
    "doc_id % 5 = 0 AS in_library",
    "'10.5555/' || CAST(doc_id % 700 AS STRING) AS doi",
    "CAST(doc_id % 11 AS DOUBLE) AS score",
]
CARDS = f"(SELECT {', '.join(CARD_COLUMNS)} FROM documents)"


def cards(spark, sf_dir):
    return load(spark, sf_dir, "documents").selectExpr(*CARD_COLUMNS)


def _low(*names):
    return [F.lower(F.col(n)) for n in names]


TERMS = ["the", "tion", "heit"]
QUERY = "The tion-heit"


def _weighted_sql(weights):
    return " + ".join(f"CASE WHEN contains(lower({c}), '{t}') THEN {w}.0::DOUBLE ELSE 0.0::DOUBLE END" for t in TERMS for c, w in weights)


#: The weights of a card's fields.
W6 = [("title", 8), ("abstract", 4), ("author", 3), ("venue", 2), ("tag", 2), ("doi", 5)]


@query("sr06_card_search", f"""
WITH s AS (SELECT id, title, ({_weighted_sql(W6)}) / 3 AS base, citations FROM {CARDS} c),
r AS (SELECT id, title, round(base + least(3.0, log10(citations + 1.0::DOUBLE)), 4) AS score FROM s WHERE base > 0)
SELECT id, title, score FROM r ORDER BY score DESC, title, id LIMIT 50""")
def card_search(spark, sf_dir):
    c = cards(spark, sf_dir)
    base = search.weighted_score([(F.lower(F.col(n)), w) for n, w in W6], QUERY)
    found = c.withColumn("base", base).where("base > 0").select("id", "title", F.round(F.col("base") + search.citation_bonus(F.col("citations"), 3.0), 4).alias("score"))
    return found.orderBy(F.col("score").desc(), "title", "id").limit(50)


@query("sr07_candidate_score", f"""
SELECT id, round(score + {_weighted_sql([('title', 8), ('abstract', 3), ('venue', 1)])} + least(4.0, log10(citations + 1.0::DOUBLE)) + CASE WHEN open_access THEN 0.25 ELSE 0.0 END + CASE WHEN in_library THEN 0.5 ELSE 0.0 END, 4) AS value FROM {CARDS} c""")
def candidate_score(spark, sf_dir):
    c = cards(spark, sf_dir)
    v = search.candidate_score(*[F.col(n) for n in ("score", "title", "abstract", "venue", "citations", "open_access", "in_library")], QUERY, True)
    return c.select("id", v.alias("value"))


@query("sr08_relevance", f"""
SELECT id, CAST((CASE WHEN contains(lower(title), 'en') THEN 12 ELSE 0 END) + (CASE WHEN lower(tag) = 'en' THEN 9 WHEN contains(lower(tag), 'en') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(abstract), 'en') THEN 5 ELSE 0 END) AS INTEGER) AS value FROM {CARDS} c""")
def library_relevance(spark, sf_dir):
    fields = [(F.array("title"), 12), (F.array("tag"), 3), (F.array("abstract"), 5)]
    return cards(spark, sf_dir).select("id", search.relevance(fields, " EN ").alias("value"))


HALF = "CAST(floor(length(text) / 2) AS INT)"
FIELDS = ["doc_id AS document_id", "source AS title", "'text' AS type", "'' AS block_id", "text"], ["doc_id AS document_id", "source AS title", "'table' AS type", "'b1' AS block_id", f"substr(text, {HALF} + 1) AS text"]


@query("corpus_search", f"""
WITH f AS (SELECT {', '.join(FIELDS[0])} FROM documents UNION ALL SELECT {', '.join(FIELDS[1])} FROM documents),
s AS (SELECT *, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'ver') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, (block_id <> '') DESC, block_id, type) AS rank FROM s WHERE score > 0),
t AS (SELECT *, greatest(instr(lower(text), 'the') - 1, 0) AS p0 FROM r WHERE rank <= 1 ORDER BY score DESC, title, document_id LIMIT 50)
SELECT document_id, title, type, block_id, score, substr(text, greatest(p0 - 180, 0) + 1, p0 + 520 - greatest(p0 - 180, 0)) AS snippet FROM t""")
def corpus_search(spark, sf_dir):
    """Two fields of each document: its whole text, and its second half as a block of its own."""
    d = load(spark, sf_dir, "documents")
    return search.corpus_search(d.selectExpr(*FIELDS[0]).unionByName(d.selectExpr(*FIELDS[1])), "the ver", 50)


@query("sr01_tokens", r"SELECT t AS term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 1)) AS t FROM documents) q GROUP BY 1 HAVING count(*) >= 5")
def token_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.explode(search.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n >= 5")


@query("sr09_prefix_candidates", r"""
WITH i AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 1)) AS t FROM documents) q)
SELECT doc_id FROM i WHERE starts_with(t, 'ver') INTERSECT SELECT doc_id FROM i WHERE starts_with(t, 'und')""")
def prefix_candidates(spark, sf_dir):
    return search.prefix_candidates(search.inverted_index(load(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "ver und")


@query("sr10_occurrences", """
WITH p AS (SELECT doc_id, text, string_split(lower(text), 'tion') AS parts FROM documents),
q AS (SELECT doc_id, text, i, list_sum(list_transform(parts[1:i], lambda x: length(x))) + 4 * (i - 1) AS position FROM (SELECT *, unnest(range(1, least(len(parts), 21))) AS i FROM p) z)
SELECT doc_id, CAST(position AS INTEGER) AS position, substr(text, CAST(greatest(position - 180, 0) + 1 AS BIGINT), CAST(position + 260 - greatest(position - 180, 0) AS BIGINT)) AS snippet FROM q""")
def occurrences(spark, sf_dir):
    return search.occurrences(load(spark, sf_dir, "documents"), "doc_id", "text", "tion", 20)


def _predicate(name, column, sql):
    @query(name, f"SELECT id FROM {CARDS} c WHERE {sql}")
    def run(spark, sf_dir):
        return cards(spark, sf_dir).where(column()).select("id")


_predicate("fl01_operator_contains", lambda: search.field_matches(F.array("title", "abstract"), "contains", "VER"), "contains(lower(title), 'ver') OR contains(lower(abstract), 'ver')")
_predicate("fl01_operator_notequals", lambda: search.field_matches(F.array("venue", "tag"), "is_not", "en"), "NOT (lower(venue) = 'en' OR lower(tag) = 'en')")
_predicate("fl01_operator_prefix", lambda: search.field_matches(F.array("venue"), "prefix", "SRC1"), "starts_with(lower(venue), 'src1')")
_predicate("fl01_operator_regex", lambda: search.field_matches(F.array("venue"), "matches", "^SRC[0-4]$"), "regexp_matches(venue, '(?i)^SRC[0-4]$')")
_predicate("fl01_operator_in", lambda: search.field_matches(F.array("tag"), "one-of", "de, fr"), "lower(tag) IN ('de', 'fr')")
_predicate("fl01_operator_gte", lambda: search.field_matches(F.array(F.col("year").cast("string")), "on or after", "2010"), "year >= 2010")
_predicate("fl03_field_queries_or", lambda: search.field_queries([(F.array("tag"), "equals", "de"), (F.array("title"), "contains", "the")], "or"), "lower(tag) = 'de' OR contains(lower(title), 'the')")
_predicate("fl03_field_queries_and", lambda: search.field_queries([(F.array("tag"), "equals", "en"), (F.array("title"), "contains", "the")]), "lower(tag) = 'en' AND contains(lower(title), 'the')")
_predicate("fl05_tags_all", lambda: search.tags_match(F.array("tag", "venue"), ["e", "src1"], "all"), "(contains(lower(tag), 'e') OR contains(lower(venue), 'e')) AND (contains(lower(tag), 'src1') OR contains(lower(venue), 'src1'))")
_predicate("fl05_tags_none", lambda: search.tags_match(F.array("tag"), ["en", "fr"], "none"), "NOT contains(lower(tag), 'en') AND NOT contains(lower(tag), 'fr')")
_predicate("fl06_year_range", lambda: search.in_range(F.col("year"), 1995, 2003), "year BETWEEN 1995 AND 2003")
_predicate("fl09_card_filters", lambda: F.lower("author").contains("de") & search.in_range(F.col("year"), 2000) & F.col("open_access"), "contains(lower(author), 'de') AND year >= 2000 AND open_access")
_predicate("fl10_all_needles", lambda: search.all_needles(F.col("abstract"), "en; er, st"), "contains(lower(abstract), 'en') AND contains(lower(abstract), 'er') AND contains(lower(abstract), 'st')")
_predicate("sr20_identifier_lookup", lambda: F.exists(F.array("doi", "venue"), lambda x: T.bare_identifier(x) == "10.5555/42"), "doi = '10.5555/42' OR lower(venue) = '10.5555/42'")
_predicate("ag01_dedup_input", lambda: F.col("doi").isNotNull(), "doi IS NOT NULL")


@query("fl07_date_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-10 00:00:00'")
def date_range(spark, sf_dir):
    return load(spark, sf_dir, "events").where(search.in_range(F.col("ts"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))).select("event_id")


@query("ag01_deduplicated", f"""
WITH k AS (SELECT id, lower(doi) AS key, score, title, year, in_library FROM {CARDS} c),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, id) AS n, min(id) OVER (PARTITION BY key) AS place FROM k),
t AS (SELECT *, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm FROM b WHERE n = 1),
l AS (SELECT *, first_value(place) OVER w AS lp, first_value(year) OVER w AS ly, first_value(in_library) OVER w AS ll FROM t WINDOW w AS (PARTITION BY norm ORDER BY place)),
r AS (SELECT *, norm <> '' AND place > lp AND in_library AND NOT ll AND year = ly AS rep FROM l),
g AS (SELECT *, max(CAST(rep AS INT)) OVER (PARTITION BY norm) AS anyrep FROM r)
SELECT id, key, score FROM g WHERE NOT (place = lp AND anyrep = 1 AND norm <> '')""")
def deduplicated(spark, sf_dir):
    c = cards(spark, sf_dir).withColumn("key", F.lower("doi"))
    return records.deduplicated(c, "id").select("id", "key", "score")


@query("ag02_identity", f"SELECT id, CASE WHEN id % 3 = 0 THEN lower(doi) ELSE trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END AS key FROM {CARDS} c")
def identity(spark, sf_dir):
    no = F.lit(None).cast("string")
    return cards(spark, sf_dir).select("id", records.identity(F.when(F.col("id") % 3 == 0, F.col("doi")), no, F.lit(""), no, no, F.col("title")).alias("key"))


@query("jn01_enriched", f"""
WITH c AS (SELECT id, title, doi FROM {CARDS} c WHERE id % 2 = 0), l AS (SELECT id AS local_id, title AS t, doi AS d FROM {CARDS} c WHERE id % 2 = 1),
i AS (SELECT c.id, min(local_id) AS m FROM c JOIN l ON lower(doi) = lower(d) GROUP BY 1),
n AS (SELECT trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k, min(local_id) AS m FROM l GROUP BY 1 HAVING k <> '')
SELECT c.id, coalesce(i.m, n.m) AS local_id, CASE WHEN i.m IS NOT NULL THEN 'identifier' WHEN n.m IS NOT NULL THEN 'title' END AS match
FROM c LEFT JOIN i ON c.id = i.id LEFT JOIN n ON trim(regexp_replace(lower(c.title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = n.k""")
def enriched(spark, sf_dir):
    c = cards(spark, sf_dir)
    local = c.where("id % 2 = 1").selectExpr("id AS local_id", "title AS local_title", "doi AS local_doi")
    out = records.enriched(c.where("id % 2 = 0").select("id", "title", "doi"), local, "id", F.array("doi"), "local_id", F.array("local_doi"), "title", "local_title")
    return out.select("id", "local_id", "match")


@query("jn21_import_new", f"SELECT id FROM {CARDS} c WHERE id % 3 = 0 AND doi NOT IN (SELECT doi FROM {CARDS} d WHERE id % 3 = 1)")
def import_new(spark, sf_dir):
    c = cards(spark, sf_dir)
    return c.where("id % 3 = 0").join(c.where("id % 3 = 1").select("doi"), "doi", "left_anti").select("id")


@query("jn04_items_with_children", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL)), ','), '') AS children FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def items_with_children(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("c"))
    joined = load(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("c", lambda x: x.cast("string")), ","), F.lit("")).alias("children"))


@query("jn05_best_child", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS n FROM orders) q WHERE n = 1")
def best_child(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return records.first_by(load(spark, sf_dir, "orders"), ["o_custkey"], [rank, F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("jn08_current_translations", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'translated' ELSE '' END AS translated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = d.doc_id % 2")
def current_translations(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("fingerprint", (F.col("doc_id") % 2).cast("int"))
    t = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("fingerprint"), F.lit("translated").alias("translated"))
    return d.join(t, ["doc_id", "fingerprint"], "left").select("doc_id", F.coalesce("translated", F.lit("")).alias("translated"))


@query("jn23_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf_dir):
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("jn06_paths", "WITH RECURSIVE t AS (SELECT p_partkey, 0 AS depth, 'n' || CAST(p_partkey AS VARCHAR) AS path FROM part WHERE p_partkey < 3 UNION ALL SELECT p.p_partkey, depth + 1, path || ' > n' || CAST(p.p_partkey AS VARCHAR) FROM part p JOIN t ON p.p_partkey >= 3 AND CAST(floor(p.p_partkey / 3) AS BIGINT) = t.p_partkey) SELECT p_partkey, CAST(depth AS INTEGER) AS depth, path FROM t")
def tree_paths(spark, sf_dir):
    tree = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") >= 3, F.floor(F.col("p_partkey") / 3)).alias("up"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"))
    return graphs.paths(tree, "p_partkey", "up", "name", 32)


@query("sr17_graph_nodes", f"SELECT 'venue:' || lower(venue) AS key, 'venue' AS type, min(venue) AS label, count(DISTINCT id) AS n FROM {CARDS} c GROUP BY 1 UNION ALL SELECT 'author:' || lower(author), 'author', min(author), count(DISTINCT id) FROM {CARDS} c GROUP BY 1 UNION ALL SELECT 'topic:' || lower(tag), 'topic', min(tag), count(DISTINCT id) FROM {CARDS} c GROUP BY 1 UNION ALL SELECT 'paper:' || CAST(id AS VARCHAR), 'paper', title, 1 FROM {CARDS} c")
def graph_nodes(spark, sf_dir):
    return graphs.literature_graph(cards(spark, sf_dir).withColumn("authors", F.array("author")).withColumn("topics", F.array("tag")))[0]


@query("sr17_graph_edges", f"SELECT 'paper:' || CAST(id AS VARCHAR) AS source, 'venue:' || lower(venue) AS target, 'published_in' AS kind FROM {CARDS} c UNION SELECT 'paper:' || CAST(id AS VARCHAR), 'author:' || lower(author), 'written_by' FROM {CARDS} c UNION SELECT 'paper:' || CAST(id AS VARCHAR), 'topic:' || lower(tag), 'about' FROM {CARDS} c")
def graph_edges(spark, sf_dir):
    return graphs.literature_graph(cards(spark, sf_dir).withColumn("authors", F.array("author")).withColumn("topics", F.array("tag")))[1]


@query("sk08_citations", f"SELECT id, tag || ' (' || CAST(year AS VARCHAR) || '). ' || title || '. ' || venue || '.' AS apa, tag || ', “' || title || ',” ' || venue || ', ' || CAST(year AS VARCHAR) || '.' AS ieee, tag || ' & ' || venue || '. ' || title || '. ' || venue || ', ' || CAST(year AS VARCHAR) || '.' AS gb FROM {CARDS} c WHERE title <> ''")
def citations(spark, sf_dir):
    c = cards(spark, sf_dir).where("title <> ''")
    args = [F.col("year"), F.col("title"), F.col("venue")]
    return c.select("id", records.citation_text(F.array("tag"), *args).alias("apa"), records.citation_text(F.array("tag"), *args, "ieee").alias("ieee"), records.citation_text(F.array("tag", "venue"), *args, "gb").alias("gb"))


@query("sk07_bibtex", f"SELECT id, '@article{{' || lower(venue) || CAST(year AS VARCHAR) || CAST(id AS VARCHAR) || ',' || chr(10) || '  title = {{' || regexp_replace(title, '([\\\\{{}}])', '\\\\\\1', 'g') || '}},' || chr(10) || '  year = {{' || CAST(year AS VARCHAR) || '}}' || chr(10) || '}}' AS entry FROM {CARDS} c WHERE trim(title) <> ''")
def bibtex(spark, sf_dir):
    c = cards(spark, sf_dir).where("trim(title) <> ''")
    key = records.citation_key(F.col("venue"), F.col("year"), F.col("id"))
    return c.select("id", records.bibtex(F.lit("article"), key, [("title", F.col("title")), ("year", F.col("year")), ("url", F.lit(""))]).alias("entry"))


@query("sk07_ris", f"SELECT id, 'TY  - JOUR' || chr(10) || 'AU  - ' || author || chr(10) || 'TI  - ' || title || chr(10) || 'PY  - ' || CAST(year AS VARCHAR) || chr(10) || 'ER  -' AS entry FROM {CARDS} c WHERE title <> ''")
def ris(spark, sf_dir):
    c = cards(spark, sf_dir).where("title <> ''")
    return c.select("id", records.ris(F.lit("JOUR"), F.array("author"), [("TI", F.col("title")), ("PY", F.col("year")), ("DO", F.lit(None))]).alias("entry"))


@query("sk06_table_export", "SELECT n_nationkey, '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS markdown, 'k,v' || chr(10) || n_name || ',\"a,b\"' AS csv, '<table><tr><th>k</th><th>v</th></tr><tr><td>' || n_name || '</td><td>a&lt;b</td></tr><tr><td>x</td><td></td></tr></table>' AS html FROM nation")
def table_export(spark, sf_dir):
    rows = F.array(F.array(F.lit("k"), F.lit("v")), F.array(F.col("n_name"), F.col("n_regionkey").cast("string")))
    cells = F.array(F.array(F.lit("k"), F.lit("v")), F.array(F.col("n_name"), F.lit("a,b")))
    return load(spark, sf_dir, "nation").select("n_nationkey", records.markdown_table(rows).alias("markdown"), records.csv_rows(cells).alias("csv"), records.html_table(F.array(F.array(F.lit("k"), F.lit("v")), F.array(F.col("n_name"), F.lit("a<b")), F.array(F.lit("x")))).alias("html"))


@query("st02_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    return search.page_of(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40, 20)


@query("st11_retained", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) q WHERE n <= 3")
def retained(spark, sf_dir):
    return records.retained(load(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id")


@query("sm09_last_state", "SELECT user_id, arg_max(event_type, ts + to_microseconds(event_id)) AS event_type FROM (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) q WHERE n = 1 GROUP BY 1")
def last_state(spark, sf_dir):
    return records.last_state(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"])


@query("sm06_contiguous_prefix", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS idx FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx, event_id) - 1 AS n FROM (SELECT DISTINCT ON (user_id, idx) * FROM e ORDER BY user_id, idx, event_id) d) SELECT user_id, count(*) AS released FROM r WHERE n = idx GROUP BY 1")
def contiguous_prefix(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = load(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) - 1 + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)).cast("long").alias("idx"))
    e = records.first_by(e, ["user_id", "idx"], [F.col("event_id")])
    return records.contiguous_prefix(e, "user_id", "idx").groupBy("user_id").agg(F.count("*").alias("released"))


@query("sm10_cache_state", "SELECT event_id, CASE WHEN event_id % 1000 <= 300 THEN 'hit' ELSE 'stale' END AS state FROM events")
def cache_state(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", records.fresh(F.col("event_id") % 1000, 300, True).alias("state"))


@query("so07_upserted", "SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(b.c_acctbal, a.c_acctbal) AS c_acctbal, a.c_acctbal > 0 OR coalesce(b.c_acctbal > 5000, FALSE) AS flag FROM customer a FULL JOIN (SELECT * FROM customer WHERE c_custkey % 10 = 0) b ON a.c_custkey = b.c_custkey")
def upserted(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") > 0).alias("flag"))
    changes = load(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey", "c_acctbal", (F.col("c_acctbal") > 5000).alias("flag"))
    return records.upserted(c, changes, "c_custkey", ["flag"], ["c_acctbal"])


# --- sequences ----------------------------------------------------------------------------------


@query("wn01_ordinals", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS ordinal, printf('order-%03d', row_number() OVER w) AS label FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ordinals(spark, sf_dir):
    return sequences.ordinals(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "order").select("o_custkey", "o_orderkey", "ordinal", "label")


LINES = "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, CASE WHEN i % 3 = 1 THEN '## ' ELSE '' END || parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) p) q"


def lines(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return d.select("doc_id", "line_no", F.concat(F.when(F.col("line_no") % 3 == 0, "## ").otherwise(""), F.col("raw")).alias("line"))


@query("wn02_sections", f"WITH l AS ({LINES}), e AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM l), h AS (SELECT * FROM e WHERE regexp_matches(line, '^(#{{1,6}})\\s')) SELECT doc_id, CAST(length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS INTEGER) AS level, trim(regexp_replace(line, '^#{{1,6}}\\s+', '')) AS title, line_no AS first_line, CAST(coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, last) AS INTEGER) AS last_line FROM h")
def sections(spark, sf_dir):
    return sequences.sections(lines(spark, sf_dir), "doc_id", "line_no", "line")


@query("wn03_neighbours", "SELECT conv_id, turn, lag(text) OVER w AS previous, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbours(spark, sf_dir):
    return sequences.neighbours(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "previous", "next")


@query("jn18_context", "SELECT conv_id, turn, array_to_string(coalesce(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), ',') AS before, array_to_string(coalesce(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []), ',') AS after FROM conversations")
def context(spark, sf_dir):
    out = sequences.context(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", 2, 2)
    return out.select("conv_id", "turn", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("wn04_top_per_document", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) q WHERE n <= 3")
def top_per_document(spark, sf_dir):
    return records.retained(load(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("wn05_greedy_groups", """
WITH RECURSIVE l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) d),
n AS (SELECT doc_id, i, length(line) AS n FROM l),
r AS (SELECT doc_id, i, n AS size, 1 AS items, 0 AS chunk FROM n WHERE i = 0
      UNION ALL SELECT n.doc_id, n.i, CASE WHEN r.size + n.n > 500 OR r.items >= 8 THEN n.n ELSE r.size + n.n END, CASE WHEN r.size + n.n > 500 OR r.items >= 8 THEN 1 ELSE r.items + 1 END, CASE WHEN r.size + n.n > 500 OR r.items >= 8 THEN r.chunk + 1 ELSE r.chunk END
      FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, chunk FROM r""")
def greedy_groups(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("n"))
    return d.select("doc_id", F.posexplode(sequences.greedy_groups(F.col("n"), 500, 8)).alias("line_no", "chunk"))


@query("wn10_merged_chunks", "SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) AS text, min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AND count(*) = count(DISTINCT turn) AS complete FROM conversations GROUP BY 1")
def merged_chunks(spark, sf_dir):
    return sequences.merged_chunks(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("wn12_turns", "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no, CAST(row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS INTEGER) AS role_ordinal FROM conversations")
def turns(spark, sf_dir):
    return sequences.turns(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "turn_no", "role_ordinal")


@query("wn14_titles", "WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^ ?\\[[^\\]]*\\] ?', '')) AS t FROM conversations WHERE role = 'user') SELECT conv_id, left(arg_min(t, turn), 52) AS title FROM c WHERE t <> '' GROUP BY 1")
def titles(spark, sf_dir):
    return sequences.conversation_titles(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("sc11_merged_log", "WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS n FROM events), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e) SELECT user_id, min(event_id) AS event_id, min(event_type) AS event_type, string_agg(CAST(event_id % 10 AS VARCHAR), '' ORDER BY event_id) AS t, count(*) AS merged FROM r GROUP BY user_id, run")
def merged_log(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 10).cast("string").alias("t"))
    return sequences.merged_runs(e, "user_id", "event_id", "event_type", [], "t")


@query("fl17_duplicate_neighbours", "WITH n AS (SELECT conv_id, turn, text AS src, 'this is one translation of ' || role AS tr FROM conversations), l AS (SELECT *, lead(tr) OVER w AS nt, lead(src) OVER w AS ns FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn FROM l WHERE tr = nt AND src <> ns")
def duplicate_neighbours(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("src"), F.concat(F.lit("This  is one translation of "), F.col("role")).alias("tr"))
    return sequences.duplicate_neighbours(c, "conv_id", "turn", "src", "tr").select("conv_id", "turn")


@query("wn18_rising_pages", "WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS page FROM events), l AS (SELECT *, coalesce(page >= lag(page) OVER (PARTITION BY user_id ORDER BY event_id), TRUE) AS up FROM e WHERE page IS NOT NULL) SELECT user_id, count(*) AS entries, round(avg(CASE WHEN up THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS rising FROM l GROUP BY 1")
def rising_pages(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("page"))
    return sequences.rising_pages(e, "user_id", "event_id", "page").select("user_id", "entries", F.round("rising", 9).alias("rising"))


@query("wn19_outline_parents", "WITH h AS (SELECT user_id, event_id, CAST(event_id % 7 % 3 + 1 AS INTEGER) AS level FROM events) SELECT a.user_id, a.event_id, a.level, max(b.event_id) AS parent FROM h a LEFT JOIN h b ON a.user_id = b.user_id AND b.event_id < a.event_id AND b.level < a.level GROUP BY 1, 2, 3")
def outline_parents(spark, sf_dir):
    h = load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7 % 3 + 1).cast("int").alias("level"))
    return sequences.outline_parents(h, "user_id", "event_id", "level").select("user_id", "event_id", "level", "parent")


# --- geometry ------------------------------------------------------------------------------------


def _boxes(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item"), geometry.box(F.col("l_partkey") % 50 * 1.0, F.col("l_suppkey") % 40 * 1.0, F.col("l_partkey") % 50 + F.col("l_quantity"), F.col("l_suppkey") % 40 + 10.0).alias("b"))


BOXES = "SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS item, l_partkey % 50 * 1.0::DOUBLE AS x0, l_suppkey % 40 * 1.0::DOUBLE AS y0, l_partkey % 50 + l_quantity AS x1, l_suppkey % 40 + 10.0::DOUBLE AS y1 FROM lineitem"


@query("jn12_assigned", f"WITH b AS ({BOXES}), k AS (SELECT page, 'L' AS block, 0.0 AS bx0, 0.0 AS by0, 45.0 AS bx1, 60.0 AS by1 FROM b GROUP BY 1 UNION ALL SELECT page, 'R', 40.0, 0.0, 110.0, 60.0 FROM b GROUP BY 1), h AS (SELECT b.page, item, block, greatest(least(x1, bx1) - greatest(x0, bx0), 0) * greatest(least(y1, by1) - greatest(y0, by0), 0) / ((x1 - x0) * (y1 - y0)) AS ratio FROM b JOIN k USING (page) WHERE (x0 + x1) / 2 BETWEEN bx0 AND bx1 AND (y0 + y1) / 2 BETWEEN by0 AND by1), r AS (SELECT *, row_number() OVER (PARTITION BY page, item ORDER BY ratio DESC, block) AS n FROM h WHERE ratio >= 0.5) SELECT page, item, block, round(ratio, 9) AS ratio FROM r WHERE n = 1")
def assigned(spark, sf_dir):
    items = _boxes(spark, sf_dir)
    pages = items.select("page").distinct()
    d = lambda x: F.lit(float(x))
    blocks = pages.select("page", F.lit("L").alias("block"), geometry.box(d(0), d(0), d(45), d(60)).alias("bb")).unionByName(pages.select("page", F.lit("R").alias("block"), geometry.box(d(40), d(0), d(110), d(60)).alias("bb")))
    return geometry.assigned(items, blocks, 30.0).withColumn("ratio", F.round("ratio", 9))


@query("ag11_union_of_boxes", f"SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({BOXES}) b GROUP BY 1")
def union_of_boxes(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("page").agg(geometry.union_of(F.col("b")).alias("u")).select("page", "u.*")


@query("sf55_sides", f"SELECT page, item, CASE WHEN x1 - x0 > 100 * 0.55 THEN 'full' WHEN (x0 + x1) / 2 < 50 THEN 'left' ELSE 'right' END AS side FROM ({BOXES}) b")
def sides(spark, sf_dir):
    return _boxes(spark, sf_dir).select("page", "item", geometry.side(F.col("b"), F.lit(100.0)).alias("side"))


@query("jn14_unique_below", f"WITH b AS ({BOXES}), h AS (SELECT c.page, c.item AS caption, t.item AS t, count(*) OVER (PARTITION BY c.page, c.item) AS n FROM b c JOIN b t ON c.page = t.page AND c.item % 10 <= 2 AND t.item % 10 > 2 WHERE t.y0 - c.y1 BETWEEN -2 AND 20 AND abs(t.x0 - c.x0) < 20) SELECT page, caption, t AS \"table\" FROM h WHERE n = 1")
def unique_below(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return geometry.unique_below(b.where("item % 10 <= 2").select("page", F.col("item").alias("caption"), F.col("b").alias("cb")), b.where("item % 10 > 2").select("page", F.col("item").alias("table"), F.col("b").alias("tb")))


# --- aggregates ------------------------------------------------------------------------------------


@query("ag05_coverage", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def coverage(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("ag07_pages", "SELECT o_custkey, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS text, count(*) AS blocks FROM orders GROUP BY 1")
def pages(spark, sf_dir):
    g = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("r"))
    return g.select("o_custkey", F.array_join(F.transform("r", lambda x: x["o_orderpriority"]), "\n").alias("text"), F.size("r").cast("long").alias("blocks"))


@query("ag09_storage", "SELECT source, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2")
def storage(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


@query("ag10_medians", "SELECT l_suppkey, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def medians(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("median"))


@query("ag15_running_sums", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS running FROM conversations")
def running_sums(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("running"))


@query("ag17_max_per_key", "SELECT l_partkey, max(l_discount) AS widest FROM lineitem GROUP BY 1")
def max_per_key(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_discount").alias("widest"))


@query("ag19_shared_counts", "WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT a.k, a.n FROM a JOIN b ON a.k = b.k AND a.n = b.n")
def shared_counts(spark, sf_dir):
    count = lambda flag: load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    return count("R").join(count("A"), ["k", "n"]).select("k", "n")


@query("pj15_manifest", "SELECT conv_id, count(*) AS blocks, count(*) FILTER (WHERE role = 'user') AS user_blocks, count(*) FILTER (WHERE contains(text, '?')) AS questions, max(length(text)) AS longest FROM conversations GROUP BY 1")
def manifest(spark, sf_dir):
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("role") == "user").alias("user_blocks"), F.count_if(F.col("text").contains("?")).alias("questions"), F.max(F.length("text")).cast("long").alias("longest"))


@query("sc22_abstract_from_positions", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def abstract_from_positions(spark, sf_dir):
    words = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("pos", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("positions"))
    placed = index.select("doc_id", "word", F.explode("positions").alias("pos")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return placed.select("doc_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))
