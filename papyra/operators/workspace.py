"""The named operations of a library of documents, each a function from frames to a frame.

A workspace is a dictionary of frames; call(name) runs an operation by its public name.
Reading ones return rows; writing ones return the frame as it is afterwards, to be
published by the caller (see sources.sinks).  Operations of a user interface, of external
services and of files on a user's own disk have no place here.

Frames: items (id, library_id, item_type, title, abstract, creator, tags, publication,
doi, date, deleted), libraries (id, name), collections (id, parent, name), members
(collection_id, id), blocks (document_id, page, place, block_id, type, text),
translations (document_id, block_id, text, fingerprint, status), messages (session_id, at,
role, text), annotations (id, item_id, page, place, type, color, text, comment), artifacts
(id, document_id, kind, updated, body), jobs (id, kind, status, at).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graphs, library, records, search, sequences

Frames = dict[str, DataFrame]
TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(*names: str):
    def add(f):
        for n in names:
            TOOLS[n] = f
        return f

    return add


def call(name: str, frames: Frames, **arguments) -> DataFrame:
    """Runs an operation; an unknown name or argument is an error."""
    if name not in TOOLS:
        raise KeyError(f"no operation {name}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](frames, **arguments)


def _page(df: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    return search.page_of(df, order, offset, max(1, min(limit, 500)))


# --- library ------------------------------------------------------------------------------------


@tool("list_libraries")
def list_libraries(f: Frames) -> DataFrame:
    return f["libraries"].orderBy("id")


@tool("get_library")
def get_library(f: Frames, id: int) -> DataFrame:
    return f["libraries"].where(F.col("id") == id)


@tool("list_collections")
def list_collections(f: Frames) -> DataFrame:
    paths = graphs.paths(f["collections"], "id", "parent", "name", 32)
    return f["collections"].join(paths, "id").orderBy("path")


@tool("get_collection")
def get_collection(f: Frames, id: int) -> DataFrame:
    """The collection and all below it."""
    own = list_collections(f)
    root = own.where(F.col("id") == id).select(F.col("path").alias("_root"))
    return own.join(F.broadcast(root), (F.col("path") == F.col("_root")) | F.col("path").startswith(F.concat("_root", F.lit(" > ")))).drop("_root")


@tool("search_collections")
def search_collections(f: Frames, query: str) -> DataFrame:
    """Collections whose name or path holds the query, equal names first, then short paths."""
    q = query.strip().lower()
    own = list_collections(f).where(F.lower("name").contains(q) | F.lower("path").contains(q))
    return own.orderBy((F.lower("name") != q), F.length("path"), "path")


@tool("get_collection_items")
def get_collection_items(f: Frames, id: int, offset: int = 0, limit: int = 50) -> DataFrame:
    held = f["members"].where(F.col("collection_id") == id).select("id")
    return _page(library.items(f["items"]).join(held, "id", "left_semi"), [F.lower("title"), F.col("id")], offset, limit)


@tool("search_items")
def search_items(f: Frames, query: str = "", offset: int = 0, limit: int = 50, **options) -> DataFrame:
    """Items by any predicate of library.matching(), the most relevant first."""
    found = library.matching(library.items(f["items"]), query, **options)
    fields = [(F.array("title"), 12), (F.col("tags"), 3), (F.array("abstract"), 5)]
    return _page(found.withColumn("score", search.relevance(fields, query)), [F.col("score").desc(), F.lower("title"), F.col("id")], offset, limit)


def _changed(f: Frames, id: int, column: str, value) -> DataFrame:
    return f["items"].withColumn(column, F.when(F.col("id") == id, value).otherwise(F.col(column)))


@tool("add_tags")
def add_tags(f: Frames, id: int, tags: list[str]) -> DataFrame:
    return _changed(f, id, "tags", F.array_union("tags", F.array(*[F.lit(t) for t in tags])))


@tool("remove_tags")
def remove_tags(f: Frames, id: int, tags: list[str]) -> DataFrame:
    return _changed(f, id, "tags", F.array_except("tags", F.array(*[F.lit(t) for t in tags])))


@tool("update_item_metadata")
def update_item_metadata(f: Frames, id: int, values: dict) -> DataFrame:
    """Only fields that may be written; others of values are ignored."""
    out = f["items"]
    for name, value in values.items():
        if name in library.WRITABLE and name in out.columns:
            out = out.withColumn(name, F.when(F.col("id") == id, F.lit(value).cast(out.schema[name].dataType)).otherwise(F.col(name)))
    return out


@tool("add_items_to_collection")
def add_items(f: Frames, collection_id: int, ids: list[int]) -> DataFrame:
    known = f["items"].where(F.col("id").isin(ids)).select(F.lit(collection_id).cast("long").alias("collection_id"), F.col("id").cast("long").alias("id"))
    return f["members"].select(F.col("collection_id").cast("long"), F.col("id").cast("long")).unionByName(known).distinct()


@tool("remove_items_from_collection")
def remove_items(f: Frames, collection_id: int, ids: list[int]) -> DataFrame:
    return f["members"].where(~((F.col("collection_id") == collection_id) & F.col("id").isin(ids)))


@tool("add_by_doi", "add_by_url")
def add_by_identifier(f: Frames, identifier: str) -> DataFrame:
    """The item that has the identifier already; no row where it is to be added."""
    wanted = T.doi(F.lit(identifier))
    return library.items(f["items"]).where((T.doi(F.col("doi")) == wanted) & (wanted != ""))


@tool("literature_import", "add_by_bibtex", "add_by_csl_json")
def to_import(f: Frames, candidates: DataFrame) -> DataFrame:
    """Candidates (title, doi) whose identifier no item has, and of those without one whose title none has."""
    own = library.items(f["items"])
    dois = own.select(T.doi(F.col("doi")).alias("_d")).where("_d <> ''").distinct()
    titles = own.select(T.import_title_key(F.col("title")).alias("_t")).distinct()
    keyed = candidates.withColumn("_d", T.doi(F.col("doi"))).withColumn("_t", T.import_title_key(F.col("title")))
    by_doi = keyed.where("_d <> ''").join(dois, "_d", "left_anti")
    by_title = keyed.where("_d = ''").join(titles, "_t", "left_anti")
    return by_doi.select(candidates.columns).unionByName(by_title.select(candidates.columns))


@tool("generate_citation", "generate_bibliography")
def citations(f: Frames, ids: list[int], style: str = "apa") -> DataFrame:
    found = f["items"].where(F.col("id").isin(ids))
    return found.select("id", records.citation_text(F.array("creator"), T.year(F.col("date")), F.col("title"), F.col("publication"), style).alias("citation")).orderBy("id")


@tool("export_bibtex")
def export_bibtex(f: Frames, ids: list[int]) -> DataFrame:
    found = f["items"].where(F.col("id").isin(ids))
    key = records.citation_key(F.col("creator"), T.year(F.col("date")), F.col("id"))
    return found.select("id", records.bibtex(F.lit("article"), key, [("title", F.col("title")), ("journal", F.col("publication")), ("doi", F.col("doi"))]).alias("entry")).orderBy("id")


@tool("export_ris")
def export_ris(f: Frames, ids: list[int]) -> DataFrame:
    found = f["items"].where(F.col("id").isin(ids))
    return found.select("id", records.ris(F.lit("JOUR"), F.array("creator"), [("TI", F.col("title")), ("JO", F.col("publication")), ("DO", F.col("doi"))]).alias("entry")).orderBy("id")


@tool("export_csl_json")
def export_csl(f: Frames, ids: list[int]) -> DataFrame:
    found = f["items"].where(F.col("id").isin(ids))
    return found.select("id", F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit("article-journal").alias("type"), "title", F.nullif("doi", F.lit("")).alias("DOI"), F.col("publication").alias("container-title"))).alias("entry")).orderBy("id")


# --- reading -----------------------------------------------------------------------------------------


def _blocks(f: Frames, document: int) -> DataFrame:
    return f["blocks"].where(F.col("document_id") == document)


def _joined(blocks: DataFrame, keys: list[str], most: int) -> DataFrame:
    rows = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "place", "text"))).alias("_b"))
    return rows.select(*keys, T.head_with_notice(F.array_join(F.transform("_b", lambda b: b["text"]), "\n\n"), most).alias("text"))


@tool("read_source")
def read_source(f: Frames, document: int, most: int = 20_000) -> DataFrame:
    return _joined(_blocks(f, document), ["document_id"], most)


@tool("read_translation", "validate_translation")
def read_translation(f: Frames, document: int, most: int = 20_000) -> DataFrame:
    """The blocks' current translations; current: how many of the blocks have one."""
    made = f["translations"].select("document_id", "block_id", F.col("text").alias("translated"), "fingerprint", "status")
    rows = _blocks(f, document).join(made, ["document_id", "block_id"], "left")
    now = library.current_translation(F.col("status"), F.col("fingerprint"), T.fingerprint(F.col("text")))
    rows = rows.withColumn("text", F.when(now, F.col("translated"))).withColumn("_now", now)
    share = rows.groupBy("document_id").agg(F.count_if("_now").alias("current"), F.count("*").alias("blocks"))
    return _joined(rows.where("_now"), ["document_id"], most).join(share, "document_id", "right")


@tool("read_pages")
def read_pages(f: Frames, document: int, first: int = 1, last: int = 1 << 30, most: int = 20_000) -> DataFrame:
    return _joined(_blocks(f, document).where(F.col("page").between(first, last)), ["document_id", "page"], most).orderBy("page")


@tool("list_blocks", "read_blocks")
def list_blocks(f: Frames, document: int, type: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    rows = _blocks(f, document)
    return _page(rows.where(F.col("type") == type) if type else rows, [F.col("page"), F.col("place")], offset, limit)


@tool("get_block", "get_figure_context", "get_formula_context", "get_table_context")
def get_block(f: Frames, document: int, block: str, before: int = 2, after: int = 2) -> DataFrame:
    """A block and the texts around it."""
    ordered = _blocks(f, document).withColumn("_at", library.reading_order(F.col("page"), F.col("place")))
    return sequences.context(ordered, ["document_id"], "_at", "text", before, after).where(F.col("block_id") == block).drop("_at")


@tool("list_sections")
def list_sections(f: Frames, document: int) -> DataFrame:
    ordered = _blocks(f, document).withColumn("_at", library.reading_order(F.col("page"), F.col("place")))
    return sequences.sections(ordered, "document_id", "_at", "text").orderBy("first_line")


@tool("read_section")
def read_section(f: Frames, document: int, title: str, most: int = 20_000) -> DataFrame:
    """All up to the next heading, of every section of that title, case aside."""
    spans = list_sections(f, document).where(F.lower("title") == title.lower()).select("document_id", "title", "first_line", "last_line")
    ordered = _blocks(f, document).withColumn("_at", library.reading_order(F.col("page"), F.col("place")))
    rows = ordered.join(spans, "document_id").where(F.col("_at").between(F.col("first_line"), F.col("last_line")))
    return _joined(rows, ["document_id", "title", "first_line"], most).orderBy("first_line")


def _numbered(kind: str, prefix: str):
    def run(f: Frames, document: int) -> DataFrame:
        return sequences.ordinals(_blocks(f, document).where(F.col("type") == kind), ["document_id"], ["page", "place"], prefix).orderBy("ordinal")

    return run


tool("list_figures")(_numbered("image", "figure"))
tool("list_formulas")(_numbered("interline_equation", "formula"))
tool("list_tables")(_numbered("table", "table"))


@tool("get_figure", "get_formula", "get_table")
def get_numbered(f: Frames, document: int, label: str) -> DataFrame:
    """figure-001, formula-002, table-003."""
    listing = {"figure": "list_figures", "formula": "list_formulas", "table": "list_tables"}[label.split("-")[0]]
    return TOOLS[listing](f, document).where(F.col("label") == label)


@tool("export_table")
def export_table(f: Frames, document: int, label: str, format: str = "markdown") -> DataFrame:
    rows = get_numbered(f, document, label).select("document_id", "label", T.html_table_rows(F.col("text")).alias("_r"))
    made = {"markdown": records.markdown_table, "csv": records.csv_rows, "html": records.html_table}[format](F.col("_r"))
    return rows.select("document_id", "label", made.alias("table"))


@tool("search_formulas")
def search_formulas(f: Frames, query: str, limit: int = 50) -> DataFrame:
    hits = f["blocks"].where((F.col("type") == "interline_equation") & F.lower("text").contains(query.strip().lower()))
    return hits.orderBy("document_id", "page", "place").limit(limit)


@tool("search_paper")
def search_paper(f: Frames, document: int, query: str, limit: int = 20) -> DataFrame:
    return search.occurrences(_blocks(f, document), "block_id", "text", query, limit)


@tool("search_corpus", "query_agent_index")
def search_corpus(f: Frames, query: str, limit: int = 50) -> DataFrame:
    titles = f["items"].select(F.col("id").alias("document_id"), "title")
    return search.corpus_search(f["blocks"].join(titles, "document_id", "left").select("document_id", "title", "type", "block_id", "text"), query, limit)


@tool("get_paper_status", "get_papers_status", "get_paper_manifest", "rebuild_manifest", "validate_document", "inspect_document_state")
def paper_status(f: Frames, documents: list[int] | None = None) -> DataFrame:
    """What there is of each document: blocks by kind, pages, and how much of it is translated now."""
    some = f["blocks"] if documents is None else f["blocks"].where(F.col("document_id").isin(documents))
    made = f["translations"].select("document_id", "block_id", "fingerprint", "status")
    rows = some.join(made, ["document_id", "block_id"], "left")
    now = library.current_translation(F.col("status"), F.col("fingerprint"), T.fingerprint(F.col("text")))
    count = lambda kind: F.count_if(F.col("type") == kind)
    return rows.groupBy("document_id").agg(F.count("*").alias("blocks"), F.count_distinct("page").alias("pages"), count("image").alias("figures"), count("table").alias("tables"), count("interline_equation").alias("formulas"), F.count_if(now).alias("translated"))


# --- conversations, annotations, artifacts, jobs -----------------------------------------------------------


@tool("list_chat_sessions")
def list_sessions(f: Frames, limit: int = 50) -> DataFrame:
    titles = sequences.conversation_titles(f["messages"], "session_id", "at", "role", "text")
    last = f["messages"].groupBy("session_id").agg(F.max("at").alias("updated"), F.count("*").alias("messages"))
    return last.join(titles, "session_id", "left").orderBy(F.col("updated").desc(), "session_id").limit(limit)


@tool("read_chat_session")
def read_session(f: Frames, session: int) -> DataFrame:
    rows = f["messages"].where(F.col("session_id") == session).withColumn("role", T.chat_role(F.col("role")))
    return sequences.turns(rows, "session_id", "at", "role").orderBy("at")


@tool("delete_chat_turn")
def delete_turn(f: Frames, session: int, turn: int) -> DataFrame:
    """The messages without one turn: the user's and all that answers it."""
    own = sequences.turns(f["messages"], "session_id", "at", "role")
    return own.where(~((F.col("session_id") == session) & (F.col("turn_no") == turn))).select(f["messages"].columns)


@tool("edit_chat_message")
def edit_message(f: Frames, session: int, turn: int, text: str) -> DataFrame:
    """A new text for a user's message; what came after it goes."""
    own = sequences.turns(f["messages"], "session_id", "at", "role")
    here = F.col("session_id") == session
    kept = own.where(~here | (F.col("turn_no") < turn) | ((F.col("turn_no") == turn) & (F.col("role") == "user")))
    return kept.withColumn("text", F.when(here & (F.col("turn_no") == turn) & (F.col("role") == "user"), text).otherwise(F.col("text"))).select(f["messages"].columns)


@tool("list_annotations")
def list_annotations(f: Frames, item: int | None = None, type: str | None = None, query: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    rows = f["annotations"]
    tests = [F.col("item_id") == item] if item is not None else []
    tests += [F.col("type") == type] if type else []
    tests += [F.lower(F.concat_ws(" ", "text", "comment")).contains(query.lower())] if query else []
    return _page(rows.where(search.all_of(tests)), [F.col("item_id"), F.col("page"), F.col("place"), F.col("id")], offset, limit)


@tool("list_research_artifacts")
def list_artifacts(f: Frames, document: int | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    equal = {k: v for k, v in (("document_id", document), ("kind", kind)) if v is not None}
    return library.listing(f["artifacts"], [F.col("updated").desc(), F.col("id")], limit, **equal)


@tool("get_research_artifact")
def get_artifact(f: Frames, id: int) -> DataFrame:
    return f["artifacts"].where(F.col("id") == id)


@tool("create_research_artifact", "update_research_artifact")
def put_artifacts(f: Frames, rows: DataFrame) -> DataFrame:
    """The artifacts with these added, or put in the place of those of their ids."""
    return f["artifacts"].join(rows.select("id").distinct(), "id", "left_anti").unionByName(rows)


@tool("delete_research_artifact")
def delete_artifact(f: Frames, id: int) -> DataFrame:
    return f["artifacts"].where(F.col("id") != id)


@tool("list_jobs")
def list_jobs(f: Frames, status: str | None = None, limit: int = 50) -> DataFrame:
    return library.listing(library.latest(f["jobs"], "id", "at"), [F.col("at").desc(), F.col("id")], limit, **({"status": status} if status else {}))


@tool("get_job")
def get_job(f: Frames, id: int) -> DataFrame:
    return library.latest(f["jobs"].where(F.col("id") == id), "id", "at")


#: Which states a job may leave by which operation.
MOVES = {"cancel_job": (["queued", "running"], "cancelled"), "retry_job": (["failed", "cancelled"], "queued")}


def _moved(name: str):
    def run(f: Frames, id: int, at) -> DataFrame:
        """The jobs' log with a row for the new state; none is added where the job's last state does not allow it."""
        states, to = MOVES[name]
        last = get_job(f, id).where(F.col("status").isin(states))
        return f["jobs"].unionByName(last.withColumn("status", F.lit(to)).withColumn("at", F.lit(at).cast(f["jobs"].schema["at"].dataType)).select(f["jobs"].columns))

    return run


for _name in MOVES:
    tool(_name)(_moved(_name))


@tool("process_collection", "process_items")
def batch(f: Frames, ids: list[int] | None = None, collection_id: int | None = None) -> DataFrame:
    """(id, parse, translate): which documents of a batch have no blocks yet, and which blocks without translation."""
    wanted = f["items"].select("id")
    if collection_id is not None:
        wanted = f["members"].where(F.col("collection_id") == collection_id).select("id").distinct()
    if ids is not None:
        wanted = wanted.where(F.col("id").isin(ids)).distinct()
    status = paper_status(f).select(F.col("document_id").alias("id"), "blocks", "translated")
    return wanted.join(status, "id", "left").select("id", F.col("blocks").isNull().alias("parse"), (F.col("blocks").isNull() | (F.col("translated") < F.col("blocks"))).alias("translate"))


@tool("get_storage_summary")
def storage(f: Frames) -> DataFrame:
    return f["blocks"].groupBy("type").agg(F.count("*").alias("blocks"), F.count_distinct("document_id").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"))


@tool("get_literature_diagnostics")
def diagnostics(f: Frames) -> DataFrame:
    return library.signature(f["items"], "id", "title", "doi")


@tool("literature_graph")
def literature(f: Frames) -> DataFrame:
    """The edges from papers to their authors, topics and venues."""
    papers = f["items"].select("id", "title", F.array("creator").alias("authors"), F.col("tags").alias("topics"), F.col("publication").alias("venue"))
    return graphs.literature_graph(papers)[1]
