"""Library operators: items, annotations, evidence, jobs, listings, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doi, text, year
from .search import all_of, field_matches, in_range, tags_match

# --- scans and projections -----------------------------------------------------------------


def items(df: DataFrame, library: int | None = None, deleted: bool = False) -> DataFrame:
    """Items of one library or all, without deleted ones unless asked."""
    if library is not None:
        df = df.where(F.col("library_id") == library)
    return df if deleted else df.where(~F.coalesce("deleted", F.lit(False)))


def current_version(df: DataFrame, version: int) -> DataFrame:
    return df.where(F.col("schema_version") == version)


def authors(rows: Column) -> Column:
    """array of (name, first, last) -> names, first and last joined where there is no name, blanks left out."""
    return F.filter(F.transform(rows, lambda r: F.coalesce(F.nullif(F.trim(text(r["name"])), F.lit("")), F.trim(F.concat_ws(" ", r["first"], r["last"])))), lambda n: n != "")


def card(title: Column, authors_: Column, date: Column, doi_: Column, tags: Column) -> Column:
    return F.struct(F.lit(1).alias("schema_version"), F.struct(F.trim(text(title)).alias("title"), authors_.alias("authors"), year(date).alias("year")).alias("metadata"), F.struct(doi(doi_).alias("doi")).alias("identifiers"), F.array_distinct(tags).alias("tags"))


def search_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def annotation(label: Column, position: Column, comment: Column) -> Column:
    """(page, position, has_comment): the page from its label if it is a number, the position if it is JSON."""
    return F.struct(F.expr("1").alias("one"), label.try_cast("int").alias("page"), F.when(F.try_parse_json(position).isNotNull(), position).alias("position"), (F.trim(text(comment)) != "").alias("has_comment")).dropFields("one")


def flat_blocks(pages: DataFrame, document: str, blocks: str) -> DataFrame:
    """(document, page, blocks array) -> a row a block with its place in the page and in the document."""
    rows = pages.select(document, "page", F.posexplode(blocks).alias("place", "block"))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(document).orderBy("page", "place")))


def scaled_line(x0: Column, y0: Column, x1: Column, y1: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """A box of a picture in page coordinates; null where the aspect ratios differ by over 2.5 %."""
    same = F.abs(from_w / from_h / (to_w / to_h) - 1) <= 0.025
    return F.when(same, F.struct((x0 * to_w / from_w).alias("x0"), (y0 * to_h / from_h).alias("y0"), (x1 * to_w / from_w).alias("x1"), (y1 * to_h / from_h).alias("y1")))


LEVELS = ["metadata", "abstract", "fulltext"]


def evidence(level: Column, document: Column, page: Column, block: Column) -> Column:
    """(level, valid): a full-text finding needs a document and a page or block."""
    known = F.when(F.lower(text(level)).isin(LEVELS), F.lower(level)).otherwise("metadata")
    placed = (text(document) != "") & (page.isNotNull() | (text(block) != ""))
    return F.struct(known.alias("level"), ((known != "fulltext") | placed).alias("valid"))


def manifest(payload: Column) -> Column:
    """An older manifest under the present names, stamped with version 3."""
    first = lambda *p: F.coalesce(*[F.get_json_object(payload, f"$.{x}") for x in p], F.lit(""))
    return F.struct(F.lit(3).alias("schema_version"), first("documentID", "documentId", "document_id").alias("document_id"), first("sourceFingerprint", "source_fingerprint", "fingerprint").alias("fingerprint"))


#: Fields of an item that may be overwritten.
WRITABLE = ["title", "abstractNote", "date", "DOI", "ISBN", "publicationTitle", "journalAbbreviation", "url", "volume", "issue", "pages", "publisher", "language"]


def updated(current: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """current with the writable fields that values has (not null) put over it; other fields of values are ignored."""
    names = [c for c in values.columns if c in WRITABLE and c in current.columns]
    v = values.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in names])
    out = current.join(v, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in names else F.col(c) for c in current.columns])


# --- predicates -----------------------------------------------------------------------------

#: Other names of item fields.
FIELD_NAMES = {"creator": "creator", "creators": "creator", "author": "creator", "tag": "tags", "tags": "tags", "abstract": "abstract", "abstractnote": "abstract", "publication": "publication", "publicationtitle": "publication", "journal": "publication", "doi": "doi", "isbn": "isbn", "itemtype": "item_type", "type": "item_type", "date": "date", "issued": "date", "title": "title", "url": "url", "language": "language", "extra": "extra"}


def field_values(df: DataFrame, name: str) -> Column:
    """The values of a field by any of its names, as an array."""
    key = name.replace("-", "").replace("_", "").replace(" ", "").lower()
    column = FIELD_NAMES.get(key, name)
    if column not in df.columns:
        return F.array().cast("array<string>")
    return F.col(column) if df.schema[column].dataType.typeName() == "array" else F.array(F.col(column).cast("string"))


def matching(df: DataFrame, query: str = "", contains: dict | None = None, equals: dict | None = None, tags: list[str] | None = None, tag_mode: str = "any", year_from=None, year_to=None, **exists) -> DataFrame:
    """Items that satisfy every given option; exists: has_attachment=True and the like."""
    tests = []
    if query:
        tests.append(F.exists(F.array(*[F.lower(text(F.array_join(field_values(df, n), " "))) for n in ("title", "abstract", "doi", "publication", "creator", "tags")]), lambda x: x.contains(query.lower())))
    tests += [field_matches(field_values(df, n), "contains", v) for n, v in (contains or {}).items()]
    tests += [field_matches(field_values(df, n), "equals", v) for n, v in (equals or {}).items()]
    if tags:
        tests.append(tags_match(field_values(df, "tags"), tags, tag_mode))
    if year_from is not None or year_to is not None:
        tests.append(in_range(year(F.col("date")), year_from, year_to))
    tests += [F.col(n) == v for n, v in exists.items()]
    return df.where(all_of(tests))


def regular(item_type: Column) -> Column:
    return ~item_type.isin("attachment", "note", "annotation")


#: Types of blocks that are no content of a page.
FURNITURE = ["header", "footer", "page_header", "page_footer", "page_number", "aside_text"]


def furniture(kind: Column) -> Column:
    return kind.isin(FURNITURE)


def current_translation(status: Column, made_for: Column, now: Column) -> Column:
    return F.coalesce((status == "complete") & (made_for != "") & (made_for == now), F.lit(False))


# --- listings -------------------------------------------------------------------------------


def listing(df: DataFrame, order: list[Column], limit: int, most: int = 200, **equals) -> DataFrame:
    """Rows with the given values, in an order, at most min(limit, most)."""
    return df.where(all_of([F.col(k) == v for k, v in equals.items()])).orderBy(*order).limit(max(1, min(limit, most)))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of every key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def natural_key(c: Column) -> Column:
    """A text for ordering: case aside, numbers by value up to ten digits."""
    padded = F.regexp_replace(F.lower(text(c)), r"(?<!\d)(\d+)", "0000000000$1")
    return F.regexp_replace(padded, r"0*(\d{10})(?!\d)", "$1")


def reading_order(page: Column, index: Column) -> Column:
    return page * 1_000_000 + index


# --- joins ----------------------------------------------------------------------------------


def parents_of_hits(items_: DataFrame, hits: DataFrame) -> DataFrame:
    """Items (id) that hits (id, parent_id) name themselves or as their parent."""
    ids = hits.select(F.explode(F.array_distinct(F.array_compact(F.array("id", "parent_id")))).alias("id")).distinct()
    return items_.join(ids, "id", "left_semi")


def first_holder(things: DataFrame, holders: DataFrame, thing: str, held: str, holder: str, order: str) -> DataFrame:
    """Every thing with the first holder (by order) whose array lists it, or null."""
    first = holders.select(F.explode(held).alias(thing), holder, order).groupBy(thing).agg(F.min_by(holder, order).alias(holder))
    return things.join(first, thing, "left")


def resolved(wanted: DataFrame, paths: DataFrame, target: str, path: str) -> DataFrame:
    """wanted with path: by the whole name, else by the last part if only one path has it; case aside."""
    base = lambda c: F.lower(F.regexp_extract(F.col(c), r"([^/]*)$", 1))
    full = paths.groupBy(F.lower(path).alias("_k")).agg(F.min(path).alias("_full"))
    short = paths.groupBy(base(path).alias("_b")).agg(F.min(path).alias("_short"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    out = wanted.withColumn("_k", F.lower(target)).withColumn("_b", base(target)).join(full, "_k", "left").join(short, "_b", "left")
    return out.withColumn(path, F.coalesce("_full", "_short")).drop("_k", "_b", "_full", "_short")


def located(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """quotes (quote, document_id, block_id, text) with found: the block named, else the first that holds the beginning of the text."""
    named = blocks.select("document_id", "block_id", F.lit(True).alias("_there"))
    out = quotes.join(named, ["document_id", "block_id"], "left")
    rest = out.where("_there IS NULL").select("quote", "document_id", F.left("text", F.lit(80)).alias("_t"))
    found = rest.join(blocks.select("document_id", F.col("block_id").alias("_b"), "place", F.col("text").alias("_bt")), "document_id").where(F.col("_bt").contains(F.col("_t"))).groupBy("quote").agg(F.min_by("_b", "place").alias("_found"))
    return out.join(found, "quote", "left").select("quote", "document_id", F.when(F.col("_there"), F.col("block_id")).otherwise(F.col("_found")).alias("found"))


def endpoints(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """edges with the node id that a column names: exactly, else by letters and numbers if only one node has them."""
    bare = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]", "")
    exact = nodes.select(F.col("id").alias("_exact")).distinct()
    fuzzy = nodes.groupBy(bare("id").alias("_k")).agg(F.min("id").alias("_fuzzy"), F.count_distinct("id").alias("_n")).where("_n = 1").drop("_n")
    out = edges.withColumn("_k", bare(column)).join(exact, F.col(column) == F.col("_exact"), "left").join(fuzzy, "_k", "left")
    return out.withColumn(f"{column}_id", F.coalesce("_exact", "_fuzzy")).drop("_k", "_exact", "_fuzzy")


def cited(c: Column, marker: str, references: Column) -> Column:
    """array of (n, marker, reference): the n-th marker of a text and the n-th reference."""
    found = F.regexp_extract_all(text(c), F.lit(marker), F.lit(0))
    return F.transform(found, lambda m, i: F.struct((i + 1).alias("n"), m.alias("marker"), F.get(references, i).alias("reference")))


def translatable_queue(batch: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Items not parsed in this batch, or whose parse is complete."""
    return batch.join(parsed.select(key, F.col("status").alias("_s")), key, "left").where("_s IS NULL OR _s = 'completed'").drop("_s")


# --- aggregates -----------------------------------------------------------------------------


def signature(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (n, signature): an order-independent digest of a table, by sums that tasks make in part."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    h = F.conv(F.substring(F.md5(row), 1, 13), 16, 10).cast("long")
    n = F.count("*")
    return rows.agg(n.alias("n"), F.concat_ws(":", n.cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(20,0)")).cast("string")).alias("signature"))


def majority_spelling(labels: DataFrame, label: str) -> DataFrame:
    """(label, corrected): a label gives way to the most frequent one at edit distance 1 or 2 with its last two signs.

    Labels within two edits share a form that either has with at most two signs left out, so
    they meet by an equi join on these forms and no label meets all others.  Labels are
    short: one of n signs has some n * n / 2 forms.
    """
    n = labels.groupBy(label).agg(F.count("*").alias("n"))
    without = lambda t, i: F.concat(F.left(t, i - 1), F.substr(t, i + 1))
    drop = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: without(t, i))).otherwise(F.array().cast("array<string>"))
    once = drop(F.col(label))
    forms = F.array_distinct(F.concat(F.array(F.col(label)), once, F.flatten(F.transform(once, drop))))
    keyed = n.select(label, "n", F.explode(forms).alias("_f"))
    other = keyed.select(F.col(label).alias("_o"), F.col("n").alias("_m"), "_f")
    better = keyed.join(other, "_f").where((F.col("_m") > F.col("n")) & (F.right(label, F.lit(2)) == F.right("_o", F.lit(2))) & (F.levenshtein(label, "_o") <= 2))
    best = better.groupBy(label).agg(F.max_by("_o", F.struct("_m", "_o")).alias("_best"))
    return n.join(best, label, "left").select(label, F.coalesce("_best", label).alias("corrected"))


def batch_plan(items_: DataFrame) -> DataFrame:
    """One row: how many items are to be parsed and translated, and how many documents that touches."""
    return items_.agg(F.count_if(~F.col("parsed")).alias("to_parse"), F.count_if(~F.col("translated")).alias("to_translate"), F.count_distinct(F.when(~F.col("parsed") | ~F.col("translated"), F.col("document_id"))).alias("documents"))


# --- sets -------------------------------------------------------------------------------------


def joined_sets(a: Column, b: Column) -> Column:
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def without(a: Column, b: Column) -> Column:
    return F.array_except(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def distinct_hits(frames: list[DataFrame], key: str) -> DataFrame:
    """The rows of many searches, one a key: the last search's."""
    from functools import reduce

    rows = reduce(lambda a, b: a.unionByName(b), [f.withColumn("_s", F.lit(i)) for i, f in enumerate(frames)])
    return latest(rows, key, "_s").drop("_s")


# --- seeds, graphs ---------------------------------------------------------------------------


def seed_kind(c: Column) -> Column:
    t = F.trim(text(c))
    return F.when(t.rlike(r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)?10\.\d+/"), "doi").when(t.rlike(r"(?i)^(arxiv:)?\d{4}\.\d{4,5}(v\d+)?$"), "arxiv").when(t.rlike(r"(?i)^(pmid:\s*)?\d{5,9}$"), "pmid").otherwise("title")


def discovered(candidates: DataFrame, key: str, score: str, limit: int = 20, shortlist: int = 10) -> DataFrame:
    """The best candidates with their rank, and whether they are on the shortlist."""
    top = candidates.orderBy(F.col(score).desc(), key).limit(min(limit, 100))
    rank = F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key)))  # over at most 100 rows
    return top.withColumn("rank", rank).withColumn("shortlisted", F.col("rank") <= min(shortlist, 30))


def edge_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, n) of a flow chart: repeated ids, edges with unknown ends, edges from a node to itself."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    lost = edges.join(ids, F.col("source") == F.col("_id"), "left_anti").unionByName(edges.join(ids, F.col("target") == F.col("_id"), "left_anti")).distinct()
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
    repeated = nodes.agg((F.count("*") - F.count_distinct("id")).alias("n")).select(F.lit("repeated").alias("fault"), "n")
    return repeated.unionByName(one(lost, "unknown_end")).unionByName(one(edges.where("source = target"), "loop"))


def formulas_replaced(formulas: DataFrame, replacements: DataFrame) -> DataFrame:
    """formulas (id, tex) with the replacements' tex, and whether it changed."""
    r = replacements.select("id", F.col("tex").alias("_tex"))
    return formulas.join(r, "id", "left").withColumn("changed", F.coalesce(F.col("_tex") != F.col("tex"), F.lit(False))).withColumn("tex", F.coalesce("_tex", "tex")).drop("_tex")
