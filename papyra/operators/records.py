"""Record operators: de-duplication, enrichment, exports, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_identifier, text, title_key


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns])


def identity(doi: Column, arxiv: Column, pmid: Column, candidate: Column, document: Column, title: Column) -> Column:
    """What two records of one work share: the first identifier there is, else the title."""
    return F.lower(first_filled(doi, arxiv, pmid, candidate, document, title_key(title)))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; only the first rows of each task are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deduplicated(cards: DataFrame, order: str) -> DataFrame:
    """cards (key, score, title, year, in_library, `order`) -> one a key, then one a title and year.

    Of a key the best score stays (the first on ties); rows without key go.  Of rows with
    one title, a later local one replaces the title's first row if that is not local and of
    the same year; others stay.
    """
    best = first_by(cards.where("key IS NOT NULL AND key <> ''"), ["key"], [F.col("score").desc(), F.col(order)])
    place = cards.where("key <> ''").groupBy("key").agg(F.min(order).alias("_place"))
    best = best.join(place, "key").withColumn("_title", title_key(F.col("title")))
    w = Window.partitionBy("_title").orderBy("_place")
    lead = F.first(F.struct("year", "in_library", "_place")).over(w)
    rows = best.withColumn("_lead", lead)
    replaces = (F.col("_title") != "") & (F.col("_place") > F.col("_lead._place")) & F.col("in_library") & ~F.col("_lead.in_library") & (F.coalesce("year", F.lit(0)) == F.coalesce(F.col("_lead.year"), F.lit(0)))
    rows = rows.withColumn("_replaces", replaces)
    replaced = F.max(F.col("_replaces").cast("int")).over(Window.partitionBy("_title"))
    rows = rows.withColumn("_gone", (F.col("_place") == F.col("_lead._place")) & (replaced == 1) & (F.col("_title") != ""))
    return rows.where("NOT _gone").drop("_title", "_place", "_lead", "_replaces", "_gone")


def enriched(candidates: DataFrame, local: DataFrame, key: str, identifiers: Column, local_key: str, local_identifiers: Column, title: str, local_title: str) -> DataFrame:
    """candidates with local_key and match: by any identifier, in their order, else by title, else null.

    Identifiers become rows, so both matches are equi joins.
    """
    mine = candidates.select(key, F.posexplode(identifiers).alias("_at", "_id")).select(key, "_at", bare_identifier(F.col("_id")).alias("_id")).where("_id <> ''")
    theirs = local.select(local_key, F.explode(local_identifiers).alias("_id")).select(local_key, bare_identifier(F.col("_id")).alias("_id")).where("_id <> ''")
    by_id = mine.join(theirs, "_id").groupBy(key).agg(F.min(local_key).alias("_by_id"))
    titles = local.select(title_key(F.col(local_title)).alias("_t"), local_key).where("_t <> ''").groupBy("_t").agg(F.min(local_key).alias("_by_title"))
    out = candidates.join(by_id, key, "left").withColumn("_t", title_key(F.col(title))).join(titles, "_t", "left")
    return out.withColumn(local_key, F.coalesce("_by_id", "_by_title")).withColumn("match", F.when(F.col("_by_id").isNotNull(), "identifier").when(F.col("_by_title").isNotNull(), "title")).drop("_t", "_by_id", "_by_title")


def overlaid(new: Column, old: Column) -> Column:
    return F.coalesce(new, old)


def upserted(current: DataFrame, changes: DataFrame, key: str, sticky: list[str], inherit: list[str]) -> DataFrame:
    """current with changes put over it by key: sticky flags stay true, a null of inherit keeps the old value."""
    a, b = current.alias("a"), changes.alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    out = [F.coalesce(f"b.{key}", f"a.{key}").alias(key)]
    for c in current.columns:
        if c in sticky:
            out.append((F.coalesce(f"a.{c}", F.lit(False)) | F.coalesce(f"b.{c}", F.lit(False))).alias(c))
        elif c in inherit:
            out.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        elif c != key:
            out.append(F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return joined.select(*out)


# --- citations --------------------------------------------------------------------------------


def citation_key(last_name: Column, year: Column, ordinal: Column) -> Column:
    name = F.lower(F.regexp_replace(text(last_name), "[^A-Za-z0-9]+", ""))
    return F.concat(F.when(name == "", "item").otherwise(name), F.left(F.coalesce(year.cast("string"), F.lit("nodate")), F.lit(4)), ordinal.cast("string"))


def citation_text(creators: Column, year: Column, title: Column, publication: Column, style: str = "apa") -> Column:
    """A citation in the APA, IEEE or GB/T 7714 manner; creators is an array of names."""
    n = F.size(creators)
    author = F.when(n > 2, F.concat(creators[0], F.lit(", …"))).when(n == 2, F.concat(creators[0], F.lit(" & "), F.get(creators, F.lit(1)))).otherwise(F.coalesce(F.get(creators, F.lit(0)), F.lit("")))
    when, what, where = F.coalesce(year.cast("string"), F.lit("n.d.")), F.coalesce(F.nullif(text(title), F.lit("")), F.lit("Untitled")), text(publication)
    if style == "ieee":
        return F.concat(author, F.lit(", “"), what, F.lit(",” "), F.when(where != "", F.concat(where, F.lit(", "))).otherwise(""), when, F.lit("."))
    if style == "gb":
        return F.concat(author, F.lit(". "), what, F.when(where != "", F.concat(F.lit(". "), where)).otherwise(""), F.lit(", "), when, F.lit("."))
    return F.concat(F.when(author != "", F.concat(author, F.lit(" "))).otherwise(""), F.lit("("), when, F.lit("). "), what, F.lit("."), F.when(where != "", F.concat(F.lit(" "), where, F.lit("."))).otherwise(""))


def bibtex(kind: Column, key: Column, fields: list[tuple[str, Column]]) -> Column:
    escape = lambda c: F.regexp_replace(text(c), r"([\\{}])", r"\\$1")
    lines = F.array_compact(F.array(*[F.when(F.trim(text(v)) != "", F.concat(F.lit(f"  {name} = {{"), escape(v), F.lit("}"))) for name, v in fields]))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def ris(kind: Column, creators: Column, fields: list[tuple[str, Column]]) -> Column:
    authors = F.transform(creators, lambda x: F.concat(F.lit("AU  - "), x))
    lines = F.array_compact(F.array(*[F.when(text(v) != "", F.concat(F.lit(f"{tag}  - "), text(v))) for tag, v in fields]))
    return F.array_join(F.concat(F.array(F.concat(F.lit("TY  - "), kind)), authors, lines, F.array(F.lit("ER  -"))), "\n")


def csv_cell(c: Column) -> Column:
    return F.when(text(c).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))


def csv_rows(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: csv_cell(x)), ",")), "\n")


def markdown_table(rows: Column) -> Column:
    """An array of rows as a pipe table; ragged rows are padded to the widest."""
    width = F.aggregate(rows, F.lit(0), lambda n, r: F.greatest(n, F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, lambda x: F.replace(text(x), F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def html_table(rows: Column) -> Column:
    """An array of rows as an HTML table, the first one its head; ragged rows are padded to the widest."""
    width = F.aggregate(rows, F.lit(0), lambda n, r: F.greatest(n, F.size(r)))
    escape = lambda x: F.replace(F.replace(F.replace(text(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    padded = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(padded(r), lambda x: F.concat(F.lit(f"<{tag}>"), escape(x), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(r, "td")), "")
    return F.concat(F.lit("<table>"), line(rows[0], "th"), body, F.lit("</table>"))


# --- jobs ----------------------------------------------------------------------------------------


def last_state(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last values of every key, by one grouped maximum."""
    return events.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in columns])


def retained(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def fresh(age_ms: Column, ttl_ms: int, allow_stale: bool) -> Column:
    """hit, stale or miss of a cached row."""
    return F.when(age_ms <= ttl_ms, "hit").when(F.lit(allow_stale) & age_ms.isNotNull(), "stale").otherwise("miss")


def contiguous_prefix(df: DataFrame, key: str, index: str) -> DataFrame:
    """Rows whose indexes run from 0 without a gap: what an ordered commit has released."""
    w = Window.partitionBy(key).orderBy(index)
    return df.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") == F.col(index)).drop("_n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
