"""Ordered scans of documents, conversations and layouts as windows, folds and grouped maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinals(df: DataFrame, keys: list[str], order: list[str], prefix: str) -> DataFrame:
    """ordinal from 1 in each group's order, and label such as figure-001."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("ordinal", n).withColumn("label", F.format_string(prefix + "-%03d", n))


def sections(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Headings (level, title) with the first and last line of their sections."""
    w = Window.partitionBy(key).orderBy(order)
    end = F.max(order).over(Window.partitionBy(key))
    marked = lines.withColumn("_end", end).withColumn("level", F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))).where("level > 0")
    return marked.select(key, "level", F.trim(F.regexp_replace(F.col(line), r"^#{1,6}\s+", "")).alias("title"), F.col(order).alias("first_line"), F.coalesce(F.lead(order).over(w) - 1, "_end").alias("last_line"))


def neighbours(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def context(df: DataFrame, keys: list[str], order: str, value: str, before: int, after: int) -> DataFrame:
    """The values around each row, at most 20 on either side."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("before", F.collect_list(value).over(w.rowsBetween(-min(before, 20), -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, min(after, 20))))


def turns(messages: DataFrame, conversation: str, order: str, role: str) -> DataFrame:
    """turn_no (how many messages of the user so far) and role_ordinal."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    user = (F.col(role) == "user").cast("int")
    kind = F.when(F.col(role) == "user", "user").otherwise("assistant")
    own = Window.partitionBy(conversation, kind).orderBy(order)
    return messages.withColumn("turn_no", F.sum(user).over(w)).withColumn("role_ordinal", F.row_number().over(own))


def conversation_titles(messages: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """The first non-blank message of the user, white space collapsed, without a leading [tag], 52 signs at most."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"^ ?\[[^\]]*\] ?", ""))
    first = messages.where((F.col(role) == "user") & (clean != "")).groupBy(conversation).agg(F.min_by(clean, order).alias("t"))
    return first.select(conversation, F.left("t", F.lit(52)).alias("title"))


def greedy_groups(lengths: Column, most: int, most_items: int, overhead: int = 0) -> Column:
    """The group (from 0) of every item of an array of sizes, closing a group when it would overflow.

    The carry makes this a fold, not a window: one expression over each document's array.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("items"), F.lit(0).alias("at"))

    def step(s, n):
        need = n.cast("long") + overhead
        full = (s["items"] > 0) & ((s["size"] + need > most) | (s["items"] >= most_items))
        at = F.when(full, s["at"] + 1).otherwise(s["at"])
        return F.struct(F.concat(s["out"], F.array(at)).alias("out"), F.when(full, need).otherwise(s["size"] + need).alias("size"), F.when(full, F.lit(1)).otherwise(s["items"] + 1).alias("items"), at.alias("at"))

    return F.aggregate(lengths, start, step)["out"]


def merged_chunks(chunks: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """Each key's chunks in order, joined by blank lines; complete is false if an index is missing or twice."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(index, text))).alias("c"), F.count_distinct(index).alias("n"), F.max(index).alias("m"), F.min(index).alias("l"))
    return rows.select(key, F.array_join(F.transform("c", lambda x: F.trim(x[text])), "\n\n").alias("text"), ((F.col("l") == 0) & (F.col("m") + 1 == F.col("n")) & (F.size("c") == F.col("n"))).alias("complete"))


def merged_runs(log: DataFrame, key: str, order: str, kind: str, group: list[str], text: str) -> DataFrame:
    """Contiguous rows of one kind and group become one row: gaps and islands."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.lit(True)
    for c in (kind, *group):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = log.withColumn("_new", (~same).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = runs.groupBy(key, "_run").agg(F.min(order).alias(order), F.first(kind).alias(kind), F.array_sort(F.collect_list(F.struct(order, text))).alias("_t"), F.count("*").alias("merged"))
    return rows.select(key, order, kind, F.array_join(F.transform("_t", lambda x: x[text]), "").alias(text), "merged")


def lines_by_baseline(items: DataFrame, key: str) -> DataFrame:
    """items (key, item, baseline, size) -> with line: items join the first line within max(2, 0.3 of the median size).

    First fit carries state, so each page's items are one grouped map (a page is small).
    """
    schema = f"{key} long, item long, line int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["baseline", "item"])
        near = max(2.0, 0.3 * float(rows["size"].median()))
        lines: list[float] = []
        out = []
        for k, item, base in zip(rows[key], rows["item"], rows["baseline"], strict=True):
            at = next((i for i, b in enumerate(lines) if abs(b - base) <= near), None)
            if at is None:
                at = len(lines)
                lines.append(base)
            out.append((k, item, at))
        return pd.DataFrame(out, columns=[key, "item", "line"])

    return items.groupBy(key).applyInPandas(run, schema)


def outline_parents(headings: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """parent: the place of the nearest earlier heading of a smaller level, or null."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # the last place of each of the six levels so far, as six running maxima
    parents = [F.max(F.when(F.col(level) == n, F.col(order))).over(w) for n in range(1, 7)]
    nearest = F.greatest(*[F.when(F.col(level) > n, p) for n, p in enumerate(parents, 1)], F.lit(None).cast("long"))
    return headings.withColumn("parent", nearest)


def rising_pages(lines: DataFrame, key: str, order: str, page: str) -> DataFrame:
    """How many lines have a page, and the share whose page is not below the one before."""
    w = Window.partitionBy(key).orderBy(order)
    seen = lines.where(F.col(page).isNotNull()).withColumn("_up", F.coalesce(F.col(page) >= F.lag(page).over(w), F.lit(True)))
    return seen.groupBy(key).agg(F.count("*").alias("entries"), F.avg(F.col("_up").cast("double")).alias("rising"))


def duplicate_neighbours(rows: DataFrame, key: str, order: str, source: str, translated: str, least: int = 24) -> DataFrame:
    """Rows whose translation the next row repeats although its source differs."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(translated, F.lit(""))), r"\s+", " "))
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_n", norm).withColumn("_next", F.lead("_n").over(w)).withColumn("_source", F.lead(source).over(w))
    return marked.where((F.length("_n") > least) & (F.col("_n") == F.col("_next")) & (F.col(source) != F.col("_source"))).drop("_n", "_next", "_source")


def unique_paths(paths: DataFrame, archive: str, order: str, path: str) -> DataFrame:
    """name: each path, the k-th of one name (case aside) with " (k)" before its extension."""
    k = F.row_number().over(Window.partitionBy(archive, F.lower(path)).orderBy(order))
    stem, ext = F.regexp_extract(path, r"^(.*?[^/])(\.[^./]*)?$", 1), F.regexp_extract(path, r"^.*[^/](\.[^./]*)$", 1)
    return paths.withColumn("name", F.when(k > 1, F.concat(stem, F.lit(" ("), k.cast("string"), F.lit(")"), ext)).otherwise(F.col(path)))


def chunk_table(chunks: DataFrame, key: str, order: str, text: str, prefix: str = "CHUNK_END") -> DataFrame:
    """start and end of every chunk in its document, and the marker that closes it."""
    from ..functions.text import fnv32

    w = Window.partitionBy(key).orderBy(order)
    end = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(w)
    marker = F.concat(F.lit(f"[[{prefix}_"), F.lpad(n.cast("string"), 4, "0"), F.lit("_"), fnv32(F.col(text)), F.lit("]]"))
    return chunks.withColumn("end", end).withColumn("start", end - F.length(text)).withColumn("marker", marker)


def page_ranges(pages: DataFrame, key: str, page: str, score: str, most: int = 200, radius: int = 20) -> DataFrame:
    """(key, part, first, last): parts of at most `most` pages, cut at the best score near their end.

    Where a part ends decides where the next begins, so each document is one fold.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(page)
        at, scores, first, out = rows[page].tolist(), rows[score].tolist(), 0, []
        while first < len(at):
            last = min(first + most, len(at)) - 1
            if last < len(at) - 1:
                near = range(max(first, last - radius + 1), last + 1)
                last = max(near, key=lambda i: (scores[i], i))
            out.append((rows[key].iloc[0], len(out), at[first], at[last]))
            first = last + 1
        return pd.DataFrame(out, columns=[key, "part", "first", "last"])

    return pages.groupBy(key).applyInPandas(run, f"{key} long, part int, first long, last long")


def first_near(rows: DataFrame, keys: list[str], order: str, text: str, pattern: str, reach: int = 4) -> DataFrame:
    """near: of the rows within `reach` before (nearest first), then after, the first text that matches."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.reverse(F.collect_list(text).over(w.rowsBetween(-reach, -1)))
    after = F.collect_list(text).over(w.rowsBetween(1, reach))
    return rows.withColumn("near", F.get(F.filter(F.concat(before, after), lambda x: x.rlike(pattern)), F.lit(0)))
