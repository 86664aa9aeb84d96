"""Search: tokenisers, field predicates, weighted ranking, snippets, pagination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_identifier, text


def tokens(query: Column) -> Column:
    """Lower-case runs of letters and numbers, longer than one sign."""
    return F.filter(F.split(F.lower(text(query)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)


def blank_tokens(query: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text(query))), r"\s+"), lambda t: t != "")


def query_tokens(query: str) -> list[str]:
    """tokens() of a constant, on the driver."""
    out, word = [], []
    for ch in query.lower() + " ":
        if ch.isalnum():
            word.append(ch)
        elif word:
            out.append("".join(word))
            word = []
    return [t for t in out if len(t) > 1]


# --- predicates ---------------------------------------------------------------------------

_POSITIVE = {
    "equals": lambda v, w: v == w,
    "startswith": lambda v, w: v.startswith(w),
    "endswith": lambda v, w: v.endswith(w),
    "contains": lambda v, w: v.contains(w),
    "gt": lambda v, w: v.try_cast("double") > float(w),
    "gte": lambda v, w: v.try_cast("double") >= float(w),
    "lt": lambda v, w: v.try_cast("double") < float(w),
    "lte": lambda v, w: v.try_cast("double") <= float(w),
}
_NEGATIVE = {"notequals": "equals", "notcontains": "contains", "notin": "in"}
#: Other names of operators.
_ALIASES = {"present": "exists", "absent": "notexists", "equal": "equals", "is": "equals", "exact": "equals", "isnot": "notequals", "not": "notequals", "prefix": "startswith", "suffix": "endswith", "matches": "regex", "greaterthan": "gt", "after": "gt", "onorafter": "gte", "before": "lt", "onorbefore": "lte", "oneof": "in", "noneof": "notin"}


def field_matches(values: Column, operator: str, expected) -> Column:
    """A predicate over a field of many values.

    Positive operators hold if any value satisfies them, negative ones if none violates
    them; case does not matter.  Unknown operators mean contains.
    """
    op = operator.lower().replace(" ", "").replace("_", "").replace("-", "")
    op = _ALIASES.get(op, op)
    low = F.transform(values, lambda v: F.lower(text(v)))
    wanted = [str(x).lower() for x in expected] if isinstance(expected, (list, tuple)) else [x.strip().lower() for x in str(expected).split(",") if x.strip()]
    if op in ("exists", "notexists"):
        some = F.exists(low, lambda v: F.trim(v) != "")
        return some if op == "exists" else ~some
    if op in _NEGATIVE:
        return ~field_matches(values, _NEGATIVE[op], expected)
    if op == "in":
        return F.exists(low, lambda v: v.isin(wanted))
    if op == "regex":
        return F.exists(values, lambda v: text(v).rlike(f"(?i){expected}"))
    rule = _POSITIVE.get(op, _POSITIVE["contains"])
    return F.coalesce(F.exists(low, lambda v: rule(v, str(expected).lower())), F.lit(False))


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def field_queries(queries: list[tuple[Column, str, object]], logic: str = "and") -> Column:
    return (any_of if logic == "or" else all_of)([field_matches(v, op, x) for v, op, x in queries])


def tags_match(tags: Column, wanted: list[str], mode: str = "any", operator: str = "contains") -> Column:
    """any: at least one wanted tag is matched; all: every one; none: not one."""
    each = [field_matches(tags, operator, w) for w in wanted]
    return all_of(each) if mode == "all" else ~any_of(each) if mode == "none" else any_of(each)


def in_range(value: Column, low=None, high=None) -> Column:
    """Within inclusive bounds; a missing value fails any bound."""
    bounds = ([value >= low] if low is not None else []) + ([value <= high] if high is not None else [])
    return F.coalesce(all_of(bounds), F.lit(False))


def all_needles(value: Column, needles: str) -> Column:
    """Every needle of a list parted by commas or semicolons is contained."""
    import re

    return all_of([F.lower(text(value)).contains(n.strip().lower()) for n in re.split("[,;]+", needles) if n.strip()])


# --- ranking --------------------------------------------------------------------------------


def weighted_score(fields: list[tuple[Column, float]], query: str, per_token: bool = True) -> Column:
    """The sum of the weights of fields that contain each token, by default over the number of tokens.

    fields are lower case.
    """
    words = query_tokens(query)
    total = reduce(lambda a, b: a + b, [F.when(f.contains(t), F.lit(float(w))).otherwise(F.lit(0.0)) for t in words for f, w in fields], F.lit(0.0))
    return total / len(words) if per_token and words else total


def citation_bonus(citations: Column, most: float) -> Column:
    return F.least(F.lit(most), F.log10(F.coalesce(citations, F.lit(0)) + F.lit(1.0)))


def candidate_score(base: Column, title: Column, abstract: Column, venue: Column, citations: Column, open_access: Column, local: Column, query: str, prefer_local: bool) -> Column:
    score = base + weighted_score([(F.lower(title), 8), (F.lower(abstract), 3), (F.lower(venue), 1)], query, per_token=False)
    score = score + citation_bonus(citations, 4.0) + F.when(open_access, 0.25).otherwise(0.0)
    if prefer_local:
        score = score + F.when(local, 0.5).otherwise(0.0)
    return F.round(score, 4)


def relevance(fields: list[tuple[Column, int]], query: str) -> Column:
    """Of library items: every value of a field that contains the query has the field's weight, an equal one three times it."""
    q = query.strip().lower()
    if not q:
        return F.lit(0)

    def of_field(values: Column, w: int) -> Column:
        return F.aggregate(values, F.lit(0), lambda n, v: n + F.when(F.lower(text(v)) == q, 3 * w).when(F.lower(text(v)).contains(q), w).otherwise(0))

    return reduce(lambda a, b: a + b, [of_field(values, w) for values, w in fields])


def snippet(value: Column, first_token: str, before: int = 180, after: int = 520) -> Column:
    """The text around the first occurrence of a token (its beginning if there is none)."""
    at = F.greatest(F.instr(F.lower(text(value)), first_token) - 1, F.lit(0))
    start = F.greatest(at - before, F.lit(0))
    return F.substring(text(value), start + 1, at + after - start)


def corpus_search(fields: DataFrame, query: str, limit: int = 50, per_document: int = 1) -> DataFrame:
    """fields (document_id, title, type, block_id, text) -> the best candidates of each document, best documents first.

    A candidate's score is the share of the query's tokens that its text contains; ties go
    to blocks before whole texts, then to the block's place.
    """
    words = [w for w in query.lower().split() if w]
    low = F.lower(text(F.col("text")))
    score = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]) / F.lit(float(len(words)))
    hits = fields.withColumn("score", score).where("score > 0")
    best = Window.partitionBy("document_id").orderBy(F.col("score").desc(), (F.coalesce("block_id", F.lit("")) != "").desc(), F.col("block_id"), F.col("type"))
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(1, per_document))
    top = hits.orderBy(F.col("score").desc(), "title", "document_id", "rank").limit(min(200, limit))
    return top.select("document_id", "title", "type", "block_id", "score", snippet(F.col("text"), words[0]).alias("snippet"))


def inverted_index(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(term, key): the distinct terms of every row."""
    return docs.select(key, F.explode(F.array_distinct(tokens(F.col(column)))).alias("term"))


def prefix_candidates(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys that have, for each token of the query, a term that begins with it."""
    words = sorted(set(query_tokens(query)))
    hit = F.explode(F.array(*[F.when(F.col("term").startswith(w), F.lit(w)) for w in words])).alias("token")
    found = index.where(any_of([F.col("term").startswith(w) for w in words])).select(key, hit).where("token IS NOT NULL")
    return found.groupBy(key).agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(words)).select(key)


def occurrences(docs: DataFrame, key: str, column: str, literal: str, limit: int) -> DataFrame:
    """(key, position, snippet): the non-overlapping places of a literal, case aside, at most `limit` a row."""
    parts = F.split(F.lower(text(F.col(column))), "\\Q" + literal.lower() + "\\E")
    ends = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: F.length(x))
    zero = F.array().cast("array<int>")
    at = F.aggregate(ends, zero, lambda a, n: F.concat(a, F.array(F.when(F.size(a) == 0, n).otherwise(F.element_at(a, -1) + n + len(literal)))))
    rows = docs.select(key, F.col(column), F.explode(F.slice(at, 1, limit)).alias("position"))
    start = F.greatest(F.col("position") - 180, F.lit(0))
    return rows.select(key, "position", F.substring(text(F.col(column)), start + 1, F.col("position") + 260 - start).alias("snippet"))


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordering, and the total of all rows, by a scalar subquery, on each of its rows."""
    return df.orderBy(*order).offset(max(0, offset)).limit(limit).withColumn("total", df.agg(F.count("*")).scalar())


def by_identifier(cards: DataFrame, identifiers: Column, wanted: str) -> DataFrame:
    """Rows one of whose identifiers equals the wanted one, schemes and case aside."""
    import re

    key = re.sub(r"^(doi|arxiv|pmid):\s*", "", wanted.strip().lower())
    return cards.where(F.exists(identifiers, lambda x: bare_identifier(x) == key))
