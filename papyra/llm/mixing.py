"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash that depends on its id and text alone.  Words are summed by source and
hash bucket; the running sum shows in which bucket a source's budget ends, and only that
bucket is summed again by the next bits of the hash, until the bits are used up.  What is
left is one threshold for each source, so the choice is a filter: nothing is sorted, and a
smaller budget always picks a subset of what a larger one picks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Stash, fresh, hash52, table

LEVELS, LEVEL_BITS = 4, 13
#: A broadcast of the sources' thresholds is at most this many short rows.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with target.

    Sources in code point order, null last, weigh `weights`, repeating.  They share
    `share` of all words; none gets more than `most` times its own, and what it cannot
    take goes to the others by weight.  That is min(most * size, level * weight) for the
    one level at which the targets add up: sources are met in order of most * size /
    weight, and the level is found at the first that is not capped.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = capped.withColumn("level", (F.lit(share) * total - before) / after)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("cap_rank", "level"))).over(Window.partitionBy())
    leveled = leveled.withColumn("cap_rank", F.row_number().over(fill)).withColumn("found", first).withColumn("found", F.col("found.level"))
    target = F.coalesce(F.least(F.col("cap"), F.col("found") * F.col("weight")), F.col("cap"))
    return leveled.select("source", "source_size", target.alias("target"))


def _step(sized: DataFrame, at: DataFrame, level: int, last: bool) -> DataFrame:
    """Sums the boundary buckets by the next bits of the hash and finds where the budget ends."""
    shift = (LEVELS - level) * LEVEL_BITS
    open_docs = sized.withColumn("prefix", F.shiftright("u", shift + LEVEL_BITS)).join(at.select(F.col("source").alias("s"), F.col("prefix").alias("p")), F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p"))).drop("s", "p")
    sums = open_docs.groupBy("source", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    joined = sums.join(at.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    w = Window.partitionBy("source").orderBy("bucket")
    below = F.sum("words").over(w) - F.col("words")
    run = joined.withColumn("below", F.col("done") + below)
    inside = F.col("below") + F.col("words") <= F.col("budget")
    if last:  # the boundary document itself: taken if that comes nearer
        inside = F.col("below") + F.col("words") - F.col("budget") < F.col("budget") - F.col("below")
        found = run.groupBy("source").agg(F.coalesce(F.min(F.when(~inside, F.struct("bucket", F.col("below").alias("at")))), F.max(F.struct((F.col("bucket") + 1).alias("bucket"), (F.col("below") + F.col("words")).alias("at")))).alias("x"))
    else:
        found = run.groupBy("source").agg(F.coalesce(F.min(F.when(~inside, F.struct("bucket", F.col("below").alias("at")))), F.max(F.struct("bucket", F.col("below").alias("at")))).alias("x"))
    keep = at.select(F.col("source").alias("s"), "budget")
    return found.join(keep, F.col("source").eqNullSafe(F.col("s"))).select("source", "budget", F.col("x.bucket").alias("prefix"), F.col("x.at").alias("done"))


def thresholds(stash: Stash, sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target) -> with copies (that each document gets) and threshold.

    A document whose hash is below the threshold gets one copy more.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = stash.put(goals.withColumn("copies", whole).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")), "goals")
    at = goals.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("done"))
    for level in range(1, LEVELS + 1):
        at = stash.put(_step(sized, at, level, level == LEVELS), f"level{level}")
    found = at.select(F.col("source").alias("s"), F.col("prefix").alias("threshold"))
    return goals.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))


def place() -> Column:
    """52 bits by which a document is chosen: of md5 of its id and text, so rows that repeat an id, or have none, are told apart."""
    return hash52(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))


def chosen(docs: DataFrame, names: dict[str, str], weights, share: float, most: float) -> DataFrame:
    """docs with source_size, target and copies under the names given."""
    stash = Stash(docs.sparkSession, "mix")
    u = place()
    sized = stash.put(docs.select("source", word_count(F.col("text")).alias("size"), u.alias("u")), "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = stash.put(thresholds(stash, sized, targets(per_source, weights, share, most)), "thresholds")
    small = found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    held = found.select(F.col("source").alias(names["s"]), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]), F.col("copies").alias(names["copies"]), F.col("threshold").alias(names["threshold"]))
    out = docs.join(F.broadcast(held) if small else held, F.col("source").eqNullSafe(F.col(names["s"])), "left")
    times = F.least(F.col(names["copies"]) + (u < F.col(names["threshold"])).cast("long"), F.lit(int(most)).cast("long"))
    return out.withColumn(names["copies"], times).drop(names["s"], names["threshold"])


def mixed(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, source, size, source_size, target, copies_taken, taken).

    copies_taken is how often the mix repeats the document: 0, 1 or 2 times for the
    defaults.  A null text has no words; a null source is a source of its own; rows equal in
    doc_id and text are chosen together, others each for itself, also without doc_id; a
    source without words has target 0; an empty table gives none.  Extra columns are left
    out.  Texts of any length are counted whole.
    """
    names = {"s": "s", "source_size": "source_size", "target": "target", "copies": "copies_taken", "threshold": "threshold"}
    out = chosen(docs.select("doc_id", "source", "text"), names, weights, share, most)
    size = word_count(F.col("text"))
    return out.select("doc_id", "source", size.alias("size"), "source_size", "target", "copies_taken", (F.col("copies_taken") * size).alias("taken"))


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: every column of docs, a row for each copy that the mix takes.

    The thresholds go to the documents, as a broadcast where the sources are few, so texts
    are not moved.  Odd rows are treated as mixed() states.
    """
    names = {x: fresh(docs, x) for x in ("s", "source_size", "target", "copies", "threshold")}
    copy = fresh(docs, "copy")
    out = chosen(docs, names, weights, share, most).where(F.col(names["copies"]) > 0)
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(names["copies"]).cast("int")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS u
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CAST([5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM per_source),
leveled AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS cap_rank,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
found AS (SELECT level AS found FROM leveled WHERE level <= cap / weight ORDER BY cap_rank LIMIT 1),
goals AS (
  SELECT source, source_size, coalesce(least(cap, found * weight), cap) AS target
  FROM leveled LEFT JOIN found ON TRUE),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS budget
  FROM goals),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.copies, b.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.u) AS here
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(least(copies + CASE WHEN upto - budget < budget - (upto - here) THEN 1 ELSE 0 END, 2) * size AS BIGINT) AS taken
FROM run
"""
