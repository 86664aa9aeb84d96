"""Trees and graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paths(tree: DataFrame, key: str, parent: str, name: str, depth: int = 50) -> DataFrame:
    """(key, depth, path): names from the root joined by " > ".

    Pointers double each round, so a tree of depth d takes log2(d) joins; a cycle ends at
    the bound and has no path.
    """
    rows = tree.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.array(F.col(name)).alias("names"))
    step = 1
    while step < depth:
        higher = rows.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("names").alias("_names"))
        rows = rows.join(higher, F.col("up") == F.col("_id"), "left").select("id", F.when(F.col("_id").isNotNull(), F.col("_up")).alias("up"), F.when(F.col("_id").isNotNull(), F.concat("_names", "names")).otherwise(F.col("names")).alias("names"))
        step *= 2
    whole = rows.where("up IS NULL")
    return whole.select(F.col("id").alias(key), (F.size("names") - 1).alias("depth"), F.array_join("names", " > ").alias("path"))


def literature_graph(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """papers (id, title, authors, topics, venue) -> nodes (key, type, label, n) and edges (source, target, kind).

    Nodes are keyed type:name in lower case; edges lead from papers to what they name.
    """
    paper = F.concat(F.lit("paper:"), F.col("id").cast("string"))
    parts = []
    for kind, edge, values in (("author", "written_by", F.col("authors")), ("topic", "about", F.col("topics")), ("venue", "published_in", F.array("venue"))):
        parts.append(papers.select(paper.alias("source"), F.explode(values).alias("label")).where("trim(label) <> ''").select("source", F.concat(F.lit(kind + ":"), F.lower(F.trim("label"))).alias("target"), F.lit(edge).alias("kind"), F.lit(kind).alias("type"), "label"))
    named = parts[0].unionByName(parts[1]).unionByName(parts[2])
    edges = named.select("source", "target", "kind").distinct()
    nodes = named.groupBy(F.col("target").alias("key"), "type").agg(F.min("label").alias("label"), F.count_distinct("source").alias("n"))
    return nodes.unionByName(papers.select(paper.alias("key"), F.lit("paper").alias("type"), F.col("title").alias("label"), F.lit(1).cast("long").alias("n"))), edges


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One hop from seeds (key): (seed, target, kind)."""
    return edges.join(seeds.withColumnRenamed("key", "source"), "source").select(F.col("source").alias("seed"), "target", "kind").distinct()


def tree_faults(nodes: DataFrame, key: str, parent: str, depth: int = 64) -> DataFrame:
    """(fault, n): roots other than one, repeated keys, unknown parents, and nodes no root reaches."""
    total = nodes.select(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.count_if(F.col(parent).isNull()).alias("roots"))
    ids = nodes.select(F.col(key).alias("_id")).distinct()
    orphan = nodes.where(F.col(parent).isNotNull()).join(ids, F.col(parent) == F.col("_id"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown_parent").alias("fault"), "n")
    reached = paths(nodes.withColumn("_name", F.col(key).cast("string")), key, parent, "_name", depth).agg(F.count_distinct(key).alias("r"))
    lost = total.join(reached, F.lit(True)).select(F.lit("unreached").alias("fault"), (F.col("d") - F.col("r")).alias("n"))
    return orphan.unionByName(lost).unionByName(total.select(F.lit("repeated").alias("fault"), (F.col("n") - F.col("d")).alias("n"))).unionByName(total.select(F.lit("roots").alias("fault"), F.col("roots").alias("n")))
