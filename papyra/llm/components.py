"""Connected components of links that no machine holds whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash

#: Links that a task holds at a time.
HELD = 1 << 20


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that these links lead to) of all nodes but the least ones: as many links as nodes at most."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends.reshape(2, -1)
    up = np.arange(len(nodes))
    while len(a):
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while ((above := up[up]) != up).any():
            up = above
    below = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[below], nodes[up[below]]


def _forests(batches):
    """(u, v) -> a forest with the same components; nothing is left out but links between what others join."""
    names, held, size = ["u", "v"], [], 0
    for batch in batches:
        held.append([x.to_numpy() for x in batch.columns])
        size += len(batch)
        if size >= HELD:
            held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
            if size >= HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], names)
                held, size = [], 0
    if held:
        found = forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)


def components(edges: DataFrame, stash: Stash, label: str = "cc") -> DataFrame:
    """(u, v) -> (node, component): the smallest node that links lead to; nodes without links are left out.

    Alternating large-star and small-star steps: every node's larger neighbours, then its
    smaller ones, are linked to the smallest around it, until each component is a star
    around its minimum.  Both steps are a grouped minimum and a join, so a node of any
    degree is only partial sums and splittable join rows; a round is written out, and a
    component of diameter d takes about log(d) rounds.

    Before the rounds the links of each larger node meet in a task, which keeps a forest of
    what it has: a group that very many links hold together enters with about one a node.
    """
    met = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).hint("rebalance", "u")
    now = stash.put(met.mapInArrow(_forests, "u long, v long").distinct(), f"{label}0")
    before, turn = None, 0
    while (at := _summary(now)) != before:
        before, turn = at, turn + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = down.unionByName(least.withColumnRenamed("m", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = stash.put(small, f"{label}{turn}")
        stash.drop(f"{label}{turn - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
