"""Exact top-k by vector-approximation files.

Candidates lie in blocks, and each block is a vector-approximation file of its own: every
dimension is cut into at most 256 cells at the quantiles of the block's values, and a vector
is stored as the numbers of its cells.  A cell's edges are the least and the greatest value
in it, so an outlier widens one cell of one block and nothing else.  A scan over the cells
bounds each score from both sides; a query keeps the candidates whose upper bound reaches
its k-th largest lower bound.  Only their exact vectors are read, in the order of their
bounds, until the k-th score found is above every bound that is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, buckets, shuffle_partitions, table

CELLS = 256
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 16384
#: Scores that a scan holds at a time, and survivors of a query that one task refines.
SCAN_SCORES, REFINED_ROWS = 1 << 21, 512
LONG = (1 << 63) - 1


def finite_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, embedding) -> (rid, vec_id, d, embedding): rows with an id and nothing but components that are finite, scaled too."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * float(scale)) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), F.size("embedding").alias("d"), "embedding")


def _whole(column, scale: int) -> np.ndarray:
    """floor(scale * x) of the rows of a list column, all of one length: whole numbers as doubles, so of any size."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(flat), -1)


def _cells(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of every component, least and greatest value of every cell) by dimension."""
    n, d = m.shape
    low, high, cells = np.zeros((CELLS, d)), np.zeros((CELLS, d)), np.zeros((n, d), np.uint8)
    for j in range(d):
        s = np.sort(m[:, j])
        cuts = np.unique(s[np.arange(1, CELLS) * n // CELLS])
        cells[:, j] = np.searchsorted(cuts, m[:, j], "right")
        at = np.concatenate(([0], np.searchsorted(s, cuts, "left"), [n]))
        full = np.flatnonzero(at[1:] > at[:-1])
        low[full, j], high[full, j] = s[at[full]], s[at[full + 1] - 1]
    return cells, low, high


FILE = "block int, d int, ids binary, rids binary, cells binary, low binary, high binary"


def approximations(candidates: DataFrame, blocks: int, scale: int) -> DataFrame:
    """(rid, vec_id, d, embedding) -> a row a block and dimension: its vector-approximation file."""
    schema = pa.schema([("block", pa.int32()), ("d", pa.int32()), *((x, pa.binary()) for x in ("ids", "rids", "cells", "low", "high"))])

    def build(t: pa.Table) -> pa.Table:
        cells, low, high = _cells(_whole(t.column("embedding"), scale))
        row = {"block": t.column("block")[0].as_py(), "d": t.column("d")[0].as_py(), "ids": t.column("vec_id").to_numpy().tobytes(), "rids": t.column("rid").to_numpy().tobytes(), "cells": cells.tobytes(), "low": low.tobytes(), "high": high.tobytes()}
        return pa.Table.from_pylist([row], schema)

    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    return candidates.select("rid", "vec_id", "d", "embedding", block.alias("block")).groupBy("block", "d").applyInArrow(build, FILE)


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of rows of q with the vectors of the cells; rounding is on the safe side."""
    every = np.arange(cells.shape[1])
    a, b = low[cells, every], high[cells, every]
    slack = np.maximum(np.abs(a), np.abs(b)) * ((cells.shape[1] + 4) * 2.0**-50)
    middle, half = q @ ((a + b) / 2).T, np.abs(q) @ ((b - a) / 2 + slack).T
    return middle - half, middle + half


def survivors(files: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """Files and queries, both with (block, query_block, d) -> (qid, query_id, rid, below, above): a tile's candidates by its own bounds."""
    kinds = {"qid": pa.int64(), "rid": pa.int64(), "below": pa.float64(), "above": pa.float64()}

    def scan(c: pa.Table, q: pa.Table) -> pa.Table:
        if not len(c) or not len(q):
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        one = {x: c.column(x)[0].as_py() for x in ("d", "ids", "rids", "cells", "low", "high")}
        ids, rids = (np.frombuffer(one[x], np.int64) for x in ("ids", "rids"))
        cells = np.frombuffer(one["cells"], np.uint8).reshape(len(ids), one["d"])
        low, high = (np.frombuffer(one[x], np.float64).reshape(CELLS, one["d"]) for x in ("low", "high"))
        qids, query_ids, vectors = q.column("rid").to_numpy(), q.column("vec_id").to_numpy(), _whole(q.column("embedding"), scale)
        step, out = max(1, SCAN_SCORES // len(ids)), []
        for a in range(0, len(qids), step):
            part = slice(a, a + step)
            below, above = bounds(vectors[part], cells, low, high)
            own = query_ids[part][:, None] == ids[None, :]
            below[own] = above[own] = -np.inf
            n = min(k, below.shape[1])
            kth = np.partition(below, below.shape[1] - n, axis=1)[:, below.shape[1] - n]
            i, j = np.nonzero((above >= kth[:, None]) & ~own)
            out.append((qids[part][i], rids[j], below[i, j], above[i, j]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], list(kinds))

    return files.groupBy("block", "query_block", "d").cogroup(queries.groupBy("block", "query_block", "d")).applyInArrow(scan, "qid long, rid long, below double, above double")


def _scores(q: np.ndarray, m: np.ndarray):
    """Inner products of whole numbers, exactly: as 64-bit numbers where these suffice, else as Python's."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, len(q))
    if top < 2.0**62:
        return (m.astype(np.int64) @ q.astype(np.int64)).tolist()
    whole = [int(x) for x in q]
    return [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in m]


def refined(found: DataFrame, k: int, scale: int) -> DataFrame:
    """(qid, query_id, vec_id, above, q, e, part) -> (qid, query_id, vec_id, score, beyond): each part's k best, read in the order of bounds.

    Scores beyond a long's range are its ends; beyond puts these in order (else it is empty).
    """
    kinds = {"qid": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "beyond": pa.binary()}

    def ends(score: int) -> tuple[int, bytes]:
        if -LONG - 1 < score < LONG:
            return score, b""
        return max(-LONG - 1, min(LONG, score)), (score + (1 << 2111)).to_bytes(264, "big")

    def refine(t: pa.Table) -> pa.Table:
        t = t.sort_by([("above", "descending"), ("vec_id", "ascending")])
        q, ids, above = _whole(t.column("q").slice(0, 1), scale)[0], t.column("vec_id").to_numpy(), t.column("above").to_numpy()
        best: list[tuple[int, int]] = []
        for a in range(0, len(t), 64):  # some at a time
            if len(best) == k and -best[-1][0] > above[a]:
                break  # no bound that is left reaches the k-th score
            got = _scores(q, _whole(t.column("e").slice(a, 64), scale))
            best = sorted(best + [(-s, int(i)) for s, i in zip(got, ids[a : a + 64], strict=True)])[:k]
        head = [t.column(x)[0].as_py() for x in ("qid", "query_id")]
        rows = [(*head, i, *ends(-s)) for s, i in best]
        return pa.table([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds.values())], list(kinds))

    return found.groupBy("qid", "part").applyInArrow(refine, "qid long, query_id long, vec_id long, score long, beyond binary")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """The k largest inner products of each query's integer vector with all others: query_id, rank, vec_id, score.

    is_query: a Column over vec_id.  Ties go to the smaller vec_id; a query has fewer rows
    if there are fewer candidates of its dimension.  Rows without vec_id, without vector or
    with a component that is null or not finite take no part; extra columns are left out.
    Rows that repeat a vec_id are candidates each and queries each; none is a candidate of a
    query of its own vec_id.  Finite components of any size are exact; a score beyond a long
    is told as the nearest one.  Of equal vectors only the k + 1 smallest ids can matter to
    any query (2 k + 1 rows, where ids repeat), so no more enter the scan, however often a
    vector recurs.  Queries and candidates meet in blocks.
    """
    spark = vectors.sparkSession
    stash = Stash(spark, "vectors")
    exact = stash.put(finite_vectors(vectors, scale), "exact")
    repeats = exact.groupBy("vec_id").count().where("count > 1").limit(1).count()
    queries = exact.where(is_query)
    alike = exact
    if repeats:  # a query must find k rows of other ids, so no id may fill the places
        alike = exact.withColumn("r", F.row_number().over(Window.partitionBy("embedding", "vec_id").orderBy("rid"))).where(F.col("r") <= k).drop("r")
    order = F.rank() if repeats else F.row_number()
    few = alike.withColumn("r", order.over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= (k + k if repeats else k) + 1).drop("r")
    rows, asked = exact.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks = max(-(-rows // CANDIDATE_BLOCK), min(shuffle_partitions(spark), max(1, rows // 1024)))
    query_blocks = max(1, -(-asked // QUERY_BLOCK))
    files = stash.put(approximations(few, blocks, scale), "approximations")
    tiles = files.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    spread = queries.withColumn("query_block", F.pmod(F.xxhash64("rid"), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = stash.put(survivors(tiles, spread, k, scale), "survivors")
    best = Window.partitionBy("qid").orderBy(F.col("below").desc())
    kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("qid").agg(F.when(F.count("*") == k, F.min("below")).alias("kth"))
    left = found.join(kth, "qid").where(F.col("kth").isNull() | (F.col("above") >= F.col("kth")))
    parts = left.groupBy("qid").agg(F.ceil(F.count("*") / REFINED_ROWS).cast("int").alias("parts"))
    left = left.join(parts, "qid").select("qid", "rid", "above", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"))
    read = left.join(exact.select("rid", "vec_id", F.col("embedding").alias("e")), "rid").join(queries.select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "qid")
    scored = refined(read.select("qid", "query_id", "vec_id", "above", "q", "e", "part").repartition(buckets(spark), "qid", "part"), k, scale)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
