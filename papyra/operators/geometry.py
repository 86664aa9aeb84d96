"""Boxes on pages: arithmetic, containment and proximity joins, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box by its corners, in any order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def contained_ratio(inner: Column, outer: Column) -> Column:
    return F.when(area(inner) > 0, overlap(inner, outer) / area(inner)).otherwise(0.0)


def valid(b: Column) -> Column:
    return (b["x0"] + b["y0"] + b["x1"] + b["y1"]).isNotNull() & (width(b) >= 0) & (height(b) >= 0)


def side(b: Column, page_width: Column) -> Column:
    """full if wider than 55 % of the page, else the half its centre lies in."""
    return F.when(width(b) > page_width * 0.55, "full").when((b["x0"] + b["x1"]) / 2 < page_width / 2, "left").otherwise("right")


def union_of(b: Column) -> Column:
    """Aggregate: the box around a group's boxes."""
    return F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def assigned(items: DataFrame, blocks: DataFrame, cell: float, least: float = 0.5) -> DataFrame:
    """items (page, item, b) to the block (page, block, bb) that holds their centre and most of them.

    Both sides are dealt into square cells of the page, so it is an equi join with the
    exact test as its residue; a block is listed once for each cell that it touches.
    """
    centre_x, centre_y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    left = items.select("page", "item", "b", centre_x.alias("cx"), centre_y.alias("cy"), F.floor(centre_x / cell).alias("gx"), F.floor(centre_y / cell).alias("gy"))
    steps = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    right = blocks.select("page", "block", "bb", steps("bb.x0", "bb.x1").alias("gx")).select("page", "block", "bb", "gx", steps("bb.y0", "bb.y1").alias("gy"))
    inside = (F.col("cx") >= F.col("bb.x0")) & (F.col("cx") <= F.col("bb.x1")) & (F.col("cy") >= F.col("bb.y0")) & (F.col("cy") <= F.col("bb.y1"))
    hits = left.join(right, ["page", "gx", "gy"]).where(inside).withColumn("ratio", contained_ratio(F.col("b"), F.col("bb"))).where(F.col("ratio") >= least)
    best = Window.partitionBy("page", "item").orderBy(F.col("ratio").desc(), "block")
    return hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("page", "item", "block", "ratio")


def unique_below(captions: DataFrame, tables: DataFrame, gap: float = 20.0, shift: float = 20.0) -> DataFrame:
    """Captions (page, caption, cb) with the one table (page, table, tb) that begins within `gap` under them."""
    band = 2 * (gap + 2)
    left = captions.withColumn("_g", F.explode(F.array(F.floor(F.col("cb.y1") / band), F.floor(F.col("cb.y1") / band) + 1, F.floor(F.col("cb.y1") / band) - 1)))
    right = tables.withColumn("_g", F.floor(F.col("tb.y0") / band))
    down, across = F.col("tb.y0") - F.col("cb.y1"), F.abs(F.col("tb.x0") - F.col("cb.x0"))
    hits = left.join(right, ["page", "_g"]).where((down >= -2) & (down <= gap) & (across < shift))
    alone = F.count("*").over(Window.partitionBy("page", "caption"))
    return hits.withColumn("_n", alone).where("_n = 1").select("page", "caption", "table")
