"""Operators on cells (gx, gy, elev) that look at neighbouring cells.

A neighbour is found by an equi-join on its coordinates: every cell sends its
elevation to the eight cells around it, and one aggregation by cell gathers
what arrived.  Row neighbours alone use windows along the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (dx, dy) around a cell, clockwise from the north-west, y southward.
RING = ((-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0))


def with_ring(cells: DataFrame) -> DataFrame:
    """cells plus ring: the elevations of the eight neighbours in RING order, null where there is none."""
    sends = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.col("gx") - dx).alias("x"), (F.col("gy") - dy).alias("y")) for i, (dx, dy) in enumerate(RING)), F.struct(F.lit(8).alias("i"), F.col("gx").alias("x"), F.col("gy").alias("y"))))
    sent = cells.select("elev", sends.alias("s")).select("elev", "s.*")
    arrived = sent.groupBy(F.col("x").alias("gx"), F.col("y").alias("gy")).agg(F.max(F.when(F.col("i") == 8, F.col("elev"))).alias("elev"), *(F.max(F.when(F.col("i") == i, F.col("elev"))).alias(f"n{i}") for i in range(8)))
    return arrived.where("elev is not null").select("gx", "gy", "elev", F.array(*(f"n{i}" for i in range(8))).alias("ring"))


def tile_count(cells: DataFrame, size: int) -> DataFrame:
    """One row: the number of tiles that have data."""
    return cells.select(F.floor(F.col("gx") / size), F.floor(F.col("gy") / size)).distinct().agg(F.count("*").alias("n"))


def flip(cells: DataFrame) -> DataFrame:
    """Valleys for peaks: elevations negated."""
    return cells.withColumn("elev", -F.col("elev"))


def scale(cells: DataFrame, factor: float) -> DataFrame:
    return cells.withColumn("elev", F.col("elev") * factor)


def tile_of(size: int) -> tuple[Column, Column]:
    return F.floor(F.col("gx") / size).cast("int").alias("tx"), F.floor(F.col("gy") / size).cast("int").alias("ty")


def tile_maximum(cells: DataFrame, size: int, floor_at_zero: bool = True) -> DataFrame:
    top = F.max("elev")
    return cells.groupBy(*tile_of(size)).agg((F.greatest(top, F.lit(0)) if floor_at_zero else top).alias("max_elev"))


def data_extent(cells: DataFrame, size: int) -> DataFrame:
    """The box of cells with data in each tile."""
    return cells.groupBy(*tile_of(size)).agg(F.min("gx").alias("min_x"), F.min("gy").alias("min_y"), F.max("gx").alias("max_x"), F.max("gy").alias("max_y"), F.count("*").alias("n"))


def despike(cells: DataFrame, rise: float) -> DataFrame:
    """Cells less those that stand more than rise above some 4-neighbour, all judged on the input."""
    at = with_ring(cells)
    low = F.least(*(F.col("ring")[i] for i in (1, 3, 5, 7)))
    return at.where(F.coalesce(F.col("elev") - low <= rise, F.lit(True))).select("gx", "gy", "elev")


def despike_in_order(cells: DataFrame, rise: float, size: int) -> DataFrame:
    """As despike, but in row order within each tile, so that a cell no longer sees spikes removed before it."""
    import numpy as np
    import pandas as pd

    def work(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["gx"].to_numpy() - part["gx"].min(), part["gy"].to_numpy() - part["gy"].min()
        grid = np.full((y.max() + 3, x.max() + 3), np.nan)
        grid[y + 1, x + 1] = part["elev"]
        near = np.fmin(np.fmin(grid[:-2, 1:-1], grid[2:, 1:-1]), np.fmin(grid[1:-1, :-2], grid[1:-1, 2:]))
        # Only cells that rise above the original least neighbour can be spikes in any order.
        for r, c in zip(*np.nonzero(grid[1:-1, 1:-1] - near > rise), strict=True):
            around = [v for v in (grid[r, c + 1], grid[r + 2, c + 1], grid[r + 1, c], grid[r + 1, c + 2]) if not np.isnan(v)]
            if around and grid[r + 1, c + 1] - min(around) > rise:
                grid[r + 1, c + 1] = np.nan
        return part[~np.isnan(grid[y + 1, x + 1])][["gx", "gy", "elev"]]

    typed = cells.select("gx", "gy", F.col("elev").cast("double").alias("elev"))
    return typed.groupBy(*tile_of(size)).applyInPandas(work, "gx int, gy int, elev double")


def copy_edges(cells: DataFrame, size: int) -> DataFrame:
    """(tx, ty, x, y, elev): tiles of size by size whose last row and column are their south and east neighbours' first.

    The corner comes from the east neighbour's first column in its last row's copy, that is, from its own row.
    """
    tx, ty = tile_of(size)
    at = cells.select(tx, ty, F.pmod("gx", F.lit(size)).cast("int").alias("x"), F.pmod("gy", F.lit(size)).cast("int").alias("y"), "elev")
    last = size - 1
    east = at.where("x = 0").select((F.col("tx") - 1).alias("tx"), "ty", F.lit(last).alias("x"), "y", F.col("elev").alias("edge"), F.lit(1).alias("way"))
    south = at.where("y = 0").select("tx", (F.col("ty") - 1).alias("ty"), "x", F.lit(last).alias("y"), F.col("elev").alias("edge"), F.lit(0).alias("way"))
    edges = east.union(south).groupBy("tx", "ty", "x", "y").agg(F.max_by("edge", "way").alias("edge"))
    joined = at.join(edges, ["tx", "ty", "x", "y"], "full")
    return joined.select("tx", "ty", "x", "y", F.coalesce("edge", "elev").alias("elev"))


def append_edges(cells: DataFrame, size: int) -> DataFrame:
    """(tx, ty, x, y, elev): tiles of size + 1, the last row, column and corner from the neighbours."""
    tx, ty = tile_of(size)
    at = cells.select(tx, ty, F.pmod("gx", F.lit(size)).cast("int").alias("x"), F.pmod("gy", F.lit(size)).cast("int").alias("y"), "elev")
    ways = [F.struct("tx", "ty", "x", "y", F.lit(True).alias("on"))]
    for dx, dy in ((1, 0), (0, 1), (1, 1)):
        on = (F.lit(True) if not dx else F.col("x") == 0) & (F.lit(True) if not dy else F.col("y") == 0)
        ways.append(F.struct((F.col("tx") - dx).alias("tx"), (F.col("ty") - dy).alias("ty"), (F.lit(size) if dx else F.col("x")).alias("x"), (F.lit(size) if dy else F.col("y")).alias("y"), on.alias("on")))
    placed = at.select("elev", F.explode(F.filter(F.array(*ways), lambda w: w["on"])).alias("w")).select("w.tx", "w.ty", "w.x", "w.y", "elev")
    own = at.select("tx", "ty").distinct()
    return placed.join(own, ["tx", "ty"], "left_semi")


def candidate_peaks(cells: DataFrame) -> DataFrame:
    """Cells at least as high as all their neighbours."""
    return with_ring(cells).where(~F.exists("ring", lambda n: F.coalesce(n > F.col("elev"), F.lit(False)))).select("gx", "gy", "elev")


def ring_saddles(cells: DataFrame) -> DataFrame:
    """(gx, gy, elev, n_saddles) of cells outside flat areas whose ring has two or more separate higher arcs.

    Arcs are read around the ring; orthogonal neighbours that touch across a
    lower corner are one arc, as higher cells touch by eight neighbours.
    """
    at = with_ring(cells)
    high = [F.coalesce(F.col("ring")[i] > F.col("elev"), F.lit(False)) for i in range(8)]
    # Corners are even, sides odd: two sides next to a corner touch each other.
    closed = [high[i] if i % 2 else (high[i] | (high[i - 1] & high[(i + 1) % 8])) for i in range(8)]
    starts = sum(((closed[i] & ~closed[i - 1]).cast("int") for i in range(8)), F.lit(0))
    flat = F.exists("ring", lambda n: F.coalesce(n == F.col("elev"), F.lit(False)))
    return at.where(~flat).select("gx", "gy", "elev", (starts - 1).alias("n_saddles")).where("n_saddles >= 1")


def steepest(cells: DataFrame) -> DataFrame:
    """cells plus (ux, uy): the highest of the neighbours and the cell itself, ties to the first in row order; itself at a top."""
    best = F.array_max(F.array(*(F.struct(F.col("ring")[i].alias("e"), F.lit(-dy).alias("a"), F.lit(-dx).alias("b")) for i, (dx, dy) in enumerate(RING)), F.struct(F.col("elev").alias("e"), F.lit(0).alias("a"), F.lit(0).alias("b"))))
    return with_ring(cells).withColumn("_best", best).select("gx", "gy", "elev", (F.col("gx") - F.col("_best.b")).alias("ux"), (F.col("gy") - F.col("_best.a")).alias("uy"))


def edge_runoffs(series: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Runoffs along each series: places after which the value first falls, or data ends, after a rise.

    series: keys (an edge), position, value (null: no data).  The value before
    the first counts as equal to it, as a walk that begins there.
    """
    walk = W.partitionBy(*keys).orderBy(position)
    first = F.row_number().over(walk) == 1
    before = F.when(first, F.col(value)).otherwise(F.lag(value).over(walk))
    rise = F.col(value).isNotNull() & (before.isNull() & ~first | (F.col(value) > before))
    fall = before.isNotNull() & (F.col(value).isNull() | (F.col(value) < before)) & ~first
    marked = series.withColumn("_before", before).withColumn("_rise", rise).withColumn("_fall", fall)
    # Rising or flat since the last fall: the last marked step before this one was a rise.
    last = F.last(F.when(F.col("_rise"), True).when(F.col("_fall"), False), ignorenulls=True).over(walk.rowsBetween(W.unboundedPreceding, -1))
    at = marked.withColumn("_was", last).withColumn("_at", F.lag(position).over(walk)).where(F.col("_fall") & F.col("_was"))
    return at.select(*keys, F.col("_at").alias(position), F.col("_before").alias(value))


def splice(runoffs: DataFrame, around: int) -> DataFrame:
    """(a, b, x, y): pairs of runoffs (runoff_id, x, y, tile) at one place, x modulo the samples around the globe.

    At each place, runoffs pair up in order of id: first with second, third
    with fourth.
    """
    place = W.partitionBy("px", "y").orderBy("runoff_id")
    at = runoffs.withColumn("px", F.pmod("x", F.lit(around)) if around else F.col("x")).withColumn("n", F.row_number().over(place)).withColumn("pair", F.floor((F.col("n") - 1) / 2))
    return at.groupBy("px", "y", "pair").agg(F.min("runoff_id").alias("a"), F.max("runoff_id").alias("b"), F.count("*").alias("k")).where("k = 2").select("a", "b", F.col("px").alias("x"), "y")


def filled_quadrants(runoffs: DataFrame, around: int) -> DataFrame:
    """(x, y, quadrants): how much of a spliced place is known; four is all of it."""
    return runoffs.groupBy((F.pmod("x", F.lit(around)) if around else F.col("x")).alias("x"), "y").agg(F.sum("quadrants").alias("quadrants"), F.count("*").alias("n")).where("n > 1").select("x", "y", "quadrants")
