"""Saddles of flat areas: the higher ground around each area falls into segments, and every segment but the highest makes one.

A single cell is a flat area too, so these are all saddles of a raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.regions import flat_components, labels_by_links
from ridgeline.operators.stencil import RING
from ridgeline.plans.scratch import Scratch

_HALF = ((1, 0), (0, 1), (1, 1), (-1, 1))


def _moved(steps) -> Column:
    return F.explode(F.array(*(F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx, dy in steps)))


def boundary_segments(cells: DataFrame) -> DataFrame:
    """(cx, cy, level, gx, gy, elev, segment): the higher cells around each flat area (named by its first cell), and which of them touch.

    A segment is a set of boundary cells of one area that hang together by
    eight neighbours; its name is its first cell.
    """
    scratch = Scratch(cells.sparkSession, "segments")
    flat = scratch.keep(flat_components(cells))
    sent = flat.select("cx", "cy", F.col("elev").alias("level"), _moved(RING).alias("n")).select("cx", "cy", "level", "n.*")
    ground = cells.select("gx", "gy", "elev")
    edge = scratch.keep(sent.join(ground, ["gx", "gy"]).where("elev > level").distinct().select("cx", "cy", "level", "gx", "gy", "elev"))
    name = F.struct("cy", "cx", F.col("gy").alias("y"), F.col("gx").alias("x"))
    there = edge.select("cx", "cy", name.alias("u"), _moved(_HALF).alias("n")).select("cx", "cy", "u", "n.*")
    links = there.join(edge.select("cx", "cy", "gx", "gy", name.alias("v")), ["cx", "cy", "gx", "gy"]).select("u", "v")
    found = labels_by_links(edge.select(name.alias("node")), links, scratch)
    return edge.withColumn("node", name).join(found, "node").select("cx", "cy", "level", "gx", "gy", "elev", F.struct(F.col("label.y").alias("y"), F.col("label.x").alias("x")).alias("segment"))


def ring_place(dx: Column, dy: Column) -> Column:
    """Place of an offset on its square ring, clockwise from the top left corner."""
    r = F.greatest(F.abs(dx), F.abs(dy))
    return F.when(dy == -r, dx + r).when(dx == r, 3 * r + dy).when(dy == r, 5 * r - dx).otherwise(7 * r - dy)


def closest_labelled(points: DataFrame, labelled: DataFrame, reach: int) -> DataFrame:
    """points (x, y, label, others) plus (gx, gy): the closest cell of labelled (gx, gy, label) with the point's label.

    Closest is the smallest square ring around the point, then the first place
    on it (``ring_place``).  Rings are looked through in bands of doubling
    width, and points stop at the first band with a hit, so the work goes with
    the square of what each has to go; null beyond reach.
    """
    scratch = Scratch(points.sparkSession, "closest")
    own = points.columns
    left = scratch.keep(points.withColumn("_n", F.monotonically_increasing_id()))
    done, low = None, 0
    while low <= reach:
        high = max(low, 2 * low - 1)
        span = F.sequence(F.lit(-high), F.lit(high))
        offsets = F.flatten(F.transform(span, lambda y: F.transform(span, lambda x: F.struct(x.alias("dx"), y.alias("dy")))))
        band = F.filter(offsets, lambda o: F.greatest(F.abs(o["dx"]), F.abs(o["dy"])) >= low) if low else offsets
        tried = left.select("_n", "x", "y", "label", F.explode(band).alias("o")).select("_n", "label", (F.col("x") + F.col("o.dx")).alias("gx"), (F.col("y") + F.col("o.dy")).alias("gy"), "o.dx", "o.dy")
        rank = F.struct(F.greatest(F.abs("dx"), F.abs("dy")).alias("r"), ring_place(F.col("dx"), F.col("dy")).alias("i"))
        hit = scratch.keep(tried.join(labelled.select("gx", "gy", "label"), ["gx", "gy", "label"]).groupBy("_n").agg(F.min_by(F.struct("gx", "gy"), rank).alias("at")).select("_n", "at.gx", "at.gy"))
        found = left.join(hit, "_n").select(*own, "gx", "gy")
        done = found if done is None else done.union(found)
        left = scratch.keep(left.join(hit.select("_n"), "_n", "left_anti"))
        if not left.limit(1).count():
            return done
        low = high + 1
    return done.union(left.select(*own, F.lit(None).cast("int"), F.lit(None).cast("int")))


def flat_saddles(cells: DataFrame) -> DataFrame:
    """(gx, gy, elev, high_x, high_y, top_x, top_y, cx, cy): one saddle for each segment of higher ground but the highest, by flat area.

    It separates the segment's highest cell from the highest of all segments
    (the first in row order, of equals), and lies on the cell of the area
    (named by its first cell) that is closest to the middle between the two.
    """
    scratch = Scratch(cells.sparkSession, "flat-saddles")
    row_order = lambda: F.struct("elev", (-F.col("gy")).alias("y"), (-F.col("gx")).alias("x"))
    tops = boundary_segments(cells).groupBy("cx", "cy", "level", "segment").agg(F.max(row_order()).alias("high"))
    tops = scratch.keep(tops)
    first = tops.groupBy("cx", "cy").agg(F.max("high").alias("top"), F.count("*").alias("n")).where("n > 1")
    pairs = tops.join(first, ["cx", "cy"]).where("high <> top")
    at = pairs.select("cx", "cy", F.col("level").alias("elev"), (-F.col("high.x")).alias("high_x"), (-F.col("high.y")).alias("high_y"), (-F.col("top.x")).alias("top_x"), (-F.col("top.y")).alias("top_y"))
    middle = at.withColumns({"x": F.floor((F.col("high_x") + F.col("top_x")) / 2).cast("int"), "y": F.floor((F.col("high_y") + F.col("top_y")) / 2).cast("int"), "label": F.struct("cx", "cy")})
    area = flat_components(cells).join(first.select("cx", "cy"), ["cx", "cy"], "left_semi").select("gx", "gy", F.struct("cx", "cy").alias("label"))
    size = cells.agg(F.max("gx") - F.min("gx"), F.max("gy") - F.min("gy")).first()
    found = closest_labelled(middle, area, max(size[0] or 0, size[1] or 0))
    return found.select("gx", "gy", "elev", "high_x", "high_y", "top_x", "top_y", "cx", "cy")
