"""Regions of steepest ascent, flat areas, and the peak graph as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.stencil import steepest
from ridgeline.plans.scratch import Scratch

_HALF = ((1, 0), (0, 1), (1, 1), (-1, 1))


def _key(x, y):
    return (y.cast("long") * (1 << 31) + x).cast("long")


def labels_by_links(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the least node that links reach, by taking neighbours' labels and then labels' labels, until nothing changes."""
    both = scratch.keep(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    now = scratch.keep(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        taken = now.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = now.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        new = scratch.keep(taken.join(jump, "next").select("node", F.least("next", "jumped").alias("label"), (F.least("next", "jumped") < F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        scratch.drop(now)
        now = new
        if not moved:
            return now.select("node", "label")


def flat_components(cells: DataFrame, corners: bool = True) -> DataFrame:
    """cells plus (cx, cy): the first cell, in row order, of each flat area (equal and connected, by eight or four neighbours)."""
    scratch = Scratch(cells.sparkSession, "flat")
    at = cells.select("gx", "gy", "elev")
    steps = _HALF if corners else _HALF[:2]
    sends = at.select("gx", "gy", "elev", F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps))).alias("s"))
    there = sends.select(_key(F.col("gx"), F.col("gy")).alias("u"), (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), "elev")
    links = there.join(at, ["gx", "gy", "elev"]).select("u", _key(F.col("gx"), F.col("gy")).alias("v"))
    nodes = at.select(_key(F.col("gx"), F.col("gy")).alias("node"))
    found = labels_by_links(nodes, links, scratch)
    named = at.withColumn("node", _key(F.col("gx"), F.col("gy"))).join(found, "node")
    return named.select("gx", "gy", "elev", F.pmod("label", F.lit(1 << 31)).cast("int").alias("cx"), F.expr(f"label div {1 << 31}").cast("int").alias("cy"))


def plateau_peaks(cells: DataFrame) -> DataFrame:
    """Peaks: flat areas with no higher cell around, at their first cell in row order."""
    from ridgeline.operators.stencil import with_ring

    lower = with_ring(cells).select("gx", "gy", F.exists("ring", lambda n: F.coalesce(n > F.col("elev"), F.lit(False))).alias("below"))
    areas = flat_components(cells).join(lower, ["gx", "gy"]).groupBy("cx", "cy", "elev").agg(F.max("below").alias("below"))
    return areas.where("not below").select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), "elev")


def thin_plateaus(candidates: DataFrame) -> DataFrame:
    """Of candidate peaks that form one flat area by four neighbours, the first in row order."""
    return flat_components(candidates, corners=False).where("gx = cx and gy = cy").select("gx", "gy", "elev")


def label_regions(cells: DataFrame) -> DataFrame:
    """cells plus (px, py): the top that steepest ascent leads to, by pointer doubling (rounds grow with the logarithm of the longest walk)."""
    scratch = Scratch(cells.sparkSession, "regions")
    start = steepest(cells)
    now = scratch.keep(start.select("gx", "gy", "elev", _key(F.col("gx"), F.col("gy")).alias("node"), _key(F.col("ux"), F.col("uy")).alias("up")))
    while True:
        jump = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        new = scratch.keep(now.join(jump, "up").select("gx", "gy", "elev", "node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        scratch.drop(now)
        now = new
        if not moved:
            return now.select("gx", "gy", "elev", F.pmod("up", F.lit(1 << 31)).cast("int").alias("px"), F.expr(f"up div {1 << 31}").cast("int").alias("py"))


def region_adjacency(regions: DataFrame) -> DataFrame:
    """(p, q, level): the best saddle between each two regions that touch; p < q by row order."""
    at = regions.select("gx", "gy", "elev", _key(F.col("px"), F.col("py")).alias("top"))
    sends = at.select("gx", "gy", F.col("elev").alias("e"), F.col("top").alias("t"), F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _HALF))).alias("s"))
    there = sends.select((F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), "e", "t")
    touch = there.join(at, ["gx", "gy"]).where("t <> top")
    return touch.groupBy(F.least("t", "top").alias("p"), F.greatest("t", "top").alias("q")).agg(F.max(F.least("e", "elev")).alias("level"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Maximum spanning forest of (p, q, level), equal levels by (p, q): Boruvka's rounds.

    Each round every component takes its best outgoing edge; the number of
    components at least halves.
    """
    scratch = Scratch(edges.sparkSession, "forest")
    base = scratch.keep(edges.select("p", "q", "level"))
    nodes = base.select(F.col("p").alias("node")).union(base.select("q")).distinct()
    label = scratch.keep(nodes.select("node", F.col("node").alias("label")))
    chosen: list[DataFrame] = []
    while True:
        a, b = label.select(F.col("node").alias("p"), F.col("label").alias("lp")), label.select(F.col("node").alias("q"), F.col("label").alias("lq"))
        out = scratch.keep(base.join(a, "p").join(b, "q").where("lp <> lq"))
        if not out.limit(1).count():
            break
        order = F.struct((-F.col("level")).alias("w"), F.col("p").alias("p"), F.col("q").alias("q"))
        ends = out.select(F.col("lp").alias("l"), order.alias("o"), "lp", "lq", "level").union(out.select("lq", order, "lp", "lq", "level"))
        best = scratch.keep(ends.groupBy("l").agg(F.min(F.struct("o", "lp", "lq", "level")).alias("m")).select("m.o.p", "m.o.q", "m.level", "m.lp", "m.lq").distinct())
        chosen.append(best.select("p", "q", "level"))
        merged = labels_by_links(label.select(F.col("label").alias("node")).distinct(), best.select(F.col("lp").alias("u"), F.col("lq").alias("v")), scratch)
        label = scratch.keep(label.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label").select("node", F.col("new").alias("label")))
    result = base.limit(0)
    for c in chosen:
        result = result.union(c)
    return result
