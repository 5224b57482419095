"""Connected components of a link table, by alternating large and small stars.

Each round rewires every link towards the smallest neighbour of its ends; the
number of rounds grows with the logarithm of the largest component.  A round
is two joins and two pre-aggregated minima; both sides of each join are read
from shared storage through an exchange, so a hub's rows can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.scratch import Scratch


def _star(scratch: Scratch, links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with v < u."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = scratch.keep(moved.where("u <> v").distinct())
    scratch.drop(least)
    return out


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: (u, v) longs, in any order, with repeats.  Returns (node, component), the component being its smallest node."""
    now = scratch.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            break
        state = tuple(found)
        wide = _star(scratch, now, True)
        scratch.drop(now)
        now = _star(scratch, wide, False)
        scratch.drop(wide)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
