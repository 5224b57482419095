"""Divide trees as tables: union, compaction and renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.plans.scratch import Scratch


def union_trees(a: DataFrame, b: DataFrame, id_column: str, shift: int, dx: int = 0, dy: int = 0) -> DataFrame:
    """Rows of both trees, those of b with ids and places shifted."""
    return a.unionByName(b.withColumn(id_column, F.col(id_column) + shift).withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy))


def compact(saddles: DataFrame) -> DataFrame:
    """Saddles that separate peaks: basin, false and error saddles go."""
    return saddles.where("type = 'p'")


def numbered(table: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """table plus a column of dense numbers in the given order (rows that agree in it: any order).

    Rows are partitioned by range, so no task sees all of them however the
    values cluster; each range starts after the counts of those before it.
    """
    scratch = Scratch(table.sparkSession, "numbered")
    ranged = scratch.keep(table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").count()
    before = counts.select("_range", F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    n = F.row_number().over(W.partitionBy("_range").orderBy(*order)) + F.col("_before") + (first - 1)
    return ranged.join(F.broadcast(before), "_range").withColumn(name, n).drop("_range", "_before")  # a row a partition


def renumber(table: DataFrame, id_column: str, deleted: DataFrame) -> DataFrame:
    """table without the deleted ids, plus new_id: dense numbers from 1 in order of id."""
    return numbered(table.join(deleted, id_column, "left_anti"), [id_column], "new_id")


def cyclic(edges: DataFrame) -> DataFrame:
    """edges: (node, parent), the parent null at a root.  The nodes from which no root can be reached.

    Every round a node's pointer skips to its target's pointer, so the rounds
    grow with the logarithm of the longest way; one that has not ended after
    as many steps as there are nodes never will.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    now = scratch.keep(edges.select("node", F.col("parent").alias("to")))
    steps, n = 1, now.count()
    while steps <= n:
        jump = now.select(F.col("node").alias("to"), F.col("to").alias("next"))
        # A parent that is no node itself ends the way.
        new = scratch.keep(now.join(jump, "to", "left").select("node", F.col("next").alias("to")))
        scratch.drop(now)
        now, steps = new, steps * 2
        if not now.where("to is not null").limit(1).count():
            break
    return now.where("to is not null").select("node")


def count_by_type(saddles: DataFrame) -> DataFrame:
    return saddles.groupBy("type").agg(F.count("*").alias("n"))
