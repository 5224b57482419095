"""Divide trees as tables: made from tiles, spliced, merged, pruned and measured.

A tree is three tables keyed by cells of one global grid (a peak's key is its
row order, ``gy * 2**31 + gx``), so trees are united without renumbering:

* ``peaks``: peak, elev
* ``edges``: p, q, level, sx, sy; a forest, each edge a saddle between two peaks
* ``runoffs``: x, y, elev, quadrants, inside_peak, peak; places on a tile's
  border where land goes on beyond it, with the peak that the ascent from there
  leads to

Tiles overlap by their last row and column.  Whatever leaves a tile passes a
border cell, and from there climbs along the border, which both tiles hold, to
a runoff: joining the peaks of runoffs that lie on one place, at that height,
restores every connection.  So a summary of this size replaces the raster when
a new tile is added.

The forest is kept maximal by Boruvka's rounds over edge tables, all seams at
once; edges that close a cycle are its lowest, the basins.  Peaks that a seam
made (an edge as high as the peak itself) are contracted away after that.

Order among edges is (level, first place in row order, peaks); among peaks the
higher, then the later key wins, but of two that an edge of their own height
joins the first cell stands for the plateau.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators.prominence import adjacency, label
from ridgeline.operators.regions import labels_by_links
from ridgeline.operators.stencil import append_edges
from ridgeline.operators.tree import compact, numbered
from ridgeline.plans.scratch import Scratch

_ROW = 1 << 31
_PIECES = "kind string, tx int, ty int, a long, b long, level double, x int, y int, quadrants int, inside_peak int"
_PIECE_COLUMNS = [c.split()[0] for c in _PIECES.split(", ")]
#: Quadrants around a cell; a runoff that has seen all of them is done.
ALL_QUADRANTS = 4
#: Rounds over tables shrink them; from so many rows on (counted) one task does what is left of a step, with the same result.
FINISH = 1 << 18


@dataclass(frozen=True)
class Tree:
    peaks: DataFrame
    edges: DataFrame
    runoffs: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.peaks.sparkSession

    def keep(self, scratch: Scratch) -> Tree:
        return Tree(scratch.keep(self.peaks), scratch.keep(self.edges), scratch.keep(self.runoffs))


def key_of(x: Column, y: Column) -> Column:
    return (y.cast("long") * _ROW + x).cast("long")


def place_of(key: str, x: str = "gx", y: str = "gy") -> tuple[Column, Column]:
    return F.pmod(key, F.lit(_ROW)).cast("int").alias(x), F.expr(f"{key} div {_ROW}").cast("int").alias(y)


# --- one tile ------------------------------------------------------------------


def border_runoffs(grid: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, column, quadrants) of a tile's runoffs.

    Each side is walked eastward or southward, as its neighbour walks it: the
    last cell of a rise is one, where the ground then falls or data ends.
    Corners with data always are, with one quadrant seen of four; others two.
    """
    h, w = grid.shape
    sides = [[(0, x) for x in range(w)], [(y, w - 1) for y in range(h)], [(y, 0) for y in range(h)], [(h - 1, x) for x in range(w)]]
    found: dict[tuple[int, int], int] = {(y, x): 1 for y in (0, h - 1) for x in (0, w - 1) if not np.isnan(grid[y, x])}
    for side in sides:
        rising, before = False, grid[side[0]]
        for last, here in zip(side, side[1:], strict=False):
            now = grid[here]
            if not np.isnan(now) and (np.isnan(before) or now > before):
                rising = True
            elif rising and (np.isnan(now) or now < before):
                found.setdefault(last, 2)
                rising = False
            before = now
    return [(y, x, q) for (y, x), q in sorted(found.items())]


def summits(grid: np.ndarray, top: np.ndarray, edges: list[tuple]) -> dict[int, tuple[int, bool]]:
    """Of each top: its flat area (by one of its tops), and whether no edge of its own height leads from that to higher ground."""
    flat = grid.ravel()
    group = {int(t): int(t) for t in np.unique(top[top >= 0])}

    def root(t):
        while group[t] != t:
            group[t] = group[group[t]]
            t = group[t]
        return t

    for level, a, b, *_ in edges:
        if flat[a] == level == flat[b]:
            group[root(a)] = root(b)
    beaten = {root(a if flat[a] == level else b) for level, a, b, *_ in edges if (flat[a] == level) != (flat[b] == level)}
    return {t: (root(t), root(t) not in beaten) for t in group}


class Islands:
    """Islands that grow and meet as the level falls: the top of each, and the level down to which it reaches a runoff."""

    def __init__(self, tops: dict[int, float], opened: dict[int, float]):
        self.elev, self.parent, self.best = tops, {t: t for t in tops}, {t: t for t in tops}
        self.open = dict.fromkeys(tops, -np.inf) | opened

    def root(self, t: int) -> int:
        while self.parent[t] != t:
            self.parent[t] = self.parent[self.parent[t]]
            t = self.parent[t]
        return t

    def meet(self, level: float, a: int, b: int) -> float | None:
        """The saddle's prominence when two islands meet there (infinite if neither is closed); None if they already had."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return None
        over = [np.inf if self.open[i] >= level else self.elev[self.best[i]] for i in (a, b)]
        ta, tb = self.best[a], self.best[b]
        plateau = self.elev[ta] == level == self.elev[tb]
        if not (ta < tb if plateau else (self.elev[ta], ta) > (self.elev[tb], tb)):
            a, b = b, a
        self.parent[b] = a
        self.open[a] = max(self.open[a], self.open[b])
        return min(over) - level


def _tile(size: int, around: int, minimum: float):
    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tx, ty = (int(k) for k in key)
        grid = np.full((size + 1, size + 1), np.nan)
        grid[part["y"], part["x"]] = part["elev"]
        h, w = (size + 1 if (part[c] == size).any() else size for c in ("y", "x"))
        grid = grid[:h, :w]
        top = label(grid)
        low, high, level, cell = adjacency(grid, top)
        name = lambda i: (int(i) // w + ty * size) * _ROW + ((int(i) % w + tx * size) % around if around else int(i) % w + tx * size)
        edges = sorted(zip(level.tolist(), low.tolist(), high.tolist(), cell.tolist(), strict=True), key=lambda e: (-e[0], e[3], e[1], e[2]))
        area = summits(grid, top, edges)
        runoffs = [(y, x, float(grid[y, x]), q, int(top[y * w + x])) for y, x, q in border_runoffs(grid)]
        flat = grid.ravel()
        inside = [int(area[t][1] and flat[t] == e) for y, x, e, q, t in runoffs]
        opened: dict[int, float] = {}
        for _, _, e, _, t in runoffs:
            opened[t] = max(e, opened.get(t, -np.inf))
        tops = {t: float(flat[t]) for t in area}
        islands, kept = Islands(tops, opened), Islands(tops, {})
        left = []
        for e, a, b, c in edges:
            height = islands.meet(e, a, b)
            if height is not None and (height <= 0 or height < minimum):
                kept.meet(e, a, b)
            elif height is not None:
                left.append((e, a, b, c))
        stands = lambda t: kept.best[kept.root(t)]
        moved = [area[stands(t)][0] != area[t][0] for *_, t in runoffs]
        rows = [("P", tx, ty, name(t), None, tops[t], None, None, None, None) for t in tops if stands(t) == t]
        rows += [("E", tx, ty, *sorted((name(stands(a)), name(stands(b)))), e, name(c) % _ROW, name(c) // _ROW, None, None) for e, a, b, c in left]
        rows += [("R", tx, ty, name(stands(t)), None, e, name(y * w + x) % _ROW, name(y * w + x) // _ROW, q, 0 if gone else i) for (y, x, e, q, t), i, gone in zip(runoffs, inside, moved, strict=True)]
        return pd.DataFrame(rows, columns=_PIECE_COLUMNS).astype({c: "Int64" for c in ("a", "b", "x", "y", "quadrants", "inside_peak")})

    return work


def tile_trees(cells: DataFrame, size: int, around: int = 0, minimum: float = 0.0) -> DataFrame:
    """Pieces of the trees of all tiles of cells (gx, gy, elev), as rows (kind, tx, ty, ...): P peaks, E edges, R runoffs.

    A tile is cells of size by size and the first row and column of its
    southern and eastern neighbours; with around, so many samples lie around
    the globe and the last column's neighbour is the first.  A tile of 512
    takes some ten megabytes in a task.  With a minimum, what can't be part of
    a peak or saddle of so much prominence, wherever else the land goes on, is
    contracted before it leaves the task.
    """
    typed = cells.select("gx", "gy", F.col("elev").cast("double").alias("elev")).where("elev is not null and not isnan(elev)")
    placed = append_edges(typed, size)
    if around:
        if around % size:
            raise ValueError(f"{around} samples around the globe are no multiple of {size}")
        last = around // size - 1
        first = placed.where("tx = 0 and x = 0")
        wrapped = first.withColumn("tx", F.lit(last)).withColumn("x", F.lit(size))
        own = placed.select("tx", "ty").where(F.col("tx") == last).distinct()
        placed = placed.unionByName(wrapped.join(own, ["tx", "ty"], "left_semi"))
    return placed.groupBy("tx", "ty").applyInPandas(_tile(size, around, minimum), _PIECES)


def tree_of(pieces: DataFrame) -> Tree:
    """Pieces as one tree, not yet spliced: a peak that two tiles hold is one, so edges may close cycles."""
    peaks = pieces.where("kind = 'P'").select(F.col("a").alias("peak"), F.col("level").alias("elev"))
    edges = pieces.where("kind = 'E'").select(F.col("a").alias("p"), F.col("b").alias("q"), "level", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return Tree(peaks, edges, pieces.where("kind = 'R'").select("x", "y", F.col("level").alias("elev"), "quadrants", "inside_peak", F.col("a").alias("peak")))


# --- forest --------------------------------------------------------------------


def small(table: DataFrame) -> bool:
    """Whether one task can hold a kept table's rows."""
    return table.count() <= FINISH


def in_one_task(table: DataFrame, work, schema: str) -> DataFrame:
    """work, from a pandas frame to one, on all rows of a small table."""

    columns = table.columns

    def whole(parts):
        found = list(parts)
        yield work(pd.concat(found) if found else pd.DataFrame(columns=columns))

    return table.coalesce(1).mapInPandas(whole, schema)


class Sets:
    """Disjoint sets, each named by one of its members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, a: int) -> int:
        while (up := self.parent.get(a, a)) != a:
            self.parent[a] = a = self.parent.get(up, up)
        return a

    def join(self, a: int, b: int) -> bool:
        """Whether they had been apart."""
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def _rank(order: str = "level") -> Column:
    """Sorts best first: highest, then first in row order."""
    return F.struct((-F.col(order)).alias("w"), F.col("sy").alias("y"), F.col("sx").alias("x"), F.col("p").alias("p"), F.col("q").alias("q"))


def roots_of(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of a kept table of pointers (node, to) without cycles; what is no node itself is a root.

    Rounds grow with the logarithm of the longest way.
    """
    if small(pointers):
        return in_one_task(pointers.select("node", "to"), _follow, "node long, root long")
    now = scratch.keep(pointers.select("node", F.col("to").alias("root")))
    while True:
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(now.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = new
        if not now.where("moved").limit(1).count():
            return now.select("node", "root")


def _follow(pointers: pd.DataFrame) -> pd.DataFrame:
    to = dict(zip(pointers["node"].tolist(), pointers["to"].tolist(), strict=True))
    for node in to:
        way = [node]
        while way[-1] in to:
            way.append(to[way[-1]])
        to.update(dict.fromkeys(way[:-1], way[-1]))
    return pd.DataFrame({"node": list(to), "root": list(to.values())}, dtype="int64")


def _best_first(edges: pd.DataFrame) -> pd.DataFrame:
    return edges.assign(w=-edges["level"].astype(float)).sort_values(["w", "sy", "sx", "p", "q"])


def _kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    """Of edges between components cp and cq, those that join two."""
    sets, best = Sets(), _best_first(edges)
    joins = [sets.join(a, b) for a, b in zip(best["cp"].tolist(), best["cq"].tolist(), strict=True)]
    return best[np.array(joins, bool)][["p", "q", "level", "sx", "sy"]]


def forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The maximum spanning forest of edges (p, q, level, sx, sy).

    Each round every component takes its best edge out, follows it to the
    component that it meets, and edges within a component go, as do all but
    the best between two; so the table shrinks as the components do.
    """
    columns = ["p", "q", "level", "sx", "sy"]
    left = scratch.keep(edges.where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "level", "sx", "sy").withColumns({"cp": F.col("p"), "cq": F.col("q")}))
    chosen = edges.limit(0).select(*columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema)
    while not small(left):
        both = F.explode(F.array(F.struct(F.col("cp").alias("c"), F.col("cq").alias("to")), F.struct(F.col("cq").alias("c"), F.col("cp").alias("to")))).alias("e")
        best = scratch.keep(left.select("*", both).select("e.c", F.struct(_rank().alias("r"), F.col("e.to").alias("to"), *columns).alias("b")).groupBy("c").agg(F.min("b").alias("b")))
        chosen = chosen.union(best.select(*(F.col(f"b.{c}").alias(c) for c in columns)).distinct())
        # Ways along best edges climb, but for the pair that chose one edge: there the smaller is the root.
        other = best.select(F.col("c").alias("to"), F.col("b.to").alias("back"))
        pointers = scratch.keep(best.select(F.col("c").alias("node"), F.col("b.to").alias("to")).join(other, "to", "left").where("not (coalesce(back, -1) = node and node < to)").select("node", "to"))
        roots = roots_of(pointers, scratch)
        at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = left.join(at("cp"), "cp", "left").join(at("cq"), "cq", "left").select(*columns, F.coalesce("cp_root", "cp").alias("a"), F.coalesce("cq_root", "cq").alias("b")).where("a <> b")
        parallel = moved.groupBy(F.least("a", "b").alias("cp"), F.greatest("a", "b").alias("cq")).agg(F.min(F.struct(_rank().alias("r"), *columns)).alias("m"))
        new = scratch.keep(parallel.select(*(F.col(f"m.{c}").alias(c) for c in columns), "cp", "cq"))
        scratch.drop(left)
        left = new
    return chosen.union(in_one_task(left, _kruskal, kinds))


def update_forest(tree_edges: DataFrame, added: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The forest after edges are added to it, and the basins: what was the lowest of a cycle, among the old edges or the new."""
    both = tree_edges.union(added.select(*tree_edges.columns))
    kept = scratch.keep(forest(both, scratch))
    return kept, both.where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "level", "sx", "sy").exceptAll(kept)


# --- seams ---------------------------------------------------------------------


def splice_edges(runoffs: DataFrame) -> DataFrame:
    """Edges between the peaks of runoffs on one place, each to the place's first peak, at the place's height."""
    first = runoffs.groupBy("x", "y").agg(F.min("peak").alias("first"))
    return runoffs.join(first, ["x", "y"]).where("peak <> first").select(F.col("first").alias("p"), F.col("peak").alias("q"), F.col("elev").alias("level"), F.col("x").alias("sx"), F.col("y").alias("sy")).distinct()


def splice_runoffs(runoffs: DataFrame) -> DataFrame:
    """One runoff a place, with the quadrants of all; those that have seen all quadrants are done and go.  It lies in a peak's area if all did."""
    one = runoffs.groupBy("x", "y").agg(F.max("elev").alias("elev"), F.sum("quadrants").cast("int").alias("quadrants"), F.min("inside_peak").alias("inside_peak"), F.min("peak").alias("peak"))
    return one.where(F.col("quadrants") < ALL_QUADRANTS)


def _relabel(tree: Tree, stands: DataFrame, edges: DataFrame | None = None) -> Tree:
    """The tree with peaks replaced by those that stand for them (node, root); edges within one go."""
    stands = stands.where("node <> root")
    at = lambda c: stands.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    moved = (tree.edges if edges is None else edges).join(at("p"), "p", "left").join(at("q"), "q", "left")
    moved = moved.select(F.coalesce("p_root", "p").alias("a"), F.coalesce("q_root", "q").alias("b"), "level", "sx", "sy").where("a <> b")
    runoffs = tree.runoffs.join(at("peak"), "peak", "left")
    inside = F.when(F.col("peak_root").isNull(), F.col("inside_peak")).otherwise(F.lit(0)).cast("int")
    return Tree(
        tree.peaks.join(stands.select(F.col("node").alias("peak")), "peak", "left_anti"),
        moved.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "level", "sx", "sy"),
        runoffs.select("x", "y", "elev", "quadrants", inside.alias("inside_peak"), F.coalesce("peak_root", "peak").alias("peak")),
    )


def drop_false_peaks(tree: Tree, scratch: Scratch) -> Tree:
    """Contracts every peak with an edge of its own height into the best peak that such an edge leads to: seams made it, or it is a plateau's later cell."""
    while True:
        at = lambda c: tree.peaks.select(F.col("peak").alias(c), F.col("elev").alias(f"{c}_elev"))
        flat = tree.edges.join(at("p"), "p").join(at("q"), "q").where("level = p_elev or level = q_elev")
        # Equal tops: the first cell stays.  p < q always.
        down = F.when(F.col("p_elev") >= F.col("q_elev"), F.struct(F.col("q").alias("node"), F.col("p_elev").alias("e"), F.col("p").alias("to"))).otherwise(F.struct(F.col("p").alias("node"), F.col("q_elev").alias("e"), F.col("q").alias("to")))
        pointers = scratch.keep(flat.select(down.alias("d")).groupBy("d.node").agg(F.max_by("d.to", F.struct(F.col("d.e"), -F.col("d.to"))).alias("to")))
        if not pointers.limit(1).count():
            return tree
        tree = _relabel(tree, roots_of(pointers, scratch)).keep(scratch)


def unite(*trees: Tree) -> Tree:
    """All rows of the trees, not yet spliced."""
    first, *others = trees
    for other in others:
        first = Tree(first.peaks.unionByName(other.peaks), first.edges.unionByName(other.edges), first.runoffs.unionByName(other.runoffs))
    return first


def merge(*trees: Tree, around: int = 0, basins: list | None = None) -> Tree:
    """One tree of several (of one is fine): all seams at once.

    With around, places so many samples apart are one.  A list given as basins
    takes a table of the edges that were dropped.
    """
    all_ = unite(*trees)
    scratch = Scratch(all_.spark, "merge")
    if around:
        turn = lambda key: key_of(F.pmod(F.pmod(key, F.lit(_ROW)), F.lit(around)), F.expr(f"{key} div {_ROW}")).alias(key)
        wrap = lambda x: F.pmod(x, F.lit(around)).cast("int").alias(x)
        all_ = Tree(all_.peaks.select(turn("peak"), "elev"), all_.edges.select(turn("p"), turn("q"), "level", wrap("sx"), "sy"), all_.runoffs.select(wrap("x"), "y", "elev", "quadrants", "inside_peak", turn("peak")))
    all_ = replace(all_, runoffs=scratch.keep(all_.runoffs))
    # A cell that is a peak in two tiles is one peak.
    peaks = scratch.keep(all_.peaks.groupBy("peak").agg(F.max("elev").alias("elev")))
    edges, dropped = update_forest(all_.edges, splice_edges(all_.runoffs), scratch)
    if basins is not None:
        basins.append(dropped)
    return drop_false_peaks(Tree(peaks, edges, scratch.keep(splice_runoffs(all_.runoffs))), scratch)


def build_tree(cells: DataFrame, size: int, around: int = 0, minimum: float = 0.0) -> Tree:
    """The divide tree of a whole raster, by way of its tiles'."""
    return merge(tree_of(Scratch(cells.sparkSession, "tiles").keep(tile_trees(cells, size, around, minimum))), around=around)


# --- prominence of peaks and saddles ---------------------------------------------


def eliminate(tree: Tree, scratch: Scratch) -> DataFrame:
    """Islands met from high to low, in rounds over tables.

    Returns (p, q, level, sx, sy, prominence, dies) of all edges: the saddle's
    prominence is the height over it of the lower of the two islands that meet
    there, null (unlimited) if both reach a runoff at that level or above, so
    that their tops may lie beyond; ``dies`` is that island's
    top (which may live on if a runoff's side proves the lower).

    A peak's island at the level of its highest edge is itself.  If that edge
    leads to a peak that is higher (or can't be closed), its saddle is settled,
    and the peak's other edges are all lower, so they may as well start from
    the neighbour, whose own state needs no change.  All such peaks go in one
    round.  What stays has a lower neighbour over its best edge, which goes
    first; rounds are as many as the longest ridge on which tops fall while
    the saddles between them rise.
    """
    opened = tree.runoffs.groupBy(F.col("peak").alias("node")).agg(F.max("elev").alias("open"))
    nodes = scratch.keep(tree.peaks.select(F.col("peak").alias("node"), F.col("elev").alias("top")).join(opened, "node", "left").select("node", "top", F.coalesce("open", F.lit(float("-inf"))).alias("open")))
    edges = scratch.keep(tree.edges.select("p", "q", "level", "sx", "sy", F.col("p").alias("a"), F.col("q").alias("b")))
    done = None
    own = ["p", "q", "level", "sx", "sy"]
    while not small(edges):
        ends = edges.select(*own, F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select(*own, "e.node", "e.to")
        best = ends.groupBy("node").agg(F.min(F.struct(_rank().alias("r"), "to", *own)).alias("m")).select("node", "m.to", *(f"m.{c}" for c in own))
        there = nodes.select(F.col("node").alias("to"), F.col("top").alias("to_top"), F.col("open").alias("to_open"))
        seen = best.join(nodes, "node").join(there, "to")
        rank = lambda node, top, open_: F.struct((F.col(open_) >= F.col("level")).alias("o"), F.col(top).alias("t"), F.col(node).alias("n"))
        gone = scratch.keep(seen.where(rank("node", "top", "open") < rank("to", "to_top", "to_open")))
        closed = F.col("open") < F.col("level")
        settled = gone.select(*own, F.when(closed, F.col("top") - F.col("level")).alias("prominence"), F.when(closed, F.col("node")).alias("dies"))
        done = settled if done is None else done.union(settled)
        roots = roots_of(gone.select("node", "to"), scratch)
        at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        left = edges.join(gone.select("p", "q"), ["p", "q"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
        new_edges = scratch.keep(left.select(*own, F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
        # A runoff below the edge is met from the neighbour too; one above it changes nothing there.
        brings = gone.select("node", F.least("open", "level").alias("open")).join(roots, "node").groupBy(F.col("root").alias("node")).agg(F.max("open").alias("more"))
        kept = nodes.join(gone.select("node"), "node", "left_anti").join(brings, "node", "left")
        nodes = scratch.keep(kept.select("node", "top", F.greatest("open", F.coalesce("more", "open")).alias("open")))
        edges = new_edges
    # Nodes that no edge leads to any more are settled.
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    one = lambda table: table.withColumn("_one", F.lit(0) + F.lit(1)).groupBy("_one")
    last = one(nodes.join(ends, "node", "left_semi")).cogroup(one(edges)).applyInPandas(_meetings, "p long, q long, level double, sx int, sy int, prominence double, dies long")
    return scratch.keep(last if done is None else done.union(last))


def _meetings(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """What eliminate finds, of one task's nodes (node, top, open) and edges (..., a, b)."""
    state = {n: (t, o) for n, t, o in zip(nodes["node"].tolist(), nodes["top"].tolist(), nodes["open"].tolist(), strict=True)}
    sets, best, found = Sets(), _best_first(edges), []
    for level, a, b in zip(best["level"].tolist(), best["a"].tolist(), best["b"].tolist(), strict=True):
        ends = sorted((state[r][1] >= level, state[r][0], r) for r in (sets.root(a), sets.root(b)))
        (unknown, top, low), (_, _, high) = ends
        found.append((None if unknown else top - level, None if unknown else low))
        sets.parent[low] = high
        # The name of an island is its highest peak, whatever runoffs it reaches.
        if state[low][0:1] + (low,) > state[high][0:1] + (high,):
            sets.parent[low], sets.parent[high] = low, low
            low, high = high, low
        state[high] = (state[high][0], max(state[low][1], state[high][1]))
    out = best[["p", "q", "level", "sx", "sy"]].assign(prominence=pd.array([f[0] for f in found], "Float64"), dies=pd.array([f[1] for f in found], "Int64"))
    return out


def saddle_prominence(tree: Tree) -> DataFrame:
    """(p, q, level, sx, sy, prominence) of each saddle; null if it is unlimited, see ``eliminate``."""
    return eliminate(tree, Scratch(tree.spark, "saddles")).drop("dies")


def tree_prominence(tree: Tree, sea_level: float = 0.0, bathymetry: bool = False) -> DataFrame:
    """(gx, gy, elev, prominence, saddle_x, saddle_y, saddle_elev) of peaks with positive prominence, runoffs left aside."""
    scratch = Scratch(tree.spark, "tree-prominence")
    saddles = eliminate(replace(tree, runoffs=tree.runoffs.where("false")), scratch)
    key = saddles.select(F.col("dies").alias("peak"), "prominence", F.col("sx").alias("saddle_x"), F.col("sy").alias("saddle_y"), F.col("level").alias("saddle_elev"))
    all_ = tree.peaks.join(key, "peak", "left")
    sea = F.lit(float(sea_level))
    if bathymetry:
        all_ = all_.join(F.broadcast(saddles.agg(F.min("level").alias("sea"))))  # one row
        sea = F.coalesce("sea", sea)
    height = F.when(F.col("saddle_elev").isNull(), F.col("elev") - sea).otherwise(F.col("prominence"))
    return all_.withColumn("prominence", height).where("prominence > 0").select(*place_of("peak"), "elev", "prominence", "saddle_x", "saddle_y", "saddle_elev")


def prune(tree: Tree, minimum: float, sea_level: float = 0.0) -> Tree:
    """The tree without peaks of less prominence than the minimum, as far as it is certain that no saddle of more needs them.

    Taking out one such peak after another, over its highest saddle, as long as
    any is left whose highest saddle has less than the minimum, ends where all
    saddles of less have been contracted; so that is done at once.  Each
    contracted island is stood for by its highest peak.  A landmass of one low
    peak goes unless a runoff leads to it.
    """
    scratch = Scratch(tree.spark, "prune")
    tree = tree.keep(scratch)
    saddles = eliminate(tree, scratch)
    low = saddles.where(F.col("prominence") < minimum)
    stands = scratch.keep(islands(tree.peaks, low, scratch))
    kept = saddles.where(F.col("prominence").isNull() | (F.col("prominence") >= minimum)).select("p", "q", "level", "sx", "sy")
    small = _relabel(tree, stands, kept).keep(scratch)
    needed = small.edges.select(F.col("p").alias("peak")).union(small.edges.select("q")).union(small.runoffs.select("peak")).distinct()
    lone = small.peaks.where(F.col("elev") - sea_level < minimum).join(needed, "peak", "left_anti")
    return replace(small, peaks=small.peaks.join(lone.select("peak"), "peak", "left_anti"))


def islands(peaks: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the highest peak of each component that the edges make."""
    edges = scratch.keep(edges.select("p", "q"))
    if small(edges):
        part = in_one_task(edges, _components, "node long, label long")
    else:
        ends = edges.select(F.col("p").alias("node")).union(edges.select("q")).distinct()
        part = labels_by_links(ends, edges.select(F.col("p").alias("u"), F.col("q").alias("v")), scratch)
    part = part.join(peaks.withColumnRenamed("peak", "node"), "node")
    best = part.groupBy("label").agg(F.max_by("node", F.struct("elev", "node")).alias("root"))
    return part.join(best, "label").select("node", "root")


def _components(edges: pd.DataFrame) -> pd.DataFrame:
    sets = Sets()
    for a, b in zip(edges["p"].tolist(), edges["q"].tolist(), strict=True):
        sets.join(a, b)
    nodes = list(dict.fromkeys([*edges["p"].tolist(), *edges["q"].tolist()]))
    return pd.DataFrame({"node": nodes, "label": [sets.root(n) for n in nodes]}, dtype="int64")


def finish(tree: Tree, minimum: float) -> Tree:
    """The last step of a merge: land that goes on beyond the map ends there, so runoffs go and all is pruned."""
    return prune(replace(tree, runoffs=tree.runoffs.where("false")), minimum)


# --- rooted trees ----------------------------------------------------------------


def rooted(edges: DataFrame) -> DataFrame:
    """(node, parent, level): the forest of edges (p, q, level, ...), hung from one node of each tree, whose parent is null.

    Each edge is walked both ways in one tour around its tree: from an arc into
    a node, the next is the arc out of it to the neighbour after the one that
    it came from.  Arcs are ranked along the tour by pointer doubling, so
    rounds grow with the logarithm of the number of edges, whatever the depth.
    The earlier arc of an edge leads to the child.
    """
    scratch = Scratch(edges.sparkSession, "rooted")
    edges = scratch.keep(edges.select("p", "q", "level"))
    if small(edges):
        return scratch.keep(in_one_task(edges, _hang, f"node long, parent long, level {edges.schema['level'].dataType.simpleString()}"))
    arcs = edges.select(F.explode(F.array(F.struct(F.col("p").alias("u"), F.col("q").alias("v")), F.struct(F.col("q").alias("u"), F.col("p").alias("v")))).alias("a"), "level").select("a.*", "level")
    arcs = scratch.keep(arcs)
    around = W.partitionBy("u").orderBy("v")
    first = arcs.groupBy("u").agg(F.min("v").alias("first"))
    out = arcs.withColumn("after", F.lead("v").over(around)).join(first, "u").select(F.col("u").alias("at"), F.col("v").alias("came"), F.coalesce("after", "first").alias("next"))
    now = scratch.keep(arcs.join(out, (F.col("v") == F.col("at")) & (F.col("u") == F.col("came"))).select("u", "v", "level", F.col("v").alias("nu"), F.col("next").alias("nv"), F.struct("u", "v").alias("least")))
    # The least arc of each tour, by doubling.
    tour, steps, n = now.select("u", "v", "nu", "nv", "least"), 1, now.count()
    while steps < n:
        ahead = tour.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nu2"), F.col("nv").alias("nv2"), F.col("least").alias("least2"))
        new = scratch.keep(tour.join(ahead, ["nu", "nv"]).select("u", "v", F.col("nu2").alias("nu"), F.col("nv2").alias("nv"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("less")))
        tour, steps = new.select("u", "v", "nu", "nv", "least"), steps * 2
        if not new.where("less").limit(1).count():
            break
    # Cut before it, and count the arcs from each to the end.
    start = scratch.keep(now.drop("least").join(tour.select("u", "v", "least"), ["u", "v"]))
    ends = (F.col("nu") == F.col("least.u")) & (F.col("nv") == F.col("least.v"))
    rank = start.select("u", "v", "level", F.when(~ends, F.col("nu")).alias("nu"), F.when(~ends, F.col("nv")).alias("nv"), F.when(ends, 0).otherwise(1).cast("long").alias("n"))
    rank = scratch.keep(rank)
    while rank.where("nu is not null").limit(1).count():
        ahead = rank.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nu2"), F.col("nv").alias("nv2"), F.col("n").alias("n2"))
        new = scratch.keep(rank.join(ahead, ["nu", "nv"], "left").select("u", "v", "level", F.col("nu2").alias("nu"), F.col("nv2").alias("nv"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")))
        scratch.drop(rank)
        rank = new
    back = rank.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("n").alias("back"))
    child = rank.join(back, ["u", "v"]).where("n > back").select(F.col("v").alias("node"), F.col("u").alias("parent"), "level")
    top = child.select(F.col("parent").alias("node")).distinct().join(child.select("node"), "node", "left_anti")
    return scratch.keep(child.union(top.select("node", F.lit(None).cast("long"), F.lit(None).cast(edges.schema["level"].dataType))))


def _hang(edges: pd.DataFrame) -> pd.DataFrame:
    near: dict[int, list[tuple[int, float]]] = {}
    for p, q, level in zip(edges["p"].tolist(), edges["q"].tolist(), edges["level"].tolist(), strict=True):
        near.setdefault(p, []).append((q, level))
        near.setdefault(q, []).append((p, level))
    rows: dict[int, tuple] = {}
    for start in sorted(near):
        todo = [] if start in rows else [start]
        rows.setdefault(start, (start, None, None))
        while todo:
            here = todo.pop()
            for other, level in near[here]:
                if other not in rows:
                    rows[other] = (other, here, level)
                    todo.append(other)
    out = pd.DataFrame(list(rows.values()), columns=["node", "parent", "level"])
    return out.astype({"node": "int64", "parent": "Int64"})


def path_minimum(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, others) plus low: the least level on the way between two nodes of a rooted forest (node, parent, level).

    Null if no way joins them or they are one node.  Each node's ancestor
    2^k steps up, and the least level on the way there, are tables made from
    one another; a pair first comes to equal depth and then to its nearest
    common ancestor in as many joins as the depth has binary digits.
    """
    scratch = Scratch(nodes.sparkSession, "paths")
    lifts = [scratch.keep(nodes.where("parent is not null").select("node", F.col("parent").alias("up"), F.col("level").alias("least")))]
    depth = scratch.keep(nodes.select("node", F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("parent").alias("to")))
    while True:
        ahead = depth.select(F.col("node").alias("to"), F.col("depth").alias("more"), F.col("to").alias("next"))
        new = scratch.keep(depth.join(ahead, "to", "left").select("node", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").alias("to")))
        depth, last = new, lifts[-1]
        if not depth.where("to is not null").limit(1).count():
            break
        jump = last.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        lifts.append(scratch.keep(last.join(jump, "up").select("node", F.col("up2").alias("up"), F.least("least", "least2").alias("least"))))
    depth = depth.select("node", "depth")
    of = lambda c: depth.select(F.col("node").alias(c), F.col("depth").alias(f"{c}_depth"))
    own = pairs.columns
    now = pairs.withColumns({"_a": F.col("a"), "_b": F.col("b")}).join(of("_a"), "_a", "left").join(of("_b"), "_b", "left")
    swap = F.col("_b_depth") > F.col("_a_depth")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    now = now.select(*own, pick("_a", "_b").alias("_u"), pick("_b", "_a").alias("_v"), F.abs(F.col("_a_depth") - F.col("_b_depth")).alias("_gap"), F.lit(None).cast(nodes.schema["level"].dataType).alias("low"))
    lift = lambda table, c: table.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"), F.col("least").alias(f"{c}_least"))
    for k in range(len(lifts) - 1, -1, -1):
        goes = F.expr(f"_gap is not null and (_gap div {1 << k}) % 2 = 1")
        moved = now.join(lift(lifts[k], "_u"), "_u", "left")
        now = scratch.keep(moved.select(*own, F.when(goes, F.col("_u_up")).otherwise(F.col("_u")).alias("_u"), "_v", "_gap", F.when(goes, F.least("low", "_u_least")).otherwise(F.col("low")).alias("low")))
    for k in range(len(lifts) - 1, -1, -1):
        moved = now.join(lift(lifts[k], "_u"), "_u", "left").join(lift(lifts[k], "_v"), "_v", "left")
        goes = F.coalesce((F.col("_u") != F.col("_v")) & (F.col("_u_up") != F.col("_v_up")), F.lit(False))
        now = scratch.keep(moved.select(*own, F.when(goes, F.col("_u_up")).otherwise(F.col("_u")).alias("_u"), F.when(goes, F.col("_v_up")).otherwise(F.col("_v")).alias("_v"), F.when(goes, F.least("low", "_u_least", "_v_least")).otherwise(F.col("low")).alias("low")))
    last = now.join(lift(lifts[0], "_u"), "_u", "left").join(lift(lifts[0], "_v"), "_v", "left")
    met = F.coalesce(F.col("_u") == F.col("_v"), F.lit(False))
    both = F.coalesce(F.col("_u_up") == F.col("_v_up"), F.lit(False))
    return last.select(*own, F.when(met, F.col("low")).when(both, F.least("low", "_u_least", "_v_least")).alias("low"))


# --- tree files ------------------------------------------------------------------


def to_tables(tree: Tree, dx: int = 0, dy: int = 0) -> dict[str, DataFrame]:
    """The tables of a tree file, by tag, with places shifted: peaks and saddles numbered from 1 in row order, runoffs from 0.

    Each peak names the next one on the way to its tree's root, and the saddle
    between them; a root has -1 for both.
    """
    peaks = numbered(tree.peaks, ["peak"], "peak_id")
    saddles = numbered(tree.edges, ["sy", "sx", "p", "q"], "saddle_id")
    runoffs = numbered(tree.runoffs, ["y", "x"], "runoff_id", first=0)
    of = lambda c, name: peaks.select(F.col("peak").alias(c), F.col("peak_id").alias(name))
    hung = rooted(tree.edges).where("parent is not null").select("node", "parent", F.least("node", "parent").alias("p"), F.greatest("node", "parent").alias("q"))
    up = hung.join(saddles, ["p", "q"]).join(of("parent", "parent_id"), "parent").select(F.col("node").alias("peak"), "parent_id", "saddle_id")
    nodes = peaks.join(up, "peak", "left").select("peak_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), F.coalesce("saddle_id", F.lit(-1)).alias("saddle_id"))
    x, y = place_of("peak", "x", "y")
    moved = lambda a, b: ((F.col(a) + dx).cast("int").alias("x"), (F.col(b) + dy).cast("int").alias("y"))
    return {
        "P": peaks.select("peak_id", x, y, "elev").select("peak_id", *moved("x", "y"), "elev"),
        "S": saddles.select("saddle_id", F.lit("p").alias("type"), *moved("sx", "sy"), F.col("level").alias("elev")),
        "R": runoffs.select("runoff_id", *moved("x", "y"), "elev", "quadrants", "inside_peak"),
        "N": nodes,
        "E": runoffs.join(of("peak", "peak_id"), "peak").select("runoff_id", "peak_id"),
    }


def from_tables(tables: dict[str, DataFrame], dx: int = 0, dy: int = 0) -> Tree:
    """The tree that a tree file's tables hold, with places shifted; saddles that separate no peaks are left out."""
    key = lambda x, y: key_of(F.col(x) + dx, F.col(y) + dy)
    peaks = tables["P"].select("peak_id", key("x", "y").alias("peak"), F.col("elev").cast("double").alias("elev"))
    of = lambda c, name: peaks.select(F.col("peak_id").alias(c), F.col("peak").alias(name))
    saddles = compact(tables["S"]).select("saddle_id", (F.col("x") + dx).cast("int").alias("sx"), (F.col("y") + dy).cast("int").alias("sy"), F.col("elev").cast("double").alias("level"))
    edges = tables["N"].where("parent_id > 0").join(saddles, "saddle_id").join(of("peak_id", "a"), "peak_id").join(of("parent_id", "b"), "parent_id")
    runoffs = tables["R"].join(tables["E"], "runoff_id").join(of("peak_id", "peak"), "peak_id")
    return Tree(
        peaks.select("peak", "elev"),
        edges.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "level", "sx", "sy"),
        runoffs.select((F.col("x") + dx).cast("int").alias("x"), (F.col("y") + dy).cast("int").alias("y"), F.col("elev").cast("double").alias("elev"), "quadrants", "inside_peak", "peak"),
    )
