"""Prominence by hierarchical contraction of a peak graph.

Prominence is the persistence of superlevel sets of the 8-connected cells: as
the level falls, islands grow and meet, and where two meet the lower top dies
with the difference as its prominence.

Cells are cut into blocks.  A block labels every cell with the local top that
steepest ascent leads to, keeps the best saddle between any two tops, and runs
the merge from high to low.  A top whose island has no cell on the block's
border at or above the meeting level is final: nothing outside can change it.
It is written out and its node contracted into its neighbour.  Only open
islands remain, with the border cells they own, so what a block passes on
grows with its border and not with its area.  Groups of 2 by 2 blocks are then
joined by their seams (pairs of touching border cells) and treated alike,
level by level, until one block is left.

Ties: of two tops the higher (elevation, row order) survives; but if both are
as high as the meeting level they are one plateau, whose first cell stands for
it.  A plateau cut by a seam therefore keeps its prominence.  Saddles name the
lower of the two cells where islands meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.scratch import Scratch

#: Cells across a block; a block's grid is a few MB.
BLOCK = 512
_ROW = 1 << 31

_SCHEMA = "kind string, bx long, by long, gx int, gy int, elev double, peak long, other long, sx int, sy int, level double, end_a long, end_b long"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def peak_id(gx, gy):
    """Row order as a number."""
    return gy * _ROW + gx


def label(grid: np.ndarray) -> np.ndarray:
    """Flat index of the top that steepest ascent from each cell leads to; -1 without data.

    Among equal cells the first in row order counts as higher.
    """
    h, w = grid.shape
    padded = np.full((h + 2, w + 2), -np.inf)
    padded[1:-1, 1:-1] = np.where(np.isnan(grid), -np.inf, grid)
    flat = np.arange(h * w).reshape(h, w)
    best, up = padded[1:-1, 1:-1].copy(), flat.copy()
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            there, index = padded[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx], flat + dy * w + dx
            better = (there > best) | ((there == best) & (index < up) & (there > -np.inf))
            best, up = np.where(better, there, best), np.where(better, index, up)
    up = up.ravel()
    while True:
        further = up[up]
        if (further == up).all():
            break
        up = further
    return np.where(np.isnan(grid).ravel(), -1, up)


def adjacency(grid: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best saddles between tops: (a, b, level, cell) with a < b, the cell the lower of the two that touch."""
    h, w = grid.shape
    flat, elev = np.arange(h * w).reshape(h, w), grid.ravel()
    pairs = []
    for a, b in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1, :], np.s_[1:, :]), (np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[:-1, 1:], np.s_[1:, :-1])):
        i, j = flat[a].ravel(), flat[b].ravel()
        apart = (top[i] >= 0) & (top[j] >= 0) & (top[i] != top[j])
        pairs.append(np.stack([i[apart], j[apart]]))
    i, j = np.concatenate(pairs, axis=1)
    cell = np.where(elev[i] <= elev[j], i, j)
    level = np.minimum(elev[i], elev[j])
    low, high = np.minimum(top[i], top[j]), np.maximum(top[i], top[j])
    order = np.lexsort((cell, -level, high, low))
    first = np.ones(len(order), bool)
    first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    keep = order[first]
    return low[keep], high[keep], level[keep], cell[keep]


def contract(tops: dict[int, float], edges: list[tuple], border: dict[int, float]):
    """One merge from high to low.

    tops: peak to elevation; edges: (level, a, b, sx, sy, end_a, end_b), the
    ends being the tops of the two cells that meet, which a and b stand for;
    border: peak to the level of the highest border cell that it owns.
    Returns the final peaks (peak, elev, level, sx, sy, end), the edges that
    remain, and the peak that each contracted one went to.
    """
    parent, best = {p: p for p in tops}, {p: p for p in tops}
    opened = dict.fromkeys(tops, -np.inf) | border

    def root(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    into: dict[int, int] = {}

    def node(p):
        while p in into:
            p = into[p]
        return p

    final, left = [], []
    for level, a, b, sx, sy, end_a, end_b in sorted(edges, key=lambda e: (-e[0], e[4], e[3], e[1], e[2])):
        ra, rb = root(a), root(b)
        if ra == rb:
            continue
        ta, tb = best[ra], best[rb]
        plateau = tops[ta] == level and tops[tb] == level
        if not (ta < tb if plateau else (tops[ta], ta) > (tops[tb], tb)):
            a, b, ra, rb, ta, tb, end_a, end_b = b, a, rb, ra, tb, ta, end_b, end_a
        if opened[rb] < level:
            final.append((tb, tops[tb], level, sx, sy, end_a))
            into[tb] = node(a)
        else:
            left.append((level, a, b, sx, sy, end_a, end_b))
        parent[rb] = ra
        best[ra] = ta
        opened[ra] = max(opened[ra], opened[rb])
    return final, [(e[0], node(e[1]), node(e[2]), *e[3:]) for e in left], node


def _emit(bx, by, tops, final, left, node, border, outer) -> pd.DataFrame:
    """kinds: F final (its end in other), T open top, E edge, B border cell."""
    rows = [("F", bx, by, None, None, elev, p, end, sx, sy, level, None, None) for p, elev, level, sx, sy, end in final]
    rows += [("T", bx, by, None, None, tops[p], p, None, None, None, None, None, None) for p in tops if node(p) == p]
    rows += [("E", bx, by, None, None, None, a, b, sx, sy, w, end_a, end_b) for w, a, b, sx, sy, end_a, end_b in left]
    rows += [("B", bx, by, x, y, e, node(p), p0, None, None, None, None, None) for x, y, e, p, p0 in border if outer(x, y)]
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({c: "Int64" for c in ("gx", "gy", "peak", "other", "sx", "sy", "end_a", "end_b")} | {"elev": "float64", "level": "float64"})


def _block(size: int, around: int = 0):
    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bx, by = (int(k) for k in key)
        x, y = part["gx"].to_numpy(), part["gy"].to_numpy()
        x0, y0 = int(x.min()), int(y.min())
        grid = np.full((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.nan)
        grid[y - y0, x - x0] = part["elev"]
        w = grid.shape[1]
        top = label(grid)
        elev = grid.ravel()
        name = lambda i: (int(i) // w + y0) * _ROW + int(i) % w + x0
        a, b, level, cell = adjacency(grid, top)
        tops = {name(i): float(elev[i]) for i in np.unique(top[top >= 0])}
        edges = [(float(e), name(i), name(j), int(c) % w + x0, int(c) // w + y0, name(i), name(j)) for i, j, e, c in zip(a, b, level, cell, strict=True)]
        on = ((x == bx * size) | (x == bx * size + size - 1) | (y == by * size) | (y == by * size + size - 1) | (x == around - 1)).nonzero()[0]
        border = []
        for k in on:
            p = name(top[(y[k] - y0) * w + x[k] - x0])
            border.append((int(x[k]), int(y[k]), float(grid[y[k] - y0, x[k] - x0]), p, p))
        highest: dict[int, float] = {}
        for _, _, e, p, _ in border:
            highest[p] = max(e, highest.get(p, -np.inf))
        final, left, node = contract(tops, edges, highest)
        return _emit(bx, by, tops, final, left, node, border, lambda *_: True)

    return work


def _join_blocks(span: int, last: bool, around: int = 0):
    """A group of 2 by 2 blocks; span: cells across the group; around: cells around the globe, whose first and last columns touch."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        px, py = (int(k) for k in key)
        kind = part["kind"]
        tops = {int(p): float(e) for p, e in part.loc[kind == "T", ["peak", "elev"]].itertuples(index=False)}
        edges = [(float(r[0]), *map(int, r[1:])) for r in part.loc[kind == "E", ["level", "peak", "other", "sx", "sy", "end_a", "end_b"]].itertuples(index=False)]
        at = {(int(r.gx), int(r.gy)): (float(r.elev), int(r.peak), int(r.other), (r.bx, r.by)) for r in part[kind == "B"].itertuples(index=False)}
        seams: dict[tuple[int, int], tuple] = {}
        for (x, y), (e, p, own, block) in at.items():
            for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
                beyond = (x + dx) % around if around else x + dx
                there = at.get((beyond, y + dy))
                if there is None or (there[3] == block and beyond == x + dx):
                    continue
                low, sx, sy = (e, x, y) if e <= there[0] else (there[0], beyond, y + dy)
                (a, end_a), (b, end_b) = sorted(((p, own), (there[1], there[2])))
                order = (-low, sy, sx, end_a, end_b)
                if (a, b) not in seams or order < seams[a, b][0]:
                    seams[a, b] = (order, (low, a, b, sx, sy, end_a, end_b))
        edges += [e for _, e in seams.values()]
        outer = lambda x, y: not last and (x % span in (0, span - 1) or y % span in (0, span - 1) or x == around - 1)
        border = [(x, y, e, p, own) for (x, y), (e, p, own, _) in at.items()]
        highest: dict[int, float] = {}
        for x, y, e, p, _ in border:
            if outer(x, y):
                highest[p] = max(e, highest.get(p, -np.inf))
        final, left, node = contract(tops, edges, highest)
        return _emit(px, py, tops, final, left, node, border, outer)

    return work


def merge_peaks(cells: DataFrame, block: int = BLOCK, bathymetry: bool = False, around: int = 0) -> DataFrame:
    """(peak, elev, prominence, saddle_x, saddle_y, saddle_elev, end) of every local top, those without prominence included.

    With around, gx runs from 0 to below it and the first and last columns
    touch; they stay on the border until the last merge, which joins them.
    """
    scratch = Scratch(cells.sparkSession, "prominence")
    typed = cells.select("gx", "gy", F.col("elev").cast("double").alias("elev")).where("elev is not null and not isnan(elev)")
    key = lambda c, n: F.floor(F.col(c) / n).cast("long").alias({"gx": "bx", "gy": "by"}.get(c, c))
    level = scratch.keep(typed.groupBy(key("gx", block), key("gy", block)).applyInPandas(_block(block, around), _SCHEMA))
    done = [level.where("kind = 'F'")]
    span = block
    while True:
        far = level.where("kind <> 'F'").agg(F.max("bx"), F.max("by")).first()
        single = far[0] is None or (far[0] == 0 and far[1] == 0)
        span *= 2
        open_ = level.where("kind <> 'F'")
        new = scratch.keep(open_.groupBy((F.col("bx") / 2).cast("long").alias("px"), (F.col("by") / 2).cast("long").alias("py")).applyInPandas(_join_blocks(span, single, around), _SCHEMA))
        done.append(new.where("kind = 'F'"))
        level = new
        if single:
            break
    finals = done[0]
    for more in done[1:]:
        finals = finals.union(more)
    died = finals.select("peak", "elev", (F.col("elev") - F.col("level")).alias("prominence"), F.col("sx").alias("saddle_x"), F.col("sy").alias("saddle_y"), F.col("level").alias("saddle_elev"), F.col("other").alias("end"))
    sea = F.lit(0.0)
    roots = level.where("kind = 'T'").select("peak", "elev")
    if bathymetry:
        # A top that dies at its own height was cut off by a seam; that is no saddle.
        roots = roots.join(F.broadcast(finals.where("elev > level").agg(F.min("level").alias("sea"))))  # one row
        sea = F.coalesce("sea", F.lit(0.0))
    top = roots.select("peak", "elev", (F.col("elev") - sea).alias("prominence"), F.lit(None).cast("int").alias("saddle_x"), F.lit(None).cast("int").alias("saddle_y"), F.lit(None).cast("double").alias("saddle_elev"), F.lit(None).cast("long").alias("end"))
    return died.union(top)


def _place(c: str, x: str = "gx", y: str = "gy"):
    return F.pmod(c, F.lit(_ROW)).cast("int").alias(x), F.expr(f"{c} div {_ROW}").cast("int").alias(y)


def prominence(cells: DataFrame, block: int = BLOCK, bathymetry: bool = False, around: int = 0) -> DataFrame:
    """(gx, gy, elev, prominence, saddle_x, saddle_y, saddle_elev) of every peak with positive prominence.

    The highest peak of each landmass has no saddle; its prominence is its
    height over sea level (zero), or with bathymetry over the lowest saddle.
    Coordinates must not be negative and no cell may occur twice.  With around,
    so many samples lie around the globe, and land joins across the seam.
    """
    return merge_peaks(cells, block, bathymetry, around).select(*_place("peak"), "elev", "prominence", "saddle_x", "saddle_y", "saddle_elev").where("prominence > 0")


def prune(peaks: DataFrame, minimum: float) -> DataFrame:
    """Peaks of at least so much prominence."""
    return peaks.where(F.col("prominence") >= minimum)


def anti_prominence(cells: DataFrame, block: int = BLOCK, bathymetry: bool = False, around: int = 0) -> DataFrame:
    """Prominence of depressions; elevations are those of the ground.  As for peaks, bathymetry chooses what the deepest is measured from."""
    found = prominence(cells.withColumn("elev", -F.col("elev")), block, bathymetry, around)
    return found.withColumn("elev", -F.col("elev")).withColumn("saddle_elev", -F.col("saddle_elev"))


def parents(cells: DataFrame, block: int = BLOCK, minimum: float = 0.0, around: int = 0) -> DataFrame:
    """(gx, gy, elev, prominence, line_x, line_y, parent_x, parent_y) of peaks with more than the minimum prominence.

    The line parent is the first peak at least as high on the walk that starts
    across the key saddle and climbs from line parent to line parent; the
    prominence parent is the first on that walk with more prominence.  Rounds
    are as many as the longest such walk has steps.
    """
    scratch = Scratch(cells.sparkSession, "parents")
    peaks = scratch.keep(merge_peaks(cells, block, around=around).select("peak", "elev", "prominence", "end"))
    about = peaks.select(F.col("peak").alias("at"), F.col("elev").alias("at_elev"), F.col("prominence").alias("at_prominence"))
    state = scratch.keep(peaks.withColumn("at", F.col("end")).join(about, "at", "left").select("peak", "elev", "prominence", "at", (F.col("at").isNull() | (F.col("at_elev") >= F.col("elev"))).alias("done")))
    while state.where("not done").limit(1).count():
        known = state.where("done").select(F.col("peak").alias("at"), F.col("at").alias("above"), F.lit(True).alias("known"))
        moved = state.join(known, "at", "left").withColumn("to", F.when(F.col("done") | F.col("known").isNull(), F.col("at")).otherwise(F.col("above")))
        new = moved.select("peak", "elev", "prominence", F.col("to").alias("at"), "done").join(about, "at", "left")
        state = scratch.keep(new.select("peak", "elev", "prominence", "at", (F.col("done") | F.col("at").isNull() | (F.col("at_elev") >= F.col("elev"))).alias("done")))
    line = state.select("peak", F.col("at").alias("line"))
    walk = scratch.keep(state.join(about, "at", "left").select("peak", "elev", "prominence", F.col("at").alias("line"), "at", (F.col("at").isNull() | (F.col("at_prominence") > F.col("prominence"))).alias("done")))
    above = line.select(F.col("peak").alias("at"), F.col("line").alias("next"))
    while walk.where("not done").limit(1).count():
        moved = walk.join(above, "at", "left").select("peak", "elev", "prominence", "line", F.when(F.col("done"), F.col("at")).otherwise(F.col("next")).alias("at"), "done").join(about, "at", "left")
        walk = scratch.keep(moved.select("peak", "elev", "prominence", "line", "at", (F.col("done") | F.col("at").isNull() | (F.col("at_prominence") > F.col("prominence"))).alias("done")))
    return walk.where(F.col("prominence") > minimum).select(*_place("peak"), "elev", "prominence", *_place("line", "line_x", "line_y"), *_place("at", "parent_x", "parent_y"))
