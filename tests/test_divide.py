"""Divide trees: against flooding and brute force on random rasters and trees, and through files and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import crs, geo
from ridgeline.operators import divide, prominence
from ridgeline.plans.scratch import Scratch
from ridgeline.sources import formats, raster, text
from tests.test_terrain import cells_of, flood


@pytest.fixture(params=["one task", "rounds"])
def ways(request, monkeypatch):
    """What is small enough for one task is done in one; without that, everything takes rounds over tables."""
    if request.param == "rounds":
        monkeypatch.setattr(divide, "FINISH", 0)


def random_raster(seed, shape=(11, 13)):
    rng = np.random.default_rng(seed)
    grid = rng.integers(1, 9, shape).astype(float)
    grid[rng.random(grid.shape) < 0.1] = np.nan
    return grid


def random_tree(seed, n=24):
    """Elevations by peak, and edges (p, q, level) with levels below both ends; some ties, two landmasses."""
    rng = np.random.default_rng(seed)
    elev = {i: float(rng.integers(30, 60)) for i in range(1, n + 1)}
    edges = []
    for i in range(2, n + 1):
        if i != n // 2:
            j = int(rng.integers(max(1, n // 2 if i > n // 2 else 1), i))
            edges.append((j, i, float(rng.integers(1, 30))))
    return elev, edges


def tree_of(spark, elev, edges, runoffs=()):
    return divide.Tree(
        spark.createDataFrame(list(elev.items()), "peak long, elev double"),
        spark.createDataFrame([(p, q, w, i, 0) for i, (p, q, w) in enumerate(edges)], "p long, q long, level double, sx int, sy int"),
        spark.createDataFrame([(i, 0, e, 2, 0, p) for i, (p, e) in enumerate(runoffs)], "x int, y int, elev double, quadrants int, inside_peak int, peak long"),
    )


def order(i, edge):
    return (-edge[2], 0, i, edge[0], edge[1])


def side(node, i, edges, cut):
    """Nodes reached from node over edges better than the cut."""
    seen, todo = {node}, [node]
    while todo:
        v = todo.pop()
        for k, (p, q, w) in enumerate(edges):
            if v in (p, q) and order(k, (p, q, w)) < cut:
                o = q if v == p else p
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
    return seen


def brute_saddles(elev, edges, runoffs):
    out = {}
    for i, (p, q, w) in enumerate(edges):
        tops = []
        for end in (p, q):
            part = side(end, i, edges, order(i, (p, q, w)))
            tops.append(np.inf if any(a in part and e >= w for a, e in runoffs) else max(elev[v] for v in part))
        out[i] = min(tops) - w
    return out


@pytest.mark.parametrize(("seed", "size", "finish"), [(1, 4, 8), (2, 3, divide.FINISH), (3, 5, divide.FINISH), (4, 16, divide.FINISH)])
def test_tiles_spliced_equal_flooding(spark, seed, size, finish, monkeypatch):
    monkeypatch.setattr(divide, "FINISH", finish)
    grid = random_raster(seed)
    found = divide.tree_prominence(divide.build_tree(cells_of(spark, grid), size)).collect()
    assert {(r.gx, r.gy): r.prominence for r in found} == flood(grid)


def test_saddle_prominence_equals_brute_force(spark, ways):
    seed = 5
    elev, edges = random_tree(seed)
    rng = np.random.default_rng(seed)
    runoffs = [(int(rng.integers(1, len(elev) + 1)), float(rng.integers(1, 40))) for _ in range(4)]
    runoffs = [(p, min(e, elev[p])) for p, e in runoffs]
    for some in ((), runoffs):
        found = {r.sx: np.inf if r.prominence is None else r.prominence for r in divide.saddle_prominence(tree_of(spark, elev, edges, some)).collect()}
        want = brute_saddles(elev, edges, some)
        assert sorted((edges[i][2], v) for i, v in found.items()) == sorted((edges[i][2], v) for i, v in want.items())
        assert found == want


def prune_one_by_one(elev, edges, minimum):
    """Peaks taken out one at a time over their highest saddle, as long as one is low and that saddle too."""
    height = brute_saddles(elev, edges, ())
    live = {i: list(e) for i, e in enumerate(edges)}
    peaks = dict(elev)
    while True:
        for v in sorted(peaks):
            mine = [i for i, (p, q, _) in live.items() if v in (p, q)]
            if not mine:
                if peaks[v] < minimum:
                    del peaks[v]
                    break
                continue
            best = min(mine, key=lambda i: order(i, edges[i]))
            p, q, w = live[best]
            other = q if v == p else p
            top = max(side(other, best, [tuple(live.get(i, (0, 0, 0))) for i in range(len(edges))], order(best, edges[best])), key=lambda x: (peaks[x], x))
            if height[best] < minimum and (peaks[v], v) < (peaks[top], top):
                for i in mine:
                    live[i] = [other if x == v else x for x in live[i][:2]] + [live[i][2]]
                del live[best], peaks[v]
                break
        else:
            return set(peaks), sorted((min(p, q), max(p, q), w) for p, q, w in live.values())


def test_prune_equals_one_at_a_time(spark, ways):
    seed = 7
    elev, edges = random_tree(seed)
    small = divide.prune(tree_of(spark, elev, edges), 25.0)
    peaks, left = prune_one_by_one(elev, edges, 25.0)
    assert {r.peak for r in small.peaks.collect()} == peaks
    assert sorted((r.p, r.q, r.level) for r in small.edges.collect()) == left


def test_prune_keeps_what_land_beyond_may_need(spark):
    """A low peak whose saddle lies between two runoffs stays; one on a spur goes, and its runoff moves to what stands for it."""
    elev = {1: 50.0, 2: 12.0, 3: 40.0, 4: 21.0}
    edges = [(1, 2, 5.0), (2, 3, 6.0), (3, 4, 20.0)]
    small = divide.prune(tree_of(spark, elev, edges, [(1, 45.0), (3, 30.0), (4, 19.0)]), 10.0)
    assert {r.peak for r in small.peaks.collect()} == {1, 3}
    assert [(r.p, r.q, r.level) for r in small.edges.collect()] == [(1, 3, 5.0)]
    assert sorted((r.peak, r.elev) for r in small.runoffs.collect()) == [(1, 45.0), (3, 19.0), (3, 30.0)]
    alone = tree_of(spark, {9: 4.0, 10: 5.0}, [], [(9, 3.0)])
    assert {r.peak for r in divide.prune(alone, 10.0).peaks.collect()} == {9}
    assert divide.finish(alone, 10.0).peaks.count() == 0


def test_forest_update_drops_basins(spark, ways):
    """An edge that closes a cycle pushes out its lowest saddle, or is it."""
    scratch = Scratch(spark, "test")
    schema = "p long, q long, level double, sx int, sy int"
    old = spark.createDataFrame([(1, 2, 5.0, 0, 0), (2, 3, 3.0, 1, 0), (4, 5, 7.0, 2, 0)], schema)
    new = spark.createDataFrame([(3, 1, 4.0, 3, 0), (1, 2, 2.0, 4, 0), (5, 1, 1.0, 5, 0)], schema)
    kept, basins = divide.update_forest(old, new, scratch)
    assert sorted(r.sx for r in kept.collect()) == [0, 2, 3, 5] and sorted(r.sx for r in basins.collect()) == [1, 4]


def test_runoffs_splice_until_all_quadrants_are_seen(spark):
    rows = [(4, 0, 9.0, 2, 1, 10), (4, 0, 9.0, 2, 1, 11), (4, 4, 7.0, 1, 1, 10), (4, 4, 7.0, 1, 0, 12), (8, 8, 3.0, 2, 0, 13)]
    runoffs = spark.createDataFrame(rows, "x int, y int, elev double, quadrants int, inside_peak int, peak long")
    assert sorted((r.p, r.q, r.level) for r in divide.splice_edges(runoffs).collect()) == [(10, 11, 9.0), (10, 12, 7.0)]
    left = {(r.x, r.y): (r.quadrants, r.inside_peak) for r in divide.splice_runoffs(runoffs).collect()}
    assert left == {(4, 4): (2, 0), (8, 8): (2, 0)}


def test_rooted_forest_and_paths(spark, ways):
    elev, edges = random_tree(11, 30)
    edges += [(30 + i, 31 + i, float(i % 7 + 1)) for i in range(1, 40)]  # and a long chain
    nodes = divide.rooted(tree_of(spark, elev, edges).edges)
    rows = nodes.collect()
    assert len({r.node for r in rows}) == len(rows) and sorted((min(r.node, r.parent), max(r.node, r.parent), r.level) for r in rows if r.parent is not None) == sorted((min(p, q), max(p, q), w) for p, q, w in edges)
    near = {}
    for p, q, w in edges:
        near.setdefault(p, []).append((q, w))
        near.setdefault(q, []).append((p, w))

    def low(a):
        seen, todo = {a: None}, [a]
        while todo:
            v = todo.pop()
            for o, w in near.get(v, ()):
                if o not in seen:
                    seen[o] = w if seen[v] is None else min(w, seen[v])
                    todo.append(o)
        return seen

    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(1, 71, (60, 2))] + [(5, 5), (31, 70), (5, 999)]
    found = {(r.a, r.b): r.low for r in divide.path_minimum(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {(a, b): low(a).get(b) for a, b in pairs}


def test_land_joins_across_180(spark):
    """A raster around the globe has the same prominences wherever it is cut."""
    rng = np.random.default_rng(12)
    grid = rng.permutation(12 * 9).reshape(9, 12).astype(float) + 1
    results = []
    for shift in (0, 5, 7):
        cells = cells_of(spark, np.roll(grid, shift, axis=1))
        for found in (prominence.prominence(cells, 4, around=12), divide.tree_prominence(divide.build_tree(cells, 4, around=12)), prominence.prominence(cells, 32, around=12)):
            results.append({((r.gx - shift) % 12, r.gy): r.prominence for r in found.collect()})
    assert all(r == results[0] for r in results)
    assert results[0] != {(r.gx, r.gy): r.prominence for r in prominence.prominence(cells_of(spark, grid), 4).collect()}


def write_tiles(folder, fmt, tiles):
    folder.mkdir()
    for (lat, lng), grid in tiles.items():
        (folder / formats.file_name(fmt, lat, lng)).write_bytes(grid.astype("<f4").tobytes())


def test_trees_through_files_and_command_line(spark, tmp_path):
    """Trees of tiles, each made without the others, written, merged and merged again, hold the prominences of all tiles together."""
    from ridgeline.cli import _tree_kml, main

    fmt = formats.parse_format("CUSTOM-0.5-8")
    rng = np.random.default_rng(3)
    west, east, south = (rng.integers(1, 900, (8, 8)) for _ in range(3))
    write_tiles(tmp_path / "all", fmt, {(59.0, 6.0): west, (59.0, 6.5): east, (58.5, 6.0): south})
    # A tile's file lacks its neighbours' first row and column, so trees are made of parts that share them.
    cells = raster.one_owner(raster.read_cells(spark, fmt.name, str(tmp_path / "all")))
    grid = raster.grid_of(fmt.name)
    pieces = divide.tile_trees(cells, 8, grid.around)
    from ridgeline.sources import sinks

    names = []
    for i, r in enumerate(pieces.select("tx", "ty").distinct().orderBy("tx", "ty").collect()):
        part = divide.tree_of(pieces.where((F.col("tx") == r.tx) & (F.col("ty") == r.ty)))
        # On a grid of its own, whose origin is the tile's corner.
        lat, lng = 90 - r.ty * 0.5, -180 + r.tx * 0.5
        own = crs.DegreeGrid(lat - 0.5, lng, lat, lng + 0.5, 16, 16)
        names.append(str(tmp_path / f"t{i}.dvt"))
        sinks.write_divide_tree(own, divide.to_tables(divide.merge(part), -r.tx * 8, -r.ty * 8), names[-1])
    assert len(names) == 3
    main(["merge", str(tmp_path / "two"), *names[:2], "-m", "0"], spark)
    main(["merge", str(tmp_path / "three"), str(tmp_path / "two" / "tree"), names[2], "-m", "40", "-f"], spark)
    main(["prominence", "-i", str(tmp_path / "all"), "-o", str(tmp_path / "whole"), "-f", fmt.name, "-m", "40", "--keep-spikes"], spark)
    lines = lambda p: sorted(tuple(x.value.split(",")[i] for i in (0, 1, 2, 5)) for x in spark.read.text(str(tmp_path / p)).collect())
    assert lines("three/prominence") == lines("whole") and lines("whole")
    back, tables = text.read_divide_tree(spark, str(tmp_path / "three" / "tree"))
    assert tables["R"].count() == 0 and back.around == 360 * 16
    main(["tree", "-i", str(tmp_path / "all"), "-o", str(tmp_path / "tree"), "-f", fmt.name, "-m", "40", "--keep-spikes", "--kml", str(tmp_path / "kml")], spark)
    main(["merge", str(tmp_path / "one"), str(tmp_path / "tree"), "-m", "40", "-f"], spark)
    assert lines("one/prominence") == lines("whole")
    kml = "".join(x.value for x in spark.read.text(str(tmp_path / "kml")).collect())
    assert all(f"<name>{k}</name>" in kml for k in ("Peaks", "Saddles", "Edges"))
    marks = _tree_kml(tree_of(spark, {1: 9.0, 2: 8.0}, [(1, 2, 3.0)], [(1, 4.0)]), grid)
    assert sorted(r.folder for r in marks.collect()) == ["Edges", "Peaks", "Peaks", "Runoffs", "Saddles"]
    with pytest.raises(ValueError, match="merged"):
        (tmp_path / "other.dvt").write_text("G,1.0,2.0,99,99,3.0,4.0\nP,1,2,3,4.25\nN,1,-1,-1\n")
        main(["merge", str(tmp_path / "bad"), names[0], str(tmp_path / "other.dvt")], spark)


def test_bounds_choose_peaks_not_ground(spark, tmp_path):
    """A peak within the bounds is measured against higher ground outside them."""
    from ridgeline.cli import main

    fmt = formats.parse_format("CUSTOM-0.5-8")
    west, east = np.ones((8, 8)), np.ones((8, 8))
    west[4, 4:], east[4, :2] = 300, 300
    west[4, 4], east[4, 2] = 500, 900
    write_tiles(tmp_path / "in", fmt, {(59.0, 6.0): west, (59.0, 6.5): east})
    for program, least in (("prominence", "100"), ("isolation", "1"), ("parents", "100")):
        main([program, "-i", str(tmp_path / "in"), "-o", str(tmp_path / program), "-f", fmt.name, "-m", least, "--bounds", "59", "6", "59.5", "6.49"], spark)
    lines = {p: [x.value.split(",") for x in spark.read.text(str(tmp_path / p)).collect()] for p in ("prominence", "isolation", "parents")}
    assert [x[2] for x in lines["prominence"]] == ["500.00"] and lines["prominence"][0][5] == "200.00"
    peak = [x for x in lines["isolation"] if x[2] == "500.00"]
    assert len(peak) == 1 and float(peak[0][5]) > 0 and all(float(x[1]) <= 6.49 for x in lines["isolation"])
    assert len(lines["parents"]) == 1 and float(lines["parents"][0][7]) > 6.49


def test_polygons_choose_files(spark, tmp_path):
    fmt = formats.parse_format("CUSTOM-0.5-4")
    write_tiles(tmp_path / "in", fmt, {(59.0, 6.0): np.ones((4, 4)), (59.0, 6.5): np.full((4, 4), 2.0), (59.0, 8.0): np.full((4, 4), 3.0)})
    ring = spark.createDataFrame([([{"lng": 6.6, "lat": 59.1}, {"lng": 6.8, "lat": 59.1}, {"lng": 6.7, "lat": 59.3}, {"lng": 6.6, "lat": 59.1}],)], "ring array<struct<lng: double, lat: double>>")
    chosen = raster.select_files(spark, fmt.name, str(tmp_path / "in"), ring)
    assert [c.rsplit("/", 1)[-1] for c in chosen] == [formats.file_name(fmt, 59.0, 6.5)]
    cells = raster.read_cells(spark, fmt.name, str(tmp_path / "in"), polygons=ring)
    assert {r.elev for r in cells.collect()} == {2.0} and len(cells.inputFiles()) == 1
    assert raster.read_cells(spark, fmt.name, str(tmp_path / "in"), polygons=ring.where("false")).count() == 0


def test_utm_tiles_to_prominence(spark, tmp_path, monkeypatch):
    """Tiles of a UTM format, here of fewer samples, come out in degrees."""
    from ridgeline.cli import main

    small = formats.Format("3DEP-1M", 12, 11, 1, utm=True)
    monkeypatch.setitem(formats.FORMATS, "3DEP-1M", small)
    grid = np.ones((12, 12), "<f4")
    grid[6, 6] = 700
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / formats.file_name(small, 415, 58, 10)).write_bytes(grid.tobytes())
    cells = raster.read_cells(spark, "3DEP-1M", str(tmp_path / "in"), zone=10).collect()
    high = [r for r in cells if r.elev == 700]
    metres = raster.grid_of("3DEP-1M", 10).metres
    assert metres == 1000 and len(cells) == 121 and len(high) == 1
    main(["prominence", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-f", "3DEP-1M", "-z", "10", "-m", "100", "--keep-spikes"], spark)
    (line,) = [x.value.split(",") for x in spark.read.text(str(tmp_path / "out")).collect()]
    at = geo.from_utm(F.lit(10), F.lit(high[0].gx * metres), F.lit(1e7 - high[0].gy * metres))
    want = spark.range(1).select(at["lat"].alias("lat"), at["lng"].alias("lng")).first()
    assert float(line[0]) == pytest.approx(want.lat, abs=1e-6) and float(line[1]) == pytest.approx(want.lng, abs=1e-6) and line[5] == "700.00"
    assert 580_000 <= high[0].gx * metres <= 590_000 and 4_150_000 <= 1e7 - high[0].gy * metres <= 4_160_000
