"""Terrain operators: against SQL, against brute force on random rasters, and on hand-drawn ones."""

import io
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import queries
from ridgeline.functions import crs, geo
from ridgeline.operators import isolation, prominence, stencil
from ridgeline.sources import formats, raster, sinks, text

SF = "/root/testdata/sf0.001"


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "customer", "events", "nation"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert normal([tuple(r) for r in found.collect()], found.columns) == normal(want.fetchall(), columns)


def cells_of(spark, grid):
    rows = [(int(x), int(y), float(grid[y, x])) for y in range(grid.shape[0]) for x in range(grid.shape[1]) if not np.isnan(grid[y, x])]
    return spark.createDataFrame(rows, "gx int, gy int, elev double")


def flood(grid):
    """Prominence by lowering the level: peaks are first cells of plateaus, the later of two equal tops is higher."""
    h, w = grid.shape
    cells = [(y, x) for y in range(h) for x in range(w) if not np.isnan(grid[y, x])]
    near = lambda y, x: [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= y + a < h and 0 <= x + b < w and not np.isnan(grid[y + a, x + b])]
    out, first = {}, {}
    for c in cells:  # in row order: a plateau's first cell names it
        todo = [] if c in first else [c]
        while todo:
            p = todo.pop()
            first[p] = c
            todo += [n for n in near(*p) if grid[n] == grid[c] and n not in first]
    for y, x in cells:
        e = grid[y, x]
        plateau, todo, peak = {(y, x)}, [(y, x)], True
        while todo:
            for n in near(*todo.pop()):
                if grid[n] > e:
                    peak = False
                elif grid[n] == e and n not in plateau:
                    plateau.add(n)
                    todo.append(n)
        if not peak or min(plateau) != (y, x):
            continue
        met = None
        for level in sorted({grid[c] for c in cells if grid[c] <= e}, reverse=True):
            seen, todo = set(plateau), list(plateau)
            while todo:
                for n in near(*todo.pop()):
                    if n not in seen and grid[n] >= level:
                        seen.add(n)
                        todo.append(n)
            if any((grid[c], first[c]) > (e, (y, x)) for c in seen):
                met = level
                break
        value = e - (met if met is not None else 0)
        if value > 0:
            out[x, y] = value
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 32), (2, 4), (3, 3), (4, 5), (5, 2)])
def test_prominence_equals_flooding_under_any_tiling(spark, seed, block):
    rng = np.random.default_rng(seed)
    grid = rng.integers(1, 9, (11, 13)).astype(float)
    grid[rng.random(grid.shape) < 0.1] = np.nan
    found = prominence.prominence(cells_of(spark, grid), block).collect()
    assert {(r.gx, r.gy): r.prominence for r in found} == flood(grid)


def test_parents_climb(spark):
    grid = np.array([[1, 1, 1, 1, 1, 1, 1, 1, 1], [1, 9, 5, 7, 3, 8, 2, 6, 1], [1, 1, 1, 1, 1, 1, 1, 1, 1]], float)
    found = {r.gx: r for r in prominence.parents(cells_of(spark, grid), 4).collect()}
    assert {x: r.prominence for x, r in found.items()} == {1: 9, 3: 2, 5: 5, 7: 4}
    assert {x: r.line_x for x, r in found.items()} == {1: None, 3: 1, 5: 1, 7: 5}
    assert {x: r.parent_x for x, r in found.items()} == {1: None, 3: 1, 5: 1, 7: 5}


@pytest.mark.parametrize("block", [2, 5, 40])
def test_isolation_equals_brute_force(spark, block):
    rng = np.random.default_rng(7)
    grid = rng.integers(1, 30, (14, 17)).astype(float)
    cells = cells_of(spark, grid)
    found = {(r.gx, r.gy): (r.higher_x, r.higher_y) for r in isolation.isolation(stencil.candidate_peaks(cells), cells, block).collect()}
    for (x, y), got in found.items():
        higher = [((a - x) ** 2 + (b - y) ** 2, b, a) for b in range(14) for a in range(17) if grid[b, a] > grid[y, x]]
        assert got == ((min(higher)[2], min(higher)[1]) if higher else (None, None))


def test_geographic_isolation_wraps(spark):
    rows = [(0, 90, 5.0), (359, 90, 9.0), (20, 90, 9.0), (180, 30, 7.0)]
    cells = spark.createDataFrame(rows, "gx int, gy int, elev double")
    found = {r.gx: r for r in isolation.geographic_isolation(cells, cells, 1.0, 5.0).collect()}
    assert found[0].higher_x == 359 and found[0].isolation_km == pytest.approx(111.32, abs=0.05)
    assert found[359].isolation_km is None and found[180].higher_x in (20, 359)


def test_spikes_in_order(spark):
    grid = np.array([[0.0, 2000, 3500, 0]])
    assert sorted(r.gx for r in stencil.despike(cells_of(spark, grid), 1000).collect()) == [0, 3]
    # The first spike goes, so the second is only seen against what is left.
    assert sorted(r.gx for r in stencil.despike_in_order(cells_of(spark, grid), 1000, 8).collect()) == [0, 3]
    grid = np.array([[0.0, 2000, 3500]])
    assert sorted(r.gx for r in stencil.despike_in_order(cells_of(spark, grid), 1000, 8).collect()) == [0, 2]


def test_utm_of_a_known_place(spark):
    """On a central meridian the northing is the scaled meridian arc, 4,429,529.03 m at 40 degrees."""
    u = geo.to_utm(F.lit(40.0), F.lit(-105.0))
    south = geo.to_utm(F.lit(-40.0), F.lit(-105.0))
    r = spark.range(1).select(u["zone"].alias("zone"), u["easting"].alias("e"), u["northing"].alias("n"), south["northing"].alias("s")).first()
    assert r.zone == 13 and r.e == pytest.approx(500000, abs=0.01)
    assert r.n == pytest.approx(0.9996 * 4429529.03, abs=0.02) and r.s == pytest.approx(1e7 - 0.9996 * 4429529.03, abs=0.02)


def test_scans_refuse_utm_formats(spark, tmp_path):
    with pytest.raises(ValueError, match="UTM"):
        raster.read_cells(spark, "3DEP-1M", str(tmp_path))


def test_equal_points_have_no_distance(spark):
    r = spark.range(1).select(geo.ellipsoid_m(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("a"), geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b")).first()
    assert r.a == 0 and r.b == pytest.approx(111194.9, abs=1)


@pytest.mark.parametrize("name", ["SRTM", "SRTM30", "NED1-ZIP", "NED13", "NED19", "3DEP-1M", "GLO30", "FABDEM", "CUSTOM-0.5-10"])
def test_file_names_read_back(name):
    fmt = formats.parse_format(name)
    for lat, lng in ((59, 6), (12, -106)) if name != "3DEP-1M" else ((415, 58),):
        assert formats.parse_name(fmt, formats.file_name(fmt, lat, lng, 10)) == (lat, lng)


def test_format_names():
    assert formats.parse_format("LIDAR") is None and formats.parse_format("CUSTOM-0.3-10") is None and formats.parse_format("CUSTOM-0.5-x") is None
    assert formats.file_name(formats.FORMATS["NED19"], 59, 6) == "ned19_n59x25_e006x00.flt"
    assert formats.file_name(formats.parse_format("CUSTOM-0.1-10"), 59, 6) == "tile_59x10_006x00.flt"
    with pytest.raises(ValueError, match="multiple"):
        formats.check_bounds(formats.FORMATS["SRTM"], 1.5)


def test_decoding():
    srtm = np.zeros((1201, 1201), ">i2")
    srtm[0, 1], srtm[2, 3] = -32768, 300
    out = formats.decode(formats.FORMATS["SRTM"], srtm.tobytes())
    assert np.isnan(out[0, 1]) and out[2, 3] == 300
    with pytest.raises(ValueError, match="bytes"):
        formats.decode(formats.FORMATS["SRTM"], b"12")
    ned = np.arange(3612 * 3612, dtype="<f4").reshape(3612, 3612)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("floatn60e006_1.flt", ned.tobytes())
    out = formats.decode(formats.FORMATS["NED1-ZIP"], held.getvalue(), 59, 6)
    assert out.shape == (3601, 3601) and out[0, 0] == ned[6, 6]
    glo = np.tile(np.array([1, 2], "<f4"), (3600, 1200))
    assert formats.decode(formats.FORMATS["GLO30"], glo.tobytes(), 55, 6)[0, :6].tolist() == [1, 1, 2, 1, 1, 2]


def test_raster_scan(spark, tmp_path):
    fmt = formats.parse_format("CUSTOM-0.5-4")
    west, east = np.arange(16, dtype="<f4"), np.arange(16, dtype="<f4") + 100
    west[5] = -9999
    for grid, lng in ((west, 6.0), (east, 6.5)):
        (tmp_path / formats.file_name(fmt, 59.0, lng)).write_bytes(grid.tobytes())
    (tmp_path / "other.txt").write_text("no tile")
    cells = raster.read_cells(spark, fmt.name, str(tmp_path)).collect()
    assert len(cells) == 31 and {r.elev for r in cells} == {float(v) for v in range(16) if v != 5} | {float(v) for v in range(100, 116)}
    assert max(r.gx for r in cells) - min(r.gx for r in cells) == 7
    tiles = raster.read_tiles(spark, fmt.name, str(tmp_path))
    again = raster.explode_tiles(tiles, fmt.per_degree).collect()
    assert {(r.gx, r.gy, r.elev) for r in again} == {(r.gx, r.gy, r.elev) for r in cells}


def test_divide_tree_round_trip(spark, tmp_path):
    grid = crs.DegreeGrid(1.0, 2.0, 3.0, 4.0, 10, 10)
    tables = {
        "P": spark.createDataFrame([(1, 2, 3, 4.25)], text.DVT["P"]), "S": spark.createDataFrame([(1, "p", 2, 3, 1.5)], text.DVT["S"]), "R": spark.createDataFrame([(0, 0, 0, 1.0, 2, 1)], text.DVT["R"]),
        "N": spark.createDataFrame([(0, -1, -1), (1, -1, -1)], text.DVT["N"]), "E": spark.createDataFrame([(0, 1)], text.DVT["E"]),
    }
    sinks.write_divide_tree(grid, tables, str(tmp_path / "t.dvt"))
    back, found = text.read_divide_tree(spark, str(tmp_path / "t.dvt"))
    assert back == grid and all(found[t].collect() == tables[t].collect() for t in tables)
    (tmp_path / "bad.dvt").write_text(grid.line() + "\nP,1,2\n")
    with pytest.raises(ValueError, match="number of fields"):
        text.read_divide_tree(spark, str(tmp_path / "bad.dvt"))
    assert crs.parse_line("U,10,0,0,5,5,1.5") == crs.UtmGrid(10, 0, 0, 5, 5, 1.5) and crs.parse_line("X,1") is None
    with pytest.raises(ValueError, match="merged"):
        grid.merge(crs.UtmGrid(10, 0, 0, 5, 5, 1.0))
    assert grid.merge(crs.DegreeGrid(0.0, 5.0, 1.0, 6.0, 10, 10)) == crs.DegreeGrid(0.0, 2.0, 3.0, 6.0, 10, 10)


def test_kml_and_points(spark, tmp_path):
    (tmp_path / "p.kml").write_text("<kml><coordinates>\n1,2,0 3,2,0\n 3,4,0 1,2,0 </coordinates></kml>")
    ring = text.read_kml_polygons(spark, str(tmp_path / "p.kml")).first().ring
    assert [(p.lng, p.lat) for p in ring] == [(1, 2), (3, 2), (3, 4), (1, 2)]
    (tmp_path / "p.txt").write_text("# c\n\n1.5,2.5,x\nbad\n3,4\n")
    assert [(r.lat, r.lng, r.line) for r in text.read_points(spark, str(tmp_path / "p.txt")).collect()] == [(1.5, 2.5, "1.5,2.5,x"), (3.0, 4.0, "3,4")]
    peaks = spark.createDataFrame([(1, 2, 3.0)], "gx int, gy int, elev double")
    sinks.write_kml(sinks.kml_placemarks(peaks, crs.DegreeGrid(0.0, 0.0, 1.0, 1.0, 10, 10)), str(tmp_path / "out"))
    assert "<name>3.00</name>" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_command_line(spark, tmp_path):
    from ridgeline.cli import main

    fmt = formats.parse_format("CUSTOM-0.5-8")
    rng = np.random.default_rng(3)
    (tmp_path / "in").mkdir()
    for lng in (6.0, 6.5):
        (tmp_path / "in" / formats.file_name(fmt, 59.0, lng)).write_bytes(rng.integers(1, 900, (8, 8)).astype("<f4").tobytes())
    lines = {}
    for program in ("prominence", "isolation", "parents"):
        main([program, "-i", str(tmp_path / "in"), "-o", str(tmp_path / program), "-f", fmt.name, "-m", "50" if program != "isolation" else "1"], spark)
        lines[program] = [x.value for x in spark.read.text(str(tmp_path / program)).collect()]
    assert {len(x.split(",")) for x in lines["prominence"]} == {6} and {len(x.split(",")) for x in lines["parents"]} == {12}
    assert sum(x.endswith(",-1.0000") for x in lines["isolation"]) >= 1
    (tmp_path / "p.kml").write_text("<coordinates>6,59 6.5,59 6.5,59.6 6,59.6 6,59</coordinates>")
    main(["filter", str(tmp_path / "p.kml"), str(tmp_path / "prominence"), str(tmp_path / "inside")], spark)
    inside = [x.value for x in spark.read.text(str(tmp_path / "inside")).collect()]
    assert 0 < len(inside) < len(lines["prominence"]) and set(inside) < set(lines["prominence"])
