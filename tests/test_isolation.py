"""The zone pyramid of isolation: bounds hold, and rows met for a peak don't grow with the map."""

import math

import numpy as np
from pyspark.sql import functions as F

from ridgeline.operators import isolation, stencil
from ridgeline.plans.scratch import Scratch
from tests.test_terrain import cells_of


def great_circle(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371010.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def test_distance_to_a_box_is_its_nearest_point(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        south = float(rng.uniform(-90, 88))
        size = float(rng.choice([0.5, 5, 40, 180]))
        rows.append((float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), south, min(90.0, south + size), float(rng.uniform(-180, 180)), min(360.0, size * float(rng.uniform(0.2, 2)))))
    rows += [(0.0, 0.0, 1.0, 2.0, -1.0, 2.0), (89.9, 170.0, 80.0, 90.0, -10.0, 5.0), (-45.0, 179.9, -46.0, -44.0, -180.0, 1.0), (10.0, 5.0, 0.0, 20.0, 0.0, 360.0)]
    table = spark.createDataFrame(rows, "_lat double, _lng double, _south double, _north double, _west double, _width double")
    for r in isolation.with_box_distance(table, "d").collect():
        lat, lng = np.meshgrid(np.linspace(r._south, r._north, 60), r._west + np.linspace(0, r._width, 60))
        near = great_circle(r._lat, r._lng, lat, lng).min()
        assert r.d <= near * (1 + 1e-9) + 1e-6
        step = 111_200 * max(r._north - r._south, r._width) / 59
        assert near - r.d <= step, r


def test_rows_met_for_a_peak_stay_flat_as_the_map_grows(spark, monkeypatch):
    met = {}
    keep = Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        if set(out.columns) == {"gx", "gy", "elev", "bx", "by"} and "isolation" in self.root:
            met[size] = met.get(size, 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    rng = np.random.default_rng(5)
    each = {}
    for size in (32, 128):
        cells = cells_of(spark, rng.permutation(size * size).reshape(size, size).astype(float))
        peaks = stencil.candidate_peaks(cells)
        found = isolation.isolation(peaks, cells, 8)
        met[size] -= size * size  # the cells themselves, kept once
        assert found.where("distance is null").count() == 1
        each[size] = met[size] / peaks.count() / (math.log2(size / 8) + 1)  # a level of the pyramid
    assert each[128] < 1.4 * each[32]


def test_map_without_higher_ground(spark):
    flat = spark.createDataFrame([(1, 2, 5.0), (40, 2, 5.0)], "gx int, gy int, elev double")
    assert [r.distance for r in isolation.isolation(flat, flat, 4).collect()] == [None, None]
    assert isolation.isolation(flat.limit(0), flat, 4).count() == 0
    assert [r.isolation_km for r in isolation.geographic_isolation(flat, flat.where(F.col("gx") == 1), 1.0).collect()] == [None, None]
    assert isolation.geographic_isolation(flat.limit(0), flat.limit(0), 1.0).count() == 0


def test_a_file_a_tile(spark, tmp_path):
    from ridgeline.functions import crs
    from ridgeline.sources import sinks, text

    rows = [(0, 0, 9.0, None, None, None), (3, 1, 7.0, 0, 0, 2.5), (9, 9, 5.0, 3, 1, 1.5), (9, 10, 4.0, 3, 1, 1.25)]
    found = spark.createDataFrame(rows, "gx int, gy int, elev double, higher_x int, higher_y int, isolation_km double")
    sinks.write_isolation_tiles(sinks.isolation_tiles(found, crs.DegreeGrid(58.0, -6.0, 60.0, -4.0, 8, 8)), str(tmp_path / "out"))
    folders = sorted(p.name for p in (tmp_path / "out").glob("file=*"))
    assert folders == ["file=isolation-58--05.txt", "file=isolation-59--06.txt", "file=isolation-60--06.txt"]
    assert all(len(list((tmp_path / "out" / f).glob("part-*"))) == 1 for f in folders)
    assert sorted(r.isolation_km for r in text.read_isolation(spark, str(tmp_path / "out" / folders[0])).collect()) == [1.25, 1.5]
