"""Raster scans: files to tiles and cells.

Files are read as whole binaries by Spark, so any store that Spark reads will
do, and each is decoded in the task that read it.  ``cells`` carry global
integer coordinates: gx grows eastward and gy southward from 180 W, 90 N (from
easting 0 and northing 10,000 km on a UTM grid), so neighbouring tiles need no
copies of each other's edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ridgeline.functions.crs import DegreeGrid, Grid, UtmGrid
from ridgeline.operators.polygon import tiles_in_polygons
from ridgeline.sources.formats import check_bounds, decode, file_name, parse_format, parse_name

TILES = "tile_id string, lat double, lng double, width int, height int, samples array<float>"
CELLS = "tile_id string, gx int, gy int, elev float"
#: UTM tiles are named in units of ten kilometres; northings end at a thousand of them.
UTM_METRES, UTM_UNITS = 10_000, 1_000


def tiles_of(boxes: DataFrame, fmt_name: str) -> DataFrame:
    """boxes (min_lat, max_lat, min_lng, max_lng, others) with a row for each tile in them, half-open: its lat, lng and file name; longitudes wrap at 180."""
    fmt = parse_format(fmt_name)
    steps = lambda low, high: F.filter(F.sequence(F.lit(0), F.ceil((F.col(high) - F.col(low)) / fmt.degrees).cast("int")), lambda k: F.col(low) + k * fmt.degrees < F.col(high))
    own = [c for c in boxes.columns if c not in ("min_lat", "max_lat", "min_lng", "max_lng")]
    at = boxes.withColumn("_i", F.explode(steps("min_lat", "max_lat"))).withColumn("_j", F.explode(steps("min_lng", "max_lng")))
    lng = F.col("min_lng") + F.col("_j") * fmt.degrees
    placed = at.select(*own, (F.col("min_lat") + F.col("_i") * fmt.degrees).alias("lat"), F.when(lng >= 180, lng - 360).otherwise(lng).alias("lng"))
    schema = StructType([*placed.schema.fields, StructField("name", StringType())])
    return placed.mapInPandas(lambda parts: (p.assign(name=[file_name(fmt, a, b) for a, b in zip(p["lat"], p["lng"], strict=True)]) for p in parts), schema)


def enumerate_tiles(spark: SparkSession, fmt_name: str, min_lat: float, max_lat: float, min_lng: float, max_lng: float) -> DataFrame:
    """(lat, lng, name) of all tiles in half-open bounds, which must be multiples of a tile's degrees."""
    check_bounds(parse_format(fmt_name), min_lat, max_lat, min_lng, max_lng)
    box = spark.createDataFrame([(float(min_lat), float(max_lat), float(min_lng), float(max_lng))], "min_lat double, max_lat double, min_lng double, max_lng double")
    return tiles_of(box, fmt_name)


def select_files(spark: SparkSession, fmt_name: str, path: str, polygons: DataFrame) -> list[str]:
    """Files of the format under path whose tile a polygon (ring) touches, found from their names alone; no content is read."""
    fmt = parse_format(fmt_name)

    def places(parts):
        for p in parts:
            found = [(f, parse_name(fmt, f.rsplit("/", 1)[-1])) for f in p["path"]]
            yield pd.DataFrame([(f, float(at[0]), float(at[1])) for f, at in found if at is not None], columns=["path", "lat", "lng"])

    listed = spark.read.format("binaryFile").load(path).select("path").mapInPandas(places, "path string, lat double, lng double")
    return [r["path"] for r in tiles_in_polygons(listed, polygons, fmt.degrees).select("path").orderBy("path").collect()]


def _files(spark: SparkSession, fmt_name: str, path: str, polygons: DataFrame | None = None) -> DataFrame:
    """The files' paths and contents; with polygons, those of tiles that they touch, and no others are opened."""
    if parse_format(fmt_name) is None:
        raise ValueError(f"unknown format {fmt_name}")
    chosen = path if polygons is None else select_files(spark, fmt_name, path, polygons)
    if not chosen:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(chosen).select("path", "content")


def read_tiles(spark: SparkSession, fmt_name: str, path: str) -> DataFrame:
    """A row per file of the format in path (TILES); no data is null in samples.  Other files are passed over."""
    fmt = parse_format(fmt_name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                name = r["path"].rsplit("/", 1)[-1]
                if (at := parse_name(fmt, name)) is None:
                    continue
                tile = decode(fmt, r["content"], *at)
                samples = pa.array(tile.ravel(), mask=np.isnan(tile.ravel()))
                lists = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), samples)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at[0]]), pa.array([at[1]]), pa.array([tile.shape[1]], pa.int32()), pa.array([tile.shape[0]], pa.int32()), lists], names=["tile_id", "lat", "lng", "width", "height", "samples"])

    return _files(spark, fmt_name, path).mapInArrow(work, TILES)


def grid_of(fmt_name: str, zone: int | None = None) -> Grid:
    """The grid of global coordinates that cells of a format are placed on: the whole earth in degrees, or a UTM zone's northern half."""
    fmt = parse_format(fmt_name)
    if fmt is None:
        raise ValueError(f"unknown format {fmt_name}")
    if not fmt.utm:
        return DegreeGrid(-90.0, -180.0, 90.0, 180.0, round(fmt.per_degree), round(fmt.per_degree))
    if zone is None or not 1 <= zone <= 60:
        raise ValueError(f"{fmt_name} tiles lie on a UTM grid; their zone, 1 to 60, must be given")
    return UtmGrid(zone, 0, 0, UTM_UNITS * UTM_METRES, UTM_UNITS * UTM_METRES, UTM_METRES / fmt.per_degree)


def read_cells(spark: SparkSession, fmt_name: str, path: str, flip: bool = False, scale: float = 1.0, zone: int | None = None, polygons: DataFrame | None = None) -> DataFrame:
    """A row per sample that has data (CELLS), on ``grid_of`` the format.  Overlapping edge samples occur once per tile.

    With polygons (ring), only tiles that one of them touches are read.
    """
    grid_of(fmt_name, zone)
    fmt = parse_format(fmt_name)
    per = fmt.per_degree
    west, north = (0, UTM_UNITS) if fmt.utm else (-180, 90)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                name = r["path"].rsplit("/", 1)[-1]
                if (at := parse_name(fmt, name)) is None:
                    continue
                tile = decode(fmt, r["content"], *at) * np.float32(-scale if flip else scale)
                x0, y0 = round((at[1] - west) * per), round((north - at[0] - fmt.degrees) * per)
                for row in range(len(tile)):
                    there = np.flatnonzero(~np.isnan(tile[row]))
                    if len(there):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(there)), pa.array((x0 + there).astype(np.int32)), pa.array(np.full(len(there), y0 + row, np.int32)), pa.array(tile[row][there])], names=["tile_id", "gx", "gy", "elev"])

    return _files(spark, fmt_name, path, polygons).mapInArrow(work, CELLS)


def explode_tiles(tiles: DataFrame, per_degree: float) -> DataFrame:
    """TILES to CELLS."""
    x0 = F.round((F.col("lng") + 180) * per_degree).cast("int")
    y0 = F.round((F.lit(90.0) - F.col("lat")) * per_degree).cast("int") - F.col("height")
    flat = tiles.select("tile_id", "width", x0.alias("x0"), y0.alias("y0"), F.posexplode("samples").alias("i", "elev")).where("elev is not null")
    return flat.select("tile_id", F.expr("x0 + i % width").cast("int").alias("gx"), F.expr("y0 + i div width").cast("int").alias("gy"), "elev")


def one_owner(cells: DataFrame) -> DataFrame:
    """Cells with each position once: of copies on shared edges, the one of the first tile by name."""
    return cells.groupBy("gx", "gy").agg(F.min(F.struct("tile_id", "elev")).alias("c")).select("c.tile_id", "gx", "gy", "c.elev")


def regrid(cells: DataFrame, factor: int, how: str = "max") -> DataFrame:
    """Coarser cells, each the maximum, minimum or mean of factor by factor cells."""
    pick = {"max": F.max, "min": F.min, "mean": F.avg}[how]
    return cells.groupBy(F.floor(F.col("gx") / factor).cast("int").alias("gx"), F.floor(F.col("gy") / factor).cast("int").alias("gy")).agg(pick("elev").cast("float").alias("elev"))
