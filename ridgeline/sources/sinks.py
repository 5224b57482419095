"""Text outputs: result lines, divide trees and KML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.crs import Grid


def prominence_lines(peaks: DataFrame, grid: Grid, scale: float = 1.0) -> DataFrame:
    """lat,lng,elevation,saddle lat,saddle lng,prominence; the saddle is 0,0 if there is none."""
    lat, lng = grid.position(F.col("gx"), F.col("gy"))
    s_lat, s_lng = grid.position(F.col("saddle_x"), F.col("saddle_y"))
    return peaks.select(F.format_string("%.6f,%.6f,%.2f,%.6f,%.6f,%.2f", lat, lng, (F.col("elev") * scale).cast("double"), F.coalesce(s_lat, F.lit(0.0)), F.coalesce(s_lng, F.lit(0.0)), (F.col("prominence") * scale).cast("double")).alias("line"))


def isolation_lines(found: DataFrame, grid: Grid, keep: str | None = None) -> DataFrame:
    """lat,lng,elevation,higher lat,higher lng,km; 0,0 and -1 if nothing is higher.  With keep, beside that column."""
    lat, lng = grid.position(F.col("gx"), F.col("gy"))
    h_lat, h_lng = grid.position(F.col("higher_x"), F.col("higher_y"))
    return found.select(*([keep] if keep else []), F.format_string("%.4f,%.4f,%.2f,%.4f,%.4f,%.4f", lat, lng, F.col("elev").cast("double"), F.coalesce(h_lat, F.lit(0.0)), F.coalesce(h_lng, F.lit(0.0)), F.coalesce(F.col("isolation_km"), F.lit(-1.0))).alias("line"))


def isolation_file_name(lat, lng):
    return F.format_string("isolation-%02d-%03d.txt", lat.cast("int"), lng.cast("int"))


def isolation_tiles(found: DataFrame, grid: Grid) -> DataFrame:
    """(file, line): isolation_lines, each with the name of its one-degree tile's file."""
    lat, lng = grid.position(F.col("gx"), F.col("gy"))
    named = found.select(isolation_file_name(F.floor(lat), F.floor(lng)).alias("file"), *found.columns)
    return isolation_lines(named, grid, keep="file")


def write_isolation_tiles(lines: DataFrame, path: str) -> None:
    """One file a tile, in a folder of its name; lines are in order.  A tile's lines go to one task, no others do."""
    lines.repartition("file").sortWithinPartitions("file", "line").write.mode("overwrite").partitionBy("file").text(path)


def parent_lines(rows: DataFrame) -> DataFrame:
    """Twelve fields: the peak, its saddle, elevation and prominence, the prominence parent and its prominence, the line parent and its elevation.

    rows: lat, lng, saddle_lat, saddle_lng, elev, prominence, parent_lat,
    parent_lng, parent_prominence, line_lat, line_lng, line_elev.  Peaks
    without a parent get zeros.
    """
    names = ["lat", "lng", "saddle_lat", "saddle_lng", "elev", "prominence", "parent_lat", "parent_lng", "parent_prominence", "line_lat", "line_lng", "line_elev"]
    return rows.select(F.format_string("%.4f,%.4f,%.4f,%.4f,%.2f,%.2f,%.4f,%.4f,%.2f,%.4f,%.4f,%.2f", *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names)).alias("line"))


def dvt_lines(grid: Grid, tables: dict[str, DataFrame]) -> DataFrame:
    """(part, id, line): a divide tree's lines in the order of part and id; tables by tag P, S, R, N, E."""
    spark = next(iter(tables.values())).sparkSession
    forms = {
        "P": ("peak_id", "P,%d,%d,%d,%.2f", ["peak_id", "x", "y", "elev"]),
        "S": ("saddle_id", "S,%d,%s,%d,%d,%.2f", ["saddle_id", "type", "x", "y", "elev"]),
        "R": ("runoff_id", "R,%d,%d,%d,%.2f,%d,%d", ["runoff_id", "x", "y", "elev", "quadrants", "inside_peak"]),
        "N": ("peak_id", "N,%d,%d,%d", ["peak_id", "parent_id", "saddle_id"]),
        "E": ("runoff_id", "E,%d,%d", ["runoff_id", "peak_id"]),
    }
    out = spark.createDataFrame([(0, 0, grid.line())], "part int, id long, line string")
    for part, (tag, (key, form, names)) in enumerate(forms.items(), 1):
        if tag in tables:
            columns = [F.col(n).cast("double") if n == "elev" else F.col(n) for n in names]
            out = out.union(tables[tag].select(F.lit(part), F.col(key).cast("long"), F.format_string(form, *columns)))
    return out


def write_divide_tree(grid: Grid, tables: dict[str, DataFrame], path: str) -> None:
    """One ordered text file per tree; trees are pruned and small."""
    dvt_lines(grid, tables).orderBy("part", "id").select("line").coalesce(1).write.mode("overwrite").text(path)


def kml_placemarks(peaks: DataFrame, grid: Grid, folder: str = "Peaks") -> DataFrame:
    """(folder, line): a placemark per row of peaks (gx, gy, elev)."""
    lat, lng = grid.position(F.col("gx"), F.col("gy"))
    return peaks.select(F.lit(folder).alias("folder"), F.format_string("<Placemark><name>%.2f</name><Point><coordinates>%.6f,%.6f</coordinates></Point></Placemark>", F.col("elev").cast("double"), lng, lat).alias("line"))


def kml_edges(edges: DataFrame, grid: Grid, folder: str = "Edges") -> DataFrame:
    """edges: x1, y1, x2, y2."""
    a_lat, a_lng = grid.position(F.col("x1"), F.col("y1"))
    b_lat, b_lng = grid.position(F.col("x2"), F.col("y2"))
    return edges.select(F.lit(folder).alias("folder"), F.format_string("<Placemark><LineString><coordinates>%.6f,%.6f %.6f,%.6f</coordinates></LineString></Placemark>", a_lng, a_lat, b_lng, b_lat).alias("line"))


def write_kml(placemarks: DataFrame, path: str) -> None:
    """One file: placemarks in their folders."""
    spark = placemarks.sparkSession
    names = [r["folder"] for r in placemarks.select("folder").distinct().orderBy("folder").collect()]
    frame = [(0, "", '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), (2, "", "</Document></kml>")]
    frame += [(1, n, f"<Folder><name>{n}</name>") for n in names] + [(1, n + "￿", "</Folder>") for n in names]
    edge = spark.createDataFrame(frame, "part int, key string, line string")
    body = placemarks.select(F.lit(1).alias("part"), F.concat("folder", F.lit("\u0001")).alias("key"), "line")
    edge.union(body).orderBy("part", "key", "line").select("line").coalesce(1).write.mode("overwrite").text(path)
