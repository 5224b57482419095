"""Polygon predicates as expressions over rings (arrays of (lng, lat) structs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees across the cells under which polygons and points are filed.
CELL = 1.0


def edges(ring: Column) -> Column:
    """The ring's edges as structs (x1, y1, x2, y2), the last point joined to the first."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a["lng"].alias("x1"), a["lat"].alias("y1"), b["lng"].alias("x2"), b["lat"].alias("y2")))


def wrap_ring(ring: Column, west: float) -> Column:
    """Points west of the given longitude a full turn further east."""
    return F.transform(ring, lambda p: F.struct(F.when(p["lng"] < west, p["lng"] + 360).otherwise(p["lng"]).alias("lng"), p["lat"].alias("lat")))


def contains(ring: Column, lng: Column, lat: Column) -> Column:
    """Even-odd rule: a ray to the west crosses an odd number of edges."""

    def crosses(e: Column) -> Column:
        return (((e["y1"] < lat) & (e["y2"] >= lat)) | ((e["y2"] < lat) & (e["y1"] >= lat))) & (e["x1"] + F.try_divide(lat - e["y1"], e["y2"] - e["y1"]) * (e["x2"] - e["x1"]) < lng)

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments ab and cd meet; parallel ones don't."""
    turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    s = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), turn)
    t = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), turn)
    return F.coalesce((s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), F.lit(False))


def intersects_box(ring: Column, min_lng: Column, min_lat: Column, max_lng: Column, max_lat: Column) -> Column:
    """Whether the polygon and the box share a point: a corner inside, edges that cross, or a vertex in the box."""
    corners = [(min_lng, min_lat), (min_lng, max_lat), (max_lng, max_lat), (max_lng, min_lat)]
    inside = contains(ring, *corners[0])
    for c in corners[1:]:
        inside = inside | contains(ring, *c)

    def edge_crosses(e: Column) -> Column:
        found = F.lit(False)
        for (px, py), (qx, qy) in zip(corners, corners[1:] + corners[:1], strict=True):
            found = found | segments_cross(e["x1"], e["y1"], e["x2"], e["y2"], px, py, qx, qy)
        return found

    vertex = F.exists(ring, lambda p: (p["lng"] >= min_lng) & (p["lng"] <= max_lng) & (p["lat"] >= min_lat) & (p["lat"] <= max_lat))
    return inside | F.exists(edges(ring), edge_crosses) | vertex


def ring_bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["lng"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(xs).alias("min_lng"), F.array_min(ys).alias("min_lat"), F.array_max(xs).alias("max_lng"), F.array_max(ys).alias("max_lat"))


def _cells_of(bounds: Column, cell: float) -> Column:
    """Cells that the bounds touch, those that share only an edge or corner with them included."""
    low, high = lambda c: (F.ceil(c / cell) - 1).cast("int"), lambda c: F.floor(c / cell).cast("int")
    xs, ys = F.sequence(low(bounds["min_lng"]), high(bounds["max_lng"])), F.sequence(low(bounds["min_lat"]), high(bounds["max_lat"]))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def filter_points(points: DataFrame, polygons: DataFrame, wrap: float | None = None, invert: bool = False, cell: float = CELL) -> DataFrame:
    """points (lat, lng, ...) inside any polygon, or with invert outside all; without polygons every point is inside.

    Polygons are filed under the cells of their bounding boxes and points under
    their own, so a point is tested against polygons near it only.
    """
    if not polygons.limit(1).count():
        return points.limit(0) if invert else points
    ring = F.col("ring") if wrap is None else wrap_ring(F.col("ring"), wrap)
    lng = F.col("lng") if wrap is None else F.when(F.col("lng") < wrap, F.col("lng") + 360).otherwise(F.col("lng"))
    filed = polygons.select(ring.alias("_ring")).select("_ring", F.explode(_cells_of(ring_bounds(F.col("_ring")), cell)).alias("c")).select("_ring", "c.cx", "c.cy")
    at = points.withColumn("_lng", lng).withColumn("cx", F.floor(F.col("_lng") / cell).cast("int")).withColumn("cy", F.floor(F.col("lat") / cell).cast("int"))
    same = (at["cx"] == filed["cx"]) & (at["cy"] == filed["cy"]) & contains(filed["_ring"], at["_lng"], at["lat"])
    return at.join(filed, same, "left_anti" if invert else "left_semi").select(*points.columns)


def tiles_in_polygons(tiles: DataFrame, polygons: DataFrame, degrees: float) -> DataFrame:
    """tiles (lat, lng of the south-west corner) that a polygon touches."""
    filed = polygons.select("ring", F.explode(_cells_of(ring_bounds(F.col("ring")), degrees)).alias("c")).select("ring", "c.cx", "c.cy")
    at = tiles.withColumn("cx", F.floor(F.col("lng") / degrees + 1e-9).cast("int")).withColumn("cy", F.floor(F.col("lat") / degrees + 1e-9).cast("int"))
    same = (at["cx"] == filed["cx"]) & (at["cy"] == filed["cy"]) & intersects_box(filed["ring"], at["lng"], at["lat"], at["lng"] + degrees, at["lat"] + degrees)
    return at.join(filed, same, "left_semi").select(*tiles.columns)
