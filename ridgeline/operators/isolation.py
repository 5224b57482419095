"""Isolation: the distance from a peak to the nearest strictly higher ground.

Cells are grouped into square blocks, blocks into zones of two by two, and so
on up to one zone for the whole map; each knows its highest cell.  A peak goes
down this pyramid from the top.  Of the zones that hold higher ground it keeps
those that may be as near as the nearest highest cell of any of them, and looks
at their parts next; only in the last blocks does it meet cells.  So the rows
met for a peak go with the shape of the ground around it and with the
logarithm of the map, not with its area.

Zones are met by equi-joins on zone keys, all peaks at a level at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.plans.scratch import Scratch

#: A level of so many zones (counted) is broadcast: its keys are few and each is met by many peaks.
FEW = 1 << 16
#: What rounding may add to a bound.
SLACK = 1 - 1e-9


def planar(dx: Column, dy: Column) -> Column:
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def pyramid(cells: DataFrame, block: int, scratch: Scratch) -> list[DataFrame]:
    """(bx, by, top, tx, ty, size) of all zones, level by level: the highest elevation, its first cell in row order, and the cells across; the last level has one zone."""
    high = lambda e, y, x: F.max(F.struct(F.col(e).alias("top"), (-F.col(y)).alias("y"), (-F.col(x)).alias("x"))).alias("m")
    columns = ["bx", "by", F.col("m.top").alias("top"), (-F.col("m.x")).alias("tx"), (-F.col("m.y")).alias("ty")]
    levels = [scratch.keep(cells.groupBy("bx", "by").agg(high("elev", "gy", "gx")).select(*columns, F.lit(block).cast("long").alias("size")))]
    while levels[-1].count() > 1:
        up = levels[-1].groupBy(F.floor(F.col("bx") / 2).cast("int").alias("bx"), F.floor(F.col("by") / 2).cast("int").alias("by"))
        levels.append(scratch.keep(up.agg(high("top", "ty", "tx")).select(*columns, F.lit(block << len(levels)).cast("long").alias("size"))))
    return levels


def _descend(peaks: DataFrame, cells: DataFrame, block: int, distance: Callable[[str, str], Column], bound: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """peaks (gx, gy, elev) plus m (d, y, x): the nearest higher cell, null if there is none.

    distance: from a row's peak to the cell in two columns; bound: adds
    _least, what it is from a row's peak to the zone (bx, by) of size cells
    across, or less.  The size is a column, so one generated program serves
    all levels.
    """
    at = scratch.keep(cells.select("gx", "gy", "elev", F.floor(F.col("gx") / block).cast("int").alias("bx"), F.floor(F.col("gy") / block).cast("int").alias("by")))
    levels = pyramid(at, block, scratch)
    open_ = scratch.keep(peaks.select("gx", "gy", "elev"))
    of_peak = W.partitionBy("gx", "gy", "elev")

    def nearer(met: DataFrame) -> DataFrame:
        seen = bound(met.where("top > elev")).withColumn("_most", distance("tx", "ty"))
        return scratch.keep(seen.withColumn("_best", F.min("_most").over(of_peak)).where(F.col("_least") * SLACK <= F.col("_best")).select("gx", "gy", "elev", "bx", "by"))

    zones = lambda level: F.broadcast(levels[level]) if levels[level].count() <= FEW else levels[level]
    left = nearer(open_.join(F.broadcast(levels[-1])))  # one zone
    for level in range(len(levels) - 2, -1, -1):
        parts = F.explode(F.array(*(F.struct((F.col("bx") * 2 + i).alias("bx"), (F.col("by") * 2 + j).alias("by")) for j in (0, 1) for i in (0, 1)))).alias("p")
        left = nearer(left.select("gx", "gy", "elev", parts).select("gx", "gy", "elev", "p.bx", "p.by").join(zones(level), ["bx", "by"]))
    there = at.select("bx", "by", F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("elev").alias("e"))
    seen = left.join(there, ["bx", "by"]).where("e > elev")
    nearest = seen.groupBy("gx", "gy", "elev").agg(F.min(F.struct(distance("x", "y").alias("d"), F.col("y").alias("y"), F.col("x").alias("x"))).alias("m"))
    return scratch.keep(open_.join(nearest, ["gx", "gy", "elev"], "left"))


def isolation(peaks: DataFrame, cells: DataFrame, block: int = 16) -> DataFrame:
    """(gx, gy, elev, higher_x, higher_y, distance) in cells, on a plane; nulls if nothing is higher.  Ties go to the first cell in row order."""
    distance = lambda x, y: planar(F.col(x) - F.col("gx"), F.col(y) - F.col("gy"))

    size = F.col("size")
    off = lambda zone, c: F.greatest(F.col(zone) * size - F.col(c), F.col(c) - (F.col(zone) + 1) * size + 1, F.lit(0))
    bound = lambda met: met.withColumn("_least", planar(off("bx", "gx"), off("by", "gy")))
    found = _descend(peaks, cells, block, distance, bound, Scratch(cells.sparkSession, "isolation"))
    return found.select("gx", "gy", "elev", F.col("m.x").alias("higher_x"), F.col("m.y").alias("higher_y"), F.col("m.d").alias("distance"))


def with_box_distance(rows: DataFrame, name: str) -> DataFrame:
    """rows plus metres by great circle from (_lat, _lng) to a box: from _south to _north, and from _west so many degrees (_width) eastward.

    Inside the box's longitudes the way is along the point's own meridian;
    outside, it ends on the box's western or eastern side, whose nearest point
    is the foot of the perpendicular or, beyond the ends, the end nearer to it.
    """
    lat, lng, south, north = (F.col(c) for c in ("_lat", "_lng", "_south", "_north"))
    sides = {"w": F.col("_west"), "e": F.col("_west") + F.col("_width")}
    foot = {f"_foot_{k}": F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(F.radians(edge - lng)))) for k, edge in sides.items()}
    end = lambda f: F.when(f.between(south, north), f).when(F.cos(F.radians(f - south)) >= F.cos(F.radians(f - north)), south).otherwise(north)
    met = rows.withColumns(foot).withColumns({f"_end_{k}": end(F.col(f"_foot_{k}")) for k in sides})
    met = met.withColumns({f"_way_{k}": geo.haversine_m(lat, lng, F.col(f"_end_{k}"), edge) for k, edge in sides.items()})
    straight = F.radians(F.abs(lat - F.greatest(south, F.least(north, lat)))) * geo.EARTH_RADIUS_M
    return met.withColumn(name, F.when(F.pmod(lng - F.col("_west"), F.lit(360.0)) <= F.col("_width"), straight).otherwise(F.least("_way_w", "_way_e")))


def geographic_isolation(peaks: DataFrame, cells: DataFrame, per_degree: float, block_degrees: float = 0.25) -> DataFrame:
    """(gx, gy, elev, higher_x, higher_y, isolation_km) on the globe, gx from 180 W and gy from 90 N.

    The nearest ground by great circle, ties to the first cell in row order;
    the distance reported is the ellipsoid's.  Longitudes wrap.
    """
    block = max(1, round(block_degrees * per_degree))
    place = lambda x, y: (geo.lat_of(F.col(y), 90.0, per_degree), geo.lng_of(F.col(x), -180.0, per_degree))
    lat, lng = place("gx", "gy")

    across, inner = F.col("size") / F.lit(float(per_degree)), (F.col("size") - 1) / F.lit(float(per_degree))

    def bound(met: DataFrame) -> DataFrame:
        north = F.lit(90.0) - F.col("by") * across
        box = {"_north": F.least(north, F.lit(90.0)), "_south": F.greatest(north - inner, F.lit(-90.0)), "_west": F.col("bx") * across - 180.0, "_width": F.least(inner, F.lit(360.0))}
        return with_box_distance(met.withColumns({"_lat": lat, "_lng": lng, **box}), "_least")

    found = _descend(peaks, cells, block, lambda x, y: geo.haversine_m(lat, lng, *place(x, y)), bound, Scratch(cells.sparkSession, "geographic-isolation"))
    far = place("m.x", "m.y")
    return found.select("gx", "gy", "elev", F.col("m.x").alias("higher_x"), F.col("m.y").alias("higher_y"), (geo.ellipsoid_m(lat, lng, *far) / 1000).alias("isolation_km"))


def at_least(found: DataFrame, minimum: float, column: str = "isolation_km") -> DataFrame:
    """Isolations over the minimum, and those without bound."""
    return found.where(F.col(column).isNull() | (F.col(column) > minimum))


def candidate_tiles(peaks: DataFrame, tiles: DataFrame, metres: Column) -> DataFrame:
    """(peak_id, tile_id): one-degree tiles (lat, lng of the south-west corner, max_elev) that a cap of so many metres around a peak touches and that may hold higher ground."""
    box = geo.cap_bounds(F.col("lat"), F.col("lng"), metres)
    at = peaks.select("peak_id", "elev", box.alias("b")).select("peak_id", "elev", F.floor("b.min_lat").cast("int").alias("s"), F.floor("b.max_lat").cast("int").alias("n"), F.floor("b.min_lng").cast("int").alias("w"), (F.floor("b.max_lng") + F.when(F.col("b.max_lng") < F.col("b.min_lng"), 360).otherwise(0)).cast("int").alias("e"))
    each = at.select("peak_id", "elev", F.explode(F.sequence("s", "n")).alias("lat"), F.sequence("w", "e").alias("lngs")).select("peak_id", "elev", "lat", F.explode("lngs").alias("lng"))
    wrapped = each.withColumn("lng", (F.pmod(F.col("lng") + 180, F.lit(360)) - 180).cast("int")).distinct()
    return wrapped.join(tiles, ["lat", "lng"]).where("max_elev > elev").select("peak_id", "tile_id")
