"""Coordinate systems of rasters: degree grids and UTM grids, their text lines, union and offsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geo


@dataclass(frozen=True)
class DegreeGrid:
    min_lat: float
    min_lng: float
    max_lat: float
    max_lng: float
    per_lat: int
    per_lng: int

    def line(self) -> str:
        return f"G,{self.min_lat:f},{self.min_lng:f},{self.per_lat},{self.per_lng},{self.max_lat:f},{self.max_lng:f}"

    def compatible(self, other) -> bool:
        return isinstance(other, DegreeGrid) and (self.per_lat, self.per_lng) == (other.per_lat, other.per_lng)

    def merge(self, other: DegreeGrid) -> DegreeGrid:
        if not self.compatible(other):
            raise ValueError("grids of different kinds or resolutions can't be merged")
        return DegreeGrid(min(self.min_lat, other.min_lat), min(self.min_lng, other.min_lng), max(self.max_lat, other.max_lat), max(self.max_lng, other.max_lng), self.per_lat, self.per_lng)

    def offset_to(self, other: DegreeGrid) -> tuple[int, int]:
        """What to add to pixels of this grid to get pixels of the other."""
        return _round((self.min_lng - other.min_lng) * self.per_lng), _round((other.max_lat - self.max_lat) * self.per_lat)

    @property
    def around(self) -> int:
        return 360 * self.per_lng

    def position(self, x: Column, y: Column) -> tuple[Column, Column]:
        return geo.lat_of(y, self.max_lat, self.per_lat), geo.lng_of(x, self.min_lng, self.per_lng)


@dataclass(frozen=True)
class UtmGrid:
    zone: int
    min_x: int
    min_y: int
    max_x: int
    max_y: int
    metres: float

    def line(self) -> str:
        return f"U,{self.zone},{self.min_x},{self.min_y},{self.max_x},{self.max_y},{self.metres:f}"

    def compatible(self, other) -> bool:
        return isinstance(other, UtmGrid) and (self.zone, self.metres) == (other.zone, other.metres)

    def merge(self, other: UtmGrid) -> UtmGrid:
        if not self.compatible(other):
            raise ValueError("grids of different zones or resolutions can't be merged")
        return UtmGrid(self.zone, min(self.min_x, other.min_x), min(self.min_y, other.min_y), max(self.max_x, other.max_x), max(self.max_y, other.max_y), self.metres)

    def offset_to(self, other: UtmGrid) -> tuple[int, int]:
        return _round((self.min_x - other.min_x) / self.metres), _round((other.max_y - self.max_y) / self.metres)

    @property
    def around(self) -> int:
        return 0

    def position(self, x: Column, y: Column) -> tuple[Column, Column]:
        at = geo.from_utm(F.lit(self.zone), F.lit(float(self.min_x)) + x * self.metres, F.lit(float(self.max_y)) - y * self.metres)
        return at["lat"], at["lng"]


Grid = DegreeGrid | UtmGrid


def _round(x: float) -> int:
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def parse_line(line: str) -> Grid | None:
    """The grid that a line describes; None if it describes none.  Old degree lines lack the last two fields: one degree then."""
    parts = line.strip().split(",")
    try:
        if parts[0] == "G" and len(parts) >= 5:
            lat, lng, a, b = float(parts[1]), float(parts[2]), int(float(parts[3])), int(float(parts[4]))
            high = (float(parts[5]), float(parts[6])) if len(parts) >= 7 else (lat + 1, lng + 1)
            return DegreeGrid(lat, lng, *high, a, b) if a > 0 and b > 0 else None
        if parts[0] == "U" and len(parts) >= 7 and float(parts[6]) > 0:
            return UtmGrid(*map(int, parts[1:6]), float(parts[6]))
    except ValueError:
        pass
    return None


def merged_extent(grids: DataFrame) -> DataFrame:
    """One row: the union of degree extents (min_lat, min_lng, max_lat, max_lng columns)."""
    return grids.agg(F.min("min_lat").alias("min_lat"), F.min("min_lng").alias("min_lng"), F.max("max_lat").alias("max_lat"), F.max("max_lng").alias("max_lng"))


def offsets_to_extent(grids: DataFrame, extent: DataFrame, per_degree: int) -> DataFrame:
    """grids plus dx, dy: the shift of their pixels in the grid of the one-row extent."""
    e = extent.select(F.col("min_lng").alias("_lng"), F.col("max_lat").alias("_lat"))
    both = grids.join(F.broadcast(e))  # one row
    return both.select(*grids.columns, F.round((F.col("min_lng") - F.col("_lng")) * per_degree).cast("int").alias("dx"), F.round((F.col("_lat") - F.col("max_lat")) * per_degree).cast("int").alias("dy"))
