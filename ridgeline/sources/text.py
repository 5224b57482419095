"""Text inputs: divide trees, KML polygons, points, isolation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.crs import Grid, parse_line

# The fields of each tagged line of a divide tree.
DVT = {
    "P": "peak_id int, x int, y int, elev float",
    "S": "saddle_id int, type string, x int, y int, elev float",
    "R": "runoff_id int, x int, y int, elev float, quadrants int, inside_peak int",
    "N": "peak_id int, parent_id int, saddle_id int",
    "E": "runoff_id int, peak_id int",
}


def read_divide_tree(spark: SparkSession, path: str) -> tuple[Grid, dict[str, DataFrame]]:
    """The grid, and a table per tag (P peaks, S saddles, R runoffs, N nodes, E runoff edges).

    A line of unknown tag or wrong arity makes the file invalid.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    head = lines.where(F.col("value").rlike("^[GU],")).limit(1).collect()
    grid = parse_line(head[0]["value"]) if head else None
    if grid is None:
        raise ValueError(f"{path}: no coordinate system")
    fields = F.split("value", ",")
    tag = fields[0]
    arity = F.create_map(*(F.lit(x) for t, s in DVT.items() for x in (t, s.count(",") + 2)))
    wrong = lines.where(~tag.isin("G", "U") & (F.coalesce(F.try_element_at(arity, tag), F.lit(0)) != F.size(fields)))
    if wrong.limit(1).collect():
        raise ValueError(f"{path}: a line has the wrong number of fields")
    tables = {}
    for t, schema in DVT.items():
        columns = [c.split() for c in schema.split(", ")]
        tables[t] = lines.where(tag == t).select(*(F.trim(fields[i + 1]).cast(kind).alias(name) for i, (name, kind) in enumerate(columns)))
    return grid, tables


def read_kml_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(poly_id, ring): each <coordinates> element as an array of (lng, lat), by file and place in it."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rings = texts.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<coordinates>(.*?)</coordinates>"), 1)).alias("n", "body"))
    points = F.filter(F.split(F.trim(F.regexp_replace("body", r"\s+", " ")), " "), lambda p: p.contains(","))
    pair = lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("lng"), F.split(p, ",")[1].cast("double").alias("lat"))
    return rings.select(F.concat_ws("#", "file", "n").alias("poly_id"), F.transform(points, pair).alias("ring")).where(F.size("ring") > 0)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lng, line) of lines that begin with two numbers; blank lines and comments are passed over."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    fields = F.split("value", ",")
    return lines.where(F.size(fields) >= 2).select(F.expr("try_cast(trim(split(value, ',')[0]) as double)").alias("lat"), F.expr("try_cast(trim(split(value, ',')[1]) as double)").alias("lng"), F.col("value").alias("line")).where("lat is not null and lng is not null")


def read_isolation(spark: SparkSession, path: str) -> DataFrame:
    """Isolation result files; a malformed line is an error."""
    schema = "lat double, lng double, elev double, higher_lat double, higher_lng double, isolation_km double"
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path)
