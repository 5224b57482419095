"""Command line: python -m ridgeline.cli PROGRAM ..., the programs being prominence, isolation, parents, tree, merge and filter."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.crs import Grid
from ridgeline.operators import divide, isolation, polygon, prominence, stencil
from ridgeline.sources import raster, sinks, text
from ridgeline.sources.formats import parse_format

#: Cells across a tile of a divide tree, at most.
TILE = 512


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ridgeline")
    programs = parser.add_subparsers(dest="program", required=True)
    for name in ("prominence", "isolation", "parents", "tree"):
        p = programs.add_parser(name)
        p.add_argument("-i", "--input", required=True, help="folder of raster files")
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-f", "--format", default="SRTM")
        p.add_argument("-m", "--minimum", type=float, default=1 if name == "isolation" else 100)
        p.add_argument("-s", "--scale", type=float, default=1.0, help="factor from the raster's unit to the output's")
        p.add_argument("-k", "--polygons", help="KML file or folder; only tiles that a polygon touches are read")
        p.add_argument("--keep-spikes", action="store_true", help="leave in samples far above a neighbour, which otherwise go in row order")
        if name != "tree":
            p.add_argument("--bounds", type=float, nargs=4, metavar=("SOUTH", "WEST", "NORTH", "EAST"), help="only peaks within, edges included, the west beyond the east across 180; the ground around them counts all the same")
        if name == "isolation":
            p.add_argument("--tiles", action="store_true", help="one file for each degree of latitude and longitude")
        if name != "isolation":
            p.add_argument("-z", "--zone", type=int, help="UTM zone of formats on a UTM grid")
        if name in ("prominence", "tree"):
            p.add_argument("-a", "--anti", action="store_true")
        if name == "prominence":
            p.add_argument("-b", "--bathymetry", action="store_true")
            p.add_argument("--kml", help="also write peaks, saddles and the lines between them, as KML")
        if name == "tree":
            p.add_argument("--kml", help="also write peaks, saddles, runoffs and edges, as KML")
    p = programs.add_parser("merge", help="join divide trees, and measure what they hold")
    p.add_argument("output", help="folder; gets tree (a tree file) and prominence (lines)")
    p.add_argument("inputs", nargs="+", help="tree files or folders of one tree file each")
    p.add_argument("-m", "--minimum", type=float, default=100)
    p.add_argument("-s", "--scale", type=float, default=1.0)
    p.add_argument("-a", "--anti", action="store_true", help="the trees are of ground turned upside down")
    p.add_argument("-b", "--bathymetry", action="store_true")
    p.add_argument("-f", "--finalize", action="store_true", help="nothing will be merged to the result: drop what only waits for more land")
    p = programs.add_parser("filter")
    p.add_argument("polygons", help="KML file or folder")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-a", "--wrap", type=float, help="longitudes west of this are a turn further east")
    p.add_argument("-x", "--invert", action="store_true")
    return parser


def within(grid: Grid, bounds: list[float] | None) -> Column:
    """Whether a row's (gx, gy) lies in the bounds, edges included."""
    if not bounds:
        return F.lit(True)
    south, west, north, east = bounds
    lat, lng = grid.position(F.col("gx"), F.col("gy"))
    across = (lng >= west) & (lng <= east) if west <= east else (lng >= west) | (lng <= east)
    return (lat >= south) & (lat <= north) & across


def tile_size(around: int, most: int = TILE) -> int:
    """The largest tile whose edges meet around the globe."""
    return next(n for n in range(most, 0, -1) if around % n == 0)


def merge_files(spark: SparkSession, inputs: list[str]) -> tuple[Grid, divide.Tree]:
    """Tree files as one spliced tree on the grid that holds them all; files of grids that don't match are an error."""
    read = [text.read_divide_tree(spark, path) for path in inputs]
    grid = reduce(lambda a, b: a.merge(b), (g for g, _ in read))
    return grid, divide.merge(*(divide.from_tables(tables, *g.offset_to(grid)) for g, tables in read), around=grid.around)


def _tree_kml(tree: divide.Tree, grid: Grid) -> DataFrame:
    at = lambda key: divide.place_of(key)
    peaks = tree.peaks.select(*at("peak"), "elev")
    saddles = tree.edges.select(F.col("sx").alias("gx"), F.col("sy").alias("gy"), F.col("level").alias("elev"))
    runoffs = tree.runoffs.select(F.col("x").alias("gx"), F.col("y").alias("gy"), "elev")
    lines = tree.edges.select(*divide.place_of("p", "x1", "y1"), *divide.place_of("q", "x2", "y2"))
    marks = [sinks.kml_placemarks(t, grid, folder) for t, folder in ((peaks, "Peaks"), (saddles, "Saddles"), (runoffs, "Runoffs"))]
    return reduce(DataFrame.union, [*marks, sinks.kml_edges(lines, grid)])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ridgeline").getOrCreate()
    if args.program == "filter":
        kept = polygon.filter_points(text.read_points(spark, args.input), text.read_kml_polygons(spark, args.polygons), args.wrap, args.invert)
        kept.select("line").write.mode("overwrite").text(args.output)
        return
    if args.program == "merge":
        grid, tree = merge_files(spark, args.inputs)
        tree = divide.finish(tree, args.minimum) if args.finalize else divide.prune(tree, args.minimum)
        sinks.write_divide_tree(grid, divide.to_tables(tree), f"{args.output}/tree")
        found = divide.tree_prominence(tree, bathymetry=args.bathymetry).where(F.col("prominence") >= args.minimum)
        found = found.withColumn("elev", -F.col("elev")) if args.anti else found
        sinks.prominence_lines(found, grid, args.scale).write.mode("overwrite").text(f"{args.output}/prominence")
        return
    fmt = parse_format(args.format)
    grid = raster.grid_of(args.format, getattr(args, "zone", None))
    polygons = text.read_kml_polygons(spark, args.polygons) if args.polygons else None
    if polygons is not None and fmt.utm:
        raise ValueError("polygons are in degrees, tiles of this format are not")
    cells = raster.one_owner(raster.read_cells(spark, args.format, args.input, zone=getattr(args, "zone", None), polygons=polygons))
    if not args.keep_spikes:
        cells = stencil.despike_in_order(cells, 1000.0, round(fmt.per_degree * fmt.degrees))
    inside = within(grid, getattr(args, "bounds", None))
    if args.program == "tree":
        tree = divide.build_tree(stencil.flip(cells) if args.anti else cells, tile_size(grid.around), grid.around, args.minimum)
        tree = divide.prune(tree, args.minimum)
        sinks.write_divide_tree(grid, divide.to_tables(tree), args.output)
        if args.kml:
            sinks.write_kml(_tree_kml(tree, grid), args.kml)
        return
    if args.program == "isolation":
        found = isolation.geographic_isolation(stencil.candidate_peaks(cells).where(inside), cells, fmt.per_degree)
        found = isolation.at_least(found, args.minimum)
        if args.tiles:
            sinks.write_isolation_tiles(sinks.isolation_tiles(found, grid), args.output)
            return
        lines = sinks.isolation_lines(found, grid)
    elif args.program == "prominence":
        measure = prominence.anti_prominence if args.anti else prominence.prominence
        found = prominence.prune(measure(cells, bathymetry=args.bathymetry, around=grid.around), args.minimum).where(inside)
        lines = sinks.prominence_lines(found, grid, args.scale)
        if args.kml:
            saddles = found.where("saddle_x is not null")
            marks = [sinks.kml_placemarks(found, grid), sinks.kml_placemarks(saddles.select(F.col("saddle_x").alias("gx"), F.col("saddle_y").alias("gy"), F.col("saddle_elev").alias("elev")), grid, "Saddles")]
            sinks.write_kml(reduce(DataFrame.union, [*marks, sinks.kml_edges(saddles.select(F.col("gx").alias("x1"), F.col("gy").alias("y1"), F.col("saddle_x").alias("x2"), F.col("saddle_y").alias("y2")), grid)]), args.kml)
    else:
        peaks = prominence.prominence(cells, around=grid.around).select("gx", "gy", "saddle_x", "saddle_y", F.col("elev").alias("own_elev"), F.col("prominence").alias("own_prominence"))
        found = prominence.parents(cells, minimum=args.minimum, around=grid.around).where(inside).join(peaks.select("gx", "gy", "saddle_x", "saddle_y"), ["gx", "gy"])
        at = lambda x, y: peaks.select(F.col("gx").alias(x), F.col("gy").alias(y), F.col("own_elev").alias(f"{x}_elev"), F.col("own_prominence").alias(f"{x}_prominence"))
        found = found.join(at("parent_x", "parent_y"), ["parent_x", "parent_y"], "left").join(at("line_x", "line_y"), ["line_x", "line_y"], "left")
        place = lambda x, y, name: [c.alias(f"{name}{k}") for c, k in zip(grid.position(F.col(x), F.col(y)), ("lat", "lng"), strict=True)]
        lines = sinks.parent_lines(found.select(*place("gx", "gy", ""), *place("saddle_x", "saddle_y", "saddle_"), "elev", "prominence", *place("parent_x", "parent_y", "parent_"), F.col("parent_x_prominence").alias("parent_prominence"), *place("line_x", "line_y", "line_"), F.col("line_x_elev").alias("line_elev")))
    lines.write.mode("overwrite").text(args.output)


if __name__ == "__main__":
    main()
