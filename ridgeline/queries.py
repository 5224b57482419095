"""Registered terrain queries over rasters derived from the test tables, and the SQL that checks them.

T16: 16 by 16 cells, x and y the part and order keys modulo 16, elevation the
summed quantity.  T64 likewise with 64, less cells whose elevation is divisible
by 11 (no data).  Both have integer elevations, so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import crs, geo
from ridgeline.operators import isolation as iso
from ridgeline.operators import divide, polygon, prominence, regions, saddles, stencil, tree
from ridgeline.plans.scratch import Scratch, checkpoint_dir
from ridgeline.sources import raster, sinks

SPIKE, TILE, PER_DEGREE, BLOCK = 30, 16, 16, 8
GRID = crs.DegreeGrid(40.0, -110.0, 44.0, -106.0, PER_DEGREE, PER_DEGREE)
# Two polygons in the degrees of GRID, closed.
POLYGONS = {1: [(-109.5, 40.5), (-107.3, 41.2), (-106.4, 43.6), (-108.9, 43.1), (-109.5, 40.5)], 2: [(-107.0, 40.2), (-106.2, 40.2), (-106.2, 41.1), (-107.0, 40.2)]}

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

BASE_SQL = {
    "t16": "t16 as (select (l_partkey % 16)::int as gx, (l_orderkey % 16)::int as gy, sum(l_quantity)::bigint as elev from lineitem group by 1, 2)",
    "t64": "t64 as (select * from (select (l_partkey % 64)::int as gx, (l_orderkey % 64)::int as gy, sum(l_quantity)::bigint as elev from lineitem group by 1, 2) where elev % 11 <> 0)",
    "ring": "off(dx, dy) as (select a.x, b.x from (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(x) where a.x <> 0 or b.x <> 0)",
}


def _sql(*parts: str) -> str:
    """A query with the named base tables in front."""
    base = [BASE_SQL[p] for p in parts[:-1] if p in BASE_SQL]
    rest = [p for p in parts[:-1] if p not in BASE_SQL]
    return f"with recursive {', '.join(base + rest)} {parts[-1]}"


def _raster(spark: SparkSession, sf_dir: str, n: int, holes: bool = False) -> DataFrame:
    checkpoint_dir(spark)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = items.groupBy((F.col("l_partkey") % n).cast("int").alias("gx"), (F.col("l_orderkey") % n).cast("int").alias("gy")).agg(F.sum("l_quantity").cast("long").alias("elev"))
    return at.where("elev % 11 <> 0") if holes else at


def _t16(spark, d):
    return _raster(spark, d, 16)


def _t64(spark, d):
    return _raster(spark, d, 64, True)


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _polygon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, [{"lng": x, "lat": y} for x, y in ring]) for k, ring in POLYGONS.items()], "poly_id int, ring array<struct<lng: double, lat: double>>")


_POLY_SQL = "edge(poly_id, x1, y1, x2, y2) as (values " + ", ".join(f"({k}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for k, ring in POLYGONS.items() for a, b in zip(ring, ring[1:], strict=False)) + ")"
_GEO_SQL = f"geo as (select gx, gy, elev, 44.0::double - gy / {PER_DEGREE}.0::double as lat, -110.0::double + gx / {PER_DEGREE}.0::double as lng from t64)"


def _geo(spark, d):
    lat, lng = GRID.position(F.col("gx"), F.col("gy"))
    return _t64(spark, d).withColumn("lat", lat).withColumn("lng", lng)


# --- rasters -----------------------------------------------------------------


@query(_sql("t64", "select gx, gy, elev from t64"))
def raster_build(spark, d):
    return _t64(spark, d).select("gx", "gy", "elev")


@query(_sql("t64", f"select (gx // {TILE})::int as tx, (gy // {TILE})::int as ty, greatest(max(elev), 0) as max_elev from t64 group by 1, 2"))
def tile_max(spark, d):
    return stencil.tile_maximum(_t64(spark, d), TILE)


@query(_sql("t64", f"select count(*) as n from (select distinct gx // {TILE}, gy // {TILE} from t64)"))
def tile_count(spark, d):
    return stencil.tile_count(_t64(spark, d), TILE)


@query(_sql("t64", "select gx, gy, -elev as elev from t64"))
def tile_flip(spark, d):
    return stencil.flip(_t64(spark, d)).select("gx", "gy", "elev")


@query(_sql("t64", "select gx, gy, round(elev * 0.3048::double, 6) as elev from t64"))
def unit_scale(spark, d):
    return stencil.scale(_t64(spark, d), geo.METRES_PER_FOOT).select("gx", "gy", F.round(F.col("elev").cast("double"), 6).alias("elev"))


@query(_sql("t64", f"select (gx // {TILE})::int as tx, (gy // {TILE})::int as ty, min(gx) as min_x, min(gy) as min_y, max(gx) as max_x, max(gy) as max_y, count(*) as n from t64 group by 1, 2"))
def data_extent(spark, d):
    return stencil.data_extent(_t64(spark, d), TILE)


@query(_sql("t64", "select (gx // 4)::int as gx, (gy // 4)::int as gy, max(elev)::float as elev from t64 group by 1, 2"))
def regrid(spark, d):
    return raster.regrid(_t64(spark, d), 4)


@query(_sql("t64", f"select gx, gy, elev from t64 c where not exists (select 1 from t64 n where abs(n.gx - c.gx) + abs(n.gy - c.gy) = 1 and c.elev - n.elev > {SPIKE})"))
def despike_single_pass(spark, d):
    return stencil.despike(_t64(spark, d), SPIKE)


@query()
def despike_in_order(spark, d):
    return stencil.despike_in_order(_t64(spark, d), SPIKE, TILE)


@query(
    _sql(
        "t64",
        f"tile as (select (gx // {TILE})::int as tx, (gy // {TILE})::int as ty, (gx % {TILE})::int as x, (gy % {TILE})::int as y, elev from t64)",
        f"slots as (select tx, ty, x, y from tile union select tx - 1, ty, {TILE - 1}, y from tile where x = 0 union select tx, ty - 1, x, {TILE - 1} from tile where y = 0)",
        f"select s.tx, s.ty, s.x, s.y, coalesce(e.elev, n.elev, o.elev) as elev from slots s left join tile o using (tx, ty, x, y) left join tile e on s.x = {TILE - 1} and e.tx = s.tx + 1 and e.ty = s.ty and e.x = 0 and e.y = s.y left join tile n on s.y = {TILE - 1} and n.tx = s.tx and n.ty = s.ty + 1 and n.y = 0 and n.x = s.x",
    )
)
def edge_overlap_copy(spark, d):
    return stencil.copy_edges(_t64(spark, d), TILE)


@query(
    _sql(
        "t64",
        f"tile as (select distinct (gx // {TILE})::int as tx, (gy // {TILE})::int as ty from t64)",
        f"select tx, ty, (gx - tx * {TILE})::int as x, (gy - ty * {TILE})::int as y, elev from tile join t64 on gx between tx * {TILE} and tx * {TILE} + {TILE} and gy between ty * {TILE} and ty * {TILE} + {TILE}",
    )
)
def edge_overlap_append(spark, d):
    return stencil.append_edges(_t64(spark, d), TILE)


_PEAKS_SQL = "cand as (select gx, gy, elev from t64 c where not exists (select 1 from t64 n where abs(n.gx - c.gx) <= 1 and abs(n.gy - c.gy) <= 1 and n.elev > c.elev))"


@query(_sql("t64", _PEAKS_SQL, "select gx, gy, elev from cand"))
def stencil_peaks(spark, d):
    return stencil.candidate_peaks(_t64(spark, d))


_REACH = "{name}(gx, gy, elev, ax, ay) as (select gx, gy, elev, gx, gy from {src} union select n.gx, n.gy, n.elev, r.ax, r.ay from {name} r join {src} n on n.elev = r.elev and {near})"


@query(_sql("t64", _PEAKS_SQL, _REACH.format(name="reach", src="cand", near="abs(n.gx - r.gx) + abs(n.gy - r.gy) = 1"), "select gx, gy, elev from (select gx, gy, elev, min(ay::bigint * 100000 + ax) as first from reach group by 1, 2, 3) where first = gy::bigint * 100000 + gx"))
def plateau_thin(spark, d):
    return regions.thin_plateaus(stencil.candidate_peaks(_t64(spark, d)))


_FLAT = _REACH.format(name="flat", src="t64", near="abs(n.gx - r.gx) <= 1 and abs(n.gy - r.gy) <= 1")


@query(_sql("t64", _FLAT, "select gx, gy, elev, (min(ay::bigint * 100000 + ax) % 100000)::int as cx, (min(ay::bigint * 100000 + ax) // 100000)::int as cy from flat group by 1, 2, 3"))
def flat_components(spark, d):
    return regions.flat_components(_t64(spark, d))


@query(
    _sql(
        "t64",
        _FLAT,
        "comp as (select gx, gy, elev, min(ay::bigint * 100000 + ax) as c from flat group by 1, 2, 3)",
        "low as (select distinct c.c from comp c join t64 n on abs(n.gx - c.gx) <= 1 and abs(n.gy - c.gy) <= 1 and n.elev > c.elev)",
        "select distinct (c % 100000)::int as gx, (c // 100000)::int as gy, elev from comp where c not in (select c from low)",
    )
)
def plateau_peaks(spark, d):
    return regions.plateau_peaks(_t64(spark, d))


def _ring_sql() -> str:
    at = ", ".join(f"max(case when n.gx - c.gx = {dx} and n.gy - c.gy = {dy} then n.elev end) as n{i}" for i, (dx, dy) in enumerate(stencil.RING))
    high = ", ".join(f"coalesce(n{i} > elev, false) as h{i}" for i in range(8))
    closed = ", ".join(f"h{i} as a{i}" if i % 2 else f"(h{i} or (h{(i - 1) % 8} and h{(i + 1) % 8})) as a{i}" for i in range(8))
    starts = " + ".join(f"(a{i} and not a{(i - 1) % 8})::int" for i in range(8))
    flat = " or ".join(f"coalesce(n{i} = elev, false)" for i in range(8))
    return _sql("t64", f"ringed as (select c.gx, c.gy, c.elev, {at} from t64 c left join t64 n on abs(n.gx - c.gx) <= 1 and abs(n.gy - c.gy) <= 1 group by 1, 2, 3)", f"high as (select *, {high} from ringed where not ({flat}))", f"closed as (select gx, gy, elev, {closed} from high)", f"select gx, gy, elev, ({starts} - 1)::int as n_saddles from closed where {starts} >= 2")


@query(_ring_sql())
def saddle_candidates(spark, d):
    return stencil.ring_saddles(_t64(spark, d))


_COMP = "comp as (select gx, gy, elev, min(ay::bigint * 100000 + ax) as c from flat group by 1, 2, 3)"
_SEGMENTS = "edge as (select distinct c.c, c.elev as level, n.gx, n.gy, n.elev from comp c join t64 n on abs(n.gx - c.gx) <= 1 and abs(n.gy - c.gy) <= 1 and n.elev > c.elev), seg(c, level, gx, gy, elev, s) as (select c, level, gx, gy, elev, gy::bigint * 100000 + gx from edge union select e.c, e.level, e.gx, e.gy, e.elev, s.s from seg s join edge e on e.c = s.c and abs(e.gx - s.gx) <= 1 and abs(e.gy - s.gy) <= 1), named as (select c, level, gx, gy, elev, min(s) as s from seg group by 1, 2, 3, 4, 5)"
_RING_PLACE = "case when dy = -r then dx + r when dx = r then 3 * r + dy when dy = r then 5 * r - dx else 7 * r - dy end"


@query(
    _sql(
        "t64",
        _FLAT,
        _COMP,
        _SEGMENTS,
        "high as (select c, level, s, max((elev, -gy, -gx)) as h from named group by 1, 2, 3)",
        "pair as (select *, max(h) over (partition by c) as t from high)",
        "mid as (select c, level, h, t, (-h[3] - t[3]) // 2 as mx, (-h[2] - t[2]) // 2 as my from pair where h <> t)",
        "near as (select m.*, p.gx, p.gy, p.gx - mx as dx, p.gy - my as dy, greatest(abs(p.gx - mx), abs(p.gy - my)) as r from mid m join comp p on p.c = m.c)",
        f"placed as (select *, row_number() over (partition by c, h order by r, {_RING_PLACE}) as n from near)",
        "select gx, gy, level as elev, (-h[3])::int as high_x, (-h[2])::int as high_y, (-t[3])::int as top_x, (-t[2])::int as top_y, (c % 100000)::int as cx, (c // 100000)::int as cy from placed where n = 1",
    )
)
def flat_saddles(spark, d):
    return saddles.flat_saddles(_t64(spark, d))


@query(
    f"with label as (select distinct (l_partkey % 64)::int as gx, (l_orderkey % 64)::int as gy, l_quantity::int as label from lineitem), place as (select o_orderkey as id, (o_orderkey % 61)::int as x, (o_custkey % 59)::int as y, (o_orderkey % 50 + 1)::int as label from orders), near as (select id, l.gx, l.gy, l.gx - a.x as dx, l.gy - a.y as dy, greatest(abs(l.gx - a.x), abs(l.gy - a.y)) as r from place a join label l using (label)) select id, arg_min(gx, r * 1000 + {_RING_PLACE}) as gx, arg_min(gy, r * 1000 + {_RING_PLACE}) as gy from near group by id"
)
def closest_labelled(spark, d):
    """The closest cell of each place's label, ring by ring."""
    items, orders = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders"))
    label = items.select((F.col("l_partkey") % 64).cast("int").alias("gx"), (F.col("l_orderkey") % 64).cast("int").alias("gy"), F.col("l_quantity").cast("int").alias("label")).distinct()
    at = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 61).cast("int").alias("x"), (F.col("o_custkey") % 59).cast("int").alias("y"), (F.col("o_orderkey") % 50 + 1).cast("int").alias("label"))
    return saddles.closest_labelled(at, label, 64).select("id", "gx", "gy")


@query(") select n_saddles, count(*) as n from (select gx, gy, elev, ".join(_ring_sql().rsplit(") select gx, gy, elev, ", 1)) + ") group by 1")
def saddle_counts(spark, d):
    return stencil.ring_saddles(_t64(spark, d)).groupBy("n_saddles").agg(F.count("*").alias("n"))


def _steep(src: str) -> str:
    return f"steep as (select c.gx, c.gy, c.elev, arg_max(n.gx, n.elev * 1000000 - n.gy * 1000 - n.gx) as ux, arg_max(n.gy, n.elev * 1000000 - n.gy * 1000 - n.gx) as uy from {src} c join {src} n on abs(n.gx - c.gx) <= 1 and abs(n.gy - c.gy) <= 1 group by 1, 2, 3)"


@query(_sql("t64", _steep("t64"), "select gx, gy, elev, ux, uy from steep"))
def steepest_neighbour(spark, d):
    return stencil.steepest(_t64(spark, d))


_WALK = "walk(gx, gy, elev, px, py) as (select gx, gy, elev, ux, uy from steep union select w.gx, w.gy, w.elev, s.ux, s.uy from walk w join steep s on s.gx = w.px and s.gy = w.py), region as (select w.gx, w.gy, w.elev, w.px, w.py from walk w join steep s on s.gx = w.px and s.gy = w.py and s.ux = s.gx and s.uy = s.gy)"


@query(_sql("t64", _steep("t64"), _WALK, "select distinct gx, gy, elev, px, py from region"))
def region_label(spark, d):
    return regions.label_regions(_t64(spark, d))


_RAG = "rag as (select least(a.py * 2147483648 + a.px, b.py * 2147483648 + b.px) as p, greatest(a.py * 2147483648 + a.px, b.py * 2147483648 + b.px) as q, max(least(a.elev, b.elev)) as level from region a join region b on abs(a.gx - b.gx) <= 1 and abs(a.gy - b.gy) <= 1 and (a.px <> b.px or a.py <> b.py) group by 1, 2)"


@query(_sql("t64", _steep("t64"), _WALK, _RAG, "select p::bigint as p, q::bigint as q, level from rag"))
def region_adjacency(spark, d):
    return regions.region_adjacency(regions.label_regions(_t64(spark, d)))


_FOREST = "span(p, q, level, node) as (select p, q, level, p from rag union select s.p, s.q, s.level, case when r.p = s.node then r.q else r.p end from span s join rag r on (r.p = s.node or r.q = s.node) and (-r.level, r.p, r.q) < (-s.level, s.p, s.q)), forest as (select p, q, level from rag except select p, q, level from span where node = q)"


@query(_sql("t16", _steep("t16"), _WALK, _RAG, _FOREST, "select p::bigint as p, q::bigint as q, level from forest"))
def max_spanning_forest(spark, d):
    return regions.spanning_forest(regions.region_adjacency(regions.label_regions(_t16(spark, d))))


_TOPS = "tops as (select distinct s.gx, s.gy, s.elev, s.gy * 2147483648 + s.gx as id from steep s where s.ux = s.gx and s.uy = s.gy)"
# The level at which a top first meets higher ground, over the forest's levels.
_MEET = "levels as (select distinct level from rag), flood(id, level, node) as (select id, level, id from tops, levels where level <= elev union select f.id, f.level, case when r.p = f.node then r.q else r.p end from flood f join rag r on (r.p = f.node or r.q = f.node) and r.level >= f.level), meet as (select t.id, max(f.level) as level from tops t join flood f using (id) join tops o on o.id = f.node and (o.elev, o.id) > (t.elev, t.id) group by 1)"


def _prominence_sql(sea: str) -> str:
    return _sql("t16", _steep("t16"), _WALK, _RAG, _TOPS, _MEET, f"select gx, gy, elev::double as elev, (elev - coalesce(level, {sea}))::double as prominence from tops left join meet using (id) where elev - coalesce(level, {sea}) > 0")


@query(_prominence_sql("0"))
def prominence_t16(spark, d):
    return prominence.prominence(_t16(spark, d), BLOCK).select("gx", "gy", "elev", "prominence")


_Q["prominence"], _SQL["prominence"] = _Q.pop("prominence_t16"), _SQL.pop("prominence_t16")


@query(_prominence_sql("(select min(m.level) from meet m join tops t using (id) where t.elev > m.level)"))
def prominence_bathy(spark, d):
    return prominence.prominence(_t16(spark, d), BLOCK, bathymetry=True).select("gx", "gy", "elev", "prominence")


@query(_prominence_sql("(select min(m.level) from meet m join tops t using (id) where t.elev > m.level)").replace("sum(l_quantity)::bigint as elev", "-sum(l_quantity)::bigint as elev").replace("elev::double as elev", "-elev::double as elev"))
def anti_prominence(spark, d):
    return prominence.anti_prominence(_t16(spark, d), BLOCK, bathymetry=True).select("gx", "gy", "elev", "prominence")


@query(_prominence_sql("0").replace("sum(l_quantity)::bigint as elev", "(900 - sum(l_quantity))::bigint as elev").replace("elev::double as elev", "-elev::double as elev"))
def anti_prominence_of_basin(spark, d):
    """Depressions of ground that lies below sea level, where the deepest counts from there."""
    below = _t16(spark, d).withColumn("elev", F.col("elev") - 900)
    return prominence.anti_prominence(below, BLOCK).select("gx", "gy", "elev", "prominence")


@query(_prominence_sql("0").replace("where elev - coalesce(level, 0) > 0", "where elev - coalesce(level, 0) >= 40"))
def prune_min(spark, d):
    return prominence.prune(prominence.prominence(_t16(spark, d), BLOCK), 40).select("gx", "gy", "elev", "prominence")


@query()
def prominence_t64(spark, d):
    return prominence.prominence(_t64(spark, d), TILE)


@query()
def line_and_prominence_parents(spark, d):
    return prominence.parents(_t64(spark, d), TILE)


# --- runoffs and trees ---------------------------------------------------------

_SERIES = "series as (select ty, pos, case when v % 7 = 0 then null else v end as v from (select (gy // 16)::int as ty, gx as pos, sum(elev)::bigint as v from t64 where gy % 16 = 0 group by 1, 2))"


@query(
    _sql(
        "t64",
        _SERIES,
        "step as (select *, row_number() over w as n, lag(v) over w as lv, lag(pos) over w as lp from series window w as (partition by ty order by pos))",
        "mark as (select *, case when n = 1 then false else v is not null and (lv is null or v > lv) end as rise, n > 1 and lv is not null and (v is null or v < lv) as fall from step)",
        "last as (select *, last_value(case when rise then true when fall then false end ignore nulls) over (partition by ty order by pos rows between unbounded preceding and 1 preceding) as was from mark)",
        "select ty, lp as pos, lv as v from last where fall and was",
    )
)
def runoffs(spark, d):
    series = _t64(spark, d).where("gy % 16 = 0").groupBy(F.floor(F.col("gy") / 16).cast("int").alias("ty"), F.col("gx").alias("pos")).agg(F.sum("elev").alias("v"))
    return stencil.edge_runoffs(series.withColumn("v", F.when(F.col("v") % 7 != 0, F.col("v"))), ["ty"], "pos", "v")


def _runoff_table(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("runoff_id"), (F.col("user_id") % 40).cast("int").alias("x"), (F.col("event_id") % 7).cast("int").alias("y"), (F.col("event_id") % 3 + 1).cast("int").alias("quadrants"))


_RUNOFF_SQL = "ro as (select event_id as runoff_id, (user_id % 40)::int as x, (event_id % 7)::int as y, (event_id % 3 + 1)::int as quadrants from events)"


@query(f"with {_RUNOFF_SQL}, n as (select runoff_id, x % 36 as x, y, (row_number() over (partition by x % 36, y order by runoff_id) - 1) // 2 as pair from ro) select min(runoff_id) as a, max(runoff_id) as b, x, y from n group by x, y, pair having count(*) = 2")
def runoff_splice(spark, d):
    return stencil.splice(_runoff_table(spark, d), 36).select("a", "b", F.col("x").cast("int").alias("x"), "y")


@query(f"with {_RUNOFF_SQL} select x % 36 as x, y, sum(quadrants)::bigint as quadrants from ro group by 1, 2 having count(*) > 1")
def quadrant_sum(spark, d):
    return stencil.filled_quadrants(_runoff_table(spark, d), 36)


@query("select s_suppkey as id, s_suppkey % 10 as x, s_suppkey % 7 as y from supplier union all select c_custkey + 100000, c_custkey % 10 + 5, c_custkey % 7 + 2 from customer")
def tree_union(spark, d):
    at = lambda t, k: spark.read.parquet(f"{d}/{t}.parquet").select(F.col(k).alias("id"), (F.col(k) % 10).alias("x"), (F.col(k) % 7).alias("y"))
    return tree.union_trees(at("supplier", "s_suppkey"), at("customer", "c_custkey"), "id", 100000, 5, 2)


_LINKED = "linked as (select o_orderkey as node, case when o_orderkey % 11 = 0 then null when o_orderkey % 97 < 3 then o_orderkey // 97 * 97 + (o_orderkey % 97 + 1) % 3 else o_orderkey // 3 end as parent from orders)"


@query(f"with recursive {_LINKED}, way(node, pos) as (select node, parent from linked where parent is not null union select w.node, l.parent from way w join linked l on l.node = w.pos where l.parent is not null), ends as (select distinct w.node from way w left join linked l on l.node = w.pos where l.node is null or l.parent is null) select node from linked where parent is not null and node not in (select node from ends)")
def tree_cycles(spark, d):
    key = F.col("o_orderkey")
    ring = F.floor(key / 97) * 97 + (key % 97 + 1) % 3
    parent = F.when(key % 11 == 0, F.lit(None)).when(key % 97 < 3, ring).otherwise(F.floor(key / 3))
    return tree.cyclic(spark.read.parquet(f"{d}/orders.parquet").select(key.alias("node"), parent.cast("long").alias("parent")))


def _saddle_table(spark, d):
    kind = F.element_at(F.array(*map(F.lit, "pfbe")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("saddle_id"), kind.alias("type"), F.col("o_totalprice").alias("elev"))


@query("select o_orderkey as saddle_id, 'p' as type, o_totalprice as elev from orders where o_orderkey % 4 = 0")
def compact(spark, d):
    return tree.compact(_saddle_table(spark, d))


@query("select substr('pfbe', (o_orderkey % 4 + 1)::int, 1) as type, count(*) as n from orders group by 1")
def saddle_types(spark, d):
    return tree.count_by_type(_saddle_table(spark, d))


@query("select o_orderkey as saddle_id, row_number() over (order by o_orderkey) as new_id from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def renumber(spark, d):
    gone = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_orderkey").alias("saddle_id")).distinct()
    return tree.renumber(_saddle_table(spark, d).select("saddle_id"), "saddle_id", gone).select("saddle_id", "new_id")


# --- divide trees ----------------------------------------------------------------


def _runoff_sql(src: str, size: int) -> str:
    """The runoffs of tiles of src: tiles with their neighbours' first row and column, each side walked eastward or southward."""
    return ", ".join(
        [
            f"tile as (select distinct (gx // {size})::int as tx, (gy // {size})::int as ty from {src})",
            f"cell as (select tx, ty, (gx - tx * {size})::int as x, (gy - ty * {size})::int as y, elev from tile join {src} on gx between tx * {size} and tx * {size} + {size} and gy between ty * {size} and ty * {size} + {size})",
            f"dim as (select tx, ty, case when max(x) = {size} then {size} else {size - 1} end as ex, case when max(y) = {size} then {size} else {size - 1} end as ey from cell group by 1, 2)",
            f"border as (select tx, ty, side, k, case side when 0 then k when 1 then ex when 2 then 0 else k end as x, case side when 0 then 0 when 1 then k when 2 then k else ey end as y from dim, range(0, {size + 1}) r(k), (values (0), (1), (2), (3)) s(side) where k <= case when side in (0, 3) then ex else ey end)",
            "step as (select a.tx, a.ty, a.side, a.k, a.x, a.y, c.elev as v, row_number() over w as n, lag(c.elev) over w as lv, lag(a.x) over w as lx, lag(a.y) over w as ly from border a left join cell c on c.tx = a.tx and c.ty = a.ty and c.x = a.x and c.y = a.y window w as (partition by a.tx, a.ty, a.side order by a.k))",
            "mark as (select *, n > 1 and v is not null and (lv is null or v > lv) as rise, n > 1 and lv is not null and (v is null or v < lv) as fall from step)",
            "was as (select *, last_value(case when rise then true when fall then false end ignore nulls) over (partition by tx, ty, side order by k rows between unbounded preceding and 1 preceding) as up from mark)",
            "corner as (select c.tx, c.ty, c.x, c.y, c.elev from cell c join dim using (tx, ty) where c.x in (0, ex) and c.y in (0, ey))",
            "ro as (select tx, ty, x, y, elev, 1 as quadrants from corner union select tx, ty, lx, ly, lv, 2 from was where fall and up and not exists (select 1 from corner c where c.tx = was.tx and c.ty = was.ty and c.x = lx and c.y = ly))",
        ]
    )


_INSIDE_PEAK = "flat(tx, ty, rx, ry, x, y, elev) as (select tx, ty, x, y, x, y, elev from ro union select f.tx, f.ty, f.rx, f.ry, c.x, c.y, c.elev from flat f join cell c on c.tx = f.tx and c.ty = f.ty and c.elev = f.elev and abs(c.x - f.x) <= 1 and abs(c.y - f.y) <= 1), lower as (select distinct f.tx, f.ty, f.rx as x, f.ry as y from flat f join cell c on c.tx = f.tx and c.ty = f.ty and c.elev > f.elev and abs(c.x - f.x) <= 1 and abs(c.y - f.y) <= 1)"


@query(_sql("t64", _runoff_sql("t64", TILE), _INSIDE_PEAK, f"select r.tx, r.ty, (r.tx * {TILE} + r.x)::int as x, (r.ty * {TILE} + r.y)::int as y, r.elev::double as elev, r.quadrants, (l.x is null)::int as inside_peak from ro r left join lower l on l.tx = r.tx and l.ty = r.ty and l.x = r.x and l.y = r.y"))
def tile_runoffs(spark, d):
    """Runoffs of T64's sixteen tiles: corners, falls after rises, and whether each lies on a peak's flat area."""
    return divide.tile_trees(_t64(spark, d), TILE).where("kind = 'R'").select("tx", "ty", "x", "y", F.col("level").alias("elev"), "quadrants", "inside_peak")


def _quarters(spark, d):
    pieces = Scratch(spark, "quarters").keep(divide.tile_trees(_t16(spark, d), BLOCK))
    return [divide.tree_of(pieces.where((F.col("tx") == x) & (F.col("ty") == y))) for y in (0, 1) for x in (0, 1)]


@query(_prominence_sql("0"))
def divide_tree_merge(spark, d):
    """Trees of T16's four quarters, merged pairwise without their rasters, have the prominences of the whole."""
    a, b, c, e = _quarters(spark, d)
    whole = divide.merge(divide.merge(a, b), divide.merge(c, e))
    return divide.tree_prominence(whole).select("gx", "gy", "elev", "prominence")


@query(_prominence_sql("(select min(m.level) from meet m join tops t using (id) where t.elev > m.level)"))
def divide_tree_bathy(spark, d):
    return divide.tree_prominence(divide.build_tree(_t16(spark, d), 4), bathymetry=True).select("gx", "gy", "elev", "prominence")


@query(_sql("t16", _steep("t16"), _WALK, _RAG, _TOPS, _MEET, "select m.level::double as level, count(*) as n from tops join meet m using (id) where elev > m.level group by 1"))
def spliced_forest_levels(spark, d):
    """Saddles of the forest after all seams of sixteen tiles are spliced: as many at each height as islands of the whole raster meet there."""
    return divide.build_tree(_t16(spark, d), 4).edges.groupBy("level").agg(F.count("*").alias("n"))


@query(_prominence_sql("0").replace("where elev - coalesce(level, 0) > 0", "where elev - coalesce(level, 0) >= 40"))
def divide_tree_pruned(spark, d):
    """Tiles' trees pruned, merged and pruned to the end keep the prominences that are large enough."""
    tree_ = divide.finish(divide.build_tree(_t16(spark, d), 4, minimum=40.0), 40.0)
    return divide.tree_prominence(tree_).where("prominence >= 40").select("gx", "gy", "elev", "prominence")


_OPEN = "reach as (select w.px, w.py, max(r.elev) as open from ro r join region w on w.gx = r.x and w.gy = r.y group by 1, 2), state as (select t.id, t.elev, coalesce(r.open, -1) as open from tops t left join reach r on r.py * 2147483648 + r.px = t.id)"
_SIDES = "side(p, q, level, s, node) as (select p, q, level, 0, p from forest union all select p, q, level, 1, q from forest union select i.p, i.q, i.level, i.s, case when f.p = i.node then f.q else f.p end from side i join forest f on (f.p = i.node or f.q = i.node) and (-f.level, f.p, f.q) < (-i.level, i.p, i.q)), top as (select p, q, level, s, max(case when open >= level then 1000000000 else elev end) as m from side join state on id = node group by 1, 2, 3, 4), pair as (select p, q, level, min(m) as m from top group by 1, 2, 3)"


@query(_sql("t16", _steep("t16"), _WALK, _RAG, _FOREST, _TOPS, _runoff_sql("t16", 16), _OPEN, _SIDES, "select level::double as level, case when m < 1000000000 then (m - level)::double end as prominence, count(*) as n from pair where m > level group by 1, 2"))
def saddle_prominence(spark, d):
    """T16 as one tile whose land goes on at its border: the height over each saddle of the lower island, unlimited if both reach a runoff."""
    found = divide.saddle_prominence(divide.tree_of(divide.tile_trees(_t16(spark, d), 16)))
    return found.groupBy("level", "prominence").agg(F.count("*").alias("n"))


def _around(sql: str) -> str:
    """The same with the first and last of sixteen columns side by side."""
    return sql.replace("abs(n.gx - c.gx) <= 1", "abs(n.gx - c.gx) in (0, 1, 15)").replace("abs(a.gx - b.gx) <= 1", "abs(a.gx - b.gx) in (0, 1, 15)")


@query(_around(_prominence_sql("0")))
def prominence_around(spark, d):
    return prominence.prominence(_t16(spark, d), BLOCK, around=16).select("gx", "gy", "elev", "prominence")


@query(_around(_prominence_sql("0")))
def divide_tree_around(spark, d):
    return divide.tree_prominence(divide.build_tree(_t16(spark, d), 4, around=16)).select("gx", "gy", "elev", "prominence")


@query(
    "with recursive node as (select c_custkey as node, case when c_custkey > 3 and c_custkey % 50 <> 0 then c_custkey - 1 - c_custkey % 3 end as parent, floor(c_acctbal)::bigint as level from customer),"
    " way(node, up, low) as (select node, node, null::bigint from node union all select w.node, n.parent, least(w.low, n.level) from way w join node n on n.node = w.up where n.parent is not null),"
    " pair as (select c_custkey as a, c_custkey * 7 % (select count(*) from customer) + 1 as b from customer)"
    " select a, b, max(case when y.node is not null then least(x.low, y.low) end) as low from pair left join way x on x.node = a left join way y on y.node = b and y.up = x.up group by a, b"
)
def path_minimum(spark, d):
    """Pairs of customers on deep chains: the least value on the way between them."""
    customers = spark.read.parquet(f"{d}/customer.parquet")
    key = F.col("c_custkey")
    nodes = customers.select(key.alias("node"), F.when((key > 3) & (key % 50 != 0), key - 1 - key % 3).alias("parent"), F.floor("c_acctbal").cast("long").alias("level"))
    pairs = customers.select(key.alias("a"), (key * 7 % customers.count() + 1).alias("b"))
    return divide.path_minimum(nodes, pairs)


# --- isolation -----------------------------------------------------------------

_ISO = "hit as (select p.gx, p.gy, p.elev, n.gx as x, n.gy as y, sqrt(((n.gx - p.gx) * (n.gx - p.gx) + (n.gy - p.gy) * (n.gy - p.gy))::double) as dist from cand p join t64 n on n.elev > p.elev), best as (select *, row_number() over (partition by gx, gy order by dist, y, x) as r from hit)"
_ISO_SQL = _sql("t64", _PEAKS_SQL, _ISO, "select c.gx, c.gy, c.elev, b.x as higher_x, b.y as higher_y, b.dist as distance from cand c left join best b on b.gx = c.gx and b.gy = c.gy and b.r = 1")


@query(_ISO_SQL)
def isolation_blocked(spark, d):
    cells = _t64(spark, d)
    return iso.isolation(stencil.candidate_peaks(cells), cells, BLOCK)


@query(_ISO_SQL.replace("from cand c left join", "from cand c join").replace("b.r = 1", "b.r = 1 and b.dist > 3"))
def isolation_at_least(spark, d):
    cells = _t64(spark, d)
    found = iso.isolation(stencil.candidate_peaks(cells), cells, BLOCK)
    return iso.at_least(found, 3, "distance").where("distance is not null")


_FAR = "far as (select p.gx, p.gy, p.elev, n.gx as x, n.gy as y, 90.0::double - p.gy / 16.0::double as la, -180.0::double + p.gx / 16.0::double as lo, 90.0::double - n.gy / 16.0::double as lb, -180.0::double + n.gx / 16.0::double as lp from cand p join t64 n on n.elev > p.elev), way as (select *, sin(radians(lb - la) / 2) ** 2 + cos(radians(la)) * cos(radians(lb)) * sin(radians(lp - lo) / 2) ** 2 as h from far), near as (select *, row_number() over (partition by gx, gy order by atan2(sqrt(h), sqrt(1 - h)), y, x) as n from way)"
_ON_ELLIPSOID = "arc as (select *, sin(radians((la + lb) / 2)) ** 2 as sf, cos(radians((la + lb) / 2)) ** 2 as cf, sin(radians((la - lb) / 2)) ** 2 as sg, cos(radians((la - lb) / 2)) ** 2 as cg, sin(radians((lo - lp) / 2)) ** 2 as sl, cos(radians((lo - lp) / 2)) ** 2 as cl from near where n = 1), bend as (select *, sg * cl + cf * sl as s, cg * cl + sf * sl as c from arc), shape as (select *, atan2(sqrt(s), sqrt(c)) as w, sqrt(s * c) / atan2(sqrt(s), sqrt(c)) as r, 1 / 298.257223563::double as f from bend)"


@query(
    _sql("t64", _PEAKS_SQL, _FAR, _ON_ELLIPSOID, "select c.gx, c.gy, c.elev, x as higher_x, y as higher_y, round(2 * w * 6378.137 * (1 + f * (3 * r - 1) / (2 * s_c) * sf * cg - f * (3 * r + 1) / (2 * s) * cf * sg), 6) as isolation_km from cand c left join (select *, c as s_c from shape) s on s.gx = c.gx and s.gy = c.gy")
    .replace("(l_partkey % 64)::int as gx", "(l_partkey % 64 + 1120)::int as gx")
    .replace("(l_orderkey % 64)::int as gy", "(l_orderkey % 64 + 736)::int as gy")
)
def isolation_geographic(spark, d):
    cells = _t64(spark, d).select((F.col("gx") + round(70 * PER_DEGREE)).alias("gx"), (F.col("gy") + round(46 * PER_DEGREE)).alias("gy"), "elev")
    return iso.geographic_isolation(stencil.candidate_peaks(cells), cells, PER_DEGREE, 1.0).withColumn("isolation_km", F.round("isolation_km", 6))


_CAP = "cap as (select gx, gy, elev, lat - degrees(30000 / 6371010.0) as s, lat + degrees(30000 / 6371010.0) as n, lng - degrees(asin(sin(30000 / 6371010.0) / cos(radians(lat)))) as w, lng + degrees(asin(sin(30000 / 6371010.0) / cos(radians(lat)))) as e from geo)"


@query(_sql("t64", _GEO_SQL, _CAP, "tile as (select floor(lat)::int as tlat, floor(lng)::int as tlng, max(elev) as top from geo group by 1, 2)", "select c.gy::bigint * 64 + c.gx as peak_id, t.tlat || '/' || t.tlng as tile_id from cap c join tile t on t.tlat between floor(c.s) and floor(c.n) and t.tlng between floor(c.w) and floor(c.e) and t.top > c.elev"))
def candidate_tiles_cap(spark, d):
    at = _geo(spark, d)
    tiles = at.groupBy(F.floor("lat").cast("int").alias("lat"), F.floor("lng").cast("int").alias("lng")).agg(F.max("elev").alias("max_elev")).withColumn("tile_id", F.concat_ws("/", "lat", "lng"))
    return iso.candidate_tiles(at.withColumn("peak_id", F.col("gy").cast("long") * 64 + F.col("gx")), tiles, F.lit(30000.0))


@query(_sql("t64", _GEO_SQL, _CAP, "select gx, gy, round(s, 6) as min_lat, round(w, 6) as min_lng, round(n, 6) as max_lat, round(e, 6) as max_lng from cap"))
def cap_bounds(spark, d):
    box = geo.cap_bounds(F.col("lat"), F.col("lng"), F.lit(30000.0))
    return _geo(spark, d).select("gx", "gy", *(F.round(box[c], 6).alias(c) for c in ("min_lat", "min_lng", "max_lat", "max_lng")))


# --- geodesy -------------------------------------------------------------------

_FROM = "46.5::double"
_H = f"(sin(radians({_FROM} - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians({_FROM})) * sin(radians(-100 - lng) / 2) ** 2)"


@query(_sql("t64", _GEO_SQL, "select gx, gy, round(lat, 6) as lat, round(lng, 6) as lng from geo"))
def latlng(spark, d):
    return _geo(spark, d).select("gx", "gy", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(_sql("t64", _GEO_SQL, f"select gx, gy, round(2 * 6371010.0 * atan2(sqrt({_H}), sqrt(1 - {_H})), 4) as metres from geo"))
def haversine(spark, d):
    return _geo(spark, d).select("gx", "gy", F.round(geo.haversine_m(F.col("lat"), F.col("lng"), F.lit(46.5), F.lit(-100.0)), 4).alias("metres"))


@query(
    _sql(
        "t64",
        _GEO_SQL,
        "a as (select gx, gy, sin(radians((lat + 46.5) / 2)) ** 2 as sf, cos(radians((lat + 46.5) / 2)) ** 2 as cf, sin(radians((lat - 46.5) / 2)) ** 2 as sg, cos(radians((lat - 46.5) / 2)) ** 2 as cg, sin(radians((lng + 100) / 2)) ** 2 as sl, cos(radians((lng + 100) / 2)) ** 2 as cl from geo)",
        "b as (select *, sg * cl + cf * sl as s, cg * cl + sf * sl as c from a)",
        "w as (select *, atan2(sqrt(s), sqrt(c)) as w, sqrt(s * c) / atan2(sqrt(s), sqrt(c)) as r, 1 / 298.257223563::double as f from b)",
        "select gx, gy, round(2000 * w * 6378.137 * (1 + f * (3 * r - 1) / (2 * c) * sf * cg - f * (3 * r + 1) / (2 * s) * cf * sg), 4) as metres from w",
    )
)
def ellipsoid(spark, d):
    return _geo(spark, d).select("gx", "gy", F.round(geo.ellipsoid_m(F.col("lat"), F.col("lng"), F.lit(46.5), F.lit(-100.0)), 4).alias("metres"))


@query(_sql("t64", _GEO_SQL, f"select gx, gy, round(atan2(sin(radians(lng + 100)) * cos(radians({_FROM})), cos(radians(lat)) * sin(radians({_FROM})) - sin(radians(lat)) * cos(radians({_FROM})) * cos(radians(lng + 100))), 9) as angle from geo"))
def bearing(spark, d):
    return _geo(spark, d).select("gx", "gy", F.round(geo.bearing(F.col("lat"), F.col("lng"), F.lit(46.5), F.lit(-100.0)), 9).alias("angle"))


def _world(spark, d):
    """Positions all over the globe."""
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 37 % 1700) / 10.0 - 85).alias("lat"), ((F.col("o_orderkey") * 53 % 3600) / 10.0 - 180).alias("lng"))


_WORLD = "world as (select o_orderkey as id, (o_orderkey * 37 % 1700) / 10.0::double - 85 as lat, (o_orderkey * 53 % 3600) / 10.0::double - 180 as lng from orders)"
_ZONE = "zone as (select *, case when lat >= 56 and lat < 64 and lng >= 3 and lng < 12 then 32 when lat >= 72 and lat < 84 and lng >= 0 and lng < 42 then case when lng < 9 then 31 when lng < 21 then 33 when lng < 33 then 35 else 37 end else floor((lng + 180) / 6)::int + 1 end as zone, case when lat < -80 or lat > 84 then 'Z' else substr('CDEFGHJKLMNPQRSTUVWX', least(floor((lat + 80) / 8), 19)::int + 1, 1) end as band from world)"
_E2 = geo.UTM_E2
_S2 = _E2 / (1 - _E2)
_M = f"(({1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256!r}) * phi - ({3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024!r}) * sin(2 * phi) + ({15 * _E2**2 / 256 + 45 * _E2**3 / 1024!r}) * sin(4 * phi) - ({35 * _E2**3 / 3072!r}) * sin(6 * phi)) * 6378137.0"


@query(
    "with "
    + ", ".join(
        [
            _WORLD,
            _ZONE,
            f"u as (select *, radians(lat) as phi, cos(radians(lat)) * radians(lng - (zone * 6 - 183)) as a, tan(radians(lat)) ** 2 as t, {_S2!r} * cos(radians(lat)) ** 2 as c, 6378137.0 / sqrt(1 - {_E2!r} * sin(radians(lat)) ** 2) as n from zone)",
        ]
    )
    + f" select id, zone::int as zone, band, round(0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {_S2!r}) * a ** 5 / 120) + 500000, 3) as easting, round(0.9996 * ({_M} + n * tan(phi) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {_S2!r}) * a ** 6 / 720)) + case when lat < 0 then 10000000 else 0 end, 3) as northing from u"
)
def utm_forward(spark, d):
    u = geo.to_utm(F.col("lat"), F.col("lng"))
    return _world(spark, d).select("id", u["zone"].alias("zone"), u["band"].alias("band"), F.round(u["easting"], 3).alias("easting"), F.round(u["northing"], 3).alias("northing"))


@query(f"with {_WORLD} select id, round(lat, 5) as lat, round(lng, 5) as lng from world")
def utm_inverse(spark, d):
    """To UTM and back gives the position, in all zones of both hemispheres."""
    u = _world(spark, d).withColumn("u", geo.to_utm(F.col("lat"), F.col("lng")))
    back = geo.from_utm(F.col("u.zone"), F.col("u.easting"), F.col("u.northing"), F.col("lat") >= 0)
    return u.select("id", F.round(back["lat"], 5).alias("lat"), F.round(back["lng"], 5).alias("lng"))


@query(f"with {_WORLD} select id, round(((lng + 190 + 360) % 360) - 180, 6) as wrapped, round(case when lat >= 0 then lat + 0.001 else lat - 0.001 end, 6) as adjusted, round(100 * abs(lat - trunc(lat)))::int as hundredths, floor(lat / 5) * 5 as low, ceil(lat / 5) * 5 as high, round(lat * 0.3048, 6) as metres, round(lat * 3.28084, 6) as feet from world")
def coordinate_helpers(spark, d):
    at = _world(spark, d)
    lat = F.col("lat")
    return at.select("id", F.round(geo.wrap_longitude(F.col("lng") + 10), 6).alias("wrapped"), F.round(geo.adjust_coordinate(lat), 6).alias("adjusted"), geo.fractional_degree(lat).alias("hundredths"), geo.round_down(lat, 5).cast("double").alias("low"), geo.round_up(lat, 5).cast("double").alias("high"), F.round(geo.feet_to_metres(lat), 6).alias("metres"), F.round(geo.metres_to_feet(lat), 6).alias("feet"))


# --- polygons ------------------------------------------------------------------

_INSIDE = f"inside as (select g.gx, g.gy from geo g, edge e group by g.gx, g.gy, e.poly_id having sum((((e.y1 < g.lat and e.y2 >= g.lat) or (e.y2 < g.lat and e.y1 >= g.lat)) and e.x1 + (g.lat - e.y1) / nullif(e.y2 - e.y1, 0) * (e.x2 - e.x1) < g.lng)::int) % 2 = 1)"


@query(_sql("t64", _GEO_SQL, _POLY_SQL, _INSIDE, "select distinct gx, gy from inside"))
def point_in_polygon(spark, d):
    return polygon.filter_points(_geo(spark, d), _polygon_table(spark)).select("gx", "gy")


@query(_sql("t64", _GEO_SQL, _POLY_SQL, _INSIDE, "select gx, gy from geo except select gx, gy from inside"))
def outside_polygon(spark, d):
    return polygon.filter_points(_geo(spark, d), _polygon_table(spark), invert=True).select("gx", "gy")


@query(_sql("t64", _GEO_SQL, _POLY_SQL, _INSIDE, "select count(i.gx) as inside, count(*) - count(i.gx) as outside from geo g left join (select distinct gx, gy from inside) i on i.gx = g.gx and i.gy = g.gy"))
def inside_counts(spark, d):
    at = _geo(spark, d).select("gx", "gy", "lat", "lng")
    marked = at.join(polygon.filter_points(at, _polygon_table(spark)).select("gx", "gy", F.lit(1).alias("i")), ["gx", "gy"], "left")
    return marked.agg(F.count("i").alias("inside"), (F.count("*") - F.count("i")).alias("outside"))


@query(_sql("t64", _GEO_SQL, _POLY_SQL.replace("edge(", "edge0("), "edge as (select poly_id, case when x1 < -108 then x1 + 360 else x1 end as x1, y1, case when x2 < -108 then x2 + 360 else x2 end as x2, y2 from edge0)", _INSIDE.replace("< g.lng", "< (case when g.lng < -108 then g.lng + 360 else g.lng end)"), "select distinct gx, gy from inside"))
def polygon_wrap(spark, d):
    return polygon.filter_points(_geo(spark, d), _polygon_table(spark), wrap=-108.0).select("gx", "gy")


_BOX = "box as (select distinct gx // 8 as bx, gy // 8 as bz, -110.0::double + (gx // 8) * 0.5 as w, 44.0::double - (gy // 8 + 1) * 0.5 as s from t64), corner as (select bx, bz, w + dx * 0.5 as lng, s + dy * 0.5 as lat from box, (values (0, 0), (0, 1), (1, 1), (1, 0)) c(dx, dy)), side as (select bx, bz, w + ax * 0.5 as px, s + ay * 0.5 as py, w + bx2 * 0.5 as qx, s + by2 * 0.5 as qy from box, (values (0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0)) c(ax, ay, bx2, by2))"


@query(
    _sql(
        "t64",
        _POLY_SQL,
        _BOX,
        "a as (select c.bx, c.bz from corner c, edge e group by c.bx, c.bz, c.lng, c.lat, e.poly_id having sum((((e.y1 < c.lat and e.y2 >= c.lat) or (e.y2 < c.lat and e.y1 >= c.lat)) and e.x1 + (c.lat - e.y1) / nullif(e.y2 - e.y1, 0) * (e.x2 - e.x1) < c.lng)::int) % 2 = 1)",
        "b as (select s.bx, s.bz, (e.x2 - e.x1) * (s.qy - s.py) - (e.y2 - e.y1) * (s.qx - s.px) as turn, (s.px - e.x1) * (s.qy - s.py) - (s.py - e.y1) * (s.qx - s.px) as n1, (s.px - e.x1) * (e.y2 - e.y1) - (s.py - e.y1) * (e.x2 - e.x1) as n2 from side s, edge e)",
        "v as (select bx, bz from box, edge where x1 between w and w + 0.5 and y1 between s and s + 0.5)",
        "select distinct bx::int as bx, bz::int as \"by\" from (select bx, bz from a union all select bx, bz from b where turn <> 0 and n1 / turn between 0 and 1 and n2 / turn between 0 and 1 union all select bx, bz from v)",
    )
)
def rect_intersects(spark, d):
    boxes = _t64(spark, d).select(F.floor(F.col("gx") / 8).cast("int").alias("bx"), F.floor(F.col("gy") / 8).cast("int").alias("by")).distinct()
    at = boxes.withColumn("lng", F.lit(-110.0) + F.col("bx") * 0.5).withColumn("lat", F.lit(44.0) - (F.col("by") + 1) * 0.5)
    return polygon.tiles_in_polygons(at, _polygon_table(spark), 0.5).select("bx", "by")


@query("select c_nationkey as poly_id, min((c_custkey * 37 % 3600) / 10.0::double - 180) as min_lng, min((c_custkey * 53 % 1700) / 10.0::double - 85) as min_lat, max((c_custkey * 37 % 3600) / 10.0::double - 180) as max_lng, max((c_custkey * 53 % 1700) / 10.0::double - 85) as max_lat from customer group by 1")
def polygon_bounds(spark, d):
    """Rings of one point a customer, in order of their keys, by nation."""
    key = F.col("c_custkey")
    points = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("poly_id"), F.struct(key, ((key * 37 % 3600) / 10.0 - 180).alias("lng"), ((key * 53 % 1700) / 10.0 - 85).alias("lat")).alias("p"))
    rings = points.groupBy("poly_id").agg(F.sort_array(F.collect_list("p")).alias("ps")).select("poly_id", F.transform("ps", lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("ring"))
    b = polygon.ring_bounds(F.col("ring"))
    return rings.select("poly_id", *(b[c].alias(c) for c in ("min_lng", "min_lat", "max_lng", "max_lat")))


# --- coordinate systems and text -----------------------------------------------


def _extents(spark, d):
    at = spark.read.parquet(f"{d}/supplier.parquet")
    lat, lng = (F.col("s_suppkey") % 20 + 30).cast("double"), (F.col("s_suppkey") % 50 - 120).cast("double")
    return at.select(F.col("s_suppkey").alias("id"), lat.alias("min_lat"), lng.alias("min_lng"), (lat + 1).alias("max_lat"), (lng + 1).alias("max_lng"))


_EXT = "ext as (select s_suppkey as id, (s_suppkey % 20 + 30)::double as min_lat, (s_suppkey % 50 - 120)::double as min_lng, (s_suppkey % 20 + 31)::double as max_lat, (s_suppkey % 50 - 119)::double as max_lng from supplier)"


@query(f"with {_EXT} select min(min_lat) as min_lat, min(min_lng) as min_lng, max(max_lat) as max_lat, max(max_lng) as max_lng from ext")
def crs_merge(spark, d):
    return crs.merged_extent(_extents(spark, d))


@query(f"with {_EXT} select id, round((min_lng - (select min(min_lng) from ext)) * 16)::int as dx, round(((select max(max_lat) from ext) - max_lat) * 16)::int as dy from ext")
def offsets_to(spark, d):
    at = _extents(spark, d)
    return crs.offsets_to_extent(at, crs.merged_extent(at), 16).select("id", "dx", "dy")


@query(
    f"select '{GRID.line()}' as line union all select printf('P,%d,%d,%d,%.2f', s_suppkey, (s_suppkey % 10)::int, (s_suppkey % 7)::int, s_acctbal) from supplier"
    " union all select printf('S,%d,%s,%d,%d,%.2f', c_custkey, substr('pfbe', (c_custkey % 4 + 1)::int, 1), (c_custkey % 50)::int, (c_custkey % 70)::int, c_acctbal) from customer"
    " union all select printf('R,%d,%d,%d,%.2f,%d,%d', n_nationkey, n_regionkey::int, (n_nationkey % 7)::int, n_nationkey / 4.0::double, (n_nationkey % 4 + 1)::int, (n_nationkey % 2)::int) from nation"
    " union all select printf('N,%d,%d,%d', s_suppkey, (s_suppkey // 2)::int, (s_suppkey % 5 - 1)::int) from supplier"
    " union all select printf('E,%d,%d', n_nationkey, (n_regionkey + 1)::int) from nation"
)
def dvt_lines(spark, d):
    """All lines of a tree file: the grid, and the five kinds."""
    read = lambda t, key, *columns: spark.read.parquet(f"{d}/{t}.parquet").select(F.col(key[0]).alias(key[1]), *columns)
    at = lambda c, n, name: (F.col(c) % n).cast("int").alias(name)
    tables = {
        "P": read("supplier", ("s_suppkey", "peak_id"), at("s_suppkey", 10, "x"), at("s_suppkey", 7, "y"), F.col("s_acctbal").alias("elev")),
        "S": read("customer", ("c_custkey", "saddle_id"), F.element_at(F.array(*map(F.lit, "pfbe")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("type"), at("c_custkey", 50, "x"), at("c_custkey", 70, "y"), F.col("c_acctbal").alias("elev")),
        "R": read("nation", ("n_nationkey", "runoff_id"), F.col("n_regionkey").cast("int").alias("x"), at("n_nationkey", 7, "y"), (F.col("n_nationkey") / 4).alias("elev"), (F.col("n_nationkey") % 4 + 1).cast("int").alias("quadrants"), at("n_nationkey", 2, "inside_peak")),
        "N": read("supplier", ("s_suppkey", "peak_id"), F.floor(F.col("s_suppkey") / 2).cast("int").alias("parent_id"), (F.col("s_suppkey") % 5 - 1).cast("int").alias("saddle_id")),
        "E": read("nation", ("n_nationkey", "runoff_id"), (F.col("n_regionkey") + 1).cast("int").alias("peak_id")),
    }
    return sinks.dvt_lines(GRID, tables).select("line")


@query(_sql("t64", _PEAKS_SQL, _ISO, f"select printf('%.4f,%.4f,%.2f,%.4f,%.4f,%.4f', 44.0 - c.gy / {PER_DEGREE}.0, -110.0 + c.gx / {PER_DEGREE}.0, c.elev::double, coalesce(44.0 - b.y / {PER_DEGREE}.0, 0.0), coalesce(-110.0 + b.x / {PER_DEGREE}.0, 0.0), coalesce(b.dist, -1.0)) as line from cand c left join best b on b.gx = c.gx and b.gy = c.gy and b.r = 1"))
def isolation_lines(spark, d):
    cells = _t64(spark, d)
    return sinks.isolation_lines(iso.isolation(stencil.candidate_peaks(cells), cells, BLOCK).withColumnRenamed("distance", "isolation_km"), GRID)


@query(_sql("t64", _PEAKS_SQL, _ISO, f"select printf('isolation-%02d-%03d.txt', floor(44.0 - c.gy / {PER_DEGREE}.0)::int, floor(-110.0 + c.gx / {PER_DEGREE}.0)::int) as file, printf('%.4f,%.4f,%.2f,%.4f,%.4f,%.4f', 44.0 - c.gy / {PER_DEGREE}.0, -110.0 + c.gx / {PER_DEGREE}.0, c.elev::double, coalesce(44.0 - b.y / {PER_DEGREE}.0, 0.0), coalesce(-110.0 + b.x / {PER_DEGREE}.0, 0.0), coalesce(b.dist, -1.0)) as line from cand c left join best b on b.gx = c.gx and b.gy = c.gy and b.r = 1"))
def isolation_tiles(spark, d):
    cells = _t64(spark, d)
    return sinks.isolation_tiles(iso.isolation(stencil.candidate_peaks(cells), cells, BLOCK).withColumnRenamed("distance", "isolation_km"), GRID)


@query()
def prominence_lines(spark, d):
    return sinks.prominence_lines(prominence.prominence(_t64(spark, d), TILE), GRID, geo.FEET_PER_METRE)


@query(
    "with box as (select o_orderkey as id, (o_orderkey % 80)::double as south, (o_custkey % 300 - 120)::double as west, (o_orderkey % 2 + 1) / 2.0::double as high, (o_custkey % 3 + 1) / 4.0::double as wide from orders),"
    " tile as (select id, south + a.k * 0.25 as lat, west + b.k * 0.25 as lng from box, range(0, 8) a(k), range(0, 8) b(k) where a.k * 0.25 < high and b.k * 0.25 < wide),"
    " turned as (select id, lat, case when lng >= 180 then lng - 360 else lng end as lng from tile)"
    " select id, lat, lng, printf('ned19_n%02dx%02d_%s%03dx%02d.flt', trunc(lat + 0.25)::int, round(100 * (lat + 0.25 - trunc(lat + 0.25)))::int, case when lng < 0 then 'w' else 'e' end, trunc(abs(lng))::int, round(100 * (abs(lng) - trunc(abs(lng))))::int) as name from turned"
)
def tile_enumeration(spark, d):
    """Files of each order's box of latitudes and longitudes."""
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    south, west = (key % 80).cast("double"), (other % 300 - 120).cast("double")
    boxes = spark.read.parquet(f"{d}/orders.parquet").select(key.alias("id"), south.alias("min_lat"), (south + (key % 2 + 1) / 2.0).alias("max_lat"), west.alias("min_lng"), (west + (other % 3 + 1) / 4.0).alias("max_lng"))
    return raster.tiles_of(boxes, "NED19").select("id", "lat", "lng", "name")


@query(f"with {_WORLD}, a as (select id, case when lat >= 0 then lat + 0.001 else lat - 0.001 end as lat, case when lng >= 0 then lng + 0.001 else lng - 0.001 end as lng from world) select id, printf('prominence-%s%02dx%02d-%s%03dx%02d', case when lat >= 0 then '' else '-' end, abs(trunc(lat))::int, round(100 * abs(lat - trunc(lat)))::int, case when lng >= 0 then '' else '-' end, abs(trunc(lng))::int, round(100 * abs(lng - trunc(lng)))::int) as name from a")
def output_names(spark, d):
    return _world(spark, d).select("id", geo.tile_name("prominence-", F.col("lat"), F.col("lng")).alias("name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
