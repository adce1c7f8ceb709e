"""Projection, patches, cubic weights, land masses, and the terrain of a raster at points."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meltemi.functions import projection
from meltemi.functions.numeric import r6
from meltemi.operators import interpolate, polygons, raster
from meltemi.operators import spatial as sp
from meltemi.plans import roles
from meltemi.plans.registry import Registry

QUERIES = Registry()
query = QUERIES.query


def _grad(along: str, across: str) -> str:
    """Centred differences inside, one-sided at the borders."""
    w = f"OVER (PARTITION BY {across} ORDER BY {along})"
    a, b = f"lag(v) {w}", f"lead(v) {w}"
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0 WHEN {a} IS NULL THEN {b} - v WHEN {b} IS NULL THEN v - {a} ELSE ({b} - {a}) / 2 END"


def _sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


def laea_sql(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing of EPSG:3035 in SQL."""
    e2 = 2 / 298.257222101 - 1 / 298.257222101**2
    e = math.sqrt(e2)
    q = lambda s: f"((1 - {e2!r}) * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"
    s0 = "sin(radians(52))"
    qp = q("1e0")
    b0, b = f"asin({q(s0)} / {qp})", f"asin(greatest(-1, least(1, {q(f'sin(radians({lat}))')} / {qp})))"
    rq = f"(6378137e0 * sqrt({qp} / 2))"
    d = f"(6378137e0 * cos(radians(52)) / sqrt(1 - {e2!r} * {s0} * {s0}) / ({rq} * cos({b0})))"
    t = f"radians({lon} - 10)"
    r = f"({rq} * sqrt(2 / (1 + sin({b0}) * sin({b}) + cos({b0}) * cos({b}) * cos({t}))))"
    return (
        f"(4321000e0 + {r} * {d} * cos({b}) * sin({t}))",
        f"(3210000e0 + {r} / {d} * (cos({b0}) * sin({b}) - sin({b0}) * cos({b}) * cos({t})))",
    )


_EAST, _NORTH = laea_sql("lon", "lat")


@query("s23_laea", _sql(roles.STATIONS, body=f"SELECT station_id, round({_EAST}, 3) AS east, round({_NORTH}, 3) AS north FROM stations"))
def laea(spark, d):
    """Stations in metres of the equal-area projection."""
    s = roles.stations(spark, d)
    east, north = projection.laea(F.col("lon"), F.col("lat"))
    return s.select("station_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


def _projected(df, lon: str, lat: str, x: str, y: str):
    east, north = projection.laea(F.col(lon), F.col(lat))
    return df.withColumns({x: east, y: north})


_SEG = "seg AS (SELECT {e1} AS x1, {n1} AS y1, {e2} AS x2, {n2} AS y2 FROM segments)".format(**dict(zip(("e1", "n1", "e2", "n2"), (*laea_sql("x1", "y1"), *laea_sql("x2", "y2")))))
_PTS = f"pts AS (SELECT station_id AS id, {_EAST} AS px, {_NORTH} AS py FROM stations)"
_T = "greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"


@query("g06_coast_km", _sql(roles.STATIONS, roles.SEGMENTS, _PTS, _SEG, f"d AS (SELECT id, px - (x1 + {_T} * (x2 - x1)) AS ex, py - (y1 + {_T} * (y2 - y1)) AS ey FROM pts, seg)", body="SELECT id AS station_id, round(min(sqrt(ex * ex + ey * ey)) / 1000, 4) AS coast_km FROM d GROUP BY 1"))
def coast_km(spark, d):
    """Kilometres from each station to the coast, in the equal-area projection."""
    s = _projected(_projected(roles.segments(spark, d), "x1", "y1", "e1", "n1"), "x2", "y2", "e2", "n2")
    s = s.select(F.col("e1").alias("x1"), F.col("n1").alias("y1"), F.col("e2").alias("x2"), F.col("n2").alias("y2"))
    p = _projected(roles.stations(spark, d).withColumnRenamed("station_id", "id"), "lon", "lat", "px", "py")
    return sp.coast_distance(p, s).select(F.col("id").alias("station_id"), F.round(F.col("coast_km") / 1000, 4).alias("coast_km"))


_XY = "t AS (SELECT id AS target_id, lon * s AS x, lat AS y FROM targets, scale), c AS (SELECT cell_id, x AS i, y AS j, is_land, lon * s AS cx, lat AS cy FROM grid, scale)"
_SCALE = "scale AS (SELECT cos(radians(avg(lat))) AS s FROM grid)"
_D2 = "round((t.x - cx) * (t.x - cx) + (t.y - cy) * (t.y - cy), 9)"


@query(
    "g01_patch_cells",
    _sql(
        roles.TARGETS, roles.GRID, _SCALE, _XY,
        f"n AS (SELECT target_id, arg_min(cell_id, (r, cell_id)) AS cell_id FROM (SELECT target_id, cell_id, {_D2} AS r FROM t, c) GROUP BY 1)",
        "k AS (SELECT target_id, is_land, i, j FROM n JOIN c USING (cell_id))",
        f"l AS (SELECT target_id, cell_id, row_number() OVER (PARTITION BY target_id ORDER BY {_D2}, cell_id) AS r FROM t JOIN k USING (target_id), c WHERE NOT k.is_land AND c.is_land)",
        body="SELECT target_id, cell_id FROM k JOIN c ON c.i >= greatest(k.i - 2, 0) AND c.i < greatest(k.i - 2, 0) + 4 AND c.j >= greatest(k.j - 2, 0) AND c.j < greatest(k.j - 2, 0) + 4 WHERE k.is_land UNION ALL SELECT target_id, cell_id FROM l WHERE r <= 16",
    ),
)
def patch_cells(spark, d):
    """The cells that each target is interpolated from: a block around land, the nearest land cells at sea."""
    return interpolate.patches(_targets(spark, d), roles.grid(spark, d))


@query(
    "g03_nearest_land",
    _sql(
        roles.TARGETS, roles.GRID, _SCALE, _XY,
        f"r AS (SELECT target_id, cell_id, is_land, row_number() OVER (PARTITION BY target_id ORDER BY {_D2}, cell_id) AS r FROM t, c)",
        body="SELECT target_id, coalesce(arg_min(cell_id, r) FILTER (WHERE is_land AND r <= 3), arg_min(cell_id, r)) AS cell_id FROM r GROUP BY 1",
    ),
)
def nearest_land(spark, d):
    """The nearest cell, or the nearest land among the three nearest where that is sea; some targets have none."""
    return interpolate.nearest_land(_targets(spark, d), roles.grid(spark, d), candidates=3)


def _targets(spark, d):
    return roles.targets(spark, d).select(F.col("id").alias("target_id"), "lon", "lat")


@query("g04_cubic_weights")
def cubic(spark, d):
    """The C1 cubic surface of the raster at every target, from the weights of its patch."""
    g = roles.grid(spark, d)

    def at(t):
        w = interpolate.cubic_weights(interpolate.patches(t, g), t, g)
        return w.join(g.select("cell_id", "v"), "cell_id").groupBy("target_id").agg(F.sum(F.col("weight") * F.col("v")).alias("v"), F.sum("weight").alias("total"))

    # Targets of one place have one value.
    return sp.by_place(_targets(spark, d), "target_id", ["lon", "lat"], at)


_BOXES = "b AS (SELECT s_suppkey AS polygon, 11 + (s_suppkey * 53 % 210) / 10.0e0 AS x, 33 + (s_suppkey * 37 % 100) / 10.0e0 AS y, 0.2137e0 + s_nationkey / 10.0e0 AS h FROM supplier)"
_CORNERS = (("x - h", "y - h"), ("x + h", "y - h"), ("x + h", "y + h"), ("x - h", "y + h"))


def _island_sql() -> str:
    side = "e AS ({})".format(" UNION ALL ".join("SELECT polygon, {} AS x1, {} AS y1, {} AS x2, {} AS y2 FROM b".format(*laea_sql(f"({p})", f"({q})"), *laea_sql(f"({r})", f"({s})")) for (p, q), (r, s) in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])))
    pts = f"pts AS (SELECT id, {_EAST} AS px, {_NORTH} AS py FROM targets)"
    area = "a AS (SELECT polygon, abs(sum(x1 * y2 - x2 * y1)) / 2e6 AS km2 FROM e GROUP BY 1)"
    hit = "h AS (SELECT id, polygon FROM pts JOIN e ON (y1 > py) <> (y2 > py) AND px < x1 + (py - y1) / (y2 - y1) * (x2 - x1) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"
    first = "f AS (SELECT id, min(polygon) AS polygon FROM h GROUP BY 1)"
    return _sql(roles.TARGETS, _BOXES, side, pts, area, hit, first, body="SELECT id, coalesce(polygon, -1) AS polygon, coalesce(km2 < 25000, false) AS is_island FROM targets LEFT JOIN f USING (id) LEFT JOIN a USING (polygon)")


@query("g07_is_island", _island_sql())
def is_island(spark, d):
    """Whether each target lies on a land mass below 25,000 square kilometres, in the equal-area projection."""
    s = roles.table(spark, d, "supplier").selectExpr("s_suppkey AS polygon", "11 + (s_suppkey * 53 % 210) / 10.0e0 AS x", "33 + (s_suppkey * 37 % 100) / 10.0e0 AS y", "0.2137e0 + s_nationkey / 10.0e0 AS h")
    sides = F.array(*[F.struct(*[F.expr(e).alias(n) for e, n in zip((*a, *b), ("a1", "b1", "a2", "b2"))]) for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])])
    e = s.select("polygon", F.explode(sides).alias("e")).select("polygon", "e.*")
    e = _projected(_projected(e, "a1", "b1", "x1", "y1"), "a2", "b2", "x2", "y2").select("polygon", "x1", "y1", "x2", "y2")
    p = _projected(roles.targets(spark, d), "lon", "lat", "px", "py")
    return polygons.island(p, e).select("id", F.coalesce("polygon", F.lit(-1).cast("long")).alias("polygon"), "is_island")


_TPI = "round(CASE WHEN count(n.v) FILTER (WHERE {d} <= {r2} AND NOT (n.x = c.x AND n.y = c.y)) >= 4 THEN c.v - avg(n.v) FILTER (WHERE {d} <= {r2} AND NOT (n.x = c.x AND n.y = c.y)) ELSE 0 END, 6) + 0"
_DIST = "((n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y)) * 62500"


@query("g11_tpi", _sql(roles.GRID, body=f"SELECT c.cell_id AS id, {_TPI.format(d=_DIST, r2=500**2)} AS tpi_500, {_TPI.format(d=_DIST, r2=2000**2)} AS tpi_2000 FROM grid c JOIN grid n ON n.x BETWEEN c.x - 8 AND c.x + 8 AND n.y BETWEEN c.y - 8 AND c.y + 8 GROUP BY c.cell_id, c.v"))
def tpi(spark, d):
    g = roles.grid(spark, d)
    out = raster.terrain(g.select(F.col("cell_id").alias("id"), "x", "y"), g, directions=0)
    return out.select("id", r6(F.col("tpi_500")).alias("tpi_500"), r6(F.col("tpi_2000")).alias("tpi_2000"))


def _sky_sql(cells: str = "grid") -> str:
    """Rays of 150 steps in 16 directions from every cell."""
    ray = "ray AS (SELECT q, round(-cos(2 * pi() * q / 16) * k)::INT AS dy, round(sin(2 * pi() * q / 16) * k)::INT AS dx FROM range(0, 16) a(q), range(1, 151) b(k))"
    seen = f"seen AS MATERIALIZED (SELECT c.cell_id, q, c.v AS v0, 250 * sqrt(dx * dx + dy * dy) AS far, c.x + dx AS x, c.y + dy AS y FROM {cells} c, ray WHERE c.x + dx BETWEEN 0 AND 49 AND c.y + dy BETWEEN 0 AND (SELECT max(y) FROM {cells}))"
    top = f"{seen}, top AS (SELECT s.cell_id, q, greatest(0, max((n.v - v0) / far)) AS t FROM seen s JOIN {cells} n USING (x, y) GROUP BY 1, 2)"
    return f"{ray}, {top}, sky AS (SELECT cell_id, greatest(0, 1 - sum(power(sin(atan(t)), 2)) / 16) AS svf FROM top GROUP BY 1)"


@query("g12_svf", _sql(roles.GRID, _sky_sql(), body="SELECT cell_id AS id, round(coalesce(svf, 1), 6) AS svf FROM grid LEFT JOIN sky USING (cell_id)"))
def svf(spark, d):
    g = roles.grid(spark, d)
    return raster.terrain(g.select(F.col("cell_id").alias("id"), "x", "y"), g, radii=()).select("id", r6(F.col("svf")).alias("svf"))


#: The raster of the role tables over lon and lat, its rows southwards: (a, b, c, d, e, f) of the affine transform.
TRANSFORM = (0.42, 0.0, 11.0, 0.0, -0.25, 43.0)
_RISE = "SELECT c.x, c.y, avg(n.v) FILTER (WHERE n.x = c.x + 1) - avg(n.v) FILTER (WHERE n.x = c.x - 1) AS de, -(avg(n.v) FILTER (WHERE n.y = c.y + 1) - avg(n.v) FILTER (WHERE n.y = c.y - 1)) AS dn, count(n.v) AS k FROM grid c JOIN grid n ON abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 GROUP BY 1, 2"
_SHAPE = "CASE WHEN k = 9 THEN {} ELSE 0 END"


@query(
    "g13_dem_features",
    _sql(
        roles.TARGETS, roles.GRID,
        "p AS (SELECT id, round_even((lon - 11) / 0.42, 0)::BIGINT AS x, round_even((lat - 43) / -0.25, 0)::BIGINT AS y FROM targets)",
        f"r AS ({_RISE})",
        f"s AS (SELECT c.x, c.y, {_TPI.format(d=_DIST, r2=500**2)} AS tpi_500 FROM grid c JOIN grid n ON n.x BETWEEN c.x - 2 AND c.x + 2 AND n.y BETWEEN c.y - 2 AND c.y + 2 GROUP BY c.x, c.y, c.v)",
        body="SELECT id, round(coalesce(" + _SHAPE.format("cos(atan2(de, dn))") + ", 0), 6) AS northness, round(coalesce(" + _SHAPE.format("sin(atan2(de, dn))") + ", 0), 6) AS eastness, round(coalesce(" + _SHAPE.format("degrees(atan(sqrt(de * de + dn * dn) / 500))") + ", 0), 6) AS slope_deg, coalesce(tpi_500, 0) AS tpi_500 FROM p LEFT JOIN r USING (x, y) LEFT JOIN s USING (x, y)",
    ),
)
def dem_features(spark, d):
    """Slope, aspect and position of the raster's pixel that each target lies on; neutral values off the raster."""
    out = raster.sampled(roles.targets(spark, d).select("id", "lon", "lat"), roles.grid(spark, d), TRANSFORM, 250.0, 250.0, radii=(500.0,), directions=0)
    names = {"dem_northness": "northness", "dem_eastness": "eastness", "dem_slope_deg": "slope_deg", "tpi_500": "tpi_500"}
    return out.select("id", *[r6(F.col(a)).alias(b) for a, b in names.items()])


_CLIP = "c AS (SELECT x, y, v - 1200 AS v, 11 + (x + 0.5e0) * 0.42e0 AS lon, 43 - (y + 0.5e0) * 0.25e0 AS lat FROM grid)"


@query(
    "g16_raster_clip",
    _sql(
        roles.GRID, _BOXES, _CLIP,
        body="SELECT x::BIGINT AS x, y::BIGINT AS y, round(greatest(v, 0), 6) AS v FROM c WHERE EXISTS (SELECT 1 FROM b WHERE abs(c.lon - b.x) + abs(c.lat - b.y) < b.h)",
    ),
)
def clip(spark, d):
    """The raster's cells within diamonds around the suppliers, negative heights raised to 0."""
    s = roles.table(spark, d, "supplier").selectExpr("s_suppkey AS polygon", "11 + (s_suppkey * 53 % 210) / 10.0e0 AS x", "33 + (s_suppkey * 37 % 100) / 10.0e0 AS y", "0.2137e0 + s_nationkey / 10.0e0 AS h")
    corner = [("x - h", "y"), ("x", "y - h"), ("x + h", "y"), ("x", "y + h")]
    sides = F.array(*[F.struct(*[F.expr(e).alias(n) for e, n in zip((*a, *b), ("x1", "y1", "x2", "y2"))]) for a, b in zip(corner, corner[1:] + corner[:1])])
    e = s.select("polygon", F.explode(sides).alias("e")).select("polygon", "e.*")
    g = roles.grid(spark, d).select("x", "y", (F.col("v") - 1200).alias("v"))
    return raster.clipped(g, e, TRANSFORM).select("x", "y", r6(F.col("v")).alias("v"))


_ROSE = "SELECT c.x, c.y, sum(CASE WHEN n.x > c.x THEN n.v WHEN n.x < c.x THEN -n.v ELSE 0 END) / 3 / 500 AS de, sum(CASE WHEN n.y > c.y THEN n.v WHEN n.y < c.y THEN -n.v ELSE 0 END) / 3 / 500 AS dn, count(n.v) AS k FROM grid c JOIN grid n ON abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 GROUP BY 1, 2"


@query("g10_aspect", _sql(roles.GRID, f"r AS ({_ROSE})", body="SELECT x, y, round(CASE WHEN k = 9 THEN de / sqrt(de * de + dn * dn) ELSE 0 END, 5) + 0 AS eastness, round(CASE WHEN k = 9 THEN dn / sqrt(de * de + dn * dn) ELSE 0 END, 5) + 0 AS northness FROM r"))
def aspect(spark, d):
    """The direction of the rise over 3 x 3 cells."""
    out = sp.slopes(roles.grid(spark, d).select("x", "y", "v"))
    return out.select("x", "y", F.round("eastness", 5).alias("eastness"), F.round("northness", 5).alias("northness"))


@query("g05_static_terrain", _sql(roles.GRID, f"a AS (SELECT cell_id, x, y, v, {_grad('x', 'y')} AS gx, {_grad('y', 'x')} AS gy FROM grid)", "s AS (SELECT cell_id, x, y, v, cos(atan2(gx, gy)) AS northness, sin(atan2(gx, gy)) AS eastness FROM a)", body="SELECT c.cell_id, round(avg(n.v), 6) AS elev_m, round(avg(n.northness), 6) + 0 AS northness, round(avg(n.eastness), 6) + 0 AS eastness FROM s c JOIN s n ON n.x BETWEEN greatest(c.x - 2, 0) AND greatest(c.x - 2, 0) + 3 AND n.y BETWEEN greatest(c.y - 2, 0) AND greatest(c.y - 2, 0) + 3 GROUP BY 1"))
def static_terrain(spark, d):
    """Mean height and aspect of the block of cells around each cell."""
    return interpolate.static_terrain(roles.grid(spark, d)).select("cell_id", *[r6(F.col(c)).alias(c) for c in ("elev_m", "northness", "eastness")])


_SIDES = ((0, 1, 0), (1, 0, 90), (0, -1, 180), (-1, 0, 270))


@query("g09_shared_segments", _sql(roles.TARGETS, "s AS (SELECT id, b, greatest(0, least(id % 7 - 2, id % 7 - 2 + id % 5)) / 10.0e0 AS lo, least(5, greatest(id % 7 - 2, id % 7 - 2 + id % 5)) / 10.0e0 AS hi, id % 5 AS n FROM targets, (VALUES (0), (90), (180), (270)) v(b))", body="SELECT id, b::DOUBLE AS b, round((lo + hi) / 2, 6) AS d FROM s WHERE n > 0 AND lo <= hi"))
def shared_segments(spark, d):
    """Distances from targets to coasts that lie on a ray, half a degree long, by the middle of what they share."""
    t = roles.targets(spark, d)
    near, far = (F.col("id") % 7 - 2) / 10.0, (F.col("id") % 7 - 2 + F.col("id") % 5) / 10.0
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(float(b)).alias("b")) for x, y, b in _SIDES]))
    s = t.select("id", F.col("lon").alias("px"), F.col("lat").alias("py"), near.alias("near"), far.alias("far"), sides.alias("s")).select("*", "s.*")
    for k, at in ((1, "near"), (2, "far")):
        s = s.withColumns({f"x{k}": F.col("px") + F.col("dx") * F.col(at), f"y{k}": F.col("py") + F.col("dy") * F.col(at)})
    hit = sp.along_hit(*map(F.col, ("px", "py", "b", "x1", "y1", "x2", "y2")), F.lit(0.5))
    return s.select("id", "b", r6(hit).alias("d")).where("d is not null")
