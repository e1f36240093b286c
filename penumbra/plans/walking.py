"""Queries over geometry, sun, shade, the graph and routes."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from ..functions import geo, rules, sun, tags
from ..operators import boundary, graph, guards, routing, sequence, shade
from ..operators.spatial import points_near_segments
from ..session import by_rows, dealt, keep, remove, shared_folder, ship_package
from ..sources import releases, tile_store
from . import service
from .lens import view, with_views
from .registry import query

#: A mid-afternoon sun in August at the centre of the projection.
LPM, SUN_X, SUN_Y = 0.5136733851243347, 0.7305095388619901, 0.6829024920379502
#: A small area with a notch, as (lat, lon) corners.
AREA = [(37.4905, 127.0205), (37.4905, 127.0395), (37.4985, 127.0397), (37.4945, 127.0305), (37.5055, 127.0315), (37.5065, 127.0203)]


#: Rows of samples and cells that come of one node's edges and building, about.
_SPREAD = 8


def _box_shadows(spark, sf):
    """Rectangles with their shadow vectors, and the boxes around both."""
    reach = F.least(F.col("height") * LPM, F.lit(200.0))
    b = by_rows(view(spark, sf, "buildings"), _SPREAD * view(spark, sf, "nodes").count(), "id").withColumns({"vx": reach * SUN_X, "vy": reach * SUN_Y})
    return b.select("x0", "x1", "y0", "y1", "vx", "vy", F.least("x0", F.col("x0") + F.col("vx")).alias("minx"), F.greatest("x1", F.col("x1") + F.col("vx")).alias("maxx"), F.least("y0", F.col("y0") + F.col("vy")).alias("miny"), F.greatest("y1", F.col("y1") + F.col("vy")).alias("maxy"))


def _in_shadow():
    """A point is in the shadow of a rectangle if moving it back along the vector for some share of it meets the rectangle."""
    enter = F.greatest(F.lit(0.0), (F.col("px") - F.col("x1")) / F.col("vx"), (F.col("py") - F.col("y1")) / F.col("vy"))
    leave = F.least(F.lit(1.0), (F.col("px") - F.col("x0")) / F.col("vx"), (F.col("py") - F.col("y0")) / F.col("vy"))
    return enter <= leave


def _edges(spark, sf):
    """All edges, dealt out by their number: each becomes many samples and cells within its task."""
    return by_rows(view(spark, sf, "edges").withColumnRenamed("by_", "by"), _SPREAD * view(spark, sf, "nodes").count(), "edge_id")


_SHADE_SQL = f"""lens_shadows AS (SELECT x0, x1, y0, y1, least(height * {LPM!r}e0, 200e0) * {SUN_X!r}e0 AS vx, least(height * {LPM!r}e0, 200e0) * {SUN_Y!r}e0 AS vy FROM lens_buildings),
    lens_samples AS (SELECT edge_id, n, ax + (bx - ax) * ((i + 0.5e0) / n) AS px, ay + (by_ - ay) * ((i + 0.5e0) / n) AS py FROM (SELECT *, CAST(least(100, greatest(1, ceil(length / 1e1))) AS INT) AS n FROM lens_edges WHERE NOT covered) AS e, unnest(generate_series(0, n - 1)) AS s(i)),
    lens_shade AS (SELECT edge_id, count(*) AS hits FROM lens_samples AS p WHERE EXISTS (SELECT 1 FROM lens_shadows AS b WHERE p.px BETWEEN b.x0 AND b.x1 + b.vx AND p.py BETWEEN b.y0 AND b.y1 + b.vy
        AND greatest(0e0, (px - x1) / vx, (py - y1) / vy) <= least(1e0, (px - x0) / vx, (py - y0) / vy)) GROUP BY 1),
    lens_ratio AS (SELECT e.edge_id, CASE WHEN covered THEN 1e0 ELSE coalesce(hits, 0) / CAST(least(100, greatest(1, ceil(length / 1e1))) AS DOUBLE) END AS shade FROM lens_edges AS e LEFT JOIN lens_shade USING (edge_id))"""


def shaded_edges(spark, sf):
    """(edge_id, shade) of every edge: covered ones are in full shade."""
    edges = _edges(spark, sf).withColumnRenamed("edge_id", "id")
    open_edges = edges.where(~F.col("covered")).select("id", "ax", "ay", "bx", "by", "length")
    ratio = shade.edge_shade(open_edges, _box_shadows(spark, sf), _in_shadow())
    return ratio.unionByName(edges.where("covered").select("id", F.lit(1.0).alias("shade_ratio"))).select(F.col("id").alias("edge_id"), F.col("shade_ratio").alias("shade"))


@query(with_views("edges", "buildings") + ", " + _SHADE_SQL + " SELECT edge_id, round(shade, 6) AS shade_ratio FROM lens_ratio")
def edge_shade_ratio(spark, sf):
    return shaded_edges(spark, sf).select("edge_id", F.round("shade", 6).alias("shade_ratio"))


@query(with_views("edges", "buildings") + ", " + _SHADE_SQL + " SELECT edge_id, round(shade, 6) AS shade_ratio FROM lens_ratio")
def edge_shade_by_hulls(spark, sf):
    """The same from convex hulls and ray casting."""
    ship_package(spark)
    reach = F.least(F.col("height") * LPM, F.lit(200.0))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    b = dealt(view(spark, sf, "buildings")).withColumns({"poly": F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")), "vx": reach * SUN_X, "vy": reach * SUN_Y})
    edges = _edges(spark, sf).withColumnRenamed("edge_id", "id")
    shadows = keep(shade.shadow_polygons(b, F.col("vx"), F.col("vy")).select("hull", "minx", "miny", "maxx", "maxy"))  # hulls are folded once
    ratio = shade.polygon_shade(edges.where(~F.col("covered")).select("id", "ax", "ay", "bx", "by", "length"), shadows)
    both = ratio.unionByName(edges.where("covered").select("id", F.lit(1.0).alias("shade_ratio")))
    return both.select(F.col("id").alias("edge_id"), F.round("shade_ratio", 6).alias("shade_ratio"))


@query(with_views("edges", "buildings") + ", " + _SHADE_SQL + """, c AS (SELECT p.edge_id, p.px, p.py, count(*) AS n FROM lens_samples AS p JOIN lens_shadows AS b ON p.px BETWEEN b.x0 AND b.x1 + b.vx AND p.py BETWEEN b.y0 AND b.y1 + b.vy GROUP BY ALL) SELECT edge_id, max(n) AS candidates, max(n) <= 512 AS within_limit FROM c GROUP BY 1""")
def shadow_candidates(spark, sf):
    """The most shadow boxes around any sample of an edge; the limit is for each sample."""
    edges = _edges(spark, sf).withColumnRenamed("edge_id", "id").where(~F.col("covered")).select("id", "ax", "ay", "bx", "by", "length")
    counts = shade.candidate_counts(shade.edge_samples(edges), _box_shadows(spark, sf))
    return counts.groupBy(F.col("id").alias("edge_id")).agg(F.max("candidates").alias("candidates"), F.bool_and("within_limit").alias("within_limit"))


@query(with_views("nodes") + " SELECT id, round((lon - 127.032e0) * (111320e0 * cos(radians(37.498e0))), 6) AS x, round((lat - 37.498e0) * 110540e0, 6) AS y FROM lens_nodes")
def project_xy(spark, sf):
    return view(spark, sf, "nodes").select("id", F.round(geo.to_x(F.col("lon")), 6).alias("x"), F.round(geo.to_y(F.col("lat")), 6).alias("y"))


@query(with_views("nodes") + " SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM lens_nodes")
def unproject_latlon(spark, sf):
    return view(spark, sf, "nodes").select("id", F.round(geo.to_lat(F.col("y")), 7).alias("lat"), F.round(geo.to_lon(F.col("x")), 7).alias("lon"))


_PAIRS = with_views("nodes", "requests") + ", p AS (SELECT request_id, start, goal, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, a.x AS sx, a.y AS sy, b.x AS gx, b.y AS gy FROM lens_requests JOIN lens_nodes AS a ON a.id = start JOIN lens_nodes AS b ON b.id = goal)"
_HAVERSINE = "12742000e0 * asin(least(1e0, sqrt(sin(radians(lat2 - lat1) / 2) * sin(radians(lat2 - lat1) / 2) + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) * sin(radians(lon2 - lon1) / 2))))"


def placed_requests(spark, sf):
    n = view(spark, sf, "nodes")
    end = lambda name, k, axes: n.select(F.col("id").alias(name), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"), F.col("x").alias(axes + "x"), F.col("y").alias(axes + "y"))
    return view(spark, sf, "requests").join(end("start", 1, "s"), "start").join(end("goal", 2, "g"), "goal")


@query(_PAIRS + f" SELECT request_id, round({_HAVERSINE}, 5) AS meters FROM p")
def haversine_pairs(spark, sf):
    return placed_requests(spark, sf).select("request_id", F.round(geo.haversine(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))), 5).alias("meters"))


@query(_PAIRS + """, b AS (SELECT request_id, degrees(atan2((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), lat2 - lat1)) + 360e0 AS raw FROM p WHERE start <> goal),
    m AS (SELECT request_id, raw - 360e0 * floor(raw / 360e0) AS bearing, (request_id * 37) % 360 AS before FROM b),
    d AS (SELECT *, (bearing - before + 540e0) - 360e0 * floor((bearing - before + 540e0) / 360e0) - 180e0 AS delta FROM m)
    SELECT request_id, round(bearing, 6) AS bearing, round(delta, 6) AS delta, CASE WHEN abs(delta) < 15 THEN 'straight' WHEN abs(delta) < 45 THEN CASE WHEN delta > 0 THEN 'slight-right' ELSE 'slight-left' END WHEN abs(delta) < 160 THEN CASE WHEN delta > 0 THEN 'right' ELSE 'left' END
           WHEN abs(delta) = 180 THEN 'uturn-right' ELSE CASE WHEN delta > 0 THEN 'uturn-right' ELSE 'uturn-left' END END AS turn,
           (['북쪽', '북동쪽', '동쪽', '남동쪽', '남쪽', '남서쪽', '서쪽', '북서쪽'])[CAST(floor(bearing / 45 + 0.5e0) AS BIGINT) % 8 + 1] AS cardinal FROM d""")
def bearing_turns(spark, sf):
    b = placed_requests(spark, sf).where("start <> goal").select("request_id", geo.bearing(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))).alias("bearing"), ((F.col("request_id") * 37) % 360).alias("before"))
    return b.select("request_id", F.round("bearing", 6).alias("bearing"), F.round(geo.turn_delta(F.col("before"), F.col("bearing")), 6).alias("delta"), geo.turn_kind(F.col("before"), F.col("bearing")).alias("turn"), geo.cardinal(F.col("bearing")).alias("cardinal"))


@query(with_views("nodes") + """, t AS (SELECT id, CAST(floor((lon + 180e0) / 360e0 * 32768e0) AS BIGINT) AS tile_x, CAST(floor((1e0 - asinh(tan(radians(lat))) / pi()) / 2e0 * 32768e0) AS BIGINT) AS tile_y FROM lens_nodes)
    SELECT id, tile_x, tile_y, round(tile_x / 32768e0 * 360e0 - 180e0, 8) AS west, round(degrees(atan(sinh(pi() * (1e0 - 2e0 * tile_y / 32768e0)))), 8) AS north FROM t""")
def tile_of_point(spark, sf):
    t = view(spark, sf, "nodes").select("id", geo.tile_x(F.col("lon")).alias("tile_x"), geo.tile_y(F.col("lat")).alias("tile_y"))
    return t.select("id", "tile_x", "tile_y", F.round(geo.tile_west(F.col("tile_x")), 8).alias("west"), F.round(geo.tile_north(F.col("tile_y")), 8).alias("north"))


@query(_PAIRS + " SELECT request_id, least(lat1, lat2) <= 37.5e0 AND greatest(lat1, lat2) >= 37.495e0 AND least(lon1, lon2) <= 127.04e0 AND greatest(lon1, lon2) >= 127.03e0 AS meets, lat1 BETWEEN 37.494e0 AND 37.502e0 AND lon1 BETWEEN 127.024e0 AND 127.04e0 AS in_corridor FROM p")
def bbox_intersects(spark, sf):
    box = (F.least("lat1", "lat2"), F.least("lon1", "lon2"), F.greatest("lat1", "lat2"), F.greatest("lon1", "lon2"))
    fixed = tuple(F.lit(v) for v in (37.495, 127.03, 37.5, 127.04))
    return placed_requests(spark, sf).select("request_id", geo.boxes_meet(box, fixed).alias("meets"), geo.in_corridor(F.col("lat1"), F.col("lon1")).alias("in_corridor"))


@query(with_views("buildings") + " SELECT id, round((x0 + x1 + x1 + x0 + x0) / 5e0, 6) AS x, round((y0 + y0 + y1 + y1 + y0) / 5e0, 6) AS y FROM lens_buildings")
def vertex_centroids(spark, sf):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    b = view(spark, sf, "buildings").select("id", ring.alias("ring"))
    return b.select("id", F.round(geo.vertex_mean(F.col("ring"), "x"), 6).alias("x"), F.round(geo.vertex_mean(F.col("ring"), "y"), 6).alias("y"))


@query(with_views("nodes") + " SELECT min(lat) - 0.015e0 AS south, min(lon) - 0.015e0 AS west, max(lat) + 0.015e0 AS north, max(lon) + 0.015e0 AS east FROM lens_nodes")
def geometry_bounds(spark, sf):
    return view(spark, sf, "nodes").agg((F.min("lat") - 0.015).alias("south"), (F.min("lon") - 0.015).alias("west"), (F.max("lat") + 0.015).alias("north"), (F.max("lon") + 0.015).alias("east"))


@query(with_views("nodes") + " SELECT id, CAST(floor(lat * 1e6 + 0.5e0) AS BIGINT) AS lat_e6, CAST(floor(lon * 1e6 + 0.5e0) AS BIGINT) AS lon_e6, round(floor(lat * 1e6 + 0.5e0) / 1e6, 6) AS lat FROM lens_nodes")
def microdegree_roundtrip(spark, sf):
    n = view(spark, sf, "nodes").select("id", geo.micro(F.col("lat")).alias("lat_e6"), geo.micro(F.col("lon")).alias("lon_e6"))
    return n.withColumn("lat", F.round(F.col("lat_e6") / 1e6, 6))


_AREA_EDGES = "VALUES " + ", ".join(f"({a[0]!r}e0, {a[1]!r}e0, {b[0]!r}e0, {b[1]!r}e0)" for a, b in zip(AREA, AREA[1:] + AREA[:1]))
_INSIDE = "(SELECT count(*) % 2 = 1 FROM area WHERE (alat > {lat}) <> (blat > {lat}) AND {lon} < (blon - alon) * ({lat} - alat) / nullif(blat - alat, 0e0) + alon)"


def _area_edges(spark):
    return spark.createDataFrame([(*a, *b) for a, b in zip(AREA, AREA[1:] + AREA[:1])], "alat double, alon double, blat double, blon double")


def _area_box():
    return min(a for a, _ in AREA), min(b for _, b in AREA), max(a for a, _ in AREA), max(b for _, b in AREA)


@query(with_views("nodes") + f", area(alat, alon, blat, blon) AS ({_AREA_EDGES}) SELECT id, {_INSIDE.format(lat='lat', lon='lon')} AS inside FROM lens_nodes")
def boundary_contains(spark, sf):
    return boundary.inside(view(spark, sf, "nodes").select("id", "lat", "lon"), _area_edges(spark), *_area_box())


@query(with_views("nodes") + f""", area(alat, alon, blat, blon) AS ({_AREA_EDGES}), p AS (SELECT id, lat + i * 1e-3 AS lat, lon + j * 1e-3 AS lon FROM lens_nodes, unnest([-1, 0, 1]) AS s(i), unnest([-1, 0, 1]) AS t(j))
    SELECT id, bool_or({_INSIDE.format(lat='p.lat', lon='p.lon')}) AS inside FROM p GROUP BY 1""")
def boundary_contains_tolerant(spark, sf):
    return boundary.inside_tolerant(view(spark, sf, "nodes").select("id", "lat", "lon"), _area_edges(spark), *_area_box())


@query(with_views("nodes") + f", area(alat, alon, blat, blon) AS ({_AREA_EDGES}) SELECT id, {_INSIDE.format(lat='lat', lon='lon')} AS in_ring, {_INSIDE.format(lat='lat', lon='lon')} AND NOT (lat > 37.4925e0 AND lat < 37.4938e0 AND lon > 127.0231e0 AND lon < 127.0272e0) AS in_polygon FROM lens_nodes")
def point_in_ring(spark, sf):
    """Against a ring, and against a polygon with a rectangular hole."""
    point = lambda lat, lon: F.struct(F.lit(lat).alias("y"), F.lit(lon).alias("x"))
    ring = F.array(*(point(a, b) for a, b in AREA))
    hole = F.array(*(point(a, b) for a, b in ((37.4925, 127.0231), (37.4925, 127.0272), (37.4938, 127.0272), (37.4938, 127.0231))))
    return view(spark, sf, "nodes").select("id", geo.in_ring(F.col("lon"), F.col("lat"), ring).alias("in_ring"), geo.in_multipolygon(F.col("lon"), F.col("lat"), F.array(F.array(ring, hole))).alias("in_polygon"))


_HULL_SQL = with_views("nodes") + """, p AS (SELECT DISTINCT gy, CAST(gx AS DOUBLE) AS x, CAST(size AS DOUBLE) AS y FROM lens_nodes)
    SELECT a.gy, a.x, a.y, b.x AS next_x, b.y AS next_y FROM p AS a JOIN p AS b ON a.gy = b.gy AND (a.x <> b.x OR a.y <> b.y)
    WHERE NOT EXISTS (SELECT 1 FROM p AS c WHERE c.gy = a.gy AND ((b.x - a.x) * (c.y - a.y) < (b.y - a.y) * (c.x - a.x) OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0)))"""


@query(_HULL_SQL)
def convex_hulls(spark, sf):
    """Sides of the hull of each row of the grid's nodes, set off by their sizes."""
    rings = view(spark, sf, "nodes").groupBy("gy").agg(F.collect_list(F.struct(F.col("gx").cast("double").alias("x"), F.col("size").cast("double").alias("y"))).alias("ring"))
    hulls = rings.select("gy", shade.convex_hull(F.col("ring")).alias("h")).where(F.size("h") > 1)
    after = F.get("h", (F.col("k") + 1) % F.size("h"))
    return hulls.select("gy", "h", F.posexplode("h").alias("k", "p")).select("gy", "p.x", "p.y", after["x"].alias("next_x"), after["y"].alias("next_y"))


_SIMPLE_SQL = with_views("nodes").replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT gy, row_number() OVER (PARTITION BY gy ORDER BY lon, y) - 1 AS k, lon AS x, y FROM (SELECT gy, lon, lat + size * 1e-5 AS y FROM lens_nodes)),
    n AS (SELECT gy, count(*) AS n FROM o GROUP BY 1 HAVING count(*) >= 4), p AS (SELECT o.* FROM o JOIN n USING (gy) UNION ALL SELECT o.gy, n.n, x, y FROM o JOIN n USING (gy) WHERE k = 0),
    s(gy, a, b) AS (SELECT gy, CAST(0 AS BIGINT), n FROM n UNION ALL
        SELECT gy, CASE WHEN i = 0 THEN a ELSE k END, CASE WHEN i = 0 THEN k ELSE b END FROM (SELECT gy, a, b, arg_min(k, (-d, k)) AS k, max(d) AS d FROM (
            SELECT gy, a, b, k, (ax + t * dx - x) * (ax + t * dx - x) + (ay + t * dy - y) * (ay + t * dy - y) AS d FROM (
            SELECT s.gy, s.a, s.b, p.k, p.x, p.y, u.x AS ax, u.y AS ay, v.x - u.x AS dx, v.y - u.y AS dy, coalesce(greatest(0e0, least(1e0, ((p.x - u.x) * (v.x - u.x) + (p.y - u.y) * (v.y - u.y)) / nullif((v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y), 0e0))), 0e0) AS t
            FROM s JOIN p ON p.gy = s.gy AND p.k > s.a AND p.k < s.b JOIN p AS u ON u.gy = s.gy AND u.k = s.a JOIN p AS v ON v.gy = s.gy AND v.k = s.b WHERE s.b - s.a > 2)) GROUP BY 1, 2, 3) AS f, (VALUES (0), (1)) AS h(i) WHERE d > {boundary.TOLERANCE_DEG}e0 * {boundary.TOLERANCE_DEG}e0),
    kept AS (SELECT gy, a AS k FROM s UNION SELECT gy, b FROM s UNION SELECT gy, a + 1 FROM s WHERE b - a = 2)
    SELECT gy, CAST(row_number() OVER (PARTITION BY gy ORDER BY k) - 1 AS INT) AS place, round(x, 6) AS x, round(y, 6) AS y FROM kept JOIN p USING (gy, k)"""


@query(_SIMPLE_SQL)
def ring_simplified(spark, sf):
    """Points that are left of rings along the grid's rows."""
    y = F.col("lat") + F.col("size") * 1e-5
    corner = F.struct(F.col("lon").alias("x"), y.isNull().alias("unknown"), y.alias("y"))  # those of unknown height come last among equals, as in SQL
    rows = view(spark, sf, "nodes").where("gy is not null").groupBy("gy").agg(F.sort_array(F.collect_list(corner)).alias("ring"))
    done = boundary.simplified_rings(rows, "gy").where("ring is not null")
    return done.select("gy", F.posexplode("ring").alias("place", "p")).select("gy", "place", "p.x", "p.y")


_SUN_SQL = """, s AS (SELECT DISTINCT CAST(floor(epoch_ms(ts) / 900000e0) AS BIGINT) AS slot FROM events), d AS (SELECT slot, slot * 900000e0 / 86400000e0 - 0.5e0 + 2440588e0 - 2451545e0 AS d FROM s),
    m AS (SELECT slot, d, radians(357.5291e0 + 0.98560028e0 * d) AS m FROM d), l AS (SELECT slot, d, m + radians(1.9148e0 * sin(m) + 0.02e0 * sin(2 * m) + 0.0003e0 * sin(3 * m)) + radians(102.9372e0) + pi() AS l FROM m),
    e AS (SELECT slot, asin(sin(radians(23.4397e0)) * sin(l)) AS dec, radians(280.16e0 + 360.9856235e0 * d) + radians(127.032e0) - atan2(sin(l) * cos(radians(23.4397e0)), cos(l)) AS h FROM l),
    a AS (SELECT slot, asin(sin(radians(37.498e0)) * sin(dec) + cos(radians(37.498e0)) * cos(dec) * cos(h)) AS alt, atan2(sin(h), cos(h) * sin(radians(37.498e0)) - tan(dec) * cos(radians(37.498e0))) AS az FROM e)"""


@query("WITH x AS (SELECT 1)" + _SUN_SQL + " SELECT slot, round(alt, 7) AS altitude, round(sin(az), 7) AS dx, round(cos(az), 7) AS dy, alt > 0.02e0 AS up, CASE WHEN alt > 0.02e0 THEN round(least(12e0 / tan(alt), 200e0), 5) ELSE 200e0 END AS shadow_m FROM a")
def sun_state_by_slot(spark, sf):
    slots = view(spark, sf, "events").select(sun.time_slot(F.unix_millis(F.col("ts").cast("timestamp"))).alias("slot")).distinct()
    s = slots.withColumn("s", sun.sun_state(F.col("slot") * sun.SLOT_MS, geo.CENTRE_LAT, geo.CENTRE_LON))
    length = F.when(F.col("s.up"), F.round(sun.shadow_length(F.lit(12.0), F.col("s.length_per_metre")), 5)).otherwise(F.lit(sun.LONGEST_M))
    return s.select("slot", F.round("s.altitude", 7).alias("altitude"), F.round("s.dx", 7).alias("dx"), F.round("s.dy", 7).alias("dy"), F.col("s.up").alias("up"), length.alias("shadow_m"))


def _at_slots(spark, sf):
    """Each event asks for one edge at its time."""
    n = view(spark, sf, "nodes").count()
    return view(spark, sf, "events").select((F.col("event_id") % (2 * n)).alias("id"), sun.time_slot(F.unix_millis(F.col("ts").cast("timestamp"))).alias("slot"))


@query(with_views("edges", "buildings") + _SUN_SQL + """, u AS (SELECT slot, alt > 0.02e0 AS up, CASE WHEN alt > 0.02e0 THEN 1e0 / tan(alt) END AS lpm, sin(az) AS dx, cos(az) AS dy FROM a),
    w AS (SELECT DISTINCT event_id % (2 * (SELECT count(*) FROM lens_nodes)) AS edge_id, CAST(floor(epoch_ms(ts) / 900000e0) AS BIGINT) AS slot FROM events),
    p AS (SELECT *, CAST(least(100, greatest(1, ceil(length / 1e1))) AS INT) AS n FROM w JOIN lens_edges USING (edge_id) JOIN u USING (slot)),
    q AS (SELECT edge_id, slot, lpm, dx, dy, ax + (bx - ax) * ((i + 0.5e0) / n) AS px, ay + (by_ - ay) * ((i + 0.5e0) / n) AS py FROM p, unnest(generate_series(0, n - 1)) AS s(i) WHERE up AND NOT covered),
    v AS (SELECT q.*, x0, x1, y0, y1, least(height * lpm, 200e0) * dx AS vx, least(height * lpm, 200e0) * dy AS vy FROM q JOIN lens_buildings ON px BETWEEN x0 - 200 AND x1 + 200 AND py BETWEEN y0 - 200 AND y1 + 200),
    h AS (SELECT edge_id, slot, count(DISTINCT (px, py)) AS hits FROM v WHERE greatest(0e0, least((px - x0) / vx, (px - x1) / vx), least((py - y0) / vy, (py - y1) / vy)) <= least(1e0, greatest((px - x0) / vx, (px - x1) / vx), greatest((py - y0) / vy, (py - y1) / vy)) GROUP BY 1, 2)
    SELECT edge_id, slot, round(CASE WHEN covered OR NOT up THEN 1e0 ELSE coalesce(hits, 0) / CAST(n AS DOUBLE) END, 6) AS shade_ratio FROM p LEFT JOIN h USING (edge_id, slot)""")
def edge_shade_by_slot(spark, sf):
    """Shade of edges at the time they are asked for; the sun of each time slot is worked out once."""
    wanted = _at_slots(spark, sf)
    s = wanted.select("slot").distinct().withColumn("s", sun.sun_state(F.col("slot") * sun.SLOT_MS, geo.CENTRE_LAT, geo.CENTRE_LON))
    suns = s.select("slot", F.col("s.up").alias("up"), F.col("s.length_per_metre").alias("lpm"), F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"))
    b = view(spark, sf, "buildings").select(F.col("x0").alias("minx"), F.col("x1").alias("maxx"), F.col("y0").alias("miny"), F.col("y1").alias("maxy"), "height")
    reach = sun.shadow_length(F.col("height"), F.col("lpm"))
    share = lambda p, a, v: (F.col(p) - F.col(a)) / (reach * F.col(v))
    enter = F.greatest(F.lit(0.0), F.least(share("px", "minx", "dx"), share("px", "maxx", "dx")), F.least(share("py", "miny", "dy"), share("py", "maxy", "dy")))
    leave = F.least(F.lit(1.0), F.greatest(share("px", "minx", "dx"), share("px", "maxx", "dx")), F.greatest(share("py", "miny", "dy"), share("py", "maxy", "dy")))
    edges = _edges(spark, sf).withColumnRenamed("edge_id", "id").select("id", "ax", "ay", "bx", "by", "length", "covered")
    out = shade.shade_at(wanted, edges, b, suns, enter <= leave, sun.LONGEST_M)
    return out.select(F.col("id").alias("edge_id"), "slot", F.round("shade_ratio", 6).alias("shade_ratio"))


@query(with_views("buildings") + " SELECT id, round(height, 6) AS height, estimated, missing, round(least(height * 0.5136733851243347e0, 200e0), 6) AS shadow_m FROM lens_buildings")
def building_heights(spark, sf):
    key = F.when(F.col("size") % 3 == 0, F.lit("height")).when(F.col("size") % 3 == 1, F.lit("building:levels")).otherwise(F.lit("building"))
    t = view(spark, sf, "nodes").where("size % 4 <> 0").select("id", F.create_map(key, F.col("size").cast("string")).alias("tags"))
    h = t.select("id", tags.building_height(F.col("tags")).alias("h"))
    return h.select("id", F.round("h.height", 6).alias("height"), F.col("h.estimated").alias("estimated"), F.col("h.missing").alias("missing"), F.round(sun.shadow_length(F.col("h.height"), F.lit(LPM)), 6).alias("shadow_m"))


@query(with_views("buildings") + " SELECT count(*) AS total, count(*) FILTER (missing) AS missing, round(count(*) FILTER (missing) / count(*)::DOUBLE, 6) AS missing_rate, 12e0 AS fallback_height FROM lens_buildings")
def building_stats(spark, sf):
    b = view(spark, sf, "buildings").agg(F.count("*").alias("total"), F.count_if("missing").alias("missing"))
    return b.select("total", "missing", F.round(F.coalesce(F.col("missing") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6).alias("missing_rate"), F.lit(tags.UNKNOWN_M).alias("fallback_height"))


@query(with_views("nodes", "ways") + " SELECT way_id, count(*) AS n_points, CAST(sum(seq * node_id) AS BIGINT) AS order_check, round(avg(lat), 6) AS mean_lat FROM (SELECT w.*, n.lat, bool_and(n.id IS NOT NULL) OVER (PARTITION BY way_id) AS ok FROM lens_ways AS w LEFT JOIN lens_nodes AS n ON n.id = w.node_id AND n.id % 50 <> 49) WHERE ok GROUP BY 1 HAVING count(*) <= 1000")
def way_node_sequence(spark, sf):
    known = view(spark, sf, "nodes").where("id % 50 <> 49").select(F.col("id").alias("node_id"), "lat", "lon")
    w = graph.node_sequences(view(spark, sf, "ways"), known)
    return w.select("way_id", "n_points", F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p["seq"] * p["node_id"]).alias("order_check"), F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lat"]) / F.size("points"), 6).alias("mean_lat"))


_POLICY = "excluded AS (SELECT DISTINCT way_id FROM lens_edges WHERE way_id % 17 = 3), blocked AS (SELECT id AS node_id FROM lens_nodes WHERE id % 97 = 5), fb AS (SELECT DISTINCT way_id FROM lens_edges WHERE way_id % 23 = 1), dirs AS (SELECT DISTINCT way_id, 'backward' AS direction FROM lens_edges WHERE way_id % 29 = 2), g AS (SELECT e.edge_id, e.a, e.b, e.way_id, e.length, e.fallback OR fb.way_id IS NOT NULL AS fallback, coalesce(dirs.direction, e.direction) AS direction FROM lens_edges AS e LEFT JOIN fb USING (way_id) LEFT JOIN dirs USING (way_id) WHERE e.way_id NOT IN (SELECT way_id FROM excluded) AND a NOT IN (SELECT node_id FROM blocked) AND b NOT IN (SELECT node_id FROM blocked))"


def policy_edges(spark, sf):
    e = view(spark, sf, "edges").select("edge_id", "a", "b", "way_id", "length", "fallback", "direction")
    ways = e.select("way_id").distinct()
    return graph.apply_policy(e, ways.where("way_id % 17 = 3"), view(spark, sf, "nodes").where("id % 97 = 5").select(F.col("id").alias("node_id")), ways.where("way_id % 23 = 1"), ways.where("way_id % 29 = 2").withColumn("direction", F.lit("backward")))


@query(with_views("edges") + ", " + _POLICY + " SELECT edge_id, a, b, way_id, round(length, 6) AS length, fallback, direction FROM g")
def graph_edges(spark, sf):
    return policy_edges(spark, sf).select("edge_id", "a", "b", "way_id", F.round("length", 6).alias("length"), "fallback", "direction")


@query(with_views("edges") + " SELECT count(DISTINCT way_id) FILTER (way_id % 17 = 3) AS skipped_ways FROM lens_edges")
def graph_skipped_ways(spark, sf):
    return view(spark, sf, "edges").select("way_id").distinct().agg(F.count_if(F.col("way_id") % 17 == 3).alias("skipped_ways"))


@query(with_views("edges") + ", " + _POLICY + ", n AS (SELECT a AS node_id FROM g UNION ALL SELECT b FROM g) SELECT node_id, count(*) AS degree, count(*) <= 64 AS within_limit FROM n GROUP BY 1")
def node_degree(spark, sf):
    return graph.degrees(policy_edges(spark, sf))


@query(with_views("edges") + ", " + _POLICY + " SELECT a AS node_id, b AS neighbour, edge_id FROM g UNION ALL SELECT b, a, edge_id FROM g")
def adjacency(spark, sf):
    return graph.adjacency(policy_edges(spark, sf))


@query(with_views("nodes", "ways") + " SELECT DISTINCT node_id FROM lens_ways WHERE node_id % 97 = 5")
def blocked_nodes_referenced(spark, sf):
    blocked = view(spark, sf, "nodes").where("id % 97 = 5").select(F.col("id").alias("node_id"))
    return blocked.join(view(spark, sf, "ways"), "node_id", "left_semi")


_PARTS = with_views("edges").replace("WITH ", "WITH RECURSIVE ", 1) + """, k AS (SELECT a, b FROM lens_edges), arcs AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
    reach(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM arcs UNION SELECT arcs.b, min(r.component) FROM reach AS r JOIN arcs ON r.node = arcs.a JOIN recurring.reach AS o ON o.node = arcs.b WHERE r.component < o.component GROUP BY 1)"""


def _parts(spark, sf):
    """Components of the whole grid."""
    return graph.components(view(spark, sf, "edges").select("edge_id", "a", "b"), keep)


@query(_PARTS + " SELECT node AS node_id, component FROM reach")
def components(spark, sf):
    return _parts(spark, sf)


@query(_PARTS + ", s AS (SELECT component, count(*) AS n FROM reach GROUP BY 1) SELECT (SELECT component FROM s ORDER BY n DESC, component LIMIT 1) AS component, max(n) AS n_nodes, count(*) AS component_count, CAST(sum(n) - max(n) AS BIGINT) AS dropped_nodes FROM s")
def largest_component(spark, sf):
    return graph.largest_component(_parts(spark, sf))


_SNAP = with_views("edges") + """, pts AS (SELECT id AS point_id, x + (id % 31) - 15e0 AS px, y + (id % 29) - 14e0 AS py FROM lens_nodes),
    c AS (SELECT point_id, edge_id, fallback, px, py, ax, ay, bx, by_, greatest(0e0, least(1e0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM pts JOIN lens_edges ON px BETWEEN least(ax, bx) - 30 AND greatest(ax, bx) + 30 AND py BETWEEN least(ay, by_) - 30 AND greatest(ay, by_) + 30),
    d AS (SELECT *, sqrt((px - ax - t * (bx - ax)) * (px - ax - t * (bx - ax)) + (py - ay - t * (by_ - ay)) * (py - ay - t * (by_ - ay))) AS distance FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance * CASE WHEN fallback THEN 1.5e0 ELSE 1e0 END, edge_id) AS k FROM d WHERE distance <= 30)"""


def _snap_candidates(spark, sf):
    pts = view(spark, sf, "nodes").select(F.col("id").alias("point_id"), (F.col("x") + F.col("id") % 31 - 15.0).alias("px"), (F.col("y") + F.col("id") % 29 - 14.0).alias("py"))
    return points_near_segments(pts, _edges(spark, sf).select("edge_id", "ax", "ay", "bx", "by", "fallback"), 30.0, 60.0)


@query(_SNAP + " SELECT point_id, count(*) AS n_edges FROM c GROUP BY 1")
def snap_candidates(spark, sf):
    return _snap_candidates(spark, sf).groupBy("point_id").agg(F.count("*").alias("n_edges"))


@query(_SNAP + " SELECT point_id, edge_id, round(t, 6) AS t, round(distance, 6) AS distance FROM b WHERE k = 1")
def snap_best(spark, sf):
    return graph.snap(_snap_candidates(spark, sf), F.lit(30.0)).select("point_id", "edge_id", F.round("t", 6).alias("t"), F.round("distance", 6).alias("distance"))


@query(_SNAP + """, cut AS (SELECT DISTINCT edge_id, t FROM b WHERE k = 1 AND t > 1e-9 AND t < 1 - 1e-9), ts AS (SELECT edge_id, t FROM cut UNION ALL SELECT edge_id, 0e0 FROM lens_edges UNION ALL SELECT edge_id, 1e0 FROM lens_edges),
    p AS (SELECT edge_id, t AS from_t, lead(t) OVER (PARTITION BY edge_id ORDER BY t) AS to_t, row_number() OVER (PARTITION BY edge_id ORDER BY t) - 1 AS piece FROM ts)
    SELECT p.edge_id, CAST(piece AS BIGINT) AS piece, round(length * (to_t - from_t), 6) AS length FROM p JOIN lens_edges USING (edge_id) WHERE to_t IS NOT NULL""")
def edge_splits(spark, sf):
    snaps = graph.snap(_snap_candidates(spark, sf), F.lit(30.0)).select("edge_id", "t").distinct()
    pieces = graph.split_edges(view(spark, sf, "edges").select("edge_id", "a", "b", "length"), snaps)
    return pieces.select("edge_id", F.col("piece").cast("long").alias("piece"), F.round("length", 6).alias("length"))


def route_edges(spark, sf):
    return keep(_route_edges(spark, sf))


def _route_edges(spark, sf):
    return view(spark, sf, "edges").join(shaded_edges(spark, sf), "edge_id").select("edge_id", "a", "b", "length", "steps", "fallback", "direction", "shade")


def asked(spark, sf):
    """Every request whose ends differ and are no further apart than the longest route."""
    r = placed_requests(spark, sf).where("start <> goal")
    return r.where(geo.euclid(F.col("sx"), F.col("sy"), F.col("gx"), F.col("gy")) <= routing.LONGEST_M).select("request_id", "start", "goal", "sx", "sy", "gx", "gy")


def paths(spark, sf):
    ship_package(spark)
    return routing.route_paths(asked(spark, sf), route_edges(spark, sf), view(spark, sf, "nodes"))


_COSTS = _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1).replace(", p AS", ", lens_edges AS (" + with_views("edges").split("lens_edges AS (", 1)[1] + ", lens_buildings AS (" + with_views("buildings").split("lens_buildings AS (", 1)[1] + ", " + _SHADE_SQL + ", p AS", 1) + """,
    q AS (SELECT * FROM p WHERE start <> goal AND sqrt((gx - sx) * (gx - sx) + (gy - sy) * (gy - sy)) <= 3000),
    w AS (SELECT 'shortest' AS mode, 0e0 AS lam UNION ALL SELECT 'balanced', 1e0 UNION ALL SELECT 'maxShade', 3e0),
    c AS (SELECT mode, a, b, direction, length / 1.25e0 * CASE WHEN steps THEN 1.5e0 ELSE 1e0 END * (CASE WHEN fallback THEN 1.5e0 ELSE 1e0 END + lam * (1 - shade)) AS cost FROM lens_edges JOIN lens_ratio USING (edge_id) CROSS JOIN w),
    arcs AS (SELECT mode, a AS src, b AS dst, cost FROM c WHERE direction IN ('both', 'forward') UNION ALL SELECT mode, b, a, cost FROM c WHERE direction IN ('both', 'backward')),
    best(request_id, mode, node, cost) USING KEY (request_id, mode, node) AS (SELECT request_id, mode, start, 0e0 FROM q CROSS JOIN w UNION
        SELECT f.request_id, f.mode, arcs.dst, min(f.cost + arcs.cost) FROM best AS f JOIN arcs ON arcs.mode = f.mode AND arcs.src = f.node LEFT JOIN recurring.best AS o ON o.request_id = f.request_id AND o.mode = f.mode AND o.node = arcs.dst
        WHERE o.cost IS NULL OR f.cost + arcs.cost < o.cost GROUP BY ALL)"""


@query(_COSTS + " SELECT q.request_id, best.mode, round(best.cost, 4) AS cost FROM q JOIN best ON best.request_id = q.request_id AND best.node = q.goal")
def route_costs_3mode(spark, sf):
    return paths(spark, sf).groupBy("request_id", "mode").agg(F.round(F.max("cost"), 4).alias("cost"))


def sample_store(spark, sf, tiled=tile_store.tiled_ways):
    """The sample's edges as ways of two points (``tiled``: in which tiles), and its buildings, written by tile; the store's folder."""
    n = view(spark, sf, "nodes")
    end = lambda name: n.select(F.col("id").alias(name), F.struct("lat", "lon").alias(f"p{name}"))
    e = view(spark, sf, "edges").select(F.col("edge_id").alias("id"), "a", "b", "covered", "steps", "fallback", "direction").join(end("a"), "a").join(end("b"), "b")
    ways = e.select("id", F.array("a", "b").alias("nodes"), F.array("pa", "pb").alias("points"), "covered", "steps", "fallback", "direction")
    corner = lambda x, y: F.struct(geo.to_lat(F.col(y)).alias("lat"), geo.to_lon(F.col(x)).alias("lon"))
    buildings = view(spark, sf, "buildings").select("id", "height", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("points"))
    root = f"{shared_folder(spark)}/penumbra-store-{uuid.uuid4().hex}"
    atexit.register(remove, spark, root)
    write = lambda folder: tile_store.write_store(tiled(ways), tile_store.tiled_buildings(buildings), folder)
    return releases.publish_release(spark, root, write, lambda folder: tile_store.whole(spark, folder))


def located_requests(spark, sf):
    return placed_requests(spark, sf).withColumnsRenamed({"lat1": "start_lat", "lon1": "start_lon", "lat2": "goal_lat", "lon2": "goal_lon"})


def no_policy(spark):
    return {"excluded": spark.createDataFrame([], "way_id long"), "blocked": spark.createDataFrame([], "node_id long"), "directions": spark.createDataFrame([], "way_id long, direction string")}


def _shadow_vector():
    reach = F.least(F.col("height") * LPM, F.lit(200.0))
    return reach * SUN_X, reach * SUN_Y


@query(_COSTS + " SELECT q.request_id, best.mode, round(best.cost, 4) AS cost FROM q JOIN best ON best.request_id = q.request_id AND best.node = q.goal")
def stored_route_costs(spark, sf):
    """Costs of the same routes, from a tile store and over the overlay: only tiles around requests are read, and only cells of a request's ends are opened.

    The limits of one request's tiles are those of a service; they leave no request out here.
    """
    ship_package(spark)
    store = sample_store(spark, sf, tile_store.ways_at_points)
    found = service.best_costs(spark, store, keep(asked(spark, sf)), no_policy(spark), *_shadow_vector(), sun.LONGEST_M)
    return found.select("request_id", "mode", F.round("cost", 4).alias("cost"))


_TILE_SQL = with_views("nodes", "edges", "buildings") + f""", area(alat, alon, blat, blon) AS ({_AREA_EDGES}), tx AS (SELECT id, CAST(floor((lon + 180e0) / 360e0 * 32768e0) AS BIGINT) AS x, CAST(floor((1e0 - asinh(tan(radians(lat))) / pi()) / 2e0 * 32768e0) AS BIGINT) AS y FROM lens_nodes),
    w AS (SELECT DISTINCT edge_id, x, y FROM (SELECT edge_id, least(p.x, q.x) AS x0, greatest(p.x, q.x) AS x1, least(p.y, q.y) AS y0, greatest(p.y, q.y) AS y1 FROM lens_edges JOIN tx AS p ON p.id = a JOIN tx AS q ON q.id = b), unnest(generate_series(x0, x1)) AS i(x), unnest(generate_series(y0, y1)) AS j(y)),
    c AS (SELECT id, (x0 + x1) / 2 / (111320e0 * cos(radians(37.498e0))) + 127.032e0 AS lon, (y0 + y1) / 2 / 110540e0 + 37.498e0 AS lat FROM lens_buildings),
    o AS (SELECT CAST(floor((lon + 180e0) / 360e0 * 32768e0) AS BIGINT) AS x, CAST(floor((1e0 - asinh(tan(radians(lat))) / pi()) / 2e0 * 32768e0) AS BIGINT) AS y FROM c WHERE {_INSIDE.format(lat='lat', lon='lon')}),
    u AS (SELECT x, y, count(*) AS ways, 0 AS buildings FROM w GROUP BY 1, 2 UNION ALL SELECT x, y, 0, count(*) FROM o GROUP BY 1, 2)
    SELECT '15-' || x || '-' || y AS tile_id, CAST(sum(ways) AS BIGINT) AS ways, CAST(sum(buildings) AS BIGINT) AS buildings, CAST(2 * sum(ways) AS BIGINT) AS way_points, CAST(4 * sum(buildings) AS BIGINT) AS building_points FROM u GROUP BY x, y"""


@query(_TILE_SQL)
def tile_catalogue(spark, sf):
    """Work of each tile: ways in all tiles of their box, buildings whose mean lies in the service area in the tile of that mean."""
    n = view(spark, sf, "nodes")
    end = lambda name: n.select(F.col("id").alias(name), F.struct("lat", "lon").alias(f"p{name}"))
    e = view(spark, sf, "edges").select(F.col("edge_id").alias("id"), "a", "b").join(end("a"), "a").join(end("b"), "b")
    corner = lambda x, y: F.struct(geo.to_lat(F.col(y)).alias("lat"), geo.to_lon(F.col(x)).alias("lon"))
    buildings = view(spark, sf, "buildings").select("id", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("points"))
    ring = F.array(*(F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")) for lat, lon in AREA))
    c = tile_store.catalogue_of(tile_store.tiled_ways(e.select("id", F.array("pa", "pb").alias("points"))), tile_store.tiled_buildings(buildings, F.array(F.array(ring))))
    return c.select("tile_id", *(F.col(x).cast("long").alias(x) for x in tile_store.WORK))


@query(with_views("nodes", "requests") + ", r AS (SELECT request_id, start, CASE WHEN request_id % 30 = 0 THEN -goal ELSE goal END AS goal FROM lens_requests) SELECT request_id, CASE WHEN g.id IS NULL THEN 'UNKNOWN_PLACE' WHEN start = goal THEN 'SAME_PLACE' ELSE 'KNOWN' END AS status FROM r LEFT JOIN lens_nodes AS g ON g.id = goal")
def unknown_places(spark, sf):
    """Requests to places that aren't there keep their row, and say so."""
    r = view(spark, sf, "requests").withColumn("goal", F.when(F.col("request_id") % 30 == 0, -F.col("goal")).otherwise(F.col("goal")))
    resolved = routing.request_status(routing.resolve_places(r, view(spark, sf, "nodes").select("id", "lat", "lon")), F.lit(True), F.lit(True))
    return resolved.select("request_id", F.when(F.col("status").isin("UNKNOWN_PLACE", "SAME_PLACE"), F.col("status")).otherwise("KNOWN").alias("status"))


@query()
def stored_status(spark, sf):
    """Outcomes of planning from the tile store, by the whole chain: checks, tiles, graph, routes."""
    r = located_requests(spark, sf).select("request_id", "start", "goal", (F.col("start_lat") + 6e-5).alias("start_lat"), "start_lon", "goal_lat", (F.col("goal_lon") + 1e-4).alias("goal_lon"), (F.col("request_id") % 400 == 0).alias("gps"))
    return service.plan_stored(spark, sample_store(spark, sf), r, no_policy(spark), *_shadow_vector())[1]


def _path_edges(spark, sf):
    return paths(spark, sf).join(route_edges(spark, sf).select("edge_id", "length", "steps", "shade"), "edge_id")


@query()
def route_paths(spark, sf):
    return paths(spark, sf)


@query()
def route_bundles(spark, sf):
    """Whole routes: search, summary, clamp and one bundle for each request."""
    done = routing.clamp_to_shortest(routing.summaries(_path_edges(spark, sf)))
    return routing.bundles(done)


def _planned(spark, sf):
    """Requests between places beside the network, by the whole chain of operators."""
    edges = keep(_edges(spark, sf).join(shaded_edges(spark, sf), "edge_id"))
    labels = graph.components(edges.select("edge_id", "a", "b"), keep)
    edges = keep(edges.join(labels.select(F.col("node_id").alias("a"), "component"), "a"))
    r = keep(asked(spark, sf)).select("request_id", (F.col("sx") + 11).alias("sx"), (F.col("sy") + 7).alias("sy"), (F.col("gx") + 13).alias("gx"), (F.col("gy") - 4).alias("gy"), (F.col("request_id") % 400 == 0).alias("gps"))
    far = r.orderBy("request_id").limit(1).select((F.col("request_id") + 1).alias("request_id"), (F.col("sx") - 1e6).alias("sx"), "sy", "gx", "gy", "gps")
    return service.plan_routes(r.unionByName(far), edges, lambda pieces: shade.edge_shade(pieces, _box_shadows(spark, sf), _in_shadow()))


@query()
def planned_routes(spark, sf):
    return _planned(spark, sf)[0]


# The grid is one component and lies within the tiles of every request of the small samples, so the outcome follows from distances, snaps and the shortest way.
_STATUS_SQL = _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1).replace(", p AS", ", lens_edges AS (" + with_views("edges").split("lens_edges AS (", 1)[1] + ", p AS", 1) + f""",
    q AS (SELECT * FROM p WHERE start <> goal AND sqrt((gx - sx) * (gx - sx) + (gy - sy) * (gy - sy)) <= 3000),
    o AS (SELECT request_id, sx + 11 AS px, sy + 7 AS py, gx + 13 AS qx, gy - 4 AS qy, CASE WHEN request_id % 400 = 0 THEN 100 ELSE 150 END AS radius FROM q),
    r AS (SELECT * FROM o UNION ALL SELECT request_id + 1, px - 1e6, py, qx, qy, 150 FROM o WHERE request_id = (SELECT min(request_id) FROM o)),
    ll AS (SELECT *, py / 110540e0 + 37.498e0 AS lat1, px / (111320e0 * cos(radians(37.498e0))) + 127.032e0 AS lon1, qy / 110540e0 + 37.498e0 AS lat2, qx / (111320e0 * cos(radians(37.498e0))) + 127.032e0 AS lon2 FROM r),
    away AS (SELECT *, {_HAVERSINE} > 3000 AS away FROM ll),
    ends AS (SELECT request_id, 'start' AS which, px AS x, py AS y, radius FROM away WHERE NOT away UNION ALL SELECT request_id, 'goal', qx, qy, radius FROM away WHERE NOT away),
    near AS (SELECT request_id, which, edge_id, x, y, radius, fallback, ax, ay, bx, by_, greatest(0e0, least(1e0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t
             FROM ends JOIN lens_edges ON x BETWEEN least(ax, bx) - 150 AND greatest(ax, bx) + 150 AND y BETWEEN least(ay, by_) - 150 AND greatest(ay, by_) + 150),
    gap AS (SELECT *, sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (by_ - ay)) * (y - ay - t * (by_ - ay))) AS d FROM near),
    snap AS (SELECT request_id, which, edge_id, t, d FROM gap WHERE d <= radius QUALIFY row_number() OVER (PARTITION BY request_id, which ORDER BY d * CASE WHEN fallback THEN 1.5e0 ELSE 1e0 END, edge_id) = 1),
    snapped AS (SELECT s.request_id, s.edge_id AS se, s.t AS st, s.d AS sd, g.edge_id AS ge, g.t AS gt, g.d AS gd FROM snap AS s JOIN snap AS g ON g.request_id = s.request_id AND s.which = 'start' AND g.which = 'goal'),
    e AS (SELECT edge_id, a, b, direction, length, length / 1.25e0 * CASE WHEN steps THEN 1.5e0 ELSE 1e0 END * CASE WHEN fallback THEN 1.5e0 ELSE 1e0 END AS cost FROM lens_edges),
    arcs AS (SELECT a AS src, b AS dst, length, cost FROM e WHERE direction IN ('both', 'forward') UNION ALL SELECT b, a, length, cost FROM e WHERE direction IN ('both', 'backward')),
    heads AS (SELECT request_id, a AS node, cost * st AS cost, length * st AS metres FROM snapped JOIN e ON edge_id = se WHERE direction IN ('both', 'backward') UNION ALL SELECT request_id, b, cost * (1 - st), length * (1 - st) FROM snapped JOIN e ON edge_id = se WHERE direction IN ('both', 'forward')),
    tails AS (SELECT request_id, a AS node, cost * gt AS cost, length * gt AS metres FROM snapped JOIN e ON edge_id = ge WHERE direction IN ('both', 'forward') UNION ALL SELECT request_id, b, cost * (1 - gt), length * (1 - gt) FROM snapped JOIN e ON edge_id = ge WHERE direction IN ('both', 'backward')),
    best(request_id, node, cost, metres) USING KEY (request_id, node) AS (SELECT request_id, node, min(cost), arg_min(metres, cost) FROM heads GROUP BY ALL UNION
        SELECT f.request_id, arcs.dst, min(f.cost + arcs.cost), arg_min(f.metres + arcs.length, f.cost + arcs.cost) FROM best AS f JOIN arcs ON arcs.src = f.node LEFT JOIN recurring.best AS k ON k.request_id = f.request_id AND k.node = arcs.dst
        WHERE k.cost IS NULL OR f.cost + arcs.cost < k.cost GROUP BY f.request_id, arcs.dst),
    ways AS (SELECT best.request_id, best.cost + tails.cost AS cost, best.metres + tails.metres AS metres FROM best JOIN tails ON tails.request_id = best.request_id AND tails.node = best.node
        UNION ALL SELECT request_id, cost * abs(gt - st), length * abs(gt - st) FROM snapped JOIN e ON edge_id = se WHERE se = ge AND (direction = 'both' OR (direction = 'forward' AND gt >= st) OR (direction = 'backward' AND gt < st))),
    least_way AS (SELECT request_id, arg_min(metres, cost) AS metres FROM ways GROUP BY 1)
    SELECT away.request_id, CASE WHEN away THEN 'ROUTE_TOO_LONG' WHEN se IS NULL OR (metres IS NULL AND NOT (se = ge AND abs(st - gt) <= 1e-9)) THEN 'SNAP_FAILED' WHEN se = ge AND abs(st - gt) <= 1e-9 THEN 'ALREADY_NEAR_GOAL'
        WHEN floor(floor(metres + 0.5e0) + CASE WHEN sd >= 0.5e0 THEN sd ELSE 0 END + CASE WHEN gd >= 0.5e0 THEN gd ELSE 0 END + 0.5e0) > 3000 THEN 'ROUTE_TOO_LONG' ELSE 'OK' END AS status
    FROM away LEFT JOIN snapped USING (request_id) LEFT JOIN least_way USING (request_id)"""


@query(_STATUS_SQL)
def planned_status(spark, sf):
    return _planned(spark, sf)[1]


@query()
def planned_segments(spark, sf):
    return _planned(spark, sf)[2]


def _planned_legs(spark, sf):
    """The segments of planned routes, in the form of the sequence operators; a request's modes are routes of their own."""
    s = _planned(spark, sf)[2]
    modes = F.create_map(*(F.lit(x) for k, m in enumerate(rules.MODES) for x in (m, k)))
    return s.withColumn("route_id", F.col("request_id") * len(rules.MODES) + modes[F.col("mode")])


@query()
def planned_steps(spark, sf):
    """Turn-by-turn steps of the planned routes."""
    return sequence.turn_by_turn(_planned_legs(spark, sf).drop("request_id", "mode").withColumn("goal_name", F.lit("Garden")))


@query()
def planned_ribbon(spark, sf):
    """Runs of shade, sun and access along the planned routes."""
    legs = _planned_legs(spark, sf)
    return sequence.ribbon(legs.withColumn("meters", geo.haversine(*(F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")))))


_ROWS = "WITH s AS (SELECT user_id AS request_id, event_type AS mode, event_id AS edge_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seq, value AS length, event_id % 7 = 0 AS steps, (event_id % 101) / 1e2 AS shade FROM events)"


@query(_ROWS + """, t AS (SELECT request_id, mode, sum(length / 1.25e0 * CASE WHEN steps THEN 1.5e0 ELSE 1e0 END) AS sec, sum(length) AS m, sum(length / 1.25e0 * CASE WHEN steps THEN 1.5e0 ELSE 1e0 END * (1 - shade)) AS sun, string_agg(edge_id, ':' ORDER BY seq) AS path_key FROM s GROUP BY 1, 2)
    SELECT request_id, mode, CAST(floor(sec + 0.5e0) AS BIGINT) AS time_sec, CAST(floor(m + 0.5e0) AS BIGINT) AS length_m, CAST(floor(sun + 0.5e0) AS BIGINT) AS sun_sec, round(floor((1 - sun / sec) * 1000 + 0.5e0) / 1000, 3) AS shade_ratio, path_key FROM t""")
def route_summary(spark, sf):
    from pyspark.sql import Window

    e = view(spark, sf, "events")
    seq = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = e.select(F.col("user_id").alias("request_id"), F.col("event_type").alias("mode"), F.col("event_id").alias("edge_id"), seq.alias("seq"), F.col("value").alias("length"), (F.col("event_id") % 7 == 0).alias("steps"), ((F.col("event_id") % 101) / 100.0).alias("shade"))
    return routing.summaries(rows).withColumn("shade_ratio", F.round("shade_ratio", 3))


@query(with_views("summaries") + """, m AS (SELECT *, CASE WHEN request_id % 7 >= 0.5e0 THEN request_id % 7 ELSE 0 END + (request_id % 3) / 2e0 AS leg FROM (SELECT *, floor(time_sec + 0.5e0) AS ts FROM lens_summaries))
    SELECT request_id, mode, CAST(floor(time_sec + leg / 1.25e0 + 0.5e0) AS BIGINT) AS time_sec, CAST(floor(length_m + leg + 0.5e0) AS BIGINT) AS length_m, CAST(floor(sun_sec + leg / 1.25e0 + 0.5e0) AS BIGINT) AS sun_sec, round(floor((1 - (sun_sec + leg / 1.25e0) / (time_sec + leg / 1.25e0)) * 1000 + 0.5e0) / 1000, 3) AS shade_ratio FROM m""")
def route_with_connectors(spark, sf):
    s = view(spark, sf, "summaries")
    out = routing.with_access(s, (F.col("request_id") % 7).cast("double"), (F.col("request_id") % 3) / 2.0)
    return out.select("request_id", "mode", "time_sec", "length_m", "sun_sec", F.round("shade_ratio", 3).alias("shade_ratio"))


@query(with_views("summaries") + """, b AS (SELECT * FROM lens_summaries WHERE mode = 'shortest') SELECT s.request_id, s.mode, CASE WHEN s.length_m > 3000 THEN b.time_sec ELSE s.time_sec END AS time_sec, CASE WHEN s.length_m > 3000 THEN b.length_m ELSE s.length_m END AS length_m,
    CASE WHEN s.length_m > 3000 THEN b.path_key ELSE s.path_key END AS path_key, CASE WHEN b.length_m > 3000 THEN 'ROUTE_TOO_LONG' ELSE 'OK' END AS status FROM lens_summaries AS s JOIN b USING (request_id)""")
def route_clamped(spark, sf):
    return routing.clamp_to_shortest(view(spark, sf, "summaries")).select("request_id", "mode", "time_sec", "length_m", "path_key", "status")


@query(_PAIRS + f", area(alat, alon, blat, blon) AS ({_AREA_EDGES}), v AS (SELECT request_id, CASE WHEN start = goal THEN 'SAME_PLACE' WHEN NOT {_INSIDE.format(lat='lat1', lon='lon1')} OR NOT {_INSIDE.format(lat='lat2', lon='lon2')} THEN 'OUTSIDE_SEOUL' WHEN {_HAVERSINE} > 3000 THEN 'ROUTE_TOO_LONG' ELSE 'OK' END AS status FROM p)" + " SELECT request_id, status, CASE status WHEN 'OK' THEN NULL WHEN 'OUTSIDE_SEOUL' THEN 'outside_seoul' WHEN 'ROUTE_TOO_LONG' THEN 'too_long' ELSE 'generic' END AS reason FROM v")
def request_validation(spark, sf):
    point = lambda lat, lon: F.struct(F.lit(lat).alias("y"), F.lit(lon).alias("x"))
    ring = F.array(*(point(a, b) for a, b in AREA))
    r = placed_requests(spark, sf).withColumnsRenamed({"lat1": "start_lat", "lon1": "start_lon", "lat2": "goal_lat", "lon2": "goal_lon"})
    done = routing.request_status(r, geo.in_ring(F.col("start_lon"), F.col("start_lat"), ring), geo.in_ring(F.col("goal_lon"), F.col("goal_lat"), ring))
    return done.select("request_id", "status", F.when(F.col("status") != "OK", rules.failure_reason(F.col("status"))).alias("reason"))


@query(with_views("edges") + " SELECT way_id, count(*) AS graph_edges, CASE WHEN count(*) > 100000 THEN 'ROUTE_DATA_TOO_COMPLEX' ELSE 'OK' END AS status FROM lens_edges GROUP BY 1")
def resource_guard_status(spark, sf):
    counts = view(spark, sf, "edges").groupBy("way_id").agg(F.count("*").alias("graph_edges"))
    return guards.resource_status(counts, {"graph_edges": "graph_edges"})
