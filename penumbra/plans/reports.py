"""Queries over tags, places, tiles, sequences, reports, feedback, streams' batch twins and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, rules, tags
from ..operators import boundary, graph, guards, places, sequence, tiles
from ..session import ship_package
from ..sources import readers, writers
from ..streaming import adherence
from .lens import view, with_views
from .registry import query


def tagged(spark, sf):
    """(id, tags) with only the tags that are there."""
    t = view(spark, sf, "tags")
    keys = {"highway": "highway", "access": "access", "foot": "foot", "sidewalk": "sidewalk", "oneway:foot": "oneway_foot", "conveying": "conveying", "foot:backward": "foot_backward", "sac_scale": "sac_scale", "locked": "locked", "tunnel": "tunnel", "height": "height", "building:levels": "levels"}
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in keys.items()))
    return t.select("id", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("tags"))


_PUBLIC = "('yes', 'designated', 'permissive')"
_TAGS = with_views("tags") + f""", n AS (SELECT *, lower(trim(highway)) AS hw FROM lens_tags),
    d AS (SELECT *, hw IN ('footway', 'steps', 'secondary', 'primary') AS known, hw IN ('secondary', 'primary') AS road, coalesce(foot IN {_PUBLIC}, false) OR coalesce(sidewalk = 'both', false) AS room,
        CASE WHEN foot_backward = 'no' THEN 'forward' ELSE 'both' END AS d1, CASE oneway_foot WHEN 'yes' THEN 'forward' WHEN '-1' THEN 'backward' WHEN 'odd' THEN 'none' ELSE 'both' END AS d2, CASE conveying WHEN 'forward' THEN 'forward' WHEN 'yes' THEN 'none' ELSE 'both' END AS d3 FROM n),
    w AS (SELECT *, CASE WHEN 'none' IN (d1, d2, d3) THEN NULL WHEN ('forward' IN (d1, d2, d3)) AND ('backward' IN (d1, d2, d3)) THEN NULL WHEN 'forward' IN (d1, d2, d3) THEN 'forward' WHEN 'backward' IN (d1, d2, d3) THEN 'backward' ELSE 'both' END AS direction,
        CASE WHEN foot IS NOT NULL THEN foot IN {_PUBLIC} ELSE access IS NULL OR access IN {_PUBLIC} END AS open FROM d),
    f AS (SELECT *, coalesce(sac_scale = 'mountain_hiking', false) OR (known AND (coalesce(sidewalk = 'separate', false) OR (road AND NOT room))) AS fallback FROM w)"""


@query(_TAGS + " SELECT id, known AND coalesce(sac_scale, '') <> 'alpine_hiking' AND open AND NOT (road AND NOT room AND coalesce(sidewalk IN ('no', 'separate'), false)) AND direction IS NOT NULL AS walkable FROM f")
def way_walkable(spark, sf):
    return tagged(spark, sf).select("id", tags.walkable(F.col("tags")).alias("walkable"))


@query(_TAGS + " SELECT id, direction FROM f")
def way_direction(spark, sf):
    return tagged(spark, sf).select("id", tags.direction(F.col("tags")).alias("direction"))


@query(_TAGS + " SELECT id, fallback FROM f")
def way_fallback(spark, sf):
    return tagged(spark, sf).select("id", tags.fallback(F.col("tags")).alias("fallback"))


@query(_TAGS + " SELECT id, coalesce(locked = 'yes', false) OR NOT open AS blocked FROM f")
def node_blocked(spark, sf):
    return tagged(spark, sf).select("id", tags.blocked(F.col("tags")).alias("blocked"))


@query(_TAGS + " SELECT id, CASE WHEN coalesce(tunnel <> 'no', false) THEN 1 ELSE 0 END + CASE WHEN highway = 'steps' THEN 2 ELSE 0 END + CASE WHEN fallback THEN 4 ELSE 0 END AS flags FROM f")
def way_flags(spark, sf):
    return tagged(spark, sf).select("id", tags.flags(F.col("tags")).alias("flags"))


@query(with_views("tags") + ", v AS (SELECT id, TRY_CAST(nullif(regexp_extract(trim(height), '^[0-9.]+'), '') AS DOUBLE) AS h, TRY_CAST(levels AS DOUBLE) AS l FROM lens_tags) SELECT id, CASE WHEN h > 0 AND h <= 60 THEN floor(h * 100 + 0.5e0) / 100 END AS compact, round(coalesce(CASE WHEN h > 0 THEN h END, CASE WHEN l > 0 THEN l * 3.3e0 END, 12e0), 6) AS height FROM v")
def numeric_tag_parse(spark, sf):
    t = tagged(spark, sf)
    return t.select("id", tags.positive(tags.raw(F.col("tags"), "height"), 60.0).alias("compact"), F.round(tags.building_height(F.col("tags"))["height"], 6).alias("height"))


_PLACE_TAGS = """WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN '  Main   Street ' END AS street, CASE WHEN c_custkey % 8 = 0 THEN CAST(c_custkey AS VARCHAR(9)) END AS number, CASE WHEN c_custkey % 16 = 1 THEN 'Seoul' END AS city,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'restaurant' WHEN 'AUTOMOBILE' THEN 'cafe' WHEN 'MACHINERY' THEN 'clinic' END AS amenity, CASE WHEN c_nationkey % 5 = 0 THEN 'yes' END AS shop, CASE WHEN c_nationkey % 7 = 0 THEN 'station' END AS railway FROM {customer}),
    a AS (SELECT *, nullif(concat_ws(' ', city, nullif(trim(regexp_replace(street, '\\s+', ' '{g})), ''), number), '') AS address FROM t)"""


def _place_tags(spark, sf):
    c = view(spark, sf, "customer")
    k = F.col("c_custkey")
    pairs = {
        "name": F.when(k % 3 != 0, F.col("c_name")), "addr:street": F.when(k % 4 == 0, "  Main   Street "), "addr:housenumber": F.when(k % 8 == 0, k.cast("string")), "addr:city": F.when(k % 16 == 1, "Seoul"),
        "amenity": F.when(F.col("c_mktsegment") == "HOUSEHOLD", "restaurant").when(F.col("c_mktsegment") == "AUTOMOBILE", "cafe").when(F.col("c_mktsegment") == "MACHINERY", "clinic"),
        "shop": F.when(F.col("c_nationkey") % 5 == 0, "yes"), "railway": F.when(F.col("c_nationkey") % 7 == 0, "station"),
    }
    entries = F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs.items()))
    return c.select(k.alias("id"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("tags"))


_PT = _PLACE_TAGS.format(customer="customer", g=", 'g'")


@query(_PT + " SELECT id, CASE WHEN name IS NULL AND address IS NULL THEN NULL WHEN railway = 'station' THEN 'station' WHEN amenity = 'cafe' THEN 'cafe' WHEN amenity = 'restaurant' THEN 'food' WHEN amenity = 'clinic' THEN 'medical' WHEN shop IS NOT NULL THEN 'store' WHEN address IS NOT NULL THEN 'address' END AS kind FROM a")
def place_kind(spark, sf):
    return _place_tags(spark, sf).select("id", tags.place_kind(F.col("tags")).alias("kind"))


@query(_PT + " SELECT id, address FROM a")
def place_address(spark, sf):
    return _place_tags(spark, sf).select("id", tags.address(F.col("tags")).alias("address"))


def _places(spark, sf):
    p = view(spark, sf, "places")
    return p.withColumn("aliases", F.when(F.col("alias").isNotNull(), F.array("alias")))


_PLAIN = "lower(regexp_replace(name, '\\s+', '', 'g'))"
_QUERY = "lower(regexp_replace({}, '[\\s·.,()\\-_/]+', '', 'g'))"


@query(with_views("places") + f""", k AS (SELECT *, CASE WHEN kind = 'station' THEN 'station:' || {_PLAIN} ELSE {_PLAIN} || ':' || CAST(round(lat, 4) AS VARCHAR) || ':' || CAST(round(lon, 4) AS VARCHAR) END AS key FROM lens_places),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY address IS NULL, seq) AS n FROM k) SELECT id, kind, name FROM r WHERE n = 1""")
def place_dedupe(spark, sf):
    return places.without_doubles(_places(spark, sf), places.plain_name(F.col("name"), places.as_it_is)).select("id", "kind", "name")


_QUOTAS = {"station": 40, "food": 25, "cafe": 10}


@query(with_views("places") + """, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS n FROM lens_places), o AS (SELECT *, n > CASE kind WHEN 'station' THEN 40 WHEN 'food' THEN 25 WHEN 'cafe' THEN 10 ELSE 120 END AS overflow FROM r)
    SELECT id, kind, name, overflow FROM o ORDER BY overflow, name, id LIMIT 120""")
def place_quota(spark, sf):
    return places.within_quotas(_places(spark, sf), _QUOTAS, 120, [places.korean(F.col("name")), F.col("id")]).select("id", "kind", "name", "overflow")


@query(with_views("places") + f""", q(query_id, query) AS (SELECT seq, name FROM lens_places WHERE seq % 20 = 0),
    a AS (SELECT query_id, {_QUERY.format("query")} AS q, list_filter(string_split_regex(lower(query), '[\\s·.,()\\-_/]+'), lambda t: t <> '') AS tokens FROM q WHERE {_QUERY.format("query")} <> ''),
    p AS (SELECT id, name, {_QUERY.format("name")} AS n, {_QUERY.format("alias")} AS al, {_QUERY.format("address")} AS ad FROM lens_places),
    s AS (SELECT query_id, id, name, CASE WHEN n = q THEN 0 WHEN starts_with(n, q) THEN 1 WHEN contains(n, q) THEN 2 WHEN al = q THEN 3 WHEN starts_with(al, q) THEN 4 WHEN contains(al, q) THEN 5
        WHEN len(tokens) > 1 AND al IS NOT NULL AND len(list_filter(tokens, lambda t: NOT contains(al, t))) = 0 THEN 5 WHEN ad = q THEN 6 WHEN starts_with(ad, q) THEN 7 WHEN contains(ad, q) THEN 8 END AS score FROM p CROSS JOIN a),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, name, id) AS rank FROM s WHERE score IS NOT NULL) SELECT query_id, rank, id, score FROM r WHERE rank <= 8""")
def place_search_batch(spark, sf):
    """The names of all places whose key is divisible by 20, against all places."""
    p = _places(spark, sf)
    return places.search(p, p.where("seq % 20 = 0").select(F.col("seq").alias("query_id"), F.col("name").alias("query")), compose=places.as_it_is)


@query(with_views("places") + f""", q AS (SELECT seq AS query_id, {_QUERY.format("name")} AS q FROM lens_places WHERE seq % 20 = 0), p AS (SELECT id, name, {_QUERY.format("name")} AS n FROM lens_places),
    r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY name, id) AS k FROM q JOIN p ON n = q) SELECT query_id, id FROM r WHERE k = 1""")
def place_exact_choice(spark, sf):
    """What Enter chooses for each searched name: the first result of that name."""
    p = _places(spark, sf)
    asked = p.where("seq % 20 = 0").select(F.col("seq").alias("query_id"), F.col("name").alias("query"))
    return places.exact_choice(places.search(p, asked, compose=places.as_it_is), p, asked, places.as_it_is)


@query(with_views("places") + """ SELECT id, CASE kind WHEN 'station' THEN '지하철역' WHEN 'food' THEN '음식점' WHEN 'cafe' THEN '카페' WHEN 'store' THEN '상점' ELSE '건물' END || CASE WHEN address IS NULL THEN '' ELSE ' · ' || address END AS description FROM lens_places""")
def place_descriptions(spark, sf):
    return view(spark, sf, "places").select("id", places.description(F.col("kind"), F.col("address")).alias("description"))


@query(_PT + """, k AS (SELECT id, name, address, CASE WHEN railway = 'station' THEN 'station' WHEN amenity = 'cafe' THEN 'cafe' WHEN amenity = 'restaurant' THEN 'food' WHEN amenity = 'clinic' THEN 'medical' WHEN shop IS NOT NULL THEN 'store' WHEN address IS NOT NULL THEN 'address' END AS kind, coalesce(name, address) AS n FROM a WHERE name IS NOT NULL OR address IS NOT NULL)
    SELECT 'osm-node-' || id AS id, kind, trim(n) AS name, CASE WHEN address <> n THEN address END AS address, 0 AS n_aliases FROM k WHERE kind IS NOT NULL AND NOT (kind = 'station' AND NOT regexp_matches(n, '[^\\d\\s.-]'))""")
def place_records(spark, sf):
    """Places made of tagged elements."""
    e = _place_tags(spark, sf).select(F.lit("node").alias("type"), "id", "tags", F.lit(37.5).alias("lat"), F.lit(127.0).alias("lon"), F.col("id").alias("seq"))
    return places.place_from(e).select("id", "kind", "name", "address", F.size("aliases").alias("n_aliases"))


@query(with_views("places") + f" SELECT id, CASE WHEN {_QUERY.format('name')} = 'market1' THEN 0 WHEN starts_with({_QUERY.format('name')}, 'market1') THEN 1 ELSE 2 END AS score FROM lens_places WHERE contains({_QUERY.format('name')}, 'market1') ORDER BY score, name, id LIMIT 8")
def place_search_topk(spark, sf):
    p = _places(spark, sf).select("id", "name", places.plain_query(F.col("name"), places.as_it_is).alias("n"))
    score = places.match_score(F.col("n"), F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit("market1"), F.array().cast("array<string>"))
    return p.withColumn("score", score).where("score is not null").orderBy("score", "name", "id").limit(places.DEFAULT_RESULTS).select("id", "score")


@query()
def place_normalised_nfkc(spark, sf):
    ship_package(spark)
    d = view(spark, sf, "documents")
    return d.select("doc_id", F.length(places.plain_name(F.col("text"))).alias("n_name"), F.length(places.plain_query(F.col("text"))).alias("n_query"))


_WAY_BOXES = with_views("nodes", "ways") + ", b AS (SELECT way_id, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM lens_ways AS w JOIN lens_nodes AS n ON n.id = w.node_id GROUP BY 1)"
_TX, _TY = "CAST(floor(({} + 180e0) / 360e0 * 32768e0) AS BIGINT)", "CAST(floor((1e0 - asinh(tan(radians({}))) / pi()) / 2e0 * 32768e0) AS BIGINT)"


def _way_boxes(spark, sf):
    n = view(spark, sf, "nodes").select(F.col("id").alias("node_id"), "lat", "lon")
    return view(spark, sf, "ways").join(n, "node_id").groupBy("way_id").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


@query(_WAY_BOXES + f", t AS (SELECT way_id, {_TX.format('west')} AS x0, {_TX.format('east')} AS x1, {_TY.format('north')} AS y0, {_TY.format('south')} AS y1 FROM b) SELECT way_id, tile_x, tile_y FROM t, unnest(generate_series(x0, x1)) AS s(tile_x), unnest(generate_series(y0, y1)) AS u(tile_y) WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= 32")
def tile_assignment_ways(spark, sf):
    return tiles.tiles_of_ways(_way_boxes(spark, sf))


@query(with_views("buildings", "nodes") + f" SELECT id, {_TX.format('lon')} AS tile_x, {_TY.format('lat')} AS tile_y FROM lens_buildings JOIN lens_nodes USING (id)")
def tile_owner_buildings(spark, sf):
    b = view(spark, sf, "buildings").select("id").join(view(spark, sf, "nodes").select("id", "lat", "lon"), "id")
    return tiles.owner_tile(b).select("id", "tile_x", "tile_y")


_BOX = [(37.4915, 127.0215), (37.4915, 127.0335), (37.4975, 127.0335), (37.4975, 127.0215)]
_IN_BOX = "({lat} > 37.4915e0 AND {lat} < 37.4975e0 AND {lon} > 127.0215e0 AND {lon} < 127.0335e0)"


@query(with_views("nodes", "ways") + f", p AS (SELECT way_id, avg(lat) AS lat, avg(lon) AS lon, bool_or({_IN_BOX.format(lat='lat', lon='lon')}) AS touched FROM lens_ways AS w JOIN lens_nodes AS n ON n.id = w.node_id GROUP BY 1) SELECT way_id, touched OR {_IN_BOX.format(lat='lat', lon='lon')} AS inside FROM p")
def ways_inside(spark, sf):
    """Ways of which the vertex mean or any point lies in a given area."""
    corner = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    n = view(spark, sf, "nodes").select(F.col("id").alias("node_id"), "lat", "lon")
    w = view(spark, sf, "ways").join(n, "node_id").groupBy("way_id").agg(F.collect_list(F.struct("lat", "lon")).alias("points"))
    return tiles.ways_inside(w, F.array(F.array(F.array(*(corner(*c) for c in _BOX))))).select("way_id", "inside")


@query(_TAGS + """, x AS (SELECT f.*, id % 5 AS kind, id % 3 = 0 AS building, id % 11 AS n_points, CASE WHEN id % 13 = 0 THEN 0 ELSE id % 11 END AS n_found, id % 7 <> 0 AS inside, id % 2 = 0 AS owner,
        known AND coalesce(sac_scale, '') <> 'alpine_hiking' AND open AND NOT (road AND NOT room AND coalesce(sidewalk IN ('no', 'separate'), false)) AND direction IS NOT NULL AS walk FROM f),
    y AS (SELECT *, kind > 1 AND (known OR building) AS used, n_points > 0 AND n_found = n_points AS whole FROM x)
    SELECT count(*) AS parsed, count(*) FILTER (kind < 2 AND inside) AS kept_nodes, count(*) FILTER (used AND whole AND inside AND walk AND n_points >= 2) AS walkways, count(*) FILTER (used AND whole AND inside AND building AND n_points >= 3 AND owner) AS buildings, count(*) FILTER (used AND NOT whole) AS missing_geometry FROM y""")
def build_stats(spark, sf):
    """Counters of a build over tagged elements: two in five are nodes, the others ways of up to ten points."""
    t, k = tagged(spark, sf), F.col("id")
    e = t.select(
        F.when(k % 5 < 2, "node").otherwise("way").alias("type"), (k % 7 != 0).alias("in_bounds"), tags.supported(F.col("tags")).alias("candidate"), tags.walkable(F.col("tags")).alias("walkable"), (k % 3 == 0).alias("is_building"),
        (k % 11).alias("n_points"), F.when(k % 13 == 0, 0).otherwise(k % 11).alias("n_found"), (k % 7 != 0).alias("inside"), (k % 2 == 0).alias("owner_inside"))
    return tiles.build_stats(e)


_AREA = (37.4893, 127.0215, 37.4975, 127.0335)
_IN_AREA = "({lat} > 37.4893e0 AND {lat} < 37.4975e0 AND {lon} > 127.0215e0 AND {lon} < 127.0335e0)"
_GEOMETRY = f"""e AS (SELECT * FROM lens_nodes WHERE lon < 127.046e0),
    g AS (SELECT way_id, count(*) AS n_points, count(e.id) AS n_found, coalesce({_IN_AREA.format(lat='avg(lat)', lon='avg(lon)')}, false) AS owner, coalesce(bool_or({_IN_AREA.format(lat='lat', lon='lon')}), false) AS touched FROM lens_ways AS w LEFT JOIN e ON e.id = w.node_id GROUP BY 1)"""


def _area():
    south, west, north, east = _AREA
    corner = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    return F.array(F.array(F.array(corner(south, west), corner(south, east), corner(north, east), corner(north, west))))


def _extract(spark, sf):
    """Nodes of an extract that ends at a meridian: ways that cross it have points that aren't there."""
    return view(spark, sf, "nodes").select("id", "lat", "lon").where(F.col("lon") < 127.046)


@query(with_views("nodes", "ways") + ", " + _GEOMETRY + " SELECT way_id, n_points, n_found, touched OR owner AS inside, owner AS owner_inside FROM g")
def way_geometry(spark, sf):
    """Points of each way, those found in an extract, and whether the way or its mean lies in an area."""
    return tiles.way_geometry(view(spark, sf, "ways"), _extract(spark, sf), _area())


@query(_TAGS.replace(with_views("tags"), with_views("tags", "nodes", "ways")) + ", " + _GEOMETRY + f""",
    y AS (SELECT n_points > 0 AND n_found = n_points AS whole, coalesce(n_points, 0) AS n_points, coalesce(touched OR owner, false) AS inside, coalesce(owner, false) AS owner, levels IS NOT NULL AS building, known,
        known AND coalesce(sac_scale, '') <> 'alpine_hiking' AND open AND NOT (road AND NOT room AND coalesce(sidewalk IN ('no', 'separate'), false)) AND direction IS NOT NULL AS walk FROM f LEFT JOIN g ON g.way_id = f.id)
    SELECT (SELECT count(*) FROM e) + count(*) AS parsed, (SELECT count(*) FROM e WHERE {_IN_AREA.format(lat='lat', lon='lon')}) AS kept_nodes, count(*) FILTER (whole AND inside AND walk AND n_points >= 2) AS walkways,
        count(*) FILTER (whole AND inside AND building AND n_points >= 3 AND owner) AS buildings, count(*) FILTER ((known OR building) AND NOT coalesce(whole, false)) AS missing_geometry FROM y""")
def build_counters(spark, sf):
    """Counters of a build from the nodes of an extract, ways, their references and tags; tagged levels make a building."""
    ways = tagged(spark, sf).select("id", tags.supported(F.col("tags")).alias("candidate"), tags.walkable(F.col("tags")).alias("walkable"), F.col("tags")["building:levels"].isNotNull().alias("is_building"))
    return tiles.build_stats(tiles.build_elements(view(spark, sf, "ways"), _extract(spark, sf), ways, _area(), _AREA))


_WAY_EDGES = _TAGS + """, t AS (SELECT id AS way_id, highway = 'steps' AS steps, coalesce(tunnel <> 'no', false) AS covered, fallback, direction, known AND coalesce(sac_scale, '') <> 'alpine_hiking' AND open AND NOT (road AND NOT room AND coalesce(sidewalk IN ('no', 'separate'), false)) AND direction IS NOT NULL AS walk, id % 17 = 3 AS excluded FROM f),
    p AS (SELECT way_id, seq, node_id, lat + (way_id % 3) * 1e-6 AS lat, lon FROM lens_ways AS w JOIN lens_nodes AS n ON n.id = w.node_id),
    s AS (SELECT way_id * 1024 + seq - 1 AS edge_id, way_id, node_id AS a, lead(node_id) OVER o AS b, lat AS alat, lon AS alon, lead(lat) OVER o AS blat, lead(lon) OVER o AS blon FROM p WINDOW o AS (PARTITION BY way_id ORDER BY seq)),
    g AS (SELECT s.*, t.steps, t.covered, t.fallback, t.direction FROM s JOIN t USING (way_id) WHERE walk AND NOT excluded AND b IS NOT NULL AND a <> b AND a % 97 <> 5 AND b % 97 <> 5),
    u AS (SELECT a AS node_id, edge_id * 2 AS k, alat AS lat, alon AS lon FROM g UNION ALL SELECT b, edge_id * 2 + 1, blat, blon FROM g),
    c AS (SELECT node_id, (lon - 127.032e0) * (111320e0 * cos(radians(37.498e0))) AS x, (lat - 37.498e0) * 110540e0 AS y FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY k) AS r FROM u) WHERE r = 1),
    e AS (SELECT g.*, sqrt((m.x - n.x) * (m.x - n.x) + (m.y - n.y) * (m.y - n.y)) AS length FROM g JOIN c AS n ON n.node_id = a JOIN c AS m ON m.node_id = b)"""


def _tagged_ways(spark, sf):
    """Ways with points, whose coordinates differ a little from way to way, and what their tags say."""
    n = view(spark, sf, "nodes").select(F.col("id").alias("node_id"), "lat", "lon")
    point = F.struct("seq", F.struct("node_id", (F.col("lat") + (F.col("way_id") % 3) * 1e-6).alias("lat"), "lon").alias("p"))
    w = view(spark, sf, "ways").join(n, "node_id").groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(point)), lambda x: x["p"]).alias("points"))
    t, tag = tagged(spark, sf).withColumnRenamed("id", "way_id"), F.col("tags")
    return w.join(t, "way_id").select("way_id", F.col("way_id").alias("way_seq"), "points", tags.walkable(tag).alias("walkable"), tags.direction(tag).alias("direction"), tags.covered(tag).alias("covered"), tags.equals(tags.raw(tag, "highway"), "steps").alias("steps"), tags.fallback(tag).alias("fallback"))


@query(_WAY_EDGES.replace(_TAGS, with_views("tags", "ways", "nodes") + _TAGS[len(with_views("tags")):]) + " SELECT edge_id, way_id, a, b, round(length, 6) AS length, steps, covered, fallback, direction FROM e WHERE length > 0")
def way_edges(spark, sf):
    """Edges made of tagged ways and their nodes."""
    w = _tagged_ways(spark, sf)
    blocked = view(spark, sf, "nodes").where("id % 97 = 5").select(F.col("id").alias("node_id"))
    return graph.way_edges(w, w.where("way_id % 17 = 3").select("way_id"), blocked).select("edge_id", "way_id", "a", "b", F.round("length", 6).alias("length"), "steps", "covered", "fallback", "direction")


@query(_WAY_EDGES.replace(_TAGS, with_views("tags", "ways", "nodes") + _TAGS[len(with_views("tags")):]) + ", r AS (SELECT CASE WHEN excluded THEN 'excluded' WHEN NOT walk THEN 'unwalkable' END AS reason FROM t WHERE way_id IN (SELECT way_id FROM lens_ways)) SELECT reason, count(*) AS n_ways FROM r WHERE reason IS NOT NULL GROUP BY 1")
def way_skips(spark, sf):
    w = _tagged_ways(spark, sf)
    return graph.skipped_ways(w, w.where("way_id % 17 = 3").select("way_id"))


_CATALOGUE = f"cat AS (SELECT tile_x || '-' || tile_y AS tile_id, tile_x / 32768e0 * 360e0 - 180e0 AS west, (tile_x + 1) / 32768e0 * 360e0 - 180e0 AS east, degrees(atan(sinh(pi() * (1e0 - 2e0 * tile_y / 32768e0)))) AS north, degrees(atan(sinh(pi() * (1e0 - 2e0 * (tile_y + 1) / 32768e0)))) AS south, n * 40000 AS bytes FROM (SELECT {_TX.format('lon')} AS tile_x, {_TY.format('lat')} AS tile_y, count(*) AS n FROM lens_nodes GROUP BY ALL))"


@query(with_views("nodes", "requests") + ", " + _CATALOGUE + """, r AS (SELECT request_id, least(a.lat, b.lat) - 0.01e0 AS s, least(a.lon, b.lon) - 0.01e0 AS w, greatest(a.lat, b.lat) + 0.01e0 AS n, greatest(a.lon, b.lon) + 0.01e0 AS e FROM lens_requests JOIN lens_nodes AS a ON a.id = start JOIN lens_nodes AS b ON b.id = goal),
    m AS (SELECT request_id, count(tile_id) AS n_tiles, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM r LEFT JOIN cat ON s <= north AND n >= south AND w <= east AND e >= west GROUP BY 1)
    SELECT *, CASE WHEN n_tiles = 0 THEN 'AREA_DATA_UNAVAILABLE' WHEN n_tiles > 36 OR bytes > 12000000 THEN 'ROUTE_TOO_LARGE' ELSE 'OK' END AS status FROM m""")
def tile_selection(spark, sf):
    n = view(spark, sf, "nodes")
    t = n.groupBy(geo.tile_x(F.col("lon")).alias("tile_x"), geo.tile_y(F.col("lat")).alias("tile_y")).agg((F.count("*") * 40000).alias("bytes"))
    catalogue = t.select(F.concat_ws("-", "tile_x", "tile_y").alias("tile_id"), geo.tile_west(F.col("tile_x")).alias("west"), geo.tile_west(F.col("tile_x") + 1).alias("east"), geo.tile_north(F.col("tile_y")).alias("north"), geo.tile_north(F.col("tile_y") + 1).alias("south"), "bytes")
    end = lambda k: n.select(F.col("id").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    return tiles.select_tiles(view(spark, sf, "requests").join(end("start"), "start").join(end("goal"), "goal"), catalogue)


@query("WITH e AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'A' THEN 'building' ELSE 'way' END AS type, l_suppkey % 50 AS tile_seq, l_linenumber AS n FROM lineitem), r AS (SELECT type, id, min(tile_seq) AS tile_seq FROM e GROUP BY 1, 2) SELECT type, id, tile_seq FROM r")
def tile_merge_dedupe(spark, sf):
    li = view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "A", "building").otherwise("way").alias("type"), (F.col("l_suppkey") % 50).alias("tile_seq"))
    return tiles.merge_tiles(li).select("type", "id", "tile_seq")


@query("SELECT CASE WHEN GROUPING(t) = 0 THEN t END AS tile_id, count(*) FILTER (l_returnflag <> 'A') AS ways, count(*) FILTER (l_returnflag = 'A') AS buildings, CAST(sum(l_linenumber) AS BIGINT) AS points FROM (SELECT *, l_suppkey % 50 AS t FROM lineitem) GROUP BY ROLLUP (t)")
def tile_work_rollup(spark, sf):
    li = view(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("tile_id"), F.when(F.col("l_returnflag") == "A", "building").otherwise("way").alias("type"), F.col("l_linenumber").alias("n_points"))
    return tiles.work(li)


@query(_TAGS + " SELECT DISTINCT id AS way_id FROM f WHERE fallback AND known")
def policy_extract(spark, sf):
    """Of any number of ways: only the policy file of one city has a limit."""
    return tiles.policy_ids(tagged(spark, sf), tags.fallback(F.col("tags")) & tags.supported(F.col("tags")), "way_id")


@query(with_views("edges") + ", e AS (SELECT DISTINCT way_id FROM lens_edges WHERE way_id % 17 <> 3) SELECT (SELECT count(*) FROM e WHERE way_id % 17 = 3) AS excluded_emitted, (SELECT count(DISTINCT way_id) FROM lens_edges WHERE way_id % 23 = 1 AND way_id % 17 = 3) AS fallback_missing, (SELECT count(DISTINCT way_id) FROM lens_edges WHERE way_id % 29 = 2 AND way_id % 17 = 3) AS directed_missing")
def policy_consistency(spark, sf):
    ways = view(spark, sf, "edges").select("way_id").distinct()
    return tiles.consistency(ways.where("way_id % 17 <> 3"), ways.where("way_id % 17 = 3"), ways.where("way_id % 23 = 1"), ways.where("way_id % 29 = 2"))


_RUNS = with_views("segments") + """, k AS (SELECT *, CASE WHEN connector THEN 'connector' WHEN covered OR shade >= 0.5e0 THEN 'shade' ELSE 'sun' END AS kind FROM lens_segments WHERE meters > 0),
    s AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY route_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT *, sum(new) OVER (PARTITION BY route_id ORDER BY seq) - 1 AS run FROM s),
    g AS (SELECT route_id, CAST(run AS BIGINT) AS run, kind, sum(meters) AS meters FROM r GROUP BY ALL)"""


@query(_RUNS + " SELECT * FROM g")
def ribbon_runs(spark, sf):
    return sequence.ribbon(view(spark, sf, "segments")).select("route_id", "run", "kind", "meters")


@query(_RUNS + " SELECT route_id, run, round(100 * meters / sum(meters) OVER (PARTITION BY route_id), 6) AS percent FROM g")
def ribbon_percent(spark, sf):
    return sequence.ribbon(view(spark, sf, "segments")).select("route_id", "run", F.round("percent", 6).alias("percent"))


@query(with_views("segments") + " SELECT CASE WHEN connector THEN 'connector' WHEN covered OR shade >= 0.5e0 THEN 'shade' ELSE 'sun' END AS style, count(*) AS n_segments, sum(meters) AS meters FROM lens_segments GROUP BY 1")
def segment_style(spark, sf):
    return view(spark, sf, "segments").groupBy(sequence.segment_kind().alias("style")).agg(F.count("*").alias("n_segments"), F.sum("meters").alias("meters"))


@query(with_views("segments") + " SELECT route_id, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM lens_segments GROUP BY 1")
def route_fit_bounds(spark, sf):
    return sequence.fit_bounds(view(spark, sf, "segments"))


def _route_segments(spark, sf):
    """Each user's positions in order as segments; every eleventh begins somewhere else."""
    from pyspark.sql import Window

    order = Window.partitionBy("route_id").orderBy("seq")
    s = view(spark, sf, "segments").withColumns({"from_lat": F.lag("lat").over(order), "from_lon": F.lag("lon").over(order)}).where("from_lat is not null")
    moved = F.when(F.col("seq") % 11 == 0, F.col("from_lat") + 1e-3).otherwise(F.col("from_lat"))
    return s.select("route_id", "seq", moved.alias("from_lat"), "from_lon", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), "shade", "covered", "steps", "connector")


@query(with_views("segments") + ", f AS (SELECT route_id, seq, CASE WHEN seq % 11 = 0 THEN lag(lat) OVER o + 1e-3 ELSE lag(lat) OVER o END AS from_lat, lag(lat) OVER o AS last_lat FROM lens_segments WINDOW o AS (PARTITION BY route_id ORDER BY seq)) SELECT route_id, CAST(sum(CASE WHEN seq > 2 AND from_lat <> last_lat THEN 1 ELSE 0 END) AS BIGINT) AS breaks FROM f WHERE from_lat IS NOT NULL GROUP BY 1")
def route_continuity(spark, sf):
    return sequence.continuity(_route_segments(spark, sf))


def _turned(a, b):
    """Change of bearing from a to b in SQL, within [-180, 180)."""
    return f"(({b} - {a} + 540e0) - 360e0 * floor(({b} - {a} + 540e0) / 360e0) - 180e0)"


def _metres_sql(a, b, c, d):
    return f"12742000e0 * asin(least(1e0, sqrt(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))))"


_TURN = _turned("s.bearing", "m.bearing")
_STEPS_SQL = with_views("segments").replace("WITH ", "WITH RECURSIVE ", 1) + f""", f AS (SELECT *, lag(lat) OVER o AS last_lat, lag(lon) OVER o AS from_lon FROM lens_segments WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
    g AS (SELECT route_id, seq, CASE WHEN seq % 11 = 0 THEN last_lat + 1e-3 ELSE last_lat END AS from_lat, from_lon, lat AS to_lat, lon AS to_lon, CASE WHEN covered THEN 1e0 ELSE greatest(0e0, least(1e0, shade)) END AS shade, steps, CASE WHEN connector THEN 'connector' WHEN steps THEN 'steps' ELSE 'walk' END AS meaning FROM f WHERE last_lat IS NOT NULL),
    h AS (SELECT *, {_metres_sql("from_lat", "from_lon", "to_lat", "to_lon")} AS meters, degrees(atan2((to_lon - from_lon) * cos(radians((from_lat + to_lat) / 2)), to_lat - from_lat)) + 360e0 AS raw FROM g),
    i AS (SELECT *, raw - 360e0 * floor(raw / 360e0) AS bearing, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS k FROM h WHERE meters >= 0.5e0),
    m AS (SELECT *, CASE WHEN lead(meaning) OVER o = meaning THEN lead(bearing) OVER o END AS follows FROM i WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
    s AS (SELECT route_id, k, 0 AS step, CASE WHEN meaning = 'walk' THEN 'depart' ELSE meaning END AS kind, meaning, meters AS metres, meters * shade AS shaded, steps AS has_steps, bearing AS first, bearing, to_lat, to_lon FROM m WHERE k = 1
        UNION ALL SELECT route_id, k, CASE WHEN goes_on THEN step ELSE step + 1 END, CASE WHEN goes_on THEN kind WHEN m_meaning = 'walk' AND NOT gap AND meaning <> 'connector' THEN
            CASE WHEN abs(turn) < 15 THEN 'straight' WHEN abs(turn) < 45 THEN CASE WHEN turn > 0 THEN 'slight-right' ELSE 'slight-left' END WHEN abs(turn) < 160 THEN CASE WHEN turn > 0 THEN 'right' ELSE 'left' END WHEN abs(turn) = 180 OR turn > 0 THEN 'uturn-right' ELSE 'uturn-left' END
            WHEN m_meaning = 'walk' THEN 'depart' ELSE m_meaning END, m_meaning, CASE WHEN goes_on THEN metres + meters ELSE meters END, CASE WHEN goes_on THEN shaded + meters * shade ELSE meters * shade END, CASE WHEN goes_on THEN has_steps OR steps ELSE steps END,
            CASE WHEN goes_on THEN first ELSE m_bearing END, CASE WHEN goes_on AND jitter THEN bearing ELSE m_bearing END, m_to_lat, m_to_lon
        FROM (SELECT *, NOT gap AND m_meaning = meaning AND NOT (m_meaning = 'walk' AND NOT jitter AND abs(turn) >= 45) AS goes_on FROM (
            SELECT s.*  EXCLUDE (k), m.k, m.meaning AS m_meaning, m.bearing AS m_bearing, m.to_lat AS m_to_lat, m.to_lon AS m_to_lon, m.meters, m.shade, m.steps, {_TURN} AS turn, {_metres_sql("s.to_lat", "s.to_lon", "m.from_lat", "m.from_lon")} > 10 AS gap,
                coalesce(m.meaning = s.meaning AND abs({_turned("s.bearing", "m.follows")}) < 25 AND (m.meters < 8 OR (m.meters <= 15 AND abs({_TURN}) >= 135 AND abs({_turned("m.bearing", "m.follows")}) >= 135)), false) AS jitter
            FROM s JOIN m ON m.route_id = s.route_id AND m.k = s.k + 1))),
    d AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY route_id, step ORDER BY k DESC) = 1)),
    x AS (SELECT *, CASE WHEN metres = 0 THEN 0e0 ELSE shaded / metres END AS ratio FROM d)
    SELECT route_id, step, kind, CASE WHEN kind = 'connector' THEN CASE WHEN step = 0 THEN '보행로까지 이동' WHEN step = n - 1 THEN '도착지까지 이동' ELSE '연결 구간 이동' END
        WHEN kind = 'depart' THEN (['북쪽', '북동쪽', '동쪽', '남동쪽', '남쪽', '남서쪽', '서쪽', '북서쪽'])[CAST(floor(first / 45 + 0.5e0) AS BIGINT) % 8 + 1] || ' 방향으로 ' || CASE WHEN step = 0 THEN '출발' ELSE '이동' END
        {" ".join(f"WHEN kind = '{k}' THEN '{text}'" for k, text in sequence.INSTRUCTIONS.items())} END AS instruction, round(metres, 6) AS distance_m, round(ratio, 6) AS shade_ratio,
        CASE WHEN meaning = 'connector' THEN 'connector' WHEN ratio >= 0.55e0 THEN 'shade' WHEN ratio <= 0.35e0 THEN 'sun' ELSE 'mixed' END AS exposure, has_steps, to_lat, to_lon FROM x
    UNION ALL SELECT route_id, CAST(n AS INT), 'arrive', 'Garden에 도착', 0e0, 0e0, 'mixed', false, to_lat, to_lon FROM x WHERE step = n - 1"""


@query(_STEPS_SQL)
def turn_by_turn(spark, sf):
    steps = sequence.turn_by_turn(_route_segments(spark, sf).withColumn("goal_name", F.lit("Garden")))
    return steps.withColumns({c: F.round(c, 6) for c in ("distance_m", "shade_ratio")})


# One decimal place, ties upwards as in the reports (lengths are whole metres).
_KM = "printf('%.1f', floor(length_m / 100e0 + 0.5e0) / 10e0) || 'km'"


@query(with_views("summaries") + " SELECT request_id, mode, greatest(1, CAST(floor(time_sec / 60 + 0.5e0) AS BIGINT)) AS walk_min, greatest(0, CAST(floor(sun_sec / 60 + 0.5e0) AS BIGINT)) AS sun_min FROM lens_summaries")
def route_minutes(spark, sf):
    return view(spark, sf, "summaries").select("request_id", "mode", rules.walk_minutes(F.col("time_sec")).alias("walk_min"), rules.sun_minutes(F.col("sun_sec")).alias("sun_min"))


@query(with_views("summaries") + f" SELECT request_id, mode, CASE WHEN length_m >= 1000 THEN {_KM} ELSE CAST(CAST(floor(length_m + 0.5e0) AS BIGINT) AS VARCHAR) || 'm' END AS distance, CASE WHEN length_m >= 1000 THEN {_KM} ELSE CAST(greatest(10, CAST(floor(length_m / 10 + 0.5e0) AS BIGINT) * 10) AS VARCHAR) || 'm' END AS step, CASE WHEN shade_ratio <= 0.35e0 THEN '햇빛 구간' ELSE '예상 그늘 ' || CAST(CAST(floor(shade_ratio * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || '%' END AS exposure FROM lens_summaries")
def distance_labels(spark, sf):
    s = view(spark, sf, "summaries")
    exposed = rules.exposure(F.lit(False), F.col("shade_ratio"))
    return s.select("request_id", "mode", rules.distance_label(F.col("length_m")).alias("distance"), rules.step_label(F.col("length_m")).alias("step"), rules.exposure_label(exposed, F.col("shade_ratio")).alias("exposure"))


@query("WITH t AS (SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) + INTERVAL 9 HOUR + to_seconds(event_id % 3000) AS arrives FROM events) SELECT event_id, CASE WHEN hour(arrives) < 12 THEN '오전 ' ELSE '오후 ' END || CAST((hour(arrives) + 11) % 12 + 1 AS VARCHAR) || ':' || lpad(CAST(minute(arrives) AS VARCHAR), 2, '0') || ' 도착' AS arrival FROM t")
def arrival_labels(spark, sf):
    e = view(spark, sf, "events")
    return e.select("event_id", rules.arrival_label(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 3000).alias("arrival"))


_COMPARE = with_views("summaries") + """, m AS (SELECT request_id, mode, greatest(1, CAST(floor(time_sec / 60 + 0.5e0) AS BIGINT)) AS w, greatest(0, CAST(floor(sun_sec / 60 + 0.5e0) AS BIGINT)) AS s FROM lens_summaries),
    c AS (SELECT a.*, b.s - a.s AS saved, CASE WHEN a.mode = 'shortest' THEN 'baseline' WHEN b.s - a.s <= 0 THEN 'no-saving' ELSE 'saving' END AS kind, greatest(0, a.w - b.w) AS extra FROM m AS a JOIN m AS b ON a.request_id = b.request_id AND b.mode = 'shortest')"""


def _compared(spark, sf):
    s = view(spark, sf, "summaries")
    base = s.where("mode = 'shortest'").select("request_id", F.col("time_sec").alias("bt"), F.col("sun_sec").alias("bs"))
    return s.join(base, "request_id").select("request_id", "mode", rules.comparison(F.col("mode") == "shortest", F.col("time_sec"), F.col("sun_sec"), F.col("bt"), F.col("bs")).alias("c"))


@query(_COMPARE + " SELECT request_id, mode, kind, CASE WHEN kind <> 'saving' THEN s END AS sun_min, CASE WHEN kind = 'saving' THEN extra END AS extra_min, CASE WHEN kind = 'saving' THEN saved END AS sun_saved_min FROM c")
def compare_to_shortest(spark, sf):
    return _compared(spark, sf).select("request_id", "mode", "c.*")


@query(_COMPARE + """, l AS (SELECT *, CASE mode WHEN 'shortest' THEN '빠른길' WHEN 'balanced' THEN '균형' ELSE '그늘우선' END AS label FROM c) SELECT request_id, mode, CASE WHEN kind <> 'saving' THEN label || '의 예상 햇빛 노출은 ' || CAST(s AS VARCHAR) || '분이에요.'
    WHEN extra = 0 THEN label || '은 빠른길보다 더 걸리지 않고, 예상 햇빛 노출은 ' || CAST(saved AS VARCHAR) || '분 적어요.' ELSE label || '은 빠른길보다 ' || CAST(extra AS VARCHAR) || '분 더 걸리고, 예상 햇빛 노출은 ' || CAST(saved AS VARCHAR) || '분 적어요.' END AS sentence FROM l""")
def comparison_sentence(spark, sf):
    label = F.create_map(*(F.lit(x) for m, (_, text) in rules.MODES.items() for x in (m, text)))[F.col("mode")]
    return _compared(spark, sf).select("request_id", "mode", rules.comparison_sentence(label, F.col("c")).alias("sentence"))


@query(with_views("weather") + " SELECT event_id, CASE WHEN uv < 3 THEN 'low' WHEN uv < 6 THEN 'moderate' WHEN uv < 8 THEN 'high' WHEN uv < 11 THEN 'very-high' ELSE 'extreme' END AS risk FROM lens_weather")
def uv_risk(spark, sf):
    return view(spark, sf, "weather").select("event_id", rules.uv_risk(F.col("uv")).alias("risk"))


_GUIDE = "CASE WHEN NOT is_day THEN 'shortest' WHEN uv >= 6 OR feels >= 30 THEN 'maxShade' WHEN uv >= 3 OR feels >= 27 THEN 'balanced' ELSE 'shortest' END"


@query(with_views("weather") + f" SELECT event_id, {_GUIDE} AS mode, CASE WHEN offset_minutes > 0 THEN 'balanced' ELSE {_GUIDE} END AS recommended FROM lens_weather")
def weather_guidance(spark, sf):
    mode = rules.weather_mode(F.col("is_day"), F.col("uv"), F.col("feels"))
    return view(spark, sf, "weather").select("event_id", mode.alias("mode"), rules.recommended_mode(F.col("offset_minutes"), mode).alias("recommended"))


@query(with_views("weather") + " SELECT event_id, CASE WHEN NOT is_day THEN '☾' WHEN code >= 95 THEN '⛈' WHEN code >= 51 THEN '☔' WHEN code >= 2 THEN '☁' ELSE '☀' END AS symbol FROM lens_weather")
def weather_symbol(spark, sf):
    return view(spark, sf, "weather").select("event_id", rules.weather_symbol(F.col("code"), F.col("is_day")).alias("symbol"))


@query(with_views("feedback") + " SELECT id, CASE WHEN verdict IN ('good', 'mid', 'bad') AND length(memo) <= 500 AND length(repeat(path_key, 25)) <= 60 THEN 'OK' ELSE 'INVALID_FEEDBACK' END AS status FROM lens_feedback")
def feedback_valid(spark, sf):
    return view(spark, sf, "feedback").select("id", writers.feedback_status(F.col("memo"), F.repeat("path_key", 25), F.col("verdict")).alias("status"))


@query(with_views("feedback") + ", r AS (SELECT id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id) AS day_rank FROM lens_feedback) SELECT id, day_rank FROM r WHERE day_rank <= 100")
def feedback_daily_cap(spark, sf):
    return writers.within_daily_cap(view(spark, sf, "feedback"), 100).select("id", "day_rank")


@query(with_views("feedback") + " SELECT id, CASE WHEN memo[1:1] IN ('=', '+', '-', '@') THEN '''' || memo ELSE memo END AS memo FROM lens_feedback")
def feedback_escaped(spark, sf):
    return view(spark, sf, "feedback").select("id", writers.safe_cell(F.col("memo")).alias("memo"))


@query(with_views("feedback") + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, path_key ORDER BY ts, id) AS k FROM lens_feedback) SELECT user_id, path_key, id FROM r WHERE k = 1")
def feedback_dedupe(spark, sf):
    return writers.first_of_path(view(spark, sf, "feedback")).select("user_id", "path_key", "id")


@query("SELECT event_type AS name, count(*) AS n_events FROM events GROUP BY 1")
def analytics_event_counts(spark, sf):
    return adherence.event_counts(view(spark, sf, "events").withColumnRenamed("event_type", "name"))


_NEAR = """, k AS (SELECT *, cos(radians(lat)) * 111320e0 AS kx FROM lens_gps), v AS (SELECT *, (127.02e0 - lon) * kx AS ax, (37.498e0 - lat) * 110540e0 AS ay, (127.044e0 - lon) * kx AS bx, (37.4982e0 - lat) * 110540e0 AS by_ FROM k),
    t AS (SELECT *, greatest(0e0, least(1e0, (-ax * (bx - ax) - ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM v),
    s AS (SELECT event_id, user_id, ts, acc, sqrt((ax + t * (bx - ax)) * (ax + t * (bx - ax)) + (ay + t * (by_ - ay)) * (ay + t * (by_ - ay))) AS d FROM t),
    f AS (SELECT *, acc <= 50 AND greatest(0, d - acc) > 35 AS far FROM s), g AS (SELECT *, sum(CASE WHEN far THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f),
    n AS (SELECT *, CASE WHEN far THEN sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) ELSE 0 END AS streak FROM g)"""


def gps_samples(spark, sf):
    point = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    route = F.array(point(37.498, 127.02), point(37.4982, 127.044))
    g = adherence.normalise(view(spark, sf, "gps")).where("valid")
    return g.withColumn("distance_m", adherence.distance_to_route(F.col("lat"), F.col("lon"), route)).withColumn("path_key", F.lit("1:2"))


@query(with_views("gps") + _NEAR + " SELECT event_id, user_id, round(d, 5) AS distance_m, CAST(streak AS INT) AS streak, CASE WHEN acc > 50 THEN 'checking' WHEN greatest(0, d - acc) <= 20 THEN 'on-route' WHEN streak >= 3 THEN 'off-route' ELSE 'checking' END AS kind FROM n")
def adherence_states(spark, sf):
    return adherence.adherence_batch(gps_samples(spark, sf)).select("event_id", "user_id", F.round("distance_m", 5).alias("distance_m"), "streak", "kind")


@query(with_views("gps") + " SELECT event_id, CASE WHEN event_id % 40 = 0 OR acc - 2 < 0 THEN 'LOCATION_UNAVAILABLE' WHEN acc * 3 > 100 THEN 'LOCATION_LOW_ACCURACY' WHEN event_id % 9 = 0 THEN 'OUTSIDE_SEOUL' ELSE 'OK' END AS status FROM lens_gps")
def location_fix_status(spark, sf):
    g = view(spark, sf, "gps")
    lat = F.when(F.col("event_id") % 40 == 0, F.lit(None)).otherwise(F.col("lat"))
    accuracy = F.when(F.col("acc") - 2 < 0, F.lit(-1.0)).otherwise(F.col("acc") * 3)
    return g.select("event_id", readers.fix_status(lat, F.col("lon"), accuracy, F.col("event_id") % 9 != 0).alias("status"))


@query(with_views("gps") + " SELECT event_id, least(acc * 40, 1000e0) AS radius_m FROM lens_gps")
def accuracy_circles(spark, sf):
    return view(spark, sf, "gps").select("event_id", rules.accuracy_circle(F.col("acc") * 40).alias("radius_m"))


@query("SELECT DISTINCT l_suppkey % 50 AS tile_id, l_orderkey AS id FROM lineitem")
def legacy_tile_elements(spark, sf):
    li = view(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("tile_id"), F.col("l_orderkey").alias("id"))
    return writers.legacy_tiles(li)


@query("SELECT 'doc-' || doc_id AS name, 'drifted' AS problem FROM documents WHERE doc_id % 7 = 0 AND octet_length(encode(text)) > 1000 AND doc_id % 5 <> 0 UNION ALL SELECT 'doc-' || doc_id, 'missing' FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL")
def artifact_drift(spark, sf):
    """Texts that came out otherwise than their source gives, or not at all."""
    d = view(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"))
    cut = F.when((F.col("doc_id") % 7 == 0) & (F.octet_length("content") > 1000), F.left("content", F.lit(10))).otherwise(F.col("content"))
    return boundary.drifted(d.where("doc_id % 5 <> 0").select("name", cut.alias("content")), d)


@query("SELECT max(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def latest_request_wins(spark, sf):
    e = view(spark, sf, "events").select("user_id", "event_id", F.col("event_id").alias("request_seq"))
    return adherence.latest(e).select("user_id", "event_id")


@query("SELECT 'doc-' || doc_id AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def artifact_hashes(spark, sf):
    d = view(spark, sf, "documents").where("text is not null")
    return guards.artifact_hashes(d, F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("text"))


@query("SELECT doc_id, left(sha256(text), 24) AS release_id FROM documents")
def release_id(spark, sf):
    return view(spark, sf, "documents").select("doc_id", guards.release_id(F.col("text")).alias("release_id"))


@query("WITH l AS (SELECT l_orderkey AS list_id, l_partkey AS value, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem), b AS (SELECT *, value <= lag(value) OVER (PARTITION BY list_id ORDER BY seq) AS bad FROM l) SELECT list_id, count(*) AS n, NOT bool_or(coalesce(bad, false)) AS sorted_unique FROM b GROUP BY 1")
def manifest_sorted_unique(spark, sf):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    li = view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("list_id"), seq.alias("seq"), F.col("l_partkey").alias("value"))
    return guards.sorted_unique(li, "list_id", "seq", "value")
