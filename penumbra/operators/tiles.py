"""Map tiles: which elements belong where, selection for a request, merging, statistics, policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

#: Most tiles of an element and of a request, most bytes of a request, buffer around it in degrees, policy rows.
MOST_PER_ELEMENT, MOST_PER_REQUEST, MOST_BYTES, BUFFER_DEG, MOST_POLICY = 32, 36, 12_000_000, 0.01, 20_000


#: Tiles to a side of the blocks in which requests meet tiles.
GRID = 16


def tile_name(x: Column, y: Column) -> Column:
    return F.concat_ws("-", F.lit(str(geo.ZOOM)), x.cast("string"), y.cast("string"))


def at_tiles(rows: DataFrame, south: Column, west: Column, north: Column, east: Column) -> DataFrame:
    """Rows once for each tile (tile_x, tile_y) of their box; none for those that span too many."""
    x0, x1 = geo.tile_x(west), geo.tile_x(east)
    y0, y1 = geo.tile_y(north), geo.tile_y(south)
    fits = (x1 - x0 + 1) * (y1 - y0 + 1) <= MOST_PER_ELEMENT
    return rows.where(fits).withColumn("tile_x", F.explode(F.sequence(x0, x1))).withColumn("tile_y", F.explode(F.sequence(y0, y1)))


def tiles_of_ways(ways: DataFrame) -> DataFrame:
    """(way_id, tile_x, tile_y) for all tiles of a way's box (south, west, north, east); none for ways that span too many."""
    return at_tiles(ways, *(F.col(c) for c in ("south", "west", "north", "east"))).select("way_id", "tile_x", "tile_y")


def owner_tile(buildings: DataFrame) -> DataFrame:
    """Each building's one tile, by the mean of its vertices (lat, lon)."""
    return buildings.withColumns({"tile_x": geo.tile_x(F.col("lon")), "tile_y": geo.tile_y(F.col("lat"))})


def tiles_of_requests(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(request_id, and the catalogue's columns) of the tiles that each request's grown box meets.

    Both sides meet in blocks of GRID by GRID tiles, an equality join; the boxes decide.
    """
    box = (F.least("start_lat", "goal_lat") - BUFFER_DEG, F.least("start_lon", "goal_lon") - BUFFER_DEG, F.greatest("start_lat", "goal_lat") + BUFFER_DEG, F.greatest("start_lon", "goal_lon") + BUFFER_DEG)
    tile = tuple(F.col(c) for c in ("south", "west", "north", "east"))
    block = lambda c: F.floor(c / GRID)
    placed = catalogue.withColumns({"_bx": block(geo.tile_x((F.col("west") + F.col("east")) / 2)), "_by": block(geo.tile_y((F.col("south") + F.col("north")) / 2))})
    # One tile more on each side: boxes that only touch meet too.
    spread = requests.withColumn("_bx", F.explode(F.sequence(block(geo.tile_x(box[1]) - 1), block(geo.tile_x(box[3]) + 1)))).withColumn("_by", F.explode(F.sequence(block(geo.tile_y(box[2]) - 1), block(geo.tile_y(box[0]) + 1))))
    return spread.join(placed, ["_bx", "_by"]).where(geo.boxes_meet(box, tile)).select("request_id", *catalogue.columns)


def select_tiles(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(request_id, n_tiles, bytes, status): tiles that a request's grown box meets, and whether they are too many."""
    met = tiles_of_requests(requests, catalogue).groupBy("request_id").agg(F.count("*").alias("n_tiles"), F.sum("bytes").alias("bytes"))
    sums = requests.select("request_id").join(met, "request_id", "left").select("request_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tiles", "bytes")))
    return sums.withColumn("status", F.when(F.col("n_tiles") == 0, "AREA_DATA_UNAVAILABLE").when((F.col("n_tiles") > MOST_PER_REQUEST) | (F.col("bytes") > MOST_BYTES), "ROUTE_TOO_LARGE").otherwise("OK"))


def merge_tiles(elements: DataFrame) -> DataFrame:
    """Elements (type, id, tile_seq, ...) once each; the first tile's copy stays."""
    first = F.row_number().over(Window.partitionBy("type", "id").orderBy("tile_seq"))
    return elements.withColumn("_k", first).where("_k = 1").drop("_k")


def work(elements: DataFrame) -> DataFrame:
    """Ways, buildings and points of each tile, and of all together in the row with a null tile."""
    return elements.rollup("tile_id").agg(F.count_if(F.col("type") == "way").alias("ways"), F.count_if(F.col("type") == "building").alias("buildings"), F.sum("n_points").alias("points"))


def policy_ids(tagged: DataFrame, wanted: Column, name: str) -> DataFrame:
    """Sorted distinct ids for which ``wanted`` holds, however many."""
    return tagged.where(wanted).select(F.col("id").alias(name)).distinct().orderBy(name)


def policy(tagged: DataFrame, wanted: Column, name: str, most: int = MOST_POLICY) -> DataFrame:
    """The ids for a policy file, of which the format allows ``most``: an error if they are more."""
    ids = policy_ids(tagged, wanted, name)
    if ids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ids in a policy list")
    return ids


def ways_inside(ways: DataFrame, boundary: Column) -> DataFrame:
    """Ways (way_id, points with lat and lon) with inside: their vertex mean or any of their points lies within the boundary's polygons."""
    mean = lambda c: geo.vertex_mean(F.col("points"), c)
    within = lambda lat, lon: geo.in_multipolygon(lon, lat, boundary, "lon", "lat")
    return ways.withColumn("inside", F.coalesce(within(mean("lat"), mean("lon")) | F.exists("points", lambda p: within(p["lat"], p["lon"])), F.lit(False)))


def way_geometry(refs: DataFrame, nodes: DataFrame, boundary: Column) -> DataFrame:
    """(way_id, n_points, n_found, inside, owner_inside) of ways given by refs (way_id, node_id) to nodes (id, lat, lon).

    n_found are the points whose node is there, at most one for each reference. owner_inside: the mean of the found points lies
    within the boundary's polygons; inside: that, or any found point does. Counts and sums are combined before the shuffle, so long ways are never gathered.
    """
    within = lambda lat, lon: geo.in_multipolygon(lon, lat, boundary, "lon", "lat")
    known = nodes.select(F.col("id").alias("node_id"), "lat", "lon", within(F.col("lat"), F.col("lon")).alias("_within")).dropDuplicates(["node_id"])
    sums = refs.select("way_id", "node_id").join(known, "node_id", "left").groupBy("way_id").agg(
        F.count("*").alias("n_points"), F.count("lat").alias("n_found"), F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"), F.max("_within").alias("_touched"))
    owner = F.coalesce(within(F.col("_lat"), F.col("_lon")), F.lit(False))
    return sums.select("way_id", "n_points", "n_found", (F.coalesce("_touched", F.lit(False)) | owner).alias("inside"), owner.alias("owner_inside"))


def build_elements(refs: DataFrame, nodes: DataFrame, ways: DataFrame, boundary: Column, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Elements for ``build_stats``: nodes (id, lat, lon), and ways (id, candidate, walkable, is_building) with their geometry.

    bounds: (south, west, north, east) in which nodes are kept. Ways without references have no points.
    """
    south, west, north, east = map(F.lit, bounds)
    no, none = F.lit(False), F.lit(0).cast("long")
    shapes = way_geometry(refs, nodes, boundary)
    of_nodes = nodes.select(
        F.lit("node").alias("type"), (F.col("lat").between(south, north) & F.col("lon").between(west, east)).alias("in_bounds"), no.alias("candidate"), no.alias("walkable"), no.alias("is_building"),
        none.alias("n_points"), none.alias("n_found"), no.alias("inside"), no.alias("owner_inside"))
    of_ways = ways.join(shapes, ways["id"] == shapes["way_id"], "left").select(
        F.lit("way").alias("type"), no.alias("in_bounds"), "candidate", "walkable", "is_building",
        F.coalesce("n_points", none).alias("n_points"), F.coalesce("n_found", none).alias("n_found"), F.coalesce("inside", no).alias("inside"), F.coalesce("owner_inside", no).alias("owner_inside"))
    return of_nodes.unionByName(of_ways)


def build_stats(elements: DataFrame) -> DataFrame:
    """One row of counts of a build: parsed, kept_nodes, walkways, buildings, missing_geometry.

    elements: (type, in_bounds, candidate, walkable, is_building, n_points, n_found, inside, owner_inside), of which ways use the last ones.
    """
    way = F.col("type") == "way"
    used = way & (F.col("candidate") | F.col("is_building"))
    whole = (F.col("n_points") > 0) & (F.col("n_found") == F.col("n_points")) & (F.col("n_points") <= 1000)
    kept = used & whole & F.col("inside")
    return elements.agg(
        F.count("*").alias("parsed"), F.count_if((F.col("type") == "node") & F.col("in_bounds")).alias("kept_nodes"),
        F.count_if(kept & F.col("walkable") & (F.col("n_points") >= 2)).alias("walkways"),
        F.count_if(kept & F.col("is_building") & (F.col("n_points") >= 3) & F.col("owner_inside")).alias("buildings"), F.count_if(used & ~whole).alias("missing_geometry"))


def consistency(emitted: DataFrame, excluded: DataFrame, fallback: DataFrame, directed: DataFrame) -> DataFrame:
    """One row of counts that must all be 0: excluded ways that are in tiles, and policy ways that aren't."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    bad = one(excluded.join(emitted, "way_id", "left_semi"), "excluded_emitted")
    lost = one(fallback.join(emitted, "way_id", "left_anti"), "fallback_missing")
    astray = one(directed.join(emitted, "way_id", "left_anti"), "directed_missing")
    return bad.crossJoin(lost).crossJoin(astray)  # three single rows
