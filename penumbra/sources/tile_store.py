"""Map elements stored by tile: written once, of which a batch of requests reads only the tiles that it needs.

A store is a folder with the tables ``ways`` and ``buildings``, partitioned by zones of tiles, and ``catalogue``, a row for each
tile with its box, its size and work, and what is wrong with it. Requests meet the catalogue; the tiles that they select
are joined with the stored tables on the zone and the tile, so Spark prunes partitions while it runs. A folder for each tile
would be pruned closer, but making and listing so many takes longer than everything else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import guards, tiles
from ..operators.spatial import with_cells
from ..session import bounded, keep
from . import readers

#: Columns of the catalogue that are limited in one tile and, added up, in one request.
WORK = ["ways", "buildings", "way_points", "building_points"]
#: Most bytes of one tile.
MOST_TILE_BYTES = 2_000_000
#: Tiles to a side of a zone, which is one folder.
ZONE = 16
#: Columns of the catalogue with the box around all points of a tile's elements. A way may reach beyond its tile, and beyond the poles a tile's own box is elsewhere.
EXTENT = ["least_lat", "least_lon", "most_lat", "most_lon"]
#: Side in metres of the grid in which areas meet tiles.
GRID_M = 1000.0


def _bounds(points: str) -> list[Column]:
    side = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return [side(F.array_min, "lat").alias("south"), side(F.array_min, "lon").alias("west"), side(F.array_max, "lat").alias("north"), side(F.array_max, "lon").alias("east")]


def tiled_ways(ways: DataFrame) -> DataFrame:
    """Ways (id, nodes, points, ...) once for each tile of their box, with its tile_id; none for ways that span too many."""
    boxed = ways.where("id is not null").withColumn("_box", F.struct(*_bounds("points")))
    placed = tiles.at_tiles(boxed, *(F.col(f"_box.{c}") for c in ("south", "west", "north", "east")))
    return placed.withColumn("tile_id", tiles.tile_name(F.col("tile_x"), F.col("tile_y"))).drop("_box", "tile_x", "tile_y")


def ways_at_points(ways: DataFrame) -> DataFrame:
    """Ways (id, nodes, points, ...) once for each tile in which one of their points lies, with its tile_id: none is left out, however many tiles lie between its points."""
    own = F.array_distinct(F.transform("points", lambda p: tiles.tile_name(geo.tile_x(p["lon"]), geo.tile_y(p["lat"]))))
    return ways.where("id is not null").withColumn("tile_id", F.explode(own))


def tiled_buildings(buildings: DataFrame, boundary: Column | None = None) -> DataFrame:
    """Buildings (id, points, ...) with the tile of their vertex mean, if that lies within the boundary's polygons."""
    mean = lambda c: geo.vertex_mean(F.col("points"), c)
    placed = buildings.withColumns({"lat": mean("lat"), "lon": mean("lon")})
    if boundary is not None:
        placed = placed.where(geo.in_multipolygon(F.col("lon"), F.col("lat"), boundary, "lon", "lat"))
    return tiles.owner_tile(placed).withColumn("tile_id", tiles.tile_name(F.col("tile_x"), F.col("tile_y"))).drop("lat", "lon", "tile_x", "tile_y")


def _tile_number(k: int) -> Column:
    """Part of a tile's name; beyond 85 degrees of latitude the last one is less than 0, so a name isn't cut at each dash."""
    return F.regexp_extract("tile_id", "^(-?[0-9]+)-(-?[0-9]+)-(-?[0-9]+)$", k).cast("long")


def zone_of_tile() -> Column:
    """Name of the zone in which a tile (tile_id) lies; its letter keeps readers from taking it for a number or date."""
    return F.concat(F.lit("z"), F.floor(_tile_number(2) / ZONE).cast("string"), F.lit("-"), F.floor(_tile_number(3) / ZONE).cast("string"))


def catalogue_of(ways: DataFrame, buildings: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """A row for each tile: its box, bytes, work, and problem (null: none).

    Bytes are those of the elements' JSON. A tile whose work is beyond the limits of a tile is ROUTE_DATA_TOO_COMPLEX, one with an
    element beyond those of an element INVALID_TILE_DATA; ``problems`` (tile_id, problem) come first.
    """
    ends = lambda name: [f(side).alias(f"_{name}_{c}") for f, side, c in zip((F.min, F.min, F.max, F.max), _bounds("points"), EXTENT)]
    count = lambda t, name: t.groupBy("tile_id").agg(*ends(name), F.count("*").alias(name), F.sum(F.size("points")).alias(f"{name[:-1]}_points"), F.sum(F.octet_length(F.to_json(F.struct(*(c for c in t.columns if c != "tile_id"))))).alias(f"_{name}"), F.max(F.size("points")).alias(f"_most_{name}"))
    both = count(ways, "ways").join(count(buildings, "buildings"), "tile_id", "full")
    extent = [f(f"_ways_{c}", f"_buildings_{c}").alias(c) for f, c in zip((F.least, F.least, F.greatest, F.greatest), EXTENT)]
    both = both.select(*extent, *(F.coalesce(c, F.lit(0)).alias(c) if c != "tile_id" else c for c in both.columns if not c.endswith(tuple(EXTENT))))
    too_much = reduce(lambda a, b: a | b, [F.col(c) > guards.LIMITS[f"tile_{c}"] for c in WORK])
    invalid = (F.col("_most_ways") > guards.LIMITS["way_points_per_element"]) | (F.col("_most_buildings") > guards.LIMITS["building_points_per_element"])
    size = F.col("_ways") + F.col("_buildings")
    found = F.when(invalid, "INVALID_TILE_DATA").when(too_much, "ROUTE_DATA_TOO_COMPLEX").when(size > MOST_TILE_BYTES, "INVALID_TILE_DATA")
    x, y = _tile_number(2), _tile_number(3)
    out = both.select("tile_id", geo.tile_north(y + 1).alias("south"), geo.tile_west(x).alias("west"), geo.tile_north(y).alias("north"), geo.tile_west(x + 1).alias("east"), size.alias("bytes"), *WORK, found.alias("problem"), *EXTENT)
    if problems is None:
        return out
    given = problems.groupBy("tile_id").agg(F.min("problem").alias("_given"))
    known = out.join(given, "tile_id", "full").withColumns({"problem": F.coalesce("_given", "problem"), **{c: F.coalesce(c, F.lit(0)) for c in ["bytes", *WORK]}}).drop("_given")
    return known.withColumns({"south": geo.tile_north(y + 1), "west": geo.tile_west(x), "north": geo.tile_north(y), "east": geo.tile_west(x + 1)})


def write_store(ways: DataFrame, buildings: DataFrame, path: str, problems: DataFrame | None = None) -> None:
    """Write elements that have a tile_id, and the catalogue, below ``path``. A zone is one folder, its elements in order of tile and id."""
    for name, table in (("ways", ways), ("buildings", buildings)):
        table.withColumn("zone", zone_of_tile()).repartition("zone").sortWithinPartitions("zone", "tile_id", "id").write.partitionBy("zone").parquet(f"{path}/{name}")
    spark = ways.sparkSession
    catalogue_of(_stored(spark, path, "ways", ways), _stored(spark, path, "buildings", buildings), problems).write.parquet(f"{path}/catalogue")


def _stored(spark: SparkSession, path: str, name: str, like: DataFrame) -> DataFrame:
    """A stored table with its own schema, so that an empty one can be read."""
    schema = like.select(*(c for c in like.columns if c != "tile_id"), F.col("tile_id").cast("string").alias("tile_id")).schema
    return spark.read.schema(schema).parquet(f"{path}/{name}").drop("zone")


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a store's tables hold what its catalogue says."""
    rows = spark.read.parquet(f"{path}/catalogue").where("problem is null").agg(F.sum("ways").alias("ways"), F.sum("buildings").alias("buildings")).first()
    known = spark.read.parquet(f"{path}/catalogue").where("problem is null").select("tile_id")
    held = {name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").join(bounded(known), "tile_id", "left_semi").count() if rows[name] else 0 for name in ("ways", "buildings")}
    return all(held[name] == (rows[name] or 0) for name in held)


def from_files(files: DataFrame, declared: DataFrame, excluded: DataFrame, fallback: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ways, buildings, problems) of compact tile files (``readers.read_whole``), checked against the manifest's tiles.

    declared: (id, bytes, sha256). A declared tile without a file is TILE_LOAD_FAILED, one with other content ROUTE_ARTIFACT_MISMATCH,
    and one that doesn't parse, is another tile or has an element out of its format INVALID_TILE_DATA. None of these gives elements.
    """
    named = files.withColumn("tile_id", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    both = bounded(declared.select(F.col("id").alias("tile_id"), F.col("sha256").alias("_want"))).join(named, "tile_id", "left")
    problem = F.when(F.col("path").isNull() | (F.col("status") != "OK"), "TILE_LOAD_FAILED").when(F.col("sha256") != F.col("_want"), "ROUTE_ARTIFACT_MISMATCH")
    parsed = F.from_json("text", readers.TILE)
    shape = F.coalesce((parsed["schema"] == 2) & (parsed["id"] == F.col("tile_id")) & parsed["w"].isNotNull() & parsed["b"].isNotNull(), F.lit(False))
    judged = keep(both.withColumn("problem", F.coalesce(problem, F.when(~shape, "INVALID_TILE_DATA"))))
    ways, buildings = readers.compact_tiles(judged.where("problem is null").select("text"))
    ways_ok = ways.withColumn("ok", F.coalesce((F.col("id") > 0) & guards.way_is_valid(F.col("flags"), F.col("nodes"), F.col("coords")), F.lit(False)))
    buildings_ok = buildings.withColumn("ok", F.coalesce((F.col("id") > 0) & guards.building_is_valid(F.col("height"), F.col("levels"), F.col("coords")), F.lit(False)))
    bad = ways_ok.where(~F.col("ok")).select("tile_id").unionByName(buildings_ok.where(~F.col("ok")).select("tile_id")).distinct().withColumn("problem", F.lit("INVALID_TILE_DATA"))
    problems = keep(judged.where("problem is not null").select("tile_id", "problem").unionByName(bad))
    good_ways = ways.join(bounded(bad.select("tile_id")), "tile_id", "left_anti")
    good_buildings = buildings.join(bounded(bad.select("tile_id")), "tile_id", "left_anti")
    return readers.expand_ways(good_ways, excluded, fallback), good_buildings.select("tile_id", "id", "height", "levels", readers.points(F.col("coords")).alias("points")), problems


def chosen_tiles(requests: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((request_id, tile_id, status) of the tiles that requests select, (request_id, status) of all requests).

    The first that holds: AREA_DATA_UNAVAILABLE (no tile), ROUTE_TOO_LARGE (too many tiles or bytes), the problem of the first tile
    that has one, ROUTE_DATA_TOO_COMPLEX (work beyond the limits of a request), OK. requests: (request_id, start_lat, start_lon, goal_lat, goal_lon).
    """
    met = keep(tiles.tiles_of_requests(requests, catalogue.select("tile_id", "south", "west", "north", "east", "bytes", "problem", *WORK)))
    sums = met.groupBy("request_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.min(F.when(F.col("problem").isNotNull(), F.struct("tile_id", "problem"))).alias("first"), *(F.sum(c).alias(c) for c in WORK))
    too_much = reduce(lambda a, b: a | b, [F.col(c) > guards.LIMITS[f"route_{c}"] for c in WORK])
    status = F.when(F.col("n").isNull(), "AREA_DATA_UNAVAILABLE").when((F.col("n") > tiles.MOST_PER_REQUEST) | (F.col("total") > tiles.MOST_BYTES), "ROUTE_TOO_LARGE").when(F.col("first").isNotNull(), F.col("first.problem")).when(too_much, "ROUTE_DATA_TOO_COMPLEX").otherwise("OK")
    judged = keep(requests.select("request_id").join(sums, "request_id", "left").select("request_id", status.alias("status")))
    return keep(met.select("request_id", "tile_id").join(judged, "request_id")), judged


def extents(catalogue: DataFrame) -> DataFrame:
    """(tile_id, minx, miny, maxx, maxy): the projected boxes around the elements of all tiles that have any."""
    held = catalogue.where("least_lat is not null")
    return held.select("tile_id", geo.to_x(F.col("least_lon")).alias("minx"), geo.to_y(F.col("least_lat")).alias("miny"), geo.to_x(F.col("most_lon")).alias("maxx"), geo.to_y(F.col("most_lat")).alias("maxy"))


def tiles_within(areas: DataFrame, held: DataFrame) -> DataFrame:
    """(tile_id, status) of every tile with elements in any of the areas (minx, miny, maxx, maxy), for ``read_chosen``: no limit on tiles, bytes or work. held: ``extents``."""
    box = ("minx", "miny", "maxx", "maxy")
    grid = lambda rows: with_cells(rows, *(F.col(c) for c in box), GRID_M)
    around = grid(areas.select(*box)).select("cell_x", "cell_y", F.struct(*box).alias("area"))
    meets = geo.boxes_meet(tuple(F.col(f"area.{c}") for c in box), tuple(F.col(c) for c in box))
    return grid(held).join(around, ["cell_x", "cell_y"]).where(meets).select("tile_id").distinct().withColumn("status", F.lit("OK"))


def read_chosen(spark: SparkSession, path: str, table: str, chosen: DataFrame) -> DataFrame:
    """Elements of the tiles that requests with the status OK select, once each: the copy of the first tile stays.

    The join is on the partition column and the tile, with a small filtered side, so only the zones of these tiles are read.
    """
    wanted = bounded(chosen.where("status = 'OK'").select("tile_id").distinct().withColumn("zone", zone_of_tile()))
    stored = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}").join(wanted, ["zone", "tile_id"], "left_semi")
    first = F.row_number().over(Window.partitionBy("id").orderBy(_tile_number(1), _tile_number(2), _tile_number(3)))
    return stored.withColumn("_k", first).where("_k = 1").drop("_k", "tile_id", "zone")
