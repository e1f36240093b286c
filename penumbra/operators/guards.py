"""Limits and integrity: resource status, element checks, hashes, release ids, sorted lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most of each resource in a tile, a corridor, a graph and a route.
LIMITS = {
    "tile_ways": 1600, "tile_buildings": 3500, "tile_way_points": 8000, "tile_building_points": 25000,
    "route_ways": 20000, "route_buildings": 45000, "route_way_points": 110000, "route_building_points": 300000,
    "way_points_per_element": 512, "building_points_per_element": 256,
    "graph_nodes": 100000, "graph_edges": 100000, "graph_node_degree": 64, "graph_components": 512,
    "route_segments": 2000, "direction_steps": 400, "shadow_candidates_per_point": 512,
}


def resource_status(counts: DataFrame, checks: dict[str, str], strict: bool = False) -> DataFrame:
    """Adds status to rows of counts; ``checks`` names the limit of each column. A value is fine up to its limit.

    With ``strict`` the job ends with an error on the first row over a limit.
    """
    within = reduce(lambda a, b: a & b, [F.col(c).between(0, LIMITS[k]) for c, k in checks.items()])
    status = F.when(within, F.lit("OK")).otherwise(F.raise_error(F.lit("ROUTE_DATA_TOO_COMPLEX")).cast("string") if strict else F.lit("ROUTE_DATA_TOO_COMPLEX"))
    return counts.withColumn("status", status)


def way_is_valid(flags: Column, nodes: Column, coords: Column) -> Column:
    """Of a compact way: flags within 0-7, two points or more, two numbers a point, all within the world."""
    n = F.size(nodes)
    lat_ok = F.forall(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(coords, 2 * i).between(-90_000_000, 90_000_000) & F.get(coords, 2 * i + 1).between(-180_000_000, 180_000_000))
    return flags.between(0, 7) & n.between(2, LIMITS["way_points_per_element"]) & (F.size(coords) == 2 * n) & F.coalesce(lat_ok, F.lit(False))


def building_is_valid(height: Column, levels: Column, coords: Column) -> Column:
    """Of a compact building: three points or more, two numbers a point, within the world; height and levels positive where they are known."""
    n = (F.size(coords) / 2).cast("int")
    within = F.forall(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(coords, 2 * i).between(-90_000_000, 90_000_000) & F.get(coords, 2 * i + 1).between(-180_000_000, 180_000_000))
    sized = (F.size(coords) % 2 == 0) & n.between(3, LIMITS["building_points_per_element"])
    real = F.coalesce((height > 0) & (height <= 1000), F.lit(True)) & F.coalesce((levels > 0) & (levels <= 300), F.lit(True))
    return F.coalesce(sized & within & real, F.lit(False))


def sorted_unique(table: DataFrame, group: str, seq: str, value: str) -> DataFrame:
    """For each list: whether its values strictly rise."""
    order = Window.partitionBy(group).orderBy(seq)
    bad = F.col(value) <= F.lag(value).over(order)
    return table.withColumn("_bad", F.coalesce(bad, F.lit(False))).groupBy(group).agg(F.count("*").alias("n"), (~F.bool_or("_bad")).alias("sorted_unique"))


def artifact_hashes(files: DataFrame, path: Column, content: Column) -> DataFrame:
    """(path, bytes, sha256) of each file's content."""
    return files.select(path.alias("path"), F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def release_id(descriptor: Column) -> Column:
    """First 24 hex digits of the hash of the descriptor's text as it was written."""
    return F.left(F.sha2(descriptor, 256), F.lit(24))


def verify(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """Paths that are missing, unexpected or changed; no rows if all is well."""
    both = declared.alias("d").join(actual.alias("a"), "path", "full")
    problem = F.when(F.col("a.sha256").isNull(), "missing").when(F.col("d.sha256").isNull(), "unexpected").when((F.col("a.sha256") != F.col("d.sha256")) | (F.col("a.bytes") != F.col("d.bytes")), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")
