"""The service area: containment by latitude buckets, tolerant containment, simplified rings."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.types import POINTS
from ..session import bounded, keep

#: Latitude buckets, probe distance in degrees, tolerance of simplification in degrees, decimal places.
BUCKETS, PROBE_DEG, TOLERANCE_DEG, PLACES = 128, 0.001, 0.00015, 6


def bucketed_edges(edges: DataFrame, south: float, north: float) -> DataFrame:
    """Edges (alat, alon, blat, blon) in each latitude bucket that they touch."""
    bucket = lambda lat: F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((lat - south) / (north - south) * BUCKETS))).cast("int")
    return edges.withColumn("bucket", F.explode(F.sequence(bucket(F.least("alat", "blat")), bucket(F.greatest("alat", "blat")))))


def inside(points: DataFrame, edges: DataFrame, south: float, west: float, north: float, east: float, key: str = "id") -> DataFrame:
    """(key, inside): even-odd count of the edges east of a point, found by equal latitude bucket after a box test. Null or NaN is outside."""
    bucket = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((F.col("lat") - south) / (north - south) * BUCKETS))).cast("int")
    boxed = points.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).withColumn("bucket", bucket)
    at = (F.col("blon") - F.col("alon")) * (F.col("lat") - F.col("alat")) / F.nullif(F.col("blat") - F.col("alat"), F.lit(0.0)) + F.col("alon")
    crosses = ((F.col("alat") > F.col("lat")) != (F.col("blat") > F.col("lat"))) & F.coalesce(F.col("lon") < at, F.lit(False))
    met = boxed.join(bounded(bucketed_edges(edges, south, north)), "bucket").where(crosses)
    odd = met.groupBy(key).agg((F.count("*") % 2 == 1).alias("odd"))
    return points.join(odd, key, "left").select(key, F.coalesce("odd", F.lit(False)).alias("inside"))


def inside_tolerant(points: DataFrame, edges: DataFrame, south, west, north, east, key: str = "id") -> DataFrame:
    """As ``inside``, but a point is also in if one of nine probes around it is. Only points that are not in by themselves are probed."""
    steps = F.array(*(F.lit(s * PROBE_DEG) for s in (-1, 0, 1)))
    plain = keep(inside(points, edges, south, west, north, east, key))
    near = points.where(F.col("lat").between(south - 2 * PROBE_DEG, north + 2 * PROBE_DEG) & F.col("lon").between(west - 2 * PROBE_DEG, east + 2 * PROBE_DEG))
    outside = near.join(plain.where("not inside"), key, "left_semi")
    probes = outside.withColumn("dlat", F.explode(steps)).withColumn("dlon", F.explode(steps)).select(F.struct(F.col(key).alias("owner"), "dlat", "dlon").alias("_probe"), (F.col("lat") + F.col("dlat")).alias("lat"), (F.col("lon") + F.col("dlon")).alias("lon"))
    hit = inside(probes, edges, south, west, north, east, "_probe").where("inside").select(F.col("_probe.owner").alias(key)).distinct().withColumn("_in", F.lit(True))
    return plain.join(hit, key, "left").select(key, (F.col("inside") | F.coalesce("_in", F.lit(False))).alias("inside"))


def _simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Keep the ends, and whatever is farther than the tolerance from the line between kept neighbours.

    A stretch of three points or fewer stays as it is, however close its middle is to the line.
    """
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a <= 2:
            keep.update(range(a, b + 1))
            continue
        (ax, ay), (bx, by) = points[a], points[b]
        far, at = 0.0, None
        for k in range(a + 1, b):
            px, py = points[k]
            dx, dy = bx - ax, by - ay
            size = dx * dx + dy * dy
            t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / size)) if size else 0.0
            off_x, off_y = ax + t * dx - px, ay + t * dy - py
            d = off_x * off_x + off_y * off_y
            if d > far:
                far, at = d, k
        if at is not None and far > tolerance * tolerance:
            todo += [(a, at), (at, b)]
    return [points[k] for k in sorted(keep)]


@F.pandas_udf(POINTS)
def simplified_ring(rings: pd.Series) -> pd.Series:
    """Rings closed, with fewer points, and rounded; null for fewer than four points, which are no ring."""

    def one(ring):
        if ring is None or len(ring) < 4:
            return None
        points = [(p["x"], p["y"]) for p in ring]
        points = _simplify(points if points[0] == points[-1] else points + points[:1], TOLERANCE_DEG)
        return [{"x": round(x, PLACES), "y": round(y, PLACES)} for x, y in points]

    return rings.map(one)


def simplified_rings(rings: DataFrame, key: str = "id", ring: str = "ring", tolerance: float = TOLERANCE_DEG, places: int = PLACES) -> DataFrame:
    """(key, ring) with rings closed, simplified and rounded, for all rings at once: the same as ``simplified_ring``, as a relational loop.

    Every point between kept ones belongs to one open stretch. A round finds the farthest point of each stretch of every ring; where
    it is beyond the tolerance the stretch is cut there, otherwise its points go. Rounds are few, as stretches are cut in
    parallel, and each is one aggregate and one join on the stretch. Rings of fewer than four points, and null ones, come back as null.
    """
    points = F.when(F.size(ring) >= 4, F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    closed = rings.select(F.col(key).alias("_key"), points.alias("p")).where(F.col("p").isNotNull())
    closed = closed.select("_key", F.when(F.get("p", F.lit(0)) == F.element_at("p", -1), F.col("p")).otherwise(F.concat("p", F.slice("p", 1, 1))).alias("p")).withColumn("n", F.size("p") - 1)
    last = F.col("n")
    ends = [F.lit(0).alias("a"), last.alias("b"), F.get("p", F.lit(0)).alias("pa"), F.get("p", last).alias("pb")]
    every = closed.select("_key", F.posexplode("p").alias("k", "q"), *ends)
    kept = [every.where((F.col("k") == 0) | (F.col("k") == F.col("b"))).select("_key", "k", "q")]
    todo = keep(every.where((F.col("k") > 0) & (F.col("k") < F.col("b"))))
    while not todo.isEmpty():
        short = F.col("b") - F.col("a") <= 2
        kept.append(todo.where(short).select("_key", "k", "q"))
        _, x, y, _ = geo.on_segment(*(F.col(f"{p}.{c}") for p in ("q", "pa", "pb") for c in "xy"))
        # From the nearest point, and never by a root: points as far but for the last bit decide where a stretch is cut.
        off_x, off_y = x - F.col("q.x"), y - F.col("q.y")
        far = todo.where(~short).withColumn("d", off_x * off_x + off_y * off_y)
        cuts = keep(far.groupBy("_key", "a").agg(F.max_by(F.struct("k", "q"), F.struct("d", -F.col("k"))).alias("c"), F.max("d").alias("d")).where(F.col("d") > tolerance * tolerance).select("_key", "a", "c.k", "c.q"))
        kept.append(cuts.select("_key", "k", "q"))
        cut = todo.where(~short).join(cuts.select("_key", "a", F.col("k").alias("at"), F.col("q").alias("pc")), ["_key", "a"]).where("k <> at")
        before = F.col("k") < F.col("at")
        side = lambda first, second: F.when(before, F.col(first)).otherwise(F.col(second))
        todo = keep(cut.select("_key", "k", "q", side("a", "at").alias("a"), side("at", "b").alias("b"), side("pa", "pc").alias("pa"), side("pc", "pb").alias("pb")))
    all_kept = reduce(DataFrame.unionByName, kept)
    rounded = F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: F.struct(F.round(x["q"]["x"], places).alias("x"), F.round(x["q"]["y"], places).alias("y")))
    done = all_kept.groupBy("_key").agg(rounded.alias("_ring"))
    return rings.select(key).join(done, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.col("_ring").alias("ring"))


def drifted(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem) of artifacts whose bytes aren't those that their source gives; no rows if all is well. Both: (name, content)."""
    both = expected.select("name", F.col("content").alias("_want")).join(actual.select("name", F.col("content").alias("_have")), "name", "full")
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_have") != F.col("_want"), "drifted")
    return both.select("name", problem.alias("problem")).where("problem is not null")
