"""Analytics over the ordered segments of a route: ribbons, styles, turn-by-turn steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

#: Shortest usable segment, gap that starts a new step, turn that does, jitter and spike lengths and angles.
LEAST_M, GAP_M, TURN_DEG, JITTER_M, SPIKE_M, SPIKE_DEG, RETURN_DEG = 0.5, 10.0, 45.0, 8.0, 15.0, 135.0, 25.0
#: Instructions by kind of step.
INSTRUCTIONS = {"straight": "계속 직진", "slight-left": "왼쪽 방향으로 완만하게 이동", "slight-right": "오른쪽 방향으로 완만하게 이동", "left": "왼쪽으로 돌아 이동", "right": "오른쪽으로 돌아 이동", "uturn-left": "왼쪽으로 크게 돌아 이동", "uturn-right": "오른쪽으로 크게 돌아 이동", "steps": "계단 이용"}


def segment_kind() -> Column:
    """connector, shade or sun, of a segment (connector, covered, shade)."""
    return F.when(F.col("connector"), "connector").when(F.col("covered") | (F.col("shade") >= 0.5), "shade").otherwise("sun")


def ribbon(segments: DataFrame, by: str = "route_id") -> DataFrame:
    """Runs of one kind along each route: (by, run, kind, meters, percent). Segments without length are left out first."""
    order = Window.partitionBy(by).orderBy("seq")
    kinds = segments.where(F.col("meters") > 0).withColumn("kind", segment_kind())
    starts = kinds.withColumn("new", F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(order) - 1).groupBy(by, "run", "kind").agg(F.sum("meters").alias("meters"))
    return runs.withColumn("percent", F.col("meters") * 100 / F.sum("meters").over(Window.partitionBy(by)))


def fit_bounds(points: DataFrame, by: str = "route_id") -> DataFrame:
    return points.groupBy(by).agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


def continuity(segments: DataFrame, by: str = "route_id") -> DataFrame:
    """How many segments of each route don't begin where the one before ended."""
    order = Window.partitionBy(by).orderBy("seq")
    broken = (F.lag("to_lat").over(order) != F.col("from_lat")) | (F.lag("to_lon").over(order) != F.col("from_lon"))
    return segments.withColumn("broken", F.coalesce(broken, F.lit(False)).cast("long")).groupBy(by).agg(F.sum("broken").alias("breaks"))


def measured(segments: DataFrame) -> DataFrame:
    """Adds length and bearing, and drops what is too short or not finite; both are plain columns, so this part stays in Spark."""
    ends = [F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")]
    out = segments.withColumn("meters", geo.haversine(*ends)).withColumn("bearing", geo.bearing(*ends))
    finite = F.forall(F.array(*ends), lambda x: F.abs(x) < float("inf"))  # NaN is greater than infinity here
    return out.where(finite & (F.col("meters") >= LEAST_M))


def meaning() -> Column:
    """connector, steps or walk, of a segment."""
    return F.when(F.col("connector"), "connector").when(F.col("steps"), "steps").otherwise("walk")


#: What a fold over segments carries: the steps done, and the one that goes on.
_STEP = "struct<kind:string,meaning:string,distance_m:double,shaded:double,has_steps:boolean,first:double,bearing:double,to_lat:double,to_lon:double>"


def _next(carried: Column, r: Column) -> Column:
    """One segment more: it belongs to the open step, or it closes that and opens its own.

    The bearing that a turn is measured from is that of the segment before, but jitter doesn't move it.
    """
    last, turned = carried["open"], lambda a, b: F.abs(geo.turn_delta(a, b))
    turn, walk, same = turned(last["bearing"], r["bearing"]), r["meaning"] == "walk", r["meaning"] == last["meaning"]
    follows = r["follows"]
    known = follows.isNotNull()
    returns = known & (turned(last["bearing"], follows) < RETURN_DEG)
    spike = (r["meters"] <= SPIKE_M) & (turn >= SPIKE_DEG) & known & (turned(r["bearing"], follows) >= SPIKE_DEG)
    jitter = F.coalesce(same & returns & ((r["meters"] < JITTER_M) | spike), F.lit(False))
    gap = geo.haversine(last["to_lat"], last["to_lon"], r["from_lat"], r["from_lon"]) > GAP_M
    goes_on = ~gap & same & ~(walk & ~jitter & (turn >= TURN_DEG))
    turns = walk & ~gap & (last["meaning"] != "connector")
    kind = F.when(turns, geo.turn_kind(last["bearing"], r["bearing"])).when(walk, "depart").otherwise(r["meaning"])
    shaded = r["meters"] * r["effective"]
    longer = F.struct(last["kind"], last["meaning"], (last["distance_m"] + r["meters"]).alias("distance_m"), (last["shaded"] + shaded).alias("shaded"), (last["has_steps"] | r["steps"]).alias("has_steps"), last["first"], F.when(jitter, last["bearing"]).otherwise(r["bearing"]).alias("bearing"), r["to_lat"], r["to_lon"])
    own = F.struct(kind.alias("kind"), r["meaning"], r["meters"], shaded, r["steps"], r["bearing"], r["bearing"], r["to_lat"], r["to_lon"])
    opened = F.struct(F.concat(carried["done"], F.array(last)).alias("done"), own.cast(_STEP).alias("open"))
    return F.when(goes_on, F.struct(carried["done"].alias("done"), longer.cast(_STEP).alias("open"))).otherwise(opened)


def turn_by_turn(segments: DataFrame) -> DataFrame:
    """Steps of each route (route_id, seq, from/to, shade, covered, steps, connector, goal_name), with a last one on arrival.

    The segments of a route are one array, of 2,000 at most by the limit on routes, and the steps a fold over it inside Spark.
    Routes without a usable segment have no steps.
    """
    effective = F.when(F.col("covered"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("shade"))))
    order = Window.partitionBy("route_id").orderBy("seq")
    rows = measured(segments).withColumns({"effective": effective, "meaning": meaning()})
    follows = F.when(F.lead("meaning").over(order) == F.col("meaning"), F.lead("bearing").over(order))
    item = F.struct("seq", "meaning", "bearing", "meters", "effective", "steps", "follows", "from_lat", "from_lon", "to_lat", "to_lon")
    routes = rows.withColumn("follows", follows).groupBy("route_id").agg(F.sort_array(F.collect_list(item)).alias("s"), F.min_by("goal_name", "seq").alias("goal_name"))
    r = F.get("s", F.lit(0))
    begun = F.struct(F.when(r["meaning"] == "walk", "depart").otherwise(r["meaning"]), r["meaning"], r["meters"], r["meters"] * r["effective"], r["steps"], r["bearing"], r["bearing"], r["to_lat"], r["to_lon"]).cast(_STEP)
    start = F.struct(F.array().cast(f"array<{_STEP}>").alias("done"), begun.alias("open"))
    folded = F.aggregate(F.slice("s", 2, F.size("s")), start, _next, lambda c: F.concat(c["done"], F.array(c["open"])))
    steps = routes.select("route_id", "goal_name", folded.alias("steps"))
    shade = F.coalesce(F.col("shaded") / F.nullif(F.col("distance_m"), F.lit(0.0)), F.lit(0.0))
    each = steps.select("route_id", F.size("steps").alias("n"), F.posexplode("steps").alias("step", "s")).select("route_id", "n", "step", "s.*").withColumn("shade_ratio", shade)
    first, final = F.col("step") == 0, F.col("step") == F.col("n") - 1
    # The sentences below.
    to_network = F.when(first, "보행로까지 이동").when(final, "도착지까지 이동").otherwise("연결 구간 이동")
    leaving = F.concat(geo.cardinal(F.col("first")), F.lit(" 방향으로 "), F.when(first, "출발").otherwise("이동"))
    text = F.when(F.col("kind") == "connector", to_network).when(F.col("kind") == "depart", leaving).otherwise(F.create_map(*(F.lit(x) for kv in INSTRUCTIONS.items() for x in kv))[F.col("kind")])
    exposed = F.when(F.col("meaning") == "connector", "connector").when(F.col("shade_ratio") >= 0.55, "shade").when(F.col("shade_ratio") <= 0.35, "sun").otherwise("mixed")
    walked = each.select("route_id", "step", "kind", text.alias("instruction"), "distance_m", "shade_ratio", exposed.alias("exposure"), "has_steps", "to_lat", "to_lon")
    end = F.element_at("steps", -1)
    arrived = steps.select("route_id", F.size("steps").alias("step"), F.lit("arrive").alias("kind"), F.concat("goal_name", F.lit("에 도착")).alias("instruction"), F.lit(0.0).alias("distance_m"), F.lit(0.0).alias("shade_ratio"), F.lit("mixed").alias("exposure"), F.lit(False).alias("has_steps"), end["to_lat"].alias("to_lat"), end["to_lon"].alias("to_lon"))
    return walked.unionByName(arrived)
