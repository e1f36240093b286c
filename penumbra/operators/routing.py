"""Routes for many requests at once: search, summary, access legs, limits and comparison."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, rules
from .graph import FALLBACK_PENALTY, STEPS_PENALTY

#: Walking speed in metres a second, longest route in metres, shortest access leg in metres.
SPEED, LONGEST_M, LEAST_ACCESS_M = 1.25, 3000.0, 0.5
PATH_SCHEMA = "request_id long, mode string, seq int, edge_id long, from_node long, to_node long, cost double"


def walk_seconds(length: Column, steps: Column) -> Column:
    return length / SPEED * F.when(steps, STEPS_PENALTY).otherwise(1.0)


def edge_cost(length: Column, steps: Column, fallback: Column, shade: Column, weight: Column) -> Column:
    seconds = walk_seconds(length, steps)
    return seconds * F.when(fallback, FALLBACK_PENALTY).otherwise(1.0) + weight * seconds * (1 - shade)


def arcs(edges: DataFrame, weight: Column) -> DataFrame:
    """Directed arcs (src, dst, edge_id, cost) of edges with direction both, forward or backward."""
    cost = edge_cost(*(F.col(c) for c in ("length", "steps", "fallback", "shade")), weight)
    priced = edges.withColumn("cost", cost)
    onward = priced.where("direction in ('both', 'forward')").select(F.col("a").alias("src"), F.col("b").alias("dst"), "edge_id", "cost")
    back = priced.where("direction in ('both', 'backward')").select(F.col("b").alias("src"), F.col("a").alias("dst"), "edge_id", "cost")
    return onward.unionByName(back)


def _search(arcs_of: dict, place: dict, start: int, goal: int):
    """Least-cost path by best-first search; the straight line at walking speed never overestimates. None if unreachable."""
    if start == goal:
        return 0.0, []
    gx, gy = place[goal]
    ahead = lambda n: math.hypot(place[n][0] - gx, place[n][1] - gy) / SPEED
    best, came, done = {start: 0.0}, {}, set()
    queue = [(ahead(start), start)]
    while queue:
        _, node = heapq.heappop(queue)
        if node == goal:
            path = []
            while node != start:
                before, edge = came[node]
                path.append((edge, before, node))
                node = before
            return best[goal], path[::-1]
        if node in done:
            continue
        done.add(node)
        for to, edge, cost in arcs_of.get(node, ()):
            reached = best[node] + cost
            if reached < best.get(to, math.inf):
                best[to], came[to] = reached, (node, edge)
                heapq.heappush(queue, (reached + ahead(to), to))
    return None


def _route_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """All searches of one request, mode by mode: its corridor's edges once each, and one row for start and goal."""
    ends = frame[frame["kind"] == "request"]
    links = frame[frame["kind"] == "arc"].sort_values(["edge_id", "src"], kind="stable")
    place, out = {}, []
    for src, dst, sx, sy, dx, dy in links[["src", "dst", "sx", "sy", "dx", "dy"]].itertuples(index=False):
        place[src], place[dst] = (sx, sy), (dx, dy)
    for mode in rules.MODES:
        arcs_of = {}
        for src, dst, edge, cost, both in links[["src", "dst", "edge_id", mode, "both"]].itertuples(index=False):
            arcs_of.setdefault(src, []).append((dst, edge, cost))
            if both:
                arcs_of.setdefault(dst, []).append((src, edge, cost))
        for start, goal in ends[["src", "dst"]].itertuples(index=False):
            found = _search(arcs_of, place, start, goal) if start in place and goal in place else None
            if found:
                out += [(key[0], mode, k, edge, a, b, found[0]) for k, (edge, a, b) in enumerate(found[1])]
    return pd.DataFrame(out, columns=["request_id", "mode", "seq", "edge_id", "from_node", "to_node", "cost"])


def _cell(c: str, cell_m: float) -> Column:
    return F.floor(F.col(c) / cell_m).cast("long")


def corridor_cells(requests: DataFrame, cell_m: float, reach_m: float) -> DataFrame:
    """requests (sx, sy, gx, gy) once for each grid cell (cx, cy) of the square that a route of ``reach_m`` can't leave; none if the ends are further apart."""
    # Such a route stays within half of what it may be longer than the straight line.
    slack = (reach_m - geo.euclid(F.col("sx"), F.col("sy"), F.col("gx"), F.col("gy"))) / 2 + cell_m
    span = lambda f, a, b, s: F.floor((f(F.col(a), F.col(b)) + s) / cell_m).cast("long")
    return requests.where(slack > 0).withColumn("cx", F.explode(F.sequence(span(F.least, "sx", "gx", -slack), span(F.greatest, "sx", "gx", slack)))).withColumn("cy", F.explode(F.sequence(span(F.least, "sy", "gy", -slack), span(F.greatest, "sy", "gy", slack))))


def corridor_sizes(requests: DataFrame, edges: DataFrame, nodes: DataFrame, cell_m: float = 600.0, reach_m: float = LONGEST_M) -> DataFrame:
    """(request_id, n_edges) of the corridor of each request whose ends are near enough; the edges are counted by cell before requests meet them."""
    counts = edges.select("a").join(nodes.select(F.col("id").alias("a"), "x", "y"), "a").groupBy(_cell("x", cell_m).alias("cx"), _cell("y", cell_m).alias("cy")).agg(F.count("*").alias("n"))
    cells = corridor_cells(requests.select("request_id", "sx", "sy", "gx", "gy"), cell_m, reach_m)
    return cells.join(counts, ["cx", "cy"], "left").groupBy("request_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"))


def route_paths(requests: DataFrame, edges: DataFrame, nodes: DataFrame, cell_m: float = 600.0, reach_m: float = LONGEST_M, extra: DataFrame | None = None) -> DataFrame:
    """Paths of every request in every mode, as ordered edges.

    Each request gets only its corridor: the edges with an end in the square around its two ends that
    a route of ``reach_m`` can't leave. Corridors are found by joining grid cells, and an edge is sent once for
    all modes and both directions. A task holds one corridor, which ``corridor_sizes`` tells beforehand.
    ``extra`` has directed arcs of single requests: (request_id, src, dst, edge_id, length, steps, fallback, shade, sx, sy, dx, dy).
    requests: (request_id, start, goal, sx, sy, gx, gy); edges: (edge_id, a, b, length, steps, fallback, direction, shade); nodes: (id, x, y).
    """
    placed = edges.select("edge_id", "a", "b", "length", "steps", "fallback", "direction", "shade").join(nodes.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")).hint("merge"), "a").join(nodes.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")).hint("merge"), "b")
    cells = placed.withColumns({"cx": _cell("ax", cell_m), "cy": _cell("ay", cell_m)})
    near = corridor_cells(requests, cell_m, reach_m).select("request_id", "cx", "cy").join(cells, ["cx", "cy"])
    costs = [edge_cost(*(F.col(c) for c in ("length", "steps", "fallback", "shade")), F.lit(w)).alias(m) for m, (w, _) in rules.MODES.items()]
    back = F.col("direction") == "backward"
    end = lambda there, here, name: F.when(back, F.col(there)).otherwise(F.col(here)).alias(name)
    links = near.where("direction in ('both', 'forward', 'backward')").select(
        "request_id", F.lit("arc").alias("kind"), end("b", "a", "src"), end("a", "b", "dst"), "edge_id", (F.col("direction") == "both").alias("both"), *costs, end("bx", "ax", "sx"), end("by", "ay", "sy"), end("ax", "bx", "dx"), end("ay", "by", "dy"))
    if extra is not None:
        links = links.unionByName(extra.select("request_id", F.lit("arc").alias("kind"), "src", "dst", "edge_id", F.lit(False).alias("both"), *costs, "sx", "sy", "dx", "dy"))
    zero = F.lit(0.0)
    asked = requests.select("request_id", F.lit("request").alias("kind"), F.col("start").alias("src"), F.col("goal").alias("dst"), F.lit(0).cast("long").alias("edge_id"), F.lit(False).alias("both"), *(zero.alias(m) for m in rules.MODES), *(zero.alias(c) for c in ("sx", "sy", "dx", "dy")))
    return links.unionByName(asked).groupBy("request_id").applyInPandas(_route_group, PATH_SCHEMA)


def shortest_costs(sources: DataFrame, arc_table: DataFrame, keep, rounds: int = 10_000) -> DataFrame:
    """(source, node, cost) of everything reachable, by joins alone: only improved nodes go on to the next round.

    Used where one source has many goals, and to check the search. ``keep`` writes a table and reads it back.
    """
    best = keep(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")))
    frontier = best
    for _ in range(rounds):
        tried = frontier.join(arc_table, frontier["node"] == arc_table["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.min(frontier["cost"] + arc_table["cost"]).alias("new"))
        merged = keep(best.join(tried, ["source", "node"], "full").select("source", "node", F.least(F.col("cost"), F.col("new")).alias("cost"), (F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))).alias("better")))
        best, frontier = merged.drop("better"), merged.where("better").drop("better")
        if frontier.isEmpty():
            break
    return best


def shade_of(sun: Column, time: Column) -> Column:
    """Share of the walking time that isn't in the sun, to three places; 0 without time."""
    return F.coalesce(F.floor((1 - sun / F.nullif(time, F.lit(0.0))) * 1000 + 0.5) / 1000, F.lit(0.0))


def summaries(path_edges: DataFrame) -> DataFrame:
    """One row for each route: seconds, metres, seconds in the sun, shade ratio to three places, and its path key.

    path_edges: (request_id, mode, seq, edge_id, length, steps, shade). Seconds have no safety penalty.
    """
    seconds = walk_seconds(F.col("length"), F.col("steps"))
    keyed = path_edges.withColumn("sec", seconds)
    total = keyed.groupBy("request_id", "mode").agg(
        F.sum("sec").alias("time_raw"), F.sum("length").alias("length_raw"), F.sum(F.col("sec") * (1 - F.col("shade"))).alias("sun_raw"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "edge_id"))), lambda x: x["edge_id"].cast("string")), ":").alias("path_key"))
    return total.select(
        "request_id", "mode", geo.half_up(F.col("time_raw")).alias("time_sec"), geo.half_up(F.col("length_raw")).alias("length_m"), geo.half_up(F.col("sun_raw")).alias("sun_sec"),
        shade_of(F.col("sun_raw"), F.col("time_raw")).alias("shade_ratio"), "path_key")


def with_access(routes: DataFrame, first_m: Column, last_m: Column) -> DataFrame:
    """Rounded summaries with the straight legs to and from the network, in full sun, rounded once more. Legs under half a metre are none."""
    leg = lambda d: F.when(d >= LEAST_ACCESS_M, d).otherwise(0.0)
    metres = leg(first_m) + leg(last_m)
    time, sun = F.col("time_sec") + metres / SPEED, F.col("sun_sec") + metres / SPEED
    return routes.withColumns({"time_sec": geo.half_up(time), "length_m": geo.half_up(F.col("length_m") + metres), "sun_sec": geo.half_up(sun), "shade_ratio": shade_of(sun, time)})


def clamp_to_shortest(routes: DataFrame, most_m: float = LONGEST_M) -> DataFrame:
    """Routes of at most ``most_m``: longer ones take the metrics and path of their request's shortest route; if that is too long, status says so."""
    w = Window.partitionBy("request_id")
    base = lambda c: F.max(F.when(F.col("mode") == "shortest", F.col(c))).over(w)
    fields = ["time_sec", "length_m", "sun_sec", "shade_ratio", "path_key"]
    with_base = routes.withColumns({f"_{c}": base(c) for c in fields})
    long = F.col("length_m") > most_m
    return with_base.select("request_id", "mode", *(F.when(long, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields), F.when(F.col("_length_m") > most_m, "ROUTE_TOO_LONG").otherwise("OK").alias("status"))


def resolve_places(requests: DataFrame, places: DataFrame) -> DataFrame:
    """Requests (request_id, start, goal, ...) with their places' coordinates; those of places (id, lat, lon) that aren't known stay, with nulls."""
    at = lambda name: places.select(F.col("id").alias(name), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
    return requests.join(at("start"), "start", "left").join(at("goal"), "goal", "left")


def request_status(requests: DataFrame, start_inside: Column, goal_inside: Column) -> DataFrame:
    """Requests with the first error that stops them, or OK: an unknown place, same place, outside the area, or too far apart."""
    unknown = F.col("start_lat").isNull() | F.col("start_lon").isNull() | F.col("goal_lat").isNull() | F.col("goal_lon").isNull()
    far = geo.haversine(*(F.col(c) for c in ("start_lat", "start_lon", "goal_lat", "goal_lon")))
    return requests.withColumn("distance_m", far).withColumn("status", F.when(unknown, "UNKNOWN_PLACE").when(F.col("start") == F.col("goal"), "SAME_PLACE").when(~start_inside | ~goal_inside, "OUTSIDE_SEOUL").when(F.col("distance_m") > LONGEST_M, "ROUTE_TOO_LONG").otherwise("OK"))


def bundles(routes: DataFrame) -> DataFrame:
    """One row for each request with its routes as an array in the order of the modes."""
    order = F.create_map(*(F.lit(x) for k, m in enumerate(rules.MODES) for x in (m, k)))
    label = F.create_map(*(F.lit(x) for m, (_, text) in rules.MODES.items() for x in (m, text)))
    item = F.struct(order[F.col("mode")].alias("rank"), "mode", label[F.col("mode")].alias("label"), "path_key", "time_sec", "length_m", "sun_sec", "shade_ratio")
    return routes.groupBy("request_id").agg(F.sort_array(F.collect_list(item)).alias("routes"))
