"""The walking graph: edges of ways, policies, degrees, components, snapping and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import bounded, keep

#: Most edges of a node; penalty of fallback roads and of steps; snapping radii in metres.
MOST_DEGREE, FALLBACK_PENALTY, STEPS_PENALTY = 64, 1.5, 1.5
GPS_RADIUS_M, PLACE_RADIUS_M = 100.0, 150.0
#: Shared folder setting for tables that cut lineage.
ROUNDS = 200


def node_sequences(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways as ordered coordinates; a way that refers to an unknown node is left out.

    refs: (way_id, seq, node_id); nodes: (node_id, lat, lon).
    """
    joined = refs.join(nodes, "node_id", "left")
    per_way = joined.groupBy("way_id").agg(
        F.count("*").alias("n_points"), F.count("lat").alias("found"),
        F.sort_array(F.collect_list(F.struct("seq", "node_id", "lat", "lon"))).alias("points"))
    return per_way.where((F.col("found") == F.col("n_points")) & (F.col("n_points") <= 1000)).drop("found")


def apply_policy(segments: DataFrame, excluded: DataFrame, blocked: DataFrame, fallback: DataFrame, directions: DataFrame) -> DataFrame:
    """Segments (a, b, way_id, fallback, direction, length) after exclusion, blocking and overrides; edge ids in their order.

    The format bounds the policy tables at 20,000 rows each; they are counted before they are broadcast.
    """
    excluded, blocked, fallback, directions = (bounded(t) for t in (excluded, blocked, fallback, directions))
    open_segments = (
        segments.join(excluded, "way_id", "left_anti")
        .join(blocked.select(F.col("node_id").alias("a")), "a", "left_anti")
        .join(blocked.select(F.col("node_id").alias("b")), "b", "left_anti")
        .where((F.col("a") != F.col("b")) & (F.col("length") > 0)))
    marked = open_segments.join(fallback.withColumn("_f", F.lit(True)), "way_id", "left").join(directions.withColumnRenamed("direction", "_d"), "way_id", "left")
    return marked.withColumn("fallback", F.coalesce("fallback", F.lit(False)) | F.coalesce("_f", F.lit(False))).withColumn("direction", F.coalesce("_d", "direction")).drop("_f", "_d")


#: Most points of a way; an edge is numbered by its way's place and its own place in the way.
MOST_POINTS = 1000


def way_edges(ways: DataFrame, excluded: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges between neighbouring nodes of ways: (edge_id, way_id, a, b, ax, ay, bx, by, length, and the ways' other columns).

    ways: (way_id, way_seq, points: array of (node_id, lat, lon), walkable, direction, ...). Excluded, unwalkable and
    impassable ways give none, nor do blocked or equal neighbours and those at one place. A node lies where the first
    segment in order that uses it has it. Edge ids follow the order of ways and, within them, of segments.
    """
    usable = ways.where(F.col("walkable") & F.col("direction").isNotNull()).join(bounded(excluded.select("way_id")), "way_id", "left_anti")
    cut = usable.withColumn("k", F.explode(F.when(F.size("points") >= 2, F.sequence(F.lit(0), F.size("points") - 2))))
    end = lambda d: F.get("points", F.col("k") + d)
    rest = [c for c in ways.columns if c not in ("way_id", "way_seq", "points", "walkable")]
    segments = cut.select((F.col("way_seq") * 1024 + F.col("k")).cast("long").alias("edge_id"), "way_id", *rest, end(0).alias("p"), end(1).alias("q"))
    closed = bounded(blocked.select("node_id"))
    segments = segments.where("p.node_id <> q.node_id").withColumns({"a": F.col("p.node_id"), "b": F.col("q.node_id")})
    segments = keep(segments.join(closed.select(F.col("node_id").alias("a")), "a", "left_anti").join(closed.select(F.col("node_id").alias("b")), "b", "left_anti"))  # read three times
    seen = segments.select(F.explode(F.array(F.struct("p", F.col("edge_id").alias("e"), F.lit(0).alias("k")), F.struct(F.col("q").alias("p"), F.col("edge_id").alias("e"), F.lit(1).alias("k")))).alias("u"))
    first = seen.groupBy(F.col("u.p.node_id").alias("node_id")).agg(F.min_by("u.p", F.struct("u.e", "u.k")).alias("p")).select("node_id", geo.to_x(F.col("p.lon")).alias("x"), geo.to_y(F.col("p.lat")).alias("y"))
    first = keep(first)
    at = lambda n: first.select(F.col("node_id").alias(n), F.col("x").alias(n + "x"), F.col("y").alias(n + "y"))
    placed = segments.drop("p", "q").join(at("a"), "a").join(at("b"), "b").withColumn("length", geo.euclid(*(F.col(c) for c in ("ax", "ay", "bx", "by"))))
    return placed.where("length > 0").select("edge_id", "way_id", "a", "b", "ax", "ay", "bx", "by", "length", *rest)


def skipped_ways(ways: DataFrame, excluded: DataFrame) -> DataFrame:
    """(reason, n_ways) of the ways that give no edges: excluded by the policy, not walkable, or without a direction."""
    marked = ways.join(bounded(excluded.select("way_id").distinct().withColumn("_x", F.lit(True))), "way_id", "left")
    reason = F.when(F.col("_x"), "excluded").when(~F.col("walkable"), "unwalkable").when(F.col("direction").isNull(), "impassable")
    return marked.select("way_id", reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count_distinct("way_id").alias("n_ways"))


def degrees(edges: DataFrame, most: int = MOST_DEGREE) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree")).withColumn("within_limit", F.col("degree") <= most)


def adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, neighbour, edge_id) in both ways, whatever the walking direction."""
    return edges.select(F.col("a").alias("node_id"), F.col("b").alias("neighbour"), "edge_id").unionByName(edges.select(F.col("b").alias("node_id"), F.col("a").alias("neighbour"), "edge_id"))


def components(edges: DataFrame, keep) -> DataFrame:
    """(node_id, component): the least node id that the edges reach, whatever their direction.

    The graph is contracted: in each round a node follows its neighbour with the least hash, if that is less than its own, to the
    end of that short chain; nodes of one end become one, and only arcs between different ones stay. So each round has a fraction of the
    nodes of the one before, and all rounds together cost little more than the first. Afterwards the labels go down the rounds again.
    ``keep`` writes a table and reads it back, so lineage stays short.
    """
    arcs = keep(adjacency(edges).select("node_id", "neighbour").distinct())
    least, rounds = None, []  # of each round: (node, root), and (root, least) with the least id under a root
    for k in range(ROUNDS):
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        ends = keep(arcs.groupBy("node_id").agg(F.least(F.first(order("node_id")), F.min(order("neighbour")))["n"].alias("root")))
        while True:
            on = lambda here, there: ends.select(F.col("node_id").alias(here), F.col("root").alias(there))  # noqa: E731, B023
            step = keep(ends.join(on("root", "second"), "root").join(on("second", "third"), "second").select("node_id", F.col("third").alias("root"), (F.col("third") != F.col("second")).alias("moved")))
            ends = step.select("node_id", "root")
            if step.where("moved").isEmpty():
                break
        known = ends.withColumn("least", F.col("node_id")) if least is None else ends.join(least, "node_id")
        groups = keep(known.groupBy("root").agg(F.min("least").alias("least")))
        rounds.append((ends, groups))
        least = groups.withColumnRenamed("root", "node_id")
        of = lambda name: ends.select(F.col("node_id").alias(name), F.col("root").alias(f"{name}_root"))  # noqa: E731, B023
        met = arcs.join(of("node_id"), "node_id").join(of("neighbour"), "neighbour").where("node_id_root <> neighbour_root")
        arcs = keep(met.select(F.col("node_id_root").alias("node_id"), F.col("neighbour_root").alias("neighbour")).distinct())
        if arcs.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    labels = None
    for ends, groups in rounds[::-1]:
        named = groups.select("root", F.col("least").alias("component"))
        if labels is not None:
            named = groups.join(labels.withColumnRenamed("node_id", "root"), "root", "left").select("root", F.coalesce("component", "least").alias("component"))
        labels = keep(ends.join(named, "root").select("node_id", "component"))
    return labels


def largest_component(labels: DataFrame) -> DataFrame:
    """One row: component, its nodes, number of components, nodes outside it; ties go to the least component."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n_nodes"))
    return sizes.agg(
        F.max_by("component", F.struct(F.col("n_nodes"), -F.col("component"))).alias("component"), F.max("n_nodes").alias("n_nodes"),
        F.count("*").alias("component_count"), (F.sum("n_nodes") - F.max("n_nodes")).alias("dropped_nodes"))


def snap(candidates: DataFrame, radius: Column) -> DataFrame:
    """The best edge of each point, from (point_id, px, py, edge_id, ax, ay, bx, by, fallback) candidates.

    Distance decides, half as much again on fallback edges, but the radius is for the distance itself. The first edge wins ties.
    """
    t, x, y, d = geo.on_segment(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    scored = candidates.withColumns({"t": t, "snap_x": x, "snap_y": y, "distance": d})
    scored = scored.where(F.col("distance") <= radius).withColumn("cost", F.col("distance") * F.when(F.col("fallback"), FALLBACK_PENALTY).otherwise(1.0))
    best = F.min_by(F.struct("edge_id", "t", "snap_x", "snap_y", "distance", "cost"), F.struct("cost", "edge_id"))
    return scored.groupBy("point_id").agg(best.alias("s")).select("point_id", "s.*")


#: Fixed value: closer than this to an end or to another point (as a share of the edge) is the same place.
SAME_T = 1e-9


#: Most cuts of an edge that virtual nodes can be named for.
MOST_CUTS = 1 << 20


def split_edges(edges: DataFrame, snaps: DataFrame) -> DataFrame:
    """Edges cut at snapped places: (edge_id, piece, from_t, to_t, a, b, length, and the edges' other columns).

    Cuts within SAME_T of an end use that end; a cut within SAME_T of the last one kept is that one. New nodes are negative.
    """
    inner = snaps.where((F.col("t") > SAME_T) & (F.col("t") < 1 - SAME_T)).select("edge_id", "t")
    nothing = F.array(F.lit(0.0))
    apart = lambda kept, t: F.when(t - F.element_at(kept, -1) > SAME_T, F.concat(kept, F.array(t))).otherwise(kept)
    per_edge = inner.groupBy("edge_id").agg(F.aggregate(F.sort_array(F.collect_list("t")), nothing, apart).alias("ts"))
    base = edges.join(per_edge, "edge_id", "left").withColumn("ts", F.concat(F.coalesce("ts", nothing), F.array(F.lit(1.0))))
    rest = [c for c in edges.columns if c not in ("edge_id", "a", "b", "length")]
    pieces = base.select("edge_id", "a", "b", "length", *rest, "ts", F.posexplode(F.slice("ts", 1, F.size("ts") - 1)).alias("piece", "from_t"))
    to_t = F.get("ts", F.col("piece") + 1)
    # A virtual node is named by its edge and place on it: negative, and the same in every run.
    virtual = lambda k: F.when(F.size("ts") <= MOST_CUTS, -(F.col("edge_id") * MOST_CUTS + k)).otherwise(F.raise_error(F.lit("too many cuts of one edge")).cast("long"))
    return pieces.select(
        "edge_id", "piece", "from_t", to_t.alias("to_t"), F.when(F.col("piece") == 0, F.col("a")).otherwise(virtual(F.col("piece"))).alias("a"),
        F.when(F.col("piece") == F.size("ts") - 2, F.col("b")).otherwise(virtual(F.col("piece") + 1)).alias("b"), (F.col("length") * (to_t - F.col("from_t"))).alias("length"), *rest)
