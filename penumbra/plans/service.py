"""Whole routes between places that need not lie on the network, for a table of requests at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph, guards, overlay, routing, shade
from ..operators.spatial import points_near_segments
from ..operators.tiles import BUFFER_DEG
from ..session import bounded, keep, ship_package
from ..sources import tile_store

#: Ids of a request's own two nodes on the network.
START, GOAL = -1, -2
#: Legs of one request, of which there is one for each component near both ends, are numbered below this; the limit on components is less.
MOST_LEGS = 1024


def legs(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Where both ends of each request meet the network, once for each component that both reach.

    requests: (request_id, sx, sy, gx, gy, gps); edges: (edge_id, a, b, ax, ay, bx, by, fallback, component, ...).
    """
    end = lambda which, x, y: requests.select("request_id", F.lit(which).alias("which"), F.col(x).alias("px"), F.col(y).alias("py"), F.when(F.col("gps"), graph.GPS_RADIUS_M).otherwise(graph.PLACE_RADIUS_M).alias("radius"))
    points = end("start", "sx", "sy").unionByName(end("goal", "gx", "gy"))
    near = points_near_segments(points, edges.select("edge_id", "ax", "ay", "bx", "by", "fallback", "component"), graph.PLACE_RADIUS_M, graph.PLACE_RADIUS_M)
    t, x, y, d = geo.on_segment(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    scored = near.withColumns({"t": t, "x": x, "y": y, "distance": d}).where(F.col("distance") <= F.col("radius"))
    cost = F.col("distance") * F.when(F.col("fallback"), graph.FALLBACK_PENALTY).otherwise(1.0)
    best = scored.groupBy("request_id", "which", "component").agg(F.min_by(F.struct("edge_id", "t", "x", "y", "distance"), F.struct(cost, "edge_id")).alias("s"))
    side = lambda which: best.where(F.col("which") == which).select("request_id", "component", F.col("s").alias(which))
    both = side("start").join(side("goal"), ["request_id", "component"])
    k = F.row_number().over(Window.partitionBy("request_id").orderBy("component"))  # no more than components of the graph
    return both.withColumn("leg_id", F.col("request_id") * MOST_LEGS + k)


def access_arcs(both: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed pieces of the edges on which a request starts and ends, and between the two if they share one."""
    e = edges.select("edge_id", "a", "b", "ax", "ay", "bx", "by", "length", "steps", "fallback", "direction", "covered")

    def pieces(end, node, onward_from_point):
        """The two parts of the edge under one end, in the direction of travel."""
        j = both.select("leg_id", F.col(f"{end}.*")).join(e, "edge_id")
        part = lambda to, x, y, share, allowed, k: j.where(F.col("direction").isin("both", allowed)).select(
            F.col("leg_id").alias("request_id"), *((F.lit(node).alias("src"), F.col(to).alias("dst")) if onward_from_point else (F.col(to).alias("src"), F.lit(node).alias("dst"))),
            (-(F.col("edge_id") * 8 + k)).alias("edge_id"), (F.col("length") * share).alias("length"), "steps", "fallback", "covered",
            *((F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(x).alias("dx"), F.col(y).alias("dy")) if onward_from_point else (F.col(x).alias("sx"), F.col(y).alias("sy"), F.col("x").alias("dx"), F.col("y").alias("dy"))))
        t = F.col("t")
        if onward_from_point:
            return part("a", "ax", "ay", t, "backward", 1).unionByName(part("b", "bx", "by", 1 - t, "forward", 2))
        return part("a", "ax", "ay", t, "forward", 3).unionByName(part("b", "bx", "by", 1 - t, "backward", 4))

    shared = both.where("start.edge_id = goal.edge_id").select("leg_id", "start", "goal", F.col("start.edge_id").alias("edge_id")).join(e, "edge_id")
    ahead = F.col("goal.t") >= F.col("start.t")
    direct = shared.where(F.col("direction").isin("both") | (ahead & (F.col("direction") == "forward")) | (~ahead & (F.col("direction") == "backward"))).select(
        F.col("leg_id").alias("request_id"), F.lit(START).alias("src"), F.lit(GOAL).alias("dst"), (-(F.col("edge_id") * 8 + 5)).alias("edge_id"), (F.col("length") * F.abs(F.col("goal.t") - F.col("start.t"))).alias("length"), "steps", "fallback", "covered",
        F.col("start.x").alias("sx"), F.col("start.y").alias("sy"), F.col("goal.x").alias("dx"), F.col("goal.y").alias("dy"))
    out = pieces("start", START, True).unionByName(pieces("goal", GOAL, False)).unionByName(direct)
    return out.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")})


def lat_lon_segments(taken: DataFrame, edges: DataFrame, own: DataFrame, access: DataFrame) -> DataFrame:
    """(leg_id, mode, seq, from_lat, .., to_lon, shade, covered, steps, connector) of the taken paths, with the straight legs at both ends.

    taken: ordered edges of paths; own: directed pieces of single legs; access: (leg_id, first_m, last_m, and the ends' coordinates).
    """
    ahead = F.col("from_node") == F.col("a")
    way = lambda p, q: F.when(ahead, F.col(p)).otherwise(F.col(q))
    flags = ["shade", "covered", "steps"]
    on_edges = taken.join(edges.select("edge_id", "a", "ax", "ay", "bx", "by", "length", *flags), "edge_id").select("request_id", "mode", "seq", way("ax", "bx").alias("fx"), way("ay", "by").alias("fy"), way("bx", "ax").alias("tx"), way("by", "ay").alias("ty"), "length", *flags)
    on_pieces = taken.join(own, ["request_id", "edge_id"]).select("request_id", "mode", "seq", F.col("sx").alias("fx"), F.col("sy").alias("fy"), F.col("dx").alias("tx"), F.col("dy").alias("ty"), "length", *flags)
    walked = on_edges.unionByName(on_pieces).where("length > 0").select(F.col("request_id").alias("leg_id"), "mode", "seq", "fx", "fy", "tx", "ty", *flags, F.lit(False).alias("connector"))
    modes = taken.groupBy(F.col("request_id").alias("leg_id"), "mode").agg((F.max("seq") + 1).alias("after"))
    ends = modes.join(access, "leg_id")
    straight = lambda metres, seq, *xy: ends.where(F.col(metres) >= routing.LEAST_ACCESS_M).select("leg_id", "mode", seq.cast("int").alias("seq"), *(F.col(c).alias(n) for c, n in zip(xy, ("fx", "fy", "tx", "ty"))), F.lit(0.0).alias("shade"), F.lit(False).alias("covered"), F.lit(False).alias("steps"), F.lit(True).alias("connector"))
    every = walked.unionByName(straight("first_m", F.lit(-1), "px", "py", "x0", "y0")).unionByName(straight("last_m", F.col("after"), "x1", "y1", "qx", "qy"))
    degrees = {"from_lat": geo.to_lat(F.col("fy")), "from_lon": geo.to_lon(F.col("fx")), "to_lat": geo.to_lat(F.col("ty")), "to_lon": geo.to_lon(F.col("tx"))}
    return every.select("leg_id", "mode", "seq", *(c.alias(n) for n, c in degrees.items()), *flags, "connector")


def graph_sizes(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, n_nodes, n_edges, degree, n_components, crowded) of the graph in the tiles of each request (request_id, cells).

    Cells are counted once; requests only add up what their cells have. A request without any edge has no row. Edges may say
    whether their shade meets too many shadows (crowded).
    """
    crowded = F.col("crowded") if "crowded" in edges.columns else F.lit(False)
    ends = F.explode(F.array(*(F.struct(overlay.cell_of(F.col(f"{n}x"), F.col(f"{n}y")).alias("cell"), F.col(n).alias("node"), F.lit(n == "a").alias("owns")) for n in "ab")))
    nodes = edges.select(ends.alias("e"), "component", crowded.alias("crowded")).select("e.*", "component", "crowded").groupBy("cell", "node").agg(F.count("*").alias("degree"), F.count_if("owns").alias("owned"), F.min("component").alias("component"), F.bool_or("crowded").alias("crowded"))
    nodes = keep(nodes)
    cells = nodes.groupBy("cell").agg(F.count("*").alias("n_nodes"), F.sum("owned").alias("n_edges"), F.max("degree").alias("degree"), F.bool_or("crowded").alias("crowded"))
    spread = requests.select("request_id", F.explode("cells").alias("cell"))
    sums = spread.join(cells, "cell").groupBy("request_id").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"), F.max("degree").alias("degree"), F.bool_or("crowded").alias("crowded"))
    parts = spread.join(nodes.select("cell", "component").distinct(), "cell").groupBy("request_id").agg(F.count_distinct("component").alias("n_components"))
    return sums.join(parts, "request_id")


def plan_routes(requests: DataFrame, edges: DataFrame, piece_shade) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(routes, status, segments): a row for each routed request and mode, the outcome of each request, and the routes' ordered segments.

    Of the components that both ends reach, the one with the least length (steps and fallback roads
    weighed) and access counts; if both ends meet that one in the same point, they are near enough already. A route may use what lies in
    the tiles around its request's ends, and is the best there at any length. ``piece_shade`` gives (id, shade_ratio) for
    pieces of edges; all edges come with their shade. Statuses, the first that holds: the request's own (``status``, if there is
    one and it isn't OK), ROUTE_TOO_LONG (ends over 3 km apart), EMPTY_GRAPH (no edge in its tiles), ROUTE_DATA_TOO_COMPLEX (nodes, edges,
    degree or components of its tiles, shadows near one of their edges, or segments of a route beyond the limits), SNAP_FAILED
    (no component that both ends reach, or no way on it), ALREADY_NEAR_GOAL, ROUTE_TOO_LONG (the way itself), OK. One request never
    fails the others; graphs over the limits are known from counts and not searched.
    """
    ship_package(requests.sparkSession)
    own_status = F.col("status") if "status" in requests.columns else F.lit("OK")
    away = geo.haversine(geo.to_lat(F.col("sy")), geo.to_lon(F.col("sx")), geo.to_lat(F.col("gy")), geo.to_lon(F.col("gx"))) > routing.LONGEST_M
    early = F.when(own_status != "OK", own_status).when(away, "ROUTE_TOO_LONG")
    requests = keep(requests.withColumn("early", early))
    possible = requests.where("early is null").withColumn("cells", overlay.cells_around(*(F.col(c) for c in ("sx", "sy", "gx", "gy"))))
    sizes = keep(graph_sizes(possible, edges))
    limit = lambda c, name: F.col(c) > guards.LIMITS[name]
    heavy = sizes.where(limit("n_nodes", "graph_nodes") | limit("n_edges", "graph_edges") | limit("degree", "graph_node_degree") | limit("n_components", "graph_components") | F.col("crowded"))
    searched = possible.join(sizes, "request_id", "left_semi").join(heavy, "request_id", "left_anti")
    both = keep(legs(searched, edges))
    arcs = access_arcs(both, edges)
    named = arcs.withColumn("id", F.concat_ws(":", "request_id", "edge_id"))
    ratio = piece_shade(named.where("not covered").select("id", F.col("sx").alias("ax"), F.col("sy").alias("ay"), F.col("dx").alias("bx"), F.col("dy").alias("by"), "length"))
    arcs = named.join(ratio, "id", "left").withColumn("shade", F.when(F.col("covered"), 1.0).otherwise(F.coalesce("shade_ratio", F.lit(0.0)))).drop("id", "shade_ratio")
    arcs = keep(arcs)  # both tables are read many times
    same_place = (F.col("start.edge_id") == F.col("goal.edge_id")) & (F.abs(F.col("start.t") - F.col("goal.t")) <= graph.SAME_T)
    cost = overlay.costs_of(*(F.col(c) for c in ("length", "steps", "fallback", "shade")))
    side = lambda which, node, x, y: F.collect_list(F.when(which, F.struct(overlay.cell_of(F.col(x), F.col(y)).alias("cell"), F.col(node).alias("node"), F.col("edge_id").alias("edge"), cost.alias("cost"))))
    from_start, to_goal = F.col("src") == START, F.col("dst") == GOAL
    own_ends = arcs.groupBy("request_id").agg(
        side(from_start & ~to_goal, "dst", "dx", "dy").alias("sources"), side(to_goal & ~from_start, "src", "sx", "sy").alias("targets"),
        F.collect_list(F.when(from_start & to_goal, F.struct(F.col("edge_id").alias("edge"), cost.alias("cost")))).alias("directs"))
    asked = both.where(~same_place).select("request_id", "leg_id", F.lit(START).cast("long").alias("start"), F.lit(GOAL).cast("long").alias("goal"), F.col("start.x").alias("sx"), F.col("start.y").alias("sy"), F.col("goal.x").alias("gx"), F.col("goal.y").alias("gy"))
    asked = keep(asked.join(possible.select("request_id", "cells"), "request_id").drop("request_id").withColumnRenamed("leg_id", "request_id").join(own_ends, "request_id"))
    cells = keep(overlay.pack(edges).join(bounded(overlay.cells_met(asked)), "cell", "left_semi"))  # shortcuts take far longer than packing
    paths = keep(overlay.routes(asked, cells, keep(overlay.shortcuts(cells))))  # searched once for routes, status and segments
    ends = requests.select("request_id", F.col("sx").alias("px"), F.col("sy").alias("py"), F.col("gx").alias("qx"), F.col("gy").alias("qy"))
    access = both.join(ends, "request_id").select("leg_id", F.col("request_id").alias("asked_id"), F.col("start.distance").alias("first_m"), F.col("goal.distance").alias("last_m"), F.col("start.x").alias("x0"), F.col("start.y").alias("y0"), F.col("goal.x").alias("x1"), F.col("goal.y").alias("y1"), "px", "py", "qx", "qy")
    reached = paths.where("mode = 'shortest' and seq = 0").select(F.col("request_id").alias("leg_id"), (F.col("cost") * routing.SPEED).alias("way")).unionByName(both.where(same_place).select("leg_id", F.lit(0.0).alias("way")))
    previews = access.join(reached, "leg_id").join(both.select("leg_id", same_place.alias("near")), "leg_id").select("leg_id", "asked_id", "near", (F.col("way") + F.col("first_m") + F.col("last_m")).alias("preview"))
    chosen = keep(previews.groupBy("asked_id").agg(F.min_by(F.struct("leg_id", "near"), F.struct("preview", "leg_id")).alias("c")).select(F.col("asked_id").alias("request_id"), "c.*"))
    parts = edges.select("edge_id", "length", "steps", "shade")
    own = arcs.select("request_id", "edge_id", "length", "steps", "shade", "covered", "sx", "sy", "dx", "dy").dropDuplicates(["request_id", "edge_id"])
    taken = paths.join(chosen.select("leg_id"), F.col("request_id") == F.col("leg_id"), "left_semi")
    on_edges = taken.join(parts, "edge_id")
    on_pieces = taken.join(own, ["request_id", "edge_id"])
    steps = on_edges.unionByName(on_pieces.select(on_edges.columns)).where("length > 0")
    totals = routing.summaries(steps).join(access, F.col("request_id") == F.col("leg_id"))
    joined = routing.with_access(totals, F.col("first_m"), F.col("last_m"))
    routes = joined.select(F.col("asked_id").alias("request_id"), "mode", "time_sec", "length_m", "sun_sec", "shade_ratio", "path_key", F.size(F.split("path_key", ":")).alias("n"))
    many = routes.groupBy("request_id").agg(F.max("n").alias("n")).where(F.col("n") > guards.LIMITS["route_segments"]).select("request_id")
    routes = routes.drop("n").join(many, "request_id", "left_anti")
    clamped = routing.clamp_to_shortest(routes)
    found = clamped.groupBy("request_id").agg(F.max("status").alias("route_status"))
    complex_ = heavy.select("request_id").unionByName(many).withColumn("complex", F.lit(True))
    outcome = requests.select("request_id", "early").join(sizes.select("request_id", "n_edges"), "request_id", "left").join(complex_, "request_id", "left").join(chosen.select("request_id", "near"), "request_id", "left").join(found, "request_id", "left")
    status = F.coalesce("early", F.when(F.col("n_edges").isNull(), "EMPTY_GRAPH").when(F.col("complex"), "ROUTE_DATA_TOO_COMPLEX").when(F.col("near").isNull(), "SNAP_FAILED").when(F.col("near"), "ALREADY_NEAR_GOAL").otherwise(F.coalesce("route_status", F.lit("ROUTE_NOT_FOUND"))))
    # A route that is too long shows the shortest one's segments.
    shown = clamped.where("status = 'OK'").select("request_id", "mode").join(routes.select("request_id", "mode", F.when(F.col("length_m") > routing.LONGEST_M, "shortest").otherwise(F.col("mode")).alias("walked")), ["request_id", "mode"])
    segments = lat_lon_segments(taken, edges, own, access).join(access.select("leg_id", F.col("asked_id").alias("request_id")), "leg_id").drop("leg_id").withColumnRenamed("mode", "walked")
    segments = segments.join(shown, ["request_id", "walked"]).drop("walked")
    return clamped.where("status = 'OK'").drop("status"), outcome.select("request_id", status.alias("status")), segments


def rank_routes(routes: DataFrame, preferred: str = "balanced") -> DataFrame:
    """The route to show first for each request: the preferred mode, else balanced, else any."""
    order = F.when(F.col("mode") == preferred, 0).when(F.col("mode") == "balanced", 1).otherwise(2)
    return routes.withColumn("_k", F.row_number().over(Window.partitionBy("request_id").orderBy(order, "mode"))).where("_k = 1").drop("_k")


def stored_network(spark, store: str, chosen: DataFrame, excluded: DataFrame, blocked: DataFrame, directions: DataFrame, sx, sy, around: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with their shade, shadow polygons) of the stored tiles that requests chose; only these are read. Buildings can be those of other tiles (``around``).

    Ways without a direction of their own are open both ways, unless the policy (way_id, direction) says otherwise. ``sx`` and ``sy``
    are the shadow's vector, as expressions over a building's height.
    """
    own = tile_store.read_chosen(spark, store, "ways", chosen)
    points = F.transform(F.sequence(F.lit(0), F.size("points") - 1), lambda i: F.struct(F.get("nodes", i).alias("node_id"), F.get("points", i)["lat"].alias("lat"), F.get("points", i)["lon"].alias("lon")))
    direction = F.coalesce("_d", F.col("direction") if "direction" in own.columns else F.lit("both"))
    ways = own.join(bounded(directions.select(F.col("way_id").alias("id"), F.col("direction").alias("_d"))), "id", "left")
    ways = ways.select(F.col("id").alias("way_id"), F.col("id").alias("way_seq"), points.alias("points"), F.lit(True).alias("walkable"), direction.alias("direction"), "covered", "steps", "fallback")
    edges = keep(graph.way_edges(ways, excluded, blocked))
    buildings = tile_store.read_chosen(spark, store, "buildings", chosen if around is None else around)
    poly = F.transform("points", lambda p: F.struct(geo.to_x(p["lon"]).alias("x"), geo.to_y(p["lat"]).alias("y")))
    shadows = keep(shade.shadow_polygons(buildings.withColumn("poly", poly), sx, sy).select("hull", "minx", "miny", "maxx", "maxy"))
    ratio = shade.polygon_shade(edges.where("not covered").select(F.col("edge_id").alias("id"), "ax", "ay", "bx", "by", "length"), shadows)
    shaded = edges.join(ratio.withColumnRenamed("id", "edge_id"), "edge_id", "left")
    return keep(shaded.withColumn("shade", F.when(F.col("covered"), 1.0).otherwise(F.coalesce("shade_ratio", F.lit(0.0)))).drop("shade_ratio")), shadows


def best_costs(spark, store: str, requests: DataFrame, policy: dict[str, DataFrame], sx, sy, shadow_m: float) -> DataFrame:
    """(request_id, mode, cost) of the best routes of requests (request_id, start, goal, sx, sy, gx, gy) between nodes, over all that is stored.

    No request is left out for the tiles that it meets, and no route for where it leads. A metre costs 1 / SPEED at least, so the cost of
    any route from start to goal says how far a better one can lead astray: it lies in an ellipse around both. Requests are
    searched in an area around their ends, and again in a wider one until the ellipse lies within it (once, if a route was found), or the area holds everything.
    Those without a route whose start can't be left or whose goal can't be entered have none anywhere. shadow_m: the longest shadow.
    """
    held = keep(tile_store.extents(spark.read.parquet(f"{store}/catalogue")))
    ends = held.agg(*(f(c).alias(f"_{c}") for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))))
    away = geo.euclid(*(F.col(c) for c in ("sx", "sy", "gx", "gy")))
    todo, parts = keep(requests.withColumn("reach", F.lit(BUFFER_DEG * geo.METRES_LAT)).crossJoin(F.broadcast(ends))), []  # one row
    while not todo.isEmpty():
        side = lambda f, g, axis, sign, more: g(f(f"s{axis}", f"g{axis}") + sign * (F.col("reach") + more), F.col(f"_{'min' if sign < 0 else 'max'}{axis}") + sign * more)
        area = lambda more: todo.select("request_id", *(side(F.least, F.greatest, a, -1, more).alias(f"min{a}") for a in "xy"), *(side(F.greatest, F.least, a, 1, more).alias(f"max{a}") for a in "xy"))
        areas = keep(area(1.0))
        edges, _ = stored_network(spark, store, keep(tile_store.tiles_within(areas, held)), policy["excluded"], policy["blocked"], policy["directions"], sx, sy, keep(tile_store.tiles_within(area(1.0 + 2 * shadow_m), held)))
        cells = keep(overlay.pack(edges))
        asked = overlay.ends_at_nodes(todo).join(overlay.cells_within(areas, cells), "request_id")
        found = keep(overlay.routes(keep(asked), cells, keep(overlay.shortcuts(cells))).groupBy("request_id", "mode").agg(F.max("cost").alias("cost")))
        dear = todo.join(found.groupBy("request_id").agg(F.max("cost").alias("cost")), "request_id", "left")
        metres = F.col("cost") * routing.SPEED
        need = F.when(F.col("cost").isNotNull(), F.sqrt(F.greatest(metres * metres - away * away, F.lit(0.0))) / 2)
        whole = F.lit(True)
        for a in "xy":
            whole = whole & (F.least(f"s{a}", f"g{a}") - F.col("reach") <= F.col(f"_min{a}")) & (F.greatest(f"s{a}", f"g{a}") + F.col("reach") >= F.col(f"_max{a}"))
        judged = keep(dear.withColumns({"sure": whole | F.coalesce(need <= F.col("reach"), F.lit(False)), "reach": F.coalesce(need, 2 * F.col("reach"))}))
        parts.append(found.join(judged.where("sure").select("request_id"), "request_id", "left_semi"))
        ways = lambda node, a, b: edges.select(F.explode(F.array(F.when(F.col("direction").isin("both", "forward"), F.col(a)), F.when(F.col("direction").isin("both", "backward"), F.col(b)))).alias(node)).distinct()
        again = judged.where("not sure")
        lost = again.where("cost is null").join(ways("start", "a", "b"), "start", "left_semi").join(ways("goal", "b", "a"), "goal", "left_semi")
        todo = keep(again.where("cost is not null").unionByName(lost).drop("cost", "sure"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "request_id long, mode string, cost double")


def plan_stored(spark, store: str, requests: DataFrame, policy: dict[str, DataFrame], sx, sy, start_inside=None, goal_inside=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``plan_routes`` from a tile store: check the requests, choose their tiles, read only these, and plan.

    requests: (request_id, start, goal, start_lat, start_lon, goal_lat, goal_lon, gps). policy: excluded (way_id), blocked (node_id),
    directions (way_id, direction). Requests that fail a check keep its status and read nothing.
    """
    yes = F.lit(True)
    checked = keep(routing.request_status(requests, yes if start_inside is None else start_inside, yes if goal_inside is None else goal_inside))
    catalogue = spark.read.parquet(f"{store}/catalogue")
    chosen, judged = tile_store.chosen_tiles(checked.where("status = 'OK'"), catalogue)
    edges, shadows = stored_network(spark, store, chosen, policy["excluded"], policy["blocked"], policy["directions"], sx, sy)
    labels = graph.components(edges.select("edge_id", "a", "b"), keep)
    over = shade.candidate_counts(shade.edge_samples(edges.where("not covered").select(F.col("edge_id").alias("id"), "ax", "ay", "bx", "by", "length")), shadows).where("not within_limit").select(F.col("id").alias("edge_id")).distinct()
    edges = edges.join(labels.select(F.col("node_id").alias("a"), "component"), "a").join(over.withColumn("crowded", F.lit(True)), "edge_id", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    edges = keep(edges)
    status = checked.select("request_id", F.col("status").alias("first")).join(judged.withColumnRenamed("status", "second"), "request_id", "left")
    placed = checked.drop("status").join(status, "request_id").select("request_id", geo.to_x(F.col("start_lon")).alias("sx"), geo.to_y(F.col("start_lat")).alias("sy"), geo.to_x(F.col("goal_lon")).alias("gx"), geo.to_y(F.col("goal_lat")).alias("gy"), "gps", F.when(F.col("first") != "OK", F.col("first")).otherwise(F.coalesce("second", "first")).alias("status"))
    return plan_routes(placed, edges, lambda pieces: shade.polygon_shade(pieces, shadows))
