"""Routes over a boundary overlay: map tiles as cells, shortcuts between their border nodes, requests that only meet the overlay.

A cell holds the nodes that lie in one map tile and the arcs between them, packed into one row. Its border nodes are
the ends of arcs that cross into another tile. Once for each cell and mode, shortcuts between border nodes are worked out, leaving
out those that lead over a third border node. A request then needs its two own cells for the ways to and from
border nodes, and shortcuts and crossing arcs of the tiles around its ends; shortcuts on the way that it
takes are unpacked afterwards, once for all requests that share them.

All four steps work on packed rows: cells, overlays, and requests by the cell in which they start. Cells with many requests are
dealt out in parts, so one place where a third of all requests start is many tasks.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, rules
from ..session import bounded, dealt, keep
from .routing import SPEED, edge_cost
from .spatial import cell, with_cells
from .tiles import BUFFER_DEG

MODES = list(rules.MODES)
#: Most requests that one task takes from a cell at once.
CROWD = 256
#: A cell's number is its tile's x times this, plus its y.
ROWS_OF_TILES = 1 << 16
#: Side in metres of the grid in which areas meet cells.
GRID_M = 500.0
#: Edge of a step that is still a shortcut.
SHORTCUT = -(1 << 62)
_LEG = "struct<mode:int,kind:string,node:bigint,inner:bigint,edge:bigint,cost:double>"
_ENDS = "array<struct<node:bigint,edge:bigint,cost:array<double>>>"
_ENDS_IN = "array<struct<cell:bigint,node:bigint,edge:bigint,cost:array<double>>>"


def cell_of(x: Column, y: Column) -> Column:
    """Number of the map tile in which a projected place lies."""
    return geo.tile_x(geo.to_lon(x)) * ROWS_OF_TILES + geo.tile_y(geo.to_lat(y))


def costs_of(length: Column, steps: Column, fallback: Column, shade: Column) -> Column:
    """Array of an edge's cost in each mode."""
    return F.array(*(edge_cost(length, steps, fallback, shade, F.lit(w)) for w, _ in rules.MODES.values()))


def pack(edges: DataFrame) -> DataFrame:
    """One row a cell: its nodes, inner arcs, arcs that leave it, and the nodes at which others arrive, each as plain arrays.

    edges: (edge_id, a, b, ax, ay, bx, by, length, steps, fallback, direction, shade). Directions as in ``routing.arcs``.
    """
    cost = costs_of(*(F.col(c) for c in ("length", "steps", "fallback", "shade")))
    placed = edges.select("edge_id", "a", "b", "ax", "ay", "bx", "by", "direction", cost.alias("cost"), cell_of(F.col("ax"), F.col("ay")).alias("ca"), cell_of(F.col("bx"), F.col("by")).alias("cb"))
    arc = lambda s, d: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.col(f"c{s}").alias("from_cell"), F.col(f"c{d}").alias("to_cell"), F.col("edge_id").alias("edge"), "cost")
    ways = F.filter(F.array(F.when(F.col("direction").isin("both", "forward"), arc("a", "b")), F.when(F.col("direction").isin("both", "backward"), arc("b", "a"))), lambda x: x.isNotNull())
    arcs = placed.select(F.explode(ways).alias("r")).select("r.*")
    nodes = placed.select(F.explode(F.array(*(F.struct(F.col(f"c{n}").alias("cell"), F.struct(F.col(n).alias("id"), F.col(f"{n}x").alias("x"), F.col(f"{n}y").alias("y")).alias("p")) for n in "ab"))).alias("n")).select("n.*")
    inner, crossing = F.col("from_cell") == F.col("to_cell"), F.col("from_cell") != F.col("to_cell")
    item = F.struct("edge", "src", "dst", "to_cell", "cost")
    leaving = arcs.groupBy(F.col("from_cell").alias("cell")).agg(F.sort_array(F.collect_list(F.when(inner, item))).alias("i"), F.sort_array(F.collect_list(F.when(crossing, item))).alias("o"))
    arriving = arcs.where(crossing).groupBy(F.col("to_cell").alias("cell")).agg(F.sort_array(F.collect_set("dst")).alias("entry"))
    every = nodes.groupBy("cell").agg(F.array_distinct(F.sort_array(F.collect_set("p"))).alias("p")).join(leaving, "cell", "left").join(arriving, "cell", "left")
    return every.select("cell", F.col("p.id").alias("node"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), *_costs_split("i"), *_costs_split("o"), "entry")


def _costs_split(name: str) -> list[Column]:
    """Fields of an array of arcs as arrays of their own, one of costs for each mode."""
    cost = lambda k: F.transform(name, lambda x: x["cost"][k])
    return [F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in ("edge", "src", "dst", "to_cell")] + [cost(k).alias(f"{name}_{m}") for k, m in enumerate(MODES)]


def spread(links: dict, cost: list, starts: dict, borders=frozenset()) -> tuple[dict, dict, dict, set]:
    """Costs from the starts; the (node, arc) before each node; where its way starts; nodes reached only over a border node in between."""
    best, came, origin, over, done = dict(starts), {}, {n: n for n in starts}, set(), set()
    queue = [(c, n) for n, c in starts.items()]
    heapq.heapify(queue)
    while queue:
        spent, node = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        between = node in over or (node in borders and origin[node] != node)
        for to, arc in links.get(node, ()):
            reached = spent + cost[arc]
            if reached < best.get(to, math.inf):
                best[to], came[to], origin[to] = reached, (node, arc), origin[node]
                (over.add if between else over.discard)(to)
                heapq.heappush(queue, (reached, to))
    return best, came, origin, over


class Cell:
    """One packed row: arcs as links by node, and costs by mode."""

    def __init__(self, row: dict):
        self.cell, self.row = row["cell"], row
        src, dst = row["i_src"] or [], row["i_dst"] or []
        self.edges, self.cost = row["i_edge"] or [], [row[f"i_{m}"] or [] for m in MODES]
        self.links, self.back = {}, {}
        for k, (a, b) in enumerate(zip(src, dst)):
            self.links.setdefault(a, []).append((b, k))
            self.back.setdefault(b, []).append((a, k))
        self.borders = frozenset(row["o_src"] or []) | frozenset(row["entry"] or [])


def _rows(batch: pa.RecordBatch, columns: list[str] | None = None):
    """Rows as dicts, one at a time: packed rows are large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).select(columns or batch.schema.names).to_pylist()[0]


_OUT = [f"o_{c}" for c in ("edge", "src", "dst", "to_cell", *MODES)]
_SHORT = [f"s_{c}_{m}" for m in MODES for c in ("src", "dst", "cost")]
OVERLAY = "cell long, node array<long>, x array<double>, y array<double>, " + ", ".join(f"o_{c} array<{'double' if c in MODES else 'long'}>" for c in ("edge", "src", "dst", "to_cell", *MODES)) + ", " + ", ".join(f"{c} array<{'double' if '_cost_' in c else 'long'}>" for c in _SHORT)


def shortcuts(cells: DataFrame) -> DataFrame:
    """The overlay: of each cell its border nodes, the arcs that leave it, and for each mode the least costs between border nodes."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                cell = Cell(row)
                place = {n: (x, y) for n, x, y in zip(row["node"], row["x"], row["y"]) if n in cell.borders}
                out = {"cell": cell.cell, "node": list(place), "x": [p[0] for p in place.values()], "y": [p[1] for p in place.values()]} | {c: row[c] or [] for c in _OUT}
                for mode, cost in zip(MODES, cell.cost):
                    found = []
                    for a in sorted(cell.borders):
                        best, _, _, over = spread(cell.links, cost, {a: 0.0}, cell.borders)
                        found += [(a, b, best[b]) for b in sorted(cell.borders & best.keys()) if b != a and b not in over]
                    out |= {f"s_{c}_{mode}": [f[k] for f in found] for k, c in enumerate(("src", "dst", "cost"))}
                yield pa.RecordBatch.from_pylist([out], schema=_arrow(OVERLAY))

    return dealt(cells).mapInArrow(run, OVERLAY)  # few rows, each of them much work


def _arrow(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string of longs, doubles, strings and lists of numbers."""
    plain = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}
    kind = lambda t: pa.list_(plain[t[6:-1]]) if t.startswith("array<") else plain[t]
    return pa.schema([(name, kind(t)) for name, t in (f.split(" ") for f in ddl.split(", "))])


def _crowds(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Adds crowd: rows of one group in parts of about ``most``, by their key."""
    parts = rows.groupBy(by).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    return rows.join(bounded(parts), by).withColumn("crowd", F.pmod(F.xxhash64(key), "_parts").cast("int")).drop("_parts")


def _legs(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, leg): the least costs from each request's sources to border nodes of their cells, from border nodes to its targets, and from source to target within a cell."""
    side = lambda name: requests.select("request_id", F.explode(name).alias("e")).select("request_id", F.col("e.cell").alias("cell"), F.struct("e.node", "e.edge", "e.cost").alias(name))
    both = side("sources").withColumn("targets", F.lit(None).cast(_ENDS[6:-1])).unionByName(side("targets").withColumn("sources", F.lit(None).cast(_ENDS[6:-1])))
    asks = keep(both.groupBy("cell", "request_id").agg(F.collect_list("sources").alias("sources"), F.collect_list("targets").alias("targets")))
    grouped = _crowds(asks, "cell", "request_id", CROWD).groupBy("cell", "crowd").agg(F.collect_list(F.struct("request_id", "sources", "targets")).alias("asks"))

    def ends(cell, links, mode, given):
        """Least costs from the given ends along the links, with where they started and by which edge."""
        starts, edges = {}, {}
        for e in given:
            if e["cost"][mode] < starts.get(e["node"], math.inf):
                starts[e["node"]], edges[e["node"]] = e["cost"][mode], e["edge"]
        best, _, origin, over = spread(links, cell.cost[mode], starts, cell.borders)
        return best, origin, over, edges

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                cell, out = Cell(row), []
                for ask in row["asks"]:
                    for mode in range(len(MODES)):
                        from_best, from_origin, from_over, from_edge = ends(cell, cell.links, mode, ask["sources"])
                        to_best, to_origin, to_over, to_edge = ends(cell, cell.back, mode, ask["targets"])
                        add = lambda kind, node, inner, edge, cost: out.append({"request_id": ask["request_id"], "leg": {"mode": mode, "kind": kind, "node": node, "inner": inner, "edge": edge, "cost": cost}})  # noqa: E731, B023
                        for n in sorted(cell.borders):
                            if n in from_best and n not in from_over:
                                add("from", n, from_origin[n], from_edge[from_origin[n]], from_best[n])
                            if n in to_best and n not in to_over:
                                add("to", n, to_origin[n], to_edge[to_origin[n]], to_best[n])
                        # Inside the cell: the way meets the target's own node.
                        within = [(from_best[n] + c, n) for n, c in ((e["node"], e["cost"][mode]) for e in ask["targets"]) if n in from_best]
                        if within:
                            cost, n = min(within)
                            edge = min((e["cost"][mode], e["edge"] is None, e["edge"] or 0) for e in ask["targets"] if e["node"] == n)
                            add("start", n, from_origin[n], from_edge[from_origin[n]], cost)
                            add("goal", n, n, None if edge[1] else edge[2], cost)
                yield pa.RecordBatch.from_pylist([r | {"cell": cell.cell} for r in out], schema=pa.schema([("request_id", pa.int64()), ("cell", pa.int64()), ("leg", pa.struct([("mode", pa.int32()), ("kind", pa.string()), ("node", pa.int64()), ("inner", pa.int64()), ("edge", pa.int64()), ("cost", pa.float64())]))]))

    return dealt(grouped.join(cells, "cell")).mapInArrow(run, f"request_id long, cell long, leg {_LEG}")


#: A step of a route: a crossing arc or an own edge, or a shortcut or leg within a cell that is still to be unpacked (SHORTCUT).
_STEP = "struct<cell:bigint,src:bigint,dst:bigint,edge:bigint>"
_TAKEN = f"request_id long, mode int, cost double, steps array<{_STEP}>"
_TAKEN_ARROW = pa.schema([("request_id", pa.int64()), ("mode", pa.int32()), ("cost", pa.float64()), ("steps", pa.list_(pa.struct([(c, pa.int64()) for c in ("cell", "src", "dst", "edge")])))])


def _search(rows: pa.Table, requests: pa.Table) -> pa.Table:
    """Best-first search of each request over the overlay of one block, tile by tile as far as its own tiles go."""
    links, place, home = [{} for _ in MODES], {}, {}
    for row in rows.to_pylist():
        for n, x, y in zip(row["node"], row["x"], row["y"]):
            place[n], home[n] = (x, y), row["cell"]
        for m, mode in enumerate(MODES):
            for a, b, cost in zip(row[f"s_src_{mode}"], row[f"s_dst_{mode}"], row[f"s_cost_{mode}"]):
                links[m].setdefault(a, []).append((b, cost, SHORTCUT, row["cell"]))
            for a, b, cost, edge, cell in zip(row["o_src"], row["o_dst"], row[f"o_{mode}"], row["o_edge"], row["o_to_cell"]):
                links[m].setdefault(a, []).append((b, cost, edge, cell))
    out = []
    for ask in requests.to_pylist():
        allowed = set(ask["cells"])
        for m in range(len(MODES)):
            found = _best_way(links[m], place, allowed, m, ask)
            if found:
                out.append({"request_id": ask["request_id"], "mode": m, "cost": found[0], "steps": found[1]})
    return pa.Table.from_pylist(out, schema=_TAKEN_ARROW)


def _best_way(links: dict, place: dict, allowed: set, mode: int, ask: dict):
    """(cost, steps) of the best route in one mode: by its own arc, within one cell, or over border nodes."""
    step = lambda cell, a, b, edge=SHORTCUT: {"cell": cell, "src": a, "dst": b, "edge": edge}
    legs = [x for x in ask["legs"] if x["leg"]["mode"] == mode]
    total, end = math.inf, None
    for d in ask["directs"] or []:
        if d["cost"][mode] < total:
            total, end = d["cost"][mode], [step(0, ask["start"], ask["goal"], d["edge"])]
    first = lambda x: [] if x["leg"]["edge"] is None else [step(x["cell"], ask["start"], x["leg"]["inner"], x["leg"]["edge"])]
    last = lambda x: [] if x["leg"]["edge"] is None else [step(x["cell"], x["leg"]["inner"], ask["goal"], x["leg"]["edge"])]
    way = lambda cell, a, b: [] if a == b else [step(cell, a, b)]
    within = {}
    for x in legs:
        if x["leg"]["kind"] in ("start", "goal"):
            within.setdefault(x["cell"], {})[x["leg"]["kind"]] = x
    for cell, x in sorted(within.items()):
        if x["start"]["leg"]["cost"] < total:
            total, end = x["start"]["leg"]["cost"], first(x["start"]) + way(cell, x["start"]["leg"]["inner"], x["start"]["leg"]["node"]) + last(x["goal"])
    entry, arrival = {}, {}
    for x in legs:
        kept = {"from": entry, "to": arrival}.get(x["leg"]["kind"])
        if kept is not None and (x["leg"]["node"] not in kept or x["leg"]["cost"] < kept[x["leg"]["node"]]["leg"]["cost"]):
            kept[x["leg"]["node"]] = x
    gx, gy = ask["gx"], ask["gy"]
    ahead = lambda n: math.hypot(place[n][0] - gx, place[n][1] - gy) / SPEED if n in place else 0.0
    best, came, done = {n: x["leg"]["cost"] for n, x in entry.items()}, {}, set()
    queue = [(c + ahead(n), n) for n, c in best.items()]
    heapq.heapify(queue)
    meeting = None
    while queue:
        bound, node = heapq.heappop(queue)
        if bound >= total:
            break
        if node in done:
            continue
        done.add(node)
        if node in arrival and best[node] + arrival[node]["leg"]["cost"] < total:
            total, meeting = best[node] + arrival[node]["leg"]["cost"], node
        for to, cost, edge, cell in links.get(node, ()):
            reached = best[node] + cost
            if cell in allowed and reached < best.get(to, math.inf):
                best[to], came[to] = reached, (node, edge, cell)
                heapq.heappush(queue, (reached + ahead(to), to))
    if meeting is None:
        return None if end is None else (total, end)
    steps, node = [], meeting
    while node in came:
        before, edge, cell = came[node]
        steps.append(step(cell, before, node, edge))
        node = before
    x, y = entry[node], arrival[meeting]
    return total, first(x) + way(x["cell"], x["leg"]["inner"], node) + steps[::-1] + way(y["cell"], meeting, y["leg"]["inner"]) + last(y)


def _unpacked(cells: DataFrame, steps: DataFrame) -> DataFrame:
    """(cell, mode, src, dst, way): edges of each shortcut that some route takes, worked out once."""
    wanted = keep(steps.where(F.col("edge") == SHORTCUT).select("cell", "mode", "src", "dst").distinct())
    grouped = _crowds(wanted, "cell", "src", 4 * CROWD).groupBy("cell", "crowd").agg(F.collect_list(F.struct("mode", "src", "dst")).alias("wanted"))
    schema = pa.schema([("cell", pa.int64()), ("mode", pa.int32()), ("src", pa.int64()), ("dst", pa.int64()), ("way", pa.list_(pa.struct([(c, pa.int64()) for c in ("edge", "a", "b")])))])

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                cell, out, by_source = Cell(row), [], {}
                for w in row["wanted"]:
                    by_source.setdefault((w["mode"], w["src"]), []).append(w["dst"])
                for (mode, src), goals in sorted(by_source.items()):
                    _, came, _, _ = spread(cell.links, cell.cost[mode], {src: 0.0})
                    for goal in goals:
                        way, node = [], goal
                        while node != src:
                            before, arc = came[node]
                            way.append({"edge": cell.edges[arc], "a": before, "b": node})
                            node = before
                        out.append({"cell": cell.cell, "mode": mode, "src": src, "dst": goal, "way": way[::-1]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt(grouped.join(cells, "cell")).mapInArrow(run, "cell long, mode int, src long, dst long, way array<struct<edge:bigint,a:bigint,b:bigint>>")


def ends_at_nodes(requests: DataFrame) -> DataFrame:
    """Requests (request_id, start, goal, sx, sy, gx, gy) between nodes, in the form that ``routes`` takes."""
    nothing = F.array(*(F.lit(0.0) for _ in MODES))
    end = lambda x, y, node: F.array(F.struct(cell_of(F.col(x), F.col(y)).alias("cell"), F.col(node).alias("node"), F.lit(None).cast("long").alias("edge"), nothing.alias("cost")))
    return requests.select("request_id", "start", "goal", "sx", "sy", "gx", "gy", end("sx", "sy", "start").alias("sources"), end("gx", "gy", "goal").alias("targets"), F.lit(None).cast("array<struct<edge:bigint,cost:array<double>>>").alias("directs"))


def cells_around(sx: Column, sy: Column, gx: Column, gy: Column, buffer: float = BUFFER_DEG) -> Column:
    """Cells of the tiles that meet the box around both ends, grown by ``buffer`` degrees."""
    lats, lons = [geo.to_lat(c) for c in (sy, gy)], [geo.to_lon(c) for c in (sx, gx)]
    xs = F.sequence(geo.tile_x(F.least(*lons) - buffer), geo.tile_x(F.greatest(*lons) + buffer))
    ys = F.sequence(geo.tile_y(F.greatest(*lats) + buffer), geo.tile_y(F.least(*lats) - buffer))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: x * ROWS_OF_TILES + y)))


def cells_within(areas: DataFrame, cells: DataFrame) -> DataFrame:
    """(request_id, cells) of all cells with a node in a request's area (request_id, minx, miny, maxx, maxy), and of some just beside it: found from the nodes, so also where tiles are tiny or beyond a pole. cells: ``pack``."""
    at = F.array_distinct(F.zip_with("x", "y", lambda x, y: F.struct(cell(x, GRID_M).alias("cell_x"), cell(y, GRID_M).alias("cell_y"))))
    held = cells.select("cell", F.explode(at).alias("g")).select("cell", "g.*")
    around = with_cells(areas, *(F.col(c) for c in ("minx", "miny", "maxx", "maxy")), GRID_M).select("request_id", "cell_x", "cell_y")
    return around.join(held, ["cell_x", "cell_y"]).groupBy("request_id").agg(F.collect_set("cell").alias("cells"))


def cells_met(requests: DataFrame) -> DataFrame:
    """(cell) that requests (cells, sources, targets) may open or cross; no other is read in ``routes``."""
    of_ends = lambda name: F.transform(F.coalesce(F.col(name), F.array().cast(_ENDS_IN)), lambda e: e["cell"])
    return requests.select(F.explode(F.concat("cells", of_ends("sources"), of_ends("targets"))).alias("cell")).distinct()


def routes(requests: DataFrame, cells: DataFrame, overlay: DataFrame, buffer: float = BUFFER_DEG) -> DataFrame:
    """Paths of every request in every mode, as ordered edges; requests without a way in their tiles have no rows.

    A route stays within the tiles that meet the box around its ends grown by ``buffer`` degrees, as those are the tiles that
    are read for it; inside of them it is the best, of any length. requests: (request_id, start, goal, sx, sy, gx, gy,
    sources, targets, directs): ends are lists of nodes with their cells, the cost to reach them in each mode, and the edge on which (null: none);
    directs are whole ways from start to goal; a column of cells, if there is one, says which are around. cells: ``pack``; overlay: ``shortcuts``.
    """
    placed = requests if "cells" in requests.columns else requests.withColumn("cells", cells_around(*(F.col(c) for c in ("sx", "sy", "gx", "gy")), buffer))
    legs = _legs(cells, requests).groupBy("request_id").agg(F.collect_list(F.struct("cell", "leg")).alias("legs"))  # no more than border nodes of a few cells
    crowds = _crowds(placed.select("request_id", "start", "goal", "gx", "gy", "directs", "cells", cell_of(F.col("sx"), F.col("sy")).alias("block")), "block", "request_id", CROWD)  # before legs, which are worked out once
    asked = keep(crowds.join(legs, "request_id", "left").withColumn("legs", F.coalesce("legs", F.array().cast(f"array<struct<cell:bigint,leg:{_LEG}>>"))))
    met = asked.select(F.col("block").alias("of_block"), F.col("crowd").alias("of_crowd"), F.explode("cells").alias("cell")).distinct().join(overlay, "cell")
    searched = met.groupBy("of_block", "of_crowd").cogroup(asked.groupBy("block", "crowd")).applyInArrow(_search, _TAKEN)
    taken = keep(searched.select("request_id", "mode", "cost", F.posexplode("steps").alias("at", "s")).select("request_id", "mode", "cost", "at", "s.*"))
    ways = taken.where(F.col("edge") == SHORTCUT).join(_unpacked(cells, taken), ["cell", "mode", "src", "dst"])
    inner = ways.select("request_id", "mode", "cost", "at", F.posexplode("way").alias("k", "w")).select("request_id", "mode", "cost", "at", "k", "w.edge", "w.a", "w.b")
    crossing = taken.where(F.col("edge") != SHORTCUT).select("request_id", "mode", "cost", "at", F.lit(0).alias("k"), "edge", F.col("src").alias("a"), F.col("dst").alias("b"))
    seq = F.row_number().over(Window.partitionBy("request_id", "mode").orderBy("at", "k")) - 1
    names = F.array(*(F.lit(m) for m in MODES))
    return inner.unionByName(crossing).select("request_id", names[F.col("mode")].alias("mode"), seq.alias("seq"), F.col("edge").alias("edge_id"), F.col("a").alias("from_node"), F.col("b").alias("to_node"), "cost")
