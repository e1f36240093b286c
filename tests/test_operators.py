"""Operators against small inputs, brute force and each other."""

import random

import pytest
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.operators import boundary, graph, guards, places, routing, sequence, shade
from penumbra.operators.spatial import points_in_boxes
from penumbra.session import keep
from penumbra.sources import readers, writers
from penumbra.streaming import adherence


def test_grid_join_equals_brute_force(spark):
    r = random.Random(3)
    pts = [(k, r.uniform(-50, 50), r.uniform(-50, 50)) for k in range(200)]
    boxes = [(k, x, y, x + r.uniform(0, 40), y + r.uniform(0, 40)) for k in range(60) for x, y in [(r.uniform(-60, 40), r.uniform(-60, 40))]]
    found = points_in_boxes(spark.createDataFrame(pts, "p int, px double, py double"), spark.createDataFrame(boxes, "b int, minx double, miny double, maxx double, maxy double"), 7.0)
    want = sorted((p, b) for p, x, y in pts for b, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    assert sorted((r.p, r.b) for r in found.collect()) == want


def test_hull_drops_points_on_sides():
    assert shade.hull([(0, 0), (2, 0), (1, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert shade.hull([(1, 1), (0, 0)]) == [(0, 0), (1, 1)]


def test_simplified_rings(spark):
    near = boundary.TOLERANCE_DEG / 10
    assert boundary._simplify([(0, 0), (1, near), (2, 0)], boundary.TOLERANCE_DEG) == [(0, 0), (1, near), (2, 0)]  # three points stay
    assert boundary._simplify([(0, 0), (1, near), (2, -near), (3, 0)], boundary.TOLERANCE_DEG) == [(0, 0), (3, 0)]
    # Closed first: the far corner splits the ring, each half is judged by itself.
    ring = [(0.0, 0.0), (0.25, near), (0.5, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rows = spark.createDataFrame([([{"x": x, "y": y} for x, y in r],) for r in (ring, ring + ring[:1], ring[:3])], "r array<struct<x:double,y:double>>")
    got = [r.s if r.s is None else [(p.x, p.y) for p in r.s] for r in rows.select(boundary.simplified_ring("r").alias("s")).collect()]
    assert got[0] == got[1] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)] and got[2] is None


def test_rings_are_cut_where_their_sql_cuts_them(spark, tmp_path):
    """Corners as far from a side but for the last bit, which a distance that went through a root took for equal or in the other order.

    Corners of unknown height come last among those of one longitude, and nodes without a key are no ring.
    """
    import duckdb

    from penumbra.plans import registry, walking  # noqa: F401

    rings = {36: [49, 10, 2, 15, 17], 43: [23, 16, 43, 41, 15], 32: [26, 1, 3, 25, 18, 36], 46: [38, 1, 18, 26, 29, 13], 13: [36, 28, 25, 16, 18, 46, 26], 59: [38, 12, 23, 46, 48, 46, 25, 17]}
    rows = [(50 * gy + k, size, "PROMO", "Brand#7") for gy, sizes in rings.items() for k, size in enumerate(sizes)]
    rows += [(50 * 70 + k, size, "PROMO", "Brand#7") for k in range(4) for size in (None, 9 * k)] + [(None, 1, "PROMO", "Brand#7")] * 4
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((tuple(r) for r in registry.QUERIES["ring_simplified"](spark, str(tmp_path)).select("gy", "place", "x", "y").collect()), key=repr)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        assert got == sorted(con.sql(f"SELECT gy, place, x, y FROM ({registry.ORACLES['ring_simplified']})").fetchall(), key=repr)


def test_snap_weighs_fallback_edges_but_measures_metres(spark):
    # A point 6 m above a fallback road and 8 m below an ordinary one: 9 against 8. One 2 m above the former: 3 against 12.
    edge = lambda k, y, fallback: (k, -50.0, y, 50.0, y, fallback)
    rows = [(p, 3.0, y, *e) for p, y in ((7, 6.0), (8, 2.0)) for e in (edge(1, 0.0, True), edge(2, 14.0, False))]
    c = spark.createDataFrame(rows, "point_id int, px double, py double, edge_id long, ax double, ay double, bx double, by double, fallback boolean")
    assert {r.point_id: (r.edge_id, r.snap_x, r.snap_y) for r in graph.snap(c, F.lit(40.0)).collect()} == {7: (2, 3.0, 14.0), 8: (1, 3.0, 0.0)}
    assert graph.snap(c.where("point_id = 7"), F.lit(7.0)).first().edge_id == 1 and graph.snap(c.where("point_id = 7"), F.lit(5.0)).count() == 0


def _grid(n, seed):
    r = random.Random(seed)
    nodes = [(y * n + x, x * 50.0, y * 50.0) for y in range(n) for x in range(n)]
    edges = []
    for i, x, y in nodes:
        for j in ([i + 1] if x < 50 * (n - 1) else []) + ([i + n] if y < 50 * (n - 1) else []):
            edges.append((len(edges), i, j, 50.0, r.random() < 0.1, r.random() < 0.1, r.choice(["both", "both", "forward", "backward"]), r.random()))
    return nodes, edges


def test_distance_from_the_end_of_a_segment_is_nothing(spark):
    r = random.Random(5)
    rows = [(*(r.uniform(-1e6, 1e6) for _ in range(2)), *(r.uniform(-1e3, 1e3) for _ in range(2))) for _ in range(200)]
    assert any(ax + (bx - ax) != bx for ax, _, bx, _ in rows)
    distance = geo.on_segment(*(F.col(c) for c in ("bx", "by", "ax", "ay", "bx", "by")))[3]
    got = spark.createDataFrame(rows, "ax double, ay double, bx double, by double").select(distance.alias("d")).distinct().collect()
    assert [x.d for x in got] == [0.0]


def test_search_equals_joins(spark):
    nodes, edges = _grid(7, 5)
    e = spark.createDataFrame(edges, "edge_id long, a long, b long, length double, steps boolean, fallback boolean, direction string, shade double")
    n = spark.createDataFrame(nodes, "id long, x double, y double")
    asked = spark.createDataFrame([(1, 0, 48, 0.0, 0.0, 300.0, 300.0), (2, 30, 5, 100.0, 200.0, 250.0, 0.0), (3, 4, 4, 200.0, 0.0, 200.0, 0.0)], "request_id long, start long, goal long, sx double, sy double, gx double, gy double")
    paths = routing.route_paths(asked, e, n).collect()
    for mode, weight in (("shortest", 0.0), ("balanced", 1.0), ("maxShade", 3.0)):
        costs = {(r.source, r.node): r.cost for r in routing.shortest_costs(asked.select(F.col("start").alias("source")).distinct(), routing.arcs(e, F.lit(weight)), keep).collect()}
        for request, start, goal in ((1, 0, 48), (2, 30, 5)):
            mine = sorted((p.seq, p.from_node, p.to_node, p.cost) for p in paths if p.request_id == request and p.mode == mode)
            if (start, goal) not in costs:
                assert not mine
                continue
            assert mine[0][1] == start and mine[-1][2] == goal and all(a[2] == b[1] for a, b in zip(mine, mine[1:]))
            assert abs(mine[0][3] - costs[start, goal]) < 1e-6
    assert not [p for p in paths if p.request_id == 3]


def test_components_with_long_chain(spark):
    edges = spark.createDataFrame([(k, k, k + 1) for k in range(40) if k != 20], "edge_id long, a long, b long")
    got = {r.node_id: r.component for r in graph.components(edges, keep).collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(41)}


def _segments(spark, points, **more):
    rows = [(1, k, *a, *b, more.get("shade", 0.0), False, k in more.get("steps", ()), k in more.get("connector", ()), "Goal") for k, (a, b) in enumerate(zip(points, points[1:]))]
    return spark.createDataFrame(rows, "route_id long, seq int, from_lat double, from_lon double, to_lat double, to_lon double, shade double, covered boolean, steps boolean, connector boolean, goal_name string")


def test_turn_by_turn(spark):
    route = [(37.5, 127.0), (37.501, 127.0), (37.501, 127.001), (37.502, 127.001)]
    kinds = lambda df: [r.kind for r in sequence.turn_by_turn(df).orderBy("step").collect()]
    assert kinds(_segments(spark, route)) == ["depart", "right", "left", "arrive"]
    straight = [(37.5 + k * 1e-3, 127.0) for k in range(4)]
    assert kinds(_segments(spark, straight, connector=(0,), steps=(2,))) == ["connector", "depart", "steps", "arrive"]
    jitter = [(37.5, 127.0), (37.501, 127.0), (37.501, 127.00005), (37.502, 127.00005)]
    assert kinds(_segments(spark, jitter)) == ["depart", "arrive"]
    spike = [(37.5, 127.0), (37.501, 127.0), (37.5009, 127.0), (37.502, 127.0)]
    assert kinds(_segments(spark, spike)) == ["depart", "arrive"]
    assert kinds(_segments(spark, [(float("nan"), 127.0), (37.5, 127.0)])) == []
    assert kinds(_segments(spark, [(37.5, 127.0), (float("inf"), 127.0), (37.5, float("-inf"))])) == []


def test_turns_straight_back(spark):
    """A turn by 180 degrees is told left or right by the last bit of the bearings, which has to be that of SQL."""
    place = lambda event: (37.49 + (event % 97) * 1e-4, 127.02 + (event % 89) * 1e-4)
    kind = lambda *events: [r.kind for r in sequence.turn_by_turn(_segments(spark, [place(e) for e in events])).orderBy("step").collect()][1]
    assert kind(1274782, 1281426, 1283415) == "uturn-left" and kind(5474782, 5481426, 5483415) == "uturn-right"


@pytest.mark.parametrize("text, ids", [
    ("숲길역", ["stop", "park"]), (" 숲 길 ", ["stop", "park"]), ("", []), ("나" * 101, []), ("물가로 7", ["mill"]), ("Ｏｌｄ ｍｉｌｌ", ["mill"]), ("windmill old", ["mill"]),
    ("숲", ["park", "stop"]), ("l", ["mill"]), ("없는 곳", []), ("역 windmill", ["mill"]), ("역 역", ["mill"])])
def test_search(spark, text, ids):
    rows = [("stop", "숲길역", [], None), ("park", "숲길공원", None, None), ("mill", "물레방아", ["OLD MILL", "Ｏｌｄ Ｗｉｎｄｍｉｌｌ"], "물가로 7")]
    p = spark.createDataFrame(rows, "id string, name string, aliases array<string>, address string")
    q = spark.createDataFrame([(1, text)], "query_id int, query string")
    assert [r.id for r in places.search(p, q).orderBy("rank").collect()] == ids


def test_search_equals_scoring_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc-1 역") for _ in range(r.randint(1, 6)))
    rows = [(str(k), word() + "x", [word() for _ in range(r.randint(0, 2))], r.choice([None, word()])) for k in range(80)]
    p = spark.createDataFrame(rows, "id string, name string, aliases array<string>, address string")
    q = spark.createDataFrame([(k, word()) for k in range(60)], "query_id int, query string")
    plain = lambda c: places.plain_query(c, places.as_it_is)
    tokens = F.transform(places.query_tokens(F.col("query"), places.as_it_is), lambda t: F.regexp_replace(t, "역$", ""))
    every = p.select("id", "name", plain(F.col("name")).alias("n"), F.transform("aliases", plain).alias("al"), plain(F.col("address")).alias("ad")).crossJoin(q.select("query_id", plain(F.col("query")).alias("q"), tokens.alias("t")).where("q <> ''"))
    want = every.withColumn("score", places.match_score(*(F.col(c) for c in ("n", "al", "ad", "q", "t")))).where("score is not null").select("query_id", "id", "score")
    got = keep(places.search(p, q, 50, places.as_it_is).select("query_id", "id", "score"))
    best = {}
    for x in want.collect():
        best.setdefault(x.query_id, []).append((x.score, x.id))
    assert {k: sorted(v)[0][0] for k, v in best.items()} == {k: min(x.score for x in got.collect() if x.query_id == k) for k in best}
    assert got.exceptAll(want).isEmpty() and got.count() == sum(min(50, len(v)) for v in best.values())


def test_queries_of_one_form_are_scored_once(spark, monkeypatch):
    scored = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def score(name):
        scored.add(1)
        return 0

    monkeypatch.setattr(places, "match_score", lambda name, *rest: score(name))
    p = spark.createDataFrame([(f"p{k}", f"Market {k}", None, None) for k in range(20)], "id string, name string, aliases array<string>, address string")
    q = spark.createDataFrame([(k, ["market", "MARKET"][k % 2]) for k in range(40)], "query_id long, query string")
    found = places.search(p, q, compose=places.as_it_is).collect()
    assert len(found) == 40 * places.DEFAULT_RESULTS and {r.query_id for r in found} == set(range(40))
    assert scored.value <= 4 * 20


def test_names_in_korean_order(spark):
    names = ["숲 2", "가게", "Zoo", "나무", "apple", "10번", "2번", "Apple", "각", "가", "힣", "숲 10"]
    p = spark.createDataFrame([(str(k), "x" + n, [], None) for k, n in enumerate(names)], "id string, name string, aliases array<string>, address string")
    q = spark.createDataFrame([(1, "x")], "query_id int, query string")
    order = lambda how: [names[int(r.id)] for r in places.search(p, q, 50, order=how).orderBy("rank").collect()]
    assert order(places.korean) == ["10번", "2번", "가", "가게", "각", "나무", "숲 10", "숲 2", "힣", "apple", "Apple", "Zoo"]
    assert order(places.by_codes) == sorted(names)


def test_limits_accept_up_to_the_limit(spark):
    rows = spark.createDataFrame([(v, k) for k, v in guards.LIMITS.items()] + [(v + 1, k) for k, v in guards.LIMITS.items()], "n int, k string")
    for k, v in guards.LIMITS.items():
        got = {r.n: r.status for r in guards.resource_status(rows.where(F.col("k") == k), {"n": k}).collect()}
        assert got == {v: "OK", v + 1: "ROUTE_DATA_TOO_COMPLEX"}
    with pytest.raises(Exception, match="ROUTE_DATA_TOO_COMPLEX"):
        guards.resource_status(rows.where("k = 'graph_nodes'"), {"n": "graph_nodes"}, strict=True).collect()


def test_tile_reader(spark, tmp_path):
    (tmp_path / "15-1-2.json").write_text('{"schema":2,"id":"15-1-2","w":[[13011352083,5,[1,2],[37500000,127000000,37500100,127000100]],[8,0,[3,4],[1,2,3,4]]],"b":[[9,null,3,[1,2,3,4,5,6]]]}')
    files = readers.read_whole(spark, str(tmp_path))
    ways, buildings = readers.compact_tiles(files)
    none = spark.createDataFrame([(8,)], "way_id long")
    got = readers.expand_ways(ways, none, spark.createDataFrame([(13011352083,)], "way_id long")).collect()
    assert [(r.id, r.covered, r.steps, r.fallback, r.points[0].lat) for r in got] == [(13011352083, True, False, True, 37.5)]
    b = buildings.first()
    assert (b.id, b.height, b.levels, len(b.coords)) == (9, None, 3.0, 6)


def test_publish_checks_before_it_replaces(spark, tmp_path):
    table = spark.range(3)
    writers.publish(table, f"file://{tmp_path}/a", f"file://{tmp_path}/b", lambda t: t.count() == 3)
    assert spark.read.parquet(f"file://{tmp_path}/b").count() == 3
    with pytest.raises(ValueError):
        writers.publish(spark.range(2), f"file://{tmp_path}/a", f"file://{tmp_path}/b", lambda t: t.count() == 3)
    assert spark.read.parquet(f"file://{tmp_path}/b").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(9)
    rows = [(u, "p", k, 1_700_000_000 + k * 60 + u, r.choice([None, 5.0, 30.0, 60.0, 90.0]), r.choice([5.0, 10.0, 70.0])) for u in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "user_id long, path_key string, event_id long, t long, distance_m double, acc double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    batch = {(x.user_id, x.ts): (x.kind, x.streak) for x in adherence.adherence_batch(df).collect()}
    for part in range(3):  # files in order of time, so the batches are too
        df.where((F.col("event_id") >= part * 20) & (F.col("event_id") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = adherence.adherence_stream(stream).writeStream.format("memory").queryName("adherence_out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x.user_id, x.ts): (x.kind, x.streak) for x in spark.table("adherence_out").collect()}
    assert got == batch
