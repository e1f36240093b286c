"""The tile store: pruned reads, checked files, statuses, whole plans; and releases that survive a stop at any step."""

import json

import pytest
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.operators import guards, overlay, tiles
from penumbra.plans import service, walking
from penumbra.session import keep, ship_package
from penumbra.sources import readers, releases, tile_store


def street(spark, n=40, step=1e-3, **more):
    """A street to the east, a way for each stretch, over several tiles."""
    point = lambda k: {"lat": 37.5, "lon": 127.0 + k * step}
    rows = [(k + 1, [k + 1, k + 2], [point(k), point(k + 1)], False, False, False, "both") for k in range(n)]
    return spark.createDataFrame(rows, "id long, nodes array<long>, points array<struct<lat:double,lon:double>>, covered boolean, steps boolean, fallback boolean, direction string")


def house(spark, rows=((1, 37.5001, 127.002),)):
    shaped = [(k, 10.0, [{"lat": lat + a * 1e-4, "lon": lon + b * 1e-4} for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))]) for k, lat, lon in rows]
    return spark.createDataFrame(shaped, "id long, height double, points array<struct<lat:double,lon:double>>")


def asked(spark, *rows):
    return spark.createDataFrame([(k, a, b, 37.5001, x, 37.5001, y, False) for k, a, b, x, y in rows], "request_id long, start string, goal string, start_lat double, start_lon double, goal_lat double, goal_lon double, gps boolean")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('store')}/s"
    tile_store.write_store(tile_store.tiled_ways(street(spark)), tile_store.tiled_buildings(house(spark)), path)
    return path


def plan(spark, store, requests):
    ship_package(spark)
    return service.plan_stored(spark, store, requests, walking.no_policy(spark), F.lit(10.0), F.lit(10.0))


def test_ways_are_placed_without_a_join(spark):
    """A way's tiles come of its own points: the table is worked out once, and ways that share an id don't get each other's tiles."""
    ways = street(spark, 1).unionByName(street(spark, 30).where("id = 30").withColumn("id", F.lit(1).cast("long"))).unionByName(street(spark, 1).withColumn("id", F.lit(None).cast("long")))
    placed = tile_store.tiled_ways(ways)
    assert "Join" not in placed._jdf.queryExecution().optimizedPlan().toString() and placed.columns == [*ways.columns, "tile_id"]
    tile = lambda p: f"15-{int((p.lon + 180) / 360 * 32768)}-"
    rows = placed.collect()
    assert len(rows) == 2 and len({r.tile_id for r in rows}) == 2 and all(r.tile_id.startswith(tile(r.points[0])) for r in rows)


def test_tiles_beyond_the_map_projection_are_stored_too(spark, tmp_path):
    """North of 85 degrees tile numbers are less than 0."""
    north = street(spark, 3).withColumn("points", F.transform("points", lambda p: F.struct((p["lat"] + 48.0).alias("lat"), p["lon"].alias("lon"))))
    ways, path = street(spark, 3).unionByName(north.withColumn("id", F.col("id") + 10)), f"file://{tmp_path}/s"
    tile_store.write_store(tile_store.tiled_ways(ways), tile_store.tiled_buildings(house(spark)), path)
    catalogue = spark.read.parquet(f"{path}/catalogue")
    assert tile_store.whole(spark, path) and catalogue.where("tile_id like '15-%--%' and south > 85 and north > south").count() > 0
    chosen = catalogue.select(F.lit(1).alias("request_id"), "tile_id", F.lit("OK").alias("status"))
    assert sorted(r.id for r in tile_store.read_chosen(spark, path, "ways", chosen).collect()) == [1, 2, 3, 11, 12, 13]


def test_only_chosen_partitions_are_read(spark, store):
    catalogue = spark.read.parquet(f"{store}/catalogue")
    requests = asked(spark, (1, "a", "b", 127.001, 127.002))
    chosen, judged = tile_store.chosen_tiles(requests, catalogue)
    assert judged.first().status == "OK" and 0 < chosen.count() < catalogue.count()
    ways = tile_store.read_chosen(spark, store, "ways", chosen)
    plan = ways._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "PartitionFilters" in plan
    wanted = {r.tile_id for r in chosen.collect()}
    held = {r.id for r in spark.read.parquet(f"{store}/ways").where(F.col("tile_id").isin(*wanted)).collect()}
    assert {r.id for r in ways.collect()} == held and len(held) < 40
    assert ways.count() == len(held)  # each way once, though it is in several tiles


def test_folders_are_those_of_zones(spark, tmp_path):
    """A store over 48 by 48 tiles has few folders, and requests still get the elements of their own tiles only."""
    point = lambda k, n: {"lat": 37.5 + k * 0.0085, "lon": 127.0 + n * 0.011}
    rows = [(50 * k + n + 1, [2 * (50 * k + n), 2 * (50 * k + n) + 1], [point(k, n), point(k, n + 0.01)], False, False, False, "both") for k in range(48) for n in range(48)]
    path = f"file://{tmp_path}/s"
    tile_store.write_store(tile_store.tiled_ways(spark.createDataFrame(rows, street(spark, 1).schema)), tile_store.tiled_buildings(house(spark)), path)
    catalogue = spark.read.parquet(f"{path}/catalogue")
    folders = list((tmp_path / "s/ways").glob("*=*"))
    assert catalogue.count() > 2000 and len(folders) <= 16 and tile_store.whole(spark, path)
    chosen, _ = tile_store.chosen_tiles(asked(spark, (1, "a", "b", 127.001, 127.002)), catalogue)
    wanted = {r.tile_id for r in chosen.collect()}
    held = {r.id for r in spark.read.parquet(f"{path}/ways").collect() if r.tile_id in wanted}
    assert {r.id for r in tile_store.read_chosen(spark, path, "ways", chosen).collect()} == held and 0 < len(held) < 60


def test_statuses_of_tiles(spark, store, monkeypatch):
    catalogue = keep(spark.read.parquet(f"{store}/catalogue"))
    requests = asked(spark, (1, "a", "b", 127.001, 127.002), (2, "a", "b", 120.0, 120.001), (3, "a", "b", 127.001, 127.039))
    status = lambda c=catalogue: {r.request_id: r.status for r in tile_store.chosen_tiles(requests, c)[1].collect()}
    assert status() == {1: "OK", 2: "AREA_DATA_UNAVAILABLE", 3: "OK"}
    last = catalogue.orderBy(F.desc("west")).first().tile_id
    broken = catalogue.withColumn("problem", F.when(F.col("tile_id") == last, "ROUTE_ARTIFACT_MISMATCH"))
    assert status(broken) == {1: "OK", 2: "AREA_DATA_UNAVAILABLE", 3: "ROUTE_ARTIFACT_MISMATCH"}
    monkeypatch.setattr(tiles, "MOST_PER_REQUEST", 3)
    assert status()[3] == "ROUTE_TOO_LARGE"


@pytest.mark.parametrize("limit", ["tile_ways", "tile_way_points", "tile_buildings", "tile_building_points", "way_points_per_element", "building_points_per_element", "route_ways", "route_way_points", "route_buildings", "route_building_points"])
def test_limits_of_tiles_and_requests(spark, monkeypatch, limit):
    monkeypatch.setitem(guards.LIMITS, limit, 0 if "building" in limit else 1)
    ways, buildings = tile_store.tiled_ways(street(spark, 6)), tile_store.tiled_buildings(house(spark))
    catalogue = keep(tile_store.catalogue_of(ways, buildings))
    got = tile_store.chosen_tiles(asked(spark, (1, "a", "b", 127.001, 127.002)), catalogue)[1].first().status
    assert got == ("INVALID_TILE_DATA" if "element" in limit else "ROUTE_DATA_TOO_COMPLEX")


@pytest.mark.parametrize("limit, most", [("graph_nodes", 5), ("graph_edges", 5), ("graph_node_degree", 1), ("graph_components", 0), ("route_segments", 2)])
def test_limits_of_graphs(spark, store, monkeypatch, limit, most):
    monkeypatch.setitem(guards.LIMITS, limit, most)
    assert plan(spark, store, asked(spark, (1, "a", "b", 127.0011, 127.0089)))[1].first().status == "ROUTE_DATA_TOO_COMPLEX"


def test_limit_of_shadows_near_a_point(spark, tmp_path, monkeypatch):
    from penumbra.operators import shade

    monkeypatch.setattr(shade, "MOST_CANDIDATES", 2)
    houses = house(spark, [(k, 37.49995, 127.002) for k in range(1, 4)])
    path = f"file://{tmp_path}/s"
    tile_store.write_store(tile_store.tiled_ways(street(spark, 10)), tile_store.tiled_buildings(houses), path)
    assert plan(spark, path, asked(spark, (1, "a", "b", 127.0011, 127.0089)))[1].first().status == "ROUTE_DATA_TOO_COMPLEX"


def test_plans_from_a_store(spark, store):
    requests = asked(
        spark, (1, "a", "b", 127.0011, 127.0089), (2, "a", "a", 127.001, 127.001), (3, "a", "b", 127.001, 127.039), (4, "a", "b", 120.0, 120.001), (5, "a", "b", 127.0011, 127.0011), (6, "a", "b", None, 127.001))
    routes, status, segments = plan(spark, store, requests)
    assert {r.request_id: r.status for r in status.collect()} == {1: "OK", 2: "SAME_PLACE", 3: "ROUTE_TOO_LONG", 4: "AREA_DATA_UNAVAILABLE", 5: "ALREADY_NEAR_GOAL", 6: "UNKNOWN_PLACE"}
    metres = 0.0078 * 111320 * 0.79337
    assert {(r.request_id, r["mode"]) for r in routes.collect()} == {(1, m) for m in overlay.MODES} and all(abs(r.length_m - metres - 22) < 2 for r in routes.collect())
    assert {r.request_id for r in segments.collect()} == {1}


def test_a_walk_that_is_too_long(spark, tmp_path):
    """Ends are near, but the way between them leads around."""
    point = lambda x, y: {"lat": 37.5 + y * 1e-3, "lon": 127.0 + x * 1e-3}
    corners = [(0, 0), (0, 8), (2, 8), (2, 1), (4, 1), (4, 8), (9, 8), (9, 0)]
    rows = [(k + 1, [k + 1, k + 2], [point(*a), point(*b)], False, False, False, "both") for k, (a, b) in enumerate(zip(corners, corners[1:]))]
    ways = spark.createDataFrame(rows, street(spark, 1).schema)
    path = f"file://{tmp_path}/s"
    tile_store.write_store(tile_store.tiled_ways(ways), tile_store.tiled_buildings(house(spark)), path)
    requests = spark.createDataFrame([(1, "a", "b", 37.5, 127.0, 37.5, 127.009, False)], asked(spark, (1, "a", "b", 1.0, 1.0)).schema)
    assert plan(spark, path, requests)[1].first().status == "ROUTE_TOO_LONG"


def test_every_request_is_routed_whatever_tiles_it_meets(spark, monkeypatch):
    """The limits of one request's tiles are a service's; the costs of a table of requests are those of its SQL, which knows no tiles."""
    import duckdb

    from penumbra.plans import registry

    for limit in ("MOST_PER_REQUEST", "MOST_BYTES"):
        monkeypatch.setattr(tiles, limit, 1)
    for limit in ("tile_ways", "tile_buildings", "route_ways", "route_buildings", "route_way_points", "route_building_points"):
        monkeypatch.setitem(guards.LIMITS, limit, 1)
    sf = "/root/testdata/sf0.001"
    got = {(r.request_id, r["mode"]): r.cost for r in walking.stored_route_costs(spark, sf).collect()}
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
        want = con.sql(f"SELECT request_id, mode, cost FROM ({registry.ORACLES['stored_route_costs']})").fetchall()
    assert len(want) == len(got) > 0 and all(abs(got[r, m] - c) < 1e-3 for r, m, c in want)


def best(spark, tmp_path, nodes, ways, requests):
    """{(request_id, mode): cost} over a store of ways (id, a, b, covered, direction) between nodes {id: (x, y)} in metres."""
    ship_package(spark)
    at = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in nodes.items()], "id long, x double, y double").select("id", "x", "y", F.struct(geo.to_lat(F.col("y")).alias("lat"), geo.to_lon(F.col("x")).alias("lon")).alias("p"))
    given = spark.createDataFrame(ways, "id long, a long, b long, covered boolean, direction string")
    ends = given.join(at.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(at.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
    shaped = ends.select("id", F.array("a", "b").alias("nodes"), F.array("pa", "pb").alias("points"), "covered", F.lit(False).alias("steps"), F.lit(False).alias("fallback"), "direction")
    path = f"file://{tmp_path}/s"
    tile_store.write_store(tile_store.ways_at_points(shaped), tile_store.tiled_buildings(house(spark)), path)
    placed = lambda name, axes: at.select(F.col("id").alias(name), geo.to_x(F.col("p.lon")).alias(f"{axes}x"), geo.to_y(F.col("p.lat")).alias(f"{axes}y"))
    asked = spark.createDataFrame(requests, "request_id long, start long, goal long").join(placed("start", "s"), "start").join(placed("goal", "g"), "goal")
    return {(r.request_id, r["mode"]): r.cost for r in service.best_costs(spark, path, asked, walking.no_policy(spark), F.lit(10.0), F.lit(10.0), 200.0).collect()}


def test_routes_may_lead_away_from_their_ends(spark, tmp_path):
    """The only way of request 1 leads 2.5 km away; the shaded one of request 2 does and is the better there; from 3's start nothing leads on, and no way joins 4's ends."""
    nodes = {1: (0, 0), 2: (100, 0), 3: (0, 2500), 4: (100, 2500), 11: (2000, 0), 12: (3500, 0), 13: (2000, 2000), 14: (3500, 2000), 21: (0, -2000), 22: (100, -2000)}
    ways = [(1, 1, 3, False, "both"), (2, 3, 4, False, "both"), (3, 4, 2, False, "both"), (4, 11, 12, False, "both"), (5, 11, 13, True, "both"), (6, 13, 14, True, "both"), (7, 14, 12, True, "both"), (8, 21, 22, False, "backward")]
    got = best(spark, tmp_path, nodes, ways, [(1, 1, 2), (2, 11, 12), (3, 21, 22), (4, 22, 1)])
    want = {(1, "shortest"): 5100, (1, "balanced"): 2 * 5100, (1, "maxShade"): 4 * 5100, (2, "shortest"): 1500, (2, "balanced"): 2 * 1500, (2, "maxShade"): 5500}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k] / 1.25) < 1e-3 for k in want)


def test_routes_lead_over_a_pole(spark, tmp_path):
    """Rows of the sample's grid go on beyond 90 degrees, where tiles are tiny, and a way from one row to the next would span more of them than an element may."""
    nodes = {gy: (0, (37.49 + gy * 4.5e-4 - geo.CENTRE_LAT) * geo.METRES_LAT) for gy in range(116680, 116700)}
    got = best(spark, tmp_path, nodes, [(gy, gy, gy + 1, False, "both") for gy in range(116680, 116699)], [(1, 116680, 116699)])
    metres = 19 * 4.5e-4 * geo.METRES_LAT
    assert {k: round(c, 4) for k, c in got.items()} == {(1, m): round(f * metres / 1.25, 4) for m, f in (("shortest", 1), ("balanced", 2), ("maxShade", 4))}


def test_files_are_checked_before_they_are_stored(spark, tmp_path):
    tile = lambda k, **more: {"schema": 2, "id": f"15-1-{k}", "w": [[5, 1, [1, 2], [37500000, 127000000, 37500100, 127000100]]], "b": [[9, None, 3, [1, 2, 3, 4, 5, 6]]]} | more
    contents = {1: json.dumps(tile(1)), 2: json.dumps(tile(2)), 3: json.dumps(tile(4)), 5: json.dumps(tile(5, w=[[5, 9, [1, 2], [1, 2, 3, 4]]])), 6: "{}", 7: json.dumps(tile(7, b=[[9, -1, 3, [1, 2, 3, 4, 5, 6]]]))}
    for k, text in contents.items():
        (tmp_path / f"15-1-{k}.json").write_text(text)
    files = keep(readers.read_whole(spark, str(tmp_path)))
    sums = {r.path.rsplit("-", 1)[1][:-5]: r.sha256 for r in files.collect()}
    declared = spark.createDataFrame([(f"15-1-{k}", 1, "0" * 64 if k == 2 else sums.get(str(k), "1" * 64)) for k in (1, 2, 3, 5, 6, 7, 8)], "id string, bytes long, sha256 string")
    none = spark.createDataFrame([], "way_id long")
    ways, buildings, problems = tile_store.from_files(files, declared, none, none)
    assert {r.tile_id: r.problem for r in problems.collect()} == {"15-1-2": "ROUTE_ARTIFACT_MISMATCH", "15-1-3": "INVALID_TILE_DATA", "15-1-5": "INVALID_TILE_DATA", "15-1-6": "INVALID_TILE_DATA", "15-1-7": "INVALID_TILE_DATA", "15-1-8": "TILE_LOAD_FAILED"}
    assert [(r.tile_id, r.id, r.covered) for r in ways.collect()] == [("15-1-1", 5, True)] and [r.id for r in buildings.collect()] == [9]
    path = f"file://{tmp_path}/out"
    tile_store.write_store(ways, buildings, path, problems)
    found = {r.tile_id: (r.problem, r.ways) for r in spark.read.parquet(f"{path}/catalogue").collect()}
    assert found["15-1-1"] == (None, 1) and found["15-1-8"] == ("TILE_LOAD_FAILED", 0) and len(found) == 7 and tile_store.whole(spark, path)


def test_buildings_outside_of_the_boundary_have_no_tile(spark):
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((37.0, 127.0), (37.0, 128.0), (38.0, 128.0), (38.0, 127.0))))
    placed = tile_store.tiled_buildings(house(spark, [(1, 37.5, 127.5), (2, 38.5, 127.5)]), F.array(F.array(ring)))
    assert [r.id for r in placed.collect()] == [1] and tile_store.tiled_buildings(house(spark, [(1, 37.5, 127.5), (2, 38.5, 127.5)])).count() == 2


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "check", "_write_text", "_replace", "after"])
def test_a_stop_at_any_step_leaves_a_whole_release(spark, tmp_path, monkeypatch, step):
    root = f"file://{tmp_path}/r"

    def publish(n, stop=None):
        def write(folder):
            spark.range(n).write.parquet(f"{folder}/a")
            if stop == "write":
                raise Stopped
            spark.range(n).write.parquet(f"{folder}/b")

        def check(folder):
            if stop == "check":
                raise Stopped
            return spark.read.parquet(f"{folder}/a").count() == spark.read.parquet(f"{folder}/b").count() == n

        return releases.publish_release(spark, root, write, check)

    def read():
        folder = releases.current_release(spark, root)
        return spark.read.parquet(f"{folder}/a").count(), spark.read.parquet(f"{folder}/b").count()

    assert releases.current_release(spark, root) is None
    publish(3)
    assert read() == (3, 3)
    if step.startswith("_"):
        def fail(*a):
            raise Stopped
        monkeypatch.setattr(releases, step, fail)
    try:
        publish(5, step)
    except Stopped:
        assert read() == (3, 3)
    else:
        assert step == "after" and read() == (5, 5)
    monkeypatch.undo()
    publish(7)
    assert read() == (7, 7)
    releases.drop_old_releases(spark, root, keep=1)
    assert read() == (7, 7) and len(list((tmp_path / "r/versions").iterdir())) == 1
    with pytest.raises(ValueError, match="verify"):
        releases.publish_release(spark, root, lambda folder: spark.range(1).write.parquet(f"{folder}/a"), lambda folder: False)
    assert read() == (7, 7)


def test_overlay_costs_are_those_of_the_whole_corridor(spark):
    from penumbra.operators import routing
    from penumbra.plans.lens import view

    sf = "/root/testdata/sf0.001"
    ship_package(spark)
    edges = keep(walking._edges(spark, sf).join(walking.shaded_edges(spark, sf), "edge_id"))
    asked = keep(walking.asked(spark, sf))
    cells = keep(overlay.pack(edges))
    new = keep(overlay.routes(overlay.ends_at_nodes(asked), cells, keep(overlay.shortcuts(cells))))
    old = keep(routing.route_paths(asked, edges, view(spark, sf, "nodes")))
    total = lambda t: {(r.request_id, r["mode"]): round(r.c, 6) for r in t.groupBy("request_id", "mode").agg(F.max("cost").alias("c")).collect()}
    assert total(new) == total(old) and new.count() == old.count()
    # Paths hang together and their edges' own costs add up.
    ways = {}
    for r in sorted(new.collect(), key=lambda r: (r.request_id, r["mode"], r.seq)):
        ways.setdefault((r.request_id, r["mode"]), []).append(r)
    ends = {r.request_id: (r.start, r.goal) for r in asked.collect()}
    for (request, _), way in ways.items():
        assert (way[0].from_node, way[-1].to_node) == ends[request] and all(a.to_node == b.from_node for a, b in zip(way, way[1:]))
    costs = {r.edge_id: r.c for r in edges.select("edge_id", overlay.costs_of(*(F.col(c) for c in ("length", "steps", "fallback", "shade"))).alias("c")).collect()}
    assert all(abs(sum(costs[r.edge_id][overlay.MODES.index(mode)] for r in way) - way[0].cost) < 1e-6 for (_, mode), way in ways.items())
    sent = cells.count() + overlay.pack(edges).count() + asked.count()
    corridor = routing.corridor_cells(asked, 600.0, routing.LONGEST_M).select("request_id", "cx", "cy").join(edges.select(routing._cell("ax", 600.0).alias("cx"), routing._cell("ay", 600.0).alias("cy")), ["cx", "cy"]).count()
    assert 10 * sent < corridor


def test_cell_numbers(spark):
    r = spark.range(1).select(overlay.cell_of(F.lit(0.0), F.lit(0.0)).alias("c"), geo.tile_x(F.lit(geo.CENTRE_LON)).alias("x"), geo.tile_y(F.lit(geo.CENTRE_LAT)).alias("y")).first()
    assert r.c == r.x * overlay.ROWS_OF_TILES + r.y
