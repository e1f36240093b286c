"""Readers, writers and checks of files, graphs and routes on small inputs of our own."""

import json

import pytest
from pyspark.sql import functions as F

from penumbra.functions import rules
from penumbra.operators import boundary, graph, guards, places, routing, sequence, tiles
from penumbra.plans import service, walking
from penumbra.sources import readers, writers
from penumbra.streaming import adherence


def put(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))
    return str(folder)


def test_extracts_and_their_status(spark, tmp_path, monkeypatch):
    way = lambda k, n=2, **tags: {"type": "way", "id": k, "tags": tags, "nodes": list(range(n)), "geometry": [{"lat": 37.0, "lon": 127.0}] * n}
    monkeypatch.setattr(readers, "MOST_ELEMENTS", 3)
    where = put(tmp_path, good={"elements": [way(1, highway="path"), way(2, 1001), {"type": "node", "id": 3}]}, many={"elements": [way(k) for k in range(4)]}, odd="not json", large="x" * 2000)
    files = readers.read_whole(spark, where, most=1_000_000).cache()
    status = {r.path.rsplit("/", 1)[1]: r.status for r in readers.overpass_status(files).collect()}
    assert status == {"good.json": "OK", "many.json": "TOO_MANY_ELEMENTS", "odd.json": "UNREADABLE", "large.json": "UNREADABLE"}
    assert {r.id: r.valid for r in readers.overpass(files).collect()} == {1: True, 2: False, 3: False}
    capped = {r.path.rsplit("/", 1)[1]: (r.status, r.text is None) for r in readers.read_whole(spark, where, most=1500).collect()}
    assert capped["large.json"] == ("TOO_LARGE", True) and capped["good.json"][0] != "OK" or capped["odd.json"] == ("OK", False)
    good = files.where("path like '%odd.json'").first()
    assert readers.verified(files, spark.createDataFrame([("odd.json", good.sha256), ("many.json", "0")], "name string, sha256 string")).count() == 1


def whole_manifest():
    box = lambda: {"south": 1, "west": 1, "north": 2, "east": 2}
    file = lambda path: {"path": path, "bytes": 5, "sha256": "c" * 64}
    return {
        "schema": 3, "releaseId": "b" * 24, "zoom": 15, "coverage": box(), "generator": {"schema": 3, "script": readers.SCRIPT},
        "source": {"schema": 1, "fileName": "extract.pbf", "bytes": 7, "sha256": "d" * 64, "observedModifiedAt": "2026-07-01T02:03:04.000Z", "downloadUrl": None, "downloadedAt": None},
        "artifacts": {"places": file("places.json"), "boundary": file("boundary.json")}, "tiles": [{"id": f"15-1-{k}", "bounds": box(), "bytes": 5, "sha256": "a" * 64} for k in (2, 3)],
        "walkingPolicy": {"schema": 1, "excludedWayIds": [1, 2], "blockedNodeIds": [], "fallbackWayIds": [3], "directions": [[4, 1], [5, -1]]}}


def changed(path, value):
    """The whole manifest with one value changed, or without it."""
    out = whole_manifest()
    at, steps = out, path.split(".")
    for step in steps[:-1]:
        at = at[int(step) if step.isdigit() else step]
    last = int(steps[-1]) if steps[-1].isdigit() else steps[-1]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


#: Each rule with values that break it alone.
BROKEN = [
    ("schema", "schema", 2), ("release_id", "releaseId", "x"), ("release_id", "releaseId", "B" * 24), ("zoom", "zoom", 23), ("zoom", "zoom", -1), ("coverage", "coverage", {}), ("coverage", "coverage.south", 3), ("coverage", "coverage.east", 181),
    ("source_schema", "source.schema", 2), ("source_file", "source.fileName", "a b"), ("source_bytes", "source.bytes", 0), ("source_hash", "source.sha256", "d" * 63), ("source_modified", "source.observedModifiedAt", "yesterday"),
    ("source_modified", "source.observedModifiedAt", "2026-07-01T02:03:04.000Z" + " " * 20), ("source_url", "source.downloadUrl", "http://x"), ("source_url", "source.downloadUrl", "https://" + "x" * 2000), ("source_url", "source.downloadUrl", ...),
    ("source_downloaded", "source.downloadedAt", "never"), ("source_downloaded", "source.downloadedAt", ...), ("generator_schema", "generator.schema", 2), ("generator_script", "generator.script", "other"), ("places", "artifacts.places.path", "p.json"),
    ("places", "artifacts.places.bytes", 12_000_001), ("boundary", "artifacts.boundary.sha256", "z" * 64), ("policy_schema", "walkingPolicy.schema", 2), ("excluded_ways", "walkingPolicy.excludedWayIds", [2, 2]), ("excluded_ways", "walkingPolicy.excludedWayIds", ...),
    ("blocked_nodes", "walkingPolicy.blockedNodeIds", [0]), ("fallback_ways", "walkingPolicy.fallbackWayIds", [4, 3]), ("directions", "walkingPolicy.directions.0", [4, 2]), ("directions", "walkingPolicy.directions.0", [6, 1]), ("directions", "walkingPolicy.directions.0", [4]),
    ("n_tiles", "tiles", []), ("tile_ids", "tiles.0.id", "15-1-4"), ("tile_ids", "tiles.0.id", "15-1"), ("tile_ids", "tiles.0.id", "15-1-3"), ("tile_bounds", "tiles.0.bounds.north", 1), ("tile_bytes", "tiles.0.bytes", 2_000_001), ("tile_bytes", "tiles.0.bytes", 0), ("tile_hashes", "tiles.0.sha256", "")]


def test_manifests(spark, tmp_path):
    cases = {f"case{k:02}": changed(path, value) for k, (_, path, value) in enumerate(BROKEN)}
    m = readers.manifest_ok(readers.manifest(readers.read_whole(spark, put(tmp_path, good=whole_manifest(), odd="not json", **cases))))
    got = {r.path.rsplit("/", 1)[1][:-5]: (r.valid, r.broken) for r in m.collect()}
    assert got.pop("good") == (True, []) and not got.pop("odd")[0]
    assert got == {f"case{k:02}": (False, [rule]) for k, (rule, _, _) in enumerate(BROKEN)}
    assert {rule for rule, _, _ in BROKEN} == set(readers.manifest_rules(readers.manifest(readers.read_whole(spark, str(tmp_path)))))


def test_place_files(spark, tmp_path):
    p = lambda k, name, kind="cafe", aliases=(): {"id": f"osm-node-{k}", "name": name, "aliases": list(aliases), "kind": kind, "lat": 37.5, "lon": 127.0}
    where = put(tmp_path, places={"schema": 2, "places": [p(1, " Tea ", aliases=[" x ", ""]), p(1, "again"), p(2, "3-1. 2", "station"), p(3, "2 gate", "station"), p(4, "odd", "castle"), p(5, "7")]})
    got = {r.id: (r.name, r.aliases) for r in places.tidy_places(readers.places(readers.read_whole(spark, where))).collect()}
    assert got == {"osm-node-1": ("Tea", ["x"]), "osm-node-3": ("2 gate", []), "osm-node-5": ("7", [])}
    loaded = spark.createDataFrame([("yeoksam", "moved", [], "station", 1.0, 2.0, 0), ("new", "new", [], "cafe", 1.0, 2.0, 1)], "id string, name string, aliases array<string>, kind string, lat double, lon double, seq int")
    merged = [(r.id, r.name) for r in readers.merge_places(readers.default_places(spark), loaded).orderBy("_at").collect()]
    assert [k for k, _ in merged] == ["gangnam-11", "yeoksam", "new"] and merged[1][1] == "moved"


def test_places_of_elements(spark):
    t = [{"amenity": "cafe", "name:ko": "찻집", "name": "Tea", "name:en": "Tea", "brand": "찻집"}, {"railway": "station", "name": "12-3"}, {"addr:full": "1 Road"}, {"amenity": "cafe"}, {"shop": "x", "name": "n" * 121}]
    e = spark.createDataFrame([("way", k, x, 1.0, 2.0, k) for k, x in enumerate(t)], "type string, id long, tags map<string,string>, lat double, lon double, seq int")
    got = {r.id: (r.kind, r.name, r.aliases, r.address) for r in places.place_from(e).collect()}
    assert got == {"osm-way-0": ("cafe", "찻집", ["Tea"], None), "osm-way-2": ("address", "1 Road", [], None)}


def test_boundaries_and_weather(spark):
    one, many = '{"type":"Polygon","coordinates":[[[1,2],[3,4],[5,6],[1,2]]]}', '{"type":"MultiPolygon","coordinates":[[[[1,2],[3,4],[5,6],[1,2]]]]}'
    rows = spark.createDataFrame([(one,), (many,)], "g string").select(readers.boundary_rings(F.col("g")).alias("r")).collect()
    assert rows[0].r == rows[1].r and rows[0].r[0][0][0] == [1.0, 2.0]
    with pytest.raises(Exception, match="unsupported boundary"):
        spark.createDataFrame([('{"type":"Point"}',)], "g string").select(readers.boundary_rings(F.col("g"))).collect()
    w = spark.createDataFrame([("t", 20.0, 21.0, 3.0, True, 1), ("t", 99.0, 21.0, 3.0, True, 1), ("t", 20.0, None, 3.0, True, 1)], readers.WEATHER)
    assert [r.valid for r in readers.weather_ok(w).collect()] == [True, False, False]
    assert spark.range(1).select(*readers.weather_place(F.lit(37.4567), F.lit(127.0049))).first()[:] == (37.46, 127.0)
    a = spark.createDataFrame([("same", "x"), ("other", "y"), ("new", "z")], "name string, content string")
    b = spark.createDataFrame([("same", "x"), ("other", "Y"), ("gone", "w")], "name string, content string")
    assert sorted((r.name, r.problem) for r in boundary.drifted(a, b).collect()) == [("gone", "missing"), ("new", "unexpected"), ("other", "drifted")]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), ("b", 1, "z")], "tile_id string, id long, body string")
    writers.write_tiles(e, f"file://{tmp_path}/t", F.length("body"))
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 4
    with pytest.raises(ValueError):
        writers.write_tiles(e, f"file://{tmp_path}/u", F.lit(1_500_000))
    assert writers.legacy_tiles(e).count() == 3
    with pytest.raises(ValueError):
        writers.legacy_tiles(spark.range(33).select(F.col("id").alias("tile_id"), F.lit(1).alias("id")))
    names = spark.createDataFrame([("route_search", 1), ("unknown", 2), ("route_search", 3)], "name string, n int")
    writers.append_events(names, f"file://{tmp_path}/e")
    writers.append_events(names, f"file://{tmp_path}/e")
    assert spark.read.parquet(f"file://{tmp_path}/e").count() == 4
    long = spark.createDataFrame([("m" * 500, "c" * 60), ("m" * 501, "c"), ("m", "c" * 61)], "m string, c string")
    assert [r.s for r in long.select(writers.feedback_status(F.col("m"), F.col("c"), F.lit("good")).alias("s")).collect()] == ["OK", "INVALID_FEEDBACK", "INVALID_FEEDBACK"]


def test_a_release_comes_back_if_the_new_one_fails(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    writers.publish(spark.range(3), a, b, lambda t: True)
    seen = []
    with pytest.raises(ValueError, match="published"):
        writers.publish(spark.range(5), a, b, lambda t: seen.append(1) or len(seen) == 1)
    assert spark.read.parquet(b).count() == 3 and not (tmp_path / "b.before").exists()


def test_feedback_once_in_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", 10), (1, "p", 20), (1, "q", 30), (2, "p", 40)], "user_id long, path_key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = adherence.feedback_once(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("feedback_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user_id, r.path_key) for r in spark.table("feedback_out").collect()) == [(1, "p"), (1, "q"), (2, "p")]


def test_element_checks(spark):
    rows = spark.createDataFrame([(5, [1, 2], [1, 2, 3, 4]), (8, [1, 2], [1, 2, 3, 4]), (0, [1], [1, 2]), (0, [1, 2], [1, 2, 3]), (0, [1, 2], [1, 2, 3, 200_000_000])], "f int, n array<long>, c array<long>")
    assert [r.v for r in rows.select(guards.way_is_valid(F.col("f"), F.col("n"), F.col("c")).alias("v")).collect()] == [True, False, False, False, False]
    b = spark.createDataFrame([(None, 3.0, [1] * 6), (0.0, None, [1] * 6), (5.0, None, [1] * 4), (5.0, 301.0, [1] * 6)], "h double, l double, c array<long>")
    assert [r.v for r in b.select(guards.building_is_valid(F.col("h"), F.col("l"), F.col("c")).alias("v")).collect()] == [True, False, False, False]
    files = lambda *x: spark.createDataFrame(x, "path string, bytes long, sha256 string")
    assert sorted(tuple(r) for r in guards.verify(files(("a", 1, "x"), ("b", 2, "y"), ("n", 1, "z")), files(("a", 1, "x"), ("b", 3, "y"), ("m", 1, "q"))).collect()) == [("b", "changed"), ("m", "missing"), ("n", "unexpected")]
    with pytest.raises(ValueError):
        tiles.policy(spark.range(5).withColumn("ok", F.lit(True)), F.col("ok"), "way_id", most=4)
    assert [r.c for r in spark.createDataFrame([(5.0,), (1e4,)], "a double").select(rules.accuracy_circle(F.col("a")).alias("c")).collect()] == [5.0, 1000.0]


def test_edges_of_ways(spark):
    P = lambda n, lat, lon: {"node_id": n, "lat": lat, "lon": lon}
    ways = [
        (10, 0, [P(1, 37.5, 127.0), P(2, 37.501, 127.0), P(2, 37.501, 127.0), P(3, 37.502, 127.0)], True, "both"),
        (11, 1, [P(3, 99.0, 0.0), P(4, 37.502, 127.001), P(5, 37.502, 127.001)], True, "forward"),  # node 3 lies where the first way has it
        (12, 2, [P(1, 37.5, 127.0), P(9, 37.6, 127.0), P(2, 37.501, 127.0)], True, "both"),  # 9 is blocked
        (13, 3, [P(1, 37.5, 127.0), P(3, 37.502, 127.0)], False, "both"), (14, 4, [P(1, 37.5, 127.0), P(3, 37.502, 127.0)], True, None), (15, 5, [P(1, 37.5, 127.0), P(3, 37.502, 127.0)], True, "both"), (16, 6, [P(1, 37.5, 127.0)], True, "both")]
    w = spark.createDataFrame(ways, "way_id long, way_seq long, points array<struct<node_id:long,lat:double,lon:double>>, walkable boolean, direction string")
    excluded, blocked = spark.createDataFrame([(15,)], "way_id long"), spark.createDataFrame([(9,)], "node_id long")
    got = [(r.edge_id, r.way_id, r.a, r.b, round(r.length, 1), r.direction) for r in graph.way_edges(w, excluded, blocked).orderBy("edge_id").collect()]
    assert got == [(0, 10, 1, 2, 110.5, "both"), (2, 10, 2, 3, 110.5, "both"), (1024, 11, 3, 4, 88.3, "forward")]
    assert sorted(tuple(r) for r in graph.skipped_ways(w, excluded).collect()) == [("excluded", 1), ("impassable", 1), ("unwalkable", 1)]


def test_split_edges_keep_their_columns_and_merge_with_the_last_kept_cut(spark):
    e = spark.createDataFrame([(1, 5, 6, 10.0, True, "forward"), (2, 6, 7, 4.0, False, "both")], "edge_id long, a long, b long, length double, steps boolean, direction string")
    s = spark.createDataFrame([(1, 0.5), (1, 0.5 + 8e-10), (1, 0.5 + 16e-10), (1, 1.0), (1, 1e-12)], "edge_id long, t double")
    got = [(r.edge_id, r.piece, r.a, r.b, round(r.length, 6), r.steps, r.direction) for r in graph.split_edges(e, s).orderBy("edge_id", "piece").collect()]
    assert [x[4:] for x in got] == [(5.0, True, "forward"), (0.0, True, "forward"), (5.0, True, "forward"), (4.0, False, "both")]
    assert got[0][2] == 5 and got[0][3] == got[1][2] < 0 and got[2][3] == 6


def test_shade_ratio_is_of_time(spark):
    rows = [(1, "m", 1, 7, 100.0, False, 1.0), (1, "m", 2, 8, 100.0, True, 0.0)]  # 80 s in shade, 120 s of steps in the sun
    s = routing.summaries(spark.createDataFrame(rows, "request_id long, mode string, seq int, edge_id long, length double, steps boolean, shade double"))
    r = s.first()
    assert (r.time_sec, r.length_m, r.sun_sec, r.shade_ratio, r.path_key) == (200, 200, 120, 0.4, "7:8")
    r = routing.with_access(s, F.lit(50.0), F.lit(0.4)).first()
    assert (r.time_sec, r.length_m, r.sun_sec, r.shade_ratio) == (240, 250, 160, 0.333)
    first = service.rank_routes(spark.createDataFrame([(1, "balanced"), (1, "maxShade"), (2, "shortest")], "request_id int, mode string"), "maxShade")
    assert sorted(tuple(x) for x in first.collect()) == [(1, "maxShade"), (2, "shortest")]


def test_planned_segments_chain_and_add_up(spark):
    routes, status, segments = walking._planned(spark, "/root/testdata/sf0.001")
    length = {(r.request_id, r.mode): r.length_m for r in routes.collect()}
    metres = segments.withColumn("m", F.hypot((F.col("to_lat") - F.col("from_lat")) * 110540.0, (F.col("to_lon") - F.col("from_lon")) * 111320.0 * F.cos(F.radians(F.lit(37.498)))))
    total = {(r.request_id, r.mode): r.m for r in metres.groupBy("request_id", "mode").agg(F.sum("m").alias("m")).collect()}
    assert total.keys() == length.keys() and all(abs(total[k] - length[k]) < 1.5 for k in length)
    one = segments.withColumn("route_id", F.concat_ws(":", "request_id", "mode"))
    rounded = one.withColumns({c: F.round(c, 7) for c in ("from_lat", "from_lon", "to_lat", "to_lon")})
    assert sequence.continuity(rounded).where("breaks > 0").count() == 0
    known = {"OK", "SNAP_FAILED", "ALREADY_NEAR_GOAL", "EMPTY_GRAPH", "ROUTE_TOO_LONG"}
    assert {r.status for r in status.collect()} <= known


def test_planned_statuses(spark, monkeypatch):
    nodes = spark.createDataFrame([(k, 100.0 * k, 0.0) for k in range(4)] + [(8, 0.0, 60.0), (9, 300.0, 60.0)], "id long, x double, y double")
    rows = [(k, k, k + 1, 100.0 * k, 0.0, 100.0 * k + 100, 0.0, 100.0, 0) for k in range(3)] + [(7, 8, 9, 0.0, 60.0, 300.0, 60.0, 300.0, 8)]
    edges = spark.createDataFrame(rows, "edge_id long, a long, b long, ax double, ay double, bx double, by double, length double, component long")
    edges = edges.withColumns({"covered": F.lit(False), "steps": F.lit(False), "fallback": F.lit(False), "direction": F.lit("both"), "shade": F.lit(0.0)})
    asked = [(1, 10.0, -5.0, 290.0, -5.0), (2, 50.0, -5.0, 50.0, -9.0), (3, 50.0, 90_000.0, 60.0, 90_000.0), (4, 10.0, -5.0, 10.0, 800.0)]
    requests = spark.createDataFrame(asked, "request_id long, sx double, sy double, gx double, gy double").withColumn("gps", F.lit(False))
    no_shade = lambda pieces: pieces.select("id", F.lit(0.0).alias("shade_ratio"))
    plan = lambda: service.plan_routes(requests, edges, no_shade)
    routes, status, _ = plan()
    assert dict(tuple(r) for r in status.collect()) == {1: "OK", 2: "ALREADY_NEAR_GOAL", 3: "EMPTY_GRAPH", 4: "SNAP_FAILED"}
    assert {(r.request_id, r.length_m) for r in routes.collect()} == {(1, 290)}
    assert {r.request_id: r.n_edges for r in routing.corridor_sizes(requests, edges, nodes).collect()} == {1: 4, 2: 4, 3: 0, 4: 4}
    monkeypatch.setitem(guards.LIMITS, "route_segments", 2)
    assert dict(tuple(r) for r in plan()[1].collect())[1] == "ROUTE_DATA_TOO_COMPLEX"
    monkeypatch.setitem(guards.LIMITS, "graph_edges", 3)
    routes, status, _ = plan()
    assert {r.status for r in status.collect()} == {"ROUTE_DATA_TOO_COMPLEX", "EMPTY_GRAPH"} and routes.count() == 0


def test_labels_of_kinds(spark):
    rows = [("medical", "Street 1"), ("education", None), ("office", ""), (None, "Street 2"), ("other", None)]
    got = spark.createDataFrame(rows, "kind string, address string").select(places.description(F.col("kind"), F.col("address"))).collect()
    assert [r[0] for r in got] == ["병원·약국 · Street 1", "학교·도서관", "회사", "장소 · Street 2", "장소"]
