"""Queries that must look at all of their input, on tables of our own."""

from penumbra.plans import walking

SF = "/root/testdata/sf0.001"


def test_requests_up_to_the_longest_route(spark, monkeypatch):
    far = [(k, k, k + 1, 0.0, 0.0, d, 0.0) for k, d in ((10, 100.0), (20, 1600.0), (200, 2999.0), (210, 3001.0))]
    placed = spark.createDataFrame([*far, (220, 5, 5, 0.0, 0.0, 0.0, 0.0)], "request_id long, start long, goal long, sx double, sy double, gx double, gy double")
    monkeypatch.setattr(walking, "placed_requests", lambda spark, sf: placed)
    assert sorted(r.request_id for r in walking.asked(spark, SF).collect()) == [10, 20, 200]


def test_blocked_nodes_of_all_ways(spark, monkeypatch):
    tables = {"nodes": spark.createDataFrame([(5,), (6,), (102,), (199,)], "id long"), "ways": spark.createDataFrame([(1, 5), (2, 6), (3, 102)], "way_id long, node_id long")}
    monkeypatch.setattr(walking, "view", lambda spark, sf, name: tables[name])
    assert sorted(r.node_id for r in walking.blocked_nodes_referenced(spark, SF).collect()) == [5, 102]
