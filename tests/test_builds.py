"""Counters of a build from raw elements, and quotas of kinds against sorting everything."""

import random

from pyspark.sql import functions as F

from penumbra.operators import places, tiles


def square(spark):
    corner = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    return F.array(F.array(F.array(corner(0.0, 0.0), corner(0.0, 10.0), corner(10.0, 10.0), corner(10.0, 0.0))))


def test_geometry_of_ways(spark):
    nodes = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 40.0, 40.0), (4, 3.0, 1.0), (4, 3.0, 1.0), (None, 5.0, 5.0)], "id long, lat double, lon double")
    refs = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (11, 3), (12, 3), (12, 3), (13, 1), (13, 99), (14, 99), (15, 1), (15, 2), (15, 4), (15, 1), (16, None)], "way_id long, node_id long")
    got = {r.way_id: tuple(r)[1:] for r in tiles.way_geometry(refs, nodes, square(spark)).collect()}
    assert got == {
        10: (2, 2, True, True), 11: (2, 2, True, False), 12: (2, 2, False, False), 13: (2, 1, True, True), 14: (1, 0, False, False), 15: (4, 4, True, True), 16: (1, 0, False, False)}


def test_counters_of_a_build(spark):
    nodes = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 40.0, 40.0), (4, 3.0, 1.0)], "id long, lat double, lon double")
    refs = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (11, 3), (11, 3), (13, 1), (13, 99), (15, 1), (15, 2), (15, 4), (15, 1), (18, 1), (18, 2)], "way_id long, node_id long")
    ways = spark.createDataFrame(
        [(10, True, True, False), (11, False, False, True), (13, True, True, False), (15, False, False, True), (17, True, True, False), (18, False, False, False)],
        "id long, candidate boolean, walkable boolean, is_building boolean")
    e = tiles.build_elements(refs, nodes, ways, square(spark), (0.0, 0.0, 10.0, 10.0))
    # 11 touches the area, but its mean is outside: no building there. 13 misses a node, 17 has no points, 18 is neither way nor building.
    assert tiles.build_stats(e).first().asDict() == {"parsed": 10, "kept_nodes": 3, "walkways": 1, "buildings": 1, "missing_geometry": 2}
    empty = tiles.build_elements(refs.limit(0), nodes.limit(0), ways.limit(0), square(spark), (0.0, 0.0, 1.0, 1.0))
    assert set(tiles.build_stats(empty).first()) == {0}


def test_quotas_equal_sorting_everything(spark):
    r = random.Random(4)
    rows = [(k, r.choice(["station"] * 6 + ["food", "cafe", None]), f"n{r.randrange(300):03d}") for k in range(3000)]
    quotas, most = {"station": 7, "food": 30}, 60
    table = spark.createDataFrame(rows, "id long, kind string, name string").repartition(7)
    got = places.within_quotas(table, quotas, most, [F.col("name"), F.col("id")]).collect()
    seen, marked = {}, []
    for k, kind, name in sorted(rows, key=lambda x: (x[2], x[0])):
        seen[kind] = seen.get(kind, 0) + 1
        marked.append((seen[kind] > quotas.get(kind, most), name, k))
    assert [(x.overflow, x.name, x.id) for x in got] == sorted(marked)[:most]
    assert places.within_quotas(table.limit(0), quotas, most, [F.col("name"), F.col("id")]).count() == 0


def test_policy_ids_have_no_limit_of_their_own(spark):
    ids = tiles.policy_ids(spark.range(3 * tiles.MOST_POLICY).withColumn("ok", F.col("id") % 2 == 0), F.col("ok"), "way_id")
    assert ids.count() == 3 * tiles.MOST_POLICY // 2
