"""The adaptive grid against brute force, with a spot that holds most boxes, and how evenly its work is dealt."""

import random

import pytest
from pyspark.sql import functions as F

from penumbra.operators import spatial


def scene(seed, n_points, n_boxes, corner):
    """Points and boxes over a square, ``corner`` of the boxes and a third of the points around one street corner."""
    r = random.Random(seed)
    at = lambda hot: (400 + r.uniform(-3, 3), 400 + r.uniform(-3, 3)) if hot else (r.uniform(0, 1000), r.uniform(0, 1000))
    points = [(k, *at(k % 3 == 0)) for k in range(n_points)]
    boxes = [(k, x, y, x + r.uniform(1, 30), y + r.uniform(1, 30)) for k in range(n_boxes) for x, y in [at(k < corner)]]
    return points, boxes


def frames(spark, points, boxes):
    return spark.createDataFrame(points, "p int, px double, py double"), spark.createDataFrame(boxes, "b int, minx double, miny double, maxx double, maxy double")


def inside(points, boxes):
    return sorted((p, b) for p, x, y in points for b, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)


@pytest.mark.parametrize("pairs, levels", [(200, 4), (200, 1), (50, 2), (10**9, 4)])
def test_split_cells_give_each_pair_once(spark, monkeypatch, pairs, levels):
    monkeypatch.setattr(spatial, "PAIRS", pairs)
    monkeypatch.setattr(spatial, "LEVELS", levels)
    points, boxes = scene(7, 300, 200, 80)
    points += [(999, None, 5.0), (998, 100.0, 100.0), (997, -50.0, -50.0)]
    boxes += [(999, 0.0, 0.0, 1000.0, 1000.0), (998, 100.0, 100.0, 100.0, 100.0)]
    p, b = frames(spark, points, boxes)
    real = [x for x in points if x[1] is not None]
    assert (spatial.split_cells(p, b, 50.0) is None) == (pairs == 10**9)
    assert sorted((r.p, r.b) for r in spatial.points_in_boxes(p, b, 50.0).collect()) == inside(real, boxes)
    near = spatial.points_in_boxes(p, b, 50.0, how="left_semi", when=F.col("b") != 999)
    assert sorted(r.p for r in near.collect()) == sorted({k for k, other in inside(real, boxes) if other != 999}) and near.columns == p.columns


@pytest.mark.parametrize("pairs", [200, 10**9])
def test_tasks_of_the_join_grow_with_the_rows(spark, monkeypatch, pairs):
    """However small the shuffle files are, rows are counted: no task of the join gets all of them."""
    from penumbra import session

    monkeypatch.setattr(spatial, "PAIRS", pairs)
    monkeypatch.setattr(session, "ROWS_A_TASK", 50, raising=False)
    points, boxes = scene(5, 300, 200, 80)
    joined = spatial.points_in_boxes(*frames(spark, points, boxes), 50.0)
    assert sorted((r.p, r.b) for r in joined.collect()) == inside(points, boxes)
    assert joined.rdd.getNumPartitions() >= 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ten_thousand_boxes_on_a_corner_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS", 400_000)
    points, boxes = scene(3, 30_000, 10_000, 10_000)
    p, b = frames(spark, points, boxes)
    base, leaves = spatial.split_cells(p, b, 25.0)
    assert base.count() >= 1 and leaves.agg(F.max("parts")).first()[0] > 1
    # Pairs that meet in each group of the join: none has over twice the bound, and tasks have about as many.
    cells = F.array(*(spatial._point_cell(k, 25.0, "px", "py") for k in range(1, spatial.LEVELS + 1)))
    dealt = p.select("px", "py", F.explode(cells).alias("c")).select("px", "py", "c.*").join(leaves, spatial._KEY).withColumn("part", F.pmod(F.xxhash64("px", "py"), "parts"))
    loads = dealt.groupBy(*spatial._KEY, "part").agg(F.count("*").alias("n_points"))
    rows = spatial._finer(spatial._box_rows(b, 25.0, ("minx", "miny", "maxx", "maxy")).join(base, spatial._KEY, "left_semi"), 1, 25.0, ("minx", "miny", "maxx", "maxy"))
    for level in range(2, spatial.LEVELS + 1):
        rows = rows.unionByName(spatial._finer(spatial._box_rows(b, 25.0, ("minx", "miny", "maxx", "maxy")).join(base, spatial._KEY, "left_semi"), level, 25.0, ("minx", "miny", "maxx", "maxy")))
    pairs = loads.join(rows.groupBy(*spatial._KEY).agg(F.count("*").alias("n_boxes")), spatial._KEY).select(*spatial._KEY, "part", (F.col("n_points") * F.col("n_boxes")).alias("pairs"))
    assert pairs.agg(F.max("pairs")).first()[0] <= 2 * spatial.PAIRS
    tasks = [r.n for r in pairs.repartition(8, *spatial._KEY, "part").groupBy(F.spark_partition_id()).agg(F.sum("pairs").alias("n")).collect()]
    assert len(tasks) == 8 and max(tasks) <= 2 * sorted(tasks)[len(tasks) // 2]
    want = inside(points[:60], boxes)
    got = spatial.points_in_boxes(p, b, 25.0).where("p < 60")
    assert got.count() == len(want) and sorted((r.p, r.b) for r in got.where("p < 9").collect()) == [x for x in want if x[0] < 9]


def test_boxes_of_a_small_file_are_not_broadcast(spark, tmp_path):
    points, boxes = scene(5, 200, 100, 0)
    for name, f in zip("pb", frames(spark, points, boxes)):
        f.write.parquet(f"{tmp_path}/{name}")
    p, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in "pb")
    near = spatial.points_in_boxes(p, b, 1.0)  # a hundred boxes, but tens of thousands of cells
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.p, r.b) for r in near.collect()) == inside(points, boxes)


def test_cells_of_points_and_boxes_are_counted_without_a_join(spark, monkeypatch):
    """The base cells of both sides go through one sum, so no task sorts both to join them."""
    plans, keep = [], spatial.keep
    monkeypatch.setattr(spatial, "keep", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    points, boxes = scene(9, 300, 200, 0)
    lone = [(999, 5000.0, 5000.0)], [(999, -900.0, -900.0, -890.0, -890.0)]  # a cell of points only, and one of boxes only
    p, b = frames(spark, points + [(998, None, 1.0)] + lone[0], boxes + lone[1])
    n_rows, split = spatial.counted_cells(p, b, 100.0)
    assert split is None and len(plans) == 1 and "Join" not in plans[0]
    cells = sum((int(x1 // 100) - int(x0 // 100) + 1) * (int(y1 // 100) - int(y0 // 100) + 1) for _, x0, y0, x1, y1 in boxes + lone[1])
    assert n_rows == len(points) + 1 + cells
