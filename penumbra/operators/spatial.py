"""Range joins as equality joins on grid cells, with full cells split as in a quadtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded, by_rows, keep

#: Pairs of points and boxes that one cell may hold; how often a fuller one is split in four before its points are dealt out.
PAIRS, LEVELS = 200_000, 4
_KEY = ["_level", "_cx", "_cy"]


def cell(value: Column, size: float) -> Column:
    return F.floor(value / float(size)).cast("long")


def with_cells(boxes: DataFrame, minx: Column, miny: Column, maxx: Column, maxy: Column, size: float) -> DataFrame:
    """One row for each grid cell that a box touches."""
    return boxes.withColumn("cell_x", F.explode(F.sequence(cell(minx, size), cell(maxx, size)))).withColumn("cell_y", F.explode(F.sequence(cell(miny, size), cell(maxy, size))))


def _box_rows(boxes: DataFrame, size: float, box) -> DataFrame:
    """Boxes once for each base cell that they touch."""
    minx, miny, maxx, maxy = (F.col(c) for c in box)
    return with_cells(boxes, minx, miny, maxx, maxy, size).withColumnsRenamed({"cell_x": "_cx", "cell_y": "_cy"}).withColumn("_level", F.lit(0))


def _finer(rows: DataFrame, level: int, size: float, box) -> DataFrame:
    """Boxes in base cells once for each cell of a finer level that they touch within that base cell."""
    parts = 1 << level
    span = lambda low, high, base: F.sequence(F.greatest(cell(F.col(low), size / parts), F.col(base) * parts), F.least(cell(F.col(high), size / parts), F.col(base) * parts + parts - 1))
    out = rows.withColumns({"_bx": F.explode(span(box[0], box[2], "_cx"))}).withColumns({"_by": F.explode(span(box[1], box[3], "_cy"))})
    return out.withColumns({"_level": F.lit(level), "_cx": F.col("_bx"), "_cy": F.col("_by")}).drop("_bx", "_by")


def _point_cell(level: int, size: float, px: str, py: str) -> Column:
    return F.struct(F.lit(level).alias("_level"), cell(F.col(px), size / (1 << level)).alias("_cx"), cell(F.col(py), size / (1 << level)).alias("_cy"))


def split_cells(points: DataFrame, boxes: DataFrame, size: float, px="px", py="py", box=("minx", "miny", "maxx", "maxy")) -> tuple[DataFrame, DataFrame] | None:
    """(base cells that are too full, the leaves that stand for them), or None if there are none."""
    return counted_cells(points, boxes, size, px, py, box)[1]


def counted_cells(points: DataFrame, boxes: DataFrame, size: float, px="px", py="py", box=("minx", "miny", "maxx", "maxy")) -> tuple[int, tuple[DataFrame, DataFrame] | None]:
    """(rows of points and of boxes by base cell, the same as ``split_cells``).

    A leaf is (_level, _cx, _cy, parts). Cells are counted, full ones split in four and counted again, LEVELS times; what is
    still full then is a spot where boxes lie on each other, and its points are dealt out in parts.
    """
    placed, celled = points.select(px, py).where(F.col(px).isNotNull() & F.col(py).isNotNull()), _box_rows(boxes.select(*box), size, box)
    full, leaves, base, n_rows = None, None, None, 0
    for level in range(LEVELS + 1):
        at = placed.select(_point_cell(0, size, px, py).alias("b"), _point_cell(level, size, px, py).alias("c"))
        rows = celled
        if full is not None:
            at = at.join(bounded(base.select(F.struct(*_KEY).alias("b"))), "b", "left_semi")
            rows = _finer(celled.join(bounded(base), _KEY, "left_semi"), level, size, box)
        # Both sides in one sum: each cell crosses one shuffle, and no task sorts the cells of both to join them.
        marked = at.select("c.*", F.lit(1).alias("n_points"), F.lit(0).alias("n_boxes")).unionByName(rows.select(*_KEY, F.lit(0).alias("n_points"), F.lit(1).alias("n_boxes")))
        counts = marked.groupBy(*_KEY).agg(F.sum("n_points").alias("n_points"), F.sum("n_boxes").alias("n_boxes"))
        if level:
            counts = counts.where("n_points > 0 and n_boxes > 0")
        if full is not None:  # only below cells that were full
            up = [F.lit(level - 1).alias("_level"), F.floor(F.col("_cx") / 2).alias("_cx"), F.floor(F.col("_cy") / 2).alias("_cy")]
            counts = counts.withColumn("_up", F.struct(*up)).join(bounded(full.select(F.struct(*_KEY).alias("_up"))), "_up", "left_semi").drop("_up")
        counts = keep(counts.withColumn("pairs", F.col("n_points") * F.col("n_boxes")))
        now = counts.where(F.col("pairs") > PAIRS)
        if level == 0:
            base = now.select(*_KEY)
            sums = counts.agg(F.sum("n_points").alias("p"), F.sum("n_boxes").alias("b")).first()
            n_rows = (sums["p"] or 0) + (sums["b"] or 0)
        else:
            light = counts.where(F.col("pairs") <= PAIRS).select(*_KEY, F.lit(1).alias("parts"))
            leaves = light if leaves is None else leaves.unionByName(light)
        if now.isEmpty():
            return n_rows, None if level == 0 else (base, leaves)
        full = now
    return n_rows, (base, leaves.unionByName(full.select(*_KEY, F.least(F.ceil(F.col("pairs") / PAIRS), "n_points").cast("int").alias("parts"))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, px="px", py="py", box=("minx", "miny", "maxx", "maxy"), how: str = "inner", when: Column | None = None) -> DataFrame:
    """Points joined with the boxes around them (``how``: inner or left_semi).

    A point has one cell, so the join is on equal cells and each pair is found once; the exact test is a residual condition.
    Cells are counted first. Those with too many pairs are split in four down to small leaves, and a spot that can't be split has its
    points dealt out, so no task gets more than about PAIRS pairs of one cell. The number of tasks grows with the rows counted, so what one of them sorts doesn't.
    """
    n_rows, split = counted_cells(points, boxes, size, px, py, box)
    placed = points.withColumns({"_level": F.lit(0), "_cx": cell(F.col(px), size), "_cy": cell(F.col(py), size), "_part": F.lit(0)})
    celled = _box_rows(boxes, size, box).withColumn("_part", F.lit(0))
    if split:
        base, leaves = (bounded(t) for t in split)
        cells = F.array(*(_point_cell(k, size, px, py) for k in range(1, LEVELS + 1)))
        dealt = placed.join(base, _KEY, "left_semi").drop(*_KEY, "_part").withColumn("_c", F.explode(cells)).withColumns({c: F.col(f"_c.{c}") for c in _KEY}).drop("_c").join(leaves, _KEY)
        dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(px, py), "parts").cast("int")).drop("parts")
        placed = placed.join(base, _KEY, "left_anti").unionByName(dealt)
        hot = celled.join(base, _KEY, "left_semi").drop("_part")
        for level in range(1, LEVELS + 1):
            there = _finer(hot, level, size, box).join(leaves, _KEY).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            celled = (celled.join(base, _KEY, "left_anti") if level == 1 else celled).unionByName(there)
    inside = (F.col(px) >= F.col(box[0])) & (F.col(px) <= F.col(box[2])) & (F.col(py) >= F.col(box[1])) & (F.col(py) <= F.col(box[3]))
    names = {f"{c}": f"{c}_of_box" for c in (*_KEY, "_part")}
    keys = [*names] if split else ["_cx", "_cy"]  # the others are constants then, which Spark leaves out of the join
    placed, celled = by_rows(placed, n_rows, *keys, joined=True), by_rows(celled.withColumnsRenamed(names), n_rows, *(names[k] for k in keys), joined=True)
    condition = inside
    for mine, theirs in names.items():
        condition = (F.col(mine) == F.col(theirs)) & condition
    # Boxes once for each cell are many more than their file tells, so Spark must not choose to broadcast them.
    joined = placed.join(celled.hint("merge"), condition if when is None else condition & when, how)
    return joined.drop(*names, *names.values())


def points_near_segments(points: DataFrame, segments: DataFrame, radius: float, size: float, px="px", py="py", ends=("ax", "ay", "bx", "by")) -> DataFrame:
    """Points joined with the segments whose box, grown by the radius, holds them."""
    ax, ay, bx, by = (F.col(c) for c in ends)
    grown = segments.withColumns({"minx": F.least(ax, bx) - radius, "maxx": F.greatest(ax, bx) + radius, "miny": F.least(ay, by) - radius, "maxy": F.greatest(ay, by) + radius})
    return points_in_boxes(points, grown, size, px, py).drop("minx", "miny", "maxx", "maxy")
