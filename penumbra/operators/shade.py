"""Shadows of buildings and the shaded share of walkway edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.types import POINTS
from .spatial import points_in_boxes

#: Metres between samples of an edge, most samples of an edge, most shadows near a point.
SAMPLE_M, MOST_SAMPLES, MOST_CANDIDATES = 10.0, 100, 512


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull without points on its sides; fewer than three distinct points come back in order."""
    todo = sorted(set(points))
    if len(todo) < 3:
        return todo

    def half(run):
        out: list[tuple[float, float]] = []
        for x, y in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return half(todo) + half(todo[::-1])


def convex_hull(ring: Column) -> Column:
    """The same for arrays of (x, y) structs, as an expression: each half is a fold whose stack is an array.

    The stack always turns left, so what a point removes is all above the last place from which it lies to the left.
    """
    nothing = F.array().cast(POINTS)

    def pushed(stack, p):
        left = lambda a, b: (b["x"] - a["x"]) * (p["y"] - a["y"]) > (b["y"] - a["y"]) * (p["x"] - a["x"])
        fits = F.filter(F.sequence(F.lit(2), F.size(stack)), lambda i: left(F.element_at(stack, i - 1), F.element_at(stack, i)))
        return F.when(F.size(stack) < 2, F.concat(stack, F.array(p))).otherwise(F.concat(F.slice(stack, 1, F.coalesce(F.array_max(fits), F.lit(1))), F.array(p)))

    def half(run):
        return F.transform(F.array(F.aggregate(run, nothing, pushed)), lambda h: F.slice(h, 1, F.size(h) - 1))[0]

    def whole(todo):
        return F.when(F.size(todo) < 3, todo).otherwise(F.concat(half(todo), half(F.reverse(todo))))

    points = F.array_sort(F.array_distinct(F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    return F.transform(F.array(points), whole)[0]


def shadow_polygons(buildings: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """Buildings (poly) with the hull of footprint and footprint moved by (sx, sy), and its box. Rings under three points are left out."""
    moved = F.transform("poly", lambda p: F.struct((p["x"] + sx).alias("x"), (p["y"] + sy).alias("y")))
    plain = F.transform("poly", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    shaped = buildings.where(F.size("poly") >= 3).withColumn("hull", convex_hull(F.concat(plain, moved))).where(F.size("hull") >= 3)
    side = lambda f, k: f(F.transform("hull", lambda p: p[k]))
    return shaped.withColumns({"minx": side(F.array_min, "x"), "maxx": side(F.array_max, "x"), "miny": side(F.array_min, "y"), "maxy": side(F.array_max, "y")})


def edge_samples(edges: DataFrame, sample_m: float = SAMPLE_M) -> DataFrame:
    """Points (px, py) in the middle of equal parts of each edge (ax, ay, bx, by, length)."""
    n = F.least(F.lit(MOST_SAMPLES), F.greatest(F.lit(1), F.ceil(F.col("length") / sample_m))).cast("int")
    spread = edges.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = (F.col("i") + 0.5) / F.col("n")
    return spread.withColumns({"px": F.col("ax") + (F.col("bx") - F.col("ax")) * t, "py": F.col("ay") + (F.col("by") - F.col("ay")) * t})


def edge_shade(edges: DataFrame, boxes: DataFrame, shaded: Column, cell_m: float = 25.0) -> DataFrame:
    """(edge id, n, shade_ratio) of the open edges: the share of samples for which ``shaded`` holds with some shadow box.

    The semi join keeps a sample once, however many shadows fall on it.
    """
    samples = edge_samples(edges)
    hits = points_in_boxes(samples, boxes, cell_m, how="left_semi", when=shaded)
    counts = hits.groupBy("id").agg(F.count("*").alias("hits"))
    return edges.join(counts, "id", "left").select("id", (F.coalesce("hits", F.lit(0)) / F.least(F.lit(MOST_SAMPLES), F.greatest(F.lit(1), F.ceil(F.col("length") / SAMPLE_M)))).alias("shade_ratio"))


def shade_at(wanted: DataFrame, edges: DataFrame, buildings: DataFrame, suns: DataFrame, shaded: Column, reach_m: float, cell_m: float = 100.0) -> DataFrame:
    """(id, slot, shade_ratio) of each wanted edge and time slot, once for each pair.

    edges: (id, ax, ay, bx, by, length, covered); buildings: boxes (minx, miny, maxx, maxy, ...); suns: (slot, up, ...), one row for each slot.
    Covered edges, and all while the sun is down, are in full shade. ``shaded`` tells of a sample (px, py), a building and
    its slot's sun whether the one lies in the other's shadow; shadows are never longer than ``reach_m``, so a sample
    meets only the buildings that near, by grid cell.
    """
    pairs = wanted.select("id", "slot").distinct().hint("merge").join(edges, "id").join(suns, "slot")  # pairs may be many in a small file
    full = F.col("covered") | ~F.col("up")
    lit = pairs.where(~full).withColumnRenamed("id", "edge").withColumn("id", F.struct("edge", "slot"))
    grown = buildings.withColumns({"_x0": F.col("minx") - reach_m, "_y0": F.col("miny") - reach_m, "_x1": F.col("maxx") + reach_m, "_y1": F.col("maxy") + reach_m})
    hits = points_in_boxes(edge_samples(lit), grown, cell_m, box=("_x0", "_y0", "_x1", "_y1"), how="left_semi", when=shaded).groupBy("edge", F.col("slot").alias("at")).agg(F.count("*").alias("hits"))
    n = F.least(F.lit(MOST_SAMPLES), F.greatest(F.lit(1), F.ceil(F.col("length") / SAMPLE_M)))
    counted = pairs.join(hits, (F.col("id") == F.col("edge")) & (F.col("slot") == F.col("at")), "left").select("id", "slot", F.when(full, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / n).alias("shade_ratio"))
    return counted


def polygon_shade(edges: DataFrame, shadows: DataFrame, cell_m: float = 25.0) -> DataFrame:
    """Edge shade against shadow polygons (hull and box): a point counts as shaded inside any of them."""
    return edge_shade(edges, shadows.select("hull", "minx", "miny", "maxx", "maxy"), geo.in_ring(F.col("px"), F.col("py"), F.col("hull")), cell_m)


def candidate_counts(samples: DataFrame, shadows: DataFrame, cell_m: float = 25.0) -> DataFrame:
    """How many shadow boxes hold each sample, and whether that is within the limit."""
    near = points_in_boxes(samples, shadows.select("minx", "miny", "maxx", "maxy"), cell_m)
    return near.groupBy("id", "i").agg(F.count("*").alias("candidates")).withColumn("within_limit", F.col("candidates") <= MOST_CANDIDATES)
