"""Hard-negative mining by a vantage-point tree over norm-augmented vectors.

With one more component, sqrt(M**2 - |x|**2) for rows (M: the largest norm) and 0 for an anchor, the squared
distance is |anchor|**2 + M**2 - 2 * score: scores become distances, a window of scores an annulus around
the anchor. The upper levels of the tree are built from a bounded sample of rows; then every row goes
down to its leaf, and each leaf keeps the exact range of its rows' distances to every vantage point above
it. By the triangle inequality these ranges bound the scores a leaf can hold for an anchor.

A search visits the leaves that reach into an anchor's annulus nearest first: a few in the first round, more in each
later one, and ends for an anchor when no leaf that is left can hold a row better than its k-th. Large leaves,
and the anchors that meet in one leaf, are split into blocks; a block is one product of matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize
from .vectors import first_of_each, matrix, numbers, squared_norm, usable

#: Rows of the sample that the tree is built from, and the rows wanted in a leaf. The tree has at most SAMPLE / 4 leaves.
SAMPLE, LEAF = 4096, 4096
#: Most rows, or anchors, of one block.
BLOCK = 16_384
#: Leaves that an anchor visits in the first round, and how many times more in each round after.
FIRST_LEAVES, MORE = 4, 16
#: Scores up to this size are exact in double precision.
EXACT = float(1 << 53)


class VantageTree:
    """Upper levels of a vantage-point tree: node i has the children 2i + 1 (within its radius) and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 11):
        rng, inner = np.random.default_rng(seed), 2**depth - 1
        self.depth, self.points, self.radii = depth, np.zeros((inner, sample.shape[1])), np.zeros(inner)
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            own = rows.pop(node)
            if not len(own):
                rows[2 * node + 1] = rows[2 * node + 2] = own
                continue
            tried = sample[rng.choice(own, min(len(own), 5), replace=False)]
            spread = [np.std(self.distances(sample[own], x)) for x in tried]  # the point with the most uneven distances parts best
            self.points[node] = tried[int(np.argmax(spread))]
            d = self.distances(sample[own], self.points[node])
            self.radii[node] = np.median(d)
            rows[2 * node + 1], rows[2 * node + 2] = own[d <= self.radii[node]], own[d > self.radii[node]]

    @staticmethod
    def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((x - point) ** 2).sum(-1))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row, from 0, and its distances to the vantage points above, from the root down."""
        node, path = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            path[:, level] = self.distances(x, self.points[node])
            node = 2 * node + 1 + (path[:, level] > self.radii[node])
        return node - (2**self.depth - 1), path

    def above(self, leaf: np.ndarray) -> np.ndarray:
        """Nodes above each leaf, from the root down."""
        node, out = leaf + 2**self.depth - 1, []
        for _ in range(self.depth):
            node = (node - 1) // 2
            out.append(node)
        return np.array(out[::-1], np.int64).reshape(self.depth, len(leaf)).T


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as long as these fit 64 bits."""
    most = max((np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if most * most * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Index:
    """The tree, and what each leaf's rows span; all bounded by SAMPLE and the number of components."""

    def __init__(self, tree: VantageTree, dims: int, largest: float, leaves: np.ndarray, low: np.ndarray, high: np.ndarray, blocks: np.ndarray):
        self.tree, self.dims, self.largest, self.leaves, self.low, self.high, self.blocks = tree, dims, largest, leaves, low, high, blocks

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each leaf can hold for each anchor, with some slack for rounding."""
        base = (q * q).sum(1)[:, None] + self.largest
        slack = 1e-7 * base + 1e-6
        if not self.tree.depth:
            return np.full((len(q), len(self.leaves)), -np.inf), np.full((len(q), len(self.leaves)), np.inf)
        points = self.tree.points
        d = np.sqrt(np.maximum((points * points).sum(1) + (q * q).sum(1)[:, None] - 2 * q @ points[:, :-1].T, 0))
        d = d[:, self.tree.above(self.leaves)]
        nearest = np.maximum(np.maximum(d - self.high, self.low - d).max(2), 0)
        farthest = (d + self.high).min(2)
        return (base - farthest**2) / 2 - slack, (base - nearest**2) / 2 + slack


def build_index(rows: DataFrame) -> tuple[Index, DataFrame]:
    """The index of (_id, _label, _v) rows, and the rows with their leaf and block."""
    n, dims, largest = rows.agg(F.count("*"), F.max(F.size("_v")), F.max(squared_norm(F.col("_v")))).first()
    dims, largest = dims or 1, largest or 0.0
    taken = rows.select("_v", F.xxhash64("_id", "_v").alias("o")).orderBy("o").limit(SAMPLE).collect()  # bounded
    sample = np.zeros((len(taken), dims))
    for k, r in enumerate(taken):
        sample[k, : len(r["_v"])] = r["_v"]
    depth = max(0, min((n // LEAF).bit_length(), (SAMPLE // 4).bit_length() - 1, (len(taken) // 4).bit_length() - 1))
    tree = VantageTree(augmented(sample, largest), depth)

    def place(batches):
        for batch in batches:
            leaf, path = tree.place(augmented(matrix(batch.column(2), dims), largest))
            path = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1) * depth, pa.int32()), pa.array(path.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), path], names=["_id", "_label", "_v", "leaf", "path"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, leaf int, path array<double>"
    placed = materialize(rows.mapInArrow(place, schema))
    ends = [f(F.get("path", F.lit(j))) for j in range(depth) for f in (F.min, F.max)]
    spans = sorted(placed.groupBy("leaf").agg(F.count("*"), *ends).collect())  # a row for each leaf
    bounds = np.array([r[2:] for r in spans], np.float64).reshape(len(spans), depth, 2)
    leaves = np.array([r[0] for r in spans], np.int64)
    blocks = np.array([-(-r[1] // BLOCK) for r in spans], np.int64)
    index = Index(tree, dims, largest, leaves, bounds[:, :, 0], bounds[:, :, 1], blocks)
    split = F.create_map(*(F.lit(int(x)) for r, b in zip(spans, blocks) if b > 1 for x in (r[0], b))) if (blocks > 1).any() else None
    part = F.lit(0) if split is None else F.pmod(F.xxhash64("_id"), F.coalesce(F.try_element_at(split, F.col("leaf")), F.lit(1))).cast("int")
    return index, placed.select("leaf", part.alias("part"), "_id", "_label", "_v")


#: A search is a row for each anchor: its windows of scores (both ends included) and the k-th score found so far in each (NONE: fewer than k).
SEARCH = "key long, anchor long, label int, v array<bigint>, window array<bigint>, low array<bigint>, high array<bigint>, bar array<bigint>"
#: Stands for no bar, and for a window without a lower end; the other end of one without an upper end.
NONE, ALL = -(1 << 62), 1 << 62
#: Anchors of one product of matrices.
SLICE = 256


def _visits(index: Index, seen: int, step: int, searches: DataFrame) -> DataFrame:
    """Of the next ``step`` leaves of each anchor, nearest first, those that can still hold a row for one of its windows."""

    def chosen(part):
        least, most = index.reach(matrix(part.column(3), index.dims))
        for k, (low, high, bar) in enumerate(zip(*(part.column(c).to_pylist() for c in (5, 6, 7)))):
            ends = np.minimum.outer(np.array(high, np.float64), most[k])  # the best score that each leaf may have inside each window
            useful = ((ends >= np.maximum(low, bar)[:, None]) & (least[k] <= np.array(high, np.float64)[:, None])).any(0)
            nearest = np.lexsort((index.leaves, -most[k], -ends.max(0)))[seen : seen + step]
            yield from ((k, index.leaves[at], block) for at in nearest[useful[nearest]] for block in range(index.blocks[at]))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                who, leaf, block = np.array(list(chosen(part)), np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(block, pa.int32()), *part.take(pa.array(who)).columns], names=["leaf", "part", *batch.schema.names])

    return searches.mapInArrow(run, f"leaf int, part int, {SEARCH}")


def _meet(index: Index, k: int, same: bool):
    """What the rows of one block give to the anchors that visit it: the first k of each window."""

    def run(visits: pa.Table, rows: pa.Table) -> pa.Table:
        found = {"key": [], "window": [], "id": [], "score": []}
        if visits.num_rows and rows.num_rows:
            ids, labels, x = numbers(rows["_id"]), numbers(rows["_label"]), matrix(rows["_v"], index.dims)
            for start in range(0, visits.num_rows, SLICE):
                part = visits.slice(start, SLICE)
                for row, s in zip(part.drop_columns(["v"]).to_pylist(), products(matrix(part["v"], index.dims), x)):
                    fits = ((labels == row["label"]) if same else (labels != row["label"])) & (ids != row["anchor"])
                    for window, low, high, bar in zip(row["window"], row["low"], row["high"], row["bar"]):
                        at = np.flatnonzero(fits & (s >= max(low, bar)) & (s <= high))
                        if len(at) > 4 * k:
                            at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                        at = at[first_of_each(np.zeros(len(at)), s[at], ids[at], k)]
                        for name, values in (("key", [row["key"]] * len(at)), ("window", [window] * len(at)), ("id", ids[at].tolist()), ("score", s[at].tolist())):
                            found[name] += values
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    return run


def annulus_search(index: Index, rows: DataFrame, searches: DataFrame, k: int, same: bool) -> DataFrame:
    """(key, window, id, score, rank): the first k rows in each window of each search, of the anchor's label or of another.

    Each round is a Spark job over the next leaves that anchors still need. Bars rise with what was found, so fewer leaves are left.
    """
    found, seen, step = None, 0, FIRST_LEAVES
    order = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id")
    while seen < len(index.leaves):
        visits = materialize(_visits(index, seen, step, searches))
        crowds = {r["leaf"]: -(-r["n"] // BLOCK) for r in visits.where("part = 0").groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
        if crowds:
            parts = F.element_at(F.create_map(*(F.lit(x) for pair in crowds.items() for x in pair)), F.col("leaf"))
            met = rows.where(F.col("leaf").isin(list(crowds))).withColumn("crowd", F.explode(F.sequence(F.lit(0), parts - 1)))
            asked = visits.withColumn("crowd", F.pmod(F.xxhash64("key"), parts).cast("int"))
            new = asked.groupBy("leaf", "part", "crowd").cogroup(met.groupBy("leaf", "part", "crowd")).applyInArrow(_meet(index, k, same), "key long, window long, id long, score long")
            every = new if found is None else found.drop("rank").unionByName(new)
            found = materialize(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        seen, step = seen + step, step * MORE
        if found is not None and seen < len(index.leaves):
            last = found.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
            bar = F.zip_with("window", "bar", lambda w, b: F.greatest(b, F.coalesce(F.try_element_at("kth", w), b)))
            searches = materialize(searches.join(last, "key", "left").withColumn("bar", F.when(F.col("kth").isNull(), F.col("bar")).otherwise(bar)).drop("kth"))
    if found is None:
        return searches.sparkSession.createDataFrame([], "key long, window long, id long, score long, rank int")
    return found


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, anchors_every: int = 100,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score) for anchors, the rows whose id is a multiple of ``anchors_every``.

    Scores are inner products of the components floor(scale * x). An anchor's positives are its first rows of the
    same label, by score, then the smaller id; of each positive, the negatives are the first rows of other labels
    whose score is between low and high percent of the positive's. Fewer are given where there are no more.
    Exact, whatever the tree looks like. Rows with a null id or label, or a null, empty or not finite vector, take no part;
    vectors of zeros do. Repeated rows count once; rows that share an id but differ are rows of their own, and
    none of them serves an anchor of that id. Shorter vectors end in zeros. Empty tables, and such without anchors, give no rows.
    Ids are integers; other columns are not read.
    """
    ship_package(vectors.sparkSession)
    vector = vectors[vector_col]
    real = vectors.where(vectors[id_col].isNotNull() & vectors[label_col].isNotNull() & (F.size(vector) > 0) & usable(vector))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = materialize(real.select(vectors[id_col].cast("long").alias("_id"), vectors[label_col].cast("int").alias("_label"), v.alias("_v")).distinct())
    index, rows = build_index(rows)
    key = F.xxhash64("_id", "_label", "_v").alias("key")
    anchors = rows.where(F.col("_id") % anchors_every == 0).select(key, F.col("_id").alias("anchor"), F.col("_label").alias("label"), F.col("_v").alias("v"))
    ends = [F.array(F.lit(x).cast("long")).alias(name) for x, name in ((0, "window"), (NONE, "low"), (ALL, "high"), (NONE, "bar"))]
    found = annulus_search(index, rows, anchors.select("*", *ends), positives, same=True)
    # Integer ends of the windows: low * p <= 100 * s <= high * p. Positives of one score share a window.
    share = lambda percent, up: F.expr(f"CAST({'-floor(-' if up else 'floor('}CAST(score AS DECIMAL(20,0)) * {percent} / 100) AS BIGINT)")
    windows = found.select("key", "score", share(low, True).alias("lo"), share(high, False).alias("hi")).distinct().where("lo <= hi")
    asked = windows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "lo", "hi"))).alias("w")).select("key", *(F.col(f"w.{c}").alias(name) for c, name in (("score", "window"), ("lo", "low"), ("hi", "high"))))
    searches = anchors.join(asked, "key").withColumn("bar", F.transform("window", lambda _: F.lit(NONE).cast("long")))
    mined = annulus_search(index, rows, searches.select("key", "anchor", "label", "v", "window", "low", "high", "bar"), negatives, same=False)
    given = found.select("key", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    out = given.join(mined.withColumnsRenamed({"window": "positive_score", "id": "negative", "score": "negative_score"}), ["key", "positive_score"]).join(anchors.select("key", "anchor"), "key")
    return out.select("anchor", "positive", "rank", "negative", "positive_score", "negative_score")
