"""Nearest vectors by multiprobe p-stable hashing.

A table of the index cuts projections of the unit vectors on Gaussian directions (stable for p = 2) into cells of one width.
For a query and a neighbour at cosine c, the neighbour's projection is normal around c times the query's with
variance 1 - c * c. This estimates how likely the neighbour lies in a cell; cells are visited in the order of this
success against the share of all vectors that they hold, the best cell first, then those perturbed in the coordinates that cost least,
until the estimated success is reached over all tables. Candidates of all tables are merged and reranked by the exact inner product.

Rows are told apart by their length: those of one ring differ by at most a factor of two, and a ring
turns a wanted inner product into a wanted cosine. Equal vectors are searched as one, with as many of their ids as an answer can take.

After a round each query knows its k-th product. Where the cells visited promise too little at that product, it goes
another round, with more cells; a query that cells can't serve is compared with all vectors, in blocks.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize, maybe_broadcast
from .textwords import mix
from .vectors import first_of_each, matrix, numbers, squared_norm, usable

#: Tables, width of a cell in deviations of a projection, vectors wanted in a cell, and most projections of a table.
TABLES, CELL_WIDTH, CELL_ROWS, MOST_PROJECTIONS = 8, 4.0, 128, 24
#: Coordinates of a table that probes perturb: 2 to this power cells of a table can be visited.
PERTURBED = 10
#: Estimated success aimed at, and the least that is good enough for the k-th found; rounds of probing.
AIM, ENOUGH, ROUNDS = 0.96, 0.93, 2
#: Vectors, or queries, of one block.
BLOCK = 8192
#: Vectors of the sample from which a query's k-th product is first guessed.
SAMPLE = 2048
#: Below this cosine cells tell nothing.
LEAST_COSINE = 0.05
_KNOTS = np.uint64(0x9E3779B97F4A7C15)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution; polynomial of Abramowitz and Stegun 26.2.17, within 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


class Tables:
    """The hash functions of all tables: a function of dimensions, projections and seed alone."""

    def __init__(self, dims: int, projections: int, tables: int = TABLES, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.tables, self.projections, rows, n = tables, projections, [], tables * projections
        while sum(map(len, rows)) < n:  # directions of one batch are made orthogonal, so that tables overlap less
            rows.append(np.linalg.qr(rng.normal(size=(dims, dims)))[0] * math.sqrt(dims))
        self.directions = np.concatenate(rows)[:n]
        self.offsets = rng.uniform(0, CELL_WIDTH, n)
        self.knots = mix(np.arange(1, n + 1, dtype=np.uint64) * _KNOTS) | np.uint64(1)

    def project(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.directions.T

    def _code(self, sums: np.ndarray) -> np.ndarray:
        return mix(sums ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell of each vector in each table."""
        steps = np.floor((self.project(unit) + self.offsets) / CELL_WIDTH).astype(np.int64).view(np.uint64) * self.knots
        return self._code(steps.reshape(len(unit), self.tables, self.projections).sum(2, dtype=np.uint64))

    def _mass(self, projected: np.ndarray, cosine: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """How likely a vector at this cosine to the query falls into each step of each projection."""
        spread = np.sqrt(np.maximum(1 - cosine * cosine, 1e-4))[:, None]
        low = (steps * CELL_WIDTH - self.offsets - cosine[:, None] * projected) / spread
        return np.maximum(normal_cdf(low + CELL_WIDTH / spread) - normal_cdf(low), 1e-12)

    def probes(self, unit: np.ndarray, cosine: np.ndarray, aim: float, at: np.ndarray):
        """Cells to visit (query x table x cell), which of them are visited, and the success estimated at the cosines ``at``.

        Two steps of each projection are looked at; where a table has more projections than are
        perturbed, those that cost least are.
        """
        projected = self.project(unit)
        here = np.floor((cosine[:, None] * projected + self.offsets) / CELL_WIDTH)
        around = np.stack([here - 1, here, here + 1])
        mass = np.stack([self._mass(projected, cosine, s) for s in around])
        best = mass.argsort(0)[::-1][:2]
        steps, mass = np.take_along_axis(around, best, 0), np.take_along_axis(mass, best, 0)
        share = np.stack([self._mass(projected, np.zeros(len(unit)), s) for s in steps])
        gain = np.log(mass / share)
        swap = gain[1] > gain[0]
        steps, gain = (np.where(swap, x[::-1], x) for x in (steps, gain))
        late = np.log(np.stack([self._mass(projected, at, s) for s in steps]))
        early = np.log(np.where(swap, mass[::-1], mass))
        shape = (len(unit), self.tables, self.projections)
        cost = (gain[0] - gain[1]).reshape(shape)
        order = cost.argsort(2)
        sorted_ = lambda x: np.take_along_axis(x.reshape(shape), order, 2)
        k = min(PERTURBED, self.projections)
        move = (steps[1] - steps[0]).astype(np.int64).view(np.uint64) * self.knots
        start = (steps[0].astype(np.int64).view(np.uint64) * self.knots).reshape(shape).sum(2, dtype=np.uint64)
        codes, costs, sure, then = start[:, :, None], np.zeros((*shape[:2], 1)), early[0].reshape(shape).sum(2)[:, :, None], late[0].reshape(shape).sum(2)[:, :, None]
        changes = [sorted_(x) for x in (move, cost, early[1] - early[0], late[1] - late[0])]
        for j in range(k):  # doubling: with and without the next perturbation
            codes, costs, sure, then = (np.concatenate([a, a + c[:, :, j : j + 1]], 2) for a, c in zip((codes, costs, sure, then), changes))
        order = costs.argsort(2)
        codes, sure, then = (np.take_along_axis(x, order, 2) for x in (codes, np.exp(sure), np.exp(then)))
        each = 1 - (1 - aim) ** (1 / self.tables)
        visited = np.cumsum(sure, 2) - sure < each
        success = 1 - np.prod(1 - np.minimum((then * visited).sum(2), 1), 1)
        return self._code(codes), visited, success


class Plan:
    """What all tasks need: hash functions of each ring, its greatest length and its number of blocks. Bounded by the range of doubles."""

    def __init__(self, dims: int, rings: dict[int, tuple[int, float]], tables: int, seed: int):
        self.dims, self.rings = dims, rings
        self.hashes = {ring: Tables(dims, max(1, min(MOST_PROJECTIONS, round(math.log2(max(2.0, n / CELL_ROWS))))), tables, seed) for ring, (n, _) in rings.items()}
        self.blocks = {ring: -(-n // BLOCK) for ring, (n, _) in rings.items()}

    def block(self, ring: int, cells: np.ndarray) -> np.ndarray:
        return (cells.view(np.uint64) >> np.uint64(20)) % np.uint64(self.blocks[ring])


def units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def _indexed(plan: Plan, distinct: DataFrame, vector: str) -> DataFrame:
    """Every vector once in each table: (ring, table, block, row, cell, ids, v)."""

    def run(batches):
        for batch in batches:
            v, rings = matrix(batch.column(2), plan.dims), numbers(batch.column(0))
            for ring in np.unique(rings):
                own = np.flatnonzero(rings == ring)
                cells = plan.hashes[ring].cells(units(v[own]))
                for table in range(cells.shape[1]):
                    cell = cells[:, table]
                    same = [pa.array(np.full(len(own), x, np.int32)) for x in (ring, table)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(plan.block(ring, cell).astype(np.int32)), pa.array(cell), *batch.select(["ids", "v"]).take(pa.array(own)).columns], names=["ring", "table", "block", "cell", "ids", "v"])

    return distinct.select("ring", "ids", "v").mapInArrow(run, f"ring int, table int, block int, cell long, ids array<long>, v {vector}")




def _visits(plan: Plan, queries: DataFrame, vector: str) -> DataFrame:
    """(ring, table, block, key, id, v, bar, cells): where each query looks. No cells: everywhere in the first table."""
    names = ["ring", "table", "block", "key", "id", "v", "bar", "cells"]

    def rows(part, who, ring, table, block, cells):
        """One row a query and block, with the cells in it."""
        order = np.lexsort((block, table, who))
        who, table, block, cells = (x[order] for x in (who, table, block, cells))
        new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (table[1:] != table[:-1]) | (block[1:] != block[:-1])][: len(who)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(who)], pa.int32()), pa.array(cells))
        taken = part.take(pa.array(who[new]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(new), ring, np.int32)), pa.array(table[new].astype(np.int32)), pa.array(block[new].astype(np.int32)), *(taken[c] for c in ("key", "id", "v", "bar")), lists], names=names)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                v, cosine, whole = matrix(part["v"], plan.dims), numbers(part["wanted"]), numbers(part["whole"].cast(pa.int8())) > 0
                length = np.sqrt((v * v).sum(1))
                for ring, (_, largest) in plan.rings.items():
                    c = cosine / (length * largest)  # the product wanted, as a cosine
                    probed = np.flatnonzero(~whole & (c < 1 + 1e-9))
                    if len(probed):
                        c = np.clip(c[probed], LEAST_COSINE, 0.9999)
                        codes, visited, _ = plan.hashes[ring].probes(units(v[probed]), c, AIM, c)
                        q, table, _ = np.nonzero(visited)
                        cells = codes[visited]
                        yield rows(part, probed[q], ring, table, plan.block(ring, cells).astype(np.int64), cells)
                    every = np.flatnonzero(whole)
                    if len(every):
                        blocks = plan.blocks[ring]
                        one = rows(part, np.repeat(every, blocks), ring, np.zeros(len(every) * blocks, np.int64), np.tile(np.arange(blocks), len(every)), np.zeros(len(every) * blocks, np.int64))
                        yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.nulls(one.num_rows, pa.list_(pa.int64()))], names=names)

    return queries.mapInArrow(run, f"ring int, table int, block int, key long, id long, v {vector}, bar double, cells array<long>")


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row: the same for the same two vectors, wherever they are met."""
    return (a * b).sum(1)


def _meet(plan: Plan, k: int):
    """Of one block, what each query finds in the cells that it visits: its first k ids."""

    def run(visits: pa.Table, rows: pa.Table) -> pa.Table:
        who, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        q, bars, v = matrix(visits["v"], plan.dims), numbers(visits["bar"]), matrix(rows["v"], plan.dims)
        lengths = np.sqrt((q * q).sum(1))
        slack = 1e-9 * lengths * np.sqrt((v * v).sum(1).max(initial=0))
        cell = numbers(rows["cell"])
        order = np.argsort(cell, kind="stable")
        held, starts = np.unique(cell[order], return_index=True)
        ends = np.r_[starts[1:], len(cell)]

        def compare(queries, places):
            for start in range(0, len(queries), 512):
                part = queries[start : start + 512]
                i, j = np.nonzero(q[part] @ v[places].T >= (bars - slack)[part][:, None])
                who.append(part[i])
                at.append(places[j])

        lists = visits["cells"].combine_chunks()
        whole = np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False))
        if len(whole):
            compare(whole, np.arange(len(v)))
        sizes = np.diff(lists.offsets.to_numpy())
        asked = numbers(lists.flatten())
        asker = np.repeat(np.arange(len(q)), np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
        by_cell = np.argsort(asked, kind="stable")
        asked, asker = asked[by_cell], asker[by_cell]
        for c, start, end in zip(held, starts, ends):
            low, high = np.searchsorted(asked, [c, c + 1]) if c < np.iinfo(np.int64).max else (np.searchsorted(asked, c), len(asked))
            if low < high:
                compare(asker[low:high], order[start:end])
        who, at = np.concatenate(who), np.concatenate(at)
        scores = exact_scores(q[who], v[at]) if len(who) else np.empty(0)
        fits = scores >= bars[who]
        who, at, scores = who[fits], at[fits], scores[fits]
        ids = rows["ids"].combine_chunks().take(pa.array(at))
        many = np.diff(ids.offsets.to_numpy()) if len(at) else np.empty(0, np.int64)
        who, scores, names = np.repeat(who, many), np.repeat(scores, many), numbers(ids.flatten())
        other = names != numbers(visits["id"])[who]
        who, scores, names = who[other], scores[other], names[other]
        first = first_of_each(who, scores, names, k)
        return pa.table({"key": pa.array(numbers(visits["key"])[who[first]], pa.int64()), "id": pa.array(names[first], pa.int64()), "score": pa.array(scores[first], pa.float64())})

    return run


def _search(plan: Plan, index: DataFrame, queries: DataFrame, k: int, vector: str) -> DataFrame:
    """(key, id, score) of what the queries find. Blocks with many vectors or queries are split: both sides meet in each pair of parts."""
    place = ["ring", "table", "block"]
    visits = materialize(_visits(plan, queries, vector))
    asked = visits.groupBy(*place).agg(F.count("*").alias("q"))
    held = index.groupBy(*place).agg(F.count("*").alias("n"))
    parts = asked.join(held, place).select(*place, F.ceil(F.col("n") / (2 * BLOCK)).cast("int").alias("parts"), F.ceil(F.col("q") / (2 * BLOCK)).cast("int").alias("crowds"))
    parts = maybe_broadcast(materialize(parts))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = visits.join(parts, place).withColumn("crowd", F.pmod(F.xxhash64("key"), "crowds").cast("int")).withColumn("part", each(F.col("parts")))
    right = index.join(parts, place).withColumn("part", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), "parts").cast("int")).withColumn("crowd", each(F.col("crowds")))
    by = [*place, "part", "crowd"]
    return left.select(*by, "key", "id", "v", "bar", "cells").groupBy(*by).cogroup(right.select(*by, "cell", "ids", "v").groupBy(*by)).applyInArrow(_meet(plan, k), "key long, id long, score double")


def _first_guess(plan: Plan, queries: DataFrame, sample: list, n: int, k: int, vector: str) -> DataFrame:
    """Bar and wanted product of each query, from the products of a bounded sample: normal beyond what the sample shows."""
    ids = np.array([r["ids"][0] for r in sample], np.int64)
    v = np.zeros((len(sample), plan.dims))
    for i, r in enumerate(sample):
        v[i, : len(r["v"])] = r["v"]
    far = NormalDist().inv_cdf
    beyond, well_beyond = (far(max(0.5, 1 - x / n)) if n > 2 * x else 0.0 for x in (k, 4 * k))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                scores = matrix(part["v"], plan.dims) @ v.T
                own = ids == numbers(part["id"])[:, None]
                scores[own] = np.nan
                enough = (~own).sum(1) >= k
                mean, deviation = np.nanmean(scores, 1, where=~own), np.nanstd(scores, 1, where=~own)
                scores[own] = -np.inf
                seen = np.where(enough, np.partition(scores, -min(k, len(v)), 1)[:, -min(k, len(v))], -np.inf)  # never over the k-th of all
                seen -= 1e-9 * np.abs(np.where(np.isfinite(seen), seen, 0))
                guess = np.maximum(mean + beyond * deviation, np.where(np.isfinite(seen), seen, -np.inf))
                bar = np.maximum(np.where(np.isfinite(guess), mean + well_beyond * deviation, -np.inf), seen)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bar), pa.array(np.where(np.isfinite(guess), guess, 0.0)), pa.array(seen), pa.array(np.zeros(len(part), bool))], names=["key", "id", "v", "bar", "wanted", "sure", "whole"])

    return queries.mapInArrow(run, f"key long, id long, v {vector}, bar double, wanted double, sure double, whole boolean")


def _unserved(plan: Plan, judged: DataFrame, vector: str, last: bool) -> DataFrame:
    """Queries whose cells promise less than ENOUGH at the k-th product found, with what they should look for next."""
    names = ["key", "id", "v", "bar", "wanted", "sure", "whole"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                v, cosine, sure, whole = matrix(part["v"], plan.dims), numbers(part["wanted"]), numbers(part["sure"]), numbers(part["whole"].cast(pa.int8())) > 0
                kth = part["kth"].to_numpy(zero_copy_only=False)
                found = np.where(np.isnan(kth), sure, kth)
                length = np.sqrt((v * v).sum(1))
                success = np.where(np.isnan(kth), 0.0, 1.0)  # with fewer than k found, the bar was too high
                for ring, (_, largest) in plan.rings.items():
                    aimed, wanted = cosine / (length * largest), np.where(np.isfinite(found), found, 0) / (length * largest)
                    can = wanted < 1 + 1e-9
                    probed = np.flatnonzero(can & (aimed < 1 + 1e-9))
                    promised = np.where(can, 0.0, 1.0)
                    if len(probed):
                        _, _, promised[probed] = plan.hashes[ring].probes(units(v[probed]), np.clip(aimed[probed], LEAST_COSINE, 0.9999), AIM, np.clip(wanted[probed], 0, 0.9999))
                    promised = np.where(can & (wanted < LEAST_COSINE), 0.0, promised)
                    success = np.minimum(success, promised)
                again = np.flatnonzero((success < ENOUGH) & ~whole)
                taken = part.take(pa.array(again))
                hopeless = ~np.isfinite(found[again]) | np.any([found[again] / (length[again] * x) < LEAST_COSINE for _, x in plan.rings.values()], axis=0) | last
                yield pa.RecordBatch.from_arrays([*(taken[c] for c in ("key", "id", "v")), pa.array(found[again]), pa.array(np.where(np.isfinite(found[again]), found[again], 0)), taken["sure"], pa.array(np.broadcast_to(hopeless, len(again)))], names=names)

    return judged.select("key", "id", "v", "bar", "wanted", "sure", "whole", "kth").mapInArrow(run, f"key long, id long, v {vector}, bar double, wanted double, sure double, whole boolean")


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, queries_every: int = 20, tables: int = TABLES, seed: int = 13,
) -> DataFrame:
    """(query, rank, id, score): the k rows of largest inner product found for each query, a row whose id is a multiple of ``queries_every``.

    Every row but the query's own id is a candidate. Scores are inner products of the given vectors in double precision; higher ones come
    first, ties go to the smaller id. What is found is nearly all: ENOUGH is the estimated chance to meet the k-th, and nearer ones are met more often.
    Rows with a null id, or a null, empty, zero or not finite vector take no part. Shorter vectors end in zeros. Repeated rows count once;
    rows that share an id but not the vector are queries and candidates of their own. Fewer than k candidates are all given.
    Empty tables, and those without queries, give no rows. Ids are integers; other columns are not read.
    """
    ship_package(vectors.sparkSession)
    element = vectors.schema[vector_col].dataType.simpleString()
    v = vectors[vector_col]
    length = F.sqrt(squared_norm(F.col("v")))
    real = vectors.where(vectors[id_col].isNotNull() & usable(v)).select(vectors[id_col].cast("long").alias("id"), v.alias("v"))
    real = real.withColumn("length", length).where("length > 0").withColumn("ring", F.round(F.log2("length")).cast("int"))
    # Equal vectors are one, with the first ids that an answer can take; so a vector that many rows share is cut before the shuffle.
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    firsts = real.withColumn("_rank", place).where(F.col("_rank") <= k + 1)
    distinct = materialize(firsts.groupBy("v").agg(F.first("ring").alias("ring"), F.first("length").alias("length"), F.sort_array(F.collect_set("id")).alias("ids")))
    queries = materialize(real.where(F.col("id") % queries_every == 0).select(F.xxhash64("id", "v").alias("key"), "id", "v").dropDuplicates(["key"]))
    sizes = distinct.groupBy("ring").agg(F.count("*"), F.max("length"), F.max(F.size("v"))).collect()  # a row for each power of two
    empty = vectors.sparkSession.createDataFrame([], "query long, rank int, id long, score double")
    if not sizes:
        return empty
    plan = Plan(max(r[3] for r in sizes), {r[0]: (r[1], r[2] * (1 + 1e-12)) for r in sizes}, tables, seed)
    n = sum(r[1] for r in sizes)
    sample = distinct.select("ids", "v", F.xxhash64("v").alias("o")).orderBy("o").limit(SAMPLE).collect()  # bounded
    asked = materialize(_first_guess(plan, queries, sample, n, k, element))
    index = _indexed(plan, distinct, element)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    found, todo = None, asked
    for turn in range(ROUNDS + 1):
        new = _search(plan, index, todo.drop("sure"), k, element)
        every = (new if found is None else found.select("key", "id", "score").unionByName(new)).distinct()
        found = materialize(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if turn == ROUNDS:
            break
        kth = found.where(F.col("rank") == k).select("key", F.col("score").alias("kth"))
        todo = materialize(_unserved(plan, todo.join(kth, "key", "left"), element, last=turn == ROUNDS - 1))
        if todo.isEmpty():
            break
    return found.join(asked.select("key", F.col("id").alias("query")), "key").select("query", "rank", "id", "score")
