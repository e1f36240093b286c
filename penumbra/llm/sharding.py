"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are rows of equal text. Groups of equal size are one item with a count, so the packer gets the
histogram of group sizes, and every group is packed. Sorted by size, each enters the bin with the tightest
remaining capacity, found in a balanced tree: after one group that bin is the tightest still, so it takes as many
of the same size as fit. The smallest capacity that needs no more than the wanted shards is used.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_enough

#: Groups of more than 1/GRAIN of a shard are joined by broadcast: at most GRAIN for each shard.
GRAIN = 1024
#: Rows or groups numbered by one window group.
SLOT_ROWS = 50_000


class CapacityTree:
    """Treap of (remaining capacity, bin); priorities are a hash of the key, so runs are repeatable."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _priority(key):
        return zlib.crc32(repr(key).encode())

    def _split(self, node, key):
        """Nodes below key, nodes from key on."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            return (node[0], node[1], node[2], a), b
        a, b = self._split(node[2], key)
        return a, (node[0], node[1], b, node[3])

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], self._join(a[3], b))
        return (b[0], b[1], self._join(a, b[2]), b[3])

    def add(self, key):
        a, b = self._split(self.root, key)
        self.root = self._join(self._join(a, (key, self._priority(key), None, None)), b)

    def take_tightest(self, size):
        """Remove and return the bin with the least remaining capacity of at least ``size``; None if there is none."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            return None
        first = b
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(b, (first[0][0], first[0][1] + 1))
        self.root = self._join(a, rest)
        return first[0]


def best_fit_counted(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (size, bin, how many) for counted sizes (size, count), larger sizes first; an item over the capacity has a bin alone.

    None as soon as more than ``most`` bins are needed.
    """
    tree, bins, runs = CapacityTree(), 0, []
    for size, left in sorted(sizes, reverse=True):
        while left:
            found = tree.take_tightest(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
                if most is not None and bins > most:
                    return None
            n = min(left, found[0] // size) if size else left
            runs.append((size, found[1], n))
            tree.add((found[0] - n * size, found[1]))
            left -= n
    return runs


def pack_counted(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, bin, how many) of the smallest capacity found that needs at most ``shards`` bins.

    An item over an even share of what is left has a bin alone, and the others share the other bins.
    """
    total, largest = sum(s * c for s, c in sizes), max((s for s, _ in sizes), default=0)
    if shards > 1 and largest * shards > total:
        rest = [(s, c - (s == largest)) for s, c in sizes]
        return [(largest, shards - 1, 1)] + pack_counted([x for x in rest if x[1]], shards - 1)
    low = max(-(-total // shards), largest, 1)
    high, runs = low, best_fit_counted(sizes, low, shards)
    while runs is None:
        high += max(1, high // 500)
        runs = best_fit_counted(sizes, high, shards)
    while high - low > max(1, high // 2000):  # within a thousandth the sizes count as equal
        middle = (low + high) // 2
        found = best_fit_counted(sizes, middle, shards)
        low, high, runs = (low, middle, found) if found is not None else (middle + 1, high, runs)
    return runs


def _deal(items: list[tuple[object, int]], runs: list[tuple[int, int, int]]) -> dict[object, int]:
    """Bin of each named item: those of one size take its runs in the order of their names."""
    bins: dict[int, list[int]] = {}
    for size, k, n in runs:
        bins.setdefault(size, []).extend([k] * n)
    places = {size: iter(ks) for size, ks in bins.items()}
    return {name: next(places[size]) for name, size in sorted(items, key=lambda x: (-x[1], str(x[0])))}


def best_fit_decreasing(items: list[tuple[object, int]], capacity: int) -> dict[object, int]:
    """Bin of each named item. Larger items come first, equal ones in the order of their names."""
    return _deal(items, best_fit_counted(list(Counter(s for _, s in items).items()), capacity))


def pack_into(items: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Bin of each named item by ``pack_counted``."""
    return _deal(items, pack_counted(list(Counter(s for _, s in items).items()), shards))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _place_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Shard of each of the groups (_g, bytes): the packing of the histogram of sizes, dealt out in the order of _g."""
    spark = groups.sparkSession
    histogram = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    counted = list(zip(histogram["bytes"].to_pylist(), histogram["n"].to_pylist()))
    runs: dict[int, list[tuple[int, int]]] = {}
    done: Counter = Counter()
    for size, shard, n in pack_counted(counted, shards):
        runs.setdefault(size, []).append((done[size], shard))
        done[size] += n
    plan = spark.createDataFrame(list(runs.items()), "bytes long, _runs array<struct<first: long, shard: int>>")
    # Groups of one size are numbered in parts, so that no window holds a frequent size as a whole.
    parts = -(-max((n for _, n in counted), default=1) // SLOT_ROWS)
    numbered = groups.withColumn("_part", F.pmod(F.xxhash64("_g"), F.lit(parts)))
    before = Window.partitionBy("bytes").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("bytes", "_part").agg(F.count("*").alias("_n")).select("bytes", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    plan = starts.join(F.broadcast(plan) if small_enough(plan) else plan, "bytes")
    numbered = numbered.withColumn("_k", F.row_number().over(Window.partitionBy("bytes", "_part").orderBy("_g")))
    place = F.col("_from") + F.col("_k") - 1
    last = F.element_at(F.filter("_runs", lambda r: r["first"] <= place), -1)
    return numbered.join(plan, ["bytes", "_part"]).select("_g", "bytes", last["shard"].alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and place in the shard for every row, all rows of one text together, by bytes.

    size is the UTF-8 length of the text (null: 0) plus 1; null and empty texts are one group. A group
    larger than an even share has a shard alone, as it can't be divided. slot numbers the
    rows of a shard from 0 without gaps; repeated rows get slots of their own. Groups of equal size are dealt in the
    order of their digests, so the same rows give the same shards. No rows: no result rows. Other columns are not read.
    The driver gets the histogram of group sizes: as sizes differ, a total of T bytes has at most sqrt(2T) of them.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = materialize(docs.select(docs[id_col].alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _digest(text).alias("_g")))
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    least = max(1, (total or 0) // (shards * GRAIN))
    groups = materialize(_place_groups(materialize(rows.groupBy("_g").agg(F.sum("size").alias("bytes"))), shards))
    # A total of `total` holds at most shards * GRAIN groups of that size; a smaller group is no hot key.
    large = groups.where(F.col("bytes") > least).select("_g", "shard")
    small = groups.where(F.col("bytes") <= least).select("_g", "shard")
    unit = F.pmod(F.xxhash64("_id", "text_crc32"), F.lit(max(16, -(-(n_rows or 0) // (SLOT_ROWS * shards)) * 2)))
    dealt = rows.join(F.broadcast(large), "_g").unionByName(rows.join(F.broadcast(large.select("_g")), "_g", "left_anti").join(small, "_g"))
    dealt = materialize(dealt.select("_id", "size", "text_crc32", "shard", unit.alias("_unit")))
    counts = dealt.groupBy("shard", "_unit").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_unit", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    place = F.row_number().over(Window.partitionBy("shard", "_unit").orderBy("_id", "text_crc32"))
    numbered = dealt.withColumn("_k", place).join(starts, ["shard", "_unit"])
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_from") + F.col("_k") - 1).cast("int").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
