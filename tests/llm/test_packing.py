"""Sharding packs every group: counted sizes against one-by-one packing, many small groups, ties."""

import random
from collections import Counter

from penumbra.llm import sharding


def one_by_one(sizes, capacity):
    """Best fit decreasing by looking at all bins for each item."""
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [(left, k) for k, left in enumerate(room) if left >= size]
        if fits:
            room[min(fits)[1]] -= size
        else:
            room.append(max(capacity, size) - size)
    return sorted(max(capacity, 0) - left for left in room)


def test_counted_sizes_are_packed_like_single_items():
    for seed in range(200):
        r = random.Random(seed)
        sizes = [r.choice([1, 2, 3, 5, 8, 13, 21, 34]) for _ in range(r.randrange(60))]
        capacity = r.randrange(34, 90)
        runs = sharding.best_fit_counted(list(Counter(sizes).items()), capacity)
        fill = Counter()
        for size, k, n in runs:
            fill[k] += size * n
        assert sorted(fill.values()) == one_by_one(sizes, capacity)
        assert Counter({s: sum(n for t, _, n in runs if t == s) for s in set(sizes)}) == Counter(sizes)
        bins = len(fill)
        assert bins == 0 or sharding.best_fit_counted(list(Counter(sizes).items()), capacity, bins - 1) is None


def test_a_size_of_its_own_leaves_even_shards():
    runs = sharding.pack_counted([(100, 1), (90, 1), (1, 30)], 4)
    fill = Counter()
    for size, k, n in runs:
        fill[k] += size * n
    assert sorted(fill.values()) == [15, 15, 90, 100]
    assert sharding.pack_counted([], 3) == [] and sharding.pack_counted([(5, 3)], 1) == [(5, 0, 3)]


def test_many_small_groups_of_few_sizes(spark, monkeypatch):
    """Groups of a size are numbered in several parts; no two runs differ, and shards are level to one group."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    texts = [f"{k:05d}" + "x" * (k % 3) for k in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, sharding.shard_documents(docs).collect()), key=str)
    again = sorted(map(tuple, sharding.shard_documents(docs.repartition(3)).collect()), key=str)
    assert got == again and len(got) == 3000
    sizes = Counter()
    for row in got:
        sizes[row[4]] += row[1]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 24
    assert len({(row[4], row[5]) for row in got}) == 3000


def test_one_text_in_a_third_of_all_rows(spark):
    texts = ["the same"] * 500 + [f"text {k}" for k in range(1000)]
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    same = {r.shard for r in got if r.doc_id < 500}
    others = Counter()
    for r in got:
        others[r.shard] += r.size * (r.shard not in same)
    assert len(same) == 1 and max(v for v in others.values()) < 1.02 * sum(others.values()) / 7
