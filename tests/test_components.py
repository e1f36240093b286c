"""Components against brute force, and the rows written on the way: a round is a fraction of the one before."""

import random

import pytest

from penumbra import session
from penumbra.operators import graph


def brute(pairs):
    up = {n: n for p in pairs for n in p}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in up}


def some(seed):
    r = random.Random(seed)
    return [(r.randrange(600), r.randrange(600)) for _ in range(350)] + [(900, 900)]


@pytest.mark.parametrize("pairs", [[(k, k + 1) for k in range(3000)], [(5, 5)], some(1), [(-k, 1) for k in range(50)]])
def test_components(spark, pairs):
    written = []

    def keep(df):
        out = session.keep(df)
        written.append(out.count())
        return out

    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "edge_id long, a long, b long")
    want = brute(pairs)
    assert sorted(tuple(r) for r in graph.components(edges, keep).collect()) == sorted(want.items())
    assert sum(written) <= 10 * (len(want) + len(pairs))
