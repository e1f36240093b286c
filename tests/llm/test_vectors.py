"""Hard negatives and nearest vectors against brute force: ties, copies, hot vectors, lengths, nulls, many small blocks and rounds."""

import math

import numpy as np
import pytest

from penumbra.llm import ann, hardneg

COLUMNS = "vec_id long, embedding array<float>, label int, rank int, score string, key long, v string, leaf string"


def table(spark, rows, parts=3):
    """Vectors with extra columns whose names clash with results and internals."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 7, "s", 1, "v", "l") for i, v, label in rows], COLUMNS).repartition(parts)


def clustered(seed, n, dims=16, clusters=9, spread=0.25, copies=0):
    """Directions around a few centres, of lengths from 0.2 to 5; some rows are exact copies of one vector."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    v = centres[r.integers(clusters, size=n)] + spread * r.normal(size=(n, dims))
    v *= (r.choice([0.2, 1, 1, 1, 5], size=n) / np.linalg.norm(v, axis=1))[:, None]
    v[r.choice(n, copies, replace=False)] = v[3]
    return [(int(i), x, int(k)) for i, x, k in zip(r.permutation(n), v.astype(np.float32).tolist(), r.integers(4, size=n))]


def mined(rows, every, positives=5, negatives=5, low=80, high=100, scale=256):
    """Every pair, as the contract says."""
    rows = sorted({(i, tuple(math.floor(float(x) * scale) for x in v), k) for i, v, k in rows if None not in (i, v, k) and len(v) and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, k in rows:
        if i % every:
            continue
        others = sorted((-dot(v, w), j, label) for j, w, label in rows if j != i)
        for s, p, _ in [x for x in others if x[2] == k][:positives]:
            fits = [x for x in others if x[2] != k and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, p, rank + 1, j, -s, -t) for rank, (t, j, _) in enumerate(fits)]
    return sorted(out)


def got_from(spark, rows, **options):
    out = hardneg.hard_negatives(table(spark, rows), **options)
    return sorted(tuple(r) for r in out.select("anchor", "positive", "rank", "negative", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed, n, copies", [(1, 700, 0), (2, 700, 230), (3, 40, 5)])
def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch, seed, n, copies):
    for name, value in (("LEAF", 40), ("BLOCK", 16), ("FIRST_LEAVES", 1), ("MORE", 3)):  # many leaves, blocks and rounds
        monkeypatch.setattr(hardneg, name, value)
    rows = clustered(seed, n, copies=copies)
    want = mined(rows, 20)
    assert got_from(spark, rows, anchors_every=20) == want and want


def test_hard_negatives_of_ties_and_awkward_rows(spark):
    ones = [1.0, 0.5]
    rows = [(0, ones, 1), (20, ones, 1), (1, ones, 1), (2, ones, 0), (3, ones, 0), (4, ones, 2), (4, ones, 2), (5, [0.0, 0.0], 0), (40, [0.0, 0.0], 0), (6, [-1.0, -0.5], 0),
            (7, None, 0), (8, [float("nan"), 1.0], 0), (9, [1.0, None], 0), (10, ones, None), (None, ones, 0), (11, [float("inf"), 1.0], 1), (12, [], 0), (13, [0.9], 2), (60, [300000.0, 1.0], 3), (61, [300000.0, 2.0], 3), (62, [300000.0, 1.0], 0)]
    assert got_from(spark, rows, anchors_every=20) == mined([(i, None if v is None or not v else [*v, 0.0][:2], k) for i, v, k in rows], 20)
    assert got_from(spark, []) == [] and got_from(spark, [(1, ones, 1), (2, ones, 0)], anchors_every=20) == [] and got_from(spark, [(0, ones, 1)]) == []


def nearest_of_all(rows, every, k):
    real = sorted({(i, tuple(map(float, v))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    ids, x = np.array([r[0] for r in real]), np.array([r[1] for r in real])
    out = {}
    for i, v in real:
        if i % every == 0:
            s = (x * np.array(v)).sum(1)
            other = np.flatnonzero(ids != i)
            out[i] = [(int(ids[j]), s[j]) for j in other[np.lexsort((ids[other], -s[other]))][:k]]
    return out


def found_by(spark, rows, **options):
    out = {}
    for r in ann.nearest(table(spark, rows), **options).orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert len(out[r["query"]]) == r["rank"]
    return out


@pytest.mark.parametrize("seed, n, copies, spread", [(1, 3000, 0, 0.25), (2, 3000, 1000, 0.25), (3, 3000, 0, 3.0), (4, 15, 4, 0.25)])
def test_nearest_recall(spark, monkeypatch, seed, n, copies, spread):
    for name, value in (("CELL_ROWS", 16), ("BLOCK", 256), ("SAMPLE", 200)):
        monkeypatch.setattr(ann, name, value)
    rows = clustered(seed, n, copies=copies, spread=spread)
    want, got = nearest_of_all(rows, 5, 10), found_by(spark, rows, k=10, queries_every=5)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    scores = {q: dict(v) for q, v in nearest_of_all(rows, 5, n).items()}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and all(scores[q][i] == s for i, s in found)


def test_a_bar_that_was_too_high_is_lowered(spark, monkeypatch):
    """The guess of the k-th product is normal beyond the sample; here nearly all products are alike, and a few far out."""
    monkeypatch.setattr(ann, "SAMPLE", 60)
    r = np.random.default_rng(8)
    near = [(k, np.r_[1.0, 0.01 * r.normal(size=7)].tolist(), 0) for k in range(12)]
    far = [(k, np.r_[-0.2, r.normal(size=7)].tolist(), 0) for k in range(12, 800)]
    got = found_by(spark, near + far, k=30, queries_every=4)
    assert len(got) == 200 and all(len(x) == 30 for x in got.values())


def test_equal_vectors_and_awkward_rows(spark):
    one = [1.0, 2.0]
    rows = [(i, one, 0) for i in range(60)] + [(100, [0.0, 0.0], 0), (120, None, 0), (140, [float("nan"), 1.0], 0), (160, [1.0, None], 0), (None, one, 0), (180, [float("-inf"), 0.0], 0), (200, [], 0), (220, [9.0], 1), (220, [9.0], 1), (240, [-1.0, -1.0], 2)]
    want = nearest_of_all([(i, None if not v else [*v, 0.0][:2], k) for i, v, k in rows], 20, 20)
    assert found_by(spark, rows) == want and want.keys() == {0, 20, 40, 220, 240}
    assert [i for i, _ in want[0]] == [220, *range(1, 20)]
    assert found_by(spark, []) == {} and found_by(spark, [(1, one, 0)]) == {} and found_by(spark, [(20, one, 0)]) == {}


def test_estimated_success_holds():
    """Of pairs at a known cosine, about the promised share meets in a visited cell."""
    r = np.random.default_rng(5)
    for cosine in (0.4, 0.8):
        q = ann.units(r.normal(size=(300, 48)))
        side = r.normal(size=q.shape)
        side = ann.units(side - (side * q).sum(1)[:, None] * q)
        x = cosine * q + math.sqrt(1 - cosine**2) * side
        hashes = ann.Tables(48, 8)
        c = np.full(300, cosine)
        codes, visited, success = hashes.probes(q, c, 0.9, c)
        met = ((codes == hashes.cells(x)[:, :, None]) & visited).any((1, 2))
        assert abs(met.mean() - success.mean()) < 0.06 and success.mean() > 0.85  # whole cells are visited, so more than aimed at
