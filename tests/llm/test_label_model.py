"""The label model of toxicity on votes drawn from known rates, its tree of voters, and the choice of features."""

import numpy as np

from penumbra.llm import toxicity


def drawn(n, seed):
    """Classes and votes: six voters with known rates, the last three copying the third; then the families' votes."""
    r = np.random.default_rng(seed)
    y = r.random(n) < 0.15
    on, off = np.array([0.5, 0.4, 0.3]), np.array([0.002, 0.004, 0.03])
    first = r.random((n, 3)) < np.where(y[:, None], on, off)
    toxic = np.hstack([first, *[first[:, 2:]] * 3])
    quiet = ~toxic.any(1)
    families = np.repeat(quiet[:, None], toxicity.FAMILIES, 1)
    return y, on, off, first, np.hstack([toxic, families]).astype(np.float32)


def test_copies_of_a_voter_add_nothing():
    y, on, off, first, v = drawn(20_000, 1)
    post = toxicity.label_model(v, 0.15)
    # What the three real voters say, by the rates that the votes were drawn with.
    truth = 1 / (1 + np.exp(-(np.log(0.15 / 0.85) + first @ np.log(on / off))))
    only_third = first[:, 2] & ~first[:, 0] & ~first[:, 1]
    assert only_third.sum() > 200
    # Four copies voting as if they were independent would make these rows sure; one vote leaves them in doubt.
    alone = toxicity.label_model(np.delete(v, [3, 4, 5], 1), 0.15)
    assert abs(post[only_third].mean() - alone[only_third].mean()) < 0.1
    fired = first.any(1)
    assert (post[first[:, 0] | first[:, 1]] > 0.9).all() and (truth[first[:, 0] | first[:, 1]] > 0.9).all()
    assert (post[~fired] < 0.5).all()


def test_tree_links_copies_and_leaves_independent_voters():
    y, _, _, _, v = drawn(20_000, 2)
    parent = toxicity.dependency_forest(v, y.astype(float))
    m = v.shape[1]
    copies = {2, 3, 4, 5}
    assert sum(parent[k] in copies for k in copies) == 3 and sum(parent[k] == m for k in copies) == 1
    assert parent[0] == parent[1] == m
    assert all(parent[k] >= 6 for k in range(6, m))


def test_votes_have_three_values():
    voters = [b"idiot", b"zzru*", b"grub"]
    texts = ["an idiot zzrude", "calm words", "", None, "you are an idiot"]
    out = toxicity.votes(texts, [toxicity.features(t) for t in texts], voters)
    quiet = out[:, -toxicity.FAMILIES :]
    assert out[0, :3].tolist() == [1, 1, 0] and quiet[0].tolist() == [0, 1, 1, 0]
    assert not out[1, :-4].any() and quiet[1].tolist() == [1, 1, 1, 1]
    assert not out[2].any() and not out[3].any()
    assert out[4, 3] == 1 and quiet[4].tolist() == [0, 0, 1, 1]


def test_no_votes_and_one_row():
    assert toxicity.label_model(np.zeros((1, 8), np.float32), 0.0).shape == (1,)
    assert (toxicity.label_model(np.zeros((50, 8), np.float32), 0.2) < 0.5).all()


def test_telling_features_by_chi_square(spark):
    r = np.random.default_rng(3)
    post = r.random(300) * (r.random(300) < 0.3)
    lists = [sorted({int(b) for b in r.integers(0, 40, 6)} | ({50, 51} if p > 0.5 else set())) for p in post]
    unit = toxicity.POSTERIOR_UNIT
    rows = spark.createDataFrame([(x, int(round(p * unit))) for x, p in zip(lists, post)], "x array<int>, t long")
    rate = sum(int(round(p * unit)) for p in post) / unit / 300
    want = []
    for b in range(60):
        t = [p for x, p in zip(lists, post) if b in x]
        if len(t) >= 3 and (sum(t) - len(t) * rate) ** 2 / (len(t) * rate * (1 - rate)) > toxicity.LEAST_CHI:
            want.append(b)
    assert toxicity.telling(rows) == want and {50, 51} <= set(want)
