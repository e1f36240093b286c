"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are a fixed lexicon, patterns, and words and word beginnings that the labelled training rows
show to be telling. Each votes toxic or abstains. Each of the four families they form votes not toxic on a text with
words in which none of its members is found. The label model is generative: a class, and in each class a tree of voters,
in which a vote depends on the class and on one other voter's vote of its kind. Accuracies and these correlations are parameters estimated from the votes
alone, the tree being the one of most conditional mutual information. Its
posterior labels train a logistic classifier over hashed words and word beginnings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize

#: Words of insult, as a starting lexicon.
LEXICON = "idiot moron stupid loser scum trash clown pathetic worthless disgusting".split()
#: Patterns of abusive writing. Each votes when it is found in the lowered text.
PATTERNS = [rb"\b(?:you|he|she|they) (?:are|is) (?:an? |such )?(?:idiot|moron|loser|clown|trash|scum)", rb"\bshut up\b", rb"\b(?:hate|kill) (?:you|them)\b", rb"!{3,}"]
#: Labelled training rows that voters and classifier are fitted on, at most (those of least hash).
MAX_ROWS = 20_000
#: Most voters learned from the training rows, the documents that a voter must be seen in, and its least precision.
MAX_VOTERS, SUPPORT, PRECISION = 600, 4, 0.9
#: Lengths of word beginnings that are features beside whole words.
STEMS = (4, 5)
#: Buckets of hashed features.
BUCKETS = 1 << 18
#: Buckets that the classifier may use, chosen by chi-square, which must exceed LEAST_CHI.
CHOSEN, LEAST_CHI = 2048, 10
#: Families of voters that can vote not toxic: lexicon, patterns, learned words, learned beginnings.
FAMILIES = 4
#: Rounds of the label model, and those in which the tree of voters is chosen anew.
ROUNDS, TREE_ROUNDS = 25, (3, 8, 13, 18)
#: Posterior labels are summed as multiples of 1/POSTERIOR_UNIT, so that sums don't depend on their order.
POSTERIOR_UNIT = 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str | None) -> set[bytes]:
    """Distinct lower-case words of the whole text, and their beginnings marked with a star."""
    words = set(text.encode().translate(_LETTERS).split()) if text else set()
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + b"*" for w in words if len(w) > n])
    return out


def learn_voters(sample: DataFrame) -> list[bytes]:
    """Features much more frequent in toxic rows of (_y, _text); at most MAX_VOTERS.

    Every feature is counted in toxic rows and in all rows; support and precision are tested in Spark, before
    the most frequent are chosen. Tasks combine their counts, and look at one row at a time.
    """
    rows = sample.select("_y", "_text")

    def counted(batches):
        for batch in batches:
            seen: Counter = Counter()
            toxic: Counter = Counter()
            for y, text in zip(batch.column(0), batch.column(1)):
                found = features(text.as_py())
                seen.update(found)
                if y.as_py():
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([toxic[f] for f in seen], pa.int64())], names=["f", "n", "t"])

    counts = rows.mapInArrow(counted, "f binary, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    good = counts.where((F.col("t") >= SUPPORT) & (F.col("t") / (F.col("n") + F.lit(0.4)) >= PRECISION))
    return [bytes(r.f) for r in good.orderBy(F.desc("t"), "f").limit(MAX_VOTERS).collect()]


def family(voter: bytes) -> int:
    return 0 if voter.decode(errors="replace") in LEXICON else 3 if voter.endswith(b"*") else 2


def votes(texts: list[str | None], sets: list[set[bytes]], voters: list[bytes]) -> np.ndarray:
    """1 where a voter speaks, 0 where it abstains: voters and patterns for toxic, then FAMILIES columns for not toxic."""
    speakers = len(voters) + len(PATTERNS)
    out = np.zeros((len(sets), speakers + FAMILIES), np.float32)
    patterns = [re.compile(p) for p in PATTERNS]
    place = {f: k for k, f in enumerate(voters)}
    kind = np.array([family(f) for f in voters] + [1] * len(PATTERNS))
    for i, (text, s) in enumerate(zip(texts, sets)):
        for f in s & place.keys():
            out[i, place[f]] = 1
        low = text.encode().lower() if text else b""
        for k, p in enumerate(patterns):
            out[i, len(voters) + k] = p.search(low) is not None
        if s:
            out[i, speakers:] = 1
            out[i, speakers + kind[out[i, :speakers] > 0]] = 0
    return out


def dependency_forest(v: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Parent of each voter, or the number of voters for a root: the forest of most conditional mutual information.

    A link has to raise the likelihood by more than the price of its two parameters (Bayesian information). Votes for
    toxic depend on such votes only, as a family's other vote is just their absence.
    """
    n, m = v.shape
    gain = np.full((m, m), -np.log(max(n, 2)))
    for w in (post, 1 - post):
        both = np.asarray((v * w[:, None].astype(np.float32)).T @ v, np.float64)
        one, total = both.diagonal().copy(), w.sum()
        a, b = one[:, None], one[None, :]
        for seen, x, y in [(both, a, b), (a - both, a, total - b), (b - both, total - a, b), (total - a - b + both, total - a, total - b)]:
            seen = np.maximum(seen, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain += np.where(seen > 1e-6, seen * np.log(seen * total / (x * y)), 0)
    toxic = np.arange(m) < m - FAMILIES
    gain[toxic[:, None] != toxic[None, :]] = 0
    parent, link = np.full(m, m), np.full(m, m)
    best, outside, often = np.zeros(m), np.ones(m, bool), v.sum(0)
    for _ in range(m):
        left = np.flatnonzero(outside)
        j = left[np.lexsort((-left, often[left], best[left]))[-1]]
        outside[j] = False
        parent[j] = link[j]
        better = outside & (gain[j] > best)
        best[better], link[better] = gain[j][better], j
    return parent


def label_model(v: np.ndarray, prior: float, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probability that each row is toxic, from its votes alone.

    Expectation-maximisation over the class of each row, begun with the prior. A voter's parameters are its rates of voting
    in both classes where its parent votes and where it abstains; rates without data lean to that of both classes together, so a
    vote that only repeats its parent says nothing more. Abstentions are no evidence.
    """
    n, m = v.shape
    post = np.where(v[:, : m - FAMILIES].any(1), 0.9, min(prior, 0.1))
    parent = np.full(m, m)
    wide = np.hstack([v, np.zeros((n, 1), np.float32)])
    for step in range(rounds):
        if step in TREE_ROUNDS:
            parent = dependency_forest(v, post)
        over = wide[:, parent]
        both = v * over
        p = float(np.clip(post.mean(), 1e-3, 0.5))
        counts = [(w @ both, w @ over, w @ v, w.sum()) for w in (post, 1 - post)]

        def evidence(spoke, cases):
            """Log ratio of the rates in the two classes, for votes and cases counted in each."""
            pooled = (sum(spoke) + 0.05) / (sum(cases) + 1)
            on, off = ((x + pooled) / (c + 1) for x, c in zip(spoke, cases))
            return np.log(on / off)

        beside = evidence([c[0] for c in counts], [c[1] for c in counts])
        alone = evidence([np.maximum(c[2] - c[0], 0) for c in counts], [np.maximum(c[3] - c[1], 0) for c in counts])
        logit = np.log(p / (1 - p)) + both @ beside + (v - both) @ alone
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def hashed(s: set[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(f) % BUCKETS for f in s), np.int64, len(s))


class FeatureWeights(dict):
    """Weight of each feature; buckets are found once for each feature, up to a bound."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, feature: bytes) -> float:
        value = float(self.weights[zlib.crc32(feature) % BUCKETS])
        if len(self) < 300_000:
            self[feature] = value
        return value


def telling(rows: DataFrame) -> list[int]:
    """Buckets of (x, t) rows that go most clearly with the posterior labels t, by chi-square; at most CHOSEN."""
    n_rows, all_t = rows.agg(F.count("*"), F.sum("t")).first()
    rate = (all_t or 0) / POSTERIOR_UNIT / max(n_rows, 1)
    counts = rows.select(F.explode("x").alias("b"), "t").groupBy("b").agg(F.count("*").alias("n"), (F.sum("t") / POSTERIOR_UNIT).alias("n1"))
    spread = F.greatest(F.col("n") * (rate * (1 - rate)), F.lit(1e-9))
    chi = F.pow(F.col("n1") - F.col("n") * rate, 2) / spread
    best = counts.where("n >= 3").select("b", chi.alias("chi")).where(F.col("chi") > LEAST_CHI)
    return sorted(r.b for r in best.orderBy(F.desc("chi"), "b").limit(CHOSEN).collect())


def train_linear(index: list[np.ndarray], target: np.ndarray, chosen: list[int], steps: int = 400, rate: float = 0.1, decay: float = 2e-4):
    """Logistic regression on soft labels; index holds each row's places in ``chosen``. Full gradients, Adam."""
    weights = np.zeros(BUCKETS)
    if not len(index):
        return weights, 0.0
    rows = np.repeat(np.arange(len(index)), [len(x) for x in index])
    columns = np.concatenate(index).astype(np.int64)
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(np.clip(target.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(target.mean(), 1e-3, 1 - 1e-3)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, w[columns], len(index))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(index)
        g = np.append(np.bincount(columns, e[rows], len(chosen)), e.sum())
        g[:-1] += decay * w[:-1] / len(index) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights[np.array(chosen, np.int64)] = w[:-1]
    return weights, float(w[-1])


def fit(sample: DataFrame):
    """Weights and bias, from (_id, _y, _text) rows that MAX_ROWS bounds.

    The features of these rows stay in Spark, where they are counted; the driver gets the votes and, of the features,
    the CHOSEN ones.
    """
    spark = sample.sparkSession
    voters = list(dict.fromkeys([w.encode() for w in LEXICON] + learn_voters(sample)))

    def run(batches):
        for batch in batches:
            fired, buckets = [], []
            for value in batch.column(2):
                text = value.as_py()
                s = features(text)
                fired.append(np.flatnonzero(votes([text], [s], voters)[0]).astype(np.int32))
                buckets.append(np.unique(hashed(s)).astype(np.int32))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fired, lists), pa.array(buckets, lists)], names=["_id", "_y", "v", "x"])

    kind = sample.schema["_id"].dataType.simpleString()
    seen = materialize(sample.mapInArrow(run, f"_id {kind}, _y int, v array<int>, x array<int>"))
    got = seen.select("_id", "_y", "v").orderBy("_id").toArrow()
    if not got.num_rows:
        return train_linear([], np.empty(0), [])
    v = np.zeros((got.num_rows, len(voters) + len(PATTERNS) + FAMILIES), np.float32)
    for i, row in enumerate(got["v"]):
        v[i, row.values.to_numpy(zero_copy_only=False)] = 1
    post = label_model(v, float(got["_y"].to_numpy().mean()))
    ids = got["_id"].to_pylist()
    marks = spark.createDataFrame([(k, i, int(round(t * POSTERIOR_UNIT))) for i, (k, t) in enumerate(zip(ids, post.tolist()))], f"_id {kind}, _row int, t long")
    labelled = seen.join(F.broadcast(marks), "_id").select("_row", "x", "t")
    chosen = telling(labelled)
    places = spark.createDataFrame([(b, k) for k, b in enumerate(chosen)], "b int, k int")
    kept = labelled.select("_row", F.explode("x").alias("b")).join(F.broadcast(places), "b").groupBy("_row").agg(F.sort_array(F.collect_list("k")).alias("k")).toArrow()
    index = [np.empty(0, np.int64)] * len(ids)
    for i, ks in zip(kept["_row"].to_pylist(), kept["k"]):
        index[i] = ks.values.to_numpy(zero_copy_only=False)
    return train_linear(index, post, chosen)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (score >= 0.5) of every row, from its text alone.

    Learns only from labelled rows whose crc32(id as text) mod 5 isn't 0, MAX_ROWS of them at most.
    Null labels and ids take no part. A null or empty text gets the score of a text without features.
    Without any training label all scores are one half. Repeated rows are scored
    alike; of several labels of an id the largest counts, of several texts of a labelled id the first in order. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    key = docs[id_col].cast("string")
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), F.coalesce(F.crc32(key.cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"))
    truth = labels.select(labels[id_col].alias("_l"), labels[label_col].cast("int").alias("_y")).where("_l is not null and _y is not null").groupBy("_l").agg(F.max("_y").alias("_y"))
    truth = truth.where(F.crc32(F.col("_l").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("_l"), "_l").limit(MAX_ROWS)
    sample = materialize(rows.join(F.broadcast(truth), rows["_id"] == truth["_l"]).groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_text").alias("_text")))
    model = spark.sparkContext.broadcast(fit(sample))

    def run(batches):
        w, bias = model.value
        weights = FeatureWeights(w)
        for batch in batches:
            scores = []
            for text in batch.column(1):
                f = features(text.as_py())
                z = bias + sum(map(weights.__getitem__, f))
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            s = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["_id", "held_out", "score", "predicted"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)
