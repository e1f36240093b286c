"""Log-bilinear language model, trained with noise-contrastive estimation, and scores of whole texts.

The model predicts a word's class from the class before it: frequent words are classes of their
own, the rest share classes by their ending. With context vectors C, class vectors R and biases b,
log P(class | before) is the log-softmax of R @ C[before] + b; one matrix product gives it for all
classes after all classes. A word within its class has its add-one share of the class's tokens.

All training documents are counted: words in a shuffle that combines on the map side, pairs of
neighbouring classes as a matrix of fixed size. Noise-contrastive estimation then works on the
whole matrix at once: the expectation over the data and over the noise is exact, not sampled.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize
from .textwords import split_words

#: Classes that are one frequent word, classes by ending, and dimensions of a vector.
SINGLES, ENDINGS, DIMENSIONS = 768, 255, 32
#: Frequent words whose counts every worker holds; the counts of all others are joined.
HELD = 1 << 16
#: Noise samples for each token, steps of training, and its rate.
NOISE, STEPS, RATE = 10, 150, 0.08
#: The end of a text, which no word can be.
END = b"\n"
_CLASSES = SINGLES + ENDINGS + 1
LOG10 = math.log(10.0)


def ending_class(word: bytes) -> int:
    """Class of a word that has none of its own: by its last three bytes, punctuation aside."""
    return SINGLES + 1 + zlib.crc32(word.strip(b".,;:!?")[-3:]) % ENDINGS


def held_out(key) -> bool:
    return zlib.crc32(str(key).encode()) % 7 == 2


def _batches_of_counts(train: DataFrame) -> DataFrame:
    """(word, n, docs) of each batch of documents."""

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                counts.update(split_words(text.as_py(), fold=True))
            if batch.num_rows:
                counts[END] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return train.mapInArrow(run, "word binary, n long")


class Classes(dict):
    """Word to class, for the words of one worker; endings are worked out once for each word seen, up to a bound."""

    def __missing__(self, word):
        value = ending_class(word)
        if len(self) < 300_000:
            self[word] = value
        return value


def class_pairs(train: DataFrame, singles: list[bytes]) -> np.ndarray:
    """How often each class follows each, over all training documents. A text begins after the class of the end.

    Each task sends one sparse matrix of fixed shape; they are added up in Spark.
    """
    def run(batches):
        classes = Classes({w: k for k, w in enumerate(singles)})
        total = np.zeros(_CLASSES * _CLASSES, np.int64)
        for batch in batches:
            for text in batch.column(0):
                c = np.fromiter(map(classes.__getitem__, split_words(text.as_py(), fold=True)), np.int64)
                a = np.empty(len(c) + 1, np.int64)
                a[0], a[1:] = classes[END], c
                b = np.append(c, classes[END])
                total += np.bincount(a * _CLASSES + b, minlength=len(total)) if len(c) > 20_000 else 0
                if len(c) <= 20_000:
                    np.add.at(total, a * _CLASSES + b, 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])

    cells = train.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_CLASSES * _CLASSES)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(_CLASSES, _CLASSES)


def train_nce(pairs: np.ndarray, dimensions: int = DIMENSIONS, noise: int = NOISE, steps: int = STEPS, rate: float = RATE, seed: int = 7):
    """Vectors and biases that maximise the noise-contrastive objective over the matrix of counts."""
    rng = np.random.default_rng(seed)
    total = pairs.sum()
    after = pairs.sum(0)
    q = ((after + 1) / (after.sum() + len(after))).astype(np.float32)
    data = (pairs / max(total, 1)).astype(np.float32)
    before = data.sum(1, keepdims=True)
    mass = noise * before * q  # expected noise for each pair, per token
    weights = [rng.normal(0, 0.1, (len(q), dimensions)).astype(np.float32) for _ in range(2)] + [np.log(q)]
    offset = np.log(noise * q)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    scale = np.float32(len(q))
    for step in range(1, steps + 1):
        c, r, b = weights
        s = 1 / (1 + np.exp(-np.clip(c @ r.T + b - offset, -30, 30)))  # how surely each pair is data
        g = (data * (1 - s) - mass * s) * scale
        gradients = [g @ r, g.T @ c, g.sum(0)]
        for k, d in enumerate(gradients):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            weights[k] = weights[k] + rate * (1 - 0.9 * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return weights


def normalised(weights) -> np.ndarray:
    """log10 P(class | class before), rows normalised exactly."""
    c, r, b = (w.astype(np.float64) for w in weights)
    logits = c @ r.T + b
    logits -= logits.max(1, keepdims=True)
    return (logits - np.log(np.exp(logits).sum(1, keepdims=True))) / LOG10


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every row by the model and by add-one word frequencies, both as log10 probabilities of the whole text.

    Learns from rows whose crc32(id as text) mod 7 isn't 2. Returns id, held_out, n_tokens, n_known,
    train_tokens, base_score, score. A null or blank text is its end alone. A word that training doesn't
    have is scored as one unseen word of its class. Without training rows N is 0 and every token unseen.
    Repeated rows count as often as they occur; a null id counts as the text "null". Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    key = F.coalesce(docs[id_col].cast("string"), F.lit("null"))
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), (F.crc32(key.cast("binary")) % 7 == 2).alias("held_out"), F.xxhash64(docs[text_col].cast("string")).alias("_key"))
    train = rows.where("not held_out").select("_text")
    counts = materialize(_batches_of_counts(train).groupBy("word").agg(F.sum("n").alias("n")))
    n_train, n_distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    frequent = counts.orderBy(F.desc("n"), "word").limit(HELD).toArrow()  # bounded by HELD
    words, numbers = frequent["word"].to_pylist(), frequent["n"].to_pylist()
    singles = [END] + [w for w in words if w != END][:SINGLES]
    own = set(singles)
    # Tokens and distinct words of the classes by ending: sums of bounded number, one for each class.
    def by_ending(batches):
        for batch in batches:
            k = np.array([0 if w in own else ending_class(w) for w in batch.column(0).to_pylist()], np.int64)
            tokens = np.bincount(k, batch.column(1).to_numpy(zero_copy_only=False), _CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CLASSES)), pa.array(tokens.astype(np.int64)), pa.array(np.bincount(k, minlength=_CLASSES))], names=["c", "n", "v"])

    sums = counts.mapInArrow(by_ending, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    inside = np.zeros(_CLASSES)
    inside[sums["c"].to_numpy()] = -np.log10(sums["n"].to_numpy() + sums["v"].to_numpy() + 1.0)
    inside[: len(singles)] = 0.0
    transitions = normalised(train_nce(class_pairs(train, singles))).astype(np.float32)
    model = spark.sparkContext.broadcast((words, numbers, singles, transitions, inside))  # bounded by HELD and the classes
    base = -math.log10(n_train + n_distinct + 1)

    def run(batches):
        words, numbers, singles, transitions, inside = model.value
        classes = Classes({w: k for k, w in enumerate(singles)})
        own, held = set(singles), dict(zip(words, numbers))
        flat = transitions.ravel()
        for batch in batches:
            out = {"tokens": [], "known": [], "b": [], "s": []}
            rare_words, rare_counts = [], []
            for text in batch.column(1):
                split = split_words(text.as_py(), fold=True)
                c = np.fromiter(map(classes.__getitem__, split), np.int64, len(split))
                a = np.empty(len(c) + 1, np.int64)
                a[0], a[1:] = 0, c
                b = np.append(c, 0)
                score = float(flat[a * _CLASSES + b].sum(dtype=np.float64) + inside[b].sum())
                known, total, rare, rare_n = 0, 0.0, [], []
                for w, k in Counter(split).items():
                    n = held.get(w)
                    if n is None:
                        rare.append(w)
                        rare_n.append(k)
                    else:
                        known += k
                        log = k * math.log10(n + 1)
                        total += log
                        if w not in own:
                            score += log
                end = held.get(END)
                known += end is not None
                total += math.log10((end or 0) + 1)
                out["tokens"].append(len(b))
                out["known"].append(known)
                out["b"].append(total + len(b) * base)
                out["s"].append(score)
                rare_words.append(rare)
                rare_counts.append(rare_n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out["tokens"], pa.int64()), pa.array(out["known"], pa.int64()), pa.array(out["b"], pa.float64()), pa.array(out["s"], pa.float64()), pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_counts, pa.list_(pa.int64()))], names=["_id", "held_out", "_key", "n_tokens", "known", "b", "s", "words", "counts"])

    kind = rows.schema["_id"].dataType.simpleString()
    partly = materialize(rows.mapInArrow(run, f"_id {kind}, held_out boolean, _key long, n_tokens long, known long, b double, s double, words array<binary>, counts array<long>"))
    # Words that no worker holds: their counts are joined; none is more frequent than the last one held.
    lists = partly.where(F.size("words") > 0).select("_id", "_key", "words", "counts").dropDuplicates(["_id", "_key"])
    pairs = lists.select("_id", "_key", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("_id", "_key", F.col("x.words").alias("word"), F.col("x.counts").alias("k"))
    found = pairs.join(counts, "word")
    rare = found.groupBy(F.col("_id").alias("_of"), F.col("_key").alias("_of_key")).agg(F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_log"))
    same = partly["_id"].eqNullSafe(F.col("_of")) & (partly["_key"] == F.col("_of_key"))
    none = F.lit(0)
    return partly.join(rare, same, "left").select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", none)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("b") + F.coalesce("rare_log", F.lit(0.0))).alias("base_score"), (F.col("s") + F.coalesce("rare_log", F.lit(0.0))).alias("score"),
    )
