"""Collocations against brute force over all phrases; shards, tries and the Bloom filter on their own."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from penumbra.llm import collocations

COLUMNS = "doc_id long, text string, lang string, phrase string, n int, a long, score string, left string"


def table(spark, rows):
    """Documents with extra columns whose names clash with results and internals."""
    return spark.createDataFrame([(k, t, lang, "p", 1, 2, "s", "l") for k, (t, lang) in enumerate(rows)], COLUMNS).repartition(3)


def brute(rows, least, depth=5, percent=100):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", folded):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    out = {}
    for (lang, words), a in counts.items():
        if len(words) > 1 and a >= least:
            cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang, words] = (a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score)
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    gone = {(l1, w1) for (l1, w1), x in out.items() for (l2, w2), y in out.items() if l1 == l2 and len(w2) > len(w1) and inside(w1, w2) and 100 * y[0] >= percent * x[0]}
    return sorted((lang, " ".join(w), *x) for (lang, w), x in out.items() if (lang, w) not in gone)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["The", "river", "élan", "a", "漢字", "b\x01c", "x-y", "ÀB", "of", "stone", "\x01"]
    phrases = ["the old stone bridge of", "New York City", "a b a b a b"]
    out = []
    for _ in range(n):
        parts = [r.choice([*words, *phrases]) + r.choice([" ", " ", "\t", ". ", ", ", "\n", "\r\n", "  ", "!?"]) for _ in range(r.randrange(40))]
        out.append(("".join(parts), r.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("least, depth, percent", [(3, 5, 100), (8, 3, 100), (4, 5, 60), (5, 2, 100)])
def test_all_phrases(spark, monkeypatch, least, depth, percent):
    monkeypatch.setattr(collocations.shards, "__defaults__", (200,))
    rows = [*corpus(least, 300), (None, "en"), ("", None), (" \n", "de"), ("one", "fr"), ("one two one two one two one two one two one two one two one two", "es"), ("a b " * 2000, "it")]
    found = collocations.collocations(table(spark, rows), depth=depth, least=least, percent=percent)
    got = sorted(tuple(r) for r in found.select("lang", "phrase", "a", "l", "r", "n", "score").collect())
    want = brute(rows, least, depth, percent)
    assert got == want and len(want) > 20
    top = collocations.best_of_each(found, 7).collect()
    for lang in {w[0] for w in want}:
        order = sorted((w for w in want if w[0] == lang), key=lambda w: (-w[6], -w[2], w[1].encode()))[:7]
        assert [(r["phrase"], r["score"]) for r in sorted((r for r in top if r["lang"] == lang), key=lambda r: r["rank"])] == [(w[1], w[6]) for w in order]


def test_empty_tables(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(None, None), ("", "en")]), least=1).count() == 0


def test_tries_of_any_shards_add_up():
    rows = corpus(5, 120)
    batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" for _, lang in rows]), pa.array([t.encode() for t, _ in rows], pa.binary())], names=["lang", "text"])
    sums = []
    for take in (50, 1 << 20):
        total = Counter()
        for lang, words, numbers in collocations.shards([batch], take):
            everything = np.arange(len(words)) > 0
            trie = collocations.CountTrie(numbers, 4, everything)
            for level in range(4):
                phrases = trie.phrases(list(words), level).to_pylist()
                assert len(set(phrases)) == len(phrases)
                total.update({(lang, p): int(n) for p, n in zip(phrases, trie.levels[level][2]) if p != b"\n"})
        sums.append(total)
    assert sums[0] == sums[1] and len(sums[0]) > 500


def test_the_filter_finds_all_that_was_put_in(spark):
    words = spark.createDataFrame([("en", f"w{k}") for k in range(3000)] + [("de", "w1 w2")], "lang string, phrase string")
    bloom = collocations.Bloom(collocations.bloom_of(words).value)
    held, strange = collocations.Words(), collocations.Words()
    for k in range(3000):
        held[f"w{k}".encode()], strange[f"v{k}".encode()]
    marks = collocations.word_marks("en", held)
    assert bloom.has(marks[1:]).all() and bloom.has(collocations.word_marks("en", strange)).mean() < 0.02
    german = collocations.word_marks("de", held)
    assert bloom.has(collocations.pair_marks(german[[held[b"w1"]]], german[[held[b"w2"]]])).all()
