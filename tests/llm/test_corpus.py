"""Corpus operators: awkward inputs, brute force, round trips and held-out accuracy on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from penumbra.llm import bpe, decontam, lengths, linededup, lm, neardup, quality, queries, sharding, substring, toxicity

tokenizers = pytest.importorskip("tokenizers")
COLUMNS = "doc_id long, text string, n_words int, kept string, shard int, _id string"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results and internals."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", None, "y") for i, t in zip(ids, texts)], COLUMNS)


WORDS = [a + b for a in "ka mi so tu ren dal vor".split() for b in "lo pi ser ana tik".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "x", "y", "z"]) + r.choice(WORDS) for _ in range(n))


AWKWARD = [None, "", " \n\t ", "one", "two words", "a\n\nb\n", prose(1, 60), prose(1, 60), prose(2, 3000), "ñandú É ü 漢字 " * 30, "###", "x" * 5000]


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(queries.VOCABULARY)


def test_bpe_matches_the_library(spark, reference):
    texts = [*AWKWARD, "it's 'll<|endoftext|> go  \n x", "a" * 20_000, " " * 9_000 + "end"]
    for r, t in zip(bpe.encode_documents(table(spark, texts), queries.VOCABULARY, with_ids=True).orderBy("doc_id").collect(), texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(table(spark, []), queries.VOCABULARY).count() == 0


def test_bpe_streams_with_bounded_tail(reference):
    merges = bpe.Merges(bpe.read_vocabulary(queries.VOCABULARY))
    text = prose(3, 400) + "a" * 9_000 + "<|endoftext|> é " + prose(4, 50)
    coder, back, out, said = bpe.Transducer(merges), bpe.Detokenizer(merges), [], ""
    r = random.Random(1)
    at = 0
    while at < len(text):
        step = r.choice([1, 5, 300])
        new = coder.feed(text[at : at + step])
        out += new
        said += back.feed(new)
        at += step
    last = coder.finish()
    assert out + last == reference.encode(text, add_special_tokens=False).ids
    assert said + back.feed(last) + back.finish() == text


def test_lengths_answer_every_limit(spark, reference):
    texts = [t for t in AWKWARD]
    sizes = [len(reference.encode(t or "", add_special_tokens=False).ids) for t in texts]
    c = lengths.token_counts(lengths.length_histogram(table(spark, texts), queries.VOCABULARY)).cache()
    for r in c.collect():
        assert r.truncated_tokens == sum(min(r.n_tokens, s) for s in sizes) and r.docs_longer == sum(s > r.n_tokens for s in sizes)
        assert r.tokens_longer == sum(s for s in sizes if s > r.n_tokens)
    for limit in (0, 1, 50, 10**6):
        assert lengths.truncated_total(c, limit) == sum(min(limit, s) for s in sizes)
    assert lengths.quantile_length(c, 0.5) == sorted(sizes)[math.ceil(len(sizes) / 2) - 1]
    assert lengths.token_counts(lengths.length_histogram(table(spark, []), queries.VOCABULARY)).count() == 0


def test_quality(spark):
    good = "the cat and the dog of " + prose(5, 80)
    repeated = " ".join(["same old words here"] * 40)
    symbols = " ".join(w + "###" for w in good.split())
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, [*AWKWARD, good, repeated, symbols])).collect()}
    n = len(AWKWARD)
    assert got[n].kept and not got[n + 1].kept and got[n + 1].base_failed and not got[n + 2].kept
    assert all(got[k].base_failed for k in (0, 1, 2, 3, 4))
    for k, t in enumerate([*AWKWARD, good, repeated, symbols]):
        w = (t or "").encode().split()
        w = [x.decode() for x in w]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
        assert (got[k].n_words, got[k].n_repeat_words, got[k].word_chars) == (len(w), len(hit), sum(map(len, w)))
    assert quality.keep_good(table(spark, [good, None])).columns == table(spark, []).columns
    assert [r.doc_id for r in quality.keep_good(table(spark, [None, good])).collect()] == [1]
    assert quality.quality_rules(table(spark, [])).count() == 0


def test_decontamination(spark):
    item, short = prose(6, 20), "Quick brown fox"
    b = spark.createDataFrame([("b", item), ("a", short), ("c", None), ("d", ""), ("e", "solo")], "item_id string, text string")
    texts = [*AWKWARD, prose(7, 30) + " " + item.upper() + " " + prose(8, 10), "a quick, BROWN fox", "solo solo", prose(9, 300) + " quick brown fox", " ".join(item.split()[:12])]
    got = {r.doc_id: r for r in decontam.contamination(table(spark, texts), b).collect()}
    n = len(AWKWARD)
    assert (got[n].n_hit, got[n].n_items, got[n].contaminated) == (20, 1, True)
    assert (got[n + 1].n_hit, got[n + 1].contaminated) == (3, True)
    assert got[n + 2].n_hit == 2 and got[n + 2].items_sha256 == hashlib.sha256(b"e").hexdigest()
    assert got[n + 3].n_hit == 3 and not got[n + 3].contaminated
    assert got[n + 4].n_hit == 0 and not any(got[k].contaminated for k in range(n))
    left = {r.doc_id for r in decontam.drop_contaminated(table(spark, texts), b).collect()}
    assert left == {k for k in range(len(texts)) if not got[k].contaminated}
    assert not decontam.contamination(table(spark, texts), b.limit(0)).where("n_hit > 0").count()
    assert decontam.contamination(table(spark, []), b).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(2)
    texts = list(AWKWARD)
    for base in range(4):
        words = prose(20 + base, 80).split()
        for _ in range(12):
            w = list(words)
            for _ in range(r.choice([0, 1, 3, 6, 9])):
                w[r.randrange(len(w))] = prose(r.random(), 1)
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:])) or frozenset(map(tuple, [w] if w else [])))
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    docs = table(spark, texts)
    got = {x.doc_id: x for x in neardup.near_duplicates(docs, shingle=2).collect()}
    assert [got[k].component_id for k in range(len(texts))] == [root(k) for k in range(len(texts))]
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    kept = {x.doc_id for x in neardup.keep_one_of_each(docs, shingle=2).collect()}
    assert kept == {k for k in range(len(texts)) if root(k) == k}
    assert neardup.near_duplicates(table(spark, []), shingle=2).count() == 0
    odd = neardup.near_duplicates(table(spark, [prose(1, 60)] * 3, [None, 5, 5]), shingle=2).collect()
    assert sorted((x.doc_id or 0, x.component_id) for x in odd) == [(0, 5), (5, 5), (5, 5)]


def test_components_of_chains_stars_and_random_links(spark):
    r = random.Random(3)
    chain = [(k, k + 1) for k in range(100, 140)]
    zigzag = list(zip(*[iter(r.sample(range(200, 240), 40))] * 2))
    star = [(399, k) for k in range(300, 330)]
    links = [*chain, *zigzag, *star, *[(r.randrange(500, 560), r.randrange(500, 560)) for _ in range(40)], (100, 101), (7, 7)]
    parent = {n: n for link in links for n in link}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_estimate_similarity():
    r = np.random.default_rng(4)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        a, b = np.unique(pool[:1000]), np.unique(np.r_[pool[: int(1000 * 2 * share / (1 + share))], pool[2000 : 3000 - int(1000 * 2 * share / (1 + share))]])
        equal = (neardup.registers(a) == neardup.registers(b)).mean()
        assert abs(equal - share) < 0.15
        one = lambda x: neardup.registers(x)[None, :]
        assert neardup.plausible(one(a), one(b), np.array([1000.0]), np.array([float(len(b))]), 0.8)[0] == (share >= 0.8) or share == 0.8
    merged = np.maximum(neardup.registers(pool[:700]), neardup.registers(pool[300:]))
    assert (merged == neardup.registers(pool)).all()


def test_sharding(spark):
    texts = [*AWKWARD, *[prose(k, 20 + k % 50) for k in range(300)], *["hot text"] * 120]
    rows = sharding.shard_documents(table(spark, texts)).collect()
    groups, sizes, slots = {}, Counter(), {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
        groups.setdefault(t, set()).add(r.shard)
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, groups.values())) == 1 and len(rows) == len(texts)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # One text is larger than an even share and has a shard alone; the others are alike.
    giant, *others = sorted(sizes.values(), reverse=True)
    assert giant == max(len((t or "").encode()) for t in texts) + 1 and len(others) == 7
    assert max(others) < 1.05 * sum(others) / 7
    assert sharding.shard_documents(table(spark, [])).count() == 0


def test_best_fit_decreasing_takes_the_tightest_bin():
    assert sharding.best_fit_decreasing([("a", 7), ("b", 6), ("c", 3), ("d", 4)], 10) == {"a": 0, "b": 1, "d": 1, "c": 0}
    r = random.Random(1)
    items = [(k, r.randint(1, 50)) for k in range(400)]
    placed = sharding.best_fit_decreasing(items, 100)
    fill = Counter()
    for k, s in items:
        fill[placed[k]] += s
    assert max(fill.values()) <= 100 and len(fill) <= math.ceil(sum(s for _, s in items) / 100) + 2


def test_line_dedup_keeps_first_chunks(spark):
    passage = "\n".join(prose(30 + k, 9) for k in range(40))
    texts = [*AWKWARD, passage + "\nfirst tail", "own head\n" + passage, passage + "\nfirst tail"]
    got = {r.doc_id: r for r in linededup.line_dedup(table(spark, texts)).collect()}
    n = len(AWKWARD)
    assert got[n].n_removed == 0 and got[n].kept_text == texts[n]
    assert got[n + 1].n_removed > 10 and got[n + 1].kept_text.startswith("own head")
    assert got[0].kept_text is None and got[1].kept_text == "" and got[1].n_lines == 1
    assert all(got[k].n_removed == 0 for k in range(n))
    out = linededup.without_repeated_lines(table(spark, texts))
    assert out.columns == table(spark, []).columns and {r.doc_id: r.text for r in out.collect()} == {k: v.kept_text for k, v in got.items()}
    assert linededup.line_dedup(table(spark, [])).count() == 0


def test_substring_dedup_equals_brute_force(spark):
    shared = prose(40, 60)
    texts = [*AWKWARD, prose(41, 20) + " " + shared, shared + "  " + prose(42, 9), prose(43, 12), prose(43, 12), shared]
    first = {}
    words = [(t or "").encode().split() for t in texts]
    for k, w in enumerate(words):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    got = {r.doc_id: r for r in substring.substring_dedup(table(spark, texts)).collect()}
    for k, w in enumerate(words):
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(13)}
        assert got[k].n_removed == len(gone) and got[k].kept_text == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    longest = {r.doc_id: r.length for r in substring.longest_repeats(table(spark, texts)).collect()}
    assert longest[len(AWKWARD)] == 52 and 3 not in longest
    assert substring.substring_dedup(table(spark, [])).count() == 0
    nulls = substring.substring_dedup(table(spark, [shared, shared], [None, None])).collect()
    assert [r.n_removed for r in nulls] == [0, 0]


def test_lm_beats_unigrams_on_held_out_text(spark):
    r = random.Random(6)
    tongues = [["the", "of", "and", "ship", "sea"], ["der", "und", "das", "haus", "berg"]]
    texts = [None, "", *[" ".join(r.choice(tongues[k % 2]) for _ in range(60)) for k in range(120)], "never seen word"]
    rows = lm.score_documents(table(spark, texts)).collect()
    count = Counter()
    words = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    for k, w in enumerate(words):
        if not lm.held_out(k):
            count.update(w)
    total, kinds = sum(count.values()), len(count)
    for x in rows:
        w = words[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(w), sum(count[t] > 0 for t in w), total, lm.held_out(x.doc_id))
        assert abs(x.base_score - sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in w)) < 1e-6
    out = [x for x in rows if x.held_out and x.n_tokens > 10]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)
    assert lm.score_documents(table(spark, [])).count() == 0


def test_lm_is_normalised():
    pairs = np.random.default_rng(1).integers(0, 9, (20, 20)).astype(float)
    p = 10 ** lm.normalised(lm.train_nce(pairs, dimensions=20, steps=400))
    assert np.allclose(p.sum(1), 1)
    assert np.corrcoef(p.ravel(), (pairs / pairs.sum(1, keepdims=True)).ravel())[0, 1] > 0.9


def test_toxicity_held_out(spark):
    r = random.Random(8)
    texts, marks = [], []
    for k in range(400):
        bad = k % 6 == 0
        words = prose(k + 500, 40).split()
        if bad:
            for w in r.sample(["idiot", "scum", "grubnak", "grubnel", "grubnor"], 2):
                words[r.randrange(40)] = w
        texts.append(" ".join(words))
        marks.append((k, int(bad)))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    rows = {x.doc_id: x for x in toxicity.score_toxicity(docs, labels).collect()}
    out = [(rows[k].predicted, y) for k, y in marks if rows[k].held_out]
    assert sum(p == y for p, y in out) >= 0.95 * len(out) and all(0 <= x.score <= 1 for x in rows.values())
    assert rows[400].predicted == rows[401].predicted == 0
    assert toxicity.score_toxicity(table(spark, []), labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = ["the and of to in " + prose(k + 900, 70) for k in range(6)]
    item = prose(950, 40)
    texts = [*AWKWARD, *good, good[0] + " tail", good[1] + " " + item]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]
    n = len(AWKWARD)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(n, n + 6))


def test_rare_voters_are_found_behind_many_common_words(spark):
    common = " ".join(f"w{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(17_576))
    common += " " + common.replace("w", "v")
    rows = [(1, f"{common} zzrude" if k < 4 else common) for k in range(5)] + [(0, common)] * 5
    assert toxicity.learn_voters(spark.createDataFrame(rows, "_y int, _text string")) == [b"zzru*", b"zzrud*", b"zzrude"]
