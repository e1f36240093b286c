"""Null ids, null and empty texts, a text of a megabyte, repeated rows and clashing names, for every operator and stage."""

import itertools
import random
import zlib

import pytest

import corpus_pipeline
from penumbra.llm import bpe, decontam, lengths, linededup, lm, neardup, quality, queries, sharding, substring, toxicity

from test_corpus import prose, table

tokenizers = pytest.importorskip("tokenizers")
LONG = "\n".join(prose(3000 + k, 25) for k in range(4000))
TEXTS = [LONG, LONG, None, "", " \n", "one", LONG + "\nat last", prose(77, 60), None]
IDS = [None, 4, None, 6, 7, 8, 9, 10, 10]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 1_000_000
    return table(spark, TEXTS, IDS).repartition(3)


def rows_of(df, *columns):
    """Rows as tuples, null ids first."""
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))


def test_encoding_and_counts(docs):
    library = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    got = rows_of(bpe.encode_documents(docs, queries.VOCABULARY), "n_tokens")
    assert got == sorted(zip(IDS, want), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))
    last = lengths.token_counts(lengths.length_histogram(docs, queries.VOCABULARY)).orderBy("n_tokens").collect()[-1]
    assert (last.n_tokens, last.docs_up_to, last.docs_longer, last.tokens_longer) == (max(want), len(want), 0, 0)


def test_scores(docs):
    got = rows_of(lm.score_documents(docs), "n_tokens", "held_out", "score")
    words = lambda t: len((t or "").split())
    assert [(i, n) for i, n, _, _ in got] == sorted(((i, words(t) + 1) for i, t in zip(IDS, TEXTS)), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    assert all(held == (zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2) and s < 0 for i, _, held, s in got)


def test_quality_and_toxicity(spark, docs):
    got = rows_of(quality.quality_rules(docs), "n_words", "n_dup_lines", "kept")
    assert len(got) == len(TEXTS) and [r[1] for r in got if r[0] in (6, 7, 8)] == [0, 0, 1]
    assert max(r[1] for r in got) == 100_002
    labels = spark.createDataFrame([(4, 1, 0), (8, 1, 1), (None, 0, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    for truth in (labels, labels.limit(0)):
        scored = rows_of(toxicity.score_toxicity(docs, truth), "score", "predicted")
        assert len(scored) == len(TEXTS) and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in scored)


def test_decontamination_of_a_long_text(spark, docs):
    item = " ".join(LONG.split()[50_000:50_020])
    b = spark.createDataFrame([("deep", item), ("none", None), (None, ""), ("word", "one")], "item_id string, text string")
    got = {(i, n): (hit, items) for i, n, hit, items in rows_of(decontam.contamination(docs, b), "n_words", "n_hit", "n_items")}
    assert got[None, 100_000] == got[4, 100_000] == got[9, 100_002] == (20, 1) and got[8, 1] == (1, 1) and got[10, 60] == (0, 0)
    assert decontam.drop_contaminated(docs, b).count() == len(TEXTS) - 1


def test_copies_of_a_long_text(docs):
    near = rows_of(neardup.near_duplicates(docs, shingle=2), "component_id", "kept")
    assert [r for r in near if r[0] in (4, 9)] == [(4, 4, True), (9, 4, False)] and len(near) == len(TEXTS)
    lines = rows_of(linededup.line_dedup(docs), "n_lines", "n_removed")
    assert (None, 4000, 0) in lines and (4, 4000, 4000) in lines and [r for r in lines if r[0] == 9][0][2] >= 3990
    left = rows_of(substring.substring_dedup(docs), "n_words", "n_removed")
    assert (None, 100_000, 0) in left and (4, 100_000, 0) in left and (9, 100_002, 100_000) in left and (10, 60, 0) in left


def test_shards_of_awkward_rows(docs):
    got = sharding.shard_documents(docs, 3).collect()
    assert len(got) == len(TEXTS) and sum(r.size for r in got) == sum(len(t or "") + 1 for t in TEXTS)
    assert len({r.shard for r in got if r.size == len(LONG) + 1}) == 1 and {r.text_crc32 for r in got if r.size == 1} == {0}


def test_packing_is_close_to_the_best():
    """Against all ways to deal few groups: the fullest shard exceeds the best one's by two ninths at most."""
    r = random.Random(11)
    for trial in range(25):
        sizes = [r.randrange(1, 60) for _ in range(7)]
        placed = sharding.pack_into(list(enumerate(sizes)), 3)
        fullest = lambda where: max(sum(s for s, p in zip(sizes, where) if p == k) for k in range(3))
        best = min(map(fullest, itertools.product(range(3), repeat=7)))
        assert fullest([placed[k] for k in range(7)]) <= best * 11 / 9 + 1, sizes


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([("none", None), ("deep", prose(77, 60))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for source in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, source, str(tmp_path))
            assert out.columns == source.columns, name
            assert out.count() == 0 if source is not docs else out.count() <= len(TEXTS), name
        assert corpus_pipeline.STAGES[-1][1](spark, source, str(tmp_path)).count() == source.count()
