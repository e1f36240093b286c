"""Rows that share an id: what happens to one text must not happen to another text under the same id."""

import hashlib

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from penumbra.llm import decontam, linededup, lm, neardup, quality, sharding, substring, toxicity

from test_corpus import prose, table

X = "\n".join(prose(k, 20) for k in range(100, 110))
Y = "\n".join(prose(k, 20) for k in range(200, 210))
IDS = [1, 5, 5]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [X, X, Y], IDS)


def test_near_duplicates(spark, docs):
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True)]
    assert sorted((r.doc_id, r.text) for r in neardup.keep_one_of_each(docs).collect()) == [(1, X), (5, Y)]
    twice = table(spark, [X, X, X.replace(" ", "  ", 1), Y, None, None], [7, 7, 8, 7, 7, 7])
    kept = sorted((r.doc_id, r.text or "") for r in neardup.keep_one_of_each(twice).collect())
    assert kept == sorted([(7, X), (7, X), (7, Y), (7, ""), (7, "")])


def test_row_by_row_operators(docs):
    assert [r.n_words for r in quality.quality_rules(docs).collect()] == [200, 200, 200]
    assert sharding.shard_documents(docs, 2).count() == 3
    scored = lm.score_documents(docs)
    assert sorted((r.doc_id, r.n_tokens) for r in scored.collect()) == [(1, 201), (5, 201), (5, 201)]


def test_clashing_names_and_empty_tables(spark):
    empty = table(spark, [])
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, empty, "").columns == empty.columns, name
        assert stage(spark, empty, "").count() == 0, name


def test_decontamination(spark, docs):
    b = spark.createDataFrame([("item", X)], "item_id string, text string")
    got = sorted((r.doc_id, r.n_hit, r.contaminated) for r in decontam.contamination(docs, b).collect())
    assert got == [(1, 200, True), (5, 0, False), (5, 200, True)]
    assert [(r.doc_id, r.text) for r in decontam.drop_contaminated(docs, b).collect()] == [(5, Y)]
    short = table(spark, ["alpha beta", "beta alpha", None], [None, None, None])
    b = spark.createDataFrame([("a", "Beta"), ("b", "alpha beta"), (None, "alpha")], "item_id string, text string")
    assert sorted((r.n_hit, r.n_items) for r in decontam.contamination(short, b).collect()) == [(0, 0), (2, 1), (2, 2)]


def test_line_dedup(spark, docs):
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in linededup.line_dedup(docs).collect())
    assert got[0] == (1, 0, X) and got[1] == (5, 0, Y) and got[2][1] == 10
    out = sorted((r.doc_id, r.text) for r in linededup.without_repeated_lines(docs).collect())
    assert out == [(1, X), (5, ""), (5, Y)]
    left = linededup.without_repeated_lines(table(spark, [X, X, Y, None, "", X + "\n\n"], [1, 5, 5, 6, 7, 8]), drop_emptied=True)
    assert {(r.doc_id, r.text) for r in left.collect()} >= {(1, X), (5, Y), (6, None), (7, "")} and left.where("doc_id = 5").count() == 1
    twice = table(spark, [X, X, "y\n" + X, None], [None, None, None, None])
    assert sorted(r.n_removed for r in linededup.line_dedup(twice).collect())[:3] == [0, 0, 0]


def test_four_lines_have_a_chunk_wherever_they_stand(spark):
    texts = ["\n".join(prose(n * 50 + k, 3) for k in range(n)) for n in range(1, 40)] + ["\n" * 9, "a\nb\n" * 30]
    for r in table(spark, texts).select("text", linededup.chunks_of(linededup.line_hashes(F.col("text"))).alias("c")).collect():
        lines = r.text.split("\n")
        assert all(0 <= i < len(lines) - 1 for i in r.c) and len(set(r.c)) == len(r.c)
        for i in range(len(lines) - 3):
            alone = "\n".join(lines[i : i + 4])
            assert {i, i + 1, i + 2} & set(r.c), alone


def test_substring_dedup(spark, docs):
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in substring.substring_dedup(docs).collect())
    assert got == [(1, 0, " ".join(X.split())), (5, 0, " ".join(Y.split())), (5, 200, "")]
    for start in (2, 4, 13):
        assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in substring.substring_dedup(docs, start=start).collect()) == got
    assert substring.level_lengths(13, 4) == [4, 8] and substring.level_lengths(13, 7) == [7] and substring.level_lengths(52, 7) == [7, 14, 28] and substring.level_lengths(13, 13) == []
