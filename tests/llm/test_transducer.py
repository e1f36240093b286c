"""The streaming encoder against the tokenizers library, fed in pieces of any size."""

import random

import pytest

from penumbra.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
PARTS = ["\n", " ", "\t", " ", "　", "<|endoftext|>", "<|endo", "ftext|>", "<", "'", "'re", "a", "the", "1", "²", "é", "漢", "!!", " a", "  ", "\r\n", "x" * 70]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.VOCABULARY)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_vocabulary(queries.VOCABULARY))


def test_pieces_of_any_size_equal_the_library(library, merges):
    r = random.Random(11)
    coder = bpe.Transducer(merges)
    for _ in range(3000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 25)))
        want = library.encode(text, add_special_tokens=False).ids
        for size in (1, 3, 1000):
            assert [t for p in coder.pieces(text, size) for t in p] == want, (text, size)


@pytest.mark.parametrize("unit", [" ", "\n", "a", "the", "1", "!?", "漢", "é", " "])
def test_memory_stays_bounded_within_one_pretoken(library, merges, unit):
    text = "so" + unit * (60_000 // len(unit)) + " end<|endoftext|>" + unit * 9000
    coder, back, ids, said, most = bpe.Transducer(merges), bpe.Detokenizer(merges), [], "", 0
    for k in range(0, len(text), 501):
        new = coder.feed(text[k : k + 501])
        ids += new
        said += back.feed(new)
        most = max(most, len(coder.tail) + len(coder.run.held if coder.run else b""))
    last = coder.finish()
    assert ids + last == library.encode(text, add_special_tokens=False).ids
    assert said + back.feed(last) + back.finish() == text
    assert most < 4 * merges.lookahead + 3 * (coder.LONG + 501)


def test_a_megabyte_without_a_break(spark, library):
    texts = ["word" * 250_000, ("two words " * 100_000).strip()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(docs, queries.VOCABULARY, with_ids=True).collect():
        assert r.token_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
