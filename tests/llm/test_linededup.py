"""Line dedup: how much of planted passages it removes, and that it removes nothing that doesn't repeat."""

import random

import pytest

from penumbra.llm import common, linededup

from test_corpus import prose, table


def planted(seed, sizes, each=60, copies=2):
    """Documents of 3 to 9 lines of their own around passages of so many lines; (texts, places of passages after their first)."""
    r = random.Random(seed)
    texts, places, n = [], [], 0
    fresh = lambda k: [prose(seed * 1_000_000 + r.randrange(10**9), 7) for _ in range(k)]
    for k in sizes:
        for _ in range(each):
            passage = fresh(k)
            for copy in range(copies):
                head, tail = fresh(r.randrange(3, 10)), fresh(r.randrange(3, 10))
                if copy:
                    places.append((n, k, len(head)))
                texts.append("\n".join(head + passage + tail))
                n += 1
    return texts, places


def repeated_pairs(texts):
    """Lines that lie in two neighbouring lines that an earlier place has too."""
    seen, out = set(), {}
    for d, text in enumerate(texts):
        lines = [] if text is None else text.split("\n")
        for i, pair in enumerate(zip(lines, lines[1:])):
            if pair in seen:
                out.setdefault(d, set()).update((i, i + 1))
            seen.add(pair)
    return out


def test_recall_of_short_passages(spark):
    sizes = (2, 3, 4, 6, 8, 12, 20)
    texts, places = planted(1, sizes)
    got = {r.doc_id: r for r in linededup.line_dedup(table(spark, texts)).collect()}
    bound = repeated_pairs(texts)
    for d, text in enumerate(texts):
        kept = got[d].kept_text.split("\n")
        assert got[d].n_removed == len(text.split("\n")) - len(kept) <= len(bound.get(d, ()))
        assert all(x in text.split("\n") for x in kept)
    for k in sizes:
        removed = sum(got[d].n_removed for d, size, _ in places if size == k)
        touched = sum(got[d].n_removed > 0 for d, size, _ in places if size == k)
        if k >= 4:
            assert removed == k * 60 and touched == 60, k
    assert all(got[d].n_removed == 0 for d in range(len(texts)) if d not in bound)


def test_passages_in_many_documents(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)  # hot chunks, sources and spans go by the other way
    texts, places = planted(2, (5,), each=3, copies=70)
    texts += [texts[0]] * 40
    got = {r.doc_id: r for r in linededup.line_dedup(table(spark, texts)).collect()}
    assert all(got[d].n_removed == 5 for d, _, _ in places)
    assert all(got[d].kept_text == "" for d in range(len(texts) - 40, len(texts))) and got[0].n_removed == 0


@pytest.mark.parametrize("text, kept", [("x\nx\nx\nx", "x"), ("a\nb\na\nb\nc", "a\nb\nc"), ("\n\n\n", ""), ("a\nb", "a\nb"), ("a\nb\nc\na\nb", "a\nb\nc")])
def test_repeats_within_a_text(spark, text, kept):
    row = linededup.line_dedup(table(spark, [text])).first()
    assert row.kept_text == kept
