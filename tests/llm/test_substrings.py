"""Repeated windows of words and bytes against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm import substring_dedup, suffix_dedup, superkmers


def brute(docs, k):
    """docs: {id: sequence}; which symbols are covered by windows that start earlier."""
    seen, out = set(), {}
    for d in sorted(docs):
        gone = np.zeros(len(docs[d]), bool)
        for i in range(len(docs[d]) - k + 1):
            window = docs[d][i : i + k]
            if window in seen:
                gone[i : i + k] = True
            seen.add(window)
        out[d] = gone
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(6)]
    docs = {}
    for d in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages)[rng.randint(0, 30) :])
        docs[d] = rng.choice([" ", "\n", "  "]).join(parts)
    docs |= {200: docs[7], 201: "x " * 500, 202: "ab " * 300 + docs[8], 203: "", 204: " \n", 205: "z" * 3000, 206: docs[9] * 3, 207: "q" * 99, 208: "one two"}
    return docs


@pytest.fixture(scope="module")
def table(spark):
    docs = corpus()
    rows = [(d, t, "clash") for d, t in docs.items()] + [(11, docs[11], "clash"), (900, None, "clash"), (None, docs[7], "clash")]
    return docs | {900: ""}, spark.createDataFrame(rows, "doc_id long, text string, packed string")


@pytest.mark.parametrize("hot", [superkmers.HOT_STRINGS, 2])
def test_words_match_brute_force(spark, table, hot, monkeypatch):
    monkeypatch.setattr(superkmers, "SAMPLE", 1)
    docs, rows = table
    got = {r.doc_id: r for r in substring_dedup.word_digests(rows, hot_strings=hot).where("doc_id is not null").collect()}
    want = brute({d: tuple(t.encode().split()) for d, t in docs.items()}, 20)
    for d, gone in want.items():
        words = docs[d].encode().split()
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(words), gone.sum(), hashlib.sha256(kept).hexdigest()), d
    assert substring_dedup.word_digests(rows).count() == rows.count()


@pytest.mark.parametrize("hot", [superkmers.HOT_STRINGS, 2])
def test_bytes_match_brute_force(spark, table, hot, monkeypatch):
    monkeypatch.setattr(superkmers, "SAMPLE", 1)
    docs, rows = table
    got = {r.doc_id: r for r in suffix_dedup.byte_digests(rows, hot_strings=hot).where("doc_id is not null").collect()}
    for d, gone in brute({d: t.encode() for d, t in docs.items()}, 100).items():
        kept = bytes(b for b, g in zip(docs[d].encode(), gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(gone), gone.sum(), spans, hashlib.sha256(kept).hexdigest()), d


def test_empty_tables_and_texts(spark, table):
    _, rows = table
    assert substring_dedup.word_digests(rows.limit(0)).count() == suffix_dedup.byte_digests(rows.limit(0)).count() == 0
    first = substring_dedup.remove_repeated_words(rows).where("doc_id = 208").head()
    assert (first.n_removed, first.text) == (0, "one two")
    assert suffix_dedup.remove_repeated_bytes(rows).where("doc_id = 207").head().kept == b"q" * 99


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=40, max_size=160), min_size=1, max_size=6))
def test_suffix_blocks_find_every_repeat(texts):
    k = 40
    data = [t.encode() for t in texts]
    got = suffix_dedup.neighbours(k)(data, np.array([len(t) - k + 1 for t in data]))
    seen, want = set(), []
    for t in data:
        for i in range(len(t) - k + 1):
            want.append(t[i : i + k] in seen)
            seen.add(t[i : i + k])
    assert got.tolist() == want


def test_small_suffix_buckets_and_order():
    rng = random.Random(2)
    data = bytes(rng.choices(b"ab", k=4000)) + b"a" * 500 + bytes(rng.choices(b"abc", k=2000)) * 2
    at = np.arange(len(data) - 60)
    order, _ = suffix_dedup.suffix_order(data, at, 60, block=64)
    assert [data[i : i + 60] for i in order.tolist()] == sorted(data[i : i + 60] for i in at.tolist())


def test_long_texts_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(superkmers, "PIECE", 300)
    words = superkmers.Words(20, 5)
    text = b" ".join(b"w%d" % i for i in range(2000))
    starts = [s + i for base, part in superkmers.pieces(words, text) for s, n in [(base, 0)] for _, a, many, _, _ in [superkmers.packed(words, part)] for x, c in zip(a, many, strict=True) for i in range(x, x + c)]
    assert starts == list(range(1981))
