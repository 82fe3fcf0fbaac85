"""Periodic runs against brute force: random, periodic and Fibonacci texts, odd rows, whole documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyfield.llm import runs
from tallyfield.llm.catalog import op12_periodic_runs


def brute(w):
    """For each period the longest stretches of equal words that far apart; the smallest period of each counts."""
    w, found = np.asarray(w), {}
    for q in range(1, len(w) // 2 + 1):
        equal = np.r_[False, w[:-q] == w[q:], False].astype(int)
        for i, j in zip(np.flatnonzero(np.diff(equal) == 1).tolist(), np.flatnonzero(np.diff(equal) == -1).tolist(), strict=True):
            if j - i + q >= max(12, 2 * q):
                stretch = w[i : j + q]
                if not any((stretch[e:] == stretch[:-e]).all() for e in range(1, q)):
                    found[i, j + q - i, q] = True
    return sorted(found, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts(rng, n):
    kind, letters = rng.random(), rng.choice([1, 2, 2, 3, 5, 20])
    if kind < 0.4:
        return [rng.randrange(letters) for _ in range(n)]
    if kind < 0.7:
        w = []
        while len(w) < n:
            u = [rng.randrange(letters) for _ in range(rng.randint(1, 15))]
            w += (u * rng.randint(1, 8))[: rng.randint(1, 60)]
        return w
    w = fibonacci(max(n, 2))
    w[rng.randrange(len(w))] = rng.randrange(3)
    return w


def test_runs_of_short_texts_match_brute_force():
    rng = random.Random(11)
    for _ in range(4000):
        w = texts(rng, rng.randint(0, 90))
        assert runs.find_runs(np.array(w, np.int64)) == (brute(w) if w else []), w


@pytest.mark.parametrize("letters", [2, 3])
def test_runs_of_long_texts_match_brute_force(letters):
    rng = random.Random(letters)
    w = [rng.randrange(letters) for _ in range(3000)] + [5] * 300 + fibonacci(700) + list(range(400)) * 3
    assert runs.find_runs(np.array(w, np.int64)) == brute(w)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers = {x: k for k, x in enumerate(dict.fromkeys(words))}
    found = brute([numbers[x] for x in words]) if words else []
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(x for i, x in enumerate(words) if i not in gone)))


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in op12_periodic_runs(spark, sf).collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark):
    line = "a b\u00a0c d e\n"
    rows = [(1, None), (2, ""), (3, " \n"), (4, line * 4), (4, line * 4), (None, line * 4), (6, "x " * 11), (7, "x " * 12), (8, "y " * 200_000), (9, "\u0085 " * 13), (10, "word " * 5), (20, "é\x0bß " * 30)]
    table = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id int, text string, start int, runs int")
    got = {tuple(r) for r in runs.run_digests(table).collect()}
    assert got == {expected(d, t) for d, t in rows if d != 8} | {(8, 1, 0, 200_000, 1, 200_000_000, hashlib.sha256(b"0,200000,1\n").hexdigest(), hashlib.sha256(b"y").hexdigest())}
    assert runs.run_digests(table).count() == len(rows)
    found = {tuple(r) for r in runs.find_in_texts(table.where("doc_id in (4, 7)")).collect()}
    assert found == {(4, 0, 16, 4, "a b\u00a0c d e"), (7, 0, 12, 1, "x")}
    assert runs.run_digests(table.limit(0)).count() == runs.find_in_texts(table.limit(0)).count() == 0
