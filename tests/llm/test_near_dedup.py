"""Near duplicates against brute force: random copies, hot groups that straddle the threshold, odd rows."""

import random

import numpy as np
import pytest

from tallyfield.llm import near_dedup
from tallyfield.llm.common import checkpointed


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    """{id: (set size, component)}, and the pairs' similarities."""
    sets = {d: shingle_set(t, k) for d, t in rows if d is not None}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed, bases=12, copies=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    texts = []
    for b in range(bases):
        base = [word() for _ in range(rng.randint(60, 160))]
        texts.append(base)
        for _ in range(copies):
            new = list(rng.choice(texts[-5:]) if b % 3 == 0 else base)
            for _ in range(rng.randint(0, 7)):
                new[rng.randrange(len(new))] = word()
            texts.append(new)
    rng.shuffle(texts)
    rows = [(i * 3 + 5, rng.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]
    odd = [None, "", " \t\n", "one", "ONE", "one two", "One TWO", "one two three", "É", "é", "w " * 3000, "\u00a0"]
    return rows + [(5000 + i, t) for i, t in enumerate(odd)]


@pytest.mark.parametrize(("seed", "k", "percent", "small"), [(1, 3, 85, 4), (2, 3, 80, 1)])
def test_components_match_brute_force(spark, monkeypatch, seed, k, percent, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in [*rows, rows[0], rows[7], (None, rows[3][1])]], "doc_id long, text string, digest string, id int")
    got = near_dedup.near_duplicates(docs, k, percent).collect()
    want = brute(rows, k, percent)
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = near_dedup.keep_one_of_each(docs, k, percent)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id}) == sorted(d for d, (_, c) in want.items() if d == c)


def test_tables_without_rows_or_candidates(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == near_dedup.keep_one_of_each(empty).count() == 0
    apart = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id int, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(apart).collect()} == {(1, 1), (2, 2)}


def reached(links):
    label = {}
    root = lambda x: x if label.setdefault(x, x) == x else root(label[x])
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {frozenset(x for x in label if root(x) == r) for r in {root(x) for x in label}}


def all_rounds(rows, percent):
    found, rounds = [], 0
    while rows is not None:
        more, rows = near_dedup.compared(rows, percent)
        found += [(r.rep, r.member) for df in more for r in df.collect()]
        rows = rows and checkpointed(near_dedup.recentred(rows))
        rounds += 1
    return found, rounds


@pytest.mark.parametrize("small", [0, 4])
def test_rounds_lose_no_link(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCKED", 16)  # else a bucket of this size needs one round
    monkeypatch.setattr(near_dedup, "SIDE", 1)
    rng = random.Random(9)
    base = set(range(100))
    other = base ^ set(range(85, 115))  # a second group in the same bucket, apart from the first
    sets = [x ^ set(rng.sample(range(70, 130), rng.randint(1, 16))) for x in (base, other) for _ in range(60)]
    links = [(a, b) for a in range(120) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for centre in (base, set(), set(range(85, 140))):  # any centre will do
        rows = spark.createDataFrame([(7, i, len(s), sorted(s ^ centre)) for i, s in enumerate(sets)], near_dedup.DIFFERING)
        found, rounds = all_rounds(rows, 85)
        assert reached(found) == reached(links) and rounds > 1
        assert {(max(x), min(x)) for x in found} <= set(links)


def test_unlinked_copies_of_one_template_make_few_candidates(spark):
    rng = random.Random(4)
    n, template, fresh = 5000, list(range(150)), iter(range(1000, 10**9))
    sets = []
    for _ in range(n):  # too many words replaced for any two to be linked, by words of their own
        gone = set(rng.sample(template, rng.randint(25, 50)))
        sets.append([x for x in template if x not in gone] + [next(fresh) for _ in gone])
    rows = spark.createDataFrame([(1, i, 150, sorted(set(s) ^ set(template))) for i, s in enumerate(sets)], near_dedup.DIFFERING).repartition(8)
    slack = 15 * 150 - 185 * near_dedup.F.size("d")
    need = near_dedup.F.greatest(near_dedup.F.lit(1), near_dedup.F.ceil(-(slack + 15 * 150 - 185 * 50) / (2 * 185)))
    left = rows.withColumns({"failed": near_dedup.F.lit(True), "close": 1 - need, "wide": 1 - need})
    assert near_dedup.rarest_shared(left).count() < 2 * n
    found, _ = all_rounds(rows, 85)
    assert not found


def template(rng, n, slots=16, choices=3, words=300):
    """Documents of one text, each slot of it filled with one of a few words."""
    places = rng.sample(range(words), slots)
    for i in range(n):
        text = [f"w{k}" for k in range(words)]
        for p in places:
            text[p] = f"v{p}x{rng.randrange(choices)}"
        yield i + 1, " ".join(text)


@pytest.mark.parametrize(("n", "choices"), [(400, 3), (1600, 3), (400, 12)])
def test_shared_variants_of_a_template(spark, monkeypatch, n, choices):
    rows = list(template(random.Random(n + choices), n, choices=choices))
    sizes = []

    def counted(df):
        out = checkpointed(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "checkpointed", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 5, 80).collect()}
    variants = np.array([[hash(w) for w in t.split()] for _, t in rows])
    label = list(range(n))
    for i in range(n):  # words are windows of five: sets of shingles are positions, and all positions' texts differ
        same = variants[i] == variants[i + 1 :]
        windows = np.lib.stride_tricks.sliding_window_view(same, 5, axis=1).all(2).sum(1) if i + 1 < n else []
        for j in np.flatnonzero(100 * np.asarray(windows) >= 80 * (2 * 296 - np.asarray(windows))) + i + 1:
            a, b = i, int(j)
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            label[max(a, b)] = min(a, b)
    root = lambda x: x if label[x] == x else root(label[x])
    assert got == {i + 1: root(i) + 1 for i in range(n)}
    assert max(sizes) <= 32 * n and len(sizes) < 25  # no step has more rows than the 32 bands of each document


def test_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(2)
    base = set(range(100))
    sets = [base ^ set(rng.sample(range(60, 140), rng.randint(6, 14))) for _ in range(150)]
    links = [(a, b) for a in range(150) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    given = [(1, i, 15 * len(s) - 185 * len(s ^ base), i if i > 60 else 0, sorted(s ^ base)) for i, s in enumerate(sets)]
    rows = spark.createDataFrame(given, "key long, id long, slack long, component long, d array<long>")
    for side in (7, 64, 256):
        monkeypatch.setattr(near_dedup, "SIDE", side)
        found = [(r.rep, r.member) for r in near_dedup.in_blocks(rows, 85).collect()]
        assert {(max(x), min(x)) for x in found} <= set(links)
        chain = [(0, i) for i in range(1, 61)]
        assert reached(found + chain) == reached(links + chain)


def test_signatures_estimate_similarity():
    x = near_dedup.shingles(" ".join(f"w{i}" for i in range(1000)).encode(), 3)
    y = near_dedup.shingles(" ".join(f"w{i}" for i in range(200, 1200)).encode(), 3)
    a, b = near_dedup.signatures([x, y], 512)
    assert abs((a == b).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.1
