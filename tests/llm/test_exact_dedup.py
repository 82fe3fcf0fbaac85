"""Exact deduplication against brute force: ties, repeats, a hot text, nulls, clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

from tallyfield.llm import exact_dedup


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def corpus():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab é\n\t", k=rng.randint(0, 5))) for _ in range(300)]
    texts += [" hot text" * 3] * 400 + ["hottexthottext hottext"] * 5 + [None, "", " \n", "\u00a0", "\u0085x", "long " * 60_000, "long" * 60_000]
    rng.shuffle(texts)
    rows = [(i * 2 + 1, t) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[5], rows[5]]


def test_groups_match_brute_force(spark):
    rows = corpus()
    groups = defaultdict(list)
    for d, t in rows:
        groups[bare(t)].append((-len(t or ""), d))
    docs = spark.createDataFrame([(d, t, "norm", "head", 1) for d, t in rows], "doc_id int, text string, norm string, head string, row int").repartition(7)
    got = exact_dedup.exact_duplicates(docs).collect()
    want = sorted((d, min(groups[bare(t)])[1], len(groups[bare(t)]), hashlib.sha256(bare(t).encode()).hexdigest()) for d, t in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(min(g)[1], dict(rows)[min(g)[1]]) for g in groups.values()} and kept.count() == len(groups)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (4, "ab"), (None, "c"), (9, "c ")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {(None, None, 2), (4, None, 2), (None, 9, 2), (9, 9, 2)}
    empty = docs.limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == exact_dedup.drop_exact_duplicates(empty).count() == 0
