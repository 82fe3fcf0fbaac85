"""The pipeline's stages on the smallest tables, each against what it must keep."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfield.llm import language_id
from tallyfield.llm.common import checkpointed, held_out
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_must(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, SF))
        assert docs.columns == columns
        seen.append(docs.collect())
    assert all(a.doc_id in {b.doc_id for b in before} for before, after in zip(seen, seen[1:], strict=False) for a in after)
    assert all(any(map(str.isalpha, r.text)) for r in seen[1])
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    assert len(seen[2]) == len({bare(r.text) for r in seen[1]}) == len({bare(r.text) for r in seen[2]})
    assert not any(re.search(r"[a-z0-9]@[a-z0-9-]+\.[a-z]", r.text) for r in seen[4]) and len(seen[4]) == len(seen[3])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in seen[4]}


def test_language_stage_keeps_documents_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.text is not None and any(map(str.isalpha, r.text)))
    only_held_out = spark.createDataFrame([(k, "the thing", "en") for k in range(40)] + [(40, None, "en"), (41, "12 !!", "en")], "doc_id long, text string, lang string").where(held_out(F.col("doc_id")) | (F.col("doc_id") >= 40))
    only_held_out = only_held_out.withColumn("lang", F.when(held_out(F.col("doc_id")), F.col("lang")))
    assert sorted(r.doc_id for r in corpus_pipeline.identify(spark, only_held_out, SF).collect()) == sorted(r.doc_id for r in only_held_out.collect() if r.doc_id < 40) != []


def test_odd_tables(spark, tmp_path):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base, "en"), (2, base.replace(" ", "  "), "en"), (3, None, "en"), (4, "", None), (5, "12 !!", "de"), (5, "12 !!", "de"), (6, "mail a@b.co now", None), (7, "x" * 90_000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").selectExpr("*", "1 as key", "2 as row", "3 as pii_base", "'n' as norm")
    for name, some in (("odd", docs), ("empty", docs.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in packed} == {2, 6, 7}  # of equal texts the longest stays; texts without a letter go
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def near_kept(rows, words=5, percent=80):
    """Ids that stay, by all pairs of full sets."""
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in rows}
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = a, b
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                label[max(x, y)] = min(x, y)
    return {d for d in sets if label[d] == d}


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.collect()
    assert len(given) == 200
    seen, frame = [given], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = checkpointed(stage(spark, frame, SF))
        seen.append(frame.collect())
    model = language_id.train(docs)
    _, top, second = model.decode(language_id.ngram_frequencies([r.text for r in given]))
    assert {r.doc_id for r in seen[1]} == {r.doc_id for r, a, b in zip(given, top, second, strict=True) if r.text and any(map(str.isalpha, r.text)) and a - b >= language_id.REJECT_UNDER}
    groups = defaultdict(list)
    for r in seen[1]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in seen[2]} == {min(g)[1] for g in groups.values()}
    assert {r.doc_id for r in seen[3]} == near_kept(seen[2])
    texts = {r.doc_id: r.text for r in seen[4]}
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens.no_truncation(), tokens.no_padding()
    ids = {d: [*tokens.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.pack(spark, frame, SF).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for runs, ends in ((pieces, {d: len(x) for d, x in ids.items()}), (places, None)):
        for key, found in runs.items():
            at = 0
            for start, length in sorted(found):
                assert start == at
                at += length
            assert at == ends[key] if ends else at <= 2048
    assert set(pieces) == set(ids)
