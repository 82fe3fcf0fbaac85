"""BPE and packing against whole-text encoding and round trips."""

import functools
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm import bpe, packing, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
load = functools.cache(tokens.load)
ODD = [None, "", " ", "a", "  two  spaces\n\n end ", "It's <|endoftext|> I'LL  é é \u0085 x\x1cy", "tabs\tand\nlines\n \n x", "日本語 テキスト 🙂🙂", "repeat", "repeat"]


@pytest.fixture(scope="module")
def docs(spark):
    long = [("abc'll !!'s xyzzy1234é" * 900)[k:] for k in (0, 3)] + ["word " * 9000 + "x" * 3000]
    rows = [(i, t, "clash", 7) for i, t in enumerate(ODD + long + [long[0]])] + [(9, "repeat", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, start int")


def expected(text, path=WORD):
    t = load(path)
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("long_chars", [4, 4096, 1_000_000])
def test_bpe_matches_whole_text_encoding(spark, docs, path, long_chars):
    some = docs if long_chars > 4 else docs.where("length(text) < 100")
    got = sorted(map(tuple, bpe.token_digests(some.withColumn("doc_id", some.doc_id.cast("int")), path, long_chars=long_chars).collect()))
    assert got == sorted((r.doc_id, *expected(r.text, path)) for r in some.collect())
    assert bpe.token_digests(docs.limit(0), WORD).count() == 0


def test_bpe_ids_and_decoding(spark, docs):
    t = load(WORD)
    encoded = bpe.encode_documents(docs, WORD, long_chars=4096)
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: r.decoded for r in bpe.decode_ids(encoded, WORD).collect()} == {k: t.decode(v, skip_special_tokens=False) for k, v in want.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abtheingon'sl!?1 é́日\n", min_size=2, max_size=120), st.data())
def test_joined_halves_equal_the_whole(text, data):
    t = load(WORD)
    cut = data.draw(st.integers(1, len(text) - 1))
    left, right = bpe.encode_spans(t, text[:cut]), bpe.encode_spans(t, text[cut:], cut)
    assert bpe.join_spans(t, text, left, right, 0, len(text)).ids.tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abtheing  on'sl!?1 é́日\n", min_size=2, max_size=200), st.integers(1, 6), st.integers(1, 60))
def test_pieces_with_and_without_places(text, edge, step):
    for path in (WORD, BYTE):
        t = load(path)
        starts = range(0, len(text), step)
        parts = [(a, min(len(text), a + step), bpe.encode_piece(path, text[a : a + step], a, edge)) for a in starts]
        for a, b, own in parts:
            whole = bpe.encode_spans(t, text[a:b], a)
            seen = own.starts >= 0
            assert (own.ids == whole.ids).all() and (own.starts == whole.starts)[seen].all() and (own.ends == whole.ends)[seen].all()
        assert bpe.fold(t, text, parts).ids.tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sl!1 \n\té \x1c<|endoftxt>", max_size=60))
def test_chunks_keep_encodings(text):
    for path, prefix in ((WORD, ""), (BYTE, " ")):
        t = load(path)
        parts = tokens.chunks(text)
        ids = [t.encode((prefix if k else "") + p, add_special_tokens=False).ids for k, p in enumerate(parts)]
        assert sum(ids, []) == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abtheingonsß<É́é日🙂'1!\x00\n", min_size=1, max_size=12), min_size=1, max_size=20))
def test_cached_chunks_equal_single_encodings(words):
    for path, prefix in ((WORD, ""), (BYTE, " "), (BYTE, "")):
        t, held = load(path), tokens.chunk_cache(path, prefix).learn(set(words))
        for w in words:
            assert np.frombuffer(held[w], "<u4").tolist() == t.encode(prefix + w, add_special_tokens=False).ids, (path, prefix, w)


def test_packing_round_trip(spark, docs):
    t = load(BYTE)
    packed = packing.pack_documents(docs, BYTE, with_ids=True)
    rows = packed.collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d in docs.dropDuplicates(["doc_id"]).collect():
        own = sorted(pieces[d.doc_id], key=lambda r: r.start)[:: 2 if d.doc_id == 9 else 1]
        assert sum((r.ids for r in own), []) == t.encode(d.text or "", add_special_tokens=False).ids + [1]
        assert {r.doc_tokens for r in own} == {sum(r.length for r in own)}
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.sequences(packed).count() == len(seqs)
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_columns_cover_the_histogram_near_the_bound():
    rng = np.random.default_rng(1)
    counts = {int(c): int(n) for c, n in zip(range(1, 257), rng.integers(0, 4000, 256), strict=True) if n}
    plan = packing.solve_patterns(counts, 256)
    covered = defaultdict(int)
    for copies, items in plan:
        assert sum(c * n for c, n in items.items()) <= 256
        for c, n in items.items():
            covered[c] += copies * n
    assert all(covered[c] >= n for c, n in counts.items())
    assert sum(x for x, _ in plan) <= 1.01 * sum(c * n for c, n in counts.items()) / 256 + 2
