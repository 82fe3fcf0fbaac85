"""AVI files: exact round trips, indexes, shots and digests."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm import media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6000), min_size=1, max_size=5))
def test_round_trip(payloads):
    padded = [media.payload_of(p) for p in payloads]
    files = media.encode_payloads(padded)
    assert [b"".join(f.tobytes() for f in own) for own in media.decode_files(files)] == padded
    assert media.encode_payloads(padded[:1]) == files[:1]


def test_extreme_differences_and_many_frames():
    for data in (bytes([0, 255] * 5000), b"\xff" * 9000, bytes(range(256)) * 300):
        padded = media.payload_of(data)
        assert b"".join(f.tobytes() for f in media.decode_files(media.encode_payloads([padded]))[0]) == padded


def test_files_that_are_not_ours():
    for bad in (b"", b"RIFF\0\0\0\0WAVE", media.encode_payloads([b"\0" * 64])[0][:-24]):
        with pytest.raises(ValueError):
            media.decode_files([bad])


def test_shots_follow_levels():
    frames = [np.full((32, 64), v, np.uint8) for v in (10, 10, 10, 200, 200, 90)]
    assert [(a, n) for a, n, _ in media.shots(frames)] == [(0, 3), (3, 2), (5, 1)]


def test_digests_and_clips(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "héllo", 0), (3, "héllo", 0), (4, "x" * 300_000, 0), (None, "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = media.media_digests(docs).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        payload = media.payload_of((text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 3}) == 1
    stored = media.media_columns(docs)
    assert {r.doc_id: hashlib.sha256(r.media).hexdigest() for r in stored.collect()} == {r.doc_id: r.media_sha256 for r in got}
    cut = media.clips(stored).where("doc_id = 4").collect()
    assert sum(r.frames for r in cut) == -(-len(media.payload_of(b"x" * 300_000)) // 2048)
    assert media.media_digests(docs.limit(0)).count() == 0
