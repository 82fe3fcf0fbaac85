"""Substring deduplication over bytes: blockwise suffix sorting with a difference cover.

Every byte covered by a ``k``-byte string that also starts earlier (smaller document id, or the
same document and an earlier start) is removed; overlaps count, and strings are judged on the
input. Texts that share strings are brought together as super-k-mers (see ``superkmers``). In a
bucket the suffixes of what is left are sorted one suffix bucket at a time, split by sampled
leading bytes, so that only one bucket's keys are in memory, and the cover's ranks, 0.8 bytes a byte
of text. Spark's own buckets are as many as the input's bytes ask for. Suffixes that agree on the first
``HEAD`` bytes are told apart by ranks of a difference-cover sample, sorted beforehand: for any
two positions some shift below the period puts both into the sample. Suffixes that agree on k
bytes end up as neighbours, and a comparison of their bytes decides.

Defined results: null and empty texts have no bytes. Rows that repeat a document (same id, same
text) are the same document. A document with a null id is passed through: it neither removes nor
loses bytes. Kept bytes need not be whole characters. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import superkmers

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: A difference cover: every difference modulo 31 is one of two members. The period is below HEAD.
PERIOD, COVER, HEAD = 31, (1, 5, 11, 24, 25, 27), 32
BLOCK = 1 << 16


def shifts() -> np.ndarray:
    """shift[a, b] puts positions that are a and b modulo PERIOD into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    table = np.full((PERIOD, PERIOD), -1)
    for d in range(PERIOD - 1, -1, -1):
        a = inside[(np.arange(PERIOD) + d) % PERIOD]
        table[np.ix_(a, a)] = d
    assert (table >= 0).all()
    return table


SHIFT = shifts()
SLOT = np.searchsorted(COVER, np.arange(PERIOD)) % len(COVER)


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each position as one big-endian number, but for the last seven; a view of the bytes that takes no memory."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))


def heads(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[at].astype(np.uint64)


def in_cover(at: np.ndarray) -> np.ndarray:
    """The number that a cover's position has among these."""
    return at // PERIOD * len(COVER) + SLOT[at % PERIOD]


def cover_ranks(words: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Ranks by ``depth`` bytes of the cover's positions below ``size``, by ``in_cover``."""
    periods = -(-size // PERIOD) + 1
    at = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
    at = at[at < size]
    first = heads(words, at)
    order = at[np.argsort(first, kind="stable")]
    first = heads(words, order)
    group = np.cumsum(np.concatenate([[0], first[1:] != first[:-1]]))
    for offset in range(8, depth, 8):
        tied = np.bincount(group)[group] > 1
        if not tied.any():
            break
        some, own = order[tied], group[tied]
        again = np.lexsort((heads(words, some + offset), own))
        order[tied] = some = some[again]
        key = heads(words, some + offset)
        new = np.zeros(len(order), bool)
        new[np.flatnonzero(tied)[1:]] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        new[1:] |= group[1:] != group[:-1]
        new[0] = False
        group = np.cumsum(new)
    ranks = np.full((periods + 1) * len(COVER), -1, np.int32)
    ranks[in_cover(order)] = group
    return ranks


def network_sorted(groups: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Sorts each row of positions (-1: none) by cover ranks, all rows side by side."""
    width = groups.shape[1]
    column = np.arange(width)
    size = 2
    while size <= width:
        step = size // 2
        while step:
            left = column[(column ^ step) > column]
            right = left ^ step
            a, b = groups[:, left], groups[:, right]
            shift = SHIFT[a % PERIOD, b % PERIOD]
            of_a, of_b = ranks[in_cover(a + shift)], ranks[in_cover(b + shift)]
            more = (b >= 0) & ((a < 0) | (of_a > of_b))
            less = (a >= 0) & ((b < 0) | (of_a < of_b))
            swap = np.where((left & size) == 0, more, less)
            groups[:, left], groups[:, right] = np.where(swap, b, a), np.where(swap, a, b)
            step //= 2
        size *= 2
    return groups


def sort_bucket(at: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Positions of one suffix bucket by their leading HEAD bytes, ties by cover ranks."""
    keys = [heads(words, at + 8 * k) for k in range(HEAD // 8)]
    order = np.lexsort(keys[::-1])
    at = at[order]
    equal = np.ones(len(at) - 1, bool)
    for key in keys:
        key = key[order]
        equal &= key[1:] == key[:-1]
    begin = np.flatnonzero(np.concatenate([[True], ~equal]))
    many = np.diff(begin, append=len(at))
    for width in sorted({1 << int(n - 1).bit_length() for n in many[many > 1].tolist()}):
        rows = np.flatnonzero((many > width // 2) & (many <= width))
        place = begin[rows][:, None] + np.arange(width)
        real = np.arange(width) < many[rows][:, None]
        groups = network_sorted(np.where(real, at[np.where(real, place, 0)], -1), ranks)
        at[place[real]] = groups[real]
    return at


def suffix_order(data: bytes, starts: np.ndarray, depth: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The starts by their leading ``depth`` bytes, a suffix bucket at a time, and the eights of the data."""
    words = eights(data + b"\0" * (depth + HEAD + 3 * PERIOD + 16))
    ranks = cover_ranks(words, len(data) + PERIOD, depth)
    picked = np.sort(heads(words, starts[:: max(1, len(starts) // 4096)]))
    splitters = np.unique(picked[:: max(1, len(picked) * block // max(1, len(starts)))])
    bucket = np.concatenate([np.searchsorted(splitters, heads(words, starts[i : i + block]), "right").astype(np.int16) for i in range(0, len(starts), block)])
    by_bucket = np.argsort(bucket, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(bucket))
    out, a = [], 0
    for b in ends.tolist():
        if b > a:
            out.append(sort_bucket(starts[by_bucket[a:b]], words, ranks))
        a = b
    return np.concatenate(out), words


def neighbours(k: int):
    """Sorts the suffixes of packed strings; true for each start whose k bytes come before."""

    def repeats(texts: list[bytes], many: np.ndarray) -> np.ndarray:
        data = b"".join(texts)
        sizes = many + k - 1
        number = np.full(len(data), -1)
        own = np.repeat(np.arange(len(many)), many)
        at = (np.cumsum(sizes) - sizes)[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        number[at] = np.arange(len(at))
        order, words = suffix_order(data, at, k)
        same = np.ones(len(order) - 1, bool)
        for offset in [*range(0, k - 7, 8), *([k - 8] if k >= 8 else [])]:
            live = np.flatnonzero(same)
            same[live] = words[order[live] + offset] == words[order[live + 1] + offset]
        if k < 8:
            mask = np.uint64(8 * (8 - k))
            same = words[order[:-1]] >> mask == words[order[1:]] >> mask
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        index = number[order]
        earliest = np.repeat(np.minimum.reduceat(index, begin), np.diff(begin, append=len(order)))
        later = np.zeros(len(at), bool)
        later[index] = index != earliest
        return later

    return repeats


def covered_bytes(docs: DataFrame, k: int = 100, hot_strings: int = superkmers.HOT_STRINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of bytes (doc_id, start, end) that repeated strings cover; runs may overlap."""
    return superkmers.covered(docs, superkmers.Bytes(k, max(1, min(16, k // 2))), neighbours(k), hot_strings, id_col, text_col)


def kept_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, maximal removed runs, and the kept bytes."""
    if not len(starts):
        return len(text), 0, 0, text
    gone = superkmers.removed(len(text), starts, ends)
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeated_bytes(docs: DataFrame, k: int = 100, hot_strings: int = superkmers.HOT_STRINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes."""
    runs = covered_bytes(docs, k, hot_strings, id_col, text_col)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return superkmers.with_runs(docs, runs, lambda d, t, a, b: (d, *kept_bytes(t, a, b)), schema, id_col, text_col)


def byte_digests(docs: DataFrame, k: int = 100, hot_strings: int = superkmers.HOT_STRINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(doc, text, starts, ends):
        n, gone, spans, kept = kept_bytes(text, starts, ends)
        return doc, n, gone, spans, hashlib.sha256(kept).hexdigest()

    return superkmers.with_runs(docs, covered_bytes(docs, k, hot_strings, id_col, text_col), finish, SCHEMA, id_col, text_col)
