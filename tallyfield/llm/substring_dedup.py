"""Substring deduplication over words: super-k-mers meet in buckets, where sorting counts windows.

Every word covered by a ``k``-word window whose word sequence also starts earlier (smaller
document id, or the same document and an earlier start) is removed; windows are judged on the
input. See ``superkmers`` for how windows travel and how skew is met.

Defined results: null and empty texts have no words. Rows that repeat a document (same id, same
text) are the same document and don't remove each other's words. A document with a null id is
passed through: it neither removes nor loses words. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import superkmers

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def counted(k: int):
    """Sorts the windows of packed strings; true for each that equals one before it."""

    def repeats(texts: list[bytes], many: np.ndarray) -> np.ndarray:
        joined = b" ".join(texts)
        hashes, first, end = superkmers.Words(k).cut(joined)
        words = many + k - 1
        own = np.repeat(np.arange(len(many)), many)
        at = (np.cumsum(words) - words)[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        value = superkmers.grams(hashes, k)[at]
        order = np.argsort(value, kind="stable")
        later = np.zeros(len(at), bool)
        same = value[order[1:]] == value[order[:-1]]
        if not same.any():
            return later
        a, b = first[at].tolist(), end[at + k - 1].tolist()
        seen: dict[bytes, int] = {}
        last = -1
        for i, j in zip(order[:-1][same].tolist(), order[1:][same].tolist(), strict=True):
            if i != last:  # a new group of equal hashes; within it bytes decide
                seen = {joined[a[i] : b[i]]: i}
            later[j] = seen.setdefault(joined[a[j] : b[j]], j) != j
            last = j
        return later

    return repeats


def covered_words(docs: DataFrame, k: int = 20, hot_strings: int = superkmers.HOT_STRINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words (doc_id, start, end) that repeated windows cover; runs may overlap."""
    return superkmers.covered(docs, superkmers.Words(k, max(1, k // 4)), counted(k), hot_strings, id_col, text_col)


def kept_words(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept ones joined by spaces."""
    words = text.split()
    if not len(starts):
        return len(words), 0, b" ".join(words)
    gone = superkmers.removed(len(words), starts, ends)
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def remove_repeated_words(docs: DataFrame, k: int = 20, hot_strings: int = superkmers.HOT_STRINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept text."""

    def finish(doc, text, starts, ends):
        n, gone, kept = kept_words(text, starts, ends)
        return doc, n, gone, kept.decode()

    runs = covered_words(docs, k, hot_strings, id_col, text_col)
    return superkmers.with_runs(docs, runs, finish, "doc_id long, n_words long, n_removed long, text string", id_col, text_col)


def word_digests(docs: DataFrame, k: int = 20, hot_strings: int = superkmers.HOT_STRINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def finish(doc, text, starts, ends):
        n, gone, kept = kept_words(text, starts, ends)
        return doc, n, gone, hashlib.sha256(kept).hexdigest()

    return superkmers.with_runs(docs, covered_words(docs, k, hot_strings, id_col, text_col), finish, SCHEMA, id_col, text_col)
