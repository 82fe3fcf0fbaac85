"""Periodic runs of words by Crochemore's partition refinement.

The positions of a text are kept in classes of equal factors (stretches of words) of one length,
first of ``FIRST`` words, then of one word more at each step. A class is refined by the classes
of the following positions; all parts of a class but its largest serve to refine others in the
next step (the smaller halves), so a position moves a logarithmic number of times. Each class is
a linked list by position. Where two neighbours of a list are just as far apart as their factors
are long, a square starts; squares of one period at consecutive positions are one run. A run of
period q is at least q words longer than its period, or ``LEAST`` words long, so any run shows
in the classes of ``FIRST`` words or later, also those of shorter periods, and a text without two
equal factors of that length has none. A class whose first and last member are too near for a
square is dropped, as is every later part of it.

Words are compared as such, not by hashes. All work is within a text, which Spark deals out; a
text takes memory in proportion to its words and is never cut.

Defined results: a null or empty text has no words, no run, four nulls and the digests of empty
strings. Repeated rows stay repeated. A null id stays null (and calls for no rewriting in the
query). No rows in, no rows out. Columns other than the id and the text don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

LEAST, FIRST = 12, 6
#: Texts whose results a task holds at a time.
ROWS = 256
RUNS = "doc_id long, start long, length long, period long, words string"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def factors(ids: np.ndarray) -> np.ndarray:
    """Numbers of the factors of FIRST words from each position: thirds of it packed, ranked and packed again."""
    many = len(ids) + 1
    pairs = ids[:-1] * many + ids[1:]
    if many < 1 << 21:
        threes = ranked(pairs[:-1] * many + ids[2:])
    else:
        threes = ranked(ranked(pairs)[:-1] * many + ids[2:])
    return threes[:-3] * many + threes[3:]


class Classes:
    """Equal-factor classes of a text's positions as linked lists; ``step`` makes the factors one word longer."""

    def __init__(self, keys: np.ndarray, limit: int):
        """``limit``: the longest period that matters."""
        self.length, self.limit, n = FIRST, limit, len(keys)
        self.cls, self.next, self.last = [-1] * n, [-1] * n, [-1] * n
        self.head: list[int] = []
        self.tail: list[int] = []
        self.size: list[int] = []
        self.far: dict[int, list[int]] = {}  # distance: positions whose next one is, or was, so far
        self.alive = 0
        order = np.argsort(keys, kind="stable")
        edges = np.flatnonzero(np.diff(keys[order])) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
            if end - start > 1:
                self.link(order[start:end].tolist(), FIRST)
        self.small: list[list[int]] | None = None  # before the first step every class refines

    def link(self, members: list[int], length: int) -> None:
        """A new class of a list of positions, unless it is too narrow for a square of ``length`` or more."""
        number, cls, nxt, last, far, limit = len(self.size), self.cls, self.next, self.last, self.far, self.limit
        if members[-1] - members[0] < (length if length > FIRST else 1):
            for i in members:
                cls[i] = -1
            return
        self.alive += 1
        before = -1
        for i in members:
            cls[i], last[i] = number, before
            if before >= 0:
                nxt[before] = i
                if i - before <= limit:
                    far.setdefault(i - before, []).append(before)
            before = i
        nxt[before] = -1
        self.head.append(members[0])
        self.tail.append(before)
        self.size.append(len(members))

    def squares(self) -> Iterator[tuple[int, list[int]]]:
        """(distance, positions): neighbours as far apart as factors are long; in the first classes as far or nearer."""
        for d in range(1, FIRST + 1) if self.length == FIRST else [self.length]:
            if found := sorted({i for i in self.far.pop(d, ()) if self.cls[i] >= 0 and self.next[i] == i + d}):
                yield d, found

    def unlink(self, members: list[int], number: int) -> None:
        nxt, last, far, least, limit = self.next, self.last, self.far, self.length + 1, self.limit
        for i in members:
            p, q = last[i], nxt[i]
            if p >= 0:
                nxt[p] = q
            else:
                self.head[number] = q
            if q >= 0:
                last[q] = p
                if p >= 0 and least <= q - p <= limit:
                    far.setdefault(q - p, []).append(p)
            else:
                self.tail[number] = p
        self.size[number] -= len(members)

    def members(self, number: int) -> list[int]:
        out, i = [], self.head[number]
        while i >= 0:
            out.append(i)
            i = self.next[i]
        return out

    def step(self) -> None:
        cls, ended = self.cls, len(self.cls) - 1 - (self.length - FIRST)
        parts: dict[int, dict[int, list[int]]] = {}  # class: parts by the class that follows
        if self.small is None:
            for number in range(len(self.size)):
                own = parts[number] = {}
                for i in self.members(number):
                    follows = -1 if i >= ended else cls[i + 1] if cls[i + 1] >= 0 else -2 - i
                    own.setdefault(follows, []).append(i)
        else:
            for key, small in enumerate(self.small):
                for i in small:
                    if i and (number := cls[i - 1]) >= 0 and i - 1 != ended:
                        parts.setdefault(number, {}).setdefault(key, []).append(i - 1)
            if ended >= 0 and cls[ended] >= 0:  # no word follows: a part of its own
                parts.setdefault(cls[ended], {})[-1] = [ended]
        self.small = []
        for number, own in parts.items():
            groups = list(own.values())
            rest = self.size[number] - sum(map(len, groups))
            largest = max(groups, key=len)
            if not rest and len(groups) == 1:
                continue
            if not rest or len(largest) > rest:  # the largest part keeps the class
                left = [g for g in groups if g is not largest]
                if rest:
                    moved = {i for g in groups for i in g}
                    left.append([i for i in self.members(number) if i not in moved])
            else:
                left = groups
            for g in left:
                self.unlink(g, number)
            for g in left:
                self.link(g, self.length + 1)
                self.small.append(g)
            if self.tail[number] - self.head[number] <= self.length:
                self.alive -= 1
                for i in self.members(number):
                    cls[i] = -1
        self.length += 1


def find_runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs, by start and period."""
    n = len(ids)
    if n < LEAST:
        return []
    keys = factors(ids)
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    classes, found = Classes(keys, n // 2), []
    while True:
        for d, starts in classes.squares():
            at = np.array(starts)
            breaks = np.flatnonzero(np.diff(at) > 1)
            for first, end in zip(at[np.r_[0, breaks + 1]].tolist(), at[np.r_[breaks, len(at) - 1]].tolist(), strict=True):
                length = end - first + d + classes.length
                if length >= max(LEAST, 2 * d):
                    found.append((first, length, d))
        if not classes.alive or classes.length >= n // 2:
            return sorted(found, key=lambda r: (r[0], r[2]))
        classes.step()


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def find_in_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each run: doc_id, start, length, period and the words of its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = text.as_py().encode().split()
                if runs := find_runs(numbered(words)):
                    start, length, period = zip(*runs, strict=True)
                    said = [b" ".join(words[s : s + p]).decode() for s, p in zip(start, period, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(runs), pa.int64()), *(pa.array(c, pa.int64()) for c in (start, length, period)), pa.array(said)], ["doc_id", "start", "length", "period", "words"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, RUNS)


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's texts: every tenth, by CRC-32 of its id, repeats itself from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def digest(doc_id: int | None, text: str) -> tuple:
    words = rewritten(text.encode().split(), doc_id)
    runs = find_runs(numbered(words)) if len(words) >= LEAST else []
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
    kept = b" ".join(collapsed(words, runs))
    return doc_id, len(runs), start, length, period, runs and 1000 * length // period or None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()


def run_digests(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: its runs, the longest of them and what is left without repeats."""
    names, kinds = zip(*(c.split() for c in DIGEST.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = [digest(i, t.as_py()) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(columns, kinds, strict=True)], list(names))

    return id_and_text(docs).mapInArrow(run, DIGEST)
