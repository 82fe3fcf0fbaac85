"""Exact repeated windows over all documents, by super-k-mers.

A window is ``k`` symbols (words or bytes) of one text. Its minimiser is the smallest hash of the
``m``-symbol grams inside it, the leftmost on ties, so equal windows have equal minimisers at
equal places. Consecutive windows whose minimiser is the same occurrence travel as one packed
string to the minimiser's bucket, compressed together with all that a task sends there. All
equal windows meet in one bucket; a minimiser that comes once is unique there and is dropped
before any window is looked at, and equal packed strings collapse to the earliest, both where
they are read and in the bucket. What is left goes to ``repeats``, which finds every window that
also starts earlier. Hashes only route; bytes decide.

A minimiser that ``hot_strings`` packed strings or more would share (estimated on every
``SAMPLE``-th document by hash of its id, which only balances load) is spread: its windows
travel one by one to buckets of their own content. At most (all strings / hot_strings) are so.
"""

from __future__ import annotations

import struct
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, partitions

SAMPLE, HOT_STRINGS, PIECE = 97, 100_000, 1 << 18
#: Bytes of text for each bucket, and of a slice whose strings a task holds before it sends them.
BUCKET_BYTES, SLICE_BYTES = 4 << 20, 32 << 20
MUL = np.uint64(0x9E3779B97F4A7C15)
Repeats = Callable[[bytes, np.ndarray, np.ndarray], np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes in an order that has nothing to do with the text's."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def grams(symbols: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m symbols from each position; shorter at the end by m - 1."""
    total, have, out, at = symbols, 1, None, 0
    power = MUL
    while True:
        if m & have:
            if out is None:
                out, at = total, have
            else:
                n = len(symbols) - at - have + 1
                out, at = out[:n] * power + total[at : at + n], at + have
        if 2 * have > m:
            return out[: max(0, len(symbols) - m + 1)]
        n = len(total) - have
        total, have, power = total[:n] * power + total[have : have + n], 2 * have, np.uint64(int(power) ** 2 % (1 << 64))


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


class Symbols:
    """How a text is cut: ``normal`` is the text that packed strings are slices of."""

    k: int
    m: int

    def normal(self, text: bytes) -> bytes:
        raise NotImplementedError

    def cut(self, normal: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end byte of every symbol."""
        raise NotImplementedError


class Bytes(Symbols):
    def __init__(self, k: int = 100, m: int = 16):
        self.k, self.m = k, m

    def normal(self, text: bytes) -> bytes:
        return text

    def cut(self, normal: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(len(normal) + 1)
        return np.frombuffer(normal, np.uint8).astype(np.uint64) + np.uint64(1), at[:-1], at[1:]


class Words(Symbols):
    def __init__(self, k: int = 20, m: int = 5):
        self.k, self.m = k, m

    def normal(self, text: bytes) -> bytes:
        return b" ".join(text.split())

    def cut(self, normal: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not normal:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none
        data = np.frombuffer(normal, np.uint8)
        blank = np.flatnonzero(data == 32)
        first, end = np.concatenate([[0], blank + 1]), np.concatenate([blank, [len(data)]])
        place = np.arange(len(data)) - np.repeat(first, np.diff(first, append=len(data)))
        powers = np.cumprod(np.full(int(place.max()) + 1, MUL, np.uint64))
        value = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
        value[blank] = 0
        return mixed(np.add.reduceat(value, first)), first, end


def packed(symbols: Symbols, normal: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a text: minimiser, first window, windows, first byte, end byte."""
    k, m = symbols.k, symbols.m
    hashes, first, end = symbols.cut(normal)
    n = len(hashes) - k + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    gram = mixed(grams(hashes, m))
    least = window_minimum(gram, k - m + 1)
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (gram[: n - 1] == least[:-1])
    start = np.flatnonzero(new)
    many = np.diff(start, append=n)
    return least[start], start, many, first[start], end[start + many + k - 2]


def pieces(symbols: Symbols, normal: bytes) -> Iterator[tuple[int, bytes]]:
    """A long text in parts that share k - 1 symbols, with the number of the first symbol."""
    if len(normal) <= 2 * PIECE:
        yield 0, normal
        return
    _, first, end = symbols.cut(normal)
    at, step = 0, max(symbols.k, len(first) * PIECE // len(normal))
    while at == 0 or at + symbols.k <= len(first):
        last = min(len(first), at + step + symbols.k - 1)
        yield at, normal[first[at] : end[last - 1]]
        at += step


def super_kmers(symbols: Symbols, docs: list[tuple[int, bytes]], hot: frozenset[int]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(minimiser, document, first window, windows, packed string)."""
    for doc, text in docs:
        for base, part in pieces(symbols, symbols.normal(text)):
            least, start, many, a, b = packed(symbols, part)
            if hot and not hot.isdisjoint(own := least.tolist()):
                _, first, end = symbols.cut(part)
                for v, s, n, x, y in zip(own, start.tolist(), many.tolist(), a.tolist(), b.tolist(), strict=True):
                    if v not in hot:
                        yield v, doc, base + s, n, part[x:y]
                        continue
                    for i in range(s, s + n):
                        window = part[first[i] : end[i + symbols.k - 1]]
                        yield xxhash.xxh64_intdigest(window), doc, base + i, 1, window
            else:
                yield from ((v, doc, base + s, n, part[x:y]) for v, s, n, x, y in zip(least.tolist(), start.tolist(), many.tolist(), a.tolist(), b.tolist(), strict=True))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """Documents with an id, so many at a time as SLICE_BYTES hold, one at least."""
    for batch in batches:
        docs, size = [], 0
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if d is not None:
                docs.append((d, t.as_py()))
                size += len(docs[-1][1])
                if size >= SLICE_BYTES:
                    yield docs
                    docs, size = [], 0
        if docs:
            yield docs


def send(symbols: Symbols, buckets: int, hot: frozenset[int]):
    """Rows (bucket, packed): compressed super-k-mers; a repeat of a string already sent has no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for docs in slices(batches):
            docs.sort(key=lambda x: x[0])
            held: dict[int, list] = {}
            for v, doc, start, n, text in super_kmers(symbols, docs, hot):
                bucket = held.get(v % buckets)
                if bucket is None:
                    bucket = held[v % buckets] = ({}, [array(kind) for kind in "Iqiii"], [])
                seen, columns, texts = bucket
                number = seen.setdefault(text, len(texts))
                if number == len(texts):
                    texts.append(text)
                for column, value in zip(columns, (v >> 32, doc, start, n, number), strict=True):
                    column.append(value)
            for some in batched(list(held.items()), 64):
                blobs = [squeeze.compress(blob(columns, texts)) for _, (_, columns, texts) in some]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "packed"])

    return run


def batched(items: list, n: int) -> Iterator[list]:
    for i in range(0, len(items), n):
        yield items[i : i + n]


def blob(columns: list[array], texts: list[bytes]) -> bytes:
    v, doc, *rest = columns
    body = [v, np.diff(np.array(doc), prepend=0).astype(np.int64), *rest, np.array([len(t) for t in texts], np.int32)]
    return struct.pack("<II", len(v), len(texts)) + b"".join(x.tobytes() for x in body) + b"".join(texts)


def unblob(data: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    n, many = struct.unpack("<II", data[:8])
    at, columns = 8, []
    for kind, size in ((np.uint32, n), (np.int64, n), (np.int32, n), (np.int32, n), (np.int32, n), (np.int32, many)):
        columns.append(np.frombuffer(data, kind, size, at))
        at += columns[-1].nbytes
    columns[1] = np.cumsum(columns[1])
    ends = at + np.cumsum(columns[5], dtype=np.int64)
    return columns[:5], [data[a:b] for a, b in zip((ends - columns[5]).tolist(), ends.tolist(), strict=True)]


def meet(symbols: Symbols, repeats: Repeats):
    """Bucket to rows (doc_id, start, end): runs of symbols that repeated windows cover."""

    def run(key, table):
        parts, texts, base = [], [], 0
        unsqueeze = zstandard.ZstdDecompressor()
        for data in table.column("packed"):
            columns, own = unblob(unsqueeze.decompress(data.as_py()))
            parts.append([*columns[:4], columns[4] + base])
            texts += own
            base += len(own)
        v, doc, start, many, number = (np.concatenate(c) for c in zip(*parts, strict=True))
        _, which, count = np.unique(v, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(count[which] > 1)
        keep = keep[np.lexsort((start[keep], doc[keep]))]
        runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: dict[bytes, tuple[int, int]] = {}
        first, again = [], []
        for i, d, s, t in zip(keep.tolist(), doc[keep].tolist(), start[keep].tolist(), number[keep].tolist(), strict=True):
            earliest = seen.get(texts[t])
            if earliest is None:
                seen[texts[t]] = (d, s)
                first.append(i)
            elif earliest != (d, s):  # else the row of a document that repeats
                again.append(i)
        again = np.array(again, np.int64)
        runs.append((doc[again], start[again], start[again] + many[again] + symbols.k - 1))
        first = np.array(first, np.int64)
        if len(first):
            _, which, count = np.unique(v[first], return_inverse=True, return_counts=True)
            first = first[count[which] > 1]
        if len(first):
            n = many[first]
            later = repeats([texts[t] for t in number[first].tolist()], n)
            own = np.repeat(np.arange(len(first)), n)
            window = start[first][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            same_row = np.flatnonzero(later)
            d, s = doc[first][own][same_row], window[same_row]
            if len(s):
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(s)) - 1
                runs.append((d[begin], s[begin], s[last] + symbols.k))
        d, a, b = (np.concatenate(c) for c in zip(*runs, strict=True))
        return pa.table({"doc_id": pa.array(d, pa.int64()), "start": pa.array(a, pa.int32()), "end": pa.array(b, pa.int32())})

    return run


def hot_minimisers(rows: DataFrame, symbols: Symbols, hot_strings: int) -> frozenset[int]:
    """Minimisers of too many strings for one bucket, as far as every SAMPLE-th document tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[int] = Counter()
            for text in batch.column(1).to_pylist():
                for _, part in pieces(symbols, symbols.normal(text)):
                    counts.update(packed(symbols, part)[0].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(counts), np.uint64).view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["v", "n"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(2, hot_strings // SAMPLE)).select("v").collect()
    return frozenset(r.v % (1 << 64) for r in found)


def covered(docs: DataFrame, symbols: Symbols, repeats: Repeats, hot_strings: int = HOT_STRINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, end): symbols covered by windows that also start earlier; runs may overlap."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    buckets = max(4 * partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    sent = rows.mapInArrow(send(symbols, buckets, hot_minimisers(rows, symbols, hot_strings)), "bucket int, packed binary")
    return sent.groupBy("bucket").applyInArrow(meet(symbols, repeats), "doc_id long, start int, end int")


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(t) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])


def with_runs(docs: DataFrame, runs: DataFrame, finish: Callable[[int, bytes, np.ndarray, np.ndarray], tuple], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``finish`` of every document: (doc_id, text, run starts, run ends) to a row of ``schema``.

    A document's runs are at most as many as its symbols, so grouping them by document is bounded.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    own = runs.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    texts = rows.mapInArrow(squeezed, "doc_id long, packed binary")
    kinds = [x.split()[1] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for d, p, a, b in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "packed", "starts", "ends")), strict=True):
                found.append(finish(d, unsqueeze.decompress(p), np.array(a or [], np.int64), np.array(b or [], np.int64)))
            arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    joined = texts.join(own, texts.doc_id == own.of, "left").select("doc_id", "packed", "starts", "ends")
    return joined.mapInArrow(run, schema)


def removed(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n symbols the runs cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(starts, n), 1)
    np.add.at(change, np.minimum(ends, n), -1)
    return np.cumsum(change[:-1]) > 0
