"""BPE encoding and decoding, with tree concatenation for long texts.

Texts up to ``long_chars`` code points are encoded where they are read. A longer text is halved
until no piece is longer, the pieces are encoded in parallel as rows of their own, and the tree
is folded: around each join a window of tokens from both sides is encoded again and grows until
its outermost tokens are those that both sides already have, at the same places. Adjacent pairs
of tokens decide a BPE encoding, so from there on both sides stand. A window that outgrows what a
piece knows of its tokens' places becomes the whole of both sides.

Defined results: null and empty texts have no tokens and decode to the empty string. Equal
texts have equal results; repeated rows stay repeated. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import id_and_text, partitions

LONG_CHARS, EDGE = 32_768, 512
DIGEST, IDS = "n_tokens long, ids_sha256 string, decoded_sha256 string", "ids array<int>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Spans:
    """Token ids with the code points each covers, counted from the whole text's start (-1: not looked at)."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.ids, self.starts, self.ends = ids, starts, ends

    def __getitem__(self, part: slice) -> Spans:
        return Spans(self.ids[part], self.starts[part], self.ends[part])

    def __add__(self, other: Spans) -> Spans:
        return Spans(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("ids", "starts", "ends")))

    def __len__(self) -> int:
        return len(self.ids)

    def same(self, i: int, other: Spans, j: int) -> bool:
        return (self.ids[i], self.starts[i], self.ends[i]) == (other.ids[j], other.starts[j], other.ends[j])


def encode_spans(tokenizer, text: str, base: int = 0) -> Spans:
    e = tokenizer.encode(text, add_special_tokens=False)
    places = np.array(e.offsets, np.int32).reshape(-1, 2) + np.int32(base)
    return Spans(np.array(e.ids, np.int32), places[:, 0], places[:, 1])


def encode_piece(path: str, text: str, base: int = 0, edge: int = EDGE) -> Spans:
    """The encoding of a piece; only tokens near its ends, that joins look at, have places.

    The middle is cut where no token crosses, so it's the same as that of the piece as a whole.
    """
    tokenizer, ahead = tokens.chunk_cache(path).tokenizer, tokens.ahead(path)
    a = tokens.BREAK.search(text, edge) if ahead is not None else None
    b = tokens.BREAK.search(text, max(edge, len(text) - edge)) if a else None
    if not a or not b or b.start() <= a.start():
        return encode_spans(tokenizer, text, base)
    skip = 1 - len(ahead)  # a later chunk takes the space before it, or nothing does
    head = encode_spans(tokenizer, text[: a.start()], base)
    middle = np.frombuffer(tokens.text_ids(path, [text[a.start() + skip : b.start()]])[0], np.int32)
    unseen = np.full(len(middle), -1, np.int32)
    return head + Spans(middle, unseen, unseen) + encode_spans(tokenizer, text[b.start() + skip :], base + b.start() + skip)


def join_spans(tokenizer, text: str, left: Spans, right: Spans, start: int, end: int, agree: int = 2) -> Spans:
    """The encoding of text[start:end] from those of its two parts."""
    width = 8
    while True:
        i, j = max(0, len(left) - width), min(len(right), width)
        a, b = int(left.starts[i] if i else start), int(right.ends[j - 1] if j < len(right) else end)
        if a < 0 or b < 0:  # the window has grown beyond the places known
            return encode_spans(tokenizer, text[start:end], start)
        window = encode_spans(tokenizer, text[a:b], a)
        n = len(window)
        left_agrees = not i or n >= agree and all(window.same(k, left, i + k) for k in range(agree))
        right_agrees = j == len(right) or n >= agree and all(window.same(n - k, right, j - k) for k in range(1, agree + 1))
        if left_agrees and right_agrees:
            return left[:i] + window + right[j:]
        width *= 2


def fold(tokenizer, text: str, parts: list[tuple[int, int, Spans]]) -> Spans:
    """Neighbouring parts (start, end, spans) joined level by level."""
    while len(parts) > 1:
        level = []
        for k in range(0, len(parts) - 1, 2):
            (a, _, left), (_, b, right) = parts[k : k + 2]
            level.append((a, b, join_spans(tokenizer, text, left, right, a, b)))
        parts = level + parts[len(level) * 2 :]
    return parts[0][2]


def digest(path: str, ids: list[int]) -> tuple[int, str, str]:
    digits = tokens.id_names(path)[0]
    return len(ids), sha(" ".join([digits[i] for i in ids])), sha(tokens.decoded(path, ids))


def encode_short(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield encoded_rows(path, digests, batch.column(0), [np.frombuffer(x, "<i4") for x in tokens.text_ids(path, batch.column(1).to_pylist())])

    return run


def encoded_rows(path: str, digests: bool, names: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    if not digests:
        return pa.RecordBatch.from_arrays([names, pa.array(ids, pa.list_(pa.int32()))], ["name", "ids"])
    columns = zip(*(digest(path, x.tolist()) for x in ids), strict=True)
    return pa.RecordBatch.from_arrays([names, *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], ["name", "n_tokens", "ids_sha256", "decoded_sha256"])


def cut_texts(long_chars: int):
    """Halves of texts until no part is longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                parts = 1 << max(1, math.ceil(math.log2(len(text) / long_chars)))
                step = math.ceil(len(text) / parts)
                starts = range(0, len(text), step)
                arrays = [pa.repeat(batch.column(0)[at], len(starts)), pa.array(starts, pa.int32()), pa.array([text[k : k + step] for k in starts])]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "start", "piece"])

    return run


def encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                batch = whole.slice(at, 16)
                starts, texts = batch.column("start").to_pylist(), batch.column("piece").to_pylist()
                spans = [encode_piece(path, t, s) for t, s in zip(texts, starts, strict=True)]
                lists = [pa.array([np.ascontiguousarray(getattr(x, k), "<i4").tobytes() for x in spans], pa.binary()) for k in ("ids", "starts", "ends")]
                ends = pa.array([s + len(t) for t, s in zip(texts, starts, strict=True)], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), ends, *lists], ["key", "start", "end", "ids", "starts", "ends"])

    return run


def fold_group(path: str, digests: bool):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        text = left.column("text")[0].as_py()
        rows = sorted(right.to_pylist(), key=lambda r: r["start"])
        parts = [(r["start"], r["end"], Spans(*(np.frombuffer(r[k], "<i4") for k in ("ids", "starts", "ends")))) for r in rows]
        ids = fold(tokens.chunk_cache(path).tokenizer, text, parts).ids
        out = encoded_rows(path, digests, pa.array([key[0].as_py()]), [ids])
        return pa.Table.from_batches([out]).rename_columns(["key", *out.schema.names[1:]])

    return run


def encode_long(texts: DataFrame, path: str, long_chars: int, digests: bool) -> DataFrame:
    """key and what is asked for of distinct long texts (key, text), by tree concatenation."""
    pieces = texts.mapInArrow(cut_texts(long_chars), "key string, start int, piece string")
    spread = pieces.repartition(partitions(texts.sparkSession), "key", "start")  # each piece is a row of its own
    done = spread.mapInArrow(encode_pieces(path), "key string, start int, end int, ids binary, starts binary, ends binary")
    return texts.groupBy("key").cogroup(done.groupBy("key")).applyInArrow(fold_group(path, digests), f"key string, {DIGEST if digests else IDS}")


def encoded(docs: DataFrame, path: str, long_chars: int, id_col: str, text_col: str, digests: bool) -> DataFrame:
    short, long, texts = split_long(id_and_text(docs, id_col, text_col), long_chars)
    kind = DIGEST if digests else IDS
    whole = short.mapInArrow(encode_short(path, digests), f"name long, {kind}").withColumnRenamed("name", "doc_id")
    return whole.unionByName(long.join(encode_long(texts, path, long_chars, digests), "key").drop("key"))


def split_long(rows: DataFrame, long_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Short rows, long rows (doc_id, key) and the distinct long texts (key, text)."""
    is_long = F.char_length("text") > long_chars
    keyed = rows.where(is_long).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    return rows.where(~is_long), keyed.select("doc_id", "key"), keyed.groupBy("key").agg(F.first("text").alias("text"))


def encode_documents(docs: DataFrame, path: str, long_chars: int = LONG_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids of every whole text."""
    return encoded(docs, path, long_chars, id_col, text_col, False)


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that the ids stand for, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = [tokens.decoded(path, x or []) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def token_digests(docs: DataFrame, path: str, long_chars: int = LONG_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""
    return encoded(docs, path, long_chars, id_col, text_col, True)
