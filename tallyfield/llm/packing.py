"""Sequence packing as a cutting-stock problem, solved by column generation.

A document's tokens (and an end token) are cut into full sequences and one remainder. Piece
lengths are counted in classes of ``unit`` tokens over all documents: a histogram of at most
``width / unit`` bins, whatever the input, which is all that the driver sees. A linear program
over cutting patterns covers the histogram; knapsack dynamic programming prices new patterns
until none can improve the bound by more than ``gap``. Patterns are rounded down and the small
residue is packed by first fit. Pieces are ranked within their class by a range-partitioned
sort, and the rank alone tells a piece its sequence, so nothing whole passes one task.

Defined results: a null or empty text is the end token alone. Rows that repeat a document are
packed as often as they occur. No rows in, no rows out. A class that holds most pieces is
spread over many ranges, as the ranges also split by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import checkpointed, id_and_text, partitions

WIDTH, UNIT, END = 2048, 8, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(path: str, width: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], "<u4").tobytes()
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), tokens.text_ids(path, batch.column(1).to_pylist()), strict=True):
                    ids += last
                    for at in range(0, len(ids), 4 * width):
                        piece = ids[at : at + 4 * width]
                        rows.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, *([np.frombuffer(piece, "<i4")] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(list(c), pa.list_(pa.int32())) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
        tokens.forget()

    return run


def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the largest value that fits."""
    f, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = int(np.searchsorted(sizes, c, "right"))
        f[c] = f[c - 1]
        if fits:
            gains = f[c - sizes[:fits]] + value[:fits]
            k = int(gains.argmax())
            if gains[k] > f[c] + 1e-12:
                f[c], took[c] = gains[k], k
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(f[room]), pattern


def solve_patterns(counts: dict[int, int], room: int, gap: float = 1e-3) -> list[tuple[int, dict[int, int]]]:
    """(copies, {class: items}) whose slots cover ``counts`` (class: pieces)."""
    sizes = np.array(sorted(counts))
    if not len(sizes):
        return []
    need = np.array([counts[int(s)] for s in sizes], float)
    m = len(sizes)
    columns = np.diag(np.floor(room / sizes))
    cost, inverse = np.ones(m), np.diag(1 / np.diag(columns))
    x = inverse @ need
    while True:
        price = cost @ inverse
        k = int(price.argmin())
        if price[k] < -1e-9:
            column, new_cost = -np.eye(m)[k], 0.0  # a surplus: more slots than pieces
        else:
            worth, column = best_pattern(np.maximum(price, 0), sizes, room)
            if worth <= 1 + gap:
                break
            new_cost = 1.0
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / step[out]
        x = x - step * ratio[out]
        x[out] = ratio[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out], cost[out] = column, new_cost
    plan: list[tuple[int, dict[int, int]]] = []
    left = need.astype(np.int64)
    for k in np.flatnonzero(cost > 0):
        copies = int(np.floor(x[k] + 1e-7))
        if copies > 0:
            plan.append((copies, {int(sizes[i]): int(columns[i, k]) for i in np.flatnonzero(columns[:, k])}))
            left = np.maximum(0, left - copies * columns[:, k].astype(np.int64))
    bins: list[tuple[int, dict[int, int]]] = []
    while left.sum():  # first fit, largest first; equal bins are made together
        items, free = {}, room
        for i in range(m - 1, -1, -1):
            if take := int(min(left[i], free // sizes[i])):
                items[int(sizes[i])], free = take, free - take * int(sizes[i])
        times = min(int(left[i] // items[int(sizes[i])]) for i in range(m) if int(sizes[i]) in items)
        for i in range(m):
            left[i] -= times * items.get(int(sizes[i]), 0)
        bins.append((times, items))
    return plan + bins


def slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each class, rows (first rank, first sequence, items a sequence), by rank."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for copies, items in plan:
        for c, n in items.items():
            found.setdefault(c, []).append((filled.get(c, 0), sequence, n))
            filled[c] = filled.get(c, 0) + copies * n
        sequence += copies
    return {c: np.array(v, np.int64) for c, v in found.items()}


def place(table: dict[int, np.ndarray], before: dict[tuple[int, int], int]):
    """Adds the sequence to sorted pieces; before: (partition, class) to the rank of its first piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            classes, parts = batch.column("class").to_numpy(), batch.column("part").to_numpy()
            sequence, rank = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
            for c in np.unique(classes).tolist():
                at = np.flatnonzero(classes == c)
                rank[at] = before[int(parts[0]), c] + seen.get(c, 0) + np.arange(len(at))
                seen[c] = seen.get(c, 0) + len(at)
                rows = table[c][np.searchsorted(table[c][:, 0], rank[at], "right") - 1]
                sequence[at] = rows[:, 1] + (rank[at] - rows[:, 0]) // rows[:, 2]
            kept = [n for n in batch.schema.names if n != "part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(rank), pa.array(sequence)], [*kept, "rank", "sequence_id"])

    return run


def pack_documents(
    docs: DataFrame, path: str, width: int = WIDTH, unit: int = UNIT, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    schema = PIECE + (", ids array<int>" if with_ids else "")
    pieces = id_and_text(docs, id_col, text_col).mapInArrow(cut_pieces(path, width, end, with_ids), schema)
    pieces = checkpointed(pieces.withColumn("class", F.ceil(F.col("length") / unit).cast("int")))
    counts = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    plan = solve_patterns(counts, width // unit)
    ranked = checkpointed(pieces.repartitionByRange(partitions(spark), "class", "doc_id", "start").sortWithinPartitions("class", "doc_id", "start"))
    ranked = ranked.withColumn("part", F.spark_partition_id())
    before: dict[tuple[int, int], int] = {}
    filled: dict[int, int] = {}
    for r in sorted(ranked.groupBy("part", "class").count().collect(), key=lambda r: (r["part"], r["class"])):
        before[r["part"], r["class"]] = filled.get(r["class"], 0)
        filled[r["class"]] = filled.get(r["class"], 0) + r["count"]
    placed = ranked.mapInArrow(place(slots(plan), before), f"{schema}, class int, rank long, sequence_id long")
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("class", "rank")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces packed ``with_ids``."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
