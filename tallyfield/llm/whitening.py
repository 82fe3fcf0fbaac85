"""Embedding whitening by cyclic Jacobi rotations of a covariance gathered on all executors.

Each entry c of a vector becomes the integer floor(64 * c) + 1000000, so sums are exact. One pass
adds up the integers of each dimension, a second one the products of what is left after the means
are taken off (the centred scatter), both per task and then by Spark's aggregation: the driver
gets one number for each dimension or pair of them. It turns the covariance by symmetric Jacobi
rotations, in rounds of disjoint pairs that go through all pairs in a sweep, until every
off-diagonal entry vanishes against its own two diagonal ones. That criterion is relative, so small
eigenvalues are as accurate as large ones. The whitening matrix (at most ``MAX_DIMS`` times
``COMPONENTS`` numbers, 512 KB) is broadcast; a third pass measures the covariance of the whitened
vectors, and the last one whitens.

Defined results: rows whose vector is null, empty or holds a null, infinite or NaN entry are
dropped. Vectors of one length make a space: of several lengths the most common one counts (of
equally common ones the longest), rows of other lengths are dropped. Repeated rows and rows that
share an id count each. A component without variance (fewer different rows than dimensions) has
``whitened`` 0 and ``explained`` 0; then the covariance of what is whitened isn't the identity, and
``identity_error`` says so. ``deviation`` is null where it isn't a long. An entry of 2**50 or more
in size raises ``ValueError``, as do vectors of more than ``MAX_DIMS`` entries. No rows in, no rows
out. Columns other than the id and the vector don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named

SCALE, SHIFT, COMPONENTS, MAX_DIMS = 64.0, 1_000_000, 32, 2048
#: Rows that a task holds at a time, and the most products that must add up to a long.
ROWS, MOST = 1024, 2**62
SUMS = "dims int, at int, n long, total long"
PRODUCTS = "i int, j int, total double"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of finite entries only, as doubles; the test stays within Spark's own expressions."""
    v = named(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select(named(id_col).cast("long").alias("vec_id"), v.alias("v")).where(v.isNotNull() & (F.size(v) > 0) & fine)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their integers, a row for each vector; all of a slice have one length."""
    lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(lengths)) + 1
    for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        for at in range(start, end, ROWS):
            part = batch.slice(at, min(ROWS, end - at))
            c = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
            if np.abs(c).max() >= 2.0**50:
                raise ValueError("an entry of 2**50 or more has no integer")
            yield part, np.floor(SCALE * c).astype(np.int64) + SHIFT


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for part, x in matrices(batch) if batch.num_rows else ():
            own = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
            own[0] += part.num_rows
            own[1] += x.sum(0)
    for dims, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, dims, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(total)], ["dims", "at", "n", "total"])


def gathered(rows: DataFrame, centred) -> np.ndarray:
    """The scatter of ``centred`` (a function of the integers), added up by pairs of dimensions, as a symmetric matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in matrices(batch) if batch.num_rows else ():
                y = centred(x)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = (k.astype(np.int32) for k in np.triu_indices(len(total)))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "total"])

    found = rows.select("v").mapInArrow(run, PRODUCTS).groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    i, j = (found.column(c).to_numpy() for c in "ij")
    out = np.zeros((int(i.max()) + 1,) * 2)
    out[i, j] = out[j, i] = found.column("total").to_numpy()
    return out


def rounds(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a sweep, each once, as rounds of disjoint ones (one stays, the others go around)."""
    seats = np.arange(size + size % 2)
    for _ in range(len(seats) - 1):
        p, q = np.minimum(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]), np.maximum(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1])
        yield p[q < size], q[q < size]
        seats[1:] = np.roll(seats[1:], 1)


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns."""
    a, vectors = matrix.astype(np.float64), np.eye(len(matrix))
    for _ in range(sweeps):
        turned = False
        for p, q in rounds(len(a)):
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            do = np.abs(off) > 1e-16 * np.sqrt(np.abs(dp) * np.abs(dq))
            if not do.any():
                continue
            turned, p, q, off, dp, dq = True, p[do], q[do], off[do], dp[do], dq[do]
            with np.errstate(over="ignore"):
                theta = (dq - dp) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))  # the smaller of both angles
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, vectors):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = dp - t * off, dq + t * off
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


class Whitening:
    """What was fitted: counts, sums, the eigenvalues and the whitening matrix (dimensions x components)."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, components: int):
        values, vectors = jacobi(covariance)
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors
        kept = min(components, len(values))
        some = values[:kept] > 1e-13 * max(float(values[0]), 0.0)
        self.matrix = np.where(some, vectors[:, :kept] / np.sqrt(np.where(some, values[:kept], 1.0)), 0.0)
        self.explained = np.where(some, values[:kept] / (np.trace(covariance) or 1.0), 0.0)
        self.identity_error = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, the whole numbers of the means taken off first."""
        whole = self.sums // self.n
        return (x - whole) - (self.sums - whole * self.n) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of the squares of n * x - sums, exact."""
        far = np.abs(x - self.sums // self.n).astype(np.float64).max(1) + 1
        if (far * self.n).max() ** 2 * x.shape[1] < MOST:
            apart = self.n * x - self.sums
            return np.einsum("ij,ij->i", apart, apart).tolist()
        exact = ((self.n * x.astype(object) - self.sums.astype(object)) ** 2).sum(1)
        return [int(e) if e < 2**63 else None for e in exact]


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """Statistics of all usable rows; None where there is none."""
    rows = usable(vectors, id_col, vector_col)
    sums = rows.select("v").mapInArrow(summed, SUMS).groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    sums = sums.groupBy("dims", "n").agg(F.sort_array(F.collect_list(F.struct("at", "total")))["total"].alias("sums"))
    best = sums.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not best:
        return None
    if best[0].dims > MAX_DIMS:
        raise ValueError(f"vectors of {best[0].dims} entries; {MAX_DIMS} at most")
    n, total = best[0].n, np.array(best[0].sums)
    whole = total // n
    rest = (total - whole * n) / n
    rows = rows.where(F.size("v") == len(total))
    model = Whitening(n, total, gathered(rows, lambda x: (x - whole) - rest) / n, components)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    white = gathered(rows, lambda x: shared.value.centred(x) @ shared.value.matrix) / n
    model.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors, id_col, vector_col)
    if model is None:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), WHITENED)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kept = m.matrix.shape[1]
        for batch in batches:
            for part, x in matrices(batch) if batch.num_rows else ():
                many = len(x) * kept
                deviation = pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), kept)))
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), kept)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(many, m.n)), deviation]
                    + [pa.array((m.centred(x) @ m.matrix).ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(many, m.identity_error))],
                    [c.split()[0] for c in WHITENED.split(", ")],
                )

    return rows.where(F.size("v") == len(model.sums)).mapInArrow(run, WHITENED)


def whitened(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    return whiten(vectors, fit(vectors, components))
