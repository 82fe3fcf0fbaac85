"""Whitening against numpy's own eigenvectors, exact integers, odd vectors and odd shapes."""

import math

import numpy as np
import pytest

from tallyfield.llm import whitening
from tallyfield.llm.catalog import op11_whitening


def integers(vectors):
    return np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors])


def test_whitens_all_rows_as_numpy_does(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = op11_whitening(spark, sf).toPandas()
    x = integers([r.embedding for r in rows])
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * 32 and set(got.component) == set(range(1, 33)) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    exact = {r.vec_id: sum((n * int(a) - int(s)) ** 2 for a, s in zip(o, sums, strict=True)) for r, o in zip(rows, x, strict=True)}
    assert {(a, b) for a, b in zip(got.vec_id, got.deviation, strict=True)} == set(exact.items())
    by_id = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in rows]].to_numpy()
    want = y @ u[:, :32] / np.sqrt(e[:32])
    assert np.abs(np.abs(by_id) - np.abs(want)).max() < 1e-7
    assert np.abs(by_id.T @ by_id / n - np.eye(32)).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), e[:32] / np.trace(v), rtol=1e-9)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.normal(0, 3, 5)], 1.0) for i in range(40)]
    odd = [(100, None, 1.0), (101, [], 1.0), (102, [1.0, None, 1.0, 1.0, 1.0], 1.0), (103, [1.0, float("nan"), 1.0, 1.0, 1.0], 1.0), (104, [1.0, float("-inf"), 1.0, 1.0, 1.0], 1.0), (105, [1.0, 2.0], 1.0)]
    rows = [*good, *odd, good[0], good[0], (None, [0.0] * 5, 2.0)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<float>, n double").repartition(5)
    got = whitening.whitened(spark, table).collect()
    assert len(got) == 43 * 5 and {r.n for r in got} == {43} and sum(r.vec_id == 0 for r in got) == 15 and sum(r.vec_id is None for r in got) == 5
    white = np.array([r.whitened for r in got]).reshape(-1, 5)
    assert np.abs(white.T @ white / 43 - np.eye(5)).max() < 1e-9 and got[0].identity_error < 1e-9
    assert whitening.whitened(spark, table.limit(0)).collect() == []
    assert whitening.whitened(spark, spark.createDataFrame(odd[:2], table.schema)).columns == table.sparkSession.createDataFrame([], whitening.WHITENED).columns


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0, 3.0])], [(i, [1.0, 2.0, 3.0]) for i in range(4)], [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)]])
def test_components_without_variance(spark, rows):
    got = whitening.whitened(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 3 * len(rows) and all(math.isfinite(r.whitened) for r in got) and got[0].identity_error == pytest.approx(1)
    varied = len(rows) == 6
    assert {r.component for r in got if r.explained > 0} == ({1} if varied else set())


def test_integers_beyond_small_products(spark):
    rows = [(i, [float((i * 37) % 11) * 1e5, -2.0 * i]) for i in range(3000)]
    got = whitening.whitened(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = integers([v for _, v in rows]).astype(object)
    sums = x.sum(0)
    want = {i: int(((len(x) * o - sums) ** 2).sum()) for (i, _), o in zip(rows, x, strict=True)}
    assert {r.vec_id: r.deviation for r in got} == {k: w if w < 2**63 else None for k, w in want.items()}


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_jacobi_finds_small_eigenvalues(size):
    rng = np.random.default_rng(size)
    scale = 10.0 ** np.linspace(6, -6, size)
    g = rng.normal(size=(size, 3 * size + 1))
    a = scale[:, None] * (g @ g.T) * scale
    values, vectors = whitening.jacobi(a)
    assert (np.diff(values) <= 0).all() and (values > 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-12
    # of the scaled matrix numpy is exact enough to compare the product of all of them
    sign, logdet = np.linalg.slogdet(g @ g.T)
    assert sign > 0 and np.log(values).sum() == pytest.approx(logdet + 2 * np.log(scale).sum(), rel=1e-9)
