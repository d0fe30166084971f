"""Whitening against numpy's eigenvectors and plain integers."""

import math

import numpy as np
import pytest

from textweir.llm import queries as q
from textweir.llm import whitening


@pytest.mark.parametrize("seed", range(6))
def test_spectral_is_the_eigendecomposition(seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 5, 17, 64, 40][seed]
    spread = [1.0, 1e3, 1e6, 10.0, 50.0, 1e12][seed]
    basis, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = np.exp(rng.uniform(0, np.log(spread), n))
    a = (basis * values) @ basis.T
    a = (a + a.T) / 2
    got, v = whitening.spectral(a)
    scale = np.abs(a).max()
    assert np.abs(got - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 1e-13 * scale * n
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13
    assert np.abs(a @ v - v * got).max() < 1e-13 * scale * n


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.eye(4) * 7, np.diag([1.0, 1, 5, 5, 5]), np.diag([0.0, 0, 2]),
                               np.diag([1.0, 3, 2]), np.ones((6, 6)), np.diag([-1.0, 1]), np.array([[0.0, 1], [1, 0]])])
def test_spectral_of_repeated_and_zero_eigenvalues(a):
    got, v = whitening.spectral(a)
    assert np.allclose(got, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-13)
    assert np.allclose(v.T @ v, np.eye(len(a)), atol=1e-13) and np.allclose(a @ v, v * got, atol=1e-12)


def expected(vectors, k=8):
    """Rows that stay, their exact deviations, and what numpy's eigenvectors give."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * e - s) ** 2 for e, s in zip(row, sums))) for row in x]
    d = np.array([[(n * e - s) / n for e, s in zip(row, sums)] for row in x])
    values, v = np.linalg.eigh(d.T @ d / n)
    return n, deviation, values[::-1][:k], d @ v[:, ::-1][:, :k], values.sum()


def test_query_against_numpy(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, values, projected, trace = expected([r.embedding for r in rows])
    got = q.op13_embedding_whitening(spark, sf_dir).toPandas()
    assert len(got) == 8 * n and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] < 1e-9
    for c in range(8):
        mine = got[got.component == c + 1].sort_values("vec_id")
        assert mine.vec_id.tolist() == [r.vec_id for r in rows] and mine.deviation.tolist() == deviation
        assert np.allclose(mine.explained, values[c] / trace, rtol=1e-10)
        want = projected[:, c] / np.sqrt(values[c])
        sign = np.sign(want @ mine.whitened.to_numpy())
        assert np.abs(sign * want - mine.whitened.to_numpy()).max() < 1e-8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.5, -3.0]), (1, [1.0, 2.5, -3.0]), (None, [0.0, 9.0, 4.0]), (7, [2.0, -1.0, 8.0]), (8, [5.0, 5.5, 1.0])]
    bad = [(2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, []), (9, [1.0]), (10, [1e300, 0.0, 0.0])]
    schema = "vec_id bigint, embedding array<double>, x int, n int, whitened string"
    table = spark.createDataFrame([(i, v, 1, 2, "w") for i, v in good + bad], schema)
    got = whitening.whiten(table).collect()
    n, deviation, values, projected, trace = expected([v for _, v in good])
    assert sorted((r.vec_id or 0, r.deviation) for r in got) == sorted((i or 0, d) for (i, _), d in zip(good, deviation))
    assert all(r.n == 5 and len(r.whitened) == 3 and r.identity_error < 1e-9 for r in got)
    assert np.allclose(got[0].explained, values / trace)
    assert whitening.whiten(table.limit(0)).collect() == []
    assert whitening.whiten(spark.createDataFrame(bad[:4], "vec_id bigint, embedding array<double>")).collect() == []


def test_components_without_variance_have_no_whitened_value(spark):
    rows = [(i, [float(i), 1.0, 2.0 * i]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in got)
    alike = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id bigint, embedding array<float>")).collect()
    assert [tuple(r) for r in alike] == [(1, 3, 0, [None, None], [None, None], None)] * 3


def test_a_deviation_that_is_no_long_is_null(spark):
    rows = [(i, [2.0**39 * (i % 2)]) for i in range(4)] + [(9, [2.0**38])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    _, deviation, *_ = expected([v for _, v in rows])
    assert [got[i] for i, _ in rows] == [d if d < 2**63 else None for d in deviation]
    assert None in got.values()
