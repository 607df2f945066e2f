"""Against numpy's eigenvectors and whole numbers of any size."""

import math
from fractions import Fraction

import numpy as np
import pytest

from clausecut.llm import queries as Q
from clausecut.llm import whitening as W


def exact(rows):
    """By vec_id and component: n, deviation, whitened (up to its sign), explained."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(v) for _, v in good} - {0}:
        fit = {tuple(v) for _, v in good if len(v) == d}
        n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        low = [Fraction(x, n) for x in s]
        cov = [[float(sum((v[i] - low[i]) * (v[j] - low[j]) for v in fit) / n) for j in range(d)] for i in range(d)]
        values, vectors = np.linalg.eigh(np.asarray(cov))
        for i, v in good:
            if len(v) == d:
                y = np.asarray([float(a - m) for a, m in zip(v, low, strict=True)])
                for k in range(min(4, d)):
                    e = values[d - 1 - k]
                    out.append((i, k + 1, n, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)), abs(float(y @ vectors[:, d - 1 - k])) / math.sqrt(e) if e > 0 else None, float(e / values.sum())))
    return sorted(out, key=str)


def same(got, rows, tolerance=1e-6):
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got), key=str)
    want = exact(rows)
    got.sort(key=lambda r: str(r[:4]))
    want.sort(key=lambda r: str(r[:4]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[4]) == pytest.approx(w[4], abs=tolerance) and g[5] == pytest.approx(w[5], rel=1e-4) and g[6] < 1e-9


@pytest.mark.parametrize("d", [1, 2, 5, 30])
def test_rotations(d):
    """Matrices whose eigenvalues spread over sixteen orders; the small ones are accurate, as the matrix is graded."""
    rng = np.random.default_rng(d)
    b = rng.normal(size=(d, d)) + 3 * np.eye(d)
    scale = 10.0 ** np.linspace(4, -4, d)
    a = scale[:, None] * (b @ b.T) * scale
    values, v = W.jacobi(a)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and list(values) == sorted(values, reverse=True)
    assert np.allclose(v @ np.diag(values) @ v.T, a, rtol=0, atol=1e-13 * np.abs(a).max())
    inverse = W.jacobi(np.linalg.inv(b @ b.T) / scale[:, None] / scale)[0][::-1]  # its large eigenvalues are the small ones
    assert np.allclose(values * inverse, 1, rtol=1e-9)


def test_whitened(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(7, 7)) * np.array([9, 5, 2, 1, 0.5, 0.2, 0.1])
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=7) @ mix + 40)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # copies count once in the fit
    rows += [(None, rows[5][1]), (7, rows[6][1]), (2000, None), (2001, [1.0] * 6 + [None]), (2002, [1.0] * 6 + [float("nan")]), (2003, [float("inf")] * 7), (2004, [])]
    rows += [(3000 + i, [float(x) for x in rng.normal(size=3)]) for i in range(20)]  # another space
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'a' AS x", "1 AS n", "'b' AS component").repartition(5)
    same(W.whitened(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_large_entries(spark):
    """Sums beyond a long; a deviation that does not fit is null."""
    rows = [(i, [1e15 * (i % 7 - 3), float(i)]) for i in range(50)]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {(i, k): (dev, w) for i, k, _, dev, w, _ in exact(rows)}
    assert len(got) == 100
    for r in got:
        dev, w = want[r.vec_id, r.component]
        assert r.deviation == (dev if dev < 1 << 63 else None) and r.n == 50
        if r.component == 1:
            assert abs(r.whitened) == pytest.approx(w, rel=1e-9)


def test_deviation_near_the_limit():
    f = W.Fit(3, [0, 0], [0, 0], np.zeros(2), np.ones(2), np.eye(2), 2.0)
    for root in (2**31, 1012333498, 1012333499, 3_037_000_499 // 3, 3_037_000_500 // 3 + 1, 715827882):
        whole = 2 * (3 * root) ** 2
        assert W.deviations(np.asarray([[root, -root]]), f) == [whole if whole < 1 << 63 else None]


def test_nothing_varies(spark):
    got = W.whitened(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], "vec_id int, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in got) == [(i, k, 1, 0, None, None, 0.0) for i in (1, 2) for k in (1, 2)]
    line = W.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id int, embedding array<float>")).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in line} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)} and max(r.identity_error for r in line) < 1e-9
    empty = W.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(200).collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(W.whitened(df).collect(), rows)
    whole = Q.op12_embedding_whitening(spark, sf)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert whole.count() == 4 * table.count() and whole.selectExpr("max(identity_error)").first()[0] < 1e-9
