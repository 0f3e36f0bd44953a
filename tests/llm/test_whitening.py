"""Operator 13 against numpy's eigenvectors."""

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, id string, x string, v int, component string, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "a", "b", 1, "c", "d") for i, v in rows], SCHEMA)


def plain(rows, wanted=8):
    """{(id, vector): (deviation, whitened)} of the covariance's eigenvectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in good], dtype=np.float64)) + 100_000
    n, a = len(x), x - x.mean(axis=0)
    e, y = np.linalg.eigh(a.T @ a / n)
    e, y = e[::-1][:wanted], y[:, ::-1][:, :wanted]
    whole = x.astype(np.int64)
    dev = ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    return good, dev, a @ y / np.sqrt(e), e / np.trace(a.T @ a / n)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)) @ np.diag([9, 7, 5, 4, 3, 2.5, 2, 1.5, 1, 1, 1, 0.5]) @ rng.standard_normal((12, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(5, rows[5][1])] * 40 + [(None, rows[7][1]), (900, None), (901, []), (902, [1.0] * 11), (903, [1.0] * 11 + [None]),
                                      (904, [1.0] * 11 + [float("nan")]), (905, [float("-inf")] + [1.0] * 11)]
    return rows


def test_against_eigenvectors(spark, rows):
    good, dev, z, explained = plain([r for r in rows if not r[1] or len(r[1]) == 12])
    got = whitening.whiten(table(spark, rows).repartition(5)).collect()
    assert len(got) == 8 * len(good) and {r.n for r in got} == {len(good)}
    sign = {}
    for (i, v), d, w in zip(good, dev.tolist(), z):
        mine = {r.component: r for r in got if r.vec_id == i}
        assert sorted(mine) == list(range(1, 9)) and {r.deviation for r in mine.values()} == {d}
        assert {int(r.deviation_exact) for r in mine.values()} == {d}
        for c, r in mine.items():
            s = sign.setdefault(c, np.sign(r.whitened * w[c - 1]))
            assert r.whitened * s == pytest.approx(w[c - 1], abs=1e-9)
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-10) and r.identity_error < 1e-10
    assert sum(r.vec_id == 5 for r in got) == 8 * 41 and sum(r.vec_id is None for r in got) == 8


def test_components_of_one_deviation_and_low_rank(spark):
    """Several equal eigenvalues, which one sequence of directions can't tell
    apart, and fewer than eight components in all."""
    rows = [(i, [float(s * 3 * (j == k)) for j in range(6)]) for i, (k, s) in enumerate([(k, s) for k in range(5) for s in (1, -1)])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and len(got) == 50
    assert all(r.explained == pytest.approx(0.2) and r.identity_error < 1e-10 for r in got)
    z = np.array(sorted((r.vec_id, r.component, r.whitened) for r in got))[:, 2].reshape(10, 5)
    assert np.allclose(z.T @ z / 10, np.eye(5), atol=1e-9)


def test_many_equal_eigenvalues_before_all_steps():
    """A wide matrix: the restart finds the copies of a deviation."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    a = q * np.r_[50, 50, 50, 40, 40, 30, 20, 10, np.full(192, 1.0)] @ np.linalg.qr(rng.standard_normal((200, 200)))[0]
    steps = [0]

    def product(w, W):
        steps[0] += 1
        u = a @ w
        return (a @ W).T @ u, u @ u, a.T @ u

    s, y = whitening.lanczos(product, 200, 8, 1)
    assert s == pytest.approx([50, 50, 50, 40, 40, 30, 20, 10]) and steps[0] < 200
    assert np.allclose(a.T @ (a @ y), y * s**2, atol=1e-8)


def test_large_numbers_are_exact():
    x = np.array([[10**9, 5], [0, 7]], dtype=np.int64)
    n, s = 10**10, [5 * 10**18, 6 * 10**10]
    assert whitening.deviations(x, n, s).tolist() == [[10**19 - 5 * 10**18, -(10**10)], [-5 * 10**18, 10**10]]


def test_empty_and_equal_vectors(spark, tmp_path):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        out = whitening.whiten(table(spark, rows))
        assert out.columns == columns and out.collect() == []


def test_query(spark, rows, tmp_path):
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = whitening.whiten(table(spark, rows)).count()
    assert whitening.op13_whitening(spark, str(tmp_path)).count() == want
