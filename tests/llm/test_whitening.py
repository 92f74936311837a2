import math

import numpy as np
import pytest

from lotwise.llm.tables import table
from lotwise.llm.whitening import Fit, deviations, jacobi_davidson, minres, op13_whitening, remaining, whiten

SMALL = "/root/testdata/sf0.001"


def solve(a, count, **kw):
    calls = []

    def product(columns):
        calls.append(columns.shape[1])
        return a @ columns
    return *jacobi_davidson(product, len(a), count, **kw), calls


@pytest.mark.parametrize("dimension, count", [(1, 4), (3, 4), (7, 2), (40, 4), (160, 6)])
def test_solver_equals_a_dense_one(dimension, count):
    rng = np.random.default_rng(dimension)
    m = rng.standard_normal((dimension + 5, dimension)) * np.linspace(1, 3, dimension)
    a = m.T @ m / len(m)
    values, vectors, _ = solve(a, count, space=30)
    want = np.linalg.eigvalsh(a)[::-1][:count]
    assert np.allclose(values, want, rtol=1e-13, atol=0)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13 * values[0]
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)


def test_solver_with_equal_zero_and_clustered_values():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for spectrum in (np.ones(60), np.zeros(60), np.r_[5, 5, 5, 5, 5, np.ones(55)], np.r_[1, 1 - 1e-9, np.full(58, .5)],
                     np.r_[9, 1, np.zeros(58)]):
        values, vectors, _ = solve((q * spectrum) @ q.T, 4)
        assert np.allclose(values, np.sort(spectrum)[::-1][:4], atol=1e-13 * max(1, spectrum[0]))
        assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(5)
    mats = [np.diag(rng.uniform(1, 3, 20) * rng.choice([-1, 1], 20)) for _ in range(3)]
    rhs = rng.standard_normal((20, 3))
    x = minres(lambda v: np.stack([m @ c for m, c in zip(mats, v.T)], axis=1), rhs, 60, 1e-13)
    assert np.allclose(np.stack([m @ c for m, c in zip(mats, x.T)], axis=1), rhs, atol=1e-9)
    assert (minres(lambda v: v, np.zeros((5, 2))) == 0).all()


def brute(rows, count=4):
    """The contract's result by dense arithmetic, up to each component's sign."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    xs = [tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (dim - len(v)) for _, v in kept]
    fit = np.array(sorted(set(xs)), dtype=np.int64).reshape(-1, dim)
    n, s = len(fit), fit.sum(axis=0).tolist()
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(n, 1)) if dim and n else (np.zeros(0), np.zeros((0, 0)))
    trace = values.sum()
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    real = values > 1e-12 * max(values.max(initial=0), 1e-300)
    out = []
    for (i, _), x in zip(kept, xs):
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        w = (np.array(x) - fit.mean(axis=0)) @ vectors[:, real] / np.sqrt(values[real])
        out += [(i, c + 1, n, dev, w[c], values[real][c] / trace) for c in range(real.sum())]
    return out


def check(rows, got):
    key = lambda r: (str(r[0]), r[1], r[3], abs(r[4]))
    want, got = sorted(brute(rows), key=key), sorted(map(tuple, got), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for component in {r[1] for r in want}:
        a = np.array([r[4] for r in got if r[1] == component])
        b = np.array([r[4] for r in want if r[1] == component])
        assert np.allclose(a, b, atol=1e-6) or np.allclose(a, -b, atol=1e-6)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-8)
    assert all(r[6] <= 1e-9 for r in got) and len({r[6] for r in got}) <= 1


def test_query_equals_dense_arithmetic(spark):
    docs = table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()
    check([tuple(r) for r in docs], op13_whitening(spark, SMALL).collect())


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(3)]) for i in range(30)]
    rows += [(1, None), (2, [1.0, None, 2.0]), (3, [nan, 0.0, 0.0]), (4, [0.0, inf, 1.0]), (5, [1.0, -inf, 1.0]),
             (None, [0.5, -0.5, 0.25]), (107, [0.5]), (107, [0.5]), (108, []), *[(109, [1.0, 1.0, 1.0])] * 40]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows],
                                  "vec_id long, embedding array<float>, id int, x string")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    check(rows, op13_whitening(spark, str(tmp_path)).collect())
    for few in ("false", "vec_id = 109", "vec_id = 1 and embedding is null", "size(embedding) = 0"):
        assert whiten(frame.where(few)).collect() == []
    got = whiten(frame.where("vec_id in (109, 107)"), components=2)    # two distinct vectors: one component
    assert {r.component for r in got.collect()} == {1}


def test_huge_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e18, -1e18])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2} and all(r.deviation is None and r.n == 3 for r in got)
    assert all(np.isfinite([r.whitened, r.explained]).all() for r in got) and got[0].identity_error < 1e-4


def test_deviations_are_exact_and_null_beyond_a_long():
    x = np.array([[3, -4], [10 ** 9, 0]], np.int64)
    assert deviations(x, 2, [1, 1]) == [(6 - 1) ** 2 + (-8 - 1) ** 2, (2 * 10 ** 9 - 1) ** 2 + 1]
    assert deviations(x, 10 ** 4, [0, 0]) == [9 * 10 ** 8 + 16 * 10 ** 8, None]


def test_partial_matrices_of_many_blocks_are_added_in_tasks(spark, monkeypatch):
    docs = table(spark, SMALL, "embeddings")
    fit = Fit(remaining(docs, "vec_id", "embedding"), 64)
    columns = np.eye(64)[:, :2]
    plain = fit.product(columns)
    fit.parts = 1 << 20
    assert np.allclose(fit.product(columns), plain, rtol=1e-12)
