"""Whitening against exact integers and an eigen solver in double precision."""

import math

import numpy as np
import pytest

from tabsmith.llm import op13_whitening as op

SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA)


def found(spark, rows, **kw):
    return op.whiten(frame(spark, rows), **kw).collect()


def integers(v):
    return [math.floor(1024 * c) + 100_000 for c in v]


def check(rows, out, components=8):
    kept = [(i, integers(v)) for i, v in rows]
    n, d = len(kept), len(kept[0][1])
    k = min(components, d)
    sums = [sum(x[j] for _, x in kept) for j in range(d)]
    want = sorted((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept)
    assert sorted((r.vec_id, r.deviation) for r in out if r.component == 1) == want
    assert len(out) == n * k and {r.n for r in out} == {n} and {r.component for r in out} == set(range(1, k + 1))
    y = np.array([[float(a * n - s) / n for a, s in zip(x, sums)] for _, x in kept])
    value, vec = np.linalg.eigh(y.T @ y / n)
    value, vec = value[::-1], vec[:, ::-1]
    by_id = {i: row for (i, _), row in zip(kept, y)}
    for c in range(k):
        got = np.array([r.whitened for r in out if r.component == c + 1])
        ref = np.array([by_id[r.vec_id] @ vec[:, c] / math.sqrt(value[c]) for r in out if r.component == c + 1])
        assert min(np.abs(got - ref).max(), np.abs(got + ref).max()) < 1e-7
        assert all(abs(r.explained / (value[c] / value.sum()) - 1) < 1e-9 for r in out if r.component == c + 1)
    z = np.array([[r.whitened for r in out if r.component == c + 1] for c in range(k)])
    z = z - z.mean(1, keepdims=True)
    measured = np.abs(z @ z.T / n - np.eye(k)).max()
    errors = {r.identity_error for r in out}
    assert len(errors) == 1 and errors.pop() < 1e-9 and measured < 1e-9


def test_random_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 12)) * np.linspace(1, 3, 12))]
    check(rows, found(spark, rows))


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    check(rows, op.whiten(table).collect())


def test_dropped_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(4)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)) * [1, 2, 3])]
    good += good[:5]
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 0.0]), (903, [float("inf"), 1.0, 1.0]), (904, []), (905, [1.0]), (906, [1e300, 0.0, 0.0])]
    out = found(spark, good + bad)
    check(good, out)
    assert {r.component for r in out} == {1, 2, 3}


def test_no_rows_and_no_variance(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []
    out = found(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in out} == {(None, None, None, 0)} and len(out) == 4
    flat = found(spark, [(i, [float(i), 1.0]) for i in range(10)])
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-12


def test_deviation_beyond_a_long_is_null(spark):
    out = found(spark, [(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 1.0])])
    assert {r.vec_id: r.deviation is None for r in out} == {1: True, 2: True, 3: False}
    big = [(i, [float(i) * 1e4, 0.0]) for i in (-60, 0, 60)]     # sums of squares near 2^63
    got = {r.vec_id: r.deviation for r in found(spark, big)}
    x = [integers(v) for _, v in big]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: (d if (d := sum((3 * a - b) ** 2 for a, b in zip(v, s))) < 1 << 63 else None) for (i, _), v in zip(big, x)}


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 1], [1, 1 + 1e-9, 1 + 2e-9, 2, 2 + 1e-10], [1, 1, 1, 1, 1e-8], [1e-12, 1, 1 + 1e-13, 7, 7]])
def test_refined_eigenvectors_of_clustered_values(values):
    rng = np.random.default_rng(8)
    d = 5 * len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    q = q @ (1.5 * np.eye(d) - 0.5 * (q.T @ q))                   # orthogonal to extended precision
    q = q @ (1.5 * np.eye(d) - 0.5 * (q.T @ q))
    lam = np.array(values * 5, np.longdouble)
    a = (q * lam) @ q.T
    a = (a + a.T) / 2
    value, x = op.eigen(a)
    assert (np.diff(value.astype(float)) <= 1e-18).all()
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17
    assert np.abs(a @ x - x * value).max() < 1e-16 * np.abs(lam).max()
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    assert np.abs(a @ start - start * value[::-1]).max() > 1e-9    # the float32 vectors alone are far from it
