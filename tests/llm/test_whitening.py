import math
import random

import numpy as np
import pytest

from seriesloom.llm.q_whitening import op11_embedding_whitening
from seriesloom.llm.qdwh import leading_eigenvectors, polar_factor, split
from seriesloom.llm.whitening import whiten

KIND = "vec_id bigint, embedding array<double>, label int, x string, n string, component string"


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = q * np.array(values, float) @ q.T
    return (a + a.T) / 2


def test_polar_factor():
    a = symmetric([5, 3, 1e-9, -1e-12, -2, -7])
    u = polar_factor(a)
    assert np.allclose(u @ u, np.eye(6), atol=1e-12)
    assert np.linalg.eigvalsh(u @ a).min() > -1e-13


def test_split_parts_the_spectrum():
    a = symmetric([9, 8, 7, 1, 0.5, 0.1])
    upper, lower = split(a, 4.0)
    assert upper.shape[1] == 3 and lower.shape[1] == 3
    assert np.allclose(sorted(np.linalg.eigvalsh(upper.T @ a @ upper)), [7, 8, 9])
    assert split(a, 100.0) is None


@pytest.mark.parametrize("values", [
    range(1, 65), [1e6, 1, 1, 1, 1e-3], [3.0] * 7, [2, 2, 1, 1, 0, 0], [1e-8, 1e-9, 0, 0], [0.0] * 3, [5.0], np.geomspace(1, 1e-12, 30), [4, 3, 2, 1, 0, 0, 0, 0, -1],
    np.random.default_rng(1).random(150),
])
def test_leading_eigenvectors(values):
    a = symmetric(list(values), 3)
    expected = np.sort(np.array(list(values), float))[::-1][:4]
    found, vectors = leading_eigenvectors(a, 4)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.allclose(found, expected, rtol=0, atol=1e-13 * len(a) * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-13 * len(a))
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * len(a) * scale


def brute(rows, count=4):
    """Directly in memory, with numpy's own eigenvectors."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in kept]
    size = max(set(lengths), key=lambda s: (lengths.count(s), s))
    kept = [(i, x) for i, x in kept if len(x) == size]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums, float) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return n, [
        (i, k + 1, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k]), values[k] / np.trace(v))
        for i, x in kept for k in range(min(count, size))
    ]


def check(found, rows):
    n, expected = brute(rows)
    assert {r["n"] for r in found} == {n} and max(r["identity_error"] for r in found) < 1e-10
    key = lambda r: (str(r[0]), r[1], r[2])
    found = sorted(((r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"]) for r in found), key=key)
    expected.sort(key=key)
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert np.allclose([f[4] for f in found], [e[4] for e in expected])
    for k in range(1, 5):  # either sign, but one for all rows of a component
        a, b = (np.array([r[3] for r in side if r[1] == k]) for side in (found, expected))
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)


def test_against_numpy(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + k % 4 + 0.1 * k) for k in range(12)], 1, "x", "n", "c") for i in range(400)]
    rows += [(i, rows[7][1], 1, "x", "n", "c") for i in range(1000, 1300)]  # one vector holds many rows
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 12), (504, [float("inf")] * 12), (505, [1.0, 2.0]), (None, [0.5] * 12), (0, [0.25] * 12)]
    rows = [(*r, 1, "x", "n", "c")[:6] if len(r) == 2 else r for r in rows]
    rng.shuffle(rows)
    check(whiten(spark.createDataFrame(rows, KIND).repartition(5)).collect(), rows)


def test_query(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check(op11_embedding_whitening(spark, small).collect(), rows)


def test_exact_at_any_size(spark):
    rows = [(0, [3e15, 1.0]), (1, [-3e15, 0.0]), (2, [1.0, 2.0])]
    found = {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), count=1).collect()}
    assert found == {0: 2**63 - 1, 1: 2**63 - 1, 2: (3 * 256 - 256) ** 2 + (3 * 512 - 768) ** 2}


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in whiten(same).collect()) == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id bigint, embedding array<float>")
    found = sorted((r["vec_id"], r["component"], r["whitened"] and abs(round(r["whitened"], 9)), r["explained"]) for r in whiten(line).collect())
    assert [f[:3] for f in found] == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)] and found[1][3] == 0
    assert whiten(same.limit(0)).count() == 0 and len(whiten(same.limit(0)).columns) == 7
