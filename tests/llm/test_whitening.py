import math
import random

import numpy as np
import pytest

from quillflow.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, whitened string, _x int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def exact(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]


def test_scatter_is_exact():
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 61), 1 << 61, (300, 5))
    primes = whitening.primes_over(2 * 300 * (1 << 122))
    assert len(set(primes)) == len(primes) and all(p < 1 << 20 for p in primes)
    residues = np.stack([whitening.residue_scatter(x, p) for p in primes])
    wide = x.astype(object)
    assert (whitening.reconstructed(residues, primes) == wide.T @ wide).all()


def test_blocks_of_many_rows():
    x = np.full((20_001, 2), (1 << 20) - 2)
    p = whitening.primes_over(1)[0]
    assert (whitening.residue_scatter(x, p) == 20_001 * ((1 << 20) - 2) ** 2 % p).all()


def test_whitening_equals_a_plain_computation(spark):
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1 + d) * 0.3 for d in range(12)] for _ in range(300)]
    vectors += [vectors[0]] * 200
    odd = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [3e38] * 12, [1.0, 2.0]]
    rows = whitening.components_of(frame(spark, vectors + odd), "vec_id").collect()
    x = np.array(exact(vectors), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    assert {r.vec_id for r in rows} == set(range(n)) and len(rows) == 8 * n and {r.n for r in rows} == {n}
    apart = n * x - sums
    deviations = (apart**2).sum(axis=1)
    cov = (apart.T @ apart / n**3).astype(float)
    values, vecs = np.linalg.eigh(cov)
    w = (apart / n).astype(float) @ vecs[:, ::-1] / np.sqrt(values[::-1])
    for r in rows:
        assert int(r.deviation) == deviations[r.vec_id]
        assert abs(r.whitened) == pytest.approx(abs(w[r.vec_id, r.component - 1]), rel=1e-6, abs=1e-8)
        assert r.explained == pytest.approx(values[::-1][r.component - 1] / values.sum(), rel=1e-9)
    assert max(r.identity_error for r in rows) < 1e-9
    first = np.array([[r.whitened for r in sorted(rows, key=lambda r: (r.component, r.vec_id)) if r.component == k] for k in (1, 2)])
    assert abs(np.cov(first, bias=True) - np.eye(2)).max() < 1e-9


def test_large_numbers_stay_exact(spark):
    vectors = [[1e13 * (i % 7), float(i), -3e12 * (i % 5)] for i in range(40)]
    rows = whitening.components_of(frame(spark, vectors), "vec_id").collect()
    x = np.array(exact(vectors), dtype=object)
    apart = len(x) * x - x.sum(axis=0)
    assert {r.vec_id: int(r.deviation) for r in rows if r.component == 1} == dict(enumerate((apart**2).sum(axis=1)))
    rows = whitening.components_of(frame(spark, [[1e15 * (i % 7), 1.0] for i in range(4000)]), "vec_id").collect()
    assert {r.deviation for r in rows if r.vec_id == 0} == {None}


def test_nothing_to_whiten(spark):
    for vectors in ([], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 9):
        found = whitening.components_of(frame(spark, vectors), "vec_id")
        assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_only_real_components(spark):
    vectors = [[float(i), 2.0 * i, 5.0] for i in range(50)]
    rows = whitening.components_of(frame(spark, vectors), "vec_id").collect()
    assert {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1) and rows[0].identity_error < 1e-9


def test_most_common_length_stays(spark):
    vectors = [[1.0 * i, 2.0] for i in range(5)] + [[1.0, float(i), 3.0] for i in range(5)] + [[4.0]]
    assert {r.vec_id for r in whitening.components_of(frame(spark, vectors), "vec_id").collect()} == {5, 6, 7, 8, 9}
