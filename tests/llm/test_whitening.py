"""Whitening against the eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from perilscope.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n int, x string"


def reference(rows, count=4, scale=256):
    """{row number: (id, deviation)} of the remaining rows, their vectors, and the fit."""
    kept = []
    for i, v, *_ in rows:
        if v is None or not v or any(c is None or not math.isfinite(np.float32(c)) for c in v):
            continue
        kept.append((i, [math.floor(scale * float(np.float32(c))) for c in v]))
    lengths = [len(x) for _, x in kept]
    size = max(set(lengths), key=lambda s: (lengths.count(s), s))
    kept = [(i, x) for i, x in kept if len(x) == size]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array(distinct, float) - np.array([s / n for s in sums])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:count]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in kept]
    mean = np.array([s / n for s in sums])
    white = (np.array([x for _, x in kept], float) - mean) @ vectors[:, order] / np.sqrt(values[order])
    return kept, n, deviation, white, values[order], values.sum()


def sample(n, size, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, size))
    x = centres[rng.integers(0, 5, n)] + 0.3 * rng.standard_normal((n, size))
    return [(i, [float(c) for c in row], i % 3, "a") for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("size", [3, 16])
def test_components_are_the_eigenvectors(spark, size):
    rows = sample(300, size)
    rows += [(1000 + i, rows[7][1], 1, None) for i in range(200)]  # copies are fitted once
    rows += [
        (2000, None, 1, "b"), (2001, [], 1, "b"), (2002, [None] * size, 1, "b"),
        (2003, [float("nan")] * size, 1, "b"), (2004, [float("-inf")] + [0.0] * (size - 1), 1, "b"),
        (2005, [1.0] * (size + 1), 1, "b"), (None, [0.5] * size, 1, "b"),
    ]
    kept, n, deviation, white, values, trace = reference(rows)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    k = len(values)
    assert len(got) == k * len(kept)
    per_id = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        per_id.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = [np.sign(per_id[0][c + 1]["whitened"]) * np.sign(white[0][c]) for c in range(k)]
    for (i, _), dev, w in zip(kept, deviation, white):
        for c in range(k):
            r = per_id[i][c + 1]
            assert r["deviation"] == dev
            assert r["whitened"] * signs[c] == pytest.approx(w[c], rel=1e-7, abs=1e-7)


def test_equal_eigenvalues_are_all_found(spark):
    """Unit vectors on both sides of all axes: one step exhausts what a start vector reaches."""
    rows = [(2 * i + s, [float((2 * s - 1) * (j == i)) for j in range(8)], 0, "") for i in range(8) for s in (0, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 * len(rows)
    assert {round(r["explained"], 9) for r in got} == {0.125}
    assert max(r["identity_error"] for r in got) < 1e-9
    for c in range(1, 5):
        assert sum(r["whitened"] ** 2 for r in got if r["component"] == c) == pytest.approx(len(rows))


def test_no_variance_no_components(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA)
    assert whitening.whiten(one).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0, "") for i in range(9)], SCHEMA)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}


def test_empty(spark):
    found = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and found.columns[:2] == ["vec_id", "component"]
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, "")], SCHEMA)).collect() == []


def test_large_entries_have_exact_deviations_or_none():
    x = np.array([[3, -4], [2**40, 1]], np.int64)
    assert whitening.deviations(x[:1], 2, (1, 1)) == [(6 - 1) ** 2 + (-8 - 1) ** 2]
    assert whitening.deviations(x, 2, (1, 1)) == [106, None]
    assert whitening.deviations(np.array([[2**31, 0]]), 1, (0, 0)) == [2**62]
