"""Whitening against a plain calculation with exact numbers and a library's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from evenground.llm import queries, whitening


def plain(vectors, k=4):
    """(n, sums, values, vectors, trace, different vectors) of lattice vectors, by exact fractions and LAPACK."""
    different = sorted(set(map(tuple, vectors)))
    n, sums = len(different), [sum(c) for c in zip(*different, strict=True)]
    y = [[Fraction(v) - Fraction(s, n) for v, s in zip(x, sums, strict=True)] for x in different]
    covariance = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(len(sums))] for i in range(len(sums))])
    values, axes = np.linalg.eigh(covariance)
    return n, sums, values[::-1][:k], axes[:, ::-1][:, :k], float(np.trace(covariance)), different


def rows_of(spark, vectors):
    df = spark.createDataFrame([(i, v, "c", 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x string, n int, i int")
    return df.repartition(3)


def on_lattice(vectors):
    return [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]


def check(got, vectors):
    x = on_lattice(vectors)
    n, sums, values, axes, trace, _ = plain(x)
    found = {(r["vec_id"], r["component"]): r for r in got}
    assert len(found) == len(got) == len(x) * len(values)
    signs = [0.0] * len(values)
    for i, row in enumerate(x):
        centred = np.array([v - s / n for v, s in zip(row, sums, strict=True)])
        for k, e in enumerate(values):
            r = found[i, k + 1]
            assert r["n"] == n and int(r["deviation"]) == sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))
            assert r["explained"] == pytest.approx(e / trace, rel=1e-9)
            assert abs(r["identity_error"]) < 1e-9
            wanted = centred @ axes[:, k] / math.sqrt(e)
            signs[k] = signs[k] or (math.copysign(1, r["whitened"] * wanted) if abs(wanted) > 1e-3 else 0.0)
            assert r["whitened"] == pytest.approx((signs[k] or 1) * wanted, abs=1e-7)


def test_whitening_equals_plain_calculation(spark):
    draw = np.random.default_rng(3)
    vectors = (draw.normal(size=(120, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 7).tolist()
    vectors += vectors[:20] + [vectors[5]] * 30
    check(whitening.whiten(rows_of(spark, vectors)).collect(), vectors)


def test_query_on_the_table(spark, llm_dir):
    table = spark.read.parquet(f"{llm_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = sorted((r["vec_id"], r["embedding"]) for r in table if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"]))
    got = queries.queries()["op12_embedding_whitening"](spark, llm_dir).collect()
    names = {v: i for i, (v, _) in enumerate(good)}
    assert len(names) == len(good)
    check([{**r.asDict(), "vec_id": names[r["vec_id"]]} for r in got], [v for _, v in good])


@pytest.mark.parametrize("d", [1, 2, 5, 33, 64])
def test_rotations(d):
    draw = np.random.default_rng(d)
    m = draw.normal(size=(d + 3, d)) * np.logspace(0, -7, d)
    m = m.T @ m
    values, axes = whitening.jacobi(m)
    assert np.all(np.diff(values) <= 0)
    assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-13)
    assert np.allclose(axes * values @ axes.T, m, atol=1e-13 * np.abs(m).max())


def test_small_eigenvalues_are_accurate():
    scale = np.diag(10.0 ** -np.arange(0, 16, 2))
    core = np.eye(8) + 0.1 * (np.ones((8, 8)) - np.eye(8))
    values, _ = whitening.jacobi(scale @ core @ scale)
    exact = np.linalg.eigvalsh(core)
    # scaled diagonal dominance bounds every eigenvalue by its own diagonal entry
    assert np.all(values[::-1] > 0) and np.prod(values) == pytest.approx(np.prod(exact) * np.prod(np.diag(scale)) ** 2, rel=1e-12)


def test_every_pair_meets_once():
    for d in (2, 3, 8, 9):
        pairs = [pq for p, q in whitening._rounds(d) for pq in zip(p.tolist(), q.tolist(), strict=True)]
        assert sorted(pairs) == [(i, j) for i in range(d) for j in range(i + 1, d)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [1.0, None], [nan, 1.0], [1.0, -inf], [1e30, 0.0], [], [-0.0, 0.25], [0.0, 0.25], [1.0, 2.0], [3.0, -1.0], [5.0]]
    got = whitening.whiten(rows_of(spark, vectors)).collect()
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert sorted(by) == [(i, c) for i in (6, 7, 8, 9) for c in (1, 2)] + [(10, 1)]
    assert by[6, 1]["n"] == 3 and by[6, 1]["whitened"] == by[7, 1]["whitened"]
    alone = by[10, 1]
    assert (alone["n"], int(alone["deviation"]), alone["whitened"], alone["explained"], alone["identity_error"]) == (1, 0, None, None, None)
    line = whitening.whiten(rows_of(spark, [[1.0, 1.0, 1.0], [2.0, 2.0, 2.0], [4.0, 4.0, 4.0]])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True, 3: True}
    assert whitening.whiten(rows_of(spark, [])).count() == 0


def test_large_numbers_stay_exact(spark):
    vectors = [[2.0**40, -(2.0**39)], [2.0**40 - 2.0**20, 1.0], [5.0, 2.0**33]]
    got = whitening.whiten(rows_of(spark, vectors)).collect()
    x = on_lattice(vectors)
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {(r["vec_id"], int(r["deviation"])) for r in got} == {(i, sum((3 * v - s) ** 2 for v, s in zip(r, sums, strict=True))) for i, r in enumerate(x)}
