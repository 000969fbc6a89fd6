import numpy as np
import pytest

from gaugeworks.llm.whitening import Centre, cholesky, solve_upper, whiten, whole_vectors

SCHEMA = "vec_id bigint, embedding array<double>, x string, n int, dim int"


def plain(vectors):
    """n, exact deviations, eigenvalues and axes of the different whole vectors, by eigh in long doubles' reach."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], object)
    different = sorted(set(map(tuple, x.tolist())))
    n, sums = len(different), [sum(col) for col in zip(*different, strict=True)]
    whole = np.array([[n * c - s for c, s in zip(row, sums, strict=True)] for row in different], object)
    cov = np.array((whole.T @ whole), float) / float(n) ** 3
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    centred = np.array([[float(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x.tolist()])
    values, axes = np.linalg.eigh(cov)
    return n, deviations, values[::-1], axes.T[::-1], centred


def made(spark, vectors, parts=5):
    return spark.createDataFrame([(i, [float(c) for c in v], "x", 1, 2) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("dim, n", [(4, 60), (20, 400)])
def test_against_brute_force(spark, dim, n):
    rng = np.random.default_rng(dim)
    vectors = rng.normal(size=(n, dim)) @ np.diag(1.7 ** -np.arange(dim)) * 30
    vectors = np.concatenate([vectors, vectors[:7], np.repeat(vectors[:1], n // 3, 0)])  # copies count once in the fit
    count, deviations, values, axes, centred = plain(vectors.tolist())
    rows = whiten(whole_vectors(made(spark, vectors.tolist()))).collect()
    k = min(dim, 16)
    assert len(rows) == len(vectors) * k
    got = np.full((len(vectors), k), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == count and r.deviation == deviations[r.vec_id] and 0 <= r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 * r.explained
    want = centred @ axes[:k].T / np.sqrt(values[:k])
    signs = np.sign((got * want).sum(0))
    assert np.abs(got - want * signs).max() < 1e-6


def test_directions_without_variance_have_no_component(spark):
    rng = np.random.default_rng(1)
    flat = rng.integers(-9, 9, (50, 2))
    vectors = [[a, b, a + b, 5.0, 2 * a] for a, b in flat.tolist()]
    rows = whiten(whole_vectors(made(spark, vectors))).collect()
    assert {r.component for r in rows} == {1, 2} and len(rows) == 100
    assert abs(sum({r.component: r.explained for r in rows}.values()) - 1) < 1e-12
    assert max(r.identity_error for r in rows) < 1e-9
    assert whiten(whole_vectors(made(spark, [[1.0, 2.0]] * 6))).count() == 0


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 9.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 1.0]),
            (9, [1e12, 0.0]), (1, [1.0, 2.0]), (10, [1.0]), (11, [2.0]), (12, [4.0]), (13, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, None, 1, 1) for i, v in rows], SCHEMA)
    out = whiten(whole_vectors(table)).collect()
    assert sorted([r.vec_id for r in out], key=str) == sorted([1, 1, 1, 1, 2, 2, None, None, 10, 11, 12], key=str)
    assert {r.n for r in out} == {3}
    assert whiten(whole_vectors(table.limit(0))).count() == 0
    assert whiten(whole_vectors(table.limit(0))).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_independent_of_partitions(spark):
    vectors = (np.random.default_rng(3).normal(size=(90, 6)) * 3).tolist()
    one, many = ({(r.vec_id, r.component): r for r in whiten(whole_vectors(made(spark, vectors, p))).collect()} for p in (1, 11))
    assert one.keys() == many.keys()
    for key, r in one.items():
        assert r.deviation == many[key].deviation and abs(r.whitened - many[key].whitened) < 1e-9


def test_helpers():
    rng = np.random.default_rng(2)
    rows, r = rng.normal(size=(9, 5)), np.triu(rng.normal(size=(5, 5))) + 3 * np.eye(5)
    assert np.allclose(solve_upper(rows, r) @ r, rows)
    assert np.allclose((c := cholesky(np.ones((3, 3)), False)).T @ c, np.ones((3, 3)), atol=1e-9)
    huge = Centre.of(10 ** 9, [10 ** 15 + 5])
    assert huge.deviations(np.array([[10 ** 6 + 1]])) == [(10 ** 9 * (10 ** 6 + 1) - 10 ** 15 - 5) ** 2]
    assert huge.deviations(np.array([[10 ** 6 + 10]])) == [None]
