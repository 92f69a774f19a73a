"""Driver numerics against independent formulations."""

import math

import numpy as np
import pytest

from locuspark.functions import mixed, special


def test_t_tail_against_known_values():
    assert special.t_two_sided(np.array([1.0]), 1)[0] == pytest.approx(0.5, rel=1e-13)
    assert special.t_two_sided(np.array([2.0]), 2)[0] == pytest.approx(1 - 2 / math.sqrt(6), rel=1e-12)
    # Even df: the finite series of Abramowitz and Stegun, 26.7.4.
    t, df = 3.3, 10
    sin, cos2 = t / math.sqrt(df + t * t), df / (df + t * t)
    series = 1 + 0.5 * cos2 + 0.5 * 0.75 * cos2**2 + 0.5 * 0.75 * (5 / 6) * cos2**3 + 0.5 * 0.75 * (5 / 6) * (7 / 8) * cos2**4
    assert special.t_two_sided(np.array([t]), df)[0] == pytest.approx(1 - sin * series, rel=1e-11)
    assert special.t_two_sided(np.array([0.0, np.inf, np.nan]), 7)[:2].tolist() == [1.0, 0.0]


def _data(n=60, m=80, seed=3):
    rng = np.random.default_rng(seed)
    g = rng.binomial(2, 0.35, (n, m)).astype(float)
    z = g - g.mean(axis=0)
    return rng, g, z @ z.T / m


def test_reml_matches_dense_restricted_likelihood():
    rng, g, k = _data()
    x = np.column_stack([np.ones(60), rng.normal(size=60)])
    y = x @ [1.0, 0.5] + np.linalg.cholesky(k + 1e-9 * np.eye(60)) @ rng.normal(size=60) + rng.normal(size=60)
    fit = mixed.reml(y, x, k)

    def dense(delta):
        v = k + delta * np.eye(60)
        vi = np.linalg.inv(v)
        p = vi - vi @ x @ np.linalg.inv(x.T @ vi @ x) @ x.T @ vi
        q = 60 - 2
        return 0.5 * (q * (math.log(q / (2 * math.pi)) - 1 - math.log(y @ p @ y)) - np.linalg.slogdet(v)[1] - np.linalg.slogdet(x.T @ vi @ x)[1] + np.linalg.slogdet(x.T @ x)[1])

    assert fit.reml == pytest.approx(dense(fit.delta), rel=1e-9)
    grid = np.exp(np.linspace(-10, 10, 2001))
    assert fit.reml >= max(dense(d) for d in grid) - 1e-9


def test_reml_with_incidence_is_reml_of_the_product():
    rng, _, k = _data(20)
    z = np.zeros((60, 20))
    z[np.arange(60), np.arange(60) % 20] = 1
    y = rng.normal(size=60)
    x = np.ones((60, 1))
    assert mixed.reml(y, x, k, z=z) == mixed.reml(y, x, z @ k @ z.T)
    with pytest.raises(ValueError):
        mixed.reml(y, np.ones((60, 1)), np.eye(1), z=np.ones((60, 1)))


def test_average_linkage_against_the_naive_procedure():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(25, 4))
    merges = mixed.average_linkage(points)
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    clusters = [[i] for i in range(25)]
    heights = []
    for groups in range(24, 0, -1):
        pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j]
        h, i, j = min(pairs)
        heights.append(h)
        clusters[i] += clusters.pop(j)
        label = mixed.cut_tree(merges, 25, groups)
        assert {frozenset(np.nonzero(label == c)[0]) for c in set(label)} == {frozenset(c) for c in clusters}
    assert np.allclose(merges[:, 2], heights)
    assert sorted(mixed.leaf_order(merges, 25)) == list(range(25))


def test_golden_section():
    assert mixed.minimum(lambda v: (v - 1.234) ** 2, -10, 10) == pytest.approx(1.234, abs=1e-6)
