"""Soft and divisive clustering on planted groups."""

import random

import numpy as np
import pytest

from spendlens.operators import ml as ML


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    rows = [(k, (0, 8, 0, 8)[k % 4] + rng.gauss(0, 0.5), (0, 0, 9, 9)[k % 4] + rng.gauss(0, 0.5), None if k % 50 else 1.0) for k in range(400)]
    return spark.createDataFrame(rows, "id long, x double, y double, mostly_missing double")


def test_mixture_probabilities_and_groups(spark, planted):
    rows = ML.gaussian_mixture(planted, ["x", "y"], "id", 4, starts=3).collect()
    assert len(rows) == 400 and all(abs(r.p0 + r.p1 + r.p2 + r.p3 - 1) < 1e-9 for r in rows)
    assert all(r.cluster == max(range(4), key=lambda i: r[f"p{i}"]) for r in rows)
    fits = ML.mixture_likelihoods(planted, ["x", "y"], "id", 4, (1, 4, 12))
    assert fits[0] <= fits[1] + 1e-6 and fits[1] <= fits[2] + 1e-6


def test_bisecting_paths_nest_and_find_the_groups(spark, planted):
    deep = {r.id: r for r in ML.bisecting_clusters(planted, ["x", "y"], "id", depth=2, min_size=10).collect()}
    flat = {r.id: r.path for r in ML.bisecting_clusters(planted, ["x", "y"], "id", depth=1, min_size=10).collect()}
    assert len(deep) == 400 and all(deep[k].path.startswith(flat[k]) for k in deep)
    groups = {}
    for k, r in deep.items():
        groups.setdefault(k % 4, set()).add(r.path)
    assert all(len(v) == 1 for v in groups.values()) and len(set.union(*groups.values())) == 4
    assert sorted({(r.path, r.cluster) for r in deep.values()}) == list(zip(["00", "01", "10", "11"], range(4)))


def test_small_and_constant_clusters_are_not_split(spark, planted):
    assert {r.path for r in ML.bisecting_clusters(planted, ["x", "y"], "id", depth=3, min_size=150).collect()} <= {"0", "1", "00", "01", "10", "11"}
    assert {r.path for r in ML.bisecting_clusters(planted, ["x", "y"], "id", depth=2, min_size=500).collect()} == {""}
    same = spark.createDataFrame([(k, 1.0) for k in range(20)], "id long, x double")
    assert {(r.path, r.cluster) for r in ML.bisecting_clusters(same, ["x"], "id", depth=2, min_size=2).collect()} == {("", 0)}
    assert ML.bisecting_clusters(same.limit(0), ["x"], "id", depth=2, min_size=2).count() == 0


def test_mixture_starts_share_their_passes(spark, planted, monkeypatch):
    passes, real = [], ML._moments
    monkeypatch.setattr(ML, "_moments", lambda blocks, width, models: passes.append(len(models)) or real(blocks, width, models))
    z = ML.mixture_features(planted, ["x", "y"], "id")
    fits = ML.mixture_likelihoods(z, ["x", "y"], "id", 4, (1, 4, 12), prepared=True)
    assert len(passes) <= 12 and set(passes) == {1} and fits == sorted(fits)
    passes.clear()
    assert ML.gaussian_mixture(z, ["x", "y"], "id", 4, starts=3, max_iter=6, prepared=True).count() == 400
    assert len(passes) <= 6 and passes[0] == 3


def test_mixture_moments_equal_plain_ones(spark, planted, monkeypatch):
    monkeypatch.setattr(ML, "BLOCK_ROWS", 7)
    z = ML.mixture_features(planted, ["x", "y"], "id")
    x = np.array([(r.x, r.y) for r in z.collect()]).T
    model = ML._Mixture(x.T[:20], 3, 1)
    (got,) = ML._moments(ML._blocks(z, ["x", "y"]), 2, [model])
    p = np.array([[w * np.exp(f - 0.5 * sum((root @ (row - m)) ** 2)) for w, m, root, f in zip(
        model.weights, model.means, model.roots, model.factors, strict=True)] for row in x.T]) + np.finfo(float).eps
    share = p / p.sum(1)[:, None]
    want = [np.log(p.sum(1)).sum(), *share.sum(0), *(share.T @ x.T).ravel(), *np.einsum("ni,an,bn->iab", share, x, x).ravel()]
    assert np.allclose(got, want)
    same = spark.createDataFrame([(None, 1.0)] * 5 + [(2, 1.0)], "id long, x double")
    for rows, n in ((same, 6), (same.limit(0), 0)):
        assert ML.gaussian_mixture(ML.mixture_features(rows, ["x"], "id"), ["x"], "id", 2, prepared=True).count() == n
