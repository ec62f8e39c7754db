"""Histograms, binned means, KDE and correlation against NumPy/pandas definitions."""

import math

import numpy as np
import pandas as pd
import pytest

from spendlens.operators import stats as ST


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.lognormal(3, 1, 500), [0.5, 0.5 + 1e-9]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for bins in (1, 7, 80):
        h = ST.histogram(df, "x", bins).orderBy("bin").toPandas()
        counts, edges = np.histogram(vals, bins=bins)
        assert h["frequency"].tolist() == counts.tolist()
        assert h["lo"].tolist() == pytest.approx(edges[:-1].tolist(), rel=1e-15)
        assert int(h["frequency"].sum()) == len(vals)


def test_histogram_value_on_edges_and_constant(spark):
    vals = [0.0, 1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = ST.histogram(df, "x", 4).orderBy("bin").toPandas()
    assert h["frequency"].tolist() == np.histogram(vals, bins=4)[0].tolist()
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    hc = ST.histogram(const, "x", 10).orderBy("bin").toPandas()
    counts, edges = np.histogram([5.0, 5.0], bins=10)
    assert hc["frequency"].tolist() == counts.tolist() and hc["lo"].iloc[0] == edges[0]


def test_log1p_histogram_uses_log_range(spark):
    vals = [1.0, 10.0, 100.0, 1000.0, -5.0, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = ST.histogram(df, "x", 5, positive=True, log1p=True).orderBy("bin").toPandas()
    pos = np.log1p([v for v in vals if v > 0])
    counts, edges = np.histogram(pos, bins=5)
    assert h["frequency"].tolist() == counts.tolist()
    assert h["hi"].iloc[-1] == pytest.approx(edges[-1])


def test_binned_mean_equals_pd_cut(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(300, 850, 400).astype(float)
    y = rng.normal(100, 20, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = ST.binned_mean(df, "x", "y", 5).orderBy("bin").toPandas()
    cats = pd.cut(pd.Series(x), bins=5)
    want = pd.Series(y).groupby(cats, observed=True).mean()
    assert got["mean"].tolist() == pytest.approx(want.tolist(), rel=1e-12)
    assert got["lo"].tolist() == pytest.approx([iv.left for iv in want.index], rel=1e-12)
    assert got["hi"].tolist() == pytest.approx([iv.right for iv in want.index], rel=1e-12)


def test_kde_matches_gaussian_formula_and_integrates(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(300, 850, 300).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    k = ST.kde(df, "x", "g").orderBy("point").toPandas()
    n = len(x)
    bw = np.std(x, ddof=1) * n ** (-0.2)
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(axis=1) / (n * bw * math.sqrt(2 * math.pi))
    assert k["x"].tolist() == pytest.approx(grid.tolist(), rel=1e-12)
    assert k["density"].tolist() == pytest.approx(dens.tolist(), rel=1e-9)
    assert np.trapezoid(k["density"], k["x"]) == pytest.approx(1.0, abs=1e-3)


@pytest.mark.parametrize("error", [1e-2, 1e-4, 1e-6])
def test_binned_density_keeps_its_bound(spark, error):
    rng = np.random.default_rng(8)
    rows = [("a", float(v)) for v in rng.normal(50, 9, 700)] + [("b", float(v)) for v in rng.pareto(1.5, 900)]
    rows += [("b", 4000.0), ("one", 1.0), ("flat", 2.0), ("flat", 2.0), ("a", None), (None, 3.0), ("a", math.inf)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = ST.kde(df, "x", "g").toPandas().set_index(["g", "point"]).sort_index()
    got = ST.kde(df, "x", "g", error=error).toPandas().set_index(["g", "point"]).sort_index()
    assert got.index.equals(want.index) and set(got.index.get_level_values(0)) == {"a", "b"}
    assert got["x"].tolist() == want["x"].tolist()
    for g, x in (("a", [v for k, v in rows if k == "a" and v is not None and v < 1e9]), ("b", [v for k, v in rows if k == "b"])):
        peak = 1 / (np.std(x, ddof=1) * len(x) ** -0.2 * math.sqrt(2 * math.pi))
        assert (got.loc[g, "density"] - want.loc[g, "density"]).abs().max() <= error * peak * (1 + 1e-9)
    assert ST.kde(df.where("false"), "x", "g", error=error).count() == 0


def test_correlation_equals_pandas_pairwise(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(0, 1, 200)
    b = a * 2 + rng.normal(0, 1, 200)
    c = rng.normal(5, 2, 200)
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::5, "c"] = np.nan
    df = spark.createDataFrame(pdf)
    got = ST.correlation(df, ["a", "b", "c"]).toPandas()
    want = pdf.corr()
    for _, r in got.iterrows():
        assert r["r"] == pytest.approx(want.loc[r["col_a"], r["col_b"]], rel=1e-9)
    sym = got.pivot(index="col_a", columns="col_b", values="r")
    assert np.allclose(sym.values, sym.values.T)


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (3.0, 0.1 * 1.0000000000000002)], "a double, k double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in ST.correlation(df, ["a", "k"]).collect()}
    assert got[("a", "k")] is None and got[("k", "k")] is None and got[("a", "a")] == 1.0


def test_standardise_population_std(spark):
    vals = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(i, v, 7.0) for i, v in enumerate(vals)], "id int, x double, k double")
    z = ST.standardise(df, ["x", "k"]).orderBy("id").toPandas()
    want = (np.array(vals) - np.mean(vals)) / np.std(vals)
    assert z["x"].tolist() == pytest.approx(want.tolist()) and z["k"].tolist() == [0.0] * 4
