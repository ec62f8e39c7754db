"""Exact distributed quantiles equal NumPy's linear interpolation, under any partitioning."""

import numpy as np
import pytest

from spendlens.operators.quantiles import exact_quantile, exact_quantiles


@pytest.mark.parametrize("q", [0.0, 0.02, 0.25, 0.5, 0.75, 1.0])
def test_global_matches_numpy(spark, q):
    rng = np.random.default_rng(1)
    vals = np.round(rng.gamma(2.0, 50.0, 997), 2)
    vals[:50] = 12.5  # many repeats
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    got = exact_quantile(df, "x", q).first()["quantile"]
    assert got == pytest.approx(float(np.percentile(vals, q * 100)), rel=1e-12)


def test_grouped_matches_numpy_and_partitioning(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 5, 600), rng.normal(0, 10, 600))]
    df = spark.createDataFrame(rows, "g int, x double")
    for parts in (1, 9):
        got = {r["g"]: r["quantile"] for r in exact_quantile(df.repartition(parts), "x", 0.5, ["g"]).collect()}
        for g in range(5):
            xs = [v for k, v in rows if k == g]
            assert got[g] == pytest.approx(float(np.median(xs)), rel=1e-12)


def test_nulls_ignored_and_empty_is_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),)], "x double")
    assert exact_quantile(df, "x", 0.5).first()[0] == 2.0
    empty = spark.createDataFrame([], "x double")
    assert exact_quantile(empty, "x", 0.5).first()[0] is None


def test_several_quantiles_grouped(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "g string, x double")
    r = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], ["g"]).first()
    assert (r["q00"], r["q25"], r["q50"], r["q100"]) == (1.0, 3.25, 5.5, 10.0)


def test_split_grouped_matches_numpy_with_hot_group_and_null_key(spark):
    rng = np.random.default_rng(9)
    hot = [("hot", float(v)) for v in np.round(rng.gamma(2.0, 40.0, 900), 2)]
    cold = [(f"g{int(k)}", float(v)) for k, v in zip(rng.integers(0, 6, 120), np.round(rng.normal(50, 9, 120), 2))]
    nulls = [(None, 3.0), (None, 5.0), (None, 10.0)]
    rows = hot + cold + nulls
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for q in (0.5, 0.02, 0.9):
        got = {r["g"]: r["quantile"] for r in exact_quantile(df, "x", q, ["g"], split=True).collect()}
        for g in {k for k, _ in rows}:
            xs = [v for k, v in rows if k == g]
            assert got[g] == pytest.approx(float(np.percentile(xs, q * 100)), rel=1e-12), (g, q)


def test_several_quantiles_split_equal_unsplit(spark):
    rng = np.random.default_rng(11)
    rows = [("big", float(v)) for v in rng.normal(0, 5, 700)] + [("small", float(v)) for v in rng.normal(3, 1, 30)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    a = {r["g"]: tuple(r[1:]) for r in exact_quantiles(df, "x", qs, ["g"]).collect()}
    b = {r["g"]: tuple(r[1:]) for r in exact_quantiles(df, "x", qs, ["g"], split=True).collect()}
    assert a.keys() == b.keys()
    for g in a:
        assert a[g] == pytest.approx(b[g], rel=1e-12)
        xs = [v for k, v in rows if k == g]
        assert b[g] == pytest.approx(tuple(np.percentile(xs, [q * 100 for q in qs])), rel=1e-12)


@pytest.mark.parametrize("partitions", [3, 700])
def test_large_groups_are_bracketed_not_ranked_whole(spark, partitions):
    """Far more values than WHOLE: the bracket path, whatever the number of shuffle partitions."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    vals = np.round(rng.gamma(2.0, 50.0, 70_000), 3)
    vals[:30_000] = 12.5  # one value holds much of the group
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"x": vals})).withColumn("g", F.lit("hot"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for q in (0.0, 0.02, 0.2, 0.5, 0.75, 1.0):
            want = float(np.percentile(vals, q * 100))
            assert exact_quantile(df, "x", q).first()["quantile"] == pytest.approx(want, rel=1e-12)
        assert exact_quantile(df, "x", 0.9, ["g"], split=True).first()["quantile"] == pytest.approx(float(np.percentile(vals, 90)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_a_bracket_that_misses_its_rank_ends_the_job(spark, keys):
    df = spark.range(60_000).selectExpr("id % 2 AS g", "CAST(pmod(id * 7919, 60000) AS DOUBLE) AS x")
    want = {0: 29999.0, 1: 30000.0}
    good = exact_quantile(df, "x", 0.5, keys, split=bool(keys)).collect()
    assert [r["quantile"] for r in good] == [29999.5] if not keys else {r["g"]: r["quantile"] for r in good} == want
    with pytest.raises(Exception, match="outside the sketched bracket"):  # the bracket is laid beyond the rank
        exact_quantile(df, "x", 0.5, keys, split=bool(keys), margin=-0.2).collect()
