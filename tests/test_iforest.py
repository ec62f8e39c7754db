"""Isolation forest invariants: outliers score lowest, contamination share, partition independence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators.iforest import IsolationForest, IsolationForestModel, average_path_length


def data(spark, n=600, outliers=12):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (n, 3))
    x[:outliers] += 8.0
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")


def test_average_path_length():
    assert average_path_length(np.array([1, 2]))[0] == 0.0
    assert average_path_length(np.array([2]))[0] == 1.0
    assert average_path_length(np.array([256]))[0] == pytest.approx(10.2447, abs=1e-3)


def test_outliers_flagged_and_share(spark):
    df = data(spark)
    model = IsolationForest(num_trees=100, sample_size=128, contamination=0.02, seed=42).fit(df, ["a", "b", "c"], "id")
    out = model.transform(df).toPandas().sort_values("anomaly_score")
    assert set(out["id"].head(12)) == set(range(12))
    share = (out["anomaly"] == -1).mean()
    assert share == pytest.approx(0.02, abs=0.005)
    assert set(out["anomaly"].unique()) <= {-1, 1}


def test_same_model_under_any_partitioning(spark):
    df = data(spark)
    f = ["a", "b", "c"]
    m1 = IsolationForest(50, 64, 0.05, 1).fit(df.repartition(1), f, "id")
    m2 = IsolationForest(50, 64, 0.05, 1).fit(df.repartition(9), f, "id")
    n1 = m1.nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    n2 = m2.nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    assert n1.equals(n2) and m1.offset == m2.offset


def test_save_load_roundtrip(spark, tmp_path):
    df = data(spark, 200, 4)
    m = IsolationForest(20, 64, 0.02, 3).fit(df, ["a", "b", "c"], "id")
    m.save(spark, str(tmp_path / "model"))
    m2 = IsolationForestModel.load(spark, str(tmp_path / "model"))
    a = m.transform(df).orderBy("id").select("anomaly_score").toPandas()
    b = m2.transform(df).orderBy("id").select("anomaly_score").toPandas()
    assert np.allclose(a.values, b.values)


def test_nulls_are_mean_imputed(spark):
    df = data(spark, 200, 0).withColumn("a", F.when(F.col("id") == 5, None).otherwise(F.col("a")))
    m = IsolationForest(20, 64, 0.02, 3).fit(df, ["a", "b", "c"], "id")
    assert m.transform(df).where("anomaly_score IS NULL").count() == 0


def test_nan_features_are_imputed(spark):
    df = data(spark, 200, 0).withColumn("b", F.when(F.col("id") == 7, float("nan")).otherwise(F.col("b")))
    _, out = IsolationForest(20, 64, 0.02, 3).fit_transform(df, ["a", "b", "c"], "id")
    assert out.where("anomaly_score IS NULL OR isnan(anomaly_score)").count() == 0


def test_equal_rows_score_alike_and_text_keys_work(spark):
    df = data(spark, 200, 4).select(F.format_string("k%03d", "id").alias("id"), "a", "b", F.lit(1.0).alias("c"))
    twins = df.where("id = 'k007'").select(F.lit("twin").alias("id"), "a", "b", "c")
    _, out = IsolationForest(20, 64, 0.02, 3).fit_transform(df.unionByName(twins), ["a", "b", "c"], "id")
    assert out.where("id IN ('k007', 'twin')").select("anomaly_score").distinct().count() == 1
    assert out.count() == 201


def test_constant_features_give_one_leaf_per_tree(spark):
    df = spark.range(50).select("id", F.lit(2.0).alias("a"))
    m, out = IsolationForest(5, 16, 0.1, 3).fit_transform(df, ["a"], "id")
    assert len(m.nodes) == 5 and set(m.nodes["size"]) == {16}
    assert {r.anomaly for r in out.collect()} == {1}


def test_scores_follow_the_nodes_walked_one_by_one(spark):
    df = data(spark, 300, 6)
    m, out = IsolationForest(30, 32, 0.02, 5).fit_transform(df, ["a", "b", "c"], "id")
    nodes = {(r.tree_id, r.node_id): r for r in m.nodes.itertuples()}
    for row in out.where("id % 40 = 0").collect():
        total = 0.0
        for t in range(30):
            n = nodes[t, 0]
            while n.feature >= 0:
                n = nodes[t, n.left if row["abc"[n.feature]] < n.threshold else n.right]
            total += n.depth + float(average_path_length(np.array([n.size]))[0])
        score = -2.0 ** (-total / 30 / float(average_path_length(np.array([32]))[0]))
        assert row.anomaly_score == pytest.approx(score - m.offset, abs=1e-8)
