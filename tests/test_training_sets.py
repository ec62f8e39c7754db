"""Stratified folds, dictionaries and imputation by the most frequent value."""

from pyspark.sql import functions as F

from spendlens.operators import ml as ML


def test_folds_keep_class_shares_and_keys_together(spark):
    df = spark.range(1003).selectExpr("id AS k", "id % 10 = 0 AS hit", "CAST(id AS STRING) AS x").unionByName(
        spark.range(20).selectExpr("id * 3 AS k", "true AS hit", "'7.5' AS x"))  # repeated keys, other labels
    awkward = spark.createDataFrame([(None, True, "1"), (5000, None, "2"), (5001, False, None)], "k long, hit boolean, x string")
    out = ML.training_set(df.unionByName(awkward), "k", "hit", ["x"], folds=4, buckets=8)
    rows = out.collect()
    assert len(rows) == 1024 and out.columns == ["k", "y", "fold", "x"]
    folds, classes = {}, {}
    for r in rows:
        folds.setdefault(r.k, set()).add(r.fold)
        classes[r.k] = max(classes.get(r.k, 0), r.y)
    assert all(len(f) == 1 for f in folds.values())
    for y in (0, 1):
        sizes = [sum(1 for k, c in classes.items() if c == y and folds[k] == {f}) for f in range(4)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(c == y for c in classes.values())
    again = ML.training_set(df.unionByName(awkward).repartition(7), "k", "hit", ["x"], folds=4, buckets=8)
    assert {(r.k, r.fold) for r in again.collect()} == {(r.k, r.fold) for r in rows}
    assert ML.training_set(df.limit(0), "k", "hit", ["x"]).count() == 0


def test_dictionary_orders_by_frequency_and_marks_null_and_unseen(spark):
    rows = [("b", 1), ("a", 1), ("b", 2), (None, 2), ("", 2), ("c", None)]
    df = spark.createDataFrame(rows, "s string, n int")
    fitted = ML.fit_dictionary(df, ["s", "n"], buckets=2)
    codes = {(r.column, r.value): (r.n, r.code) for r in fitted.collect()}
    assert codes["s", "b"] == (2, 2) and sorted(c for (col, _), (_, c) in codes.items() if col == "s") == [2, 3, 4, 5]
    assert codes["n", "2"] == (3, 2) and codes["n", "1"] == (2, 3) and len(codes) == 6
    new = spark.createDataFrame([("b", 9), (None, 1), ("zz", None)], "s string, n int")
    got = {(r.s, r.n): (r.s_code, r.n_code) for r in ML.encode(new, fitted, ["s", "n"]).collect()}
    assert got == {("b", 9): (2, 1), (None, 1): (0, 3), ("zz", None): (1, 0)}
    often = ML.fit_dictionary(df, ["s", "n"], min_count=2)
    assert {(r.column, r.value) for r in often.collect()} == {("s", "b"), ("n", "1"), ("n", "2")}
    assert ML.fit_dictionary(df.limit(0), ["s"]).count() == 0


def test_mode_imputation_takes_the_most_frequent_value_and_the_smaller_of_ties(spark):
    df = spark.createDataFrame([(1, "b", 5), (2, "a", None), (3, "b", 7), (4, "a", 9), (5, None, None)], "id int, s string, n int")
    got = {r.id: (r.s, r.n) for r in ML.impute(df, ["s", "n"], "mode").collect()}
    assert got == {1: ("b", 5), 2: ("a", 5), 3: ("b", 7), 4: ("a", 9), 5: ("a", 5)}
    assert ML.impute(df.select("id", F.lit(None).cast("string").alias("s")), ["s"], "mode").where("s IS NULL").count() == 5
