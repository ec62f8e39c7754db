"""Aggregates on hand-built frames: null keys, one-row groups, ties, pct, joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.operators import aggregates as A
from spendlens.operators import reports as R

TXN_SCHEMA = ("transaction_id long, date timestamp_ntz, client_id long, card_id long, amount_usd double, "
              "transaction_type string, merchant_id long, merchant_city string, mcc int, errors string")


def txn(spark):
    d = dt.datetime
    rows = [
        (1, d(2010, 1, 1, 0, 1), 10, 100, -77.0, "Swipe Transaction", 500, "Beulah", 5499, None),
        (2, d(2010, 1, 1, 23), 10, 100, 1234.56, "Chip Transaction", 500, "Bettendorf", 5311, "Bad PIN"),
        (3, d(2010, 1, 2, 1), 10, 101, 0.0, "Online Transaction", 501, "ONLINE", 4829, "Bad PIN,Insufficient"),
        (5, d(2010, 2, 28, 12), 11, 102, 3.0, None, 502, "Rome", 5812, None),
        (6, d(2010, 3, 1), None, 103, 9.0, "chip transaction", 502, "Rome", 5812, None),
        (7, d(2010, 3, 2), 12, 104, 4.0, "chip", 503, "Bettendorf", 5812, None),
        (8, d(2010, 3, 3), 12, 104, 6.0, "chip", 503, "Beulah", 5812, None),
    ]
    return spark.createDataFrame(rows, TXN_SCHEMA)


def test_user_aggregate_semantics(spark):
    ua = {r["user_id"]: r for r in A.user_aggregate(txn(spark)).collect()}
    assert set(ua) == {10, 11, 12}  # NULL client dropped (F8)
    u10 = ua[10]
    assert u10["txn_count"] == 3 and u10["amount_sum"] == pytest.approx(1157.56)
    assert u10["txn_span_days"] == 1  # 00:01 -> next day 01:00 is one whole day
    assert u10["error_rate_pct"] == pytest.approx(200 / 3)
    assert u10["chip_usage_pct"] == pytest.approx(100 / 3)
    assert u10["unique_merchants"] == 2 and u10["amount_median"] == 0.0
    assert ua[11]["amount_std"] is None and ua[11]["txn_frequency"] == 1.0  # one-row group


def test_user_aggregate_median_strategies_agree(spark):
    t = txn(spark)
    a = {r["user_id"]: r["amount_median"] for r in A.user_aggregate(t).collect()}
    b = {r["user_id"]: r["amount_median"] for r in A.user_aggregate(t, median="distributed").collect()}
    assert a == b


def test_mode_ties_pick_smallest(spark):
    m = {r["merchant_id"]: r["merchant_city"] for r in A.mode_per_group(txn(spark), "merchant_id",
                                                                         "merchant_city").collect()}
    assert m[503] == "Bettendorf" and m[502] == "Rome"


def test_enrichment_joins_on_id_not_position(spark):
    users = spark.createDataFrame([(12, "F", 700), (10, "M", 650)], "id long, gender string, credit_score int")
    cards = spark.createDataFrame([(100, 10, 1000.0), (101, 10, 3000.0), (999, 77, 5.0)],
                                  "card_id long, client_id long, credit_limit_usd double")
    ua = {r["user_id"]: r for r in A.user_aggregate(txn(spark), users, cards).collect()}
    assert ua[12]["gender"] == "F" and ua[10]["credit_score"] == 650 and ua[11]["gender"] is None
    assert ua[10]["avg_credit_limit"] == 2000.0 and ua[10]["num_cards"] == 2 and ua[12]["num_cards"] is None


def test_risk_metrics_flags(spark):
    users = spark.createDataFrame([(10, 70, 5.0, 0.0), (11, 30, 1.0, 10.0)],
                                  "id long, current_age int, total_debt double, yearly_income double")
    rm = {r["user_id"]: r for r in A.risk_metrics(A.user_aggregate(txn(spark), users)).collect()}
    assert rm[10]["is_senior"] is True and rm[11]["is_senior"] is False and rm[12]["is_senior"] is False
    assert rm[10]["high_error_rate"] is True and rm[11]["high_error_rate"] is False
    assert rm[11]["amount_volatility"] == 0.0  # NULL std -> 0
    assert rm[10]["debt_to_income"] == pytest.approx(5e6)


def test_sql_style_inner_and_weighted_limit(spark):
    users = spark.createDataFrame([(10, 700), (11, 600)], "id long, credit_score int")
    cards = spark.createDataFrame([(100, 10, 1000.0, True), (101, 10, 4000.0, False), (102, 11, 50.0, False)],
                                  "card_id long, client_id long, credit_limit_usd double, card_on_dark_web boolean")
    ub = {r["user_id"]: r for r in A.user_aggregate_inner(txn(spark), users, cards).collect()}
    assert set(ub) == {10, 11}
    # two transactions on card 100 and one on card 101: transaction-weighted
    assert ub[10]["txn_weighted_credit_limit"] == pytest.approx((1000 * 2 + 4000) / 3)
    assert ub[10]["has_dark_web_card"] == 1 and ub[11]["has_dark_web_card"] == 0
    assert ub[10]["total_errors"] == 2


def test_top_n_and_share(spark):
    t = txn(spark)
    top = R.top_errors(t.union(t)).collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0]["n"] == 2
    share = {r["k"]: r["pct"] for r in R.share_of_total(
        spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long"), "n").collect()}
    assert share == {"a": 25.0, "b": 75.0}


def test_daily_and_weekday(spark):
    t = txn(spark)
    daily = {r["date"]: r["txn_count"] for r in A.daily_aggregate(t).collect()}
    assert daily[dt.date(2010, 1, 1)] == 2
    wd = {r["txn_dow"]: r["dow_label"] for r in R.weekday_counts(t).collect()}
    assert wd[4] == "Fri"  # 2010-01-01 was a Friday
    assert R.hour_counts(t).agg(F.sum("txn_count")).first()[0] == 7


def test_nan_amounts_are_ignored_not_raised(spark):
    rows = [(1, dt.datetime(2010, 1, 1), 10, 100, float("nan"), "chip", 500, "A", 1, None),
            (2, dt.datetime(2010, 1, 2), 10, 100, 4.0, "chip", 500, "A", 1, None),
            (3, dt.datetime(2010, 1, 3), 10, 100, 6.0, "chip", 500, "A", 1, None)]
    t = spark.createDataFrame(rows, TXN_SCHEMA)
    u = A.user_aggregate(t).first()
    assert u["txn_count"] == 3 and u["amount_sum"] == 10.0 and u["amount_mean"] == 5.0
    assert u["amount_median"] == 5.0 and u["amount_std"] == pytest.approx(2 ** 0.5)
    assert (u["amount_min"], u["amount_max"]) == (4.0, 6.0)
    assert A.merchant_aggregate(t).first()["amount_mean"] == 5.0
    assert R.monthly_volume(t).first()["avg_amount"] == 5.0


def test_frame_and_sql_style_user_aggregates_agree(spark):
    """SURVEY §5.3: G1 and G20 agree where their semantics coincide (counts, mean amount, errors)."""
    from conftest import SF_SMALL
    from spendlens.sources import adapters as AD

    t = AD.txn(spark, SF_SMALL, ["client_id", "card_id", "amount_usd", "date", "errors", "transaction_type",
                                 "merchant_id"])
    a = {r["user_id"]: r for r in A.user_aggregate(t).collect()}
    b = {r["user_id"]: r for r in A.user_aggregate_inner(t, AD.users(spark, SF_SMALL), AD.cards(spark, SF_SMALL))
         .collect()}
    assert set(a) == set(b)  # every transaction finds its user and card in the adapters
    for uid, r in b.items():
        assert r["txn_count"] == a[uid]["txn_count"]
        assert r["avg_amount"] == a[uid]["amount_mean"]
        assert r["total_errors"] == round(a[uid]["error_rate_pct"] * a[uid]["txn_count"] / 100)
        assert r["chip_ratio"] == pytest.approx(a[uid]["chip_usage_pct"] / 100)


def test_value_counts_and_merchants_from_one_unfolding(spark):
    rows = [(1, 10, 5, "b", 2.0), (1, 10, 6, "a", 4.0), (1, None, 6, "a", 6.0), (1, 11, None, "b", None), (2, None, None, None, 1.0),
            (None, 12, 7, "c", 9.0)]
    t = spark.createDataFrame(rows, "merchant_id long, client_id long, card_id long, merchant_city string, amount_usd double")
    counts = {(r.merchant_id, r._col, r.client_id, r.card_id, r.merchant_city): r._n for r in A.value_counts(
        t, "merchant_id", ["client_id", "card_id", "merchant_city"]).collect()}
    assert counts == {(1, 0, 10, None, None): 2, (1, 0, 11, None, None): 1, (1, 1, None, 5, None): 1, (1, 1, None, 6, None): 2,
                      (1, 2, None, None, "a"): 2, (1, 2, None, None, "b"): 2}
    got = {r.merchant_id: (r.unique_customers, r.unique_cards, r.txn_count, r.merchant_city, r.amount_sum)
           for r in A.merchant_aggregate(t).collect()}
    assert got == {1: (2, 2, 4, "a", 12.0), 2: (0, 0, 1, None, 1.0)}
    sketched = {r.merchant_id: (r.unique_customers, r.merchant_city) for r in A.merchant_aggregate(t, approx_distinct=True).collect()}
    assert sketched == {1: (2, "a"), 2: (0, None)}
    assert A.merchant_aggregate(t.where("merchant_id = 9")).count() == 0


def test_value_counts_spread_a_hot_merchant_of_rows_dealt_by_merchant(spark):
    t = spark.range(2000).selectExpr("1L AS merchant_id", "id AS client_id", "id + 9 AS card_id", "'x' AS merchant_city").repartition(4, "merchant_id")
    counts = A.value_counts(t, "merchant_id", ["client_id", "card_id", "merchant_city"], {"merchant_city": F.pmod("client_id", F.lit(4))})
    held = [r["count"] for r in counts.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(held) == 4004 and max(held) < 2000  # 4000 pairs and four parts of the one city; one task held all before
    assert counts.where("_col = 2").agg(F.sum("_n")).first()[0] == 2000
    got = A.merchant_aggregate(t.withColumn("amount_usd", F.lit(1.0))).first()
    assert (got.unique_customers, got.unique_cards, got.txn_count, got.merchant_city) == (2000, 2000, 2000, "x")


def test_summaries_compute_their_transactions_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    t = spark.range(100).select("id", (F.col("id") % 7).alias("client_id"), F.col("id").alias("card_id"), (F.col("id") % 5).alias("merchant_id"),
                                F.lit(1).alias("mcc"), F.udf(counted, "double")(F.col("id").cast("double")).alias("amount_usd"), F.lit(0).alias("has_error"))
    assert {(r.section, r.metric): r.value for r in R.dataset_summary(t).collect()}["amount", "median"] == 49.5
    assert seen.value == 100
    cards = spark.createDataFrame([("YES",), ("no",)], "card_on_dark_web string")
    assert {(r.section, r.metric): r.value for r in R.dataset_summary_sql_style(t, cards).collect()}["transactions", "median_amount"] == 49.5
    assert seen.value == 200
