"""Facades end to end: frame-style analysis with its report catalogue
and the SQL-variant analysis over named views (P8, S9, S11)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendlens.plans.analysis import SqlAnalysis, SpendAnalysis
from spendlens.sources import adapters as AD
from spendlens.sources import files as IO


@pytest.fixture(scope="module")
def cleaned(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cleaned")
    IO.write_table(AD.txn(spark, SF_SMALL), str(d / "transactions.parquet"))
    IO.write_table(AD.users(spark, SF_SMALL), str(d / "users.parquet"))
    IO.write_table(AD.cards(spark, SF_SMALL), str(d / "cards.parquet"))
    return str(d)


def test_spend_analysis_reports(spark, cleaned, tmp_path):
    ta = SpendAnalysis(spark, cleaned, city_coords=AD.city_coords(spark, SF_SMALL))
    status = {r["report"]: (r["status"], r["error"]) for r in ta.run_reports(str(tmp_path / "out")).collect()}
    assert all(s == "ok" for s, _ in status.values()), status
    assert {"amount_distribution", "correlation_heatmap", "us_merchant_map", "anomaly_scores",
            "demographic_age_bins", "credit_score_by_gender", "anomaly_share",
            "anomaly_amount_box", "anomaly_amount_density", "us_merchant_map_legend"} <= set(status)
    hist = spark.read.parquet(str(tmp_path / "out" / "amount_distribution"))
    assert hist.count() == 80
    again = {r["report"]: r["status"] for r in ta.run_reports(str(tmp_path / "out"), force=False).collect()}
    assert set(again.values()) == {"skipped"}


def test_spend_analysis_summary_and_top(spark, cleaned):
    ta = SpendAnalysis(spark, cleaned, materialize="cache")
    summ = {r["metric"]: r["value"] for r in ta.summary_statistics().collect()}
    assert summ["total_transactions"] == ta.transactions.count()
    top = ta.top_items(3)
    users = top["users"].collect()
    assert [r["rank"] for r in users] == [1, 2, 3]
    assert users[0]["txn_count"] == ta.user_agg.agg(F.max("txn_count")).first()[0]
    assert ta.risk_metrics.where("high_error_rate").count() > 0


def test_failed_report_is_isolated(spark, cleaned, tmp_path):
    ta = SpendAnalysis(spark, cleaned)
    ta.transactions = ta.transactions.drop("errors")  # top_errors must fail, the rest must not
    status = {r["report"]: r["status"] for r in ta.run_reports(str(tmp_path / "o"), only=[
        "top_errors", "time_patterns_hour"]).collect()}
    assert status == {"top_errors": "failed", "time_patterns_hour": "ok"}


@pytest.fixture(scope="module")
def text_tables(spark, tmp_path_factory):
    """Parquet with text money columns, as a CSV-to-Parquet conversion leaves them."""
    d = tmp_path_factory.mktemp("text")
    t = AD.txn(spark, SF_SMALL).select(
        F.col("transaction_id").alias("id"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
        "client_id", "card_id", F.concat(F.lit("$"), F.col("amount_usd").cast("decimal(12,2)").cast("string")).alias(
            "amount"), F.col("transaction_type").alias("use_chip"), "merchant_id", "merchant_city", "merchant_state",
        "mcc", "errors")
    u = AD.users(spark, SF_SMALL).select(
        "id", "current_age", "retirement_age", "gender", "credit_score", "num_credit_cards",
        *[F.format_string("$%.2f", F.col(c)).alias(c) for c in ("per_capita_income", "yearly_income", "total_debt")])
    c = AD.cards(spark, SF_SMALL).select(
        F.col("card_id").alias("id"), "client_id", F.lit("Visa").alias("card_brand"), F.lit("Debit").alias("card_type"),
        F.lit("YES").alias("has_chip"), F.when(F.col("card_on_dark_web"), "Yes").otherwise("No").alias(
            "card_on_dark_web"), F.format_string("$%.2f", F.col("credit_limit_usd")).alias("credit_limit"))
    for name, df in (("transactions", t), ("users", u), ("cards", c)):
        IO.write_table(df, str(d / f"{name}.parquet"))
    return str(d)


def test_sql_analysis(spark, text_tables):
    sa = SqlAnalysis(spark, f"{text_tables}/users.parquet", f"{text_tables}/cards.parquet",
                     f"{text_tables}/transactions.parquet")
    n_txn = spark.table("transactions").count()
    assert n_txn == AD.txn(spark, SF_SMALL).count()
    assert sa.monthly_transactions().agg(F.sum("txn_count")).first()[0] == n_txn
    pats = sa.patterns()
    assert pats["hourly"].agg(F.sum("txn_count")).first()[0] == n_txn and pats["daily"].count() == 7
    errs = sa.errors()
    assert errs["top_errors"].count() <= 10 and errs["dark_web"].agg(F.sum("pct")).first()[0] == pytest.approx(100)
    assert sa.score_by_gender().count() == 400
    corr = sa.correlations()
    assert corr.count() == 13 * 13
    an = sa.anomalies()
    summary = {r["metric"]: r["value"] for r in sa.summary(an).collect()}
    assert summary["total_transactions"] == n_txn
    assert summary["anomalous_pct"] == pytest.approx(2.0, abs=0.5)
    assert summary["unique_users"] == sa.user_agg.count()


def test_command_line_sql_analysis(spark, text_tables, tmp_path, capsys):
    import json

    from spendlens.__main__ import main

    out = tmp_path / "cli"
    assert main(["sql-analysis", f"{text_tables}/users.parquet", f"{text_tables}/cards.parquet",
                 f"{text_tables}/transactions.parquet", str(out)]) == 0
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["anomalous_pct"] == pytest.approx(2.0, abs=0.5) and summary["total_transactions"] > 0
