"""Named views over text-typed Parquet (the SQL-variant data model).

Each view is a projection made of the library's own column functions, so the views parse exactly as the rest
of the library does; Catalyst prunes unused columns and pushes the key filter into the scan.  The view and
column names are the interface.  Day of week is Monday=0 (D3); ``txn_dow_sun0`` keeps the Sunday=0 variant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.aggregates import sql_style_transactions


def _money(c: str):
    return C.parse_currency(c, dtype="double")


def users_view(raw: DataFrame) -> DataFrame:
    typed = {c: F.col(c).cast("int") for c in ("current_age", "retirement_age", "credit_score", "num_credit_cards")}
    typed |= {c: _money(c) for c in ("per_capita_income", "yearly_income", "total_debt")}
    return raw.withColumns(typed).select(F.col("id").cast("long").alias("user_id"), "gender", *typed)


def cards_view(raw: DataFrame) -> DataFrame:
    keys = {"card_id": F.col("id").cast("long"), "user_id": F.col("client_id").cast("long"),
            "credit_limit": _money("credit_limit")}
    return raw.select(*[v.alias(k) for k, v in keys.items()], "card_brand", "card_type", "has_chip", "card_on_dark_web")


def transactions_view(raw: DataFrame) -> DataFrame:
    """F1 applied; ``used_chip`` and ``has_error`` as ``sql_style_transactions`` derives them."""
    typed = raw.withColumns({"amount_usd": _money("amount"), "date": C.strict_timestamp("date")})
    parts = {"txn_year": F.year("date"), "txn_month": F.month("date"), "txn_hour": F.hour("date"),
             "txn_dow": C.weekday_mon0("date"), "txn_dow_sun0": C.weekday_sun0("date")}
    ids = {n: F.col(c).cast("long") for n, c in (("txn_id", "id"), ("user_id", "client_id"), ("card_id", "card_id"),
                                                 ("merchant_id", "merchant_id"))}
    return sql_style_transactions(typed).select(
        *[v.alias(k) for k, v in ids.items()], F.col("date").alias("txn_date"), *[v.alias(k) for k, v in parts.items()],
        F.col("amount_usd").alias("amount"), "used_chip", "merchant_city", "merchant_state",
        F.col("mcc").cast("int").alias("mcc"), "has_error", "errors")


def register_views(spark: SparkSession, users_path: str, cards_path: str, transactions_path: str) -> None:
    for name, path, view in (("users", users_path, users_view), ("cards", cards_path, cards_view),
                             ("transactions", transactions_path, transactions_view)):
        view(spark.read.parquet(path)).createOrReplaceTempView(name)
