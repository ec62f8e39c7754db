"""Declared schemas of the raw files and of the cleaned tables.

Raw CSV columns that carry money, ZIP codes or dates arrive as text and are
typed by the preprocess stage; ids are LONG, small counts INT.
"""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
MONEY = T.DecimalType(12, 2)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_TRANSACTIONS = _st(
    ("id", L), ("date", S), ("client_id", L), ("card_id", L), ("amount", S), ("use_chip", S),
    ("merchant_id", L), ("merchant_city", S), ("merchant_state", S), ("zip", S), ("mcc", I), ("errors", S),
)

RAW_USERS = _st(
    ("id", L), ("current_age", I), ("retirement_age", I), ("birth_year", I), ("birth_month", I),
    ("gender", S), ("address", S), ("latitude", D), ("longitude", D), ("per_capita_income", S),
    ("yearly_income", S), ("total_debt", S), ("credit_score", I), ("num_credit_cards", I),
)

RAW_CARDS = _st(
    ("id", L), ("client_id", L), ("card_brand", S), ("card_type", S), ("card_number", S), ("expires", S),
    ("cvv", I), ("has_chip", S), ("num_cards_issued", I), ("credit_limit", S), ("acct_open_date", S),
    ("year_pin_last_changed", I), ("card_on_dark_web", S),
)

CLEAN_TRANSACTIONS = _st(
    ("transaction_id", L), ("date", T.TimestampNTZType()), ("client_id", L), ("card_id", L),
    ("amount_usd", MONEY), ("transaction_type", S), ("merchant_id", L), ("merchant_city", S),
    ("merchant_state", S), ("zip", S), ("mcc", I), ("errors", S),
)

CLEAN_USERS = _st(
    ("id", L), ("retirement_age", I), ("birth_date", T.DateType()), ("gender", S),
    ("per_capita_income_usd", MONEY), ("yearly_income_usd", MONEY), ("total_debt_usd", MONEY),
    ("credit_score", I), ("num_credit_cards", I),
)

CLEAN_CARDS = _st(
    ("card_id", L), ("client_id", L), ("card_brand", S), ("card_type", S), ("card_number", S),
    ("expires", T.DateType()), ("cvv", I), ("has_chip", B), ("num_cards_issued", I),
    ("credit_limit_usd", MONEY), ("acct_open_date", T.DateType()), ("year_pin_last_changed", I),
    ("card_on_dark_web", B),
)

MCC_CODES = _st(("id", I), ("description", S))
FRAUD_LABELS = _st(("id", L), ("fraud", B))
CITY_COORDS = _st(("city_state", S), ("lat", D), ("lon", D))
