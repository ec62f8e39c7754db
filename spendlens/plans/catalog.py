"""Registered queries: one per operator of SURVEY §2, each with its SQL twin.

Every query reads the driver tables at ``sf_dir`` through the adapters in
``spendlens.sources.adapters`` and runs the library operator over the whole
tables.  ``ORACLE[name]`` is the equivalent DuckDB SQL; operators that SQL
cannot express (PCA, k-means and other clusterings) register no SQL; what must
hold of any right fit is registered beside them with SQL.

Floating outputs that two engines legitimately round differently (standard
deviations, medians, correlations, densities) are rounded to fixed decimals
on both sides; money sums and means are exact and are not rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..session import materialize
from ..sources import adapters as AD
from . import oracle_sql as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


STD6 = {"amount_std": 6, "amount_median": 6}
# Columns each family of queries reads: the adapter joins only the dimensions these need.
USER_COLS = ["client_id", "amount_usd", "date", "merchant_id", "errors", "transaction_type"]
SQL_STYLE_COLS = ["client_id", "card_id", "amount_usd", "date", "errors", "transaction_type"]

# ---------------------------------------------------------------- aggregates

USER_AGG_SQL = O.with_(["txn"], f"""
SELECT client_id AS user_id,
       {O.msum('amount_usd')} AS amount_sum,
       {O.mmean('amount_usd')} AS amount_mean,
       {O.mstd('amount_usd')} AS amount_std,
       round(median(amount_usd), 6) AS amount_median,
       min(amount_usd) AS amount_min, max(amount_usd) AS amount_max,
       min(date) AS first_txn_date, max(date) AS last_txn_date,
       count(*) AS txn_count,
       date_sub('day', min(date), max(date)) AS txn_span_days,
       count(*) / (date_sub('day', min(date), max(date)) + 1) AS txn_frequency,
       (CAST(count(errors) AS DOUBLE) / count(*)) * 100 AS error_rate_pct,
       (CAST(count_if(coalesce(contains(lower(transaction_type), 'chip'), false)) AS DOUBLE) / count(*)) * 100
           AS chip_usage_pct,
       count(DISTINCT merchant_id) AS unique_merchants
FROM txn WHERE client_id IS NOT NULL
GROUP BY client_id""")


@register("user_agg", USER_AGG_SQL)
def q_user_agg(spark: SparkSession, d: str) -> DataFrame:
    """G1, G6, G7, G8, C12, C13, C20, C21, J1."""
    return rounded(A.user_aggregate(AD.txn(spark, d, USER_COLS)), STD6)


def _user_agg_body(rnd: bool = True) -> str:
    std = O.mstd("amount_usd") if rnd else "stddev_samp(amount_usd)"
    med = "round(median(amount_usd), 6)" if rnd else "median(amount_usd)"
    return f"""
SELECT client_id AS user_id,
       coalesce({O.msum('amount_usd')}, 0) AS amount_sum, {O.mmean('amount_usd')} AS amount_mean,
       {std} AS amount_std, {med} AS amount_median,
       min(amount_usd) AS amount_min, max(amount_usd) AS amount_max,
       min(date) AS first_txn_date, max(date) AS last_txn_date, count(*) AS txn_count,
       date_sub('day', min(date), max(date)) AS txn_span_days,
       count(*) / (date_sub('day', min(date), max(date)) + 1) AS txn_frequency,
       (CAST(count(errors) AS DOUBLE) / count(*)) * 100 AS error_rate_pct,
       (CAST(count_if(coalesce(contains(lower(transaction_type), 'chip'), false)) AS DOUBLE) / count(*)) * 100
           AS chip_usage_pct,
       count(DISTINCT merchant_id) AS unique_merchants
FROM txn WHERE client_id IS NOT NULL GROUP BY client_id"""


CARD_AGG_BODY = f"""
SELECT client_id AS user_id, {O.mmean('credit_limit_usd')} AS avg_credit_limit, count(*) AS num_cards
FROM cards WHERE client_id IS NOT NULL GROUP BY client_id"""


def _enriched_body(rnd: bool = True) -> str:
    return f"""
SELECT ua.*, u.current_age, u.gender, u.credit_score, u.per_capita_income, u.yearly_income, u.total_debt,
       u.num_credit_cards, ca.avg_credit_limit, ca.num_cards
FROM ({_user_agg_body(rnd)}) ua
LEFT JOIN users u ON ua.user_id = u.id
LEFT JOIN ({CARD_AGG_BODY}) ca ON ua.user_id = ca.user_id"""


def enriched_user_agg(spark: SparkSession, d: str) -> DataFrame:
    return A.user_aggregate(AD.txn(spark, d, USER_COLS), AD.users(spark, d), AD.cards(spark, d))


@register("user_agg_enriched", O.with_(["txn", "users", "cards"], _enriched_body()))
def q_user_agg_enriched(spark, d):
    """G1 + J2 + J3 + G9."""
    return rounded(enriched_user_agg(spark, d), STD6)


@register("daily_agg", O.with_(["txn"], f"""
SELECT CAST(date AS DATE) AS date, count(*) AS txn_count,
       coalesce({O.msum('amount_usd')}, 0) AS amount_sum, {O.mmean('amount_usd')} AS amount_mean,
       {O.mstd('amount_usd')} AS amount_std,
       (CAST(count(errors) AS DOUBLE) / count(*)) * 100 AS error_rate_pct
FROM txn WHERE date IS NOT NULL GROUP BY CAST(date AS DATE)"""))
def q_daily_agg(spark, d):
    """G2, C8."""
    return rounded(A.daily_aggregate(AD.txn(spark, d, ["date", "amount_usd", "errors"])), STD6)


MODE_CITY_BODY = """
SELECT merchant_id, merchant_city FROM (
  SELECT merchant_id, merchant_city,
         row_number() OVER (PARTITION BY merchant_id ORDER BY n DESC, merchant_city) AS rn
  FROM (SELECT merchant_id, merchant_city, count(*) AS n FROM txn
        WHERE merchant_id IS NOT NULL AND merchant_city IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1"""

MERCHANT_BODY = f"""
SELECT m.*, c.merchant_city FROM (
  SELECT merchant_id, coalesce({O.msum('amount_usd')}, 0) AS amount_sum, {O.mmean('amount_usd')} AS amount_mean,
         {O.mstd('amount_usd')} AS amount_std, count(DISTINCT client_id) AS unique_customers,
         count(DISTINCT card_id) AS unique_cards, count(*) AS txn_count
  FROM txn WHERE merchant_id IS NOT NULL GROUP BY merchant_id) m
LEFT JOIN ({MODE_CITY_BODY}) c ON m.merchant_id = c.merchant_id"""

MERCHANT_COLS = ["merchant_id", "client_id", "card_id", "amount_usd", "merchant_city"]


@register("merchant_agg", O.with_(["txn"], MERCHANT_BODY))
def q_merchant_agg(spark, d):
    """G3 (+G4 folded), G8."""
    return rounded(A.merchant_aggregate(AD.txn(spark, d, MERCHANT_COLS)), STD6)


@register("merchant_mode_city", O.with_(["txn"], MODE_CITY_BODY))
def q_merchant_mode_city(spark, d):
    """Most frequent city per merchant, ties to the smallest name."""
    return A.mode_per_group(AD.txn(spark, d, ["merchant_id", "merchant_city"]), "merchant_id", "merchant_city")


MCC_BODY = f"""
SELECT mcc, coalesce({O.msum('amount_usd')}, 0) AS amount_sum, {O.mmean('amount_usd')} AS amount_mean,
       {O.mstd('amount_usd')} AS amount_std, count(DISTINCT client_id) AS unique_customers, count(*) AS txn_count
FROM txn WHERE mcc IS NOT NULL GROUP BY mcc"""


@register("mcc_agg", O.with_(["txn"], MCC_BODY))
def q_mcc_agg(spark, d):
    """G5."""
    return rounded(A.mcc_aggregate(AD.txn(spark, d, ["mcc", "client_id", "amount_usd"])), STD6)


@register("card_agg", O.with_(["cards"], CARD_AGG_BODY))
def q_card_agg(spark, d):
    """G9 (J4 folded)."""
    return A.card_aggregate(AD.cards(spark, d))


@register("risk_metrics", O.with_(["txn", "users", "cards"], f"""
, e AS ({_enriched_body(False)}),
q AS (SELECT quantile_cont(error_rate_pct, 0.75) AS q75 FROM e)
SELECT e.* EXCLUDE (amount_std, amount_median), round(e.amount_std, 6) AS amount_std,
       round(e.amount_median, 6) AS amount_median,
       round(coalesce(e.amount_std / (e.amount_mean + 1e-6), 0), 6) AS amount_volatility,
       coalesce(e.total_debt / (e.yearly_income + 1e-6), 0) AS debt_to_income,
       coalesce(e.num_cards, 0) AS cards_per_user,
       coalesce(e.error_rate_pct > q.q75, false) AS high_error_rate,
       coalesce(e.current_age > 65, false) AS is_senior
FROM e, q""".replace("\n, e AS", ", e AS", 1)))
def q_risk_metrics(spark, d):
    """G10, G11, C22, C24, C25."""
    # two passes over the user table (q75, then the flags): compute it once
    return rounded(A.risk_metrics(materialize(enriched_user_agg(spark, d))), {**STD6, "amount_volatility": 6})


SQL_STYLE_BODY = """
, keyed AS (SELECT client_id, card_id, CAST(amount_usd AS DECIMAL(18,6)) AS amount,
                   contains(lower(transaction_type), 'chip') AS chip, errors IS NOT NULL AS failed
            FROM txn
            WHERE client_id IS NOT NULL AND card_id IS NOT NULL AND amount_usd IS NOT NULL AND date IS NOT NULL),
t AS (SELECT amount AS amount_usd, CAST(failed AS INT) AS has_error FROM keyed),
per_card AS (SELECT client_id, card_id, count(*) AS n, sum(amount) AS total, count_if(failed) AS fails, count_if(chip) AS chips
             FROM keyed GROUP BY client_id, card_id),
per_user AS (
SELECT p.client_id, sum(p.n) AS n, sum(p.total) AS total, sum(p.fails) AS fails, sum(p.chips) AS chips,
       sum(CAST(c.credit_limit_usd AS DECIMAL(18,6)) * p.n) AS limits, bool_or(c.card_on_dark_web) AS dark
FROM per_card p JOIN cards c ON c.card_id = p.card_id AND c.client_id = p.client_id GROUP BY p.client_id),
ub AS (
SELECT p.client_id AS user_id, CAST(p.n AS BIGINT) AS txn_count, CAST(p.total AS DOUBLE) / p.n AS avg_amount,
       CAST(p.fails AS BIGINT) AS total_errors, CAST(p.chips AS DOUBLE) / p.n AS chip_ratio,
       u.credit_score, u.yearly_income, u.total_debt, u.per_capita_income, u.num_credit_cards, u.current_age,
       u.retirement_age, CAST(p.limits AS DOUBLE) / p.n AS txn_weighted_credit_limit,
       CASE WHEN p.dark THEN 1 ELSE 0 END AS has_dark_web_card
FROM per_user p JOIN users u ON u.id = p.client_id)"""


def _with_sql_style(body: str) -> str:
    return O.with_(["txn", "users", "cards"], body).replace(")\n, keyed AS", "),\nkeyed AS", 1)


def sql_style_user_agg(spark, d):
    return A.user_aggregate_inner(AD.txn(spark, d, SQL_STYLE_COLS), AD.users(spark, d), AD.cards(spark, d))


@register("user_agg_sql_style", _with_sql_style(SQL_STYLE_BODY + "\nSELECT * FROM ub"))
def q_user_agg_sql_style(spark, d):
    """G20, J5, G7b, F1, D5."""
    return sql_style_user_agg(spark, d)


# ---------------------------------------------------------------- reports

from ..operators import reports as R  # noqa: E402

SUMMARY_METRICS = [
    ("transactions", "total_transactions", "CAST(count(*) AS DOUBLE)"),
    ("transactions", "unique_users", "CAST(count(DISTINCT client_id) AS DOUBLE)"),
    ("transactions", "unique_cards", "CAST(count(DISTINCT card_id) AS DOUBLE)"),
    ("amount", "mean", O.mmean("amount_usd")),
    ("amount", "median", "median(amount_usd)"),
    ("amount", "std", "stddev_samp(amount_usd)"),
    ("amount", "min", "min(amount_usd)"),
    ("amount", "max", "max(amount_usd)"),
    ("merchants", "unique_merchants", "CAST(count(DISTINCT merchant_id) AS DOUBLE)"),
    ("mcc", "unique_mcc", "CAST(count(DISTINCT mcc) AS DOUBLE)"),
]


def _summary_sql() -> str:
    parts = [f"SELECT '{s}' AS section, '{m}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM txn"
             for s, m, e in SUMMARY_METRICS]
    pu = "(SELECT client_id, count(*) AS n FROM txn WHERE client_id IS NOT NULL GROUP BY client_id)"
    parts += [
        f"SELECT 'users', 'total_users', round(CAST(count(*) AS DOUBLE), 6) FROM {pu}",
        f"SELECT 'users', 'avg_txns_per_user', round(avg(n), 6) FROM {pu}",
        f"SELECT 'users', 'median_txns_per_user', round(CAST(median(n) AS DOUBLE), 6) FROM {pu}",
        f"SELECT 'users', 'max_txns_per_user', round(CAST(max(n) AS DOUBLE), 6) FROM {pu}",
        "SELECT 'merchants', 'top_merchant_txn_count', round(CAST(max(n) AS DOUBLE), 6) FROM "
        "(SELECT merchant_id, count(*) AS n FROM txn WHERE merchant_id IS NOT NULL GROUP BY 1)",
        "SELECT 'mcc', 'top_mcc_txn_count', round(CAST(max(n) AS DOUBLE), 6) FROM "
        "(SELECT mcc, count(*) AS n FROM txn WHERE mcc IS NOT NULL GROUP BY 1)",
    ]
    return O.with_(["txn"], "\nUNION ALL\n".join(parts))


@register("dataset_summary", _summary_sql())
def q_dataset_summary(spark, d):
    """G12 (print_summary_statistics as a table)."""
    cols = ["client_id", "card_id", "merchant_id", "mcc", "amount_usd"]
    return rounded(R.dataset_summary(AD.txn(spark, d, cols)), {"value": 6})


@register("dataset_summary_sql_style", _with_sql_style(SQL_STYLE_BODY + """
SELECT 'transactions' AS section, 'total_transactions' AS metric, round(CAST(count(*) AS DOUBLE), 6) AS value FROM t
UNION ALL SELECT 'transactions', 'avg_amount', round(CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE)
                 / count(amount_usd), 6) FROM t
UNION ALL SELECT 'transactions', 'median_amount', round(median(amount_usd), 6) FROM t
UNION ALL SELECT 'errors', 'transactions_with_error', round(CAST(sum(has_error) AS DOUBLE), 6) FROM t
UNION ALL SELECT 'errors', 'error_pct', round(avg(has_error) * 100.0, 6) FROM t
UNION ALL SELECT 'cards', 'cards_on_dark_web', round(CAST(count(*) AS DOUBLE), 6) FROM cards WHERE card_on_dark_web
UNION ALL SELECT 'users', 'unique_users', round(CAST(count(DISTINCT user_id) AS DOUBLE), 6) FROM ub"""))
def q_dataset_summary_sql_style(spark, d):
    """G13, F7, G35 (summary() without the optional anomaly rows)."""
    t = A.sql_style_transactions(AD.txn(spark, d, SQL_STYLE_COLS))
    return rounded(R.dataset_summary_sql_style(t, AD.cards(spark, d), sql_style_user_agg(spark, d)), {"value": 6})


@register("monthly_volume", O.with_(["txn"], f"""
SELECT CAST(date_trunc('month', date) AS DATE) AS period, count(transaction_id) AS txn_count,
       {O.mmean('amount_usd')} AS avg_amount
FROM txn WHERE date IS NOT NULL GROUP BY 1"""))
def q_monthly_volume(spark, d):
    """G14, C17."""
    return R.monthly_volume(AD.txn(spark, d, ["transaction_id", "date", "amount_usd"]))


@register("monthly_median", O.with_(["txn"], f"""
SELECT CAST(year(date) AS INT) AS txn_year, CAST(month(date) AS INT) AS txn_month, count(*) AS txn_count,
       {O.mmean('amount_usd')} AS avg_amount, round(median(amount_usd), 6) AS median_amount,
       make_date(CAST(year(date) AS INT), CAST(month(date) AS INT), 1) AS period
FROM txn GROUP BY 1, 2"""))
def q_monthly_median(spark, d):
    """G15, C14, C18."""
    return rounded(R.monthly_median(AD.txn(spark, d, ["date", "amount_usd"])), {"median_amount": 6})


@register("hour_counts", O.with_(["event_txn"], """
SELECT CAST(hour(date) AS INT) AS txn_hour, count(*) AS txn_count FROM event_txn WHERE date IS NOT NULL GROUP BY 1"""))
def q_hour_counts(spark, d):
    """G16 (by hour)."""
    return R.hour_counts(AD.event_txn(spark, d))


@register("weekday_counts", O.with_(["event_txn"], """
SELECT CAST(isodow(date) - 1 AS INT) AS txn_dow, count(*) AS txn_count,
       (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[isodow(date)] AS dow_label
FROM event_txn WHERE date IS NOT NULL GROUP BY 1, 3"""))
def q_weekday_counts(spark, d):
    """G16 (by weekday), C15, C16."""
    return R.weekday_counts(AD.event_txn(spark, d))


@register("hour_weekday_table", O.with_(["event_txn"], f"""
SELECT CAST(hour(date) AS INT) AS txn_hour, CAST(isodow(date) - 1 AS INT) AS txn_dow, count(*) AS txn_count,
       {O.mmean('amount_usd')} AS avg_amount,
       CAST(sum(CASE WHEN errors IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS error_count
FROM event_txn GROUP BY 1, 2"""))
def q_hour_weekday_table(spark, d):
    """G17 base table."""
    return R.hour_weekday_table(AD.event_txn(spark, d))


@register("hour_rollup", O.with_(["event_txn"], """
SELECT CAST(hour(date) AS INT) AS txn_hour, CAST(count(*) AS BIGINT) AS txn_count FROM event_txn GROUP BY 1"""))
def q_hour_rollup(spark, d):
    """G17 second level: hour x weekday counts re-summed per hour."""
    return R.rollup_counts(R.hour_weekday_table(AD.event_txn(spark, d)), "txn_hour")


@register("weekday_rollup", O.with_(["event_txn"], """
SELECT CAST(isodow(date) - 1 AS INT) AS txn_dow, CAST(count(*) AS BIGINT) AS txn_count FROM event_txn GROUP BY 1"""))
def q_weekday_rollup(spark, d):
    """G17 second level: hour x weekday counts re-summed per weekday."""
    return R.rollup_counts(R.hour_weekday_table(AD.event_txn(spark, d)), "txn_dow")


@register("time_patterns", O.with_(["event_txn"], """
SELECT CASE WHEN grouping(txn_hour) = 0 THEN 'hour' ELSE 'weekday' END AS pattern, txn_hour, txn_dow,
       count(*) AS txn_count
FROM (SELECT CAST(hour(date) AS INT) AS txn_hour, CAST(isodow(date) - 1 AS INT) AS txn_dow
      FROM event_txn WHERE date IS NOT NULL)
GROUP BY GROUPING SETS ((txn_hour), (txn_dow))"""))
def q_time_patterns(spark, d):
    """G16 as one scan with GROUPING SETS."""
    return R.time_patterns(AD.event_txn(spark, d))


@register("top_errors", O.with_(["txn"], """
SELECT errors, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, errors) AS INT) AS rank
FROM txn WHERE errors IS NOT NULL GROUP BY errors ORDER BY n DESC, errors LIMIT 10"""))
def q_top_errors(spark, d):
    """G18, K4, F5."""
    return R.top_errors(AD.txn(spark, d, ["errors"]))


@register("top_error", O.with_(["txn"], """
SELECT errors, count(*) AS n, CAST(1 AS INT) AS rank
FROM txn WHERE errors IS NOT NULL GROUP BY errors ORDER BY n DESC, errors LIMIT 1"""))
def q_top_error(spark, d):
    """K4 with a limit below the number of texts."""
    return R.top_errors(AD.txn(spark, d, ["errors"]), 1)


@register("dark_web_share", O.with_(["cards"], """
SELECT card_on_dark_web, count(*) AS n, CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER () AS pct
FROM cards GROUP BY 1"""))
def q_dark_web_share(spark, d):
    """G19, C31."""
    return R.dark_web_share(AD.cards(spark, d))


@register("top_merchants", O.with_(["txn"], f"""
SELECT merchant_id, count(*) AS txn_count, {O.mmean('amount_usd')} AS amount_mean,
       CAST(row_number() OVER (ORDER BY count(*) DESC, merchant_id) AS INT) AS rank
FROM txn WHERE merchant_id IS NOT NULL GROUP BY merchant_id ORDER BY txn_count DESC, merchant_id LIMIT 15"""))
def q_top_merchants(spark, d):
    """K1, K2, K6 (plot_top_merchants, top_n=15)."""
    m = A.merchant_aggregate(AD.txn(spark, d, ["merchant_id", "client_id", "card_id", "amount_usd"]))
    return R.top_n(m, "txn_count", "merchant_id", 15).select("merchant_id", "txn_count", "amount_mean", "rank")


@register("top_mcc", O.with_(["txn"], """
SELECT mcc, count(*) AS txn_count, count(DISTINCT client_id) AS unique_customers,
       CAST(row_number() OVER (ORDER BY count(*) DESC, mcc) AS INT) AS rank
FROM txn WHERE mcc IS NOT NULL GROUP BY mcc ORDER BY txn_count DESC, mcc LIMIT 15"""))
def q_top_mcc(spark, d):
    """K1, K2, K6 (plot_top_mcc, top_n=15)."""
    m = A.mcc_aggregate(AD.txn(spark, d, ["mcc", "client_id", "amount_usd"]))
    return R.top_n(m, "txn_count", "mcc", 15).select("mcc", "txn_count", "unique_customers", "rank")


@register("top_users", O.with_(["txn"], f"""
SELECT client_id AS user_id, count(*) AS txn_count, coalesce({O.msum('amount_usd')}, 0) AS amount_sum,
       CAST(row_number() OVER (ORDER BY count(*) DESC, client_id) AS INT) AS rank
FROM txn WHERE client_id IS NOT NULL GROUP BY client_id ORDER BY txn_count DESC, user_id LIMIT 10"""))
def q_top_users(spark, d):
    """K1, K2, K6 (print_top_items n=10, users)."""
    t = AD.txn(spark, d, ["client_id", "amount_usd"])
    g = t.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("txn_count"), C.exact_sum("amount_usd").alias("_s"))
    g = g.select(F.col("client_id").alias("user_id"), "txn_count", F.coalesce(C.money("_s"), F.lit(0.0)).alias(
        "amount_sum"))
    return R.top_n(g, "txn_count", "user_id", 10)


# ---------------------------------------------------------------- statistics

from ..operators import geo as G  # noqa: E402
from ..operators import stats as ST  # noqa: E402


def _hist_sql(src: str, x: str, bins: int, col_name: str | None = None) -> str:
    """NumPy histogram in SQL: bin by floor + edge corrections, all bins present."""
    step = f"((b.hi - b.lo) / {float(bins)})"

    def edge(i: str) -> str:
        return f"(CASE WHEN {i} >= {bins} THEN b.hi ELSE CAST({i} AS DOUBLE) * {step} + b.lo END)"

    label = f"'{col_name}' AS feature, " if col_name else ""
    return f"""(
WITH v AS (SELECT CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE))),
b0 AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
      FROM b0),
i0 AS (SELECT x, least(CAST(trunc((x - b.lo) / (b.hi - b.lo) * {float(bins)}) AS INT), {bins - 1}) AS i FROM v, b),
i1 AS (SELECT x, CASE WHEN x < {edge('i')} THEN i - 1 ELSE i END AS i FROM i0, b),
i2 AS (SELECT CASE WHEN x >= {edge('(i + 1)')} AND i <> {bins - 1} THEN i + 1 ELSE i END AS bin FROM i1, b),
c AS (SELECT bin, count(*) AS n FROM i2 GROUP BY bin)
SELECT {label}CAST(g.bin AS INT) AS bin, CAST(g.bin AS DOUBLE) * {step} + b.lo AS lo,
       CASE WHEN g.bin = {bins - 1} THEN b.hi ELSE CAST(g.bin + 1 AS DOUBLE) * {step} + b.lo END AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS frequency
FROM (SELECT range AS bin FROM range({bins})) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin)"""


@register("amount_histogram", O.with_(["txn"], "SELECT * FROM " + _hist_sql(
    "(SELECT amount_usd FROM txn WHERE amount_usd > 0)", "amount_usd", 80)))
def q_amount_histogram(spark, d):
    """G22, F2 (80 equal-width bins of positive amounts)."""
    return ST.histogram(AD.txn(spark, d, ["amount_usd"]), "amount_usd", 80, positive=True)


@register("log_amount_histogram", O.with_(["txn"], """
SELECT bin, round(lo, 9) AS lo, round(hi, 9) AS hi, frequency FROM """ + _hist_sql(
    "(SELECT ln(1 + amount_usd) AS la FROM txn WHERE amount_usd > 0)", "la", 80)))
def q_log_amount_histogram(spark, d):
    """G22, C19, D20 (bins in log(1+x) space)."""
    h = ST.histogram(AD.txn(spark, d, ["amount_usd"]), "amount_usd", 80, positive=True, log1p=True)
    return rounded(h, {"lo": 9, "hi": 9})


USER_HIST_COLS = ["txn_count", "amount_sum", "amount_mean", "txn_frequency"]


@register("user_histograms", O.with_(["txn"], ", ua AS (" + _user_agg_body() + ")\n" + "\nUNION ALL\n".join(
    f"SELECT feature, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, frequency FROM {_hist_sql('ua', c, 50, c)}"
    for c in USER_HIST_COLS)).replace(")\n, ua AS", "),\nua AS", 1))
def q_user_histograms(spark, d):
    """Four 50-bin histograms of the user aggregate in one pass."""
    ua = materialize(A.user_aggregate(AD.txn(spark, d, ["client_id", "amount_usd", "date", "merchant_id"])))
    return rounded(ST.histograms(ua, USER_HIST_COLS, 50), {"lo": 6, "hi": 6})


@register("credit_score_kde", O.with_(["users"], """
, v AS (SELECT gender, CAST(credit_score AS DOUBLE) AS x FROM users WHERE credit_score IS NOT NULL AND gender IS NOT NULL),
s AS (SELECT gender, count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v GROUP BY gender),
k AS (SELECT gender, n, sqrt(sd * sd * pow(CAST(n AS DOUBLE), -0.2) * pow(CAST(n AS DOUBLE), -0.2)) AS bw, mn, mx
      FROM s),
g AS (SELECT gender, n, bw, CAST(p.range AS INT) AS point,
             CASE WHEN p.range = 199 THEN mx + bw * 3.0
                  ELSE CAST(p.range AS DOUBLE) * ((mx + bw * 3.0 - (mn - bw * 3.0)) / 199.0) + (mn - bw * 3.0) END AS x
      FROM k, range(200) p WHERE bw > 0)
SELECT g.gender, g.point, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * ((g.x - v.x) / g.bw) * ((g.x - v.x) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())), 10)
           AS density
FROM g JOIN v ON g.gender = v.gender GROUP BY g.gender, g.point, g.x, g.n, g.bw""".replace("\n, v AS", ", v AS", 1)))
def q_credit_score_kde(spark, d):
    """Credit-score density per gender on a 200-point grid."""
    u = AD.users(spark, d).where(F.col("credit_score").isNotNull())
    return rounded(ST.kde(u, "credit_score", "gender"), {"x": 6, "density": 10})


DENSITY_ERROR = 1e-4


@register("amount_density", O.with_(["txn"], f"""
, v AS (SELECT transaction_type AS g, CAST(amount_usd AS DOUBLE) AS v FROM txn WHERE amount_usd IS NOT NULL AND transaction_type IS NOT NULL),
s AS (SELECT g, n, sqrt(sd * sd * pow(CAST(n AS DOUBLE), -0.2) * pow(CAST(n AS DOUBLE), -0.2)) AS bw, mn, mx
      FROM (SELECT g, count(*) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx FROM v GROUP BY g)),
c AS (SELECT g, k, sum(1 - (q - k)) AS l, sum(q - k) AS r
      FROM (SELECT v.g, (v.v - s.mn) / (s.bw * sqrt(8 * {DENSITY_ERROR})) AS q,
                   floor((v.v - s.mn) / (s.bw * sqrt(8 * {DENSITY_ERROR}))) AS k FROM v JOIN s ON v.g = s.g WHERE s.bw > 0) GROUP BY g, k),
m AS (SELECT g, k, sum(w) AS w FROM (SELECT g, k, l AS w FROM c UNION ALL SELECT g, k + 1, r FROM c) GROUP BY g, k),
p AS (SELECT g, n, bw, mn, CAST(r.range AS INT) AS point,
             CAST(r.range AS DOUBLE) * ((mx + bw * 3.0 - (mn - bw * 3.0)) / 199.0) + (mn - bw * 3.0) AS x FROM s, range(200) r WHERE bw > 0)
SELECT p.g AS transaction_type, p.point, round(p.x, 6) AS x,
       round(sum(m.w * exp(-0.5 * ((p.x - (p.mn + m.k * (p.bw * sqrt(8 * {DENSITY_ERROR})))) / p.bw)
                                * ((p.x - (p.mn + m.k * (p.bw * sqrt(8 * {DENSITY_ERROR})))) / p.bw)))
             / (p.n * p.bw * sqrt(2 * pi())), 10) AS density
FROM p JOIN m ON p.g = m.g GROUP BY p.g, p.point, p.x, p.n, p.bw""".replace("\n, v AS", ", v AS", 1)))
def q_amount_density(spark, d):
    """Density of all amounts per transaction type, binned: the work is rows + bins."""
    t = AD.txn(spark, d, ["amount_usd", "transaction_type"])
    return rounded(ST.kde(t, "amount_usd", "transaction_type", error=DENSITY_ERROR), {"x": 6, "density": 10})


CORR_COLS = ["amount_sum", "amount_mean", "amount_median", "amount_std", "amount_min", "amount_max", "txn_count",
             "txn_span_days", "txn_frequency", "error_rate_pct", "chip_usage_pct", "unique_merchants", "current_age",
             "credit_score", "per_capita_income", "yearly_income", "total_debt", "num_credit_cards",
             "avg_credit_limit", "num_cards"]


def _corr_sql(src: str, cols: list[str]) -> str:
    """Pairwise-complete Pearson; a column that is constant (to 1e-10 relative) on the pair's rows gives NULL."""
    def const(a: str, b: str) -> str:
        m = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
        return f"(count({m}) = 0 OR stddev_pop({m}) <= 1e-10 * abs(avg({m})) OR stddev_pop({m}) = 0)"

    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                r = f"CASE WHEN {const(a, a)} THEN NULL ELSE 1.0 END"
                n = f"count({a})"
            else:
                r = f"CASE WHEN {const(a, b)} OR {const(b, a)} THEN NULL ELSE round(corr({a}, {b}), 9) END"
                n = f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({r} AS DOUBLE) AS r, {n} AS n FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("correlation_matrix", O.with_(["txn", "users", "cards"], ", e AS (" + _enriched_body(False) + ")\n"
                                        + _corr_sql("e", CORR_COLS)).replace(")\n, e AS", "),\ne AS", 1))
def q_correlation_matrix(spark, d):
    """Pairwise-complete Pearson over the numeric user features."""
    ua = enriched_user_agg(spark, d)
    return rounded(ST.correlation(ua, ST.numeric_columns(ua)), {"r": 9})


SELECTED_COLS = ST.SELECTED_FEATURES


@register("correlation_selected", _with_sql_style(SQL_STYLE_BODY + """,
f AS (SELECT *, total_debt / CASE WHEN yearly_income <> 0 THEN yearly_income END AS debt_to_income,
             yearly_income / CASE WHEN num_credit_cards <> 0 THEN num_credit_cards END AS income_per_card FROM ub)
""" + _corr_sql("f", SELECTED_COLS)))
def q_correlation_selected(spark, d):
    """Correlation of 13 named features incl. two derived ratios."""
    from ..functions import columns as C

    ub = sql_style_user_agg(spark, d).withColumns({
        "debt_to_income": C.nullif_ratio("total_debt", "yearly_income"),
        "income_per_card": C.nullif_ratio("yearly_income", "num_credit_cards"),
    })
    return rounded(ST.correlation(ub, SELECTED_COLS), {"r": 9})


@register("gender_mean", O.with_(["txn", "users", "cards"], f"""
SELECT gender, avg(txn_count) AS mean_txn_count FROM ({_enriched_body()}) WHERE gender IS NOT NULL GROUP BY gender"""))
def q_gender_mean(spark, d):
    """G28."""
    return R.gender_mean(enriched_user_agg(spark, d))


@register("cards_mean_spend", O.with_(["txn", "users", "cards"], f"""
SELECT num_credit_cards, {O.mmean('amount_sum')} AS mean_amount_sum FROM ({_enriched_body()})
WHERE num_credit_cards IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 10"""))
def q_cards_mean_spend(spark, d):
    """G30, K5."""
    return R.cards_mean_spend(enriched_user_agg(spark, d))


@register("fewest_cards_mean_spend", O.with_(["txn", "users", "cards"], f"""
SELECT num_credit_cards, {O.mmean('amount_sum')} AS mean_amount_sum FROM ({_enriched_body()})
WHERE num_credit_cards IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 4"""))
def q_fewest_cards_mean_spend(spark, d):
    """G30, K5 with a limit below the number of keys."""
    return R.cards_mean_spend(enriched_user_agg(spark, d), 4)


def _cut_sql(src: str, by: str, value: str, bins: int) -> str:
    interior = " + ".join(
        f"CASE WHEN CAST({i} AS DOUBLE) * ((b.hi - b.lo) / {float(bins)}) + b.lo < x THEN 1 ELSE 0 END"
        for i in range(1, bins))
    return f"""
, v AS (SELECT CAST({by} AS DOUBLE) AS x, CAST({value} AS DOUBLE) AS y FROM {src} WHERE {by} IS NOT NULL),
b0 AS (SELECT min(x) AS mn, max(x) AS mx FROM v),
b AS (SELECT CASE WHEN mn = mx THEN mn - (CASE WHEN mn <> 0 THEN abs(mn) * 0.001 ELSE 0.001 END) ELSE mn END AS lo,
             CASE WHEN mn = mx THEN mx + (CASE WHEN mn <> 0 THEN abs(mn) * 0.001 ELSE 0.001 END) ELSE mx END AS hi,
             mn = mx AS same, (mx - mn) * 0.001 AS adj FROM b0),
k AS (SELECT ({interior}) AS bin, y FROM v, b)
SELECT CAST(k.bin AS INT) AS bin,
       round(CASE WHEN k.bin = 0 AND NOT b.same THEN b.lo - b.adj
                  ELSE CAST(k.bin AS DOUBLE) * ((b.hi - b.lo) / {float(bins)}) + b.lo END, 6) AS lo,
       round(CASE WHEN k.bin = {bins - 1} THEN b.hi
                  ELSE CAST(k.bin + 1 AS DOUBLE) * ((b.hi - b.lo) / {float(bins)}) + b.lo END, 6) AS hi,
       round(avg(k.y), 6) AS mean, count(k.y) AS n
FROM k, b GROUP BY k.bin, b.lo, b.hi, b.same, b.adj"""


@register("score_bin_mean", O.with_(["txn", "users", "cards"], ", ua AS (" + _enriched_body() + ")"
                                    + _cut_sql("ua", "credit_score", "amount_mean", 5)).replace(
    ")\n, ua AS", "),\nua AS", 1))
def q_score_bin_mean(spark, d):
    """Mean amount per credit-score bin (pd.cut, 5 bins)."""
    return rounded(R.score_bin_mean(materialize(enriched_user_agg(spark, d))), {"lo": 6, "hi": 6, "mean": 6})


@register("age_bin_mean", O.with_(["txn", "users", "cards"], ", ua AS (" + _enriched_body() + ")"
                                  + _cut_sql("ua", "current_age", "amount_mean", 6)).replace(
    ")\n, ua AS", "),\nua AS", 1))
def q_age_bin_mean(spark, d):
    """Mean amount per age bin (pd.cut, 6 bins)."""
    return rounded(R.age_bin_mean(materialize(enriched_user_agg(spark, d))), {"lo": 6, "hi": 6, "mean": 6})


# ---------------------------------------------------------------- geography

LOC_BODY = f"""
SELECT merchant_city, merchant_state, count(amount_usd) AS txn_count, {O.mmean('amount_usd')} AS avg_amount
FROM txn WHERE merchant_city IS NOT NULL AND merchant_state IS NOT NULL AND amount_usd IS NOT NULL
GROUP BY 1, 2"""


@register("location_agg", O.with_(["txn"], LOC_BODY))
def q_location_agg(spark, d):
    """G21, F3."""
    return A.location_aggregate(AD.txn(spark, d, ["merchant_city", "merchant_state", "amount_usd"]))


GEO_SQL = O.with_(["txn", "city_coords", "state_coords"], f"""
, top AS ({LOC_BODY} ORDER BY txn_count DESC, merchant_city, merchant_state LIMIT 300),
cc AS (SELECT city_state, min({{'lat': lat, 'lon': lon}}) AS p FROM city_coords GROUP BY 1),
sc AS (SELECT upper(trim(state)) AS state, min({{'lat': lat, 'lon': lon}}) AS p FROM state_coords GROUP BY 1),
g AS (SELECT top.*, coalesce(cc.p.lat, sc.p.lat, 39.5) AS lat, coalesce(cc.p.lon, sc.p.lon, -98.4) AS lon,
             CASE WHEN cc.p IS NOT NULL THEN 'city' WHEN sc.p IS NOT NULL THEN 'state' ELSE 'default' END AS geo_level
      FROM top
      LEFT JOIN cc ON cc.city_state = upper(trim(merchant_city)) || '|' || upper(trim(merchant_state))
      LEFT JOIN sc ON sc.state = upper(trim(merchant_state))),
box AS (SELECT * FROM g WHERE lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -66),
r AS (SELECT min(sqrt(txn_count)) AS c_lo, max(sqrt(txn_count)) AS c_hi,
             min(sqrt(avg_amount)) AS a_lo, max(sqrt(avg_amount)) AS a_hi FROM box)
""".replace("\n, top AS", ", top AS", 1))


@register("merchant_locations", GEO_SQL + """
SELECT box.*,
  round(CASE WHEN c_hi = c_lo THEN 410.0 ELSE 20.0 + (sqrt(txn_count) - c_lo) / (c_hi - c_lo) * 780.0 END, 6)
      AS size_count,
  round(CASE WHEN a_hi = a_lo THEN 410.0 ELSE 20.0 + (sqrt(avg_amount) - a_lo) / (a_hi - a_lo) * 780.0 END, 6)
      AS size_amount
FROM box, r""")
def q_merchant_locations(spark, d):
    """Geocoded top-300 locations with bubble sizes."""
    t = AD.txn(spark, d, ["merchant_city", "merchant_state", "amount_usd"])
    out = G.merchant_locations(t, AD.city_coords(spark, d), AD.state_coords(spark, d))
    return rounded(out, {"size_count": 6, "size_amount": 6})


@register("top_merchant_locations", GEO_SQL.replace("LIMIT 300", "LIMIT 8") + """
SELECT box.merchant_city, box.merchant_state, box.txn_count, box.avg_amount, box.geo_level FROM box""")
def q_top_merchant_locations(spark, d):
    """K3 with a limit below the number of locations."""
    t = AD.txn(spark, d, ["merchant_city", "merchant_state", "amount_usd"])
    out = G.merchant_locations(t, AD.city_coords(spark, d), AD.state_coords(spark, d), top_n=8)
    return out.select("merchant_city", "merchant_state", "txn_count", "avg_amount", "geo_level")


@register("bubble_legend", GEO_SQL.replace("r AS (SELECT min(sqrt(txn_count))", "r0 AS (SELECT min(sqrt(txn_count))")
          + """
, r AS (SELECT CAST(min(txn_count) AS DOUBLE) AS c_lo, CAST(max(txn_count) AS DOUBLE) AS c_hi,
               min(avg_amount) AS a_lo, max(avg_amount) AS a_hi FROM box),
s AS (SELECT 'txn_count' AS metric, 'min' AS stop, c_lo AS value, c_lo AS lo, c_hi AS hi FROM r
      UNION ALL SELECT 'txn_count', 'mid', (c_lo + c_hi) / 2, c_lo, c_hi FROM r
      UNION ALL SELECT 'txn_count', 'max', c_hi, c_lo, c_hi FROM r
      UNION ALL SELECT 'avg_amount', 'min', a_lo, a_lo, a_hi FROM r
      UNION ALL SELECT 'avg_amount', 'mid', (a_lo + a_hi) / 2, a_lo, a_hi FROM r
      UNION ALL SELECT 'avg_amount', 'max', a_hi, a_lo, a_hi FROM r)
SELECT metric, stop, round(value, 6) AS value,
       round(CASE WHEN sqrt(hi) = sqrt(lo) THEN 410.0
                  ELSE 20.0 + (sqrt(value) - sqrt(lo)) / (sqrt(hi) - sqrt(lo)) * 780.0 END, 6) AS size
FROM s WHERE value IS NOT NULL""")
def q_bubble_legend(spark, d):
    """Size-legend stops of the location report."""
    t = AD.txn(spark, d, ["merchant_city", "merchant_state", "amount_usd"])
    locs = G.merchant_locations(t, AD.city_coords(spark, d), AD.state_coords(spark, d))
    return rounded(G.bubble_legend(locs), {"value": 6, "size": 6})


# ---------------------------------------------------------------- scalar functions

from ..functions import columns as C  # noqa: E402
from ..operators import iforest as IF  # noqa: E402
from ..operators import ml as ML  # noqa: E402
from ..operators import quality as QL  # noqa: E402


@register("parse_currency", O.with_(["raw_cards"], """
SELECT id, amount,
       CAST(CAST(trim(regexp_replace(amount, '[$,]', '', 'g')) AS DECIMAL(12,2)) AS DOUBLE) AS amount_usd
FROM raw_cards"""))
def q_parse_currency(spark, d):
    """Currency text to exact DECIMAL(12,2) (shown as DOUBLE)."""
    r = AD.raw_cards(spark, d)
    return r.select("id", "amount", C.parse_currency("amount").cast("double").alias("amount_usd"))


@register("parse_zip", O.with_(["raw_cards"], """
SELECT id, CASE WHEN length(z) < 5 THEN lpad(z, 5, '0') ELSE z END AS zip
FROM (SELECT id, regexp_replace(zip, '\\.\\d+$', '') AS z FROM raw_cards)"""))
def q_parse_zip(spark, d):
    """C5."""
    return AD.raw_cards(spark, d).select("id", C.parse_zip("zip").alias("zip"))


@register("parse_month_year", O.with_(["raw_cards"], """
SELECT id, CAST(try_strptime(expires, '%m/%Y') AS DATE) AS expires FROM raw_cards"""))
def q_parse_month_year(spark, d):
    """C6."""
    return AD.raw_cards(spark, d).select("id", C.parse_month_year("expires").alias("expires"))


@register("parse_yes_no", O.with_(["raw_cards"], """
SELECT id, CASE upper(trim(has_chip)) WHEN 'YES' THEN true WHEN 'NO' THEN false END AS has_chip FROM raw_cards"""))
def q_parse_yes_no(spark, d):
    """C7."""
    return AD.raw_cards(spark, d).select("id", C.parse_yes_no("has_chip").alias("has_chip"))


@register("lenient_number", O.with_(["raw_cards"], """
SELECT id, TRY_CAST(zip AS DOUBLE) AS zip_number, TRY_CAST(amount AS DOUBLE) AS amount_number FROM raw_cards"""))
def q_lenient_number(spark, d):
    """C11: text to number, unparseable -> NULL."""
    r = AD.raw_cards(spark, d)
    return r.select("id", C.lenient_number("zip").alias("zip_number"), C.lenient_number("amount").alias("amount_number"))


@register("lenient_timestamp", O.with_(["raw_cards"], """
SELECT id, TRY_CAST(opened AS TIMESTAMP) AS opened_at FROM raw_cards"""))
def q_lenient_timestamp(spark, d):
    """C2 (C2b is the strict twin): text to naive timestamp, garbage -> NULL."""
    return AD.raw_cards(spark, d).select("id", C.lenient_timestamp("opened").alias("opened_at"))


@register("make_birth_date", """
SELECT c_custkey AS id, make_date(CAST(1940 + c_custkey % 60 AS INT), CAST(1 + c_custkey % 12 AS INT), 1) AS birth_date,
       c_name FROM customer""")
def q_make_birth_date(spark, d):
    """Year + month columns -> birth_date in place of the year, month dropped."""
    c = AD.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (F.lit(1940) + F.col("c_custkey") % 60).cast("int").alias("birth_year"),
        (F.lit(1) + F.col("c_custkey") % 12).cast("int").alias("birth_month"), "c_name")
    return C.join_year_month(c, "birth_year", "birth_month", "birth_date")


@register("date_parts", O.with_(["event_txn"], """
SELECT transaction_id, CAST(year(date) AS INT) AS txn_year, CAST(month(date) AS INT) AS txn_month,
       CAST(hour(date) AS INT) AS txn_hour, CAST(isodow(date) - 1 AS INT) AS txn_dow,
       CAST(dayofweek(date) AS INT) AS txn_dow_sun0,
       (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[isodow(date)] AS dow_label,
       CAST(date_trunc('month', date) AS DATE) AS period, CAST(date AS DATE) AS day
FROM event_txn"""))
def q_date_parts(spark, d):
    """C8, C14, C15, C15b, C16, C17."""
    e = AD.event_txn(spark, d)
    return e.select(
        "transaction_id", F.year("date").alias("txn_year"), F.month("date").alias("txn_month"),
        F.hour("date").alias("txn_hour"), C.weekday_mon0("date").alias("txn_dow"),
        C.weekday_sun0("date").alias("txn_dow_sun0"), C.weekday_label("date").alias("dow_label"),
        C.month_start("date").alias("period"), C.to_date("date").alias("day"))


@register("safe_ratios", O.with_(["users"], """
SELECT id, coalesce(total_debt / (yearly_income + 1e-6), 0) AS debt_to_income_eps,
       total_debt / CASE WHEN yearly_income <> 0 THEN yearly_income END AS debt_to_income,
       yearly_income / CASE WHEN num_credit_cards <> 0 THEN num_credit_cards END AS income_per_card
FROM users"""))
def q_safe_ratios(spark, d):
    """C22, C23, C24."""
    u = AD.users(spark, d)
    return u.select("id", C.eps_ratio("total_debt", "yearly_income").alias("debt_to_income_eps"),
                    C.nullif_ratio("total_debt", "yearly_income").alias("debt_to_income"),
                    C.nullif_ratio("yearly_income", "num_credit_cards").alias("income_per_card"))


@register("impute_errors", O.with_(["txn"], """
SELECT transaction_id, card_id, coalesce(errors, 'No error') AS errors FROM txn"""))
def q_impute_errors(spark, d):
    """C9."""
    t = AD.txn(spark, d, ["transaction_id", "card_id", "errors"])
    return t.select("transaction_id", "card_id", C.impute_errors("errors").alias("errors"))


@register("required_keys_filter", O.with_(["txn"], """
SELECT merchant_state, count(*) AS txn_count FROM txn
WHERE client_id IS NOT NULL AND card_id IS NOT NULL AND amount_usd IS NOT NULL AND date IS NOT NULL
  AND merchant_state IS NOT NULL
GROUP BY merchant_state"""))
def q_required_keys_filter(spark, d):
    """F1 (required keys) then F8 (NULL group keys dropped)."""
    t = AD.txn(spark, d, ["client_id", "card_id", "amount_usd", "date", "merchant_state"])
    t = t.dropna(subset=["client_id", "card_id", "amount_usd", "date"])
    return t.where(F.col("merchant_state").isNotNull()).groupBy("merchant_state").agg(
        F.count(F.lit(1)).alias("txn_count"))


# ---------------------------------------------------------------- quality

def _missing_sql() -> str:
    cols = list(AD.TXN_COLUMNS)
    parts = []
    for i, c in enumerate(cols):
        nan = f" OR isnan({c})" if c == "amount_usd" else ""
        parts.append(f"SELECT '{c}' AS column, {i} AS position, CAST(count_if({c} IS NULL{nan}) AS BIGINT) AS missing FROM txn")
    return O.with_(["txn"], "\nUNION ALL\n".join(parts)).replace(" AS column,", ' AS "column",')


@register("missing_report", _missing_sql())
def q_missing_report(spark, d):
    """Missing values per column of the transactions."""
    return QL.missing_report(AD.txn(spark, d))


PROFILE_TYPES = {"transaction_id": "bigint", "date": "timestamp_ntz", "client_id": "bigint", "card_id": "bigint",
                 "amount_usd": "double", "transaction_type": "string", "merchant_id": "bigint",
                 "merchant_city": "string", "merchant_state": "string", "mcc": "int", "errors": "string"}


@register("table_profile", O.with_(["txn"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null FROM txn" for c, t in PROFILE_TYPES.items())))
def q_table_profile(spark, d):
    """Column, type, non-null count."""
    return QL.profile(AD.txn(spark, d))


# ---------------------------------------------------------------- joins

@register("label_join", O.with_(["txn", "labels_in"], """
SELECT t.transaction_id, t.card_id, t.amount_usd, l.fraud
FROM txn t LEFT JOIN labels_in l ON t.card_id = l.id"""))
def q_label_join(spark, d):
    """J7 (labels keyed by card id, as transaction ids repeat in the adapter)."""
    t = AD.txn(spark, d, ["transaction_id", "card_id", "amount_usd"])
    return ML.label_join(t, AD.labels_in(spark, d), txn_key="card_id")


FOLD_COLS = ["amount_usd", "mcc"]


def _hash_order(text: str) -> str:
    return f"CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) % {ML.RANK_BUCKETS}, {text}"


@register("training_set", O.with_(["txn", "labels_in"], f"""
, j AS (SELECT t.transaction_id, t.amount_usd, t.mcc, l.fraud::INT AS y FROM txn t JOIN labels_in l ON t.card_id = l.id WHERE l.fraud IS NOT NULL),
k AS (SELECT transaction_id, CAST(transaction_id AS VARCHAR) AS k, max(y) AS y FROM j GROUP BY transaction_id),
f AS (SELECT transaction_id, CAST((row_number() OVER (PARTITION BY y ORDER BY {_hash_order('k')}) - 1) % 5 AS INT) AS fold FROM k)
SELECT j.transaction_id, j.y, f.fold, CAST(j.amount_usd AS DOUBLE) AS amount_usd, CAST(j.mcc AS DOUBLE) AS mcc
FROM j JOIN f ON j.transaction_id = f.transaction_id""").replace(")\n, j AS", "),\nj AS", 1))
def q_training_set(spark, d):
    """Labelled transactions in five folds, stratified by label."""
    t = AD.txn(spark, d, ["transaction_id", "card_id", *FOLD_COLS])
    return ML.training_set(ML.label_join(t, AD.labels_in(spark, d), txn_key="card_id"), "transaction_id", "fraud", FOLD_COLS)


DICTIONARY_COLS = ["merchant_city", "merchant_state", "errors", "merchant_id"]
_DICTIONARY_BODY = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", v AS value, n, 1 + row_number() OVER (ORDER BY n DESC, {_hash_order('v')}) AS code
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM txn WHERE {c} IS NOT NULL%s GROUP BY ALL)""" for c in DICTIONARY_COLS)


@register("category_dictionary", O.with_(["txn"], _DICTIONARY_BODY.replace("%s", "")))
def q_category_dictionary(spark, d):
    """C4: frequency-ordered codes of the categorical columns."""
    return ML.fit_dictionary(AD.txn(spark, d, DICTIONARY_COLS), DICTIONARY_COLS)


@register("encoded_transactions", O.with_(["txn"], ", dict AS (" + _DICTIONARY_BODY.replace("%s", " AND date < DATE '1992-02-01'") + """)
SELECT t.transaction_id, """ + ", ".join(f"CASE WHEN t.{c} IS NULL THEN 0 ELSE coalesce(d{i}.code, 1) END AS {c}_code"
                                      for i, c in enumerate(DICTIONARY_COLS)) + "\nFROM txn t " + " ".join(
    f"LEFT JOIN dict d{i} ON d{i}.\"column\" = '{c}' AND d{i}.value = CAST(t.{c} AS VARCHAR)" for i, c in enumerate(DICTIONARY_COLS))).replace(
    ")\n, dict AS", "),\ndict AS", 1))
def q_encoded_transactions(spark, d):
    """C4: all transactions encoded with the dictionary of the first month; later values are unseen."""
    t = AD.txn(spark, d, ["transaction_id", "date", *DICTIONARY_COLS])
    fitted = materialize(ML.fit_dictionary(t.where(F.col("date") < F.lit("1992-02-01").cast("date")), DICTIONARY_COLS))
    return ML.encode(t, fitted, DICTIONARY_COLS).select("transaction_id", *[f"{c}_code" for c in DICTIONARY_COLS])


@register("mcc_lookup", O.with_(["txn", "mcc_codes"], f"""
SELECT m.*, c.description FROM ({MCC_BODY}) m LEFT JOIN mcc_codes c ON m.mcc = c.id"""))
def q_mcc_lookup(spark, d):
    """J8 + G5."""
    t = AD.txn(spark, d, ["mcc", "client_id", "amount_usd"])
    return rounded(A.mcc_aggregate(t, AD.mcc_codes(spark, d)), STD6)


# ---------------------------------------------------------------- models

def _user_features(spark, d):
    ua = enriched_user_agg(spark, d)
    return ua, ML.feature_columns(ua)


def _z_sql() -> str:
    cols = ML.DEFAULT_FEATURES
    z = ",\n       ".join(
        f"round(CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
        f"END, 6) AS {c}" for c in cols)
    return O.with_(["txn", "users", "cards"], f"SELECT user_id,\n       {z}\nFROM ({_enriched_body(False)})")


@register("standardised_features", _z_sql())
def q_standardised_features(spark, d):
    """M1: z-scores of the model features (population std, as scikit-learn)."""
    ua, cols = _user_features(spark, d)
    z = ST.standardise(materialize(ua.select("user_id", *cols)), cols)
    return rounded(z, {c: 6 for c in cols})


def _impute_sql() -> str:
    cols = ML.DEFAULT_FEATURES
    z = ",\n       ".join(f"round(CAST(coalesce({c}, avg({c}) OVER ()) AS DOUBLE), 6) AS {c}" for c in cols)
    return O.with_(["txn", "users", "cards"], f"SELECT user_id,\n       {z}\nFROM ({_enriched_body(False)})")


@register("imputed_features", _impute_sql())
def q_imputed_features(spark, d):
    """M4: mean imputation of the model features."""
    ua, cols = _user_features(spark, d)
    return rounded(ML.impute(materialize(ua.select("user_id", *cols)), cols, "mean"), {c: 6 for c in cols})


@register("pca_projection")
def q_pca_projection(spark, d):
    """M5: first two principal components of the standardised features."""
    ua, cols = _user_features(spark, d)
    return ML.pca_projection(ua, cols, "user_id", 2)


@register("kmeans_clusters")
def q_kmeans_clusters(spark, d):
    """M6: k-means (k=4) cluster per user."""
    ua, cols = _user_features(spark, d)
    return ML.kmeans_clusters(ua, cols, "user_id", 4)


@register("gaussian_mixture")
def q_gaussian_mixture(spark, d):
    """M6: Gaussian mixture (k=3) membership per user, over three features."""
    ua, cols = _user_features(spark, d)
    return ML.gaussian_mixture(ua, cols[:3], "user_id", 3)


@register("bisecting_clusters")
def q_bisecting_clusters(spark, d):
    """M6: divisive clustering of the users by four features, two levels."""
    ua, cols = _user_features(spark, d)
    return ML.bisecting_clusters(ua, cols[:4], "user_id", depth=2, min_size=20)


def anomaly_frame(spark, d) -> DataFrame:
    """Features rounded to millionths: engines differ in the last bits of a deviation, and a tie must be one everywhere."""
    ua, cols = _user_features(spark, d)
    est = IF.IsolationForest(num_trees=200, sample_size=256, contamination=0.02, seed=42)
    return est.fit_transform(rounded(ua, {c: 6 for c in cols}), cols, "user_id", keep=["amount_mean"])[1]


def _forest_sql(body: str) -> str:
    cols = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ML.DEFAULT_FEATURES)
    shaped = {"ua": f"SELECT user_id, {cols} FROM ({_enriched_body(False)})"}
    return O.with_(["txn", "users", "cards"], body, shaped | O.forest("ua", "user_id", "amount_mean", ML.DEFAULT_FEATURES, 200, 256, 0.02, 42))


@register("anomaly_scores", _forest_sql("SELECT user_id, round(anomaly_score, 9) AS anomaly_score, anomaly FROM labelled"))
def q_anomaly_scores(spark, d):
    """M2, M3: isolation-forest decision score and label per user."""
    return rounded(anomaly_frame(spark, d).select("user_id", "anomaly_score", "anomaly"), {"anomaly_score": 9})


@register("anomaly_summary")
def q_anomaly_summary(spark, d):
    """G33."""
    return IF.anomaly_summary(anomaly_frame(spark, d))


@register("anomaly_amount_by_label", _forest_sql("SELECT label, " + ", ".join(
    f"round(quantile_cont(amount_mean, {q / 100}), 6) AS q{q}" for q in (0, 25, 50, 75, 100)) + " FROM labelled GROUP BY label"))
def q_anomaly_amount_by_label(spark, d):
    """Quartiles of the mean amount per anomaly label (violin body in kde form elsewhere)."""
    a = anomaly_frame(spark, d).withColumn("label", C.anomaly_label("anomaly"))
    return rounded(ST.describe_by(a, "amount_mean", "label"), {f"q{q}": 6 for q in (0, 25, 50, 75, 100)})


@register("anomaly_histogram", _forest_sql("SELECT bin, round(lo, 9) AS lo, round(hi, 9) AS hi, frequency FROM " + _hist_sql(
    "labelled", "anomaly_score", 60)))
def q_anomaly_histogram(spark, d):
    """60-bin histogram of the decision scores."""
    return rounded(ST.histogram(anomaly_frame(spark, d), "anomaly_score", 60), {"lo": 9, "hi": 9})


@register("anomaly_amount_density", _forest_sql("""
SELECT g.label, g.point, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * ((g.x - v.amount_mean) / g.bw) * ((g.x - v.amount_mean) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())), 10) AS density
FROM (SELECT label, n, bw, CAST(p.range AS INT) AS point,
             CASE WHEN p.range = 99 THEN mx + bw * 2.0
                  ELSE CAST(p.range AS DOUBLE) * ((mx + bw * 2.0 - (mn - bw * 2.0)) / 99.0) + (mn - bw * 2.0) END AS x
      FROM (SELECT label, count(*) AS n, min(amount_mean) AS mn, max(amount_mean) AS mx,
                   stddev_samp(amount_mean) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw FROM labelled GROUP BY label) k, range(100) p
      WHERE bw > 0) g JOIN labelled v ON g.label = v.label
GROUP BY g.label, g.point, g.x, g.n, g.bw"""))
def q_anomaly_amount_density(spark, d):
    """G34 (violin body): density of the mean amount per anomaly label (violin KDE: 100 points, cut 2)."""
    a = anomaly_frame(spark, d).withColumn("label", C.anomaly_label("anomaly"))
    return rounded(ST.kde(a, "amount_mean", "label", grid=100, cut=2.0), {"x": 6, "density": 10})


# ---------------------------------------------------------------- invariants of the fitted models
# Components and clusters have no SQL form; what must hold of any right fit does.

def _facts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fact(df: DataFrame, name: str, value) -> DataFrame:
    return df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("fact"), "value")


ORACLE["anomaly_summary"] = O.with_(["txn"], """
SELECT CAST(ceil(0.02 * (n - 1)) AS BIGINT) AS n_anomalies, n AS n_rows, ceil(0.02 * (n - 1)) * 100.0 / n AS pct_anomalies
FROM (SELECT count(DISTINCT client_id) AS n FROM txn)""")


@register("anomaly_invariants", O.with_(["txn"], """
, u AS (SELECT count(DISTINCT client_id) AS n FROM txn)
SELECT 'users in the score histogram' AS fact, n AS value FROM u
UNION ALL SELECT 'users whose label follows the sign of the score', n FROM u
UNION ALL SELECT 'users anomalous', CAST(ceil(0.02 * (n - 1)) AS BIGINT) FROM u
UNION ALL SELECT 'labels with quartiles in order', 2
UNION ALL SELECT 'points of the density', 200
UNION ALL SELECT 'points of negative density', 0""").replace(")\n, u AS", "),\nu AS", 1))
def q_anomaly_invariants(spark, d):
    """M2, M3, G24, G33, G34 from one fit."""
    a = materialize(anomaly_frame(spark, d).withColumn("label", C.anomaly_label("anomaly")))
    box, curve = ST.describe_by(a, "amount_mean", "label"), ST.kde(a, "amount_mean", "label", grid=100, cut=2.0)
    ordered = (F.col("q0") <= F.col("q25")) & (F.col("q25") <= F.col("q50")) & (F.col("q50") <= F.col("q75")) & (
        F.col("q75") <= F.col("q100"))
    return _facts(
        _fact(ST.histogram(a, "anomaly_score", 60), "users in the score histogram", F.sum("frequency")),
        _fact(a, "users whose label follows the sign of the score",
              F.count_if((F.col("anomaly_score") < 0) == (F.col("anomaly") == -1))),
        _fact(a, "users anomalous", F.count_if(F.col("label") == "Anomaly")),
        _fact(box, "labels with quartiles in order", F.count_if(ordered)),
        _fact(curve, "points of the density", F.count("density")),
        _fact(curve, "points of negative density", F.count_if(F.col("density") < 0)))


@register("pca_invariants", O.with_(["txn"], """
, u AS (SELECT count(DISTINCT client_id) AS n FROM txn)
SELECT 'users projected' AS fact, n AS value FROM u
UNION ALL SELECT 'correlation of the components in millionths', 0
UNION ALL SELECT 'first component varies most, and more than a single feature', 1""").replace(")\n, u AS", "),\nu AS", 1))
def q_pca_invariants(spark, d):
    """M5."""
    p = materialize(q_pca_projection(spark, d))
    return _facts(
        _fact(p, "users projected", F.count("pc1")),
        _fact(p, "correlation of the components in millionths", F.round(F.abs(F.corr("pc1", "pc2")) * 1e6)),
        _fact(p, "first component varies most, and more than a single feature",
              ((F.var_pop("pc1") >= F.var_pop("pc2")) & (F.var_pop("pc1") >= 1.0)).cast("int")))


@register("kmeans_invariants", O.with_(["txn"], """
, u AS (SELECT count(DISTINCT client_id) AS n FROM txn)
SELECT 'users in a cluster' AS fact, n AS value FROM u
UNION ALL SELECT 'clusters', 4
UNION ALL SELECT 'at least 98 % of users are nearest to the mean of their own cluster', 1""").replace(
    ")\n, u AS", "),\nu AS", 1))
def q_kmeans_invariants(spark, d):
    """M6: clusters against their own means in the standardised features."""
    ua, cols = _user_features(spark, d)
    x = materialize(ua.select("user_id", *[F.col(c).cast("double").alias(c) for c in cols]))
    z = ST.standardise(ML.impute(x, cols), cols)
    k = materialize(z.join(ML.kmeans_clusters(x, cols, "user_id", 4), "user_id"))
    means = k.groupBy(F.col("cluster").alias("other")).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])  # four rows
    away = sum(((F.col(c) - F.col(f"_m_{c}")) * (F.col(c) - F.col(f"_m_{c}")) for c in cols), F.lit(0.0))
    near = k.crossJoin(F.broadcast(means)).groupBy("user_id", "cluster").agg(F.min_by("other", away).alias("nearest"))
    return _facts(
        _fact(k, "users in a cluster", F.count("cluster")), _fact(means, "clusters", F.count("other")),
        _fact(near, "at least 98 % of users are nearest to the mean of their own cluster",
              (F.avg((F.col("nearest") == F.col("cluster")).cast("int")) >= 0.98).cast("int")))


def _planted(spark, d, groups: int) -> DataFrame:
    """Two or four well separated groups laid around the amounts of the transactions: id, true_group, x, y."""
    t = AD.txn(spark, d, ["transaction_id", "amount_usd"]).groupBy("transaction_id").agg(
        (F.pmod(F.min("amount_usd").cast("double"), F.lit(1.0)) - 0.5).alias("_e"))
    group = (F.pmod("transaction_id", F.lit(groups)) * (3 // (groups - 1))).cast("int")  # 0 and 3, or 0 to 3
    return t.select("transaction_id", group.alias("true_group"), (F.pmod(group, F.lit(2)) * 10 + F.col("_e")).alias("x"),
                    (F.floor(group / 2) * 6 + F.pmod(F.col("_e") * 7, F.lit(1.0))).alias("y"))


@register("gaussian_mixture_invariants", O.with_(["txn"], """
SELECT 'rows' AS fact, count(DISTINCT transaction_id) AS value FROM txn
UNION ALL SELECT 'probabilities off one by over 1e-9', 0
UNION ALL SELECT 'planted groups found whole and alone', 2
UNION ALL SELECT 'group means found within 0.1', 2
UNION ALL SELECT 'more iterations fit no worse', 1"""))
def q_gaussian_mixture_invariants(spark, d):
    """M6: two planted groups are the components; the likelihood does not fall with the iterations."""
    x = materialize(_planted(spark, d, 2))
    z = ML.mixture_features(x, ["x", "y"], "transaction_id")
    m = materialize(x.join(ML.gaussian_mixture(z, ["x", "y"], "transaction_id", 2, starts=3, prepared=True), "transaction_id"))
    total = sum((F.col(f"p{i}") for i in range(2)), F.lit(0.0))
    pairs = m.groupBy("true_group", "cluster").agg(F.count(F.lit(1)).alias("n"))
    whole = pairs.groupBy("true_group").agg(F.count("cluster").alias("clusters"), F.first("cluster").alias("cluster"))
    soft = m.agg(*[(F.sum(F.col(f"p{i}") * F.col(c)) / F.sum(f"p{i}")).alias(f"{c}{i}") for i in range(2) for c in "xy"])
    found = soft.select(F.explode(F.array(*[F.struct(F.lit(i).alias("cluster"), F.col(f"x{i}").alias("mx"), F.col(f"y{i}").alias("my"))
                                            for i in range(2)])).alias("s")).select("s.*")
    true = x.groupBy("true_group").agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"))
    near = whole.join(found, "cluster").join(true, "true_group")
    fits = ML.mixture_likelihoods(z, ["x", "y"], "transaction_id", 2, (1, 3, 10), prepared=True)
    rising = all(b >= a - 1e-6 * abs(a) for a, b in zip(fits, fits[1:]))
    return _facts(
        _fact(m, "rows", F.count("cluster")), _fact(m, "probabilities off one by over 1e-9", F.count_if(F.abs(total - 1) > 1e-9)),
        _fact(whole.where("clusters = 1"), "planted groups found whole and alone", F.count_distinct("cluster")),
        _fact(near, "group means found within 0.1", F.count_if((F.abs(F.col("mx") - F.col("tx")) < 0.1) & (F.abs(F.col("my") - F.col("ty")) < 0.1))),
        _fact(m.limit(1), "more iterations fit no worse", F.max(F.lit(int(rising)))))


@register("bisecting_invariants", O.with_(["txn"], """
SELECT 'rows' AS fact, count(DISTINCT transaction_id) AS value FROM txn
UNION ALL SELECT 'leaves', 4
UNION ALL SELECT 'planted groups found whole', 4
UNION ALL SELECT 'parents of the first level', 2
UNION ALL SELECT 'levels above keep their rows together', 1"""))
def q_bisecting_invariants(spark, d):
    """M6: two levels part four planted groups; a shallower run's clusters are unions of a deeper one's."""
    x = materialize(_planted(spark, d, 4))
    deep = materialize(x.join(ML.bisecting_clusters(x, ["x", "y"], "transaction_id", depth=2, min_size=2), "transaction_id"))
    flat = ML.bisecting_clusters(x, ["x", "y"], "transaction_id", depth=1, min_size=2).select("transaction_id", F.col("path").alias("parent"))
    both = deep.join(flat, "transaction_id")
    whole = deep.groupBy("true_group").agg(F.count_distinct("path").alias("paths"))
    return _facts(
        _fact(deep, "rows", F.count("cluster")), _fact(deep, "leaves", F.count_distinct("path")),
        _fact(whole, "planted groups found whole", F.count_if(F.col("paths") == 1)),
        _fact(deep, "parents of the first level", F.count_distinct(F.substring("path", 1, 1))),
        _fact(both, "levels above keep their rows together", F.min((F.substring("path", 1, 1) == F.col("parent")).cast("int"))))
