"""Report tables.

Each report is a small, chart-ready DataFrame.  Top-N reports plan as
``TakeOrderedAndProject`` (each task keeps its N best rows); shares of a
total use a one-row total that is broadcast, never an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .aggregates import dark_web_flag, pick
from .quantiles import exact_quantile
from .stats import binned_mean


def top_n(df: DataFrame, order_col: str, key: str, n: int = 10, rank: bool = True) -> DataFrame:
    """K1/K2/K6: the ``n`` largest rows by ``order_col`` (ties by ``key``), with rank 1..n.

    The rank window runs after the limit, so it only ever sees ``n`` rows.
    """
    top = df.orderBy(F.desc(order_col), F.asc(key)).limit(n)
    if not rank:
        return top
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(order_col), F.asc(key))).cast("int"))


def share_of_total(df: DataFrame, count_col: str = "n", out: str = "pct") -> DataFrame:
    """Count * 100 / total, the total from a one-row aggregate."""
    tot = df.agg(F.sum(count_col).alias("_tot"))
    return df.crossJoin(F.broadcast(tot)).withColumn(
        out, F.col(count_col).cast("double") * F.lit(100.0) / F.col("_tot")
    ).drop("_tot")


# ---------------------------------------------------------------- time reports

def monthly_volume(txn: DataFrame) -> DataFrame:
    """Per calendar month: count of transaction ids and mean amount."""
    t = txn.where(F.col("date").isNotNull())
    g = t.groupBy(C.month_start("date").alias("period")).agg(
        F.count("transaction_id").alias("txn_count"), C.exact_sum("amount_usd").alias("_s"),
        C.exact_count("amount_usd").alias("_n"),
    )
    return g.select("period", "txn_count", C.mean_from("_s", "_n").alias("avg_amount"))


def monthly_median(txn: DataFrame, median: str = "split") -> DataFrame:
    """Per (year, month): count, mean, exact median of the amount; SQL GROUP BY keeps NULL keys.

    A month is a huge group (few groups, each a large share of all rows), so the exact median
    splits every month into global value buckets (``split``) rather than ranking it in one task."""
    t = txn.select(
        F.year("date").alias("txn_year"), F.month("date").alias("txn_month"),
        F.col("amount_usd").cast("double").alias("amount"),
    )
    g = t.groupBy("txn_year", "txn_month").agg(
        F.count(F.lit(1)).alias("txn_count"), C.exact_sum("amount").alias("_s"), C.exact_count("amount").alias("_n"),
        *([F.median("amount").alias("median_amount")] if median == "builtin" else []),
    )
    g = g.select("txn_year", "txn_month", "txn_count", C.mean_from("_s", "_n").alias("avg_amount"),
                 *(["median_amount"] if median == "builtin" else []))
    if median != "builtin":
        med = exact_quantile(t, "amount", 0.5, ["txn_year", "txn_month"], "median_amount",
                             split=median == "split").select(
            F.col("txn_year").alias("_y"), F.col("txn_month").alias("_m"), "median_amount")
        on = F.col("txn_year").eqNullSafe(F.col("_y")) & F.col("txn_month").eqNullSafe(F.col("_m"))
        g = g.join(med, on, "left").drop("_y", "_m")
    return g.withColumn("period", C.month_from_parts("txn_year", "txn_month"))


def hour_counts(txn: DataFrame) -> DataFrame:
    """Transactions per hour of day."""
    return txn.where(F.col("date").isNotNull()).groupBy(F.hour("date").alias("txn_hour")).agg(
        F.count(F.lit(1)).alias("txn_count")
    )


def weekday_counts(txn: DataFrame) -> DataFrame:
    """Transactions per weekday (Monday=0) with label."""
    g = txn.where(F.col("date").isNotNull()).groupBy(C.weekday_mon0("date").alias("txn_dow")).agg(
        F.count(F.lit(1)).alias("txn_count")
    )
    labels = F.array(*[F.lit(x) for x in C.WEEKDAY_LABELS])
    return g.withColumn("dow_label", F.element_at(labels, F.col("txn_dow") + 1))


def time_patterns(txn: DataFrame) -> DataFrame:
    """G16 in one scan: counts per hour and per weekday as GROUPING SETS ((hour), (weekday)).

    Rows carry ``pattern`` = 'hour' or 'weekday' and the other key NULL."""
    t = txn.where(F.col("date").isNotNull()).select(
        F.hour("date").alias("txn_hour"), C.weekday_mon0("date").alias("txn_dow"))
    g = t.groupingSets([["txn_hour"], ["txn_dow"]], "txn_hour", "txn_dow").agg(
        F.count(F.lit(1)).alias("txn_count"), F.grouping("txn_hour").alias("_gh"))
    return g.select(F.when(F.col("_gh") == 0, F.lit("hour")).otherwise(F.lit("weekday")).alias("pattern"),
                    "txn_hour", "txn_dow", "txn_count")


def hour_weekday_table(txn: DataFrame) -> DataFrame:
    """(hour, weekday) -> count, mean amount, error count."""
    t = txn.select(
        F.hour("date").alias("txn_hour"), C.weekday_mon0("date").alias("txn_dow"), "amount_usd",
        C.present_flag("errors").alias("_err"),
    )
    g = t.groupBy("txn_hour", "txn_dow").agg(
        F.count(F.lit(1)).alias("txn_count"), C.exact_sum("amount_usd").alias("_s"),
        C.exact_count("amount_usd").alias("_n"), F.sum("_err").alias("error_count"),
    )
    return g.select("txn_hour", "txn_dow", "txn_count", C.mean_from("_s", "_n").alias("avg_amount"),
                    "error_count")


def rollup_counts(table: DataFrame, key: str) -> DataFrame:
    """G17 second level: re-sum the hour x weekday counts to one key (a tiny table)."""
    return table.groupBy(key).agg(F.sum("txn_count").alias("txn_count")).orderBy(key)


# ---------------------------------------------------------------- errors and dark web

def top_errors(txn: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent error texts."""
    counts = txn.where(F.col("errors").isNotNull()).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, "n", "errors", n)


def dark_web_share(cards: DataFrame, keep_null: bool = True) -> DataFrame:
    """Cards per dark-web flag and share in percent (SQL keeps a NULL group)."""
    c = cards if keep_null else cards.where(F.col("card_on_dark_web").isNotNull())
    counts = c.groupBy("card_on_dark_web").agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(counts, "n", "pct")


# ---------------------------------------------------------------- demographic panels

def gender_mean(user_agg: DataFrame, value: str = "txn_count") -> DataFrame:
    """Mean of ``value`` per gender (NULL gender dropped)."""
    return user_agg.where(F.col("gender").isNotNull()).groupBy("gender").agg(F.avg(value).alias(f"mean_{value}"))


def cards_mean_spend(user_agg: DataFrame, n: int = 10) -> DataFrame:
    """Mean total spend per number of credit cards, first ``n`` keys ascending."""
    g = user_agg.where(F.col("num_credit_cards").isNotNull()).groupBy("num_credit_cards").agg(
        C.exact_sum("amount_sum").alias("_s"), C.exact_count("amount_sum").alias("_n")
    )
    return g.select("num_credit_cards", C.mean_from("_s", "_n").alias("mean_amount_sum")).orderBy(
        "num_credit_cards"
    ).limit(n)


def score_bin_mean(user_agg: DataFrame, bins: int = 5) -> DataFrame:
    """Mean amount per equal-width credit-score bin."""
    return binned_mean(user_agg, "credit_score", "amount_mean", bins)


def age_bin_mean(user_agg: DataFrame, bins: int = 6) -> DataFrame:
    """Mean amount per equal-width age bin."""
    return binned_mean(user_agg, "current_age", "amount_mean", bins)


# ---------------------------------------------------------------- dataset summaries

def _long(row_df: DataFrame, items: list[tuple[str, str, str]]) -> DataFrame:
    cells = [F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"))
             for s, m, c in items]
    return row_df.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*")


def dataset_summary(txn: DataFrame) -> DataFrame:
    """Dataset summary as (section, metric, value).

    The five columns are written once: every part below reads them, and a plan
    that joins tables into its transactions would else repeat the joins for each.
    Each entity is grouped once (map-side partial aggregation); its distinct
    count is the number of groups and its top count the largest group, so no
    separate distinct-count pass is needed.  The per-user counts feed three
    passes (moments, and the two passes of the exact median) and are small
    (one row per user), so they are materialised once.  Every part ends as a
    one-row aggregate; the rows are combined by one-row cross joins.
    """
    from ..session import materialize

    amt = C.lenient_number(F.col("amount_usd").cast("string")) if dict(txn.dtypes)["amount_usd"] == "string" \
        else C.nan_to_null(F.col("amount_usd").cast("double"))
    t = materialize(txn.select("client_id", "card_id", "merchant_id", "mcc", amt.alias("amount")))
    base = t.agg(
        F.count(F.lit(1)).alias("rows"),
        C.mean_from(C.exact_sum("amount"), C.exact_count("amount")).alias("mean"),
        F.stddev_samp("amount").alias("std"),
        F.min("amount").alias("min"),
        F.max("amount").alias("max"),
    )
    med = exact_quantile(t, "amount", 0.5, out="median")

    def groups(key: str):
        return t.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    per_user = materialize(groups("client_id"))
    users = per_user.agg(F.count(F.lit(1)).alias("users"), F.avg("n").alias("u_mean"), F.max("n").alias("u_max"))
    u_med = exact_quantile(per_user, "n", 0.5, out="u_median")
    cards = groups("card_id").agg(F.count(F.lit(1)).alias("cards"))
    merchants = groups("merchant_id").agg(F.count(F.lit(1)).alias("merchants"), F.max("n").alias("top_merchant"))
    mccs = groups("mcc").agg(F.count(F.lit(1)).alias("mccs"), F.max("n").alias("top_mcc"))
    row = base.crossJoin(med).crossJoin(users).crossJoin(u_med).crossJoin(cards).crossJoin(merchants).crossJoin(mccs)
    return _long(row, [
        ("transactions", "total_transactions", "rows"), ("transactions", "unique_users", "users"),
        ("transactions", "unique_cards", "cards"), ("amount", "mean", "mean"), ("amount", "median", "median"),
        ("amount", "std", "std"), ("amount", "min", "min"), ("amount", "max", "max"),
        ("users", "total_users", "users"), ("users", "avg_txns_per_user", "u_mean"),
        ("users", "median_txns_per_user", "u_median"), ("users", "max_txns_per_user", "u_max"),
        ("merchants", "unique_merchants", "merchants"), ("merchants", "top_merchant_txn_count", "top_merchant"),
        ("mcc", "unique_mcc", "mccs"), ("mcc", "top_mcc_txn_count", "top_mcc"),
    ])


def dataset_summary_sql_style(txn: DataFrame, cards: DataFrame, user_agg: DataFrame | None = None,
                              anomalies: DataFrame | None = None) -> DataFrame:
    """Totals, error share, dark-web cards, users and (optionally) anomalies.

    ``txn`` is the SQL-style transactions view (F1 applied, ``has_error``); the two columns that three
    passes read are written once.
    """
    from ..session import materialize

    t = materialize(txn.select(C.nan_to_null(F.col("amount_usd").cast("double")).alias("amount"), "has_error"))
    base = t.agg(
        F.count(F.lit(1)).alias("n"),
        C.mean_from(C.exact_sum("amount"), C.exact_count("amount")).alias("avg"),
        F.sum("has_error").alias("err_n"),
        (F.avg("has_error") * F.lit(100.0)).alias("err_pct"),
    )
    med = exact_quantile(t, "amount", 0.5, out="med")
    dark = pick(cards, "card_on_dark_web")
    dk = cards.agg(F.sum(dark_web_flag(dark)).alias("dark_n"))
    row = base.crossJoin(med).crossJoin(dk)
    items = [("transactions", "total_transactions", "n"), ("transactions", "avg_amount", "avg"),
             ("transactions", "median_amount", "med"), ("errors", "transactions_with_error", "err_n"),
             ("errors", "error_pct", "err_pct"), ("cards", "cards_on_dark_web", "dark_n")]
    if user_agg is not None:
        row = row.crossJoin(user_agg.agg(F.countDistinct("user_id").alias("users_n")))
        items.append(("users", "unique_users", "users_n"))
    if anomalies is not None:
        a = anomalies.agg(F.count_if(F.col("anomaly") == -1).alias("anom_n"), F.count(F.lit(1)).alias("anom_tot"))
        row = row.crossJoin(a).withColumn("anom_pct", F.col("anom_n") * F.lit(100.0) / F.col("anom_tot"))
        items += [("anomalies", "anomalous_users", "anom_n"), ("anomalies", "anomalous_pct", "anom_pct")]
    return _long(row, items)
