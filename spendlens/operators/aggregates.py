"""Entity aggregates.

Each aggregate is a single ``groupBy().agg()`` over the transactions: Spark
runs it as map-side partial aggregation + one shuffle on the group key, so a
hot key (a merchant or user holding a large share of rows) reaches the
reducer as one partial row per map task, not as its raw rows.  Money sums
are exact decimals, so results do not depend on partitioning or retries.

Group keys that are NULL are dropped before aggregation, as the reference's
frame ``groupby`` does (F8); the SQL-style user aggregate keeps SQL semantics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .quantiles import exact_quantile

CHIP_COLUMNS = ("use_chip", "trasaction_type", "transaction_type")
USER_ATTRS = ("current_age", "gender", "credit_score", "per_capita_income", "yearly_income", "total_debt",
              "num_credit_cards")
SQL_USER_ATTRS = ("credit_score", "yearly_income", "total_debt", "per_capita_income", "num_credit_cards",
                  "current_age", "retirement_age")


def pick(df: DataFrame, *aliases: str) -> str | None:
    """First of ``aliases`` present in ``df`` (plan-time, no job)."""
    return next((c for c in aliases if c in df.columns), None)


def _money_aggs(amount: str, prefix: str = "amount") -> list:
    return [
        C.exact_sum(amount).alias("_s"),
        C.sample_std(amount).alias("_sd"),
        C.exact_count(amount).alias("_na"),
    ]


def _money_cols(prefix: str = "amount", mean: bool = True, std: bool = True, total: bool = True) -> list:
    out = []
    if total:
        out.append(F.coalesce(C.money("_s"), F.lit(0.0)).alias(f"{prefix}_sum"))
    if mean:
        out.append(C.mean_from("_s", "_na").alias(f"{prefix}_mean"))
    if std:
        out.append(F.col("_sd").alias(f"{prefix}_std"))
    return out


def _pct(k: str, n: str):
    return (F.col(k).cast("double") / F.col(n)) * F.lit(100.0)


# ---------------------------------------------------------------- G9 card aggregate (J4 folded)

def card_aggregate(cards: DataFrame, client_col: str = "client_id") -> DataFrame:
    """Per user: mean credit limit over their cards and number of cards."""
    limit = pick(cards, "credit_limit_usd", "credit_limit")
    return (
        cards.where(F.col(client_col).isNotNull())
        .groupBy(client_col)
        .agg(C.exact_sum(limit).alias("_s"), C.exact_count(limit).alias("_n"), F.count(F.lit(1)).alias("num_cards"))
        .select(
            F.col(client_col).alias("user_id"),
            C.mean_from("_s", "_n").alias("avg_credit_limit"),
            "num_cards",
        )
    )


def user_attributes(users: DataFrame, names: tuple = USER_ATTRS) -> DataFrame:
    """J2 input: user id + the attribute columns present (either naming, D2)."""
    key = pick(users, "id", "user_id")
    cols = [F.col(key).alias("user_id")]
    for a in names:
        src = pick(users, a, f"{a}_usd")
        if src is not None:
            cols.append(F.col(src).alias(a))
    return users.select(*cols)


def with_current_age(users: DataFrame, as_of) -> DataFrame:
    """``current_age`` in whole years as of a day, from ``birth_date`` (D2); an age that is there already stays."""
    if "current_age" in users.columns or "birth_date" not in users.columns:
        return users
    months = F.months_between(F.lit(as_of).cast("date"), F.col("birth_date"))
    return users.withColumn("current_age", F.floor(months / 12).cast("int"))


# ---------------------------------------------------------------- G1 user aggregate

def median_per_group(df: DataFrame, key: str, value: str, out: str, strategy: str = "builtin") -> DataFrame:
    """Median of ``value`` per ``key`` (NULL keys dropped): exact with ``builtin`` (per-group value
    map), ``distributed`` (window over a group's distinct values) or ``split`` (groups also cut into
    global value buckets, for groups holding a large share of all rows); ``approx`` is a sketch."""
    d = df.where(F.col(key).isNotNull()).select(key, F.col(value).cast("double").alias(value))
    if strategy in ("distributed", "split"):
        return exact_quantile(d, value, 0.5, [key], out, split=strategy == "split")
    if strategy == "approx":
        return d.groupBy(key).agg(F.percentile_approx(value, 0.5, 10000).cast("double").alias(out))
    return d.groupBy(key).agg(F.median(value).alias(out))


def user_aggregate(txn: DataFrame, users: DataFrame | None = None, cards: DataFrame | None = None, *,
                   median: str = "distributed", approx_distinct: bool = False, sort: bool = False) -> DataFrame:
    """G1 (+G6, G7, G8, C12, C20, C21, J2, J3, G9).

    ``median``: ``distributed`` (exact; ranks a user's distinct amounts in a
    spillable window, so even a user holding a third of all rows only costs a
    sort), ``builtin`` (exact ``median``: an in-memory value map per user,
    faster for small groups) or ``approx`` (fixed-size sketch).
    """
    amt = "amount_usd"
    t = txn.where(F.col("client_id").isNotNull())
    chip = pick(t, *CHIP_COLUMNS)
    has_err = "errors" in t.columns
    aggs = [
        F.count(F.lit(1)).alias("txn_count"),
        *_money_aggs(amt),
        F.min(C.nan_to_null(F.col(amt).cast("double"))).alias("amount_min"),  # Spark orders NaN above all
        F.max(C.nan_to_null(F.col(amt).cast("double"))).alias("amount_max"),
        F.min("date").alias("first_txn_date"),
        F.max("date").alias("last_txn_date"),
        (F.approx_count_distinct("merchant_id") if approx_distinct else F.countDistinct("merchant_id")).alias(
            "unique_merchants"
        ),
    ]
    if has_err:
        aggs.append(F.count("errors").alias("_nerr"))
    if chip:
        aggs.append(F.count_if(C.contains_chip(chip)).alias("_nchip"))
    # Sums, counts and the distinct count stay in one codegen'd HashAggregate (Spark plans the
    # distinct as a (user, merchant) pre-aggregation).  The median needs a value map per
    # group; kept in the same aggregate it would be pushed down to every (user, merchant)
    # pair, so it runs as its own aggregation and is joined back on the user key (both
    # sides are already hash-partitioned by it).
    g = t.groupBy("client_id").agg(*aggs)
    g = g.join(median_per_group(t, "client_id", amt, "amount_median", median), "client_id", "left")
    span = C.whole_days_between("first_txn_date", "last_txn_date")
    cols = [
        F.col("client_id").alias("user_id"),
        *_money_cols(),
        F.col("amount_median"),
        "amount_min", "amount_max", "first_txn_date", "last_txn_date", "txn_count",
        span.alias("txn_span_days"),
        C.per_day_rate("txn_count", span).alias("txn_frequency"),
    ]
    if has_err:
        cols.append(_pct("_nerr", "txn_count").alias("error_rate_pct"))
    if chip:
        cols.append(_pct("_nchip", "txn_count").alias("chip_usage_pct"))
    cols.append("unique_merchants")
    out = g.select(*cols)
    if users is not None:
        out = out.join(user_attributes(users), "user_id", "left")
    if cards is not None:
        out = out.join(card_aggregate(cards), "user_id", "left")
    return out.orderBy(F.desc("txn_count"), "user_id") if sort else out


# ---------------------------------------------------------------- G2 daily aggregate

def daily_aggregate(txn: DataFrame) -> DataFrame:
    day = F.to_date("date")
    t = txn.where(F.col("date").isNotNull())
    aggs = [F.count(F.lit(1)).alias("txn_count"), *_money_aggs("amount_usd")]
    has_err = "errors" in t.columns
    if has_err:
        aggs.append(F.count("errors").alias("_nerr"))
    g = t.groupBy(day.alias("date")).agg(*aggs)
    err = _pct("_nerr", "txn_count") if has_err else F.lit(0.0)
    return g.select("date", "txn_count", *_money_cols(), err.alias("error_rate_pct"))


# ---------------------------------------------------------------- G3/G4 merchant aggregate

def mode_per_group(df: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """Most frequent non-null ``value`` per ``key``; ties -> smallest value.

    Two aggregations: (key, value) counts with map-side combine, then the
    arg-max per key over those counts (one small struct per distinct value).
    """
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    best = F.min(F.struct((-F.col("_n")).alias("neg_n"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.getField("v").alias(out or value))


def distinct_count(df: DataFrame, key: str, col: str, out: str, approx: bool = False) -> DataFrame:
    """Distinct non-null ``col`` values per ``key``: dedupe (key, col) pairs, then count.

    The pairs shuffle on (key, col), so a hot key is spread over many tasks;
    the final count is partially aggregated."""
    d = df.where(F.col(key).isNotNull())
    if approx:
        return d.groupBy(key).agg(F.approx_count_distinct(col).alias(out))
    pairs = d.where(F.col(col).isNotNull()).select(key, col).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def value_counts(df: DataFrame, key: str, cols: list[str], salts: dict[str, Column] | None = None) -> DataFrame:
    """Rows per (``key``, column, value) of several columns from one scan: (key, ``_col``: place in ``cols``, the columns,
    all but that one NULL, ``_n``).  NULL values give no row.

    Most pairs of a key and an id are met once or twice, so combining them in the scan tasks would only fill memory: every
    unfolded row travels, in its few bytes, to one of ``spark.sql.shuffle.partitions`` tasks by (key, column, value), where it
    meets its like.  That number is asked for outright: small partitions must not be put together here, as a task holds all
    its distinct pairs.  A hot key is spread over many tasks.  A column whose single values hold a large share of the rows
    gets an expression in ``salts``, which parts the rows of one value further; its counts then come as several rows to add up.
    Exact and mergeable: counts of parts of a table add up.
    """
    salts = salts or {}
    named = [F.struct(F.col(key).alias(key), F.lit(i).alias("_col"),
                      *[(F.col(c) if c == x else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in cols],
                      salts.get(x, F.lit(0)).cast("int").alias("_salt")) for i, x in enumerate(cols)]
    pairs = df.where(F.col(key).isNotNull()).select(F.inline(F.array(*named)))
    pairs = pairs.where(F.greatest(F.lit(False), *[F.col(c).isNotNull() for c in cols]))
    by = [key, "_col", *cols, "_salt"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, *by).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).drop("_salt")


CITY_SALTS = 64


def merchant_aggregate(txn: DataFrame, *, approx_distinct: bool = False, sort: bool = False) -> DataFrame:
    """G3 (+G4, G8).  Two scans: one for the money, one for all the counts of values (``value_counts``), from which follow both
    distinct counts and the most frequent city (ties to the smallest).  The counts shrink to one row per (merchant, city), with
    the numbers of ids in the row without a city, before anything is sorted by merchant.  Bitmaps of ids would take 4 KB per
    merchant and block of 32,768 ids, however few a merchant meets, so the pairs are counted instead.  ``approx_distinct``
    takes sketches."""
    t = txn.where(F.col("merchant_id").isNotNull())
    sketches = {"unique_customers": "client_id", "unique_cards": "card_id"} if approx_distinct else {}
    g = t.groupBy("merchant_id").agg(*_money_aggs("amount_usd"), F.count(F.lit(1)).alias("txn_count"),
                                     *[F.approx_count_distinct(c).alias(n) for n, c in sketches.items()])
    out = g.select("merchant_id", *_money_cols(), "txn_count", *sketches)
    city = ["merchant_city"] if "merchant_city" in t.columns else []
    ids = {} if approx_distinct else {"unique_customers": "client_id", "unique_cards": "card_id"}
    cols = [*ids.values(), *city]
    if cols:
        salts = {c: F.pmod(F.xxhash64("client_id", "card_id"), F.lit(CITY_SALTS)) for c in city}
        sums = value_counts(t, "merchant_id", cols, salts).groupBy("merchant_id", *city).agg(
            *[F.count_if(F.col("_col") == i).alias(n) for i, n in enumerate(ids)],
            *[F.sum(F.when(F.col("_col") == len(ids), F.col("_n"))).alias("_n") for _ in city])
        best = F.min(F.when(F.col("_n").isNotNull(), F.struct((-F.col("_n")).alias("k"), F.col("merchant_city").alias("v"))))
        counts = sums.groupBy("merchant_id").agg(*[F.sum(n).alias(n) for n in ids],
                                                 *[best.getField("v").alias(c) for c in city])
        out = out.join(counts, "merchant_id", "left")
    out = out.select("merchant_id", "amount_sum", "amount_mean", "amount_std",
                     F.coalesce("unique_customers", F.lit(0)).alias("unique_customers"),
                     F.coalesce("unique_cards", F.lit(0)).alias("unique_cards"), "txn_count", *city)
    return out.orderBy(F.desc("txn_count"), "merchant_id") if sort else out


# ---------------------------------------------------------------- G5 MCC aggregate (+J8)

def mcc_aggregate(txn: DataFrame, mcc_codes: DataFrame | None = None, *, approx_distinct: bool = False,
                  sort: bool = False) -> DataFrame:
    t = txn.where(F.col("mcc").isNotNull())
    nd = F.approx_count_distinct if approx_distinct else F.countDistinct
    g = t.groupBy("mcc").agg(
        *_money_aggs("amount_usd"), nd("client_id").alias("unique_customers"), F.count(F.lit(1)).alias("txn_count")
    )
    out = g.select("mcc", *_money_cols(), "unique_customers", "txn_count")
    if mcc_codes is not None:
        out = mcc_lookup(out, mcc_codes)
    return out.orderBy(F.desc("txn_count"), "mcc") if sort else out


def mcc_lookup(df: DataFrame, mcc_codes: DataFrame, code_col: str = "mcc") -> DataFrame:
    """Attach the MCC description.  Spark's own size statistics (and AQE) choose the join."""
    codes = mcc_codes.select(F.col("id").alias("_mcc_id"), "description")
    return df.join(codes, F.col(code_col) == F.col("_mcc_id"), "left").drop("_mcc_id")


# ---------------------------------------------------------------- G10/G11 risk metrics

def risk_metrics(user_agg: DataFrame, quantile: float = 0.75) -> DataFrame:
    out = user_agg
    if {"amount_std", "amount_mean"} <= set(out.columns):
        out = out.withColumn("amount_volatility", C.eps_ratio("amount_std", "amount_mean"))
    if {"total_debt", "yearly_income"} <= set(out.columns):
        out = out.withColumn("debt_to_income", C.eps_ratio("total_debt", "yearly_income"))
    if "num_cards" in out.columns:
        out = out.withColumn("cards_per_user", C.zero_if_null("num_cards"))
    if "error_rate_pct" in out.columns:
        q = exact_quantile(user_agg, "error_rate_pct", quantile, out="_q75")
        # one row by construction: a cross join with it is a broadcast of one row
        out = out.crossJoin(F.broadcast(q)).withColumn(
            "high_error_rate", C.flag_above("error_rate_pct", F.col("_q75"))
        ).drop("_q75")
    if "current_age" in out.columns:
        out = out.withColumn("is_senior", C.flag_above("current_age", 65))
    return out


# ---------------------------------------------------------------- G20 SQL-style user aggregate

def sql_style_transactions(txn: DataFrame) -> DataFrame:
    """S11 transactions view: F1 required keys, used_chip and has_error flags."""
    chip = pick(txn, *CHIP_COLUMNS)
    used = F.when(F.lower(F.col(chip)).like("%chip%"), 1).otherwise(0) if chip else F.lit(0)
    return txn.where(
        F.col("client_id").isNotNull() & F.col("card_id").isNotNull() & F.col("amount_usd").isNotNull()
        & F.col("date").isNotNull()
    ).select(
        "*",
        used.cast("int").alias("used_chip"),
        F.when(F.col("errors").isNotNull(), 1).otherwise(0).cast("int").alias("has_error"),
    )


def dark_web_flag(c: str):
    """1 if the card was seen on the dark web (YES or TRUE in any case and padding), else 0: the one rule for it."""
    return F.when(F.upper(C.trim_ws(F.col(c).cast("string"))).isin("YES", "TRUE"), 1).otherwise(0)


def user_aggregate_inner(txn: DataFrame, users: DataFrame, cards: DataFrame) -> DataFrame:
    """Inner joins txn x users x cards, credit limit averaged over transactions.

    Transactions are first reduced to one row per (user, card) - partial
    aggregation spreads a hot user over its cards - and only then joined with
    the card and user dimensions, so the joins see one row per card instead
    of one per transaction.
    """
    t = sql_style_transactions(txn)
    per_card = t.groupBy("client_id", "card_id").agg(
        F.count(F.lit(1)).alias("_n"),
        C.exact_sum("amount_usd").alias("_s"),
        C.exact_count("amount_usd").alias("_na"),
        F.sum("has_error").alias("_err"),
        F.sum("used_chip").alias("_chip"),
    )
    limit = pick(cards, "credit_limit_usd", "credit_limit")
    cd = cards.select(
        F.col("card_id").alias("_cid"), F.col("client_id").alias("_uid"),
        C.fixed(limit).alias("_limit"), dark_web_flag("card_on_dark_web").alias("_dark"),
    )
    j = per_card.join(cd, (F.col("card_id") == F.col("_cid")) & (F.col("client_id") == F.col("_uid")))
    per_user = j.groupBy("client_id").agg(
        F.sum("_n").alias("txn_count"),
        C.exact_sum("_s").alias("_s"),
        F.sum("_na").alias("_na"),
        F.sum("_err").alias("total_errors"),
        F.sum("_chip").alias("_chip"),
        F.sum(F.col("_limit") * F.col("_n")).alias("_ls"),
        F.sum(F.when(F.col("_limit").isNotNull(), F.col("_n"))).alias("_ln"),
        F.max("_dark").alias("has_dark_web_card"),
    )
    ua = user_attributes(users, SQL_USER_ATTRS)
    attrs = [c for c in SQL_USER_ATTRS if c in ua.columns]
    out = per_user.join(ua, per_user.client_id == ua.user_id)
    return out.select(
        "user_id",
        "txn_count",
        C.mean_from("_s", "_na").alias("avg_amount"),
        "total_errors",
        (F.col("_chip").cast("double") / F.col("txn_count")).alias("chip_ratio"),
        *attrs,
        C.mean_from("_ls", "_ln").alias("txn_weighted_credit_limit"),
        F.col("has_dark_web_card").cast("int").alias("has_dark_web_card"),
    )


# ---------------------------------------------------------------- G21 location aggregate

def location_aggregate(txn: DataFrame, amount_col: str = "amount_usd", city_col: str = "merchant_city",
                       state_col: str = "merchant_state") -> DataFrame:
    amt = C.lenient_number(F.col(amount_col)) if dict(txn.dtypes)[amount_col] == "string" else F.col(amount_col)
    t = txn.select(F.col(city_col), F.col(state_col), amt.alias("_amt")).dropna(subset=[city_col, state_col, "_amt"])
    g = t.groupBy(city_col, state_col).agg(
        F.count("_amt").alias("txn_count"), C.exact_sum("_amt").alias("_s")
    )
    return g.select(city_col, state_col, "txn_count", C.mean_from("_s", "txn_count").alias("avg_amount"))
