"""Shape the driver's star-schema tables like the card-payment domain tables.

These are the inputs every registered query starts from, so their work grows
with the driver tables.  The shapes follow FIXTURES.md §4; the same shapes are
spelled in SQL for the oracle in ``spendlens.plans.oracle``.

``txn`` joins only the dimensions whose columns are asked for: lineitem keys
are foreign keys into orders/supplier/part and dimension keys are unique, so a
join that contributes no column cannot change the rows (classic join
elimination).  That keeps the biggest table to one shuffle in most plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TXN_COLUMNS = (
    "transaction_id", "date", "client_id", "card_id", "amount_usd", "transaction_type",
    "merchant_id", "merchant_city", "merchant_state", "mcc", "errors",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region, 25 rows by definition of the schema."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


def txn(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """Card transactions: one row per line item (transaction_id is not unique)."""
    want = list(TXN_COLUMNS if columns is None else columns)
    li = table(spark, sf_dir, "lineitem")
    exprs = {
        "transaction_id": (F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        "card_id": F.col("l_orderkey"),
        "amount_usd": F.col("l_extendedprice"),
        "transaction_type": F.when(F.col("l_linestatus") == "F", F.lit("Chip Transaction")).otherwise(
            F.lit("Swipe Transaction")
        ),
        "merchant_id": F.col("l_suppkey"),
        "errors": F.when(F.col("l_returnflag") == "R", F.lit("Insufficient Balance")).when(
            (F.col("l_returnflag") == "A") & (F.col("l_quantity") < 5), F.lit("Bad PIN")
        ),
    }
    df = li
    if {"date", "client_id"} & set(want):
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
        df = df.join(o, df.l_orderkey == o.o_orderkey)
        exprs["date"] = F.col("o_orderdate")
        exprs["client_id"] = F.col("o_custkey")
    if {"merchant_city", "merchant_state"} & set(want):
        sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        # nation x region has a fixed 25 rows: a proven bound, safe to broadcast.
        sup = sup.join(F.broadcast(_geo(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
        df = df.join(sup, df.l_suppkey == sup.s_suppkey)
        exprs["merchant_city"] = F.col("n_name")
        exprs["merchant_state"] = F.when(F.col("n_nationkey") % 5 == 0, F.lit(None).cast("string")).otherwise(
            F.col("r_name")
        )
    if "mcc" in want:
        p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
        df = df.join(p, df.l_partkey == p.p_partkey)
        exprs["mcc"] = F.col("p_size")
    return df.select(*[exprs[c].alias(c) for c in want])


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("card_id"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_totalprice").alias("credit_limit_usd"),
        (F.col("o_orderstatus") == "P").alias("card_on_dark_web"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        k.alias("id"),
        F.when(nk % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.when(k % 97 != 0, (F.lit(300) + k % 551).cast("int")).alias("credit_score"),
        (F.col("c_acctbal") * 10).alias("yearly_income"),
        F.col("c_acctbal").alias("total_debt"),
        (F.col("c_acctbal") / 2).alias("per_capita_income"),
        (F.lit(1) + nk % 9).cast("int").alias("num_credit_cards"),
        (F.lit(18) + k % 70).cast("int").alias("current_age"),
        (F.lit(60) + k % 10).cast("int").alias("retirement_age"),
    )


def event_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("transaction_id"),
        F.col("ts").alias("date"),
        F.col("user_id").alias("client_id"),
        F.col("value").alias("amount_usd"),
        F.when(F.col("event_type") == "error", F.lit("error")).alias("errors"),
    )


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card rows in raw text form, for the parse operators."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    return o.select(
        k.alias("id"),
        F.col("o_custkey").alias("client_id"),
        F.when(k % 7 == 0, F.concat(F.lit("$-"), price, F.lit(" ")))
        .when(k % 11 == 0, F.concat(F.lit(" $1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".50")))
        .otherwise(F.concat(F.lit("$"), price))
        .alias("amount"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat((k % 99999).cast("string"), F.lit(".0")))
        .alias("zip"),
        F.concat(
            F.month("o_orderdate").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string")
        ).alias("expires"),
        F.when(F.col("o_orderstatus") == "F", F.lit(" yes"))
        .when(F.col("o_orderstatus") == "O", F.lit("NO"))
        .otherwise(F.lit("unknown"))
        .alias("has_chip"),
        F.when(k % 17 == 0, F.lit("garbage"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("opened"),
    )


def city_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation; the key of each third one names a state that no transaction has, so the city level misses."""
    g = _geo(spark, sf_dir)
    state = F.when(F.col("n_nationkey") % 3 == 0, F.lit("elsewhere")).otherwise(F.col("r_name"))
    return g.select(
        F.upper(F.concat(F.col("n_name"), F.lit("|"), state)).alias("city_state"),
        (F.lit(20) + F.col("n_nationkey") * 1.5).cast("double").alias("lat"),
        (F.lit(-130) + F.col("n_nationkey") * 3.0).cast("double").alias("lon"),
    )


def state_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region; one goes by a name that no transaction has, so the state level misses too."""
    r = table(spark, sf_dir, "region")
    return r.select(
        F.when(F.col("r_regionkey") == 3, F.lit("elsewhere")).otherwise(F.col("r_name")).alias("state"),
        (F.lit(30) + F.col("r_regionkey") * 4).cast("double").alias("lat"),
        (F.lit(-120) + F.col("r_regionkey") * 9).cast("double").alias("lon"),
    )


def labels_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraud labels of all orders (cards); those of the lowest priority are not known (NULL)."""
    o = table(spark, sf_dir, "orders")
    known = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority") == "1-URGENT")
    return o.select(F.col("o_orderkey").alias("id"), known.alias("fraud"))


def mcc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code -> description, one row per part size."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_size").agg(F.min("p_type").alias("description")).select(
        F.col("p_size").alias("id"), "description"
    )
