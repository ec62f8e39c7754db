"""Batch stages: raw files -> typed Parquet -> cleaned Parquet.

Each table is one Spark job reading its source, applying column functions
(codegen'd) and writing through the commit protocol; a stage skips tables
whose output exists unless ``force`` is set.  The cleaned tables are the
written, lineage-free inputs of every later report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.quality import assert_no_missing
from ..sources import files as IO
from ..sources import schemas as S

RAW_FILES = {
    "transactions": "transactions_data.csv",
    "users": "users_data.csv",
    "cards": "cards_data.csv",
    "mcc_codes": "mcc_codes.json",
    "fraud_labels": "train_fraud_labels.json",
}


# ---------------------------------------------------------------- P1 typing

def type_transactions(raw: DataFrame, *beside: Column) -> DataFrame:
    """Raw text transactions -> typed (dates lenient, money strict), with the columns ``beside``."""
    return raw.select(
        F.col("id").cast("long").alias("id"),
        C.lenient_timestamp("date").alias("date"),
        F.col("client_id").cast("long").alias("client_id"),
        F.col("card_id").cast("long").alias("card_id"),
        C.parse_currency("amount").alias("amount"),
        F.col("use_chip"),
        F.col("merchant_id").cast("long").alias("merchant_id"),
        F.col("merchant_city"),
        F.col("merchant_state"),
        C.parse_zip("zip").alias("zip"),
        F.col("mcc").cast("int").alias("mcc"),
        F.col("errors"),
        *beside,
    )


def type_users(raw: DataFrame, *beside: Column) -> DataFrame:
    ints = ["current_age", "retirement_age", "birth_year", "birth_month", "credit_score", "num_credit_cards"]
    money = ["per_capita_income", "yearly_income", "total_debt"]
    cols = []
    for f in S.RAW_USERS.fields:
        c = f.name
        if c == "id":
            cols.append(F.col(c).cast("long").alias(c))
        elif c in ints:
            cols.append(C.trim_ws(c).cast("int").alias(c))
        elif c in money:
            cols.append(C.parse_currency(c).alias(c))
        elif c in ("latitude", "longitude"):
            cols.append(C.trim_ws(c).cast("double").alias(c))
        else:
            cols.append(F.col(c))
    return raw.select(*cols, *beside)


def type_cards(raw: DataFrame, *beside: Column) -> DataFrame:
    return raw.select(
        F.col("id").cast("long").alias("id"),
        F.col("client_id").cast("long").alias("client_id"),
        "card_brand", "card_type", "card_number",
        C.parse_month_year("expires").alias("expires"),
        C.trim_ws("cvv").cast("int").alias("cvv"),
        C.parse_yes_no("has_chip").alias("has_chip"),
        C.trim_ws("num_cards_issued").cast("int").alias("num_cards_issued"),
        C.parse_currency("credit_limit").alias("credit_limit"),
        C.parse_month_year("acct_open_date").alias("acct_open_date"),
        C.trim_ws("year_pin_last_changed").cast("int").alias("year_pin_last_changed"),
        C.parse_yes_no("card_on_dark_web").alias("card_on_dark_web"),
        *beside,
    )


def _text(spark: SparkSession, path: str, schema, malformed: str = "raise") -> DataFrame:
    raw = C.normalise_missing(IO.read_csv_text(spark, path, malformed))
    return raw.select(*[F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string").alias(f.name)
                        for f in schema.fields])


#: The CSV tables: how they are typed, and their raw columns.
CSV_TABLES = {"transactions": (type_transactions, S.RAW_TRANSACTIONS), "users": (type_users, S.RAW_USERS),
              "cards": (type_cards, S.RAW_CARDS)}


class Written(dict):
    """Table -> written?, with what the write pass counted of the CSV tables that it wrote: ``rows`` (table -> rows) and
    ``losses`` (table -> column -> values present in the text that typing turned into NULL)."""

    def __init__(self):
        super().__init__()
        self.rows: dict[str, int] = {}
        self.losses: dict[str, dict[str, int]] = {}


def _watched(raw: DataFrame, typed: DataFrame, watch: Observation) -> DataFrame:
    """``typed``, made of ``raw`` by column functions alone, with its rows and losses counted while it is written."""
    names = [f.name for f in typed.schema.fields if f.dataType != T.StringType() and f.name in raw.columns]
    lost = [F.count_if(F.col(f"_raw.`{c}`").isNotNull() & F.col(f"`{c}`").isNull()).alias(c) for c in names]
    return typed.observe(watch, F.count(F.lit(1)).alias("_rows"), *lost).drop("_raw")


def preprocess(spark: SparkSession, in_dir: str, out_dir: str, force: bool = False, quarantine: bool = False) -> Written:
    """Five raw files -> typed Parquet; returns table -> written?, with rows and losses per column (D12) observed in the
    same pass.

    A malformed CSV row ends the stage; with ``quarantine`` such rows go to ``<table>_malformed.parquet`` beside the
    table instead (reason, text, file, fields), so that rows in = rows out + rows quarantined.
    """
    done = Written()
    for name, (typing, schema) in CSV_TABLES.items():
        source = f"{in_dir}/{RAW_FILES[name]}"
        if quarantine:
            IO.write_table(IO.malformed_csv(spark, source), f"{out_dir}/{name}_malformed.parquet", force)
        raw, watch = _text(spark, source, schema, "drop" if quarantine else "raise"), Observation(name)
        typed = typing(raw, F.struct(*raw.columns).alias("_raw"))
        done[name] = IO.write_table(_watched(raw, typed, watch), f"{out_dir}/{name}.parquet", force)
        if done[name]:
            counted = dict(watch.get)
            done.rows[name] = counted.pop("_rows")
            done.losses[name] = counted
    done["mcc_codes"] = IO.write_table(IO.read_json_map(spark, f"{in_dir}/{RAW_FILES['mcc_codes']}"),
                                       f"{out_dir}/mcc_codes.parquet", force)
    done["fraud_labels"] = IO.write_table(IO.read_labelled_map(spark, f"{in_dir}/{RAW_FILES['fraud_labels']}"),
                                          f"{out_dir}/fraud_labels.parquet", force)
    return done


def coercion_report(spark: SparkSession, in_dir: str) -> DataFrame:
    """Values present in the raw text that typing turned into NULL, per column."""
    from ..operators.quality import coercion_losses

    raw_t = _text(spark, f"{in_dir}/{RAW_FILES['transactions']}", S.RAW_TRANSACTIONS, "drop")
    raw_c = _text(spark, f"{in_dir}/{RAW_FILES['cards']}", S.RAW_CARDS, "drop")
    t = coercion_losses(raw_t, {"date": C.lenient_timestamp("date")}).withColumn("table", F.lit("transactions"))
    c = coercion_losses(raw_c, {"expires": C.parse_month_year("expires"), "has_chip": C.parse_yes_no("has_chip"),
                                "acct_open_date": C.parse_month_year("acct_open_date"),
                                "card_on_dark_web": C.parse_yes_no("card_on_dark_web")}).withColumn(
        "table", F.lit("cards"))
    return t.unionByName(c)


# ---------------------------------------------------------------- P2 cleanup

def clean_cards(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"id": "card_id", "credit_limit": "credit_limit_usd"}).withColumns(
        {"expires": C.to_date("expires"), "acct_open_date": C.to_date("acct_open_date")})


def clean_transactions(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"id": "transaction_id", "amount": "amount_usd", "use_chip": "transaction_type"})


def clean_users(df: DataFrame) -> DataFrame:
    out = C.join_year_month(df.drop("current_age"), "birth_year", "birth_month", "birth_date")
    return out.drop("address", "latitude", "longitude").withColumnsRenamed({
        "per_capita_income": "per_capita_income_usd", "yearly_income": "yearly_income_usd",
        "total_debt": "total_debt_usd"})


def cleanup(spark: SparkSession, in_dir: str, out_dir: str, force: bool = False) -> dict[str, bool]:
    """rename/derive, assert completeness (G32), write.  Raises ``ValueError`` on missing values."""
    steps = {
        "cards": (clean_cards, ()),
        "mcc_codes": (lambda d: d, ()),
        "fraud_labels": (lambda d: d, ()),
        "transactions": (clean_transactions, ("merchant_state", "zip", "errors")),
        "users": (clean_users, ()),
    }
    done = {}
    for name, (fn, skip) in steps.items():
        out = f"{out_dir}/{name}.parquet"
        if not force and IO.is_committed(spark, out):
            done[name] = False
            continue
        df = fn(spark.read.parquet(f"{in_dir}/{name}.parquet"))
        assert_no_missing(df, skip)
        done[name] = IO.write_table(df, out, force=True)
    return done


def run_pipeline(spark: SparkSession, raw_dir: str, work_dir: str, force: bool = False,
                 reports_dir: str | None = None, as_of=None, quarantine: bool = False) -> dict:
    """Preprocess -> cleanup -> (optional) all reports; ages as of the day ``as_of``."""
    result = {"preprocess": preprocess(spark, raw_dir, f"{work_dir}/preprocessed", force, quarantine),
              "cleanup": cleanup(spark, f"{work_dir}/preprocessed", f"{work_dir}/cleaned", force)}
    if reports_dir is not None:
        from .analysis import SpendAnalysis

        status = SpendAnalysis(spark, f"{work_dir}/cleaned", as_of=as_of).run_reports(reports_dir, force=force)
        result["reports"] = {r["report"]: r["status"] for r in status.collect()}
    return result
