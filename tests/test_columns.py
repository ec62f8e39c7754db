"""Scalar column functions on edge rows (FIXTURES §2, SURVEY §4.3 traps)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlens.functions import columns as C


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("$-77.00", Decimal("-77.00")), ("$1,234.56", Decimal("1234.56")), ("$0.00", Decimal("0.00")),
    (" $5.10 ", Decimal("5.10")), ("\t$3.00\n", Decimal("3.00")),
])
def test_parse_currency(spark, text, expected):
    assert one(spark, C.parse_currency("v"), text) == expected


def test_parse_currency_strict_and_lenient(spark):
    assert one(spark, C.parse_currency("v", strict=False), "abc") is None
    with pytest.raises(Exception):
        spark.createDataFrame([("abc",)], "v string").select(C.parse_currency("v")).collect()


@pytest.mark.parametrize("text,expected", [("58523.0", "58523"), ("123.0", "00123"), ("123456", "123456"),
                                           (None, None), ("7", "00007")])
def test_parse_zip_pads_but_never_truncates(spark, text, expected):
    assert one(spark, C.parse_zip("v"), text) == expected


@pytest.mark.parametrize("text,expected", [("12/2022", dt.date(2022, 12, 1)), ("2/2022", dt.date(2022, 2, 1)),
                                           ("13/2022", None), ("junk", None)])
def test_parse_month_year(spark, text, expected):
    assert one(spark, C.parse_month_year("v"), text) == expected


@pytest.mark.parametrize("text,expected", [("YES", True), (" no ", False), ("maybe", None), ("Yes", True),
                                           (None, None)])
def test_parse_yes_no(spark, text, expected):
    assert one(spark, C.parse_yes_no("v"), text) is expected


def test_lenient_timestamp(spark):
    assert one(spark, C.lenient_timestamp("v"), "garbage") is None
    assert one(spark, C.lenient_timestamp("v"), "2010-01-01 00:01:00") == dt.datetime(2010, 1, 1, 0, 1)


def test_whole_days_not_calendar_days(spark):
    df = spark.createDataFrame([(dt.datetime(2010, 1, 1, 23), dt.datetime(2010, 1, 2, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(C.whole_days_between("a", "b").alias("d"), F.datediff("b", "a").alias("cal")).first()
    assert r["d"] == 0 and r["cal"] == 1


def test_weekday_conventions(spark):
    monday = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(monday,)], "t timestamp_ntz")
    r = df.select(C.weekday_mon0("t").alias("a"), C.weekday_sun0("t").alias("b"),
                  C.weekday_label("t").alias("c"), C.month_start("t").alias("m")).first()
    assert (r["a"], r["b"], r["c"], r["m"]) == (0, 1, "Mon", dt.date(2024, 1, 1))


def test_trim_ws_strips_tabs(spark):
    assert one(spark, C.trim_ws("v"), "\t a \n") == "a"


def test_ratios_never_raise(spark):
    df = spark.createDataFrame([(5.0, 0.0), (None, 2.0)], "a double, b double")
    rows = df.select(C.eps_ratio("a", "b").alias("e"), C.nullif_ratio("a", "b").alias("n")).collect()
    assert rows[0]["e"] == pytest.approx(5e6) and rows[0]["n"] is None
    assert rows[1]["e"] == 0.0 and rows[1]["n"] is None


def test_location_key_null_propagates(spark):
    df = spark.createDataFrame([(" rome ", "it"), ("x", None)], "c string, s string")
    got = [r["k"] for r in df.select(C.location_key("c", "s").alias("k")).collect()]
    assert got == ["ROME|IT", None]


def test_normalise_missing_tokens_and_nan(spark):
    df = spark.createDataFrame([("NA", float("nan")), ("ok", 1.0)], "s string, x double")
    rows = C.normalise_missing(df).collect()
    assert rows[0]["s"] is None and rows[0]["x"] is None and rows[1]["s"] == "ok"


def test_join_year_month_in_place(spark):
    df = spark.createDataFrame([(1, 1980, 2, "F")], "id int, birth_year int, birth_month int, g string")
    out = C.join_year_month(df, "birth_year", "birth_month", "birth_date")
    assert out.columns == ["id", "birth_date", "g"]
    assert out.first()["birth_date"] == dt.date(1980, 2, 1)


def test_narrow_ints(spark):
    df = spark.createDataFrame([(1, 100000), (2, -5)], "a long, b long")
    out = C.narrow_ints(df, ["a", "b"])
    assert dict(out.dtypes) == {"a": "tinyint", "b": "int"}


def test_exact_std_matches_definition(spark):
    import statistics

    vals = [10.25, 3.5, 7.75, 1000.01]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = df.agg(C.exact_sum("x").alias("s"), C.sample_std("x").alias("sd"), F.count("x").alias("n")).select(
        "sd", C.mean_from("s", "n").alias("m")).first()
    assert r["sd"] == pytest.approx(statistics.stdev(vals), rel=1e-12)
    assert r["m"] == pytest.approx(statistics.mean(vals), rel=1e-15)
    single = spark.createDataFrame([(1.0,)], "x double").agg(C.sample_std("x").alias("sd")).first()
    assert single["sd"] is None


def test_std_of_large_close_amounts_and_sub_cent_sums(spark):
    close = spark.range(200_000).select((F.lit(1_000_000.0) + F.col("id") % 2 * 0.01).alias("x"))
    assert close.agg(C.sample_std("x").alias("sd")).first()["sd"] == pytest.approx(0.0050, abs=1e-4)
    small = spark.createDataFrame([(0.004,), (0.004,), (0.004,), (None,), (float("nan"),), (-0.5,)], "x double")
    r = small.where("x > 0 or x is null").agg(C.exact_sum("x").alias("s"), C.exact_count("x").alias("n")).first()
    assert float(r["s"]) == 0.012 and r["n"] == 3
    assert float(small.agg(C.exact_sum("x").alias("s")).first()["s"]) == pytest.approx(-0.488)


@pytest.mark.parametrize("values, want", [
    ([float("inf"), 1.0], float("inf")), ([1e20, 1.0], 1e20), ([9e18] * 3, 2.7e19), ([4e-7] * 3, 1.2e-6), ([float("-inf"), None], float("-inf")),
    ([1.5e9, 0.25], 1500000000.25), ([None, float("nan")], None), ([-0.1, 0.1, 123456789.01], 123456789.01), ([1e308, 5.0], 1e308)])
def test_no_amount_ends_a_sum(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.agg(C.exact_sum("x").alias("s"), C.exact_count("x").alias("n")).select("s", C.mean_from("s", "n").alias("m")).first()
    assert got["s"] == (want if want is None else pytest.approx(want, rel=1e-15))
    assert (got["m"] is None) == (want is None)


def test_both_infinities_give_nan_and_cents_stay_exact(spark):
    import math

    df = spark.createDataFrame([(float("inf"),), (float("-inf"),)], "x double")
    assert math.isnan(df.agg(C.exact_sum("x").alias("s")).first()["s"])
    cents = spark.range(100_000).select((F.pmod(F.col("id") * 7919, F.lit(10_000_019)) / 100).alias("x"), F.pmod(F.col("id"), F.lit(3)).alias("g"))
    want = sum(k * 7919 % 10_000_019 for k in range(100_000)) / 100
    for parts in (1, 7):
        assert cents.repartition(parts).agg(C.exact_sum("x").alias("s")).first()["s"] == want
