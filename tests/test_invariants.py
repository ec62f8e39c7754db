"""Invariants: same answers under any shuffle partitioning; property tests
of the scalar parsers and the histogram against their Python/NumPy definitions."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from conftest import SF_SMALL
from spendlens.functions import columns as C
from spendlens.operators import stats as ST

PARTITION_QUERIES = ["user_agg", "merchant_agg", "risk_metrics", "dataset_summary", "monthly_median",
                     "user_agg_sql_style", "merchant_locations", "score_bin_mean", "correlation_matrix"]


@pytest.mark.parametrize("name", PARTITION_QUERIES)
def test_same_result_with_1_and_8_shuffle_partitions(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        b = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(0, 10**7).map(lambda i: f"{i}.0"),
                          st.text("0123456789", min_size=1, max_size=8)), min_size=1, max_size=20))
def test_parse_zip_is_strip_decimal_then_zfill(spark, zips):
    import re

    df = spark.createDataFrame([(z,) for z in zips], "z string")
    got = [r[0] for r in df.select(C.parse_zip("z")).collect()]
    want = [None if z is None else re.sub(r"\.\d+$", "", z).zfill(5) for z in zips]
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["", "-"]), st.integers(0, 10**8), st.sampled_from([" ", "", "\t"])),
                min_size=1, max_size=20))
def test_parse_currency_round_trip(spark, parts):
    from decimal import Decimal

    texts = [f"{pad}${sign}{cents // 100:,}.{cents % 100:02d}{pad}" for sign, cents, pad in parts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.parse_currency("t")).collect()]
    want = [Decimal(f"{sign}{cents // 100}.{cents % 100:02d}") for sign, cents, _ in parts]
    assert got == want


@SETTINGS
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False, width=64), min_size=1, max_size=60), st.integers(1, 30))
def test_histogram_property(spark, vals, bins):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    h = ST.histogram(df, "x", bins).orderBy("bin").toPandas()
    counts, edges = np.histogram(np.array(vals), bins=bins)
    assert h["frequency"].tolist() == counts.tolist()
    assert h["lo"].tolist() == pytest.approx(edges[:-1].tolist())


def test_session_helpers(spark):
    from spendlens.session import checkpoint_dir, materialize, shuffle_partitions_for

    assert checkpoint_dir(spark) is not None  # local mode: a scratch folder is allowed
    df = spark.range(10)
    assert materialize(df).count() == 10 and materialize(df, "cache").count() == 10
    assert shuffle_partitions_for(100 * 1024 ** 4) == 409600 and shuffle_partitions_for(1) == 200
