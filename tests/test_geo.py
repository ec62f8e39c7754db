"""Location report: fallback levels, dedupe, box filter, bubble sizes."""

import pytest
from pyspark.errors import AnalysisException

from spendlens.operators import geo as G


def test_geocode_levels_and_box(spark):
    rows = [("Austin", "TX", 10.0)] * 5 + [("Nowhere", "TX", 20.0)] * 3 + [("Rome", "Italy", 5.0)] * 2 + [
        ("Anchorage", "AK", 1.0)]
    txn = spark.createDataFrame(rows, "merchant_city string, merchant_state string, amount_usd double")
    cc = spark.createDataFrame([("AUSTIN|TX", 30.3, -97.7), ("AUSTIN|TX", 31.0, -97.0)],
                               "city_state string, lat double, lon double")
    out = {r["merchant_city"]: r for r in G.merchant_locations(txn, cc).collect()}
    assert out["Austin"]["geo_level"] == "city" and out["Austin"]["lat"] == 30.3  # deduped, smallest wins
    assert out["Nowhere"]["geo_level"] == "state" and out["Nowhere"]["lat"] == 31.5
    assert out["Rome"]["geo_level"] == "default" and out["Rome"]["lat"] == 39.5
    assert "Anchorage" not in out  # Alaska centre lies outside the box (D13)
    assert out["Austin"]["size_count"] == 800.0 and out["Rome"]["size_count"] == 20.0


def test_top_n_before_box(spark):
    rows = [("A", "AK", 1.0)] * 3 + [("B", "TX", 1.0)] * 2 + [("C", "TX", 1.0)]
    txn = spark.createDataFrame(rows, "merchant_city string, merchant_state string, amount_usd double")
    out = G.merchant_locations(txn, None, top_n=2).collect()
    assert [r["merchant_city"] for r in out] == ["B"]  # D16: cut first, then filter


def test_bubble_constant_and_legend(spark):
    df = spark.createDataFrame([(5, 2.0), (5, 2.0)], "txn_count long, avg_amount double")
    assert {r["s"] for r in G.scale_bubbles(df, "txn_count", "s").collect()} == {410.0}
    locs = spark.createDataFrame([(1, 4.0), (9, 16.0)], "txn_count long, avg_amount double")
    leg = {(r["metric"], r["stop"]): r["size"] for r in G.bubble_legend(locs).collect()}
    assert leg[("txn_count", "min")] == 20.0 and leg[("txn_count", "max")] == 800.0
    assert leg[("avg_amount", "mid")] == pytest.approx(20 + (10 ** 0.5 - 2) / 2 * 780)


def test_read_city_coords(spark, tmp_path):
    p = tmp_path / "cities.csv"
    p.write_text("City,State,lat,lon,population\n Austin ,tx,30.3,-97.7,1\nBoston,MA,42.4,-71.1,2\n")
    got = {r["city_state"]: (r["lat"], r["lon"]) for r in G.read_city_coords(spark, str(p)).collect()}
    assert got == {"AUSTIN|TX": (30.3, -97.7), "BOSTON|MA": (42.4, -71.1)}
    assert G.read_city_coords(spark, str(tmp_path / "missing.csv"), missing_ok=True).count() == 0
    with pytest.raises(AnalysisException):
        G.read_city_coords(spark, str(tmp_path / "missing.csv"))
