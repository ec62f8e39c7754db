"""Merchant location report.

Plan: location aggregate -> top N locations (N rows, a parameter bound) ->
geocode.  The top-N table is the side with a proven size bound, so it is the
one broadcast; the coordinate lookup (any size, user supplied) is streamed
and deduplicated on its key first so that a repeated key cannot fan out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from .aggregates import location_aggregate

# State centre (lat, lon) used when a city is not in the lookup.
STATE_CENTRES = [
    ("AL", 32.8, -86.8), ("AK", 64.2, -153.4), ("AZ", 34.3, -111.1), ("AR", 34.8, -92.2), ("CA", 36.8, -119.4),
    ("CO", 39.0, -105.5), ("CT", 41.6, -72.7), ("DE", 39.0, -75.5), ("FL", 27.8, -81.6), ("GA", 32.2, -83.4),
    ("HI", 20.3, -156.4), ("ID", 44.4, -114.6), ("IL", 40.0, -89.2), ("IN", 40.3, -86.1), ("IA", 42.0, -93.2),
    ("KS", 38.5, -98.4), ("KY", 37.5, -85.3), ("LA", 31.2, -91.8), ("ME", 45.4, -69.0), ("MD", 39.0, -76.8),
    ("MA", 42.3, -71.8), ("MI", 44.3, -85.6), ("MN", 46.4, -93.1), ("MS", 32.7, -89.7), ("MO", 38.5, -92.5),
    ("MT", 47.0, -110.0), ("NE", 41.5, -99.9), ("NV", 39.5, -116.9), ("NH", 43.7, -71.6), ("NJ", 40.1, -74.5),
    ("NM", 34.8, -106.2), ("NY", 42.9, -75.5), ("NC", 35.6, -79.8), ("ND", 47.5, -100.5), ("OH", 40.4, -82.8),
    ("OK", 35.6, -96.9), ("OR", 43.9, -120.6), ("PA", 40.9, -77.8), ("RI", 41.7, -71.5), ("SC", 33.9, -80.9),
    ("SD", 44.4, -100.2), ("TN", 35.9, -86.4), ("TX", 31.5, -99.3), ("UT", 39.3, -111.1), ("VT", 44.0, -72.7),
    ("VA", 37.8, -78.2), ("WA", 47.4, -120.6), ("WV", 38.6, -80.6), ("WI", 44.3, -89.8), ("WY", 43.0, -107.6),
    ("DC", 38.9, -77.0),
]
# Country centre used when neither city nor state is known.
DEFAULT_CENTRE = (39.5, -98.4)
# Continental bounding box (inclusive) and bubble size range.
LAT_BOX = (24.0, 50.0)
LON_BOX = (-125.0, -66.0)
BUBBLE_MIN, BUBBLE_MAX = 20.0, 800.0


def state_centres(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE_CENTRES, "state string, lat double, lon double")


def read_city_coords(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """CSV with City, State, lat, lon -> (city_state, lat, lon).

    A path or column that is not there raises; with ``missing_ok`` it gives an empty lookup."""
    try:
        raw = spark.read.option("header", True).csv(path)
        return raw.select(
            C.location_key("City", "State").alias("city_state"),
            F.col("lat").try_cast("double").alias("lat"),
            F.col("lon").try_cast("double").alias("lon"),
        )
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], "city_state string, lat double, lon double")


def _dedupe(lookup: DataFrame, key: str) -> DataFrame:
    """One row per key (smallest lat, lon wins), so a join cannot fan out."""
    best = F.min(F.struct("lat", "lon"))
    return lookup.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_p")).select(
        key, F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon")
    )


def scale_bubbles(df: DataFrame, col: str, out: str, lo_size: float = BUBBLE_MIN, hi_size: float = BUBBLE_MAX):
    """Sqrt scaling to [lo_size, hi_size]; a constant column gets the midpoint."""
    r = F.sqrt(F.col(col).cast("double"))
    b = df.agg(F.min(r).alias("_lo"), F.max(r).alias("_hi"))
    # one row: broadcast
    j = df.crossJoin(F.broadcast(b))
    size = F.lit(lo_size) + (r - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(hi_size - lo_size)
    return j.withColumn(out, F.when(F.col("_hi") == F.col("_lo"), F.lit((lo_size + hi_size) / 2)).otherwise(size)).drop(
        "_lo", "_hi")


def geocode(locations: DataFrame, city_coords: DataFrame | None, state_coords: DataFrame,
            city_col: str, state_col: str) -> DataFrame:
    """City lookup, else state centre, else country centre; adds geo_level."""
    spark = locations.sparkSession
    loc = locations.withColumn("_key", C.location_key(city_col, state_col)).withColumn(
        "_state", F.upper(C.trim_ws(state_col)))
    if city_coords is None:
        city_coords = spark.createDataFrame([], "city_state string, lat double, lon double")
    # Reduce each lookup to the keys of ``locations`` first (a semi join against the
    # top-N keys, which are bounded by N and broadcast), then dedupe: what is left
    # is at most N rows per lookup, so it can be broadcast into the final left joins.
    keys = F.broadcast(loc.select("_key").where(F.col("_key").isNotNull()).distinct())
    cc = _dedupe(city_coords.join(keys, city_coords.city_state == keys._key, "left_semi"), "city_state").select(
        F.col("city_state").alias("_key"), F.col("lat").alias("_clat"), F.col("lon").alias("_clon"))
    states = F.broadcast(loc.select("_state").where(F.col("_state").isNotNull()).distinct())
    sl = state_coords.withColumn("state", F.upper(C.trim_ws("state")))
    sc = _dedupe(sl.join(states, sl.state == states._state, "left_semi"), "state").select(
        F.col("state").alias("_state"), F.col("lat").alias("_slat"), F.col("lon").alias("_slon"))
    j = loc.join(F.broadcast(cc), "_key", "left").join(F.broadcast(sc), "_state", "left")
    level = F.when(F.col("_clat").isNotNull(), F.lit("city")).when(F.col("_slat").isNotNull(), F.lit("state")).otherwise(
        F.lit("default"))
    lat = F.when(F.col("_clat").isNotNull(), F.col("_clat")).when(F.col("_slat").isNotNull(), F.col("_slat")).otherwise(
        F.lit(DEFAULT_CENTRE[0]))
    lon = F.when(F.col("_clat").isNotNull(), F.col("_clon")).when(F.col("_slat").isNotNull(), F.col("_slon")).otherwise(
        F.lit(DEFAULT_CENTRE[1]))
    return j.select(*locations.columns, lat.alias("lat"), lon.alias("lon"), level.alias("geo_level"))


def merchant_locations(txn: DataFrame, city_coords: DataFrame | None = None, state_coords: DataFrame | None = None,
                       *, amount_col: str = "amount_usd", city_col: str = "merchant_city",
                       state_col: str = "merchant_state", top_n: int = 300) -> DataFrame:
    """Top ``top_n`` locations by count, geocoded, kept inside the box, with bubble sizes."""
    spark = txn.sparkSession
    agg = location_aggregate(txn, amount_col, city_col, state_col)
    top = agg.orderBy(F.desc("txn_count"), F.asc(city_col), F.asc(state_col)).limit(top_n)  # K3, before the box (D16)
    # The top-N table (N rows, a parameter bound) feeds the two lookups, the box filter and
    # both bubble scalings; materialise it once instead of re-running the aggregate per use.
    top = materialize(top)
    geo = geocode(top, city_coords, state_coords if state_coords is not None else state_centres(spark),
                  city_col, state_col)
    boxed = geo.where(F.col("lat").between(*LAT_BOX) & F.col("lon").between(*LON_BOX))  # F6
    out = scale_bubbles(boxed, "txn_count", "size_count")
    return scale_bubbles(out, "avg_amount", "size_amount")


def bubble_legend(locations: DataFrame, lo_size: float = BUBBLE_MIN, hi_size: float = BUBBLE_MAX) -> DataFrame:
    """Three legend stops (min, middle, max) per metric with their bubble sizes."""
    b = locations.agg(F.min("txn_count").cast("double").alias("c_lo"), F.max("txn_count").cast("double").alias("c_hi"),
                      F.min("avg_amount").alias("a_lo"), F.max("avg_amount").alias("a_hi"))
    rows = []
    for metric, lo, hi in (("txn_count", "c_lo", "c_hi"), ("avg_amount", "a_lo", "a_hi")):
        mid = (F.col(lo) + F.col(hi)) / 2
        for stop, val in (("min", F.col(lo)), ("mid", mid), ("max", F.col(hi))):
            rows.append(F.struct(F.lit(metric).alias("metric"), F.lit(stop).alias("stop"), val.alias("value"),
                                 F.sqrt(F.col(lo)).alias("_rl"), F.sqrt(F.col(hi)).alias("_rh")))
    x = b.select(F.explode(F.array(*rows)).alias("_s")).select("_s.*")
    size = F.lit(lo_size) + (F.sqrt("value") - F.col("_rl")) / (F.col("_rh") - F.col("_rl")) * F.lit(hi_size - lo_size)
    return x.select("metric", "stop", "value", F.when(F.col("_rh") == F.col("_rl"), F.lit((lo_size + hi_size) / 2))
                    .otherwise(size).alias("size")).where(F.col("value").isNotNull())
