"""Distribution statistics.

All of them are aggregations whose output size is fixed by a parameter
(bins, grid points, columns), never by the data:

* ``histogram`` - NumPy's equal-width rule: one 1-row min/max pass, a bin
  index per row (codegen'd arithmetic, exact edge corrections), one
  ``groupBy(bin)`` with map-side combine.  Empty bins are kept (count 0).
* ``binned_mean`` - ``pd.cut(x, bins)`` right-closed bins, lowest edge
  lowered by 0.1 % of the range; empty bins dropped.
* ``kde`` - Gaussian KDE with Scott's bandwidth on a 200-point grid per
  group: values are first counted per distinct value, then each count row
  meets the (bounded, broadcast) grid of its group and the sums are
  partially aggregated.
* ``correlation`` - pairwise-complete Pearson for all column pairs in one
  wide aggregation pass; constant columns give NULL instead of raising.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: tuple = (), include_ids: bool = False) -> list[str]:
    """numeric columns (booleans and dates are not numeric), minus ``exclude`` and ``*_id``."""
    out = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, _NUMERIC) or f.name in exclude:
            continue
        if not include_ids and (f.name == "id" or f.name.endswith("_id")):
            continue
        out.append(f.name)
    return out


def _finite(c):
    return F.when(~F.isnan(c), c)


# ---------------------------------------------------------------- histograms

def _with_bin(df: DataFrame, x: str, lo: str, hi: str, bins: int, out: str = "bin") -> DataFrame:
    """Add NumPy's ``histogram`` bin of ``x`` for edges ``linspace(lo, hi, bins+1)``.

    Estimate ``floor((x-lo)/(hi-lo)*bins)``, then correct by one against the
    exact edges ``i*step + lo`` (the last edge is ``hi``; the last bin is
    closed).  Each step is its own projection: Catalyst keeps a column that a
    later step uses several times instead of inlining (and repeating) it.
    """
    X, LO, HI = F.col(x), F.col(lo), F.col(hi)
    step = (HI - LO) / F.lit(float(bins))

    def edge(i):
        return F.when(i >= F.lit(bins), HI).otherwise(i.cast("double") * step + LO)

    raw = ((X - LO) / (HI - LO) * F.lit(float(bins))).cast("int")
    d = df.withColumn("_b0", F.least(raw, F.lit(bins - 1)))
    d = d.withColumn("_b1", F.when(X < edge(F.col("_b0")), F.col("_b0") - 1).otherwise(F.col("_b0")))
    up = (X >= edge(F.col("_b1") + 1)) & (F.col("_b1") != bins - 1)
    return d.withColumn(out, F.when(up, F.col("_b1") + 1).otherwise(F.col("_b1"))).drop("_b0", "_b1")


def _bounds(lo, hi):
    """NumPy's rule for an empty range: widen by 0.5 each side."""
    same = lo == hi
    return F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi)


def histograms(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """Equal-width histograms of several columns in one pass.

    Returns (feature, bin, lo, hi, frequency); every bin of every column is
    present, empty bins with frequency 0.  NULL/NaN values are ignored.
    """
    spark = df.sparkSession
    long_ = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _finite(F.col(c).cast("double")).alias("x"))
                            for c in cols])).alias("_p")
    ).select("_p.feature", "_p.x").where(F.col("x").isNotNull())
    # one row per column: bounded by the column list, broadcast
    b = long_.groupBy("feature").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    lo, hi = _bounds(F.col("_lo"), F.col("_hi"))
    b = b.select("feature", lo.alias("_lo"), hi.alias("_hi"))
    counted = (
        _with_bin(long_.join(F.broadcast(b), "feature"), "x", "_lo", "_hi", bins)
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    grid = F.broadcast(b.crossJoin(spark.range(bins).select(F.col("id").cast("int").alias("bin"))))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return grid.join(counted, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (F.col("bin").cast("double") * step + F.col("_lo")).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.col("_hi"))
        .otherwise((F.col("bin") + 1).cast("double") * step + F.col("_lo"))
        .alias("hi"),
        F.coalesce(F.col("frequency"), F.lit(0)).cast("long").alias("frequency"),
    )


def histogram(df: DataFrame, col: str, bins: int = 80, *, log1p: bool = False, positive: bool = False) -> DataFrame:
    """(bin, lo, hi, frequency) of one column; ``log1p`` bins log(1+x) in its own range."""
    x = F.col(col).cast("double")
    d = df.select(x.alias("_v"))
    if positive:
        d = d.where(F.col("_v") > 0)
    if log1p:
        d = d.select(F.log1p("_v").alias("_v"))
    return histograms(d, ["_v"], bins).drop("feature")


# ---------------------------------------------------------------- equal-width bins (pd.cut)

def binned_mean(df: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """Mean of ``value`` per ``pd.cut(by, bins)`` bin -> (bin, lo, hi, mean, n)."""
    x = _finite(F.col(by).cast("double"))
    d = df.select(x.alias("_x"), _finite(F.col(value).cast("double")).alias("_v")).where(F.col("_x").isNotNull())
    b = d.agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    mn, mx = F.col("_mn"), F.col("_mx")
    pad = F.when(mn != 0, F.abs(mn) * 0.001).otherwise(F.lit(0.001))
    b = b.select(
        F.when(mn == mx, mn - pad).otherwise(mn).alias("_lo"),
        F.when(mn == mx, mx + pad).otherwise(mx).alias("_hi"),
        (mn == mx).alias("_same"),
        ((mx - mn) * 0.001).alias("_adj"),
    )
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    interior = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: i.cast("double") * step + F.col("_lo"))
    bin_ = F.size(F.filter(interior, lambda e: e < F.col("_x")))
    # a single row by construction (global min/max): broadcast
    g = d.crossJoin(F.broadcast(b)).groupBy(bin_.alias("bin")).agg(
        F.avg("_v").alias("mean"), F.count("_v").alias("n"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_same").alias("_same"),
        F.first("_adj").alias("_adj"),
    )
    lo_edge = F.col("bin").cast("double") * step + F.col("_lo")
    lo = F.when((F.col("bin") == 0) & ~F.col("_same"), F.col("_lo") - F.col("_adj")).otherwise(lo_edge)
    hi = F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise((F.col("bin") + 1).cast("double") * step + F.col("_lo"))
    return g.select(F.col("bin").cast("int").alias("bin"), lo.alias("lo"), hi.alias("hi"), "mean", "n")


# ---------------------------------------------------------------- KDE

def kde(df: DataFrame, value: str, by: str | None = None, grid: int = 200, cut: float = 3.0,
        error: float | None = None) -> DataFrame:
    """Gaussian KDE per group (Scott bandwidth, seaborn support grid) -> (by, point, x, density).

    Exact by default, at the cost of distinct values x grid: for few distinct values.  With ``error`` the values are binned
    first (see ``_binned_density``), at the cost of rows + bins; no density is then off by more than ``error`` times the
    highest density a single value could have, 1 / (bandwidth x sqrt(2 pi)).  Missing and infinite values take no part; a
    group needs two different ones.
    """
    spark = df.sparkSession
    v = _finite(F.col(value).cast("double"))
    key = F.col(by) if by else F.lit("all")
    d = df.select(key.alias("_g"), v.alias("_v")).where((F.abs("_v") < float("inf")) & F.col("_g").isNotNull())
    stats = d.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_mn"),
        F.max("_v").alias("_mx"),
    )
    factor = F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    bw = F.sqrt(F.col("_sd") * F.col("_sd") * factor * factor)
    stats = stats.select("_g", "_n", bw.alias("_bw"), F.col("_mn"), F.col("_mx")).where(F.col("_bw") > 0)
    gmin = F.col("_mn") - F.col("_bw") * cut
    gmax = F.col("_mx") + F.col("_bw") * cut
    step = (gmax - gmin) / F.lit(float(grid - 1))
    pts = stats.crossJoin(spark.range(grid).select(F.col("id").cast("int").alias("point"))).select(
        "_g", "_n", "_bw", "point",
        F.when(F.col("point") == grid - 1, gmax).otherwise(F.col("point").cast("double") * step + gmin).alias("x"),
    )
    norm = F.lit(1.0 / math.sqrt(2 * math.pi)) / (F.col("_n") * F.col("_bw"))
    if error is not None:
        out = pts.join(_binned_density(d, stats, gmin, step, grid, error), ["_g", "point"], "left").select(
            "_g", "point", "x", (F.coalesce("_sum", F.lit(0.0)) * norm).alias("density"))
        return out.select(F.col("_g").alias(by or "group"), "point", "x", "density")
    counts = d.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    # The grid has groups x grid rows; Spark's size statistics and AQE choose the join.
    z = (F.col("x") - F.col("_v")) / F.col("_bw")
    contrib = F.col("_c") * F.exp(F.lit(-0.5) * z * z)
    out = counts.join(pts, "_g").groupBy("_g", "point", "x").agg(
        (F.sum(contrib) * F.first(norm)).alias("density")
    )
    return out.select(F.col("_g").alias(by or "group"), "point", "x", "density")


# Kernel values this many bandwidths away are below 1e-17 of the kernel's peak.
REACH = 9.0


def _binned_density(d: DataFrame, stats: DataFrame, gmin, step, grid: int, error: float) -> DataFrame:
    """Kernel sums (_g, point, _sum) by linear binning: each value is shared between the two nearest points of a mesh, and the
    mesh weights (combined map-side) are convolved with the kernel.

    The mesh is ``sqrt(8 error)`` bandwidths fine.  Sharing a value linearly replaces the kernel by its linear interpolant, off
    by at most spacing^2 / 8 times its greatest curvature, which is its peak / bandwidth^2: ``error`` peaks.  A mesh point
    reaches only grid points within ``REACH`` bandwidths, so a group's convolution has about 2 REACH x grid / sqrt(8 error)
    terms however long its tails are.
    """
    mesh = F.col("_bw") * math.sqrt(8 * error)
    place = (F.col("_v") - F.col("_mn")) / mesh
    at = d.join(stats, "_g").select("_g", F.floor(place).alias("_k"), (place - F.floor(place)).alias("_f"))
    # both shares of a mesh cell in one row, so that the shuffle carries one row per cell
    cells = at.groupBy("_g", "_k").agg(F.sum(F.lit(1.0) - F.col("_f")).alias("_left"), F.sum("_f").alias("_right"))
    ends = F.array(F.struct(F.col("_k").alias("k"), F.col("_left").alias("w")),
                   F.struct((F.col("_k") + 1).alias("k"), F.col("_right").alias("w")))
    nodes = cells.select("_g", F.explode(ends).alias("_e")).groupBy("_g", F.col("_e.k").alias("_k")).agg(
        F.sum("_e.w").alias("_w"))
    m = F.col("_mn") + F.col("_k").cast("double") * mesh
    low = F.greatest(F.ceil((m - gmin - F.col("_bw") * REACH) / step), F.lit(0))
    high = F.least(F.floor((m - gmin + F.col("_bw") * REACH) / step), F.lit(grid - 1))
    reached = nodes.join(stats, "_g").withColumns({"_m": m, "_lo": low, "_hi": high}).where("_lo <= _hi").select(
        "_g", "_w", "_m", "_bw", gmin.alias("_x0"), step.alias("_step"), F.explode(F.sequence("_lo", "_hi")).alias("_p"))
    z = (F.col("_p").cast("double") * F.col("_step") + F.col("_x0") - F.col("_m")) / F.col("_bw")
    return reached.groupBy("_g", F.col("_p").cast("int").alias("point")).agg(
        F.sum(F.col("_w") * F.exp(F.lit(-0.5) * z * z)).alias("_sum"))


# ---------------------------------------------------------------- correlation

# The named features of the SQL-style correlation.
SELECTED_FEATURES = [
    "avg_amount", "credit_score", "yearly_income", "total_debt", "per_capita_income", "txn_weighted_credit_limit",
    "num_credit_cards", "debt_to_income", "current_age", "txn_count", "total_errors", "chip_ratio", "has_dark_web_card",
]

# Relative spread below which a column counts as constant (floating-point noise).
CONSTANT_RTOL = 1e-10


def _pair_moments(cols: list[str]):
    """Per-partition centred moments of every column pair (pairwise-complete).

    For each pair (i, j), over rows where both are present: n, the two means,
    the two sums of squared deviations and the co-deviation.  Batches are
    merged with the parallel formulas of Chan, Golub & LeVeque, so each
    partition emits k x k rows whatever its size.
    """
    import numpy as np
    import pandas as pd

    k = len(cols)

    def batch_moments(x):
        m = ~np.isnan(x)
        shift = np.where(m.any(axis=0), np.nanmean(np.where(m, x, np.nan), axis=0), 0.0)
        xs = np.where(m, x - shift, 0.0)
        mf = m.astype("float64")
        n = mf.T @ mf
        sa = xs.T @ mf                      # sa[i, j]: sum of column i over rows where i and j are present
        saa = (xs * xs).T @ mf
        sab = xs.T @ xs
        with np.errstate(invalid="ignore", divide="ignore"):
            da = np.where(n > 0, sa / n, 0.0)
            db = da.T
            ma = shift[:, None] + da
            mb = shift[None, :] + db
            m2a = np.maximum(saa - n * da * da, 0.0)
            m2b = m2a.T
            cab = sab - n * da * db
        return n, ma, mb, m2a, m2b, cab

    def merge(a, b):
        n1, ma1, mb1, m2a1, m2b1, c1 = a
        n2, ma2, mb2, m2a2, m2b2, c2 = b
        n = n1 + n2
        with np.errstate(invalid="ignore", divide="ignore"):
            w = np.where(n > 0, n2 / n, 0.0)
        dxa, dxb = ma2 - ma1, mb2 - mb1
        return (n, ma1 + dxa * w, mb1 + dxb * w, m2a1 + m2a2 + dxa * dxa * n1 * w,
                m2b1 + m2b2 + dxb * dxb * n1 * w, c1 + c2 + dxa * dxb * n1 * w)

    def run(batches):
        acc = None
        for pdf in batches:
            cur = batch_moments(pdf[cols].to_numpy(dtype="float64", na_value=np.nan))
            acc = cur if acc is None else merge(acc, cur)
        if acc is None:
            return
        ii, jj = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        names = ["n", "ma", "mb", "m2a", "m2b", "cab"]
        data = {"i": ii.ravel().astype("int32"), "j": jj.ravel().astype("int32")}
        data.update({nm: arr.ravel() for nm, arr in zip(names, acc)})
        yield pd.DataFrame(data)

    return run


def correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form (col_a, col_b, r, n).

    One pass over the data: an Arrow-batched ``mapInPandas`` emits k x k
    centred partial moments per partition (NumPy, pairwise non-null masks);
    they are merged across partitions with the same parallel formulas on a
    table of (partitions x k^2) rows.  ``r`` is NULL where a column is
    constant over the rows shared with its partner (spread below
    ``CONSTANT_RTOL`` of its magnitude); plain ``corr`` would raise under
    ANSI or return rounding noise there.
    """
    cols = cols or numeric_columns(df)
    spark = df.sparkSession
    x = df.select(*[_finite(F.col(c).cast("double")).alias(c) for c in cols])
    schema = "i int, j int, n double, ma double, mb double, m2a double, m2b double, cab double"
    parts = x.mapInPandas(_pair_moments(cols), schema).where(F.col("n") > 0)
    # Global pair means as window aggregates over each (i, j) cell, so the partials are read once
    # (a join back onto them would run the whole upstream plan a second time).  The window's
    # exchange on (i, j) also serves the final groupBy; each cell has one row per partition.
    cell = Window.partitionBy("i", "j")
    w = parts.select("*", F.sum("n").over(cell).alias("_N"),
                     (F.sum(F.col("n") * F.col("ma")).over(cell) / F.sum("n").over(cell)).alias("_MA"),
                     (F.sum(F.col("n") * F.col("mb")).over(cell) / F.sum("n").over(cell)).alias("_MB"))
    da, db = F.col("ma") - F.col("_MA"), F.col("mb") - F.col("_MB")
    m = w.groupBy("i", "j").agg(
        F.first("_N").alias("n"), F.first("_MA").alias("mean_a"), F.first("_MB").alias("mean_b"),
        F.sum(F.col("m2a") + F.col("n") * da * da).alias("m2a"),
        F.sum(F.col("m2b") + F.col("n") * db * db).alias("m2b"),
        F.sum(F.col("cab") + F.col("n") * da * db).alias("cab"))
    n = F.col("n")
    sda, sdb = F.sqrt(F.col("m2a") / n), F.sqrt(F.col("m2b") / n)
    const_a = sda <= F.lit(CONSTANT_RTOL) * F.abs(F.col("mean_a"))
    const_b = sdb <= F.lit(CONSTANT_RTOL) * F.abs(F.col("mean_b"))
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
        F.least(F.greatest(F.col("cab") / F.sqrt(F.col("m2a") * F.col("m2b")), F.lit(-1.0)), F.lit(1.0)))
    r = F.when(const_a | const_b | (sda == 0) | (sdb == 0), F.lit(None).cast("double")).otherwise(r)
    # all k^2 cells (so that all-null pairs still appear with n = 0, r NULL); k is the column count
    cells = [(i, j, a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    full = F.broadcast(spark.createDataFrame(cells, "i int, j int, col_a string, col_b string"))
    out = full.join(m.select("i", "j", r.alias("r"), n.cast("long").alias("n")), ["i", "j"], "left")
    return out.select("col_a", "col_b", "r", F.coalesce("n", F.lit(0)).alias("n"))


# ---------------------------------------------------------------- M1 standardisation

def standardise(df: DataFrame, cols: list[str], ddof: int = 0, suffix: str = "") -> DataFrame:
    """M1: z-scores with population (ddof=0, scikit-learn) or sample std; constant -> 0."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    st = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{i}") for i, c in enumerate(cols)],
                *[sd(F.col(c).cast("double")).alias(f"_s_{i}") for i, c in enumerate(cols)])
    # global moments: one row, broadcast
    j = df.crossJoin(F.broadcast(st))
    out = []
    for i, c in enumerate(cols):
        s = F.col(f"_s_{i}")
        z = (F.col(c).cast("double") - F.col(f"_m_{i}")) / F.when(s != 0, s)
        out.append(F.when(s == 0, F.lit(0.0)).otherwise(z).alias(c + suffix))
    keep = [c for c in df.columns if c not in cols or suffix]
    return j.select(*keep, *out)


def describe_by(df: DataFrame, value: str, by: str, split: bool = True) -> DataFrame:
    """G34 box part: exact min, quartiles, max of ``value`` per ``by``.

    The groups are few labels, one of them nearly all rows, so by default each group is
    ranked in global value buckets (``split``) rather than in one task."""
    from .quantiles import exact_quantiles

    return exact_quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], [by], ["q0", "q25", "q50", "q75", "q100"],
                           split=split)


__all__ = ["numeric_columns", "histogram", "histograms", "binned_mean", "kde", "correlation", "standardise",
           "describe_by"]
