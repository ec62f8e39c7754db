"""Exact quantiles without funnelling a group through one task (G11, medians).

Spark's ``percentile``/``median`` aggregate keeps a value->count map per group
and merges it in one task; for the global case (or a hot group) that map grows
with the number of distinct values.  ``exact_quantile`` reaches the same value
(linear interpolation between the two neighbouring order statistics, as
``percentile``, NumPy ``linear`` and SQL ``quantile_cont``) with plain
DataFrame steps:

* values are first counted per (group, value) - map-side partial aggregation;
* groups: a running sum of the counts over ``Window.partitionBy(keys)``
  ordered by value gives each distinct value its rank range; the window works
  on *distinct* values (bounded by the value domain, e.g. cents) and spills;
* the global case, and groups with ``split``: a fixed-size sketch first brackets the
  wanted ranks (one row per group); values below a bracket become one row that
  carries their number, values above it go, and only what lies inside - some
  0.02 % of a large group - is ranked, as distinct values with counts.  Two scans, and no
  work that depends on the number of shuffle partitions.  Every bracket is verified: a wanted
  rank that falls outside it finds no value among the ranked ones, and then the job ends with
  an error that names ``margin``, so no missing or wrong quantile passes.  (A second, wider
  try inside the plan would cost every run a further scan; the margin is five times the
  sketch's bound.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C, _END, _N, _LOW = "_q_cnt", "_q_end", "_q_n", "_q_low"
# A sketch of this accuracy is off by n / ACCURACY ranks at most; brackets reach MARGIN on either
# side, which also covers the rounding of ranks once a group has WHOLE values.  Smaller groups
# are ranked whole.  Merged sketches may be off by more, which the verification finds.
ACCURACY, MARGIN, WHOLE = 50_000, 1e-4, 20_000


def _clean(df: DataFrame, value: str):
    v = F.col(value)
    dt = df.schema[value].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return v.isNotNull() & ~F.isnan(v)
    return v.isNotNull()


def _pick(q: float, value: str, i: int = 0) -> list:
    pos = F.lit(q) * (F.col(_N) - F.lit(1)).cast("double")
    lo = F.floor(pos)
    hi = F.ceil(pos)
    start = F.col(_END) - F.col(_C)
    v = F.col(value).cast("double")
    return [
        F.max(F.when((start <= lo) & (lo < F.col(_END)), v)).alias(f"_q_lo{i}"),
        F.max(F.when((start <= hi) & (hi < F.col(_END)), v)).alias(f"_q_hi{i}"),
        F.max(pos - lo).alias(f"_q_frac{i}"),
        F.max(F.col(_N)).alias(f"_q_rows{i}"),
    ]


def _interp(out: str, i: int = 0):
    lo, hi, frac = F.col(f"_q_lo{i}"), F.col(f"_q_hi{i}"), F.col(f"_q_frac{i}")
    missed = (F.col(f"_q_rows{i}") > 0) & (lo.isNull() | hi.isNull())
    error = F.raise_error(F.lit(f"{out}: its rank lies outside the sketched bracket; pass a larger margin")).cast("double")
    return F.when(missed, error).otherwise(lo + (hi - lo) * frac).alias(out)


def exact_quantile(df: DataFrame, value: str, q: float, keys: list[str] | tuple = (), out: str = "quantile",
                   dedupe: bool = True, split: bool = False, margin: float = MARGIN) -> DataFrame:
    """Exact ``q``-quantile of ``value`` per ``keys`` (one row per group; one row overall if no keys).

    Nulls/NaN are ignored; an empty input gives NULL (global) or no row (grouped).
    ``dedupe`` first counts repeated values (money: many repeats); pass False for
    continuous values, where the pre-count would only add a shuffle.
    ``split`` (grouped case) brackets the wanted rank of every group before ranking, so
    that a group holding a large share of all rows is not ranked whole in one task;
    ``margin`` is the share of the rows that a bracket reaches to either side of the rank.
    """
    return exact_quantiles(df, value, [q], keys, [out], split, dedupe, margin)


def _narrowed(rows: DataFrame, value: str, q: float, keys: list[str], margin: float = MARGIN) -> DataFrame:
    """Rows (keys, value, ``_q_cnt``) of which only the bracket of rank ``q`` is left, with ``_q_n``."""
    about = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_b_rows"),
        F.percentile_approx(F.col(value), [max(0.0, q - margin), min(1.0, q + margin)], ACCURACY).alias("_b"))
    about = about.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_b_rows").alias(_N),
                         F.when(F.col("_b_rows") > WHOLE, F.col("_b")[0]).alias("_b_lo"),
                         F.when(F.col("_b_rows") > WHOLE, F.col("_b")[1]).alias("_b_hi"))
    if keys:
        cond = F.lit(True)
        for k in keys:  # NULL group keys form a group, as in SQL GROUP BY
            cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        joined = rows.join(about, cond)
    else:
        joined = rows.crossJoin(F.broadcast(about))  # one row
    below = F.coalesce(F.col(value) < F.col("_b_lo"), F.lit(False))
    kept = joined.where(F.col("_b_hi").isNull() | (F.col(value) <= F.col("_b_hi")))
    return kept.groupBy(*keys, below.alias(_LOW), F.when(~below, F.col(value)).alias(value)).agg(
        F.count(F.lit(1)).alias(_C), F.max(_N).alias(_N))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], keys: list[str] | tuple = (),
                    names: list[str] | None = None, split: bool = False, dedupe: bool = True,
                    margin: float = MARGIN) -> DataFrame:
    """Several exact quantiles per group; ``split`` and ``margin`` as in ``exact_quantile``."""
    if any(not 0.0 <= q <= 1.0 for q in qs):
        raise ValueError("q must be in [0, 1]")
    keys = list(keys)
    names = names or [f"q{int(round(q * 100)):02d}" for q in qs]
    clean = df.where(_clean(df, value)).select(*keys, F.col(value).cast("double").alias(value))
    if keys and not split:
        if dedupe:
            counted = clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(_C))
        else:
            counted = clean.withColumn(_C, F.lit(1).cast("long"))
        w_run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counted.withColumn(_END, F.sum(_C).over(w_run)).withColumn(
            _N, F.sum(_C).over(Window.partitionBy(*keys)))
        aggs = [a for i, q in enumerate(qs) for a in _pick(q, value, i)]
        return ranked.groupBy(*keys).agg(*aggs).select(*keys, *[_interp(n, i) for i, n in enumerate(names)])
    out = None
    for i, (q, name) in enumerate(zip(qs, names, strict=True)):
        rows = _narrowed(clean, value, q, keys, margin)
        w_run = Window.partitionBy(*keys).orderBy(F.col(_LOW).desc(), value).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        one = rows.withColumn(_END, F.sum(_C).over(w_run)).groupBy(*keys).agg(*_pick(q, value, i)).select(
            *[F.col(k).alias(k if out is None else f"_k_{k}") for k in keys], _interp(name, i))
        if out is None:
            out = one
        elif not keys:
            out = out.crossJoin(one)  # one row each
        else:
            cond = F.lit(True)
            for k in keys:
                cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            out = out.join(one, cond).drop(*[f"_k_{k}" for k in keys])
    return out


def exact_median(df: DataFrame, value: str, keys: list[str] | tuple = (), out: str = "median") -> DataFrame:
    return exact_quantile(df, value, 0.5, keys, out)
