"""Scalar column functions.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; DataFrame-level wrappers take and return a
DataFrame so they compose with ``df.transform(fn, col)``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stored money type of the cleaned tables and the exact accumulator type.
MONEY = T.DecimalType(12, 2)
CENTS = T.DecimalType(18, 2)

# Day-of-week labels, Monday first.
WEEKDAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Text the tabular reader treats as missing (pandas read_csv defaults).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- text cleaning

def trim_ws(c: str | Column) -> Column:
    """Strip all leading/trailing whitespace (``trim`` only strips spaces)."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def parse_currency(c: str | Column, strict: bool = True, dtype: T.DataType = MONEY) -> Column:
    """``"$-1,234.50 "`` -> DECIMAL(12,2). ``strict`` raises on bad text."""
    text = trim_ws(F.regexp_replace(col_(c), r"[$,]", ""))
    return text.cast(dtype) if strict else text.try_cast(dtype)


def lenient_timestamp(c: str | Column) -> Column:
    """Text -> naive timestamp, unparseable -> NULL."""
    return col_(c).try_cast(T.TimestampNTZType())


def strict_timestamp(c: str | Column) -> Column:
    """Text -> naive timestamp, raises on garbage (ANSI)."""
    return col_(c).cast(T.TimestampNTZType())


def parse_zip(c: str | Column) -> Column:
    """``58523.0`` -> ``58523``, ``123.0`` -> ``00123``; longer text is kept whole."""
    z = F.regexp_replace(col_(c).cast("string"), r"\.\d+$", "")
    return F.when(F.length(z) < 5, F.lpad(z, 5, "0")).otherwise(z)


def parse_month_year(c: str | Column) -> Column:
    """``M/yyyy`` -> first day of that month (DATE); bad text -> NULL."""
    return F.try_to_date(col_(c), "M/yyyy")


def parse_yes_no(c: str | Column) -> Column:
    """YES/NO in any case and padding -> BOOLEAN, anything else -> NULL."""
    u = F.upper(trim_ws(c))
    return F.when(u == "YES", F.lit(True)).when(u == "NO", F.lit(False))


def to_date(c: str | Column) -> Column:
    """Timestamp -> date."""
    return F.to_date(col_(c))


def impute_errors(c: str | Column, fill: str = "No error") -> Column:
    """Missing error text -> ``No error``."""
    return F.coalesce(col_(c), F.lit(fill))


def lenient_number(c: str | Column) -> Column:
    """C11: ``pd.to_numeric(errors='coerce')``; NaN also becomes NULL."""
    x = col_(c).try_cast(T.DoubleType())
    return F.when(~F.isnan(x), x)


def contains_chip(c: str | Column) -> Column:
    """Case-insensitive "chip" test, NULL -> false."""
    return F.coalesce(F.lower(col_(c)).contains("chip"), F.lit(False))


def present_flag(c: str | Column) -> Column:
    """1 when the value is present, else 0."""
    return col_(c).isNotNull().cast("int")


def weekday_mon0(c: str | Column) -> Column:
    """Monday=0 ... Sunday=6."""
    return F.weekday(col_(c))


def weekday_sun0(c: str | Column) -> Column:
    """Sunday=0 ... Saturday=6."""
    return F.dayofweek(col_(c)) - 1


def weekday_label(c: str | Column) -> Column:
    """Mon..Sun label of a timestamp/date."""
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS])
    return F.element_at(labels, F.weekday(col_(c)) + 1)


def month_start(c: str | Column) -> Column:
    """C17: first day of the month as DATE (stable under any session time zone)."""
    return F.trunc(F.to_date(col_(c)), "month")


def month_from_parts(year: str | Column, month: str | Column) -> Column:
    """Year + month -> DATE of the first day."""
    return F.make_date(col_(year), col_(month), F.lit(1))


def whole_days_between(first: str | Column, last: str | Column) -> Column:
    """C20: whole 24h periods between two timestamps (``Timedelta.days``)."""
    return F.timestamp_diff("DAY", col_(first), col_(last))


def per_day_rate(count: str | Column, span_days: str | Column) -> Column:
    """Count / (span + 1)."""
    return col_(count).cast("double") / (col_(span_days) + F.lit(1))


def eps_ratio(num: str | Column, den: str | Column, eps: float = 1e-6) -> Column:
    """Num / (den + eps), missing -> 0."""
    return F.coalesce(F.try_divide(col_(num).cast("double"), col_(den).cast("double") + F.lit(eps)), F.lit(0.0))


def nullif_ratio(num: str | Column, den: str | Column) -> Column:
    """Num / den with a zero denominator giving NULL."""
    d = col_(den).cast("double")
    return col_(num).cast("double") / F.when(d != 0, d)


def zero_if_null(c: str | Column) -> Column:
    """C24."""
    return F.coalesce(col_(c), F.lit(0))


def flag_above(c: str | Column, threshold: Column | float) -> Column:
    """Value > threshold, missing -> false."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(col_(c) > t, F.lit(False))


def location_key(city: str | Column, state: str | Column) -> Column:
    """``CITY|STATE``; NULL when either part is missing (``concat`` propagates NULL)."""
    return F.concat(F.upper(trim_ws(city)), F.lit("|"), F.upper(trim_ws(state)))


def anomaly_label(c: str | Column) -> Column:
    """1 -> Normal, -1 -> Anomaly."""
    return F.when(col_(c) == -1, F.lit("Anomaly")).when(col_(c) == 1, F.lit("Normal"))


def nan_to_null(c: str | Column) -> Column:
    x = col_(c)
    return F.when(~F.isnan(x), x)


# ---------------------------------------------------------------- exact money moments
# Money is summed exactly to a millionth: whole units and millionths as two LONG sums, so a
# sum does not depend on the order rows arrive in (partitioning, AQE, retries) and the hot
# loop stays in plain long arithmetic inside codegen.  The two meet once per group in a
# DECIMAL, whose double is the correctly rounded value of the exact sum.  What does not fit
# there, amounts of ``EXACT_BELOW`` and more (infinite ones as well) and digits past the
# millionth, is added as a plain DOUBLE sum, so no amount can end a job.  The standard
# deviation is Spark's own, which merges central moments.
EXACT_BELOW = 1e9


def exact_count(c: str | Column) -> Column:
    """Number of present (non-NULL, non-NaN) money values: the divisor of a money mean."""
    return F.count(nan_to_null(col_(c).cast("double")))


def exact_sum(c: str | Column) -> Column:
    """Sum as DOUBLE, exact to a millionth below ``EXACT_BELOW``; NULL and NaN are skipped, an infinite amount gives an
    infinite sum (NaN with both signs)."""
    x = nan_to_null(col_(c).cast("double"))
    exact = F.when(F.abs(x) < EXACT_BELOW, x)
    whole = F.floor(exact)
    rest = (exact - whole) * F.lit(1e6)
    millionths = F.rint(rest)
    past = rest - millionths
    # a double's own error is no digit: it is below 2e-10 millionths per unit of the amount
    digits = F.when(F.abs(past) > F.abs(exact) * 4e-10 + 1e-9, past * F.lit(1e-6))
    sound = (F.sum(whole).cast("decimal(32,6)")
             + F.sum(millionths.cast("long")).cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("double")
    other = F.sum(F.when(F.abs(x) >= EXACT_BELOW, x).otherwise(digits))
    return F.coalesce(sound + F.coalesce(other, F.lit(0.0)), other)


def fixed(c: str | Column) -> Column:
    """A value as DECIMAL with six decimals; NULL for missing or NaN."""
    x = nan_to_null(col_(c).cast("double"))
    return x.cast("decimal(20,6)")


def money(s: str | Column) -> Column:
    """An exact sum as DOUBLE."""
    return col_(s).cast("double")


def mean_from(s: str | Column, n: str | Column) -> Column:
    """Mean from an exact sum and a count (NULL for n = 0)."""
    return F.when(col_(n) > 0, money(s) / col_(n))


def sample_std(c: str | Column) -> Column:
    """Sample standard deviation (NULL for fewer than two values); NULL and NaN are skipped."""
    return F.stddev_samp(nan_to_null(col_(c).cast("double")))


# ---------------------------------------------------------------- DataFrame wrappers

def with_col(df: DataFrame, name: str, fn, *args) -> DataFrame:
    """``df.transform(with_col, 'amount', parse_currency)`` style in-place rewrite."""
    return df.withColumn(name, fn(name, *args))


def join_year_month(df: DataFrame, year_col: str, month_col: str, out_col: str) -> DataFrame:
    """The year column becomes ``out_col`` (DATE, first of month) in place; month dropped.

    An invalid month raises under ANSI mode, as the reference's ``to_datetime`` does.
    """
    cols = []
    for c in df.columns:
        if c == year_col:
            cols.append(F.make_date(F.col(year_col), F.col(month_col), F.lit(1)).alias(out_col))
        elif c != month_col:
            cols.append(F.col(c))
    return df.select(*cols)


def narrow_ints(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast integer columns to the narrowest signed type holding their range.

    One aggregation pass over the listed columns (partial aggregation, no shuffle
    of rows), then a cast; the result type is data-dependent by design.
    """
    if not cols:
        return df
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    row = df.agg(*aggs).first()
    out = df
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if lo is None:
            continue
        for t, lim in ((T.ByteType(), 2**7), (T.ShortType(), 2**15), (T.IntegerType(), 2**31), (T.LongType(), 2**63)):
            if -lim <= lo and hi < lim:
                out = out.withColumn(c, F.col(c).cast(t))
                break
    return out


def normalise_missing(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """D18 + NaN rule: string null tokens -> NULL, float NaN -> NULL."""
    toks = NULL_TOKENS if tokens is None else tokens
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(~c.isin(toks), c).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
