"""Data-quality checks.

Each check is one aggregation pass over all columns at once (a single
partial-aggregated job), never a loop of per-column jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _missing(df: DataFrame, name: str):
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_report(df: DataFrame, skip: tuple = ()) -> DataFrame:
    """G32 as a table: (column, missing) for every column not in ``skip``, in column order."""
    cols = [c for c in df.columns if c not in skip]
    row = df.agg(*[F.count_if(_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"_m{i}").alias("missing"))
             for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.column", "_c.position", "_c.missing")


def assert_no_missing(df: DataFrame, skip: tuple = ()) -> DataFrame:
    """Raise ``ValueError`` naming the first column (in order) with missing values; return ``df``."""
    rep = missing_report(df, skip).where(F.col("missing") > 0).orderBy("position").limit(1).collect()
    if rep:
        raise ValueError(f"Column '{rep[0]['column']}' has {rep[0]['missing']} missing values")
    return df


def profile(df: DataFrame) -> DataFrame:
    """(column, type, non_null) from one aggregation."""
    row = df.agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                      F.col(f"_n{i}").alias("non_null")) for i, f in enumerate(df.schema.fields)]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows for a look (a limit is the feature here)."""
    return df.limit(n)


def coercion_losses(raw: DataFrame, parsed: dict[str, object]) -> DataFrame:
    """Per column, values present in the raw text that the parser turned into NULL.

    ``parsed`` maps a raw column name to the parsing ``Column`` expression.
    """
    names = list(parsed)
    row = raw.agg(*[F.count_if(F.col(c).isNotNull() & parsed[c].isNull()).alias(f"_l{i}")
                    for i, c in enumerate(names)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"_l{i}").alias("lost")) for i, c in enumerate(names)]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
