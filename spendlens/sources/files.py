"""Sources and sinks.

Raw CSV files are read with every column as text and typed by name, so the
column order of a file does not matter and no schema-inference pass runs.
The single-document JSON label file is split on its separators by the text
source, so a huge file is read by many tasks instead of one.
"""

from __future__ import annotations

import re
from collections import namedtuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from . import json_map

Tables = namedtuple("Tables", ["transactions", "users", "cards"])
#: Empty file that marks a folder as a finished table; Spark's readers pass over it.
COMMITTED = "_COMMITTED"


# ---------------------------------------------------------------- file system helpers (driver metadata only)

def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there: a file, or a folder that its writer marked as complete."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).isFile():
        return bool(fs.exists(p))
    return any(bool(fs.exists(_fs_path(spark, f"{path}/{mark}")[1])) for mark in (COMMITTED, "_SUCCESS"))


def _beside(path: str, tag: str) -> str:
    """A hidden folder beside ``path``, which Spark's readers pass over."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_{tag}-{name}" if parent else f"_{tag}-{name}"


def _publish(spark: SparkSession, written: str, path: str) -> None:
    """Mark a complete folder and rename it to its place; a table that is there goes only then."""
    fs, target = _fs_path(spark, path)
    fresh, old = (_fs_path(spark, x)[1] for x in (written, _beside(path, "replaced")))
    fs.create(_fs_path(spark, f"{written}/{COMMITTED}")[1], True).close()
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot replace {path}")
    if not fs.rename(fresh, target):
        raise OSError(f"cannot move {written} to {path}")
    fs.delete(old, True)


def size_mb(spark: SparkSession, path: str) -> float:
    fs, p = _fs_path(spark, path)
    return fs.getContentSummary(p).getLength() / 1e6


# ---------------------------------------------------------------- S1-S3 CSV

def _csv_rows(spark: SparkSession, path: str, multi_line: bool, **options) -> tuple[DataFrame, list[str]]:
    """All columns as text, and ``_reason`` (NULL: sound), ``_text`` and ``_file`` of each row.

    A row is malformed if it has more fields than the header or a quote that is not closed; a shorter one is padded with
    NULL.  Fields are counted only for rows that Spark reports as not fitting the header.
    """
    def reader():
        made = spark.read.option("header", True).option("quote", '"').option("escape", '"')
        for k, v in options.items():
            made = made.option(k, v)
        return made

    names = reader().csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_text"]])
    raw = reader().schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_text").option("columnPruning", False).csv(path)  # fields are counted whatever is selected
    # Spark refuses a query that reads the corrupt record alone, so it comes with nothing of the first field
    raw = raw.withColumn("_text", F.nullif(F.concat_ws("", "_text", F.substring(f"`{names[0]}`", 1, 0)), F.lit("")))
    bare = F.regexp_replace("_text", r'"([^"]|"")*"', "")
    separator = re.escape(options.get("sep", options.get("delimiter", ",")))
    reason = F.when(bare.contains('"'), F.lit("quote not closed")).when(
        F.regexp_count(bare, F.lit(separator)) >= len(names), F.lit("too many fields"))
    return raw.select(*[f"`{c}`" for c in names], reason.alias("_reason"), "_text", F.col("_metadata.file_path").alias("_file")), names


def read_csv_text(spark: SparkSession, path: str, malformed: str = "raise", multi_line: bool = False, **options) -> DataFrame:
    """Header CSV with all columns as text (no inference pass).

    Malformed rows (see ``_csv_rows``) never pass as data: ``malformed="raise"`` ends the job with the row's text, ``"drop"``
    leaves them out for ``malformed_csv`` to return.  With ``multi_line`` a quoted field may hold line feeds; files are not
    split then, so many files are needed for many tasks.  Without it a quote that is not closed on its line always ends the
    job, since the field's other lines could pass for rows.
    """
    if malformed not in ("raise", "drop"):
        raise ValueError("malformed must be 'raise' or 'drop'")
    rows, names = _csv_rows(spark, path, multi_line, **options)
    sound = F.col("_reason").isNull()
    fatal = F.lit(True) if malformed == "raise" else F.col("_reason") == "quote not closed"
    if malformed == "raise" or not multi_line:
        said = F.concat(F.lit("malformed CSV row ("), "_reason", F.lit(") in "), "_file", F.lit(": "), F.substring("_text", 1, 500))
        sound = F.when(sound, F.lit(True)).when(fatal, F.raise_error(said).cast("boolean")).otherwise(F.lit(False))
    return rows.where(sound).select(*[f"`{c}`" for c in names])


def malformed_csv(spark: SparkSession, path: str, multi_line: bool = False, **options) -> DataFrame:
    """The rows that ``read_csv_text(malformed="drop")`` leaves out: reason, text, file, and the fields as far as they were read."""
    rows, names = _csv_rows(spark, path, multi_line, **options)
    return rows.where(F.col("_reason").isNotNull()).select(
        F.col("_reason").alias("reason"), F.col("_text").alias("text"), F.col("_file").alias("file"),
        F.array(*[f"`{c}`" for c in names]).alias("fields"))


def typed(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Pick the schema's columns by name (missing ones become NULL) and cast text to their types.

    ``strict`` casts raise on text that is not a number (as the reference's
    numeric conversion does); ``strict=False`` turns it into NULL.
    """
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if not isinstance(f.dataType, T.StringType):
                c = C.trim_ws(c).cast(f.dataType) if strict else C.trim_ws(c).try_cast(f.dataType)
            cols.append(c.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType, null_tokens: list[str] | None = None,
                 malformed: str = "raise") -> DataFrame:
    """Text columns, pandas-style missing tokens -> NULL (D18), then the declared schema."""
    raw = C.normalise_missing(read_csv_text(spark, path, malformed), null_tokens)
    return typed(raw, schema)


# ---------------------------------------------------------------- S4/S5 JSON maps

def read_json_map(spark: SparkSession, path: str, key_type: str = "int", key: str = "id",
                  value: str = "description", range_bytes: int = json_map.RANGE_BYTES) -> DataFrame:
    """One JSON object ``{code: description}`` -> rows (key, value), read in byte ranges of ``range_bytes``.

    Of a repeated key the last entry counts; a null value stays as NULL; anything but a flat object raises.
    """
    fs, p = _fs_path(spark, path)
    status = fs.getFileStatus(p)
    found = json_map.read_entries(spark, status.getPath().toString(), status.getLen(), range_bytes)
    last = found.groupBy("key").agg(F.max_by(F.struct("value"), "place").alias("last"))
    return last.select(F.col("key").cast(key_type).alias(key), F.col("last.value").alias(value))


def read_labelled_map(spark: SparkSession, path: str, field: str = "target", key: str = "id",
                      value: str = "fraud", strict: bool = True) -> DataFrame:
    """``{"target": {"id": "Yes"|"No"|null, ...}}`` -> (id LONG, fraud BOOLEAN).

    The document is split on ``,`` by the text source (splittable, many tasks)
    and each fragment parsed with a pattern; valid because neither ids nor the
    Yes/No values contain commas.  A null value gives NULL.  An entry that is neither raises, or
    with ``strict=False`` stays as a row with a NULL id.
    """
    del field  # the single top-level field only wraps the map
    parts = spark.read.option("lineSep", ",").text(path)
    pat = r'"(\d+)"\s*:\s*(?:"([^"]*)"|null)[\s}]*$'
    wrapper = r'^\s*(\{\s*"[^"]*"\s*:\s*\{)?[\s}]*$'  # a map without entries
    kv = parts.where(~F.col("value").rlike(wrapper)).select(
        "value", F.regexp_extract("value", pat, 1).alias("_k"), F.regexp_extract("value", pat, 2).alias("_v"))
    bad = F.col("_k") == ""
    wrong = F.raise_error(F.concat(F.lit("not an entry of a label map: "), F.col("value"))) if strict else F.lit(None)
    return kv.select(F.when(bad, wrong.cast("long")).otherwise(F.expr("try_cast(_k AS BIGINT)")).alias(key),
                     C.parse_yes_no("_v").alias(value))


# ---------------------------------------------------------------- S6/S7 Parquet

def load_tables(spark: SparkSession, dataset_dir: str) -> Tables:
    """Cleaned transactions (required), users and cards (``None`` when absent)."""
    txn = spark.read.parquet(f"{dataset_dir}/transactions.parquet")
    users = spark.read.parquet(f"{dataset_dir}/users.parquet") if path_exists(
        spark, f"{dataset_dir}/users.parquet") else None
    cards = spark.read.parquet(f"{dataset_dir}/cards.parquet") if path_exists(
        spark, f"{dataset_dir}/cards.parquet") else None
    return Tables(txn, users, cards)


# ---------------------------------------------------------------- S8/S9/S12 sinks

def write_table(df: DataFrame, path: str, force: bool = False, fmt: str = "parquet",
                compression: str = "zstd") -> bool:
    """Write unless a finished table is there (``force`` overwrites).  Returns whether it wrote.

    The table is written to a hidden folder beside its place, marked as complete and then renamed, so an interrupted write
    leaves nothing that passes for a table: the next call does it again.  An overwritten table stays until the new one is
    complete.  One writer per table at a time.
    """
    spark = df.sparkSession
    if not force and is_committed(spark, path):
        return False
    aside = _beside(path, "writing")
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        w = w.option("compression", compression)
    elif fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(aside)
    _publish(spark, aside, path)
    return True


def csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str, **read_options) -> float:
    """CSV -> ZSTD Parquet with every column kept as text; skipped when present. Returns size in MB."""
    if not is_committed(spark, parquet_path):
        write_table(read_csv_text(spark, csv_path, **read_options), parquet_path, force=False)
    return size_mb(spark, parquet_path)


def write_report(name: str, df: DataFrame, out_dir: str, fmt: str = "parquet") -> str:
    """Chart data sink - one folder per report (the reference saves a PNG instead)."""
    path = f"{out_dir}/{name}"
    write_table(df, path, force=True, fmt=fmt)
    return path
