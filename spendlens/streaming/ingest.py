"""Incremental ingest of arriving transaction files (the P1 stage as a stream).

The batch stage re-reads a whole raw file and skips work only per output
table.  When raw CSV drops keep arriving, the same typing runs as a
Structured Streaming query over the landing folder: each file is processed
exactly once (the checkpoint records which files were committed), output
goes through the file sink's transactional log, and a restarted or failed
query resumes where it stopped.  ``availableNow`` processes what is there
and stops, so it can be scheduled like a batch job.

The checkpoint must live on shared storage (next to the output by default),
never on a machine-local folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..plans.stages import type_transactions
from ..sources import schemas as S

# Raw columns as text, in the file's column order (the header is checked against it).
RAW_TEXT = T.StructType([T.StructField(f.name, T.StringType(), True) for f in S.RAW_TRANSACTIONS.fields])


def transactions_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None
                        ) -> DataFrame:
    """Streaming DataFrame of typed transactions from CSV files landing in ``landing_dir``."""
    reader = (spark.readStream.schema(RAW_TEXT).option("header", True).option("enforceSchema", False)
              .option("quote", '"').option("escape", '"'))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return type_transactions(C.normalise_missing(reader.csv(landing_dir)))


def ingest_transactions(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint: str | None = None,
                        available_now: bool = True) -> StreamingQuery:
    """Start the ingest query; with ``available_now`` it stops after the files present now."""
    writer = (transactions_stream(spark, landing_dir).writeStream.format("parquet")
              .option("compression", "zstd")
              .option("checkpointLocation", checkpoint or f"{out_dir}/_checkpoint")
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(f"{out_dir}/data")
