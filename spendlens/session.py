"""SparkSession helpers.

Library code never creates its own session: every public function takes
DataFrames (or a session) from the caller.  ``local_session`` exists for
tests and the bench, and ``checkpoint_dir`` finds the shared folder a
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spendlens") -> SparkSession:
    """A local-mode session configured like the production one (AQE on, UTC, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPENDLENS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir(spark) is None:  # local runs only: a cluster names its own shared folder
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-ckpt-"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder that ``spark.checkpoint.dir`` (or the context) names, if any."""
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def materialize(df: DataFrame, how: str = "write", folder: str | None = None) -> DataFrame:
    """Compute ``df`` once for several passes.

    ``write`` stores it as Parquet in ``folder`` (by default the session's checkpoint folder) and reads it
    back, which cuts lineage and keeps column pruning; the files go when the session ends.  Without a folder
    the plan stays lazy.  ``cache`` persists, ``none`` leaves the plan lazy.
    """
    if how == "cache":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    folder = folder or checkpoint_dir(spark)
    if how == "none" or not folder:
        return df
    path = f"{folder}/materialized-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions_for(input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024,
                           minimum: int = 200) -> int:
    """Shuffle partition count that keeps each reducer's input near ``target_partition_bytes``.

    Set ``spark.sql.shuffle.partitions`` to this for the largest shuffle of a job
    (AQE then coalesces small partitions and splits skewed ones at run time):
    100 TB of shuffle input at 256 MB per partition is about 400,000 partitions.
    """
    return max(minimum, -(-int(input_bytes) // int(target_partition_bytes)))
