"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the plans rely on: adaptive execution splits hot join keys at run time, also
# where the join feeds an aggregation on the same key (that is what the "force" flag is for).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Keys compress well, so a shuffled MB is up to 40 MB of a task's memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4MB",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.files.maxPartitionBytes": "8MB",
    # Before a plan runs, sizes are guesses from compressed files, and rows that explode makes are not counted, so
    # nothing is broadcast on a guess: a table is once its measured size allows it.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Facts of a few huge instances fill few partitions, and yet their join must not bring an instance into one task.
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
    # A union that counts as partitioned like its children can lose that when they are planned anew at run time: joins then meet
    # unequal numbers of partitions.
    "spark.sql.unionOutputPartitioning": "false",
    # Tables between the steps are written, so shuffle files go when the query that made them ends.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Work whose shuffles outgrow its input by far is done in slices of about so many rows, but in no more slices than these.
SLICE_ROWS = 2_000_000
SLICES = 8
# Rows of a written file at most: files are what readers share out, and bits or ranges of many rows fill few bytes.
FILE_ROWS = 250_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that may already be running."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``, which the cluster names.

    Sessions must have the setting; ``tools/spark.py`` gives tests and local runs one of their own.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None)
    application = context.applicationId
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/bitloom-{application}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from there.

    This ends the lineage (iterations stay short, lost executors reread files) and, unlike an RDD
    checkpoint, keeps column pruning and file statistics for the plans that follow.
    """
    configure(df.sparkSession)
    return written(df, FILE_ROWS)


def written(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """``cut`` under whatever settings the session has; 0 leaves the rows of a file unbounded."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_slices(work: Callable[..., DataFrame], tables: list[DataFrame], by: list[str], rows: int) -> DataFrame:
    """``work(*tables)``, for large tables on one slice of them after the other, so that shuffle files of one slice only are kept.

    Rows that agree in ``by`` share a slice, and ``work`` must not bring others together. ``rows`` are those of the largest
    table; every slice reads all tables, and its result is written.
    """
    count = min(SLICES, 1 + rows // SLICE_ROWS)
    if count == 1:
        return work(*tables)
    number = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by]), F.lit(count))
    done = [cut(work(*[df.where(number == k) for df in tables])) for k in range(count)]
    return reduce(lambda a, b: a.unionByName(b), done)
