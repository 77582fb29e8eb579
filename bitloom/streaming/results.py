"""Results that arrive over time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.operators.analytics import CASE, ranked
from bitloom.schemas import KEY, RESULT
from bitloom.sources.manifests import results_manifest, upsert_results_manifest

_STREAM_SCHEMA = T.StructType([
    *RESULT.fields, T.StructField("batch", T.StringType()),
    T.StructField("result_set", T.StringType())])


def stream_results(spark: SparkSession, path: str, sink: str, checkpoint: str,
                   available_now: bool = True):
    """Tail a results folder (as ``write_results`` lays it out) into a manifest log.

    Each micro-batch writes its manifest rows to ``epoch=<id>`` of the sink, replacing that epoch
    if it is replayed; nothing already written is read or rewritten. ``current_manifest`` is the
    upserted view.
    """
    records = spark.readStream.schema(_STREAM_SCHEMA).json(path).withColumn(
        "file", F.concat_ws("/", F.col("solver.type"), F.concat(
            F.col("problem.instance_id"), F.lit("--"), F.col("run_id"), F.lit(".json"))))

    def append(rows: DataFrame, epoch: int) -> None:
        (results_manifest(rows).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}"))

    writer = records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# A sink is a log of epochs; what is current is the latest row per key. ``compact`` writes a snapshot of it beside the
# log, and readers then take the newest snapshot and the epochs after it.


def _snapshot(spark: SparkSession, sink: str) -> tuple[int, DataFrame | None]:
    """The last epoch of the newest snapshot and its rows; (-1, None) without any."""
    try:
        every = spark.read.parquet(f"{sink}_snapshots")
    except AnalysisException:
        return -1, None
    upto = every.agg(F.max("upto")).first()[0]
    return (-1, None) if upto is None else (upto, every.where(F.col("upto") == upto).drop("upto"))


def _latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Latest row per key with the epoch it came in, by ``version`` first where the log has one.

    Folders of epochs before the newest snapshot are not opened.
    """
    upto, old = _snapshot(spark, sink)
    log = spark.read.parquet(sink).withColumn("epoch", F.col("epoch").cast("bigint")).where(F.col("epoch") > upto)
    rows = log if old is None else old.unionByName(log)
    payload = [c for c in log.columns if c not in keys]
    age = F.struct(*[c for c in ("version", "epoch") if c in payload])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), age).alias("r")).select(*keys, "r.*")


def compact(spark: SparkSession, sink: str, keys: list[str]) -> int:
    """Write the current rows as a snapshot up to the last epoch, whose number is returned.

    A snapshot appears when its job commits, so a failed one changes nothing and may be repeated. Epochs up to
    a snapshot are never read again and may be deleted, the last one excepted.
    """
    upto = max(_snapshot(spark, sink)[0], spark.read.parquet(sink).agg(F.max("epoch").cast("bigint")).first()[0])
    _latest(spark, sink, keys).write.mode("overwrite").parquet(f"{sink}_snapshots/upto={upto}")
    return upto


MANIFEST_KEYS = ["batch", "result_set", "run_id", "instance_id"]
INCUMBENT_KEYS = [*KEY, "solver"]
BOARD_KEYS = [*CASE, "solver", "run_id"]


def current_manifest(spark: SparkSession, sink: str) -> DataFrame:
    """Latest row per run and instance over all epochs."""
    latest = _latest(spark, sink, MANIFEST_KEYS).drop("epoch")
    return upsert_results_manifest(latest.limit(0), latest)


def stream_incumbent(runs: DataFrame) -> DataFrame:
    """Best energy so far per instance and solver of a (streaming) run table.

    State is one row per (instance, solver); write it in update mode. Missing and NaN energies never win.
    """
    real = F.col("energy").isNotNull() & ~F.isnan("energy")
    return runs.groupBy(*KEY, "solver").agg(
        F.min(F.when(real, F.struct("energy", "run_id"))).alias("best")).select(
        *KEY, "solver", F.col("best.energy").alias("energy"), F.col("best.run_id").alias("run_id"))


def write_incumbents(runs: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Log the incumbents that a micro-batch changed to ``epoch=<id>`` of the sink."""

    def append(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    writer = (stream_incumbent(runs).writeStream.outputMode("update").foreachBatch(append)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_incumbents(spark: SparkSession, sink: str) -> DataFrame:
    """Incumbents as of the latest epoch that touched them."""
    return _latest(spark, sink, INCUMBENT_KEYS).drop("epoch")


def stream_leaderboard(runs: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Keep the log behind a live leaderboard of a stream of runs.

    ``runs``: batch, result_set, instance_id, solver, run_id, version (number, such as a file's time), energy,
    wall_seconds. Each micro-batch writes the newest version of each of its runs to ``epoch=<id>`` of the sink, replaced on
    replay; the log is all the state there is. A run that comes again, late or rewritten, counts once. Missing energies (NULL
    or NaN) and times are left out of means.
    """
    def number(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value).alias(name)

    keyed = runs.select(*BOARD_KEYS, F.col("version").cast("double").alias("version"), number("energy"), number("wall_seconds"))

    def append(rows: DataFrame, epoch: int) -> None:
        newest = rows.groupBy(*BOARD_KEYS).agg(F.max_by(F.struct("version", "energy", "wall_seconds"), "version").alias("r"))
        newest.select(*BOARD_KEYS, "r.*").write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    writer = keyed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_leaderboard(spark: SparkSession, sink: str) -> DataFrame:
    """``analytics.leaderboard`` of the newest versions of all runs so far."""
    return ranked(_latest(spark, sink, BOARD_KEYS))
