"""A local session for tests, checks and benchmarks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from bitloom.session import SETTINGS


def with_folder(spark: SparkSession) -> SparkSession:
    """Give a session in one process a folder for written intermediate tables if it names none.

    Clusters name one in ``spark.checkpoint.dir``, which is never replaced.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_ is None and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark


def session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bitloom")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1"))
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("SPARK_LOG", "ERROR"))
    return with_folder(spark)
