"""Stages of a comparison: tables that later steps read more than once are written once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows are dealt by a key."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt by a key to a fixed number of tasks, so that costly work on its rows, or on groups of the key, is spread evenly.

    Adaptive plans would join small shuffles to about as many tasks as cores, one of
    which is left over, and a small file of many rows would be one task.
    """
    return df.repartition(tasks(df.sparkSession), by)


def materialized(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a table in the cluster's shared folder (``spark.checkpoint.dir``; only in local mode a temporary one stands in for it).

    It keeps plans small: a tree's hashes take a join a level, and matching reads them
    many times. The files outlive an executor, so nothing is computed twice.

    by: a pair's id. The table is dealt by it, and all later joins, windows and counts
    whose keys hold it take place in its partitions, without another exchange.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="stages"))
    if not by:
        return df.checkpoint(eager=True)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Adaptive plans do not say how their rows are dealt; this stage only deals them.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return dealt(df, by).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
