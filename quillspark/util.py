"""Small helpers every operator shares: table access, input spreading, checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores when its scan has fewer splits than there are cores.

    A table that arrives as one row group would run all Python work in one task. Inputs that already
    have enough splits pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, F.xxhash64(F.col(key)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; only where none is set (tests, local mode) set one."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later steps neither repeat nor lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
