"""Shared storage for cut lineage, read from the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where none is set, a temporary one on a single machine, an error on a cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        one_machine = context.master == "local" or context.master.startswith("local[")
        if not named and not one_machine:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="viaflux-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` with its rows written to the checkpoint folder, so that later stages read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
