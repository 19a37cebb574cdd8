"""Cutting lineage: intermediate tables that survive the loss of an executor.

A staged table is written to reliable storage (the folder in ``spark.checkpoint.dir``), so later
operators start from it: it is computed once, and plans that read it several times stay small.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session without one gets its own."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if known:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and continue from the stored rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
