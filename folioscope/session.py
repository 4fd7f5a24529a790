"""What a session needs for Python workers to run this library's functions."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver has it on a path of its own.

    On a cluster whose nodes don't share that folder, ship the package with --py-files.
    """
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a folder of its own; on a cluster that is
    an error, as no machine-local folder can be read by other executors.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = context._jsc.sc().getCheckpointDir()
        configured = current.get() if current.isDefined() else f"/tmp/folioscope-shared-{context.applicationId}"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, whoever reads it how often."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
