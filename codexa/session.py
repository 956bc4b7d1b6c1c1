"""Session helpers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


#: Bytes of an Arrow batch: what a Python worker holds follows from it, not from the length of the texts.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and keeps the bytes of their batches small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder of spark.checkpoint.dir, which a cluster must set; a local master gets a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codexa-"))
    return df.checkpoint()
