"""Rows written once in the folder that driver and executors share, where a plan would need them twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Without one, a temporary folder if driver and executors are one process; on a cluster an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cloakwork-checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written_once(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: a lost executor costs a read and no second computation."""
    place = f"{shared_folder(df.sparkSession)}/once-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
