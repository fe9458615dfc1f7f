"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows, which are whole documents, in one Arrow batch at most.
BATCH_ROWS = 128


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is set, a temporary one is made if driver and executors are one process (tests, a local shell); on a cluster that is an
    error, as each machine would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cloakwork-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches small enough for rows that are whole documents.

    Spark reads the bound from the session when the query runs and knows none in bytes, so a session that allows more than
    ``BATCH_ROWS`` rows is held to that from here on.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns called by their places (c0, c1, ...), so that no name can clash."""
    return df.toDF(*(f"c{n}" for n in range(len(df.columns))))


def text_digest(text: str = "text") -> Column:
    """What stands for a row's text where rows are told apart: 128 bits of it, and for a null one the empty string."""
    return F.coalesce(F.md5(F.col(text)), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
