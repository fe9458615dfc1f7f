"""Streaming jobs over whole texts: redaction through a span store into an idempotent sink, and answers that wait for their mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakwork.operators.jobs import restore_answers
from cloakwork.operators.redaction import EngineConf
from cloakwork.operators.store import SpanStore


class BatchSink:
    """A folder of Parquet with one partition for each micro-batch. A batch that is written again replaces itself, so a replay adds nothing."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.folder).parquet(self.folder)


def redact_stream(docs: DataFrame, conf: EngineConf, keys: list[str], name: str, folder: str, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts the redaction of streamed ``docs`` (``keys``, text, ...): see :meth:`SpanStore.redact`.

    Every micro-batch meets the span store ``name`` in ``folder``: a chunk that an earlier batch, run or job has seen is not detected again. A restarted query
    that repeats its last batch finds its chunks there, and replaces its rows in the sink ``out``. Rows of one key may come in several batches, but once in
    each.
    """
    sink = BatchSink(out)

    def run(rows: DataFrame, batch: int) -> None:
        store = SpanStore(rows.sparkSession, folder, name)
        sink.write(store.redact(rows, conf, keys), batch)

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def answers_with_mappings(answers: DataFrame, mappings: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """``answers`` (request_id, ts, kind, content_type, body, ...) restored with ``mappings`` (request_id, ts, mapping), both streams or both tables.

    An answer is held until its mapping comes, or until ``wait`` of event time has gone by without one; then it goes out as it is, placeholders and all. A mapping may be up
    to ``wait`` older or younger than its answer and is forgotten after that. Each request has one mapping and one answer.
    """
    a, m = answers, mappings.select(F.col("request_id").alias("_request"), F.col("ts").alias("_ts"), "mapping")
    if answers.isStreaming:
        a, m = a.withWatermark("ts", wait), m.withWatermark("_ts", wait)
    near = F.col("_ts").between(F.col("ts") - F.expr(f"interval {wait}"), F.col("ts") + F.expr(f"interval {wait}"))
    return restore_answers(a.join(m, (F.col("request_id") == F.col("_request")) & near, "left").drop("_request", "_ts"))
