"""A store of detected chunks that outlives a job.

The store is a folder of Parquet: the hash of a chunk's text and the spans that a detector found in it, under a folder for the detector and
one for each of ``BUCKETS`` buckets of hashes. No text is in it. A run looks its chunks up by an anti-join with the buckets it
meets, detects what is new, each distinct chunk once, and appends that once, by Spark's committer. So a conversation that has grown costs its last chunk only, as chunks but the
last do not change, and a repeated one nothing. Spans are stored before edges are judged, since the same text may stand at another place.

Two runs at the same time may both append a chunk; readers take each hash once.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators import native
from cloakwork.operators.redaction import FAILED, PAIRS, SPANS, EngineConf, _free, chunk_rows, detect, small_batches, spans_of_chunks, substitute
from cloakwork.operators.shared import written_once

BUCKETS = 64


def bucket(digest: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a hexadecimal hash, by its first digits."""
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


class SpanStore:
    """Spans by chunk of the detector that ``name`` stands for: another model, or another version of one, needs another name."""

    def __init__(self, spark: SparkSession, folder: str, name: str) -> None:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
            raise ValueError("a detector's name is letters, digits, dots, dashes and underscores")
        self.spark, self.place = spark, f"{folder.rstrip('/')}/{name}"

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """(hash, spans, bucket), each hash once; of the given buckets only, whose folders alone are read then."""
        try:
            rows = self.spark.read.schema(f"hash string, spans {SPANS}, bucket int").parquet(self.place)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], f"hash string, spans {SPANS}, bucket int")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).dropDuplicates(["hash"])

    def detect_chunks(self, docs: DataFrame, conf: EngineConf, keys: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """The chunks of ``docs`` without their texts and with ``cached``, whether the store knew them before; and (hash, spans) of them all.

        Detects each distinct unknown chunk once and appends it. A detector's error stops the run, and nothing is appended.
        """
        chunked = chunk_rows(small_batches(docs), conf, keys, text_col)
        parts = written_once(chunked.withColumn("bucket", bucket(F.col("hash"))))
        met = [r[0] for r in parts.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        known = written_once(self.read(met).join(parts.select("hash").distinct(), "hash", "left_semi"))
        new = parts.join(known.select("hash"), "hash", "left_anti").groupBy("hash", "bucket").agg(F.first("part").alias("part"))
        found = written_once(new.select("hash", detect(F.col("part"), conf.detector).alias("spans"), "bucket"))
        if not found.isEmpty():
            found.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.place)
        marked = parts.drop("part", "bucket").join(known.select("hash", F.lit(True).alias("cached")), "hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
        return marked, known.select("hash", "spans").unionByName(found.select("hash", "spans"))

    def detect(self, docs: DataFrame, conf: EngineConf, keys: list[str], text_col: str = "text", nested: bool = False) -> DataFrame:
        """Merged spans (``keys``, start, end, class, score), as :func:`~cloakwork.operators.redaction.detect_distinct_chunks` finds them."""
        parts, spans = self.detect_chunks(docs, conf, keys, text_col)
        return spans_of_chunks(parts.drop("cached"), spans, keys, nested)

    def report(self, docs: DataFrame, conf: EngineConf, keys: list[str], text_col: str = "text") -> DataFrame:
        """What may be logged of each text: ``keys``, field_len (bytes), spans, classes, and of its chunks how many there are, and were cached."""
        parts, spans = self.detect_chunks(docs, conf, keys, text_col)
        merged = spans_of_chunks(parts.drop("cached"), spans, keys).groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("spans"), F.array_sort(F.collect_list("class")).alias("classes"))
        counted = parts.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.count_if("cached").cast("int").alias("cached"))
        out = docs.select(*keys, F.octet_length(text_col).cast("long").alias("field_len")).join(counted, keys, "left").join(merged, keys, "left")
        nothing = {"spans": F.lit(0), "classes": F.array().cast("array<string>"), "chunks": F.lit(0), "cached": F.lit(0)}
        return out.select(*keys, "field_len", *(F.coalesce(c, empty).alias(c) for c, empty in nothing.items()))

    def redact(self, docs: DataFrame, conf: EngineConf, keys: list[str], text_col: str = "text") -> DataFrame:
        """``docs``, one row for each value of ``keys``, with redacted, mapping and status instead of the text column; spans come from the store where it has them.

        Keys must not be null or repeat. A text whose spans are not all in it, as no text's should be, is given as failed.
        """
        rest = [c for c in docs.columns if c != text_col]
        _free(rest, ("redacted", "mapping", "status"))
        spans = self.detect(docs, conf, keys, text_col, conf.nested)
        listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("minus_end"), F.lit(0).alias("ord"), F.lit(0).alias("n"), "class"))).alias("found"))
        data = F.col(text_col).cast("binary")
        value = lambda s: F.decode(F.substring(data, s["start"] + 1, -s["minus_end"] - s["start"]), "UTF-8")
        kept = F.transform("found", lambda s: F.struct(value(s).alias("value"), s["class"].alias("class")))
        pairs = F.coalesce(native.pairs_of(kept, conf.nonce, conf.hex_digits), F.array().cast(PAIRS))
        met = docs.join(listed, keys, "left").withColumn("mapping", pairs)
        sound = F.coalesce(F.forall("found", lambda s: -s["minus_end"] <= F.octet_length(text_col)), F.lit(True))
        redacted = F.when(F.size("mapping") > 0, substitute(F.when(F.size("mapping") > 0, F.col(text_col)), F.col("mapping"), conf.guard)).otherwise(F.col(text_col))
        return met.select(*rest, F.when(sound, redacted).alias("redacted"), F.when(sound, F.col("mapping")).otherwise(F.array().cast(PAIRS)).alias("mapping"), F.when(sound, "ok").otherwise(FAILED).alias("status"))
