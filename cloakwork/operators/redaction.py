"""Redaction and restoring of whole tables.

Without chunk dedup, redaction is one pass and no shuffle: in DataFrame functions where the rules allow it, else chunking, detection, merging and substitution in Arrow
batches. With dedup, equal chunks
are detected once: one shuffle of distinct chunk hashes, one to bring the spans back. The dedup pays only for a detector that costs more
than a shuffle.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.kernels import chunk, jsonwalk, text
from cloakwork.operators import native
from cloakwork.operators.detect import Detector, RuleDetector, detect_all
from cloakwork.operators.shared import written_once

PAIRS = "array<struct<from:string,to:string>>"
SPANS = "array<struct<start:int,end:int,class:string,score:float>>"
CHUNKS = native.CHUNKS
FIELDS = "array<struct<ord:int,text:string>>"
FAILED = "redaction failed"
NONCE_BYTES = 16
#: Whole documents in one Arrow batch at most.
BATCH_ROWS = 128


@dataclass(frozen=True)
class EngineConf:
    """What a job fixes once: the nonce is chosen on the driver, at random unless given, so retried tasks give equal placeholders.

    A value that is found inside another span only has no pair of its own, unless ``nested`` says so; the spans that are reported are merged all the same.
    """

    nonce: bytes = field(default_factory=lambda: secrets.token_bytes(NONCE_BYTES))
    detector: Detector = field(default_factory=RuleDetector)
    chunk_target: int = chunk.TARGET
    chunk_overlap: int = chunk.OVERLAP
    guard: bool = True
    hex_digits: int = text.HEX_DIGITS
    nested: bool = False


def find_spans(said: str, conf: EngineConf, nested: bool = False) -> list[text.Span]:
    """Merged spans of one text, with ``nested`` those inside others too; an error of the detector is the caller's."""
    return find_all_spans([said], conf, nested)[0]


def find_all_spans(texts: list[str], conf: EngineConf, nested: bool = False) -> list[list[text.Span]]:
    """The same for several texts, whose chunks go to the detector together."""
    parts = [chunk.split(t, conf.chunk_target, conf.chunk_overlap) if len(t.encode()) >= text.SPAN_MIN else [] for t in texts]
    asked = [p.text for own in parts for p in own if len(p.text.encode()) >= text.SPAN_MIN]
    found = iter(detect_all(conf.detector, asked))
    return [chunk.merge([(p, next(found) if len(p.text.encode()) >= text.SPAN_MIN else []) for p in own], nested) for own in parts]


def placeholder(kind: Column, value: Column, nonce: bytes, hex_digits: int = text.HEX_DIGITS) -> Column:
    """The placeholder as an expression."""
    digest = F.sha2(F.concat(F.lit(bytearray(nonce)), F.encode(value, "UTF-8")), 256)
    return F.concat(F.lit(text.PREFIX), F.upper(kind), F.lit("_"), F.substring(digest, 1, hex_digits))


def protected_blobs(said: Column) -> Column:
    """The quoted blobs in which nothing is replaced."""
    found = F.regexp_extract_all(said, F.lit(text.BLOB.pattern.decode()), F.lit(1))
    return F.filter(found, lambda b: F.octet_length(b) >= text.BLOB_MIN)


@dataclass
class _Redactor:
    conf: EngineConf

    def all(self, texts: list[str | None]) -> list[tuple[str | None, list[text.Pair], str]]:
        """Redacted text, pairs and status of each; a failure never gives the text, and is looked for text by text."""
        try:
            spans = iter(find_all_spans([t for t in texts if t is not None], self.conf, self.conf.nested))
            found = [None if t is None else next(spans) for t in texts]
        except Exception:
            found = [None] * len(texts)
        return [self.one(t, s) for t, s in zip(texts, found)]

    def one(self, said: str | None, spans: list[text.Span] | None = None) -> tuple[str | None, list[text.Pair], str]:
        if said is None:
            return None, [], "ok"
        try:
            spans = find_spans(said, self.conf, self.conf.nested) if spans is None else spans
            return *text.redact(said, spans, self.conf.nonce, self.conf.guard, self.conf.hex_digits), "ok"
        except Exception:
            return None, [], FAILED


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, for functions over whole documents: Spark bounds Arrow batches by rows only, so a session that allows more than ``BATCH_ROWS`` is held to that from here on."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def spread(df: DataFrame, keys: list[str], per_core: int = 4) -> DataFrame:
    """``df`` dealt over all cores by its ``keys``, for detectors that cost far more than a shuffle: a file is cut by its row groups, of which it may have but one."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _free(columns: list[str], made: tuple[str, ...]) -> None:
    """An error if a column would stand beside a made one of the same name."""
    if clash := sorted({c for c in columns if c.lower() in made}):
        raise ValueError(f"rename the columns {clash} first: the result has columns of these names")


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns called by their places, as Spark hands over no names with dots."""
    return df.toDF(*(f"c{n}" for n in range(len(df.columns))))


def _pairs(pairs: list[text.Pair]) -> list[dict]:
    return [{"from": a, "to": b} for a, b in pairs]


def redact_documents(docs: DataFrame, conf: EngineConf, text_col: str = "text") -> DataFrame:
    """``docs`` with redacted, mapping and status instead of the text column; every other column as it is.

    Null texts stay null, empty ones empty; rows may repeat. A column already called redacted, mapping or status is an error.
    With unbroken rules (and chunks of eight bytes or more) all of it is DataFrame functions, and texts in which no rule matches are only looked at.
    """
    rest = [c for c in docs.columns if c != text_col]
    _free(rest, ("redacted", "mapping", "status"))
    if isinstance(conf.detector, RuleDetector) and conf.detector.unbroken and conf.chunk_target >= 8:
        return _redact_natively(docs, conf, rest, text_col)
    plain = small_batches(docs).select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Redactor(conf)
        for batch in batches:
            out = worker.all(batch.column(len(rest)).to_pylist())
            pairs = pa.array([_pairs(o[1]) for o in out], pa.list_(pa.struct([("from", pa.string()), ("to", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([o[0] for o in out], pa.string()), pairs, pa.array([o[2] for o in out])], names=[*rest, "redacted", "mapping", "status"])

    return _numbered(plain).mapInArrow(run, f"{kinds}redacted string, mapping {PAIRS}, status string")


def _redact_natively(docs: DataFrame, conf: EngineConf, rest: list[str], text_col: str) -> DataFrame:
    said, hit, kept = F.col("said"), F.col("hit"), [f"c{n}" for n in range(len(rest))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(rest, kept)), F.col(f"`{text_col}`").alias("said"))
    rows = rows.withColumn("hit", F.coalesce(conf.detector.might_match(said), F.lit(False)))
    whole = F.array(F.struct(F.lit(0).alias("ord"), F.lit(0).alias("start"), said.alias("text"), F.lit(False).alias("hard_left"), F.lit(False).alias("hard_right"))).cast(CHUNKS)
    parts = F.when(native.may_break(said, conf.chunk_target), native.chunks(said, conf.chunk_target, conf.chunk_overlap)).otherwise(whole)
    found = native.rule_spans(parts, conf.detector.given)
    pairs = native.pairs_of(F.array_sort(found) if conf.nested else native.kept_spans(found), conf.nonce, conf.hex_digits)
    rows = rows.withColumn("pairs", F.when(hit, pairs))
    redacted = F.when(hit, native.folded(said, F.col("pairs"), guard=conf.guard)).otherwise(said)
    made = (redacted, F.coalesce("pairs", F.array().cast(PAIRS)), F.lit("ok"))
    return rows.select(*kept, *(m.alias(f"m{n}") for n, m in enumerate(made))).toDF(*rest, "redacted", "mapping", "status")


def chunks(said: Column, target: int = chunk.TARGET, overlap: int = chunk.OVERLAP) -> Column:
    """The parts of a text, in DataFrame functions."""
    return native.chunks(said, target, overlap)


def detect(said: Column, detector: Detector) -> Column:
    """Spans of each text; an error stops the job, as nothing undetected may pass."""

    @F.pandas_udf(SPANS)
    def run(column: pd.Series) -> pd.Series:
        long = [t is not None and len(t.encode()) >= text.SPAN_MIN for t in column]
        found = iter(detect_all(detector, [t for t, ask in zip(column, long) if ask]))
        return pd.Series([[dict(zip(("start", "end", "class", "score"), s)) for s in next(found)] if ask else [] for ask in long], dtype=object)

    return run(said)


def merge_spans(spans: DataFrame, keys: list[str], nested: bool = False) -> DataFrame:
    """Field spans from chunk spans, in windows.

    ``spans`` has ``keys``, chunk_ord, chunk_start, chunk_bytes, hard_left, hard_right, span_ord, start, end, class, score. A span inside the
    last kept one is dropped; as starts ascend and kept ends grow, that is the largest end before it. With ``nested`` only a span at the place of an
    earlier one is dropped.
    """
    cut = (F.col("hard_right") & (F.col("end") == F.col("chunk_bytes"))) | (F.col("hard_left") & (F.col("start") == 0))
    moved = spans.where(~cut).select(*keys, "chunk_ord", "span_ord", (F.col("chunk_start") + F.col("start")).alias("start"), (F.col("chunk_start") + F.col("end")).alias("end"), "class", "score")
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "chunk_ord", "span_ord", "class")
    same = Window.partitionBy(*keys, "start", "end", "class")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    best = moved.withColumn("before", before).withColumn("score", F.max("score").over(same))
    if nested:
        best = best.withColumn("before", F.lag("end").over(Window.partitionBy(*keys, "start", "end").orderBy("chunk_ord", "span_ord", "class")))
    return best.where(F.col("before").isNull() | (F.col("end") > F.col("before"))).select(*keys, "start", "end", "class", "score")


def detect_distinct_chunks(docs: DataFrame, conf: EngineConf, keys: list[str], text_col: str = "text") -> DataFrame:
    """Merged spans of each document, every distinct chunk detected once (before edges are judged, as those differ by place)."""
    parts = written_once(chunk_rows(small_batches(docs), conf, keys, text_col))
    found = parts.groupBy("hash").agg(F.first("part").alias("part")).select("hash", detect(F.col("part"), conf.detector).alias("spans"))
    return spans_of_chunks(parts.drop("part"), found, keys)


def chunk_rows(docs: DataFrame, conf: EngineConf, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, place, ends, hash and text (part) of every chunk that is long enough to hold a span."""
    parts = docs.select(*keys, F.explode(chunks(F.col(text_col), conf.chunk_target, conf.chunk_overlap)).alias("c"))
    parts = parts.select(*keys, F.col("c.ord").alias("chunk_ord"), F.col("c.start").alias("chunk_start"), F.octet_length("c.text").alias("chunk_bytes"), "c.hard_left", "c.hard_right", F.sha2("c.text", 256).alias("hash"), F.col("c.text").alias("part"))
    return parts.where(F.col("chunk_bytes") >= text.SPAN_MIN)


def spans_of_chunks(parts: DataFrame, found: DataFrame, keys: list[str], nested: bool = False) -> DataFrame:
    """Merged spans of each document from its chunks (:func:`chunk_rows`) and the spans of each hash."""
    met = parts.join(found, "hash").select("*", F.posexplode("spans").alias("span_ord", "s"))
    return merge_spans(met.select(*keys, "chunk_ord", "chunk_start", "chunk_bytes", "hard_left", "hard_right", "span_ord", "s.*"), keys, nested)


def restore(said: Column, mapping: Column, guard: bool = True) -> Column:
    """The originals back in place of the placeholders."""

    @F.pandas_udf("string")
    def run(column: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else text.restore(t, [(p["from"], p["to"]) for p in (m if m is not None else ())], guard) for t, m in zip(column, pairs)])

    return run(said, mapping)


def restore_native(said: Column, mapping: Column, guard: bool = True) -> Column:
    """The same in DataFrame functions, for placeholders without quotes, as all of ours are; a text without a mapping is not looked at."""
    return native.folded(said, mapping, back=True, guard=guard)


def substitute(said: Column, mapping: Column, guard: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(column: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else text.substitute(t, [(p["from"], p["to"]) for p in (m if m is not None else ())], guard)[0] for t, m in zip(column, pairs)])

    return run(said, mapping)


def extract_fields(kind: Column, body: Column) -> Column:
    """Ordered user texts of a request body; null if the body is malformed."""

    @F.pandas_udf(FIELDS)
    def run(kinds: pd.Series, bodies: pd.Series) -> pd.Series:
        def one(k: str, b: str | None) -> list | None:
            try:
                return [] if b is None else [{"ord": n, "text": f.text} for n, f in enumerate(jsonwalk.extract(k, b))]
            except jsonwalk.Bad:
                return None

        return pd.Series([one(k, b) for k, b in zip(kinds, bodies)])

    return run(kind, body)


def json_strings(body: Column) -> Column:
    """Non-empty string values of a JSON text in document order, keys left out; null if it is no JSON."""

    @F.pandas_udf("array<string>")
    def run(bodies: pd.Series) -> pd.Series:
        def one(b: str | None) -> list | None:
            try:
                return jsonwalk.string_values(b or "null")
            except jsonwalk.Bad:
                return None

        return pd.Series([one(b) for b in bodies])

    return run(body)


def redact_requests(requests: DataFrame, conf: EngineConf) -> DataFrame:
    """``requests`` (…, kind, body) with body redacted, mapping (first value wins over all fields) and status.

    A malformed body or a failing detector gives no body at all, never the original. Of equal keys of an object only the last goes
    on. A column already called mapping or status
    is an error.
    """
    rest = [c for c in requests.columns if c != "body"]
    _free(rest, ("mapping", "status"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in requests.schema.fields if f.name != "body")

    def one(kind: str, body: str | None) -> tuple[str | None, list[text.Pair], str]:
        if body is None or kind == jsonwalk.PASSTHROUGH:
            return body, [], "ok"
        try:
            (fields, cuts), merged, texts = jsonwalk.extract_all(kind, body), {}, []
            for f in fields:
                said, pairs = text.redact(f.text, find_spans(f.text, conf, conf.nested), conf.nonce, conf.guard, conf.hex_digits)
                texts.append(said)
                for value, token in pairs:
                    merged.setdefault(value, token)
            return jsonwalk.reassemble(body, fields, texts, cuts), list(merged.items()), "ok"
        except Exception:
            return None, [], FAILED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(k, b) for k, b in zip(batch.column(-2).to_pylist(), batch.column(-1).to_pylist())]
            pairs = pa.array([_pairs(o[1]) for o in out], pa.list_(pa.struct([("from", pa.string()), ("to", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([o[0] for o in out], pa.string()), pairs, pa.array([o[2] for o in out])], names=[*rest, "body", "mapping", "status"])

    plain = small_batches(requests).select(*(F.col(f"`{c}`") for c in rest), "kind", "body")
    return _numbered(plain).mapInArrow(run, f"{kinds}body string, mapping {PAIRS}, status string")


def request_mapping(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One mapping per request from field pairs (``keys``, field_ord, pair_ord, from, to): the first of equal values wins."""
    first = F.row_number().over(Window.partitionBy(*keys, "from").orderBy("field_ord", "pair_ord"))
    kept = pairs.withColumn("_n", first).where("_n = 1")
    ordered = F.array_sort(F.collect_list(F.struct("field_ord", "pair_ord", "from", "to")))
    return kept.groupBy(*keys).agg(F.transform(ordered, lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to"))).alias("mapping"))
