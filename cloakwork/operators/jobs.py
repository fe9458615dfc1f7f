"""Whole jobs: requests on their way up, answers on their way back, and what may be logged of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.kernels import jsonwalk, text
from cloakwork.kernels.sse import Restorer
from cloakwork.operators import requests as rq
from cloakwork.operators import tokens
from cloakwork.operators.redaction import FAILED, EngineConf, _free, extract_fields, find_spans, redact_requests, small_batches
from cloakwork.operators.shared import written_once
from cloakwork.operators.store import SpanStore

#: What is answered where a request does not go on.
REFUSALS = {"unauthorized": 401, "request body too large": 413, FAILED: 502}
LOG = "field int, field_len long, spans int, classes array<string>"


def upstream_url(base: str, path: Column, query: Column) -> Column:
    asked = F.coalesce(query, F.lit(""))
    return F.concat(F.lit(base.rstrip("/")), path, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))


def forward_requests(requests: DataFrame, conf: EngineConf, secret: bytes, base: str, now: int | None = None, limit: int = rq.MAX_BODY_BYTES) -> DataFrame:
    """``requests`` (..., method, path, query, headers, body) as they go upstream.

    Authorised by the path's token, held to ``limit`` bytes, routed, redacted. Adds kind, status_code, error, url, upstream_headers and
    mapping, and body is the redacted one. What is refused has no url and no body, only its status code and error body. A null
    body is empty. Columns that bear the names of the added ones, or begin with an underscore as the job's own do, are an error.
    """
    _free(requests.columns, ("kind", "status_code", "error", "url", "upstream_headers", "mapping", "status", "_auth", "_refused", "_why"))
    auth = requests.withColumn("_auth", tokens.authorise(F.col("path"), secret, now))
    large = F.octet_length(F.coalesce("body", F.lit(""))) > limit
    refused = F.when(~F.col("_auth.ok"), "unauthorized").when(large, "request body too large")
    kind = F.when(F.col("_refused").isNull(), rq.route(F.col("method"), F.col("_auth.rest"))).otherwise(jsonwalk.PASSTHROUGH)
    routed = auth.withColumn("_refused", refused).withColumn("kind", kind).withColumn("body", F.when(F.col("_refused").isNull(), F.coalesce("body", F.lit(""))))
    done = redact_requests(routed, conf)
    why = F.coalesce("_refused", F.when(F.col("status") == FAILED, FAILED))
    code = F.lit(None).cast("int")
    for said, number in REFUSALS.items():
        code = F.when(F.col("_why") == said, number).otherwise(code)
    goes = F.col("_why").isNull()
    return (
        done.withColumn("_why", why)
        .withColumns(
            {
                "status_code": F.when(goes, 200).otherwise(code),
                "error": F.when(~goes, rq.error_body(F.col("_why"))),
                "url": F.when(goes, upstream_url(base, F.col("_auth.rest"), F.col("query"))),
                "upstream_headers": F.when(goes, rq.upstream_headers(F.col("headers"))),
            }
        )
        .drop("_auth", "_refused", "_why", "status")
    )


def restore_answers(answers: DataFrame, guard: bool = True) -> DataFrame:
    """``answers`` (..., kind, content_type, body, mapping) with mode, and the originals back in body.

    Without a mapping the body stays untouched and meets no Python. An event stream is restored event by event, as its family
    writes them; any other body as a whole, as raw text. A null body stays null. All is one pass over ``answers``. A column called mode is an error.
    """
    _free(answers.columns, ("mode",))
    mode = rq.restore_mode(F.col("kind"), F.col("content_type"), F.greatest(F.size("mapping"), F.lit(0)))

    @F.pandas_udf("string")
    def back(kinds: pd.Series, modes: pd.Series, bodies: pd.Series, mappings: pd.Series) -> pd.Series:
        def one(kind: str, mode: str, body: str | None, mapping) -> str | None:
            if body is None:
                return None
            pairs = [(p["from"], p["to"]) for p in mapping]
            if mode == "buffered-restore":
                return text.restore(body, pairs, guard)
            restorer = Restorer(kind, pairs, guard=guard)
            lines = restorer.feed(body)
            rest = restorer.close()
            return "".join(f"{line}\n" for line in lines + rest)

        return pd.Series([one(*row) for row in zip(kinds, modes, bodies, mappings)])

    said = small_batches(answers).withColumn("mode", mode)
    quiet = F.col("mode") == "passthrough"
    restored = back("kind", "mode", F.when(~quiet, F.col("body")), F.when(~quiet, F.col("mapping")))
    return said.withColumn("body", F.when(quiet, F.col("body")).otherwise(restored))


def safe_log(mapping: Column) -> Column:
    """What may be logged of a mapping: its placeholders, no value."""
    return F.transform(mapping, lambda p: p["to"])


def field_log(requests: DataFrame, conf: EngineConf, keys: list[str]) -> DataFrame:
    """One row for each field of ``requests`` (..., kind, body): ``keys``, its place, its length in bytes, its spans and their classes.

    No text and no value appears. Malformed bodies have no fields.
    """
    kinds = "".join(f"`{k}` {requests.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: tuple[list, ...] = ([], [], [], [])
            for n, (kind, body) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist())):
                try:
                    fields = jsonwalk.extract(kind, body) if body is not None else []
                except jsonwalk.Bad:
                    fields = []
                for k, field in enumerate(fields):
                    spans = find_spans(field.text, conf)
                    rows.append(n)
                    for column, value in zip(out, (k, len(field.text.encode()), len(spans), [s[2] for s in spans])):
                        column.append(value)
            at = pa.array(rows, pa.int64())
            made = [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *made], names=[*keys, "field", "field_len", "spans", "classes"])

    return small_batches(requests).mapInArrow(run, kinds + LOG)


def stored_field_log(requests: DataFrame, conf: EngineConf, keys: list[str], store: SpanStore) -> DataFrame:
    """The same through a span store, with chunks and, of these, cached: how many the store knew, and the detector was not asked for."""
    fields = small_batches(requests).select(*keys, F.explode(extract_fields(F.col("kind"), F.col("body"))).alias("f")).select(*keys, F.col("f.ord").alias("field"), F.col("f.text").alias("text"))
    return store.report(written_once(fields), conf, [*keys, "field"])
