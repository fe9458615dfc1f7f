"""Routing, request checks and restore modes, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.kernels.jsonwalk import PASSTHROUGH, ROUTES

MAX_BODY_BYTES = 32 << 20
#: Headers that belong to one hop of a connection.
HOP_HEADERS = ("connection", "proxy-connection", "keep-alive", "transfer-encoding", "te", "trailer", "upgrade")


def route(method: Column, path: Column) -> Column:
    """The request family of a method and path; what is not known passes through."""
    bare = F.regexp_replace(path, "/+$", "")
    kind = F.lit(PASSTHROUGH)
    for end, name in reversed(ROUTES):
        kind = F.when(bare.endswith(end), name).otherwise(kind)
    return F.when(method == "POST", kind).otherwise(PASSTHROUGH)


def redactable(kind: Column) -> Column:
    return kind != PASSTHROUGH


def streams_events(kind: Column) -> Column:
    return kind != PASSTHROUGH


def key_path(path: Column) -> Column:
    """struct(token, rest, ok) of ``/_k/<token>/<rest>``; without a rest it is ``/``, without the mark the path itself."""
    keyed = path.startswith("/_k/")
    rest = F.regexp_extract(path, "^/_k/([^/]*)(/.*)?$", 2)
    token = F.regexp_extract(path, "^/_k/([^/]*)(/.*)?$", 1)
    return F.struct(
        F.when(keyed, token).otherwise("").alias("token"),
        F.when(keyed, F.when(rest == "", "/").otherwise(rest)).otherwise(path).alias("rest"),
        keyed.alias("ok"),
    )


def body_status(body: Column, limit: int = MAX_BODY_BYTES) -> Column:
    return F.when(F.octet_length(body) > limit, "too_large").otherwise("ok")


def is_event_stream(content_type: Column) -> Column:
    return F.coalesce(content_type.startswith("text/event-stream"), F.lit(False))


def is_json(content_type: Column) -> Column:
    return F.coalesce(content_type.startswith("application/json"), F.lit(False))


def restore_mode(kind: Column, content_type: Column, pairs: Column) -> Column:
    """passthrough without anything to restore, else stream-restore or buffered-restore."""
    stream = is_event_stream(content_type) | (streams_events(kind) & ~is_json(content_type))
    return F.when(pairs == 0, "passthrough").when(stream, "stream-restore").otherwise("buffered-restore")


def strip_hop_headers(headers: Column) -> Column:
    """A header map without the hop headers, whatever their case."""
    return F.map_filter(headers, lambda name, _: ~F.lower(name).isin(*HOP_HEADERS))


def upstream_headers(headers: Column) -> Column:
    """A request's headers as they go on: no hop headers, no length, and an answer that is not compressed."""
    kept = F.map_filter(strip_hop_headers(headers), lambda name, _: ~F.lower(name).isin("content-length", "accept-encoding", "host"))
    return F.map_concat(kept, F.create_map(F.lit("Accept-Encoding"), F.lit("identity")))


def answer_headers(headers: Column) -> Column:
    """An answer's headers as they go back: all but the length, which restoring changes."""
    return F.map_filter(headers, lambda name, _: F.lower(name) != "content-length")


def error_body(message: Column) -> Column:
    return F.to_json(F.struct(F.struct(message.alias("message")).alias("error")))


def routed(requests: DataFrame) -> DataFrame:
    """``requests`` (method, path, body) with kind, redactable, streams_events and status."""
    kind = route(F.col("method"), F.col("path"))
    return requests.withColumns({"kind": kind, "redactable": redactable(kind), "streams_events": streams_events(kind), "status": body_status(F.col("body"))})
