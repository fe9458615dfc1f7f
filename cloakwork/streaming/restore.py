"""Restoring of event streams: in batch by stream, and as a stateful streaming query.

Rows are (stream_id, seq, line, closes, kind, mapping); a line is text of one stream, in the order of seq, and the
row that closes a stream flushes what is held. The first row of a stream brings its kind and mapping; later ones need none. The state of a
stream is these and the unsettled end of its block. A stream without a mapping passes through untouched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloakwork.kernels.sse import Restorer, State

OUT = "stream_id string, seq long, ord int, line string"
SCHEMA = pa.schema([("stream_id", pa.string()), ("seq", pa.int64()), ("ord", pa.int32()), ("line", pa.string())])
STATE = "raw string, content string, sent int, last string, seq long, kind string, pairs string"
IDLE_MS = 3_600_000


def _pairs(mapping) -> list[tuple[str, str]]:  # noqa: ANN001
    return [(p["from"], p["to"]) for p in (mapping if mapping is not None else ())]


def _play(restorer: Restorer, line: str | None, closes: bool) -> list[str]:
    out = restorer.feed(line + "\n") if line is not None else []
    return out + restorer.close() if closes else out


class _Playing:
    """The stream whose lines are being read, in order, from sorted batches; it may go on in the next one."""

    def __init__(self) -> None:
        self.stream, self.restorer = None, None

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("stream_id")
        cuts = [0, *(pc.indices_nonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1))).to_numpy() + 1).tolist(), len(ids)] if len(ids) else [0]
        parts = [self._stream(batch.slice(s, e - s)) for s, e in zip(cuts, cuts[1:])]
        return pa.concat_batches(parts) if parts else pa.RecordBatch.from_pylist([], SCHEMA)

    def _stream(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """Some lines of one stream. Without anything to restore its columns go on as they are."""
        stream = rows.column("stream_id")[0].as_py()
        if stream != self.stream or stream is None:
            pairs = next((_pairs(m) for m in rows.column("mapping").to_pylist() if m), []) if rows.column("mapping").null_count < len(rows) else []
            kind = next((k for k in rows.column("kind").to_pylist() if k is not None), "") if pairs else ""
            self.stream, self.restorer = stream, Restorer(kind, pairs) if pairs else None
        if self.restorer is None:
            said = rows.filter(pc.is_valid(rows.column("line")))
            return pa.RecordBatch.from_arrays([said.column("stream_id"), said.column("seq"), pa.array([0] * len(said), pa.int32()), said.column("line")], schema=SCHEMA)
        out: tuple[list, list, list] = ([], [], [])
        for seq, line, closes in zip(*(rows.column(c).to_pylist() for c in ("seq", "line", "closes"))):
            for n, said in enumerate(_play(self.restorer, line, bool(closes))):
                for column, value in zip(out, (seq, n, said)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array([stream] * len(out[0]), pa.string()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], schema=SCHEMA)


def restore_batch(lines: DataFrame, every_row: bool = False) -> DataFrame:
    """Restored lines of whole streams: stream_id, seq (of the line that let them out), ord, line.

    One pass: lines are shuffled by stream and sorted, and a task plays its streams one after the other, so no stream is gathered in memory. A stream's first row by
    seq brings its kind and mapping (or a later one that the same Arrow batch holds); one that has nothing to restore goes on by whole columns. ``every_row``, that each row brings its stream's mapping, makes no difference
    any more.
    """
    lines = lines.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "line", "closes", "kind", F.when(F.size("mapping") > 0, F.col("mapping")).alias("mapping"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        playing = _Playing()
        for batch in batches:
            yield playing.rows(batch)

    return lines.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, OUT)


def restore_stream(lines: DataFrame, timeout: str = GroupStateTimeout.ProcessingTimeTimeout, idle_ms: int = IDLE_MS) -> DataFrame:
    """The same on a stream. Rows of a batch are sorted by seq; a stream's rows must not arrive in a later batch than
    higher ones of it. State goes when the closing row comes, or ``idle_ms`` after the last row; either way what is
    held goes out first."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        given = None if state.hasTimedOut else pd.concat(list(frames)).sort_values("seq")
        rows = [] if given is None else list(zip(given["seq"], given["line"], given["closes"]))
        if held is not None:
            kind, pairs, seq = held[5], [tuple(p) for p in json.loads(held[6])], held[4]
        else:
            kind, pairs, seq = given["kind"].iloc[0], _pairs(given["mapping"].iloc[0]), int(given["seq"].iloc[0])
        restorer, out, closed = Restorer(kind, pairs, State(*held[:4]) if held is not None else None), [], state.hasTimedOut
        for seq, line, closes in rows:
            seq = int(seq)
            out += [(key[0], seq, n, said) for n, said in enumerate(_play(restorer, line, closes))]
            closed = closed or bool(closes)
        if state.hasTimedOut:  # numbered after the lines of the last row
            out += [(key[0], seq, (1 << 30) + n, line) for n, line in enumerate(restorer.close())]
        if closed:
            state.remove()
        else:
            s = restorer.state
            state.update((s.raw, s.content, s.sent, s.last, int(seq), kind, json.dumps(pairs)))
            if timeout == GroupStateTimeout.ProcessingTimeTimeout:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "ord", "line"])

    return lines.groupBy("stream_id").applyInPandasWithState(run, OUT, STATE, "append", timeout)
