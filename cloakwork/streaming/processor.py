"""Restoring of event streams by a stateful processor: lines may come late, early or twice.

What is kept of a stream, by state of its own: the unsettled end of its block (one value), its mapping (a list, in the order in which pairs came), and the lines
that are here before their turn (a map by number). That a stream has ended is remembered for a time, so lines that a source sends again are
not taken for a new one. A timer ends a stream that has gone silent. Keep the states in RocksDB
(``spark.sql.streaming.stateStore.providerClass``): Spark asks for that, and lines that wait are then on disk, not in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cloakwork.kernels.sse import Restorer, State
from cloakwork.streaming.restore import IDLE_MS, OUT, _play

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = "raw string, content string, sent int, last string, awaited long, kind string, timer long"
#: Where the numbers within a line begin that a silent stream's rest gets, after those of the line itself.
REST = 1 << 30


class LineRestorer(StatefulProcessor):
    """Plays the lines of each stream by number, from ``first`` on without a gap, whatever order they come in."""

    def __init__(self, idle_ms: int = IDLE_MS, first: int = 0) -> None:
        self.idle_ms, self.first = idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", BLOCK)
        self.mapping = handle.getListState("mapping", "plain string, placeholder string")
        self.early = handle.getMapState("early", "seq long", "line string, closes boolean, kind string, mapping string")
        self.ended = handle.getValueState("ended", "seq long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        if self.ended.exists():
            for _ in rows:
                pass
            return
        self._open()
        closed = False
        for row in rows:
            seq = int(row["seq"])
            if closed or seq < self.awaited:  # here already
                continue
            pairs = [[p["from"], p["to"]] for p in row["mapping"]] if row["mapping"] is not None else []
            turn = row["line"], bool(row["closes"]), row["kind"], pairs
            if seq > self.awaited:
                self.early.updateValue((seq,), (*turn[:3], json.dumps(pairs)))
                self.waiting = True
                continue
            while turn is not None and not closed:
                for n, said in enumerate(self._turn(*turn)):
                    yield Row(stream_id=key[0], seq=self.awaited, ord=n, line=said)
                closed, turn = turn[1], None
                self.awaited += 1
                if self.waiting and self.early.containsKey((self.awaited,)):
                    line, closes, kind, told = self.early.getValue((self.awaited,))
                    self.early.removeKey((self.awaited,))
                    turn = line, bool(closes), kind, json.loads(told)
        if closed:
            self._end()
        else:
            self._keep(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """What waits is played over the gaps, then what is held goes out."""
        if not self.block.exists():
            return
        self._open()
        self.timer = None  # this one is gone by itself
        last, closed = max(self.awaited - 1, self.first), False
        for seq in sorted(int(k[0]) for k in self.early.keys()):
            line, closed, kind, told = self.early.getValue((seq,))
            for n, said in enumerate(self._turn(line, bool(closed), kind, json.loads(told))):
                yield Row(stream_id=key[0], seq=seq, ord=n, line=said)
            last = seq
            if closed:
                break
        if not closed:
            for n, said in enumerate(self._restorer().close()):
                yield Row(stream_id=key[0], seq=last, ord=REST + n, line=said)
        self.awaited = last + 1
        self._end()

    def close(self) -> None:
        pass

    def _open(self) -> None:
        held = self.block.get() if self.block.exists() else None
        self.state = State(*held[:4]) if held is not None else State()
        self.awaited, self.kind, self.timer = held[4:7] if held is not None else (self.first, None, None)
        self.pairs = [tuple(p) for p in self.mapping.get()] if held is not None else []
        self.kept = len(self.pairs)
        self.waiting = held is not None and self.early.exists()
        self.restorer = None

    def _restorer(self) -> Restorer:
        if self.restorer is None:
            self.restorer = Restorer(self.kind or "", self.pairs, self.state)
        return self.restorer

    def _turn(self, line: str | None, closes: bool, kind: str | None, pairs: list) -> list[str]:
        new = [p for p in map(tuple, pairs) if p not in self.pairs]
        if new or (self.kind is None and kind is not None):
            self.pairs += new
            self.kind, self.restorer = self.kind or kind, None
        return _play(self._restorer(), line, closes)

    def _keep(self, timer: int) -> None:
        s = self.state
        if self.timer is not None:
            self.handle.deleteTimer(self.timer)
        self.handle.registerTimer(timer)
        self.block.update((s.raw, s.content, s.sent, s.last, self.awaited, self.kind, timer))
        if len(self.pairs) > self.kept:
            self.mapping.appendList(self.pairs[self.kept :])

    def _end(self) -> None:
        if self.timer is not None:
            self.handle.deleteTimer(self.timer)
        for state in (self.block, self.mapping, self.early):
            state.clear()
        self.ended.update((self.awaited - 1,))


def restore_lines(lines: DataFrame, idle_ms: int = IDLE_MS, first: int = 0) -> DataFrame:
    """Restored lines of streamed ``lines`` (stream_id, seq, line, closes, kind, mapping): stream_id, seq, ord, line, as ``restore_batch`` gives them.

    The lines of a stream are numbered from ``first`` on without a gap. They may come in any order and in any batch: one that is early waits, one that has been played is
    passed over. A mapping may come in parts; a pair counts from the line on that brings it, and the kind from the first line that has one. The row that ``closes`` ends the stream; so do ``idle_ms``
    without a row, which play what waits over the gap and let out what is held. Rows of a stream that ended less than ``idle_ms`` ago are passed over. Null seqs are left
    out, null stream_ids are one stream, a null ``closes`` is false, other columns are ignored.

    Spark runs a batch without rows after each for the timers, so a query triggered by ``availableNow`` ends only where
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is false; its timers are then looked at in the next run.
    """
    known = lines.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "line", "closes", "kind", "mapping").where(F.col("seq").isNotNull())
    return known.groupBy("stream_id").transformWithState(LineRestorer(idle_ms, first), OUT, "append", "ProcessingTime")
