"""Detection on a stream of texts in which equal chunks are detected once.

Two stateful steps: spans by chunk hash, and the chunks of a text by its key until all are there. For a detector that costs more than two shuffles, on streams that cannot be
cut into jobs with a span store between them. The states want RocksDB, as in ``processor``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from cloakwork.kernels import chunk, text
from cloakwork.operators.detect import Detector, detect_all
from cloakwork.operators.redaction import SPANS, EngineConf, chunks

#: How long spans, and texts that are done or wait for a chunk, are remembered after their last change.
KEEP_MS = 24 * 3_600_000
#: Keys that a chunk's repeats are dealt to; each has the chunk detected once.
LOTS = 16
PLACE = "n int, ord int, start int, n_bytes int, hard_left boolean, hard_right boolean"


class ChunkSpans(StatefulProcessor):
    """Each chunk's spans, from the detector for the first row of a key and from the state for all others. No text is kept."""

    def __init__(self, detector: Detector, keep_ms: int) -> None:
        self.detector, self.keep_ms = detector, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getValueState("spans", "found string", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        found = self.spans.get()[0] if self.spans.exists() else None
        for row in rows:
            if found is None:
                found = json.dumps([list(s) for s in detect_all(self.detector, [row["part"]])[0]])
                self.spans.update((found,))
            yield Row(doc=row["doc"], n=row["n"], ord=row["ord"], start=row["start"], n_bytes=row["n_bytes"], hard_left=row["hard_left"], hard_right=row["hard_right"], found=found)

    def close(self) -> None:
        pass


class WholeTexts(StatefulProcessor):
    """The merged spans of a text, once all of its chunks are there."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "ord int", "start int, n_bytes int, hard_left boolean, hard_right boolean, found string", self.keep_ms)
        self.done = handle.getValueState("done", "n int", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        done = self.done.exists()
        parts = {int(k[0]): tuple(v) for k, v in self.parts.iterator()} if not done and self.parts.exists() else {}
        known, n = set(parts), None
        for row in rows:
            n = row["n"]
            parts[row["ord"]] = row["start"], row["n_bytes"], row["hard_left"], row["hard_right"], row["found"]
        if done or n is None:
            return
        if len(parts) < n:
            for ord_ in parts.keys() - known:
                self.parts.updateValue((ord_,), parts[ord_])
            return
        # merging asks a chunk for its size alone
        whole = [(chunk.Chunk(o, s, " " * size, left, right), [tuple(x) for x in json.loads(found)]) for o, (s, size, left, right, found) in sorted(parts.items())]
        self.parts.clear()
        self.done.update((n,))
        yield Row(doc=key[0], spans=[Row(**dict(zip(("start", "end", "class", "score"), s))) for s in chunk.merge(whole)])

    def close(self) -> None:
        pass


def detect_stream(docs: DataFrame, conf: EngineConf, keys: list[str], text_col: str = "text", keep_ms: int = KEEP_MS, lots: int = LOTS) -> DataFrame:
    """Merged spans of streamed ``docs``: ``keys``, start, end, class and score, as ``detect_distinct_chunks`` gives them for a table.

    A chunk is detected ``lots`` times at most in ``keep_ms``, whatever the number of texts, batches and restarts; after that again. So a chunk in a third of all texts is dealt to as many tasks.
    A text comes out in the batch that brings it; a failing detector stops the query. One that its key has brought before (within ``keep_ms``) is passed over; another text of the same key is one
    of its own. Null and short texts have no spans. ``keys`` must be of types that JSON gives back.
    """
    kinds = StructType([f for k in keys for f in docs.schema.fields if f.name == k])
    said = F.col(f"`{text_col}`")
    doc = F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys), F.sha2(said, 256).alias("_text_sha256")))
    parts = F.filter(chunks(said, conf.chunk_target, conf.chunk_overlap), lambda c: F.octet_length(c["text"]) >= text.SPAN_MIN)
    rows = docs.select(doc.alias("doc"), F.size(parts).alias("n"), F.explode(parts).alias("c"))
    part = F.col("c.text")
    rows = rows.select("doc", "n", "c.ord", "c.start", F.octet_length(part).alias("n_bytes"), "c.hard_left", "c.hard_right", part.alias("part"), F.sha2(part, 256).alias("hash"), F.pmod(F.xxhash64("doc"), F.lit(lots)).alias("lot"))
    found = rows.groupBy("hash", "lot").transformWithState(ChunkSpans(conf.detector, keep_ms), f"doc string, {PLACE}, found string", "append", "ProcessingTime")
    whole = found.groupBy("doc").transformWithState(WholeTexts(keep_ms), f"doc string, spans {SPANS}", "append", "ProcessingTime")
    return whole.select(F.from_json("doc", kinds).alias("k"), F.inline("spans")).select("k.*", "start", "end", "class", "score")
