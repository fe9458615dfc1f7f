"""Best-fit packing of tokenized documents, planned over the histogram of piece lengths.

Best-fit-decreasing looks at lengths only, so it is run on counts: at most ``capacity`` numbers, whatever the corpus'
size. Open sequences with the same content stand as one group with a count; each length in falling order fills the
groups with the least room that it fits. The plan is a short list of (length, first rank, last rank, first
sequence, offset); documents take their slots by joining their rank within their length to it.

Scale: texts are tokenized once, and only lengths and checksums move. Ranks within a length come from
salted buckets (count by bucket, running sum over buckets, row number inside the bucket), so that a length that a third of all
pieces have is numbered by many tasks. Driver and broadcasts hold the histogram and the plan, both bounded by ``capacity``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_batches, texts

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 8_000
#: Fixed value: the split of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class FastTokenizer:
    """Token ids as little-endian bytes, equal to the tokenizer file's own on every text.

    A byte-level BPE whose ids follow its merges is the same function as its vocabulary read as ranks, which
    ``tiktoken`` computes several times faster. Files of another kind, and texts that hold an added token's string, go
    to ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            self.fast = self._as_ranks(json.load(file))

    def _as_ranks(self, spec: dict):
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        byte_level = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not byte_level or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            return None
        vocabulary = {token: n for token, n in model["vocab"].items() if token not in self.added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [vocabulary.get("".join(m)) for m in merges] != list(range(256, 256 + len(merges))) or len(vocabulary) != 256 + len(merges):
            return None
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): n for token, n in vocabulary.items()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = FastTokenizer(path), end_id.to_bytes(4, "little")
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(tokenizer.encode(text or "") + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing over counts.

    Returns (length, first rank, end rank, first sequence, offset): the pieces of that length with ranks
    first..end-1 go, one each, to the sequences from first sequence on, all at that offset.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, count)]
    sequences = 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        rank, left = 0, histogram[length]
        room = length
        while left and room <= capacity:
            groups = open_.get(room)
            if not groups:
                room += 1
                continue
            first, count = groups.pop()
            take = min(left, count)
            slots.append((length, rank, rank + take, first, capacity - room))
            if take < count:
                groups.append((first + take, count - take))
            open_.setdefault(room - length, []).append((first, take))
            rank, left = rank + take, left - take
            room = max(length, room - length)  # the tightest room may now be among those just filled
        each = capacity // length
        if left:
            full, rest = divmod(left, each)
            for k in range(each):  # new sequences take as many of this length as go in
                if full:
                    slots.append((length, rank + k * full, rank + (k + 1) * full, sequences, k * length))
            if full:
                open_.setdefault(capacity - each * length, []).append((sequences, full))
            rank, sequences = rank + each * full, sequences + full
            for k in range(rest):
                slots.append((length, rank + k, rank + k + 1, sequences, k * length))
            if rest:
                open_.setdefault(capacity - rest * length, []).append((sequences, 1))
                sequences += 1
    return slots


def place(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    ``pieces`` is read three times and must not change between reads (write it first).
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan(counts, capacity), "length long, low long, high long, first long, `offset` long")
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    marked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = marked.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = marked.withColumn("within", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within"))
    slots = F.broadcast(slots.withColumnRenamed("length", "slot_length"))  # bounded by the capacity, not by the corpus
    placed = ranked.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows that repeat a doc_id (or have none) are packed each on
    its own. Equal pieces may swap places, which changes nothing that can be seen. An empty table gives no rows. Other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return place(durable(map_batches(docs, _pieces(tokenizer_path, capacity, end_id), schema)), capacity)
