"""Removal of repeated long passages by De Bruijn compaction over word windows.

The graph: a window of ``width`` consecutive words is an edge between two (width-1)-word nodes. A table of all edges would be a
row for every word of the corpus, so edges are kept compacted from the start, as assemblers of genomes do it: consecutive windows that
share their minimizer (the smallest hash of the ``grain``-word grams inside the window) form one path, about a seventh as many rows.
Equal windows have equal minimizers, so only paths that meet under one minimizer can repeat anything:

1. Paths are shuffled by minimizer, those of crowded ones by minimizer and content. A path whose whole word content came earlier is nonbranching there and
   collapses onto an earlier occurrence: all of its windows are repeats. Copies within a task collapse before the shuffle.
2. First occurrences that meet *other* content under their minimizer (the graph branches) are opened into windows by
   joining their source coordinates back to the texts; a window is known by a digest of its words' bytes, and the earliest stays.
   The earliest occurrence of any window lies in the first occurrence of its path's content, so nothing is missed.
3. Collapsed paths are verified at their source coordinates: the earlier occurrence's words are read from its document, and what is to go must
   have the same words, by a 128-bit digest of their bytes that has nothing to do with the hashes they met by.
4. The coordinates of all repeated windows return to their documents, which drop the covered words.

Scale: one shuffle of 48-byte path rows, one of opened windows, two of zstd-compressed texts by doc_id. No step
gathers more than one document's coordinates. A task names the first occurrence of a path or window that it meets and marks the
others itself (in a table of its latest ``_SEEN``), so a passage that a third of all documents share is a row for each task under its key, not
one for each document. Minimizers with very many different contents (the edges of such a passage, where each document goes on in
its own way) are looked for in a sample of the documents. There they are seen to branch, so their rows need only meet by content and are dealt
by it. The sample decides where rows meet, never what goes: one that it overlooks meets in one task, which spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, StringType

from .common import durable, map_batches, shuffle_parts, texts

WIDTH = 20
GRAIN = 6
NULL_ID = -(1 << 63)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CACHE_WORDS = 400_000
_SEEN = 500_000
#: One document in so many is looked at for crowded minimizers, so many contents make one, and so many are dealt by content at most.
_LOOK, _CROWD, _CROWDS = 64, 64, 10_000


class _WordHashes(dict):
    """Word to 64-bit hash, remembered; emptied when full so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class _Rolling:
    """Hashes of any run of words, by prefix sums of word hash times a power of an odd number modulo 2**64."""

    def __init__(self, odd: int) -> None:
        self.odd, self.inverse = np.uint64(odd), np.uint64(pow(odd, -1, 1 << 64))
        self.power = self.back = np.ones(1, dtype=np.uint64)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) + 1
        if n > len(self.power):
            size = max(n, 2 * len(self.power))
            for name, base in (("power", self.odd), ("back", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        out = np.zeros(n, dtype=np.uint64)
        np.cumsum(hashes * self.power[: n - 1], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (sums[start + length] - sums[start]) * self.back[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def paths(hashes: np.ndarray, width: int, rolling: _Rolling, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, content hash, first window and number of windows of each path of one document."""
    n = len(hashes)
    if n < width:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    grain = min(grain, width)
    sums = rolling.sums(hashes)
    grams = _mix(rolling.runs(sums, np.arange(n - grain + 1), grain))
    span = width - grain + 1
    least = _sliding_min(grams, span)
    at = np.empty(len(least), dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    for s in range(0, len(least), 65536):
        at[s : s + 65536] = np.argmax(views[s : s + 65536] == least[s : s + 65536, None], axis=1)
    at += np.arange(len(least))
    start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    count = np.diff(np.append(start, len(at)))
    content = _mix(rolling.runs(sums, start, count + (width - 1)) ^ count.astype(np.uint64))
    return least[start], content, start, count


class _Firsts(dict):
    """Earliest coordinate of each key met lately."""

    def earlier(self, key, spot: tuple[int, int, int]) -> tuple[int, int, int] | None:  # noqa: ANN001
        """A coordinate before ``spot`` where the key was met; None if this is the earliest, which is then remembered."""
        known = self.get(key)
        if known is not None and known < spot:
            return known
        if len(self) >= _SEEN:
            self.clear()
        self[key] = spot
        return None


#: A document is (doc_id, same): rows of one id, or of none, are told apart by a hash of their texts.
DOC, FIRST = ["doc_id", "same"], ["first_doc", "first_same"]
FOUND = "m long, c long, doc_id long, same long, pos long, first_doc long, first_same long, first_pos long"


def _find_paths(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling, firsts = _WordHashes(), _Rolling(_ODD[0]), _Firsts()
        for batch in batches:
            parts = []
            for doc, same, text in zip(batch.column("doc_id").to_pylist(), batch.column("same").to_pylist(), texts(batch)):
                words = text.split() if text else []
                if len(words) >= width:
                    least, content, start, count = paths(known.of(words), width, rolling)
                    parts.append((least, content, np.full(len(start), doc, dtype=np.int64), np.full(len(start), same, dtype=np.int64), start << 8 | count))
            if parts:
                m, c, d, e, p = (np.concatenate(x) for x in zip(*parts))
                # rows equal in id and text are one document, where an equal start is no earlier one
                before = [firsts.earlier(key, spot) for key, spot in zip(c.tolist(), zip(d.tolist(), e.tolist(), p.tolist()))]
                again = np.array([x is not None for x in before])
                # they have no more to find: a key of their own spreads them over all tasks
                m[again], c[again] = _mix((d ^ e)[again].view(np.uint64) ^ m[again]), _mix(p[again].view(np.uint64))
                first = [pa.array([None if x is None else x[k] for x in before], pa.int64()) for k in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d), pa.array(e), pa.array(p), *first], names=["m", "c", *DOC, "pos", *FIRST, "first_pos"])

    return run


class _Words:
    """The words of a text, and digests of any run of them by their bytes."""

    def __init__(self, text: bytes | None) -> None:
        self.words = text.split() if text else []
        self.joined = b" ".join(self.words)
        self.at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words)) + 1)]).tolist()

    def __len__(self) -> int:
        return len(self.words)

    def digest(self, start: int, end: int) -> bytes:
        return xxhash.xxh3_128_digest(self.joined[self.at[start] : self.at[end] - 1])

    def path(self, pos: int, width: int) -> bytes | None:
        """Digest of a path's words; None if the text has no such place."""
        end = (pos >> 8) + (pos & 255) + width - 1
        return self.digest(pos >> 8, end) if end <= len(self.words) else None


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [None if t is None else packer.compress(t) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary()), *batch.columns[3:]], names=[*DOC, "z", *batch.schema.names[3:]])


def _open_paths(width: int):
    """Windows of the opened paths: digest (two longs), place, and whether the task itself has met an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, firsts = zstandard.ZstdDecompressor().decompress, _Firsts()
        for batch in batches:
            keys, docs, sames, places = [], [], [], []
            for doc, same, z, spots in zip(*(batch.column(c).to_pylist() for c in (*DOC, "z", "spots"))):
                if z is None:
                    continue
                words = _Words(unpack(z))
                last = len(words) - width
                for pos in spots:
                    for at in range(pos >> 8, min((pos >> 8) + (pos & 255) - 1, last) + 1):
                        keys.append(words.digest(at, at + width))
                        docs.append(doc)
                        sames.append(same)
                        places.append(at)
            if keys:
                again = np.array([firsts.earlier(key, spot) is not None for key, spot in zip(keys, zip(docs, sames, places))])
                w = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2).copy()
                w[again, 1] = np.array(docs)[again] ^ np.array(sames)[again] ^ np.array(places)[again]  # spread, as they have no more to find
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), *(pa.array(x, pa.int64()) for x in (docs, sames, places)), pa.array(again)], names=["w1", "w2", *DOC, "at", "again"])

    return run


def _read_paths(width: int):
    """Digests of the words at the coordinates that others collapsed onto."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            docs, sames, places, said = [], [], [], []
            for doc, same, z, spots in zip(*(batch.column(c).to_pylist() for c in (*DOC, "z", "spots"))):
                words = _Words(None if z is None else unpack(z))
                for pos in spots:
                    digest = words.path(pos, width)
                    if digest is not None:
                        docs.append(doc)
                        sames.append(same)
                        places.append(pos)
                        said.append(digest)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (docs, sames, places)), pa.array(said, pa.binary())], names=[*FIRST, "first_pos", "said"])

    return run


def covered(n: int, spots: list[int] | None, ats: list[int] | None, width: int) -> np.ndarray | None:
    """Which of ``n`` words lie in a repeated window; None if none does."""
    if not spots and not ats:
        return None
    spots, ats = np.array(spots or [], dtype=np.int64), np.array(ats or [], dtype=np.int64)
    start = np.concatenate([spots >> 8, ats])
    end = np.minimum(start + np.concatenate([(spots & 255) + width - 1, np.full(len(ats), width)]), n)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(start, n), 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(width: int, rest: list[str], as_it_was: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for z, spots, ats in zip(*(batch.column(c).to_pylist() for c in ("z", "spots", "ats"))):
                text = None if z is None else unpack(z)
                words = text.split() if text else []
                if spots:
                    own = _Words(text)
                    spots = [s["pos"] for s in spots if own.path(s["pos"], width) == s["said"]]
                gone = covered(len(words), spots, ats, width) if words else None
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                if gone is not None:
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept.append(text if as_it_was and not n_removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), *(batch.column(c) for c in rest)],
                names=["doc_id", "kept_text", "n_words", "n_removed", *rest],
            )

    return run


def crowded(docs: DataFrame, width: int) -> DataFrame:
    """(m, crowd): minimizers that branch into ``_CROWD`` contents or more within a sample of ``docs``, the ``_CROWDS`` most crowded at most."""
    part = docs.select("doc_id", F.xxhash64("text").alias("same"), "text").where(F.pmod(F.xxhash64(*DOC), F.lit(_LOOK)) == 0)
    contents = map_batches(part, _find_paths(width), FOUND).where("first_doc is null").select("m", "c").distinct()
    return contents.groupBy("m").agg(F.count("c").alias("crowd")).where(F.col("crowd") >= max(2, _CROWD)).orderBy(F.desc("crowd"), "m").limit(_CROWDS)


def remove_repeats(docs: DataFrame, width: int = WIDTH, carry: list[str] | None = None, as_it_was: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, kept_text, n_words, n_removed, and the columns named in ``carry``.

    A word goes if it is in a window of ``width`` words whose words also start earlier: in a smaller doc_id, or in
    the same document before. Kept words are joined by one space; a null text has no words, an empty table no rows.
    A null doc_id counts as the smallest. Rows that repeat a doc_id, or have none, are documents of their own, in the order of a hash of their
    texts; rows equal in both are one document: a window there is not earlier than itself, and the same goes from each of them. Other columns are ignored. With
    ``as_it_was`` a text that loses nothing, a null one too, is its own kept_text.
    """
    if not 1 < width < 200:
        raise ValueError("width must be between 2 and 199")
    rest = list(carry or [])
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("same"), "text", *rest)
    found = map_batches(docs.select(*DOC, "text"), _find_paths(width), FOUND)
    found = found.join(F.broadcast(crowded(docs, width)), "m", "left").withColumn("k", F.when(F.col("crowd").isNull(), F.col("m")).otherwise(F.xxhash64("m", "c")))
    meet, alike = Window.partitionBy("k"), Window.partitionBy("k", "c").orderBy(*DOC, "pos")
    spot = F.struct(*DOC, "pos")
    first = {"first_doc": "first.doc_id", "first_same": "first.same", "first_pos": "first.pos"}
    met = (
        found.withColumn("first", F.when(F.rank().over(alike) > 1, F.first(spot).over(alike)))
        .withColumn("branches", F.col("crowd").isNotNull() | (F.min("c").over(meet) != F.max("c").over(meet)))
        .select(*DOC, "pos", *(F.coalesce(own, met).alias(own) for own, met in first.items()), "branches")
    )
    met = durable(met.where("branches or first_doc is not null"))
    parts = shuffle_parts(docs.sparkSession)
    carried = [StructField(c, docs.schema[c].dataType) for c in rest]
    packed = StructType([*(StructField(c, LongType(), False) for c in DOC), StructField("z", BinaryType()), *carried])
    packed = map_batches(docs, _squeeze, packed).repartition(parts, *DOC)
    # collapsed paths: their source's words, read where they stand; a join that can be split, as very many may share a source.
    # The compressed texts go whole into every join, so that one exchange serves all
    collapsed = met.where("first_doc is not null").drop("branches")
    asked = collapsed.groupBy(F.col("first_doc").alias("doc_id"), F.col("first_same").alias("same")).agg(F.collect_set("first_pos").alias("spots"))
    read = map_batches(packed.join(asked, DOC), _read_paths(width), "first_doc long, first_same long, first_pos long, said binary")
    spots = collapsed.join(read, [*FIRST, "first_pos"]).groupBy(*DOC).agg(F.collect_list(F.struct("pos", "said")).alias("spots"))
    # first occurrences where the graph branches: their windows
    opening = met.where("first_doc is null").groupBy(*DOC).agg(F.collect_list("pos").alias("spots"))
    opened = map_batches(packed.join(opening, DOC), _open_paths(width), "w1 long, w2 long, doc_id long, same long, at long, again boolean")
    ranked = opened.withColumn("r", F.rank().over(Window.partitionBy("w1", "w2").orderBy(*DOC, "at"))).where("r > 1 or again")
    ats = ranked.groupBy(*DOC).agg(F.collect_list("at").alias("ats"))
    out = packed.join(spots.join(ats, DOC, "full"), DOC, "left")
    made = [StructField("doc_id", LongType()), StructField("kept_text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]
    out = map_batches(out, _remove(width, rest, as_it_was), StructType([*made, *carried]))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def keep_first_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the words left that no earlier passage repeats; untouched texts stay byte for byte, changed ones are joined by one space.

    A column n_chars follows the text. Every row stays, with whatever other columns it has.
    """
    names = docs.columns
    carried = {c: f"carried {n}" for n, c in enumerate(names) if c not in ("doc_id", "text", "n_chars")}
    rows = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(new) for c, new in carried.items()))
    out = remove_repeats(rows, carry=list(carried.values()), as_it_was=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*(made[c].alias(c) if c in made else F.col(carried[c]).alias(c) for c in names))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r
      FROM (SELECT doc_id, i, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WIDTH - 1})) AS i FROM d))),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS k FROM w WHERE r > 1),
every AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS k FROM d),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM every ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns from :func:`remove_repeats`."""
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], width: int = WIDTH) -> dict[int | None, tuple[int, int, str]]:
    """The same by a dictionary of windows, for small tests on rows whose ids differ, unless the texts are equal too."""
    first: dict[tuple[bytes, ...], tuple[int, int]] = {}
    split = [(NULL_ID if d is None else d, (t or "").encode().split()) for d, t in rows]
    for doc, words in split:
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            first[key] = min(first.get(key, (doc, s)), (doc, s))
    out = {}
    for doc, words in split:
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            if first[tuple(words[s : s + width])] < (doc, s):
                gone[s : s + width] = [True] * width
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[None if doc == NULL_ID else doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
