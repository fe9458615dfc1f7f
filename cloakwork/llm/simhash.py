"""SimHash near-duplicate groups by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. If two fingerprints differ in at most three bits, one of
the halves differs in at most one bit, so the pair shares a *one-wildcard variant* of that half: the half
with some bit left out. Every distinct fingerprint is posted under its 2 x 32 variants; equal variants meet in one
sorted stream, are verified by exact Hamming distance, and linked to the smallest member of their
local group. Stars instead of pairs keep the links linear in the postings, whatever the group's size.

Scale: exact copies share one fingerprint and are posted once. The postings are the only large shuffle
(16 bytes each, 64 for each distinct fingerprint). Groups of equal variants stream through sorted partitions and
hold eight bytes for each member. Components are found by alternating large-star and small-star rounds, with
every round written to the shared checkpoint folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, numbered, shuffle_parts, text_digest, texts

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
HALF = 32
#: Above so many members, a variant's group is verified by its other half's bytes instead of by all its pairs.
DENSE_GROUP = 2048
BLOCK = 1024


def fingerprint(text: bytes | None) -> int:
    """Bit b is 1 if it is set in over half of the hashes of the 3-word shingles, repeats included."""
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    hashes = np.array([digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:])], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # whole texts of any length, in bounded memory
        bits = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t) for t in texts(batch)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(marks)], names=["doc_id", "digest", "fp"])


def variants(marks: np.ndarray) -> np.ndarray:
    """The 64 posting keys of each fingerprint: half (1 bit), left-out bit (5 bits), the half's other bits (32 bits)."""
    marks = marks.view(np.uint64)
    out = np.empty((len(marks), 2 * HALF), dtype=np.uint64)
    for half in (0, 1):
        part = (marks >> np.uint64(HALF * half)) & np.uint64(0xFFFFFFFF)
        for bit in range(HALF):
            out[:, half * HALF + bit] = (part & np.uint64(0xFFFFFFFF ^ (1 << bit))) | np.uint64((half * HALF + bit) << HALF)
    return out.view(np.int64)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("fp").to_numpy(zero_copy_only=False)
        if len(marks):
            yield pa.RecordBatch.from_arrays([pa.array(variants(marks).ravel()), pa.array(np.repeat(marks, 2 * HALF))], names=["variant", "fp"])


def _near(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ many) <= MAX_DISTANCE


def local_links(marks: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, smallest of its local group) among distinct fingerprints that share a variant.

    A breadth-first search over the members not reached yet; each is compared in blocks. In a group over
    ``DENSE_GROUP`` the search looks only among members that share a 16-bit quarter with the
    one at hand, which any two within three bits do.
    """
    marks = np.sort(marks.view(np.uint64))
    n = len(marks)
    if n < 2:
        return []
    if n == 2:
        return [(int(marks[1]), int(marks[0]))] if _near(marks[0], marks[1]) else []
    lists: list[dict[int, np.ndarray]] = []
    if n > DENSE_GROUP:
        for k in range(4):  # 16-bit quarters: three changed bits leave one quarter whole
            quarter = (marks >> np.uint64(16 * k)) & np.uint64(0xFFFF)
            order = np.argsort(quarter, kind="stable")
            cuts = np.flatnonzero(np.diff(quarter[order])) + 1
            lists.append({int(quarter[g[0]]): g for g in np.split(order, cuts)})
    left = np.ones(n, dtype=bool)
    links = []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front:
            at = front.pop()
            if lists:
                among = np.unique(np.concatenate([lists[k][int((marks[at] >> np.uint64(16 * k)) & np.uint64(0xFFFF))] for k in range(4)]))
                among = among[left[among]]
            else:
                among = np.flatnonzero(left)
            if not len(among):
                if not lists:
                    break
                continue
            found = among[_near(marks[at], marks[among])]
            left[found] = False
            front.extend(found.tolist())
            links.extend((int(marks[f]), int(marks[seed])) for f in found)
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (variant, fp) rows to links; a group may go over from one batch to the next."""
    key, held = None, []

    def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    out: list[tuple[int, int]] = []
    for batch in batches:
        variant = batch.column("variant").to_numpy(zero_copy_only=False)
        marks = batch.column("fp").to_numpy(zero_copy_only=False)
        if not len(marks):
            continue
        starts = np.concatenate([[0], np.flatnonzero(np.diff(variant)) + 1])
        ends = np.append(starts[1:], len(marks))
        whole = (ends - starts) > 1  # single postings inside the batch need no look
        whole[0] = whole[-1] = True
        for s, e in zip(starts[whole].tolist(), ends[whole].tolist()):
            if key is not None and variant[s] == key:
                held.append(marks[s:e])
                continue
            if held:
                out.extend(local_links(np.concatenate(held)))
            key, held = variant[s], [marks[s:e]]
        out = list(set(out))
        if len(out) > 20000:
            yield emit(out)
            out = []
    if held:
        out.extend(local_links(np.concatenate(held)))
    if out:
        yield emit(list(set(out)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component; nodes without edges do not appear.

    ``edges`` has (a, b) with a != b, compared as unsigned by a prior shift or as plain longs, alike for all.
    Alternating large-star and small-star; ends when a round changes no edge.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def signature(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        return tuple(row)

    last = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: each larger neighbour of a node goes to the node's smallest neighbour
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        edges = durable(small)
        now = signature(edges)
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, fp, root (a fingerprint that stands for the component) and component_id of each row of ``docs`` (doc_id, digest, text)."""
    marks = durable(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", "text"), _fingerprints, "doc_id long, digest string, fp long"))
    owners = marks.groupBy("fp").agg(F.min("doc_id").alias("owner"))
    postings = map_batches(owners.select("fp"), _post, "variant long, fp long")
    parts = shuffle_parts(docs.sparkSession)
    met = postings.repartition(parts, "variant").sortWithinPartitions("variant", "fp")
    links = met.mapInArrow(_link, "a long, b long")
    roots = components(links)
    # smallest owner of each component, then back to the fingerprints and documents
    placed = owners.join(roots, owners.fp == roots.node, "left").select("fp", "owner", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("owner").alias("component_id"))
    return marks.join(placed.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, ...) with fingerprint and component.

    Returns doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable).
    Null or wordless texts have fingerprint zero and link like any other. Repeated rows give repeated rows of one component. A
    row whose doc_id is null links by its text and gets the smallest non-null id of its component, or null. An empty
    table gives no rows. Other columns are ignored.
    """
    placed = _placed(docs.select("doc_id", "text", F.lit(None).cast("string").alias("digest")))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies: of each component one row stays, that with the smallest doc_id.

    A row without an id comes after those with one; of rows of one id, or of none, the one whose text has the smallest digest stays. Rows that repeat
    a doc_id with texts that are no near copies stay, each for its own component; of rows equal in id and text any one stays.
    """
    rows = numbered(docs)
    doc, text = (rows.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    named = rows.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), text_digest(text).alias("digest"))
    alike = _placed(named).groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n")
    kept = durable(alike.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("kept id"), F.col("k.digest").alias("kept digest"), F.col("k.n").alias("n")))
    out = rows.join(kept.drop("n"), F.col(doc).cast("long").eqNullSafe(F.col("kept id")) & (text_digest(text) == F.col("kept digest")), "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.withColumn("digest", text_digest(text)).dropDuplicates([doc, "digest"]).drop("digest")
    return out.toDF(*docs.columns)
