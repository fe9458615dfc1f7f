"""Approximate nearest neighbours by a permutation index.

Each vector is represented by the order of the pivots around it, nearest first, and posted in the inverted files
of its ``posted`` nearest pivots. A query reads the files of its own nearest pivots, keeps the vectors met in at least
``min_shared`` of them, ranks those by Spearman's footrule between the two permutations, and reranks the best
``keep`` of each index shard by exact cosine. A query that meets no more than k vectors that way asks for fewer shared files.

Scale: equal vectors are one index entry with its smallest ids, so a vector that a third of all rows repeat is
indexed once. The index is split by entries, as search engines do: a shard has about ``SHARD_ROWS`` entries with their vectors,
permutations and inverted files, so what a query meets is summed up where it is met, and only k rows for each query and shard
move. Shards are built once and written to the checkpoint folder. Queries go to them in broadcast blocks of ``QUERY_BLOCK`` at most;
neither index nor queries are copied for that, and a task holds one shard and one block. Pivots are a bounded sample
(``pivots`` vectors for each dimension). Fixed pivots keep an inverted file at posted/pivots of the shard, so the work grows
with queries times rows; raise ``pivots`` with the data where its intrinsic dimension is low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_batches

K = 5
PIVOTS = 256
POSTED = 24
MIN_SHARED = 3
KEEP = 128
SHARD_ROWS = 8192
QUERY_BLOCK = 8192


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part, each once."""
    number = F.col("embedding").cast("array<double>")
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0)).distinct()


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components near 1: cosines stay the same to the last bit, and nothing overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def permutations(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pivots for each vector, nearest first, and each pivot's rank in it."""
    order = np.argsort(-(unit(vectors) @ pivots.T), axis=1, kind="stable")
    rank = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=np.int16)[None, :], 1)
    return order, rank


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


SHARD = "dim int, vectors binary, ranks binary, files binary, ends binary, members array<array<long>>"


def _builder(pivots: dict[int, np.ndarray], posted: int) -> Callable[[pa.Table], pa.Table]:
    """One row for each shard: its entries' vectors and permutations, and the inverted files, pivot after pivot."""

    def build(entries: pa.Table) -> pa.Table:
        dim = entries.column("dim")[0].as_py()
        base = _matrix(entries.column("embedding"), dim)
        order, rank = permutations(base, pivots[dim])
        near = min(posted, order.shape[1])
        flat = order[:, :near].ravel()
        files = (np.argsort(flat, kind="stable") // near).astype(np.int32)
        ends = np.cumsum(np.bincount(flat, minlength=order.shape[1]))
        row = [pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (scaled(base), rank, files, ends)), pa.array([entries.column("members").to_pylist()], pa.list_(pa.list_(pa.int64())))]
        return pa.table(row, names=["dim", "vectors", "ranks", "files", "ends", "members"])

    return build


def search_shard(shard: dict, own: list[int], asked: np.ndarray, pivots: np.ndarray, k: int, posted: int, min_shared: int, keep: int) -> tuple[list[int], list[int], list[float]]:
    """Query ids, vector ids and cosines of the k nearest found in one shard for each of the queries ``own`` (ids) with vectors ``asked``."""
    base = np.frombuffer(shard["vectors"]).reshape(-1, asked.shape[1])
    rank = np.frombuffer(shard["ranks"], dtype=np.int16).reshape(len(base), -1)
    files = np.split(np.frombuffer(shard["files"], dtype=np.int32), np.frombuffer(shard["ends"], dtype=np.int64)[:-1])
    members, norms, asked = shard["members"], np.sqrt((base * base).sum(axis=1)), scaled(asked)
    order, asked_rank = permutations(asked, pivots)
    near = min(posted, order.shape[1])
    out: tuple[list, list, list] = ([], [], [])
    for q, me in enumerate(own):
        shared = np.bincount(np.concatenate([files[p] for p in order[q, :near]]), minlength=len(base))
        for least in range(min(min_shared, near), -1, -1):
            met = np.flatnonzero(shared >= least)
            if len(met) > k:
                break
        if len(met) > keep:
            footrule = np.abs(rank[met] - asked_rank[q]).sum(axis=1, dtype=np.int32)
            met = met[footrule <= np.partition(footrule, keep - 1)[keep - 1]]  # ties at the edge stay
        vector = asked[q]
        score = (base[met] * vector).sum(axis=1) / (norms[met] * np.sqrt((vector * vector).sum()))
        if len(met) > k + 1:
            best = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            met, score = met[best], score[best]
        for minus, m in sorted((-s, m) for e, s in zip(met.tolist(), score.tolist()) for m in members[e] if m != me)[:k]:
            out[0].append(me)
            out[1].append(m)
            out[2].append(-minus)
    return out


def _asks(block: DataFrame) -> dict[int, tuple[list[int], np.ndarray]]:
    """Ids and vectors of a block of queries by dimension."""
    out: dict[int, tuple[list[int], list]] = {}
    for r in block.collect():  # at most a block
        ids, vectors = out.setdefault(r["dim"], ([], []))
        ids.append(r["vec_id"])
        vectors.append(r["embedding"])
    return {d: (ids, np.array(vectors)) for d, (ids, vectors) in out.items()}


def search(
    vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, posted: int = POSTED, min_shared: int = MIN_SHARED, keep: int = KEEP, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """The k nearest found of each query by cosine: query_id, rank (from 1), vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Ties go to the smaller vec_id. Rows
    without an id or a vector, and vectors that are empty, zero or hold null or non-finite components, take no part.
    Vectors are compared within their dimension only. Repeated rows count once; ids that repeat with different
    vectors are never their own neighbours. Fewer candidates than k give fewer rows; an empty table, or none that asks, gives none.
    Other columns are ignored.
    """
    rows = valid(vectors).withColumn("dim", F.size("embedding"))
    spark = vectors.sparkSession
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)  # no query needs more of equal vectors
    entries = durable(few.groupBy("dim", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members")))
    sizes = {r["dim"]: r["count"] for r in entries.groupBy("dim").count().collect()}
    lot = F.pmod(F.xxhash64("embedding"), F.lit(1 << 40))
    chosen = []
    for dim, size in sizes.items():  # those of smallest hash, out of the few whose hash is small at all
        few = entries.where((F.col("dim") == dim) & (lot <= min(1 << 40, (1 << 40) * 8 * pivots // size)))
        chosen += few.orderBy(lot, "embedding").limit(pivots).select("dim", "embedding").collect()
    by_dim: dict[int, list] = {}
    for r in chosen:  # at most `pivots` vectors of each dimension
        by_dim.setdefault(r["dim"], []).append(r["embedding"])
    centres = spark.sparkContext.broadcast({d: unit(np.array(v)) for d, v in by_dim.items()})
    shards = max(1, -(-entries.count() // shard_rows))
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards))).repartition(shards, "dim", "shard")
    index = durable(dealt.groupBy("dim", "shard").applyInArrow(_builder(centres.value, posted), SHARD))
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // query_block))
    asked = durable(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)))) if blocks > 1 else asked.withColumn("block", F.lit(0))

    def answers(block: int) -> DataFrame:
        asks = spark.sparkContext.broadcast(_asks(asked.where(F.col("block") == block)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.to_pylist():
                    if shard["dim"] in asks.value:
                        got = search_shard(shard, *asks.value[shard["dim"]], centres.value[shard["dim"]], k, posted, min_shared, keep)
                        yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], names=["query_id", "vec_id", "score"])

        return map_batches(index, run, "query_id long, vec_id long, score double")

    found = reduce(DataFrame.unionAll, map(answers, range(blocks)))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: list[int], vectors: np.ndarray, asked: list[int], k: int = K) -> dict[int, list[tuple[int, float]]]:
    """Exact neighbours, for tests."""
    ids_, norms, out = np.array(ids), np.sqrt((vectors * vectors).sum(axis=1)), {}
    at = {v: n for n, v in enumerate(ids)}
    for q in asked:
        score = (vectors * vectors[at[q]]).sum(axis=1) / (norms * norms[at[q]])
        order = [n for n in np.lexsort((ids_, -score)) if ids_[n] != q][:k]
        out[q] = [(int(ids_[n]), float(score[n])) for n in order]
    return out
