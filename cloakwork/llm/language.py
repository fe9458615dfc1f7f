"""Language identification by rank-order profiles of n-grams (Cavnar and Trenkle, 1994).

A language's profile is the list of its ``profile`` most frequent letter n-grams (one to three letters, words padded by
a space) over all of its training documents. A document's own list of its ``top`` most frequent n-grams is compared with
each profile by the out-of-place distance: the sum of rank differences, with the profile's length for
n-grams it lacks. The nearest profile names the language; the score is one minus the distance's share of its maximum.

Scale: training counts are summed inside each task before they are shuffled as (language, n-gram, count). The
profiles are ``profile`` rows for each language; they go along with the function, ``TOGETHER`` languages at a time. Prediction is one
scan without any shuffle, in which documents meet the blocks of languages one after the other and keep the nearest profile so far.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import durable, map_batches, numbered

PROFILE = 400
TOP = 300
#: Languages whose profiles are in memory together.
TOGETHER = 1000
UNKNOWN = "und"
#: Below this score a document resembles no profile and the pipeline rejects it.
MIN_SCORE = 0.2
_LETTERS = re.compile(r"[^\W\d_]+")
_BITS = 21  # of a code point
_HELD = 1_000_000


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as packed code points, and their counts; empty if the text has no letter."""
    words = _LETTERS.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    gap = one == 32
    two = (one[:-1] << _BITS) | one[1:]
    three = (two[:-1] << _BITS) | one[2:]
    keys = np.concatenate([one[~gap], two, three[~gap[1:-1]]])
    return np.unique(keys, return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, ties by the packed code points."""
    return keys[np.lexsort((keys, -counts))[:top]]


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = defaultdict(list)

    def rows(lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            got = grams(text)
            if len(got[0]):
                held[lang].append(got)
        for lang, parts in held.items():
            held[lang] = [_sum(parts)] if parts else []
        if sum(len(p[0][0]) for p in held.values() if p) > _HELD:
            for lang, parts in held.items():
                if parts:
                    yield rows(lang, *parts[0])
            held.clear()
    for lang, parts in held.items():
        if parts:
            yield rows(lang, *parts[0])


def train(docs: DataFrame, profile: int = PROFILE, together: int = TOGETHER) -> list[dict[str, np.ndarray]]:
    """Profiles from ``docs`` (text, lang), in blocks of about ``together`` languages; rows without a language or without letters teach nothing."""
    counted = map_batches(docs.where(F.col("lang").isNotNull()).select("lang", "text"), _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = durable(counted.withColumn("place", place).where(F.col("place") <= profile).select("lang", "place", "gram"))
    blocks = -(-rows.select("lang").distinct().count() // together)
    out = []
    for block in range(blocks):
        grams: dict[str, list] = defaultdict(list)
        for r in sorted(rows.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block).collect(), key=lambda r: (r["lang"], r["place"])):
            grams[r["lang"]].append(r["gram"])
        if grams:
            out.append({lang: np.array(g, dtype=np.int64) for lang, g in grams.items()})
    return out


class Profiles:
    """All profiles as one table: n-gram by language, the n-gram's rank or the penalty for lacking it."""

    def __init__(self, profiles: dict[str, np.ndarray], profile: int = PROFILE, top: int = TOP) -> None:
        self.names, self.penalty, self.top = sorted(profiles), profile, min(top, profile)
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.known) + 1, len(self.names)), profile, dtype=np.int64)
        for n, name in enumerate(self.names):
            self.rank[np.searchsorted(self.known, profiles[name]), n] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest profile's language and its score; a text without letters is near to none, with score 0."""
        keys, counts = grams(text)
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(keys, counts, self.top)
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == own, at, len(self.known))
        ranks = self.rank[at]
        apart = np.where(ranks < self.penalty, np.abs(ranks - np.arange(len(own))[:, None]), self.penalty).sum(axis=0)
        best = int(np.argmin(apart))  # ties: the first name
        return self.names[best], 1.0 - float(apart[best]) / (self.penalty * len(own))


def predict(docs: DataFrame, profiles: list[dict[str, np.ndarray]]) -> DataFrame:
    """``docs`` with lang_pred and score behind its own columns, by the text alone. Ties go to the first name.

    ``docs`` has a column text; its columns' names are its own affair, as they are kept by place.
    """
    names, at = docs.columns, docs.columns.index("text")
    kinds = StructType([StructField(f"c{n}", f.dataType) for n, f in enumerate(docs.schema.fields)]).add("lang", "string").add("score", "double")

    def judge(so_far: DataFrame, block: dict[str, np.ndarray]) -> DataFrame:
        table = Profiles(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = [table.predict(t) for t in batch.column(at).to_pylist()]
                before = zip(batch.column(-2).to_pylist(), batch.column(-1).to_pylist())
                best = [min(((name, score), old), key=lambda x: (x[0] == UNKNOWN, -x[1], x[0])) for (name, score), old in zip(said, before)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64())], names=batch.schema.names)

        return map_batches(so_far, run, kinds)

    start = numbered(docs).withColumns({"lang": F.lit(UNKNOWN), "score": F.lit(0.0)})
    return reduce(judge, profiles, start).toDF(*names, "lang_pred", "score")


def identify(docs: DataFrame, held_out: Column, together: int = TOGETHER) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs`` (doc_id, text, lang).

    Learns from the rows that are not held out and have a language. A null text, or one without letters, is ``und``
    with score 0, and so is every text if nothing can be learned. Rows may repeat or lack doc_ids; each is judged by its
    text. An empty table gives no rows. Other columns are ignored. A text of any length is read as a whole, in memory that
    follows its length.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out.alias("held_out"))
    profiles = train(marked.where(~F.col("held_out")), together=together)
    return predict(marked.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, held_out: Column, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose text is in no known language: ``und``, or a score under ``min_score``."""
    judged = numbered(predict(docs, train(docs.where(~held_out).select("text", "lang"))))
    name, score = judged.columns[-2:]
    return judged.where((F.col(name) != UNKNOWN) & (F.col(score) >= min_score)).drop(name, score).toDF(*docs.columns)


#: crc32 of the id's text, bit by bit.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, lang, {_CRC} % 3 = 1 AS held_out, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS ws FROM documents),
s AS (SELECT doc_id, lang, held_out, ' ' || array_to_string(ws, ' ') || ' ' AS s FROM d WHERE len(ws) > 0),
c AS (SELECT doc_id, lang, held_out, c1, lead(c1) OVER w AS c2, lead(c1, 2) OVER w AS c3
      FROM (SELECT doc_id, lang, held_out, unnest(string_split(s, '')) AS c1, unnest(range(1, length(s) + 1)) AS i FROM s) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, lang, held_out, gram, count(*) AS n FROM (
      SELECT doc_id, lang, held_out, c1 AS gram FROM c WHERE c1 <> ' '
      UNION ALL SELECT doc_id, lang, held_out, c1 || c2 FROM c WHERE c2 IS NOT NULL
      UNION ALL SELECT doc_id, lang, held_out, c1 || c2 || c3 FROM c WHERE c3 IS NOT NULL AND c2 <> ' ') GROUP BY ALL),
p AS (SELECT lang AS name, gram, r FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) - 1 AS r
      FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram) WHERE r < {PROFILE}),
o AS (SELECT doc_id, gram, r, count(*) OVER (PARTITION BY doc_id) AS size FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) - 1 AS r FROM g) WHERE r < {TOP}),
a AS (SELECT o.doc_id, name, any_value(size) AS size, sum(CASE WHEN p.r IS NULL THEN {PROFILE} ELSE abs(p.r - o.r) END) AS apart
      FROM o CROSS JOIN (SELECT DISTINCT name FROM p) names LEFT JOIN p USING (name, gram) GROUP BY o.doc_id, name),
b AS (SELECT doc_id, arg_min(name, (apart, name)) AS name, min(apart) AS apart, any_value(size) AS size FROM a GROUP BY doc_id)
SELECT doc_id, held_out, coalesce(name, 'und') AS lang_pred, CASE WHEN name IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - apart::DOUBLE / ({PROFILE} * size)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id)
"""
