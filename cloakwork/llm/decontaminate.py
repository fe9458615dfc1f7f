"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints: of every ``width - GRAM + 1`` consecutive ``GRAM``-word hashes, the smallest is kept. Any span of ``width``
words that a document shares with a test item keeps the same hash on both sides, so joining the fingerprints misses no
shared window. Documents that share a fingerprint are extended: their full windows are joined with the items'
windows, word for word, and the hit words are the union of those windows. Items shorter than ``width`` words are one window of
their own length and are looked up by it.

Scale: documents are scanned once for fingerprints, which go as (digest of the text, fingerprint), never with the text, and stay in
the task (distinct ones per document) until they meet the test set. The test set's fingerprints are broadcast only if counted below
``BROADCAST_ROWS``; above that the same join shuffles. Windows are opened only for texts with a shared fingerprint, equal texts once. Items
with equal windows are one row with a list. Hits are written before they meet the documents, so that a text which a
third of them repeat is a join key that can be split, or needs no shuffle at all where the hits are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, numbered

WIDTH = 13
GRAM = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of the words: every ASCII character but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.array_remove(parts, "")


def _with(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's argument is not inlined."""
    return F.transform(F.array(value), body)[0]


def _grams(ws: Column, n: int) -> Column:
    """Hash of the n words from each place on; empty if there are fewer than n."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _winnow(hashes: Column, span: int) -> Column:
    """The smallest of every ``span`` consecutive hashes, each once."""
    least = F.transform(F.sequence(F.lit(1), F.size(hashes) - (span - 1)), lambda i: F.array_min(F.slice(hashes, i, span)))
    return F.when(F.size(hashes) >= span, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(ws: Column, width: int, short: list[int]) -> Column:
    """Winnowed hashes of the windows, and the hashes of all grams of the short items' lengths."""
    gram = min(GRAM, width)
    parts = [_with(_grams(ws, gram), lambda h: _winnow(h, width - gram + 1)), *(_grams(ws, n) for n in short)]
    return F.array_distinct(F.concat(*parts)) if short else parts[0]


def _windows_of(ws: Column, n: Column) -> Column:
    """The windows of n words as texts, with their places (from 0)."""
    at = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(ws, i + 1, n), " ").alias("window")))


def _windows(ws: Column, n: int) -> Column:
    return _windows_of(ws, F.lit(n))


def _covered(spans: Column) -> Column:
    """Words in the union of (at, n) spans, sorted by place."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def step(state: Column, span: Column) -> Column:
        end = span["at"] + span["n"]
        new = F.greatest(F.lit(0), end - F.greatest(state["end"], span["at"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["words"] + new).alias("words"))

    return F.aggregate(spans, start, step)["words"]


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few; else joins on it shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, digest (of its text), n_words, n_hit, items (sorted as strings), contaminated.

    A word is hit if it is inside an occurrence of a window of any item of ``benchmark`` (item_id, text). Null or
    wordless texts have no words and no windows; null item_ids are left out of the list, though their windows
    hit. Rows that repeat a doc_id or have none are judged each by its own text. An empty benchmark hits nothing.
    Other columns are ignored. A text of any length is judged as a whole.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(width))
    sizes = sorted(r[0] for r in items.select(size.alias("n")).distinct().collect())  # at most `width` numbers
    short = [n for n in sizes if n < width]
    marks = items.select(F.explode(F.when(F.size("ws") < width, F.array(F.xxhash64("ws"))).otherwise(_with(F.col("ws"), lambda ws: _fingerprints(ws, width, [])))).alias("mark")).distinct()
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    found = _with(words(F.col("text")), lambda ws: _fingerprints(ws, width, short))
    keys = durable(texts.select(F.md5("text").alias("digest"), F.explode(found).alias("mark")).join(_small(marks), "mark").select("digest").distinct())
    met = texts.select(F.md5("text").alias("digest"), "text").join(_small(keys), "digest", "left_semi")
    suspects = met.groupBy("digest").agg(F.first("text").alias("text"))  # equal texts are judged once
    # extension: whole windows, word for word
    tested = items.select("item", F.explode(_windows_of(F.col("ws"), size)).alias("w")).groupBy("w.n", "w.window").agg(F.collect_set("item").alias("items"))
    opened = suspects.select("digest", F.explode(_with(words(F.col("text")), lambda ws: F.concat(*[_windows(ws, n) for n in sizes]) if sizes else F.array())).alias("w")) if sizes else None
    judged = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    if opened is None:
        hits = judged.select("digest").limit(0).select("digest", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        hits = opened.select("digest", "w.*").join(_small(tested), ["n", "window"]).groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
        hits = durable(hits.select("digest", _covered(F.col("spans")).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items")))
        if hits.agg(F.coalesce(F.sum(F.size("items") + 1), F.lit(0))).first()[0] <= BROADCAST_ROWS:
            hits = F.broadcast(hits)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return judged.join(hits, "digest", "left").select(
        "doc_id", "digest", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns from :func:`contamination`."""
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows. Each row is judged by its own text, whatever its doc_id; equal texts go together."""
    bad = _small(durable(contamination(docs, benchmark).where("contaminated").select("digest").distinct()))
    rows = numbered(docs)
    digest = F.md5(F.coalesce(F.col(rows.columns[docs.columns.index("text")]), F.lit("")))
    return rows.join(bad, digest == bad["digest"], "left_anti").toDF(*docs.columns)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i
             FROM (SELECT item_id, ws, least(len(ws), {WIDTH}) AS n FROM b WHERE len(ws) > 0))),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
