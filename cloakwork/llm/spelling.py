"""Spelling variants: words one edit apart, grouped under the most frequent of them, by an even-partition pigeonhole join.

Each word is cut into two segments, the first of half its length. One edit leaves a segment whole, so a near word of equal length has one of the
two at the same place, and a word longer by one has the first there or the second one place further on. Words are indexed under (length, segment, its text);
words of equal length and words longer by one probe with the substrings at those places; what meets is verified by its edit distance.

A segment under which more than ``CROWD`` rows meet is taken further by the same rule: its words differ in the rest by the same one edit, so
the rest is cut into two halves, and one of these has to agree as well. This goes on while a group is crowded and the rest can be
cut, so that a prefix which a third of all words share costs no pair that the rest does not call for.

Scale: occurrences are counted inside the tasks and then by word; all later shuffles are of distinct frequent words. No group is
gathered anywhere: counts are partial sums, and the candidates come from equijoins that can be split.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, texts

SHORTEST, LEAST = 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
CROWD = 64
_TASK_WORDS = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) with ``shortest`` code points and ``least`` occurrences.

    Words are maximal runs of Latin letters with A-Z in lower case; ``change`` may make another word of one in a document before it
    is counted. Null texts have none; repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                said = Counter(_RUN.findall(text.lower().decode())) if text else {}  # bytes.lower() changes A-Z only
                for word, n in said.items():
                    if len(word) >= shortest:
                        new = word if change is None else change(doc, word)
                        if len(new) >= shortest:
                            total[new] += n
                if len(total) >= _TASK_WORDS:
                    yield rows()
        if total:
            yield rows()

    counted = map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(said: Column, size: Column, longer: bool) -> Column:
    """(segment, its text, the rest) of both segments of an indexed text of ``size`` code points; with ``longer`` the substrings that a
    text of one more has at their places."""
    half = F.floor(size / 2).cast("int")
    second = half + (2 if longer else 1)
    first = F.struct(F.lit(1).alias("segment"), F.substring(said, 1, half).alias("part"), F.substring(said, half + 1, F.length(said)).alias("rest"))
    return F.array(first, F.struct(F.lit(2).alias("segment"), F.substring(said, second, F.length(said)).alias("part"), F.substring(said, 1, second - 1).alias("rest")))


def candidates(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of ``words`` (word, n) that meet under a segment: b is one longer, or of equal length and behind a in order."""
    size = F.length("word")
    own = words.select("word", "n", F.lit(False).alias("longer"), size.alias("size"))
    far = words.select("word", "n", F.lit(True).alias("longer"), (size - 1).alias("size"))
    rows = own.unionAll(far).withColumn("place", F.lit("")).withColumn("rest", F.col("word")).withColumn("rest_size", F.col("size"))
    done = None
    while True:
        cut = [F.when(F.col("longer"), _halves(F.col("rest"), F.col("rest_size"), True)).otherwise(_halves(F.col("rest"), F.col("rest_size"), False))]
        rows = rows.select("word", "n", "longer", "size", "place", "rest_size", F.inline(*cut))
        # the key of a level is the key of the one before, which segment agrees, and its text; blanks are in no word
        rows = rows.withColumn("place", F.concat_ws(" ", "place", F.col("segment").cast("string"), "part"))
        rows = rows.select("word", "n", "longer", "size", "place", "rest", (F.length("rest") - F.col("longer").cast("int")).alias("rest_size"))
        met = rows.groupBy("size", "place").agg(F.count(F.lit(1)).alias("met"), F.count_if(~F.col("longer")).alias("indexed"))
        rows = durable(rows.join(met.where("indexed > 0 and met > 1"), ["size", "place"]))
        again = (F.col("met") > crowd) & (F.col("rest_size") > 1)
        few = rows.where(~again).drop("met", "indexed", "rest", "rest_size")
        done = few if done is None else done.unionAll(few)
        rows = rows.where(again).drop("met", "indexed")
        if rows.isEmpty():
            break
    a = done.where(~F.col("longer")).select("size", "place", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = done.select("size", "place", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    return a.join(b, ["size", "place"]).where(F.col("longer") | (F.col("a") < F.col("b"))).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The candidates that are one inserted, deleted or replaced code point apart, each once."""
    return candidates(words, crowd).where(F.levenshtein("a", "b", 1) == 1).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to. Chains are walked in doubling steps; as frequencies grow along them, they end."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = durable(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = further.select("word", "root")
        if further.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """Per row of ``words`` (distinct word, n): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (of equal ones the first in code-point order), if that is at least ``ratio`` times as frequent, else
    null; its root is the end of the chain of forms, or the word itself. An empty table gives no rows. Other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its variant")
    words = durable(words.select("word", "n"))
    pairs = durable(near_pairs(words, crowd))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    leads = -F.col("best.minus") >= ratio * F.col("n")
    judged = durable(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.minus")).alias("form_n")))
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """The spelling variants of all frequent words of ``docs`` (doc_id, text): see :func:`count_words` and :func:`variants`."""
    return variants(count_words(docs, change=change))


def brute_force(rows: list[tuple[int | None, str | None]], change: Callable[[int | None, str], str] | None = None, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO) -> set[tuple]:
    """The same by all edits of every word, for small tests."""
    count: Counter = Counter()
    for doc, text in rows:
        for run in _RUN.findall((text or "").encode().lower().decode()):
            count[run if change is None else change(doc, run)] += 1
    count = Counter({w: n for w, n in count.items() if len(w) >= shortest and n >= least})
    letters = {c for w in count for c in w}
    form, near = {}, {}
    for w in count:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))}
        edits |= {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in letters for d in (0, 1)}
        found = [x for x in edits - {w} if x in count]
        near[w] = len(found)
        best = min(found, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, count[w], near[w], count[form[w]] if form[w] is not None else None))
    return out


#: crc32 of ``<doc_id>:<run>`` by half bytes (the table follows from the polynomial); words by their deletions.
_STEPS = [n for n in range(16)]
for _ in range(4):
    _STEPS = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in _STEPS]
_DIGITS = "list_transform(flatten(list_transform(range(1, strlen(hex(encode(said))) + 1, 2), lambda k: [hex(encode(said))[k + 1], hex(encode(said))[k]])), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_DIGITS}), lambda c, d: xor({_STEPS}[xor(c, d) % 16 + 1], c // 16)), 4294967295)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {SHORTEST} GROUP BY ALL),
h AS (SELECT run, n, {_CRC} AS h FROM (SELECT run, n, doc_id || ':' || run AS said FROM r)),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h) WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
x AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
      UNION SELECT word, cut FROM x WHERE cut IN (SELECT word FROM v) UNION SELECT cut, word FROM x WHERE cut IN (SELECT word FROM v)),
b AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-v.n, near)) AS near, max(v.n) AS near_n FROM p JOIN v ON v.word = near GROUP BY p.word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT w.word, w.next, f.form FROM w JOIN f ON f.word = w.next)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM w WHERE next IS NULL) USING (word)
"""
