"""Document quality by attention over passages (multiple-instance learning with a gated attention pooling).

A document is a bag of passages of ``PASSAGE`` words. Every passage becomes a vector: shares of hashed word shapes and of hashed words, and how far
it repeats itself, shouts or is made of signs. A layer encodes the vector; a gated attention (a tanh unit times a sigmoid unit, then a softmax over the document's passages)
weighs the encodings; a logistic unit scores their weighted sum. Labels are of documents only; which passages speak for them is learned.

Scale: learns from at most ``LABELLED`` labelled documents and ``PASSAGES`` of their passages, chosen by a hash of the id; these two bound
what reaches the driver, and nothing else here is bounded. Scoring is one scan without a shuffle, every passage of every text is encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

PASSAGE = 48
SHAPES, WORDS, PLAIN = 96, 96, 8
WIDTH = SHAPES + WORDS + PLAIN
ENCODED, GATED = 24, 12
LABELLED, PASSAGES = 4000, 40_000
ROUNDS, DOCS_A_STEP, RATE, PENALTY = 40, 128, 0.01, 1e-4
THRESHOLD = 0.3
_READ = 100_000
_CACHE_WORDS = 200_000
_LONG_WORD = 64
_FORMS = ((re.compile("[^\\W\\d_a-zß-öø-ÿ]+"), "A"), (re.compile("[^\\W\\d_A]+"), "a"), (re.compile("\\d+"), "0"))


def shape(word: str) -> str:
    """Runs of capitals, of other letters and of digits as one character each; signs stay, three of a kind at most."""
    out = word
    for pattern, sign in _FORMS:
        out = pattern.sub(sign, out)
    return re.sub(r"(.)\1{3,}", r"\1\1\1", out)[:12]


class WordTable:
    """Of each word met lately: the buckets of its shape and of itself, its letters, capitals and signs."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.table = np.zeros((0, 5), dtype=np.int32)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words (equal for equal words of one call), and the table that they point into."""
        if len(self.place) > _CACHE_WORDS:
            self.place, self.rows, self.table = {}, [], self.table[:0]
        place, rows = self.place, self.rows
        ids = np.empty(len(words), dtype=np.int64)
        for n, word in enumerate(words):
            at = place.get(word)
            if at is None:
                at = place[word] = len(rows)
                rows.append(self._row(word))
            ids[n] = at
        if len(rows) > len(self.table):
            self.table = np.concatenate([self.table, np.array(rows[len(self.table) :], dtype=np.int32).reshape(-1, 5)])
        return ids, self.table

    @staticmethod
    def _row(word: bytes) -> tuple[int, int, int, int, int]:
        said = word[: 4 * _LONG_WORD].decode(errors="replace")[:_LONG_WORD]  # what a word longer than that is like, not what it says
        letters = sum(c.isalpha() for c in said)
        return xxhash.xxh32_intdigest(shape(said)) % SHAPES, xxhash.xxh32_intdigest(word.lower(), 1) % WORDS, letters, sum(c.isupper() for c in said), len(said) - letters


def passages(words: list[list[bytes]], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of some documents, and each document's number of passages."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    counts = -(-sizes // PASSAGE)
    ids, known = table.of([w for ws in words for w in ws])
    doc = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(np.cumsum(counts) - counts, sizes) + place // PASSAGE
    n = int(counts.sum())
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if not n:
        return out, counts
    size = np.bincount(passage, minlength=n).astype(np.float32)
    rows = known[ids]
    for offset, column, width in ((0, 0, SHAPES), (SHAPES, 1, WORDS)):
        out[:, offset : offset + width] = np.bincount(passage * width + rows[:, column], minlength=n * width).reshape(n, width)
    out[:, : SHAPES + WORDS] = np.sqrt(out[:, : SHAPES + WORDS] / size[:, None])
    per = lambda weights: np.bincount(passage, weights=weights, minlength=n)
    again = np.zeros(len(ids))
    again[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    pair = ids.copy()  # two words in a row of a document; its first word has none before it
    pair[1:] += (doc[1:] == doc[:-1]) * (ids[:-1] + 1) * (len(known) + 1)
    old = np.ones(len(ids))
    old[np.unique(np.unique(pair, return_inverse=True)[1] * len(words) + doc, return_index=True)[1]] = 0  # which the document had before
    distinct = np.bincount(np.unique(passage * (len(known) + 1) + ids) // (len(known) + 1), minlength=n)
    letters, capitals, signs = (per(rows[:, c]) for c in (2, 3, 4))
    plain = (per(again) / size, per(old) / size, distinct / size, capitals / np.maximum(letters, 1), signs / np.maximum(letters + signs, 1), letters / size / 8, np.log1p(size) / 4, np.log1p(counts[np.repeat(np.arange(len(words)), counts)]) / 4)
    out[:, SHAPES + WORDS :] = np.stack(plain, axis=1)
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float  # of a text without passages, or of all if nothing was learned

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """All that the gradient needs, for documents with at least one passage."""
        w, starts = self.weights, np.cumsum(counts) - counts
        own = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        left, right = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
        raw = (left * right) @ w["attend"]
        raw = np.exp(raw - np.maximum.reduceat(raw, starts)[own])
        share = raw / np.add.reduceat(raw, starts)[own]
        pooled = np.add.reduceat(share[:, None] * h, starts)
        return {"own": own, "starts": starts, "h": h, "left": left, "right": right, "share": share, "pooled": pooled, "p": _sigmoid(pooled @ w["score"] + w["score_bias"])}

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss."""
        w, f = self.weights, self.forward(x, counts)
        own, h, share = f["own"], f["h"], f["share"]
        d_out = (f["p"] - y) / len(y)
        d_pooled = d_out[:, None] * w["score"]
        along = (h * d_pooled[own]).sum(axis=1)
        d_raw = share * (along - np.add.reduceat(share * along, f["starts"])[own])
        d_left = d_raw[:, None] * w["attend"] * f["right"] * (1 - f["left"] ** 2)
        d_right = d_raw[:, None] * w["attend"] * f["left"] * f["right"] * (1 - f["right"])
        d_h = (share[:, None] * d_pooled[own] + d_left @ w["tanh"].T + d_right @ w["gate"].T) * (1 - h**2)
        return {"encode": x.T @ d_h, "encode_bias": d_h.sum(axis=0), "tanh": h.T @ d_left, "gate": h.T @ d_right, "attend": (f["left"] * f["right"]).T @ d_raw, "score": f["pooled"].T @ d_out, "score_bias": d_out.sum(keepdims=True)}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        some = counts > 0
        if some.any() and self.weights:
            out[some] = self.forward((x - self.mean) / self.scale, counts[some])["p"]
        return out


def start(width: int = WIDTH, seed: int = 7) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    shapes = {"encode": (width, ENCODED), "encode_bias": (ENCODED,), "tanh": (ENCODED, GATED), "gate": (ENCODED, GATED), "attend": (GATED,), "score": (ENCODED,), "score_bias": (1,)}
    return {k: random.normal(0, 0 if k.endswith("bias") else 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}


def fit(bags: list[np.ndarray], labels: list[int]) -> Model:
    """A model from the passage vectors of documents and their labels; with one label only or none, the share of ones for every text."""
    prior = (sum(labels) + 1) / (len(labels) + 2)
    if not 0 < sum(labels) < len(labels):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, prior)
    every = np.concatenate(bags).astype(np.float64)
    model = Model(every.mean(axis=0), np.maximum(every.std(axis=0), 0.02), start(), prior)
    every = (every - model.mean) / model.scale
    counts = np.array([len(b) for b in bags])
    starts, y = np.cumsum(counts) - counts, np.array(labels, dtype=np.float64)
    random, step = np.random.default_rng(11), 0
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for turn in range(ROUNDS):
        order = random.permutation(len(bags))
        for at in range(0, len(order), DOCS_A_STEP):
            some = order[at : at + DOCS_A_STEP]
            x = np.concatenate([every[starts[n] : starts[n] + counts[n]] for n in some])
            step += 1
            rate = RATE * (1 - turn / ROUNDS)
            for k, g in model.gradient(x, counts[some], y[some]).items():
                g = g + PENALTY * model.weights[k] * (not k.endswith("bias"))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, most: int = PASSAGES) -> tuple[list[np.ndarray], list[int]]:
    """Passage vectors and labels of at most ``labelled`` labelled documents with ``most`` passages together, in the order of a hash of the id.

    One row for each id; a document that alone has more passages than that, or none, teaches nothing.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)  # bounded, so fit to broadcast
    text = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(text.alias("text"))
    size = F.ceil(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) / PASSAGE)
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over at most `labelled` rows without their texts
    sized = picked.select("doc_id", size.alias("size")).where((F.col("size") > 0) & (F.col("size") <= most))
    fits = sized.withColumn("so_far", F.sum("size").over(order)).where(F.col("so_far") <= most).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            vectors = [passages([t.encode().split()], table)[0].astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(vectors, pa.binary())], names=["doc_id", "quality", "vectors"])

    rows = map_batches(picked.join(F.broadcast(fits), "doc_id").select("doc_id", "quality", "text"), run, "doc_id long, quality int, vectors binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [np.frombuffer(r["vectors"], dtype=np.float16).reshape(-1, WIDTH) for r in rows], [r["quality"] for r in rows]


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text), by its whole text.

    ``labels`` has doc_id and quality (0 or 1; others teach nothing; a document with both counts as 1). Learns from rows that are
    not held out. Null and wordless texts get the share of ones among what was learned. Repeated rows and null
    doc_ids give rows of their own; an empty table gives none. Other columns are ignored. A text of any length is read as a whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    model = fit(*sample(docs.where(~held_out), labels.where(~held_out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            ids, words, size, out = batch.column("doc_id"), [], 0, []

            def score() -> None:
                out.extend(model.scores(*passages(words, table)).tolist())

            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words.append(text.split() if text else [])
                size += len(words[-1])
                if size >= _READ:
                    score()
                    words, size = [], 0
            score()
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = map_batches(docs, run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
