"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel counts common subsequences of ``LENGTH`` characters, each weighted by ``DECAY`` for every character it
spans in either string, so inserted and skipped characters weaken a match instead of breaking it. Words carry a mark in front, so that
the kernel knows where they begin. Landmarks are the words and word beginnings of the labelled sample that tell the
labels apart best, by standing in a text at all or in two words of it. A word is mapped to its kernel values against the landmarks; a
text, read as its set of words, to the largest value of each landmark, to the number of words near it, and to their
share, because a common stem says something only where it is frequent for the text's length. The Nystroem map (the inverse root of the
landmarks' own kernel matrix) turns each of the three into features of a linear machine, and a logistic curve turns its
margin into a score.

Scale: labels are sampled by a hash of the id, at most ``LABELLED`` rows, which is the one bound here; scoring is one
scan without a shuffle over whole texts. Kernel values are computed once for each distinct word that a task
has not met lately, in a bounded table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LENGTH = 4
DECAY = 0.8
#: The kernel is raised to this power, which sharpens it and leaves it a kernel.
POWER = 2
LANDMARKS = 24
#: Kernel shares from which a word counts as near a landmark, rising to a whole count at 1.
NEAR = 0.75
#: Words that every text counts as having beside its own, when shares of words are taken.
SHARE_PRIOR = 20
LABELLED = 4000
THRESHOLD = 0.7
WORD_SPAN = 24
#: Stands before every word; no letter.
START = "^"
_LANDMARK_SPAN = 10
_CACHE_WORDS = 300_000
_CHUNK = 4096
_TOKEN = re.compile(r"\S+")
_NOISE = re.compile(r"[\W\d_]+")


def words(text: str | None) -> list[str]:
    """Letters of the tokens in lower case; runs of three or more single letters are read as one word."""
    out: list[str] = []
    spelled: list[str] = []
    for token in _TOKEN.findall(text.lower()) if text else []:
        word = token if token.isalpha() else _NOISE.sub("", token)
        if len(word) == 1:
            spelled.append(word)
            continue
        if spelled:
            out.extend(["".join(spelled)] if len(spelled) >= 3 else spelled)
            spelled = []
        if word:
            out.append(word)
    if spelled:
        out.extend(["".join(spelled)] if len(spelled) >= 3 else spelled)
    return out


def word_set(text: str | None) -> set[str]:
    """The different ones of :func:`words`: each different token is looked at once, and only runs of single letters are read in order."""
    tokens = text.lower().split() if text else []
    clean = {t: t if t.isalpha() else _NOISE.sub("", t) for t in set(tokens)}
    out = {w for w in clean.values() if len(w) > 1}
    if singles := {t for t, w in clean.items() if len(w) == 1}:
        run: list[int] = []
        for n in [*(n for n, t in enumerate(tokens) if t in singles), len(tokens) + 1]:
            if run and n > run[-1] + 1:
                spelled = [clean[tokens[k]] for k in run]
                out.update(["".join(spelled)] if len(run) >= 3 else spelled)
                run = []
            run.append(n)
    return out


def _codes(strings: list[str]) -> np.ndarray:
    """Characters as numbers, a row for each string, zeros behind its end."""
    return np.array(strings).view(np.uint32).reshape(len(strings), -1)


def _may_share(s: np.ndarray, t: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every row of ``s`` and of ``t`` whether they have characters enough in common for a subsequence of ``LENGTH``; never false where they share one.

    Such a subsequence stands at ``LENGTH`` places of the row of ``t``, of which as many may repeat a bit as the row has places more than bits.
    """
    alphabet = np.unique(t[t > 0])
    bits = np.zeros(int(alphabet[-1]) + 2, dtype=np.uint64)
    bits[alphabet] = np.left_shift(np.uint64(1), (np.arange(len(alphabet)) % 64).astype(np.uint64))
    of_s, of_t = (np.bitwise_or.reduce(bits[np.minimum(x, len(bits) - 1)], axis=1) for x in (s, t))
    least = LENGTH - (sizes - np.bitwise_count(of_t))
    return np.bitwise_count(of_s[None, :] & of_t[:, None]) >= least[:, None]


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Subsequence kernel of every string of ``left`` against every one of ``right``, by dynamic programming over the pairs that may share a subsequence."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not left or not right or not any(left) or not any(right):
        return out
    longest_first = sorted(range(len(right)), key=lambda n: -len(right[n]))
    sizes = np.array([len(right[n]) for n in longest_first])
    s, t = _codes(left), _codes([right[n] for n in longest_first])
    of_t, of_s = np.nonzero(_may_share(s, t, sizes))
    s, t, width = np.ascontiguousarray(s[of_s].T), np.ascontiguousarray(t[of_t].T), t.shape[1]
    reach = [int(np.count_nonzero(sizes[of_t] > j)) for j in range(width)]  # pairs whose right string has this character
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    total, room = np.zeros(len(of_t), dtype=np.float32), np.zeros(len(of_t), dtype=np.float32)
    # prefix[i][j]: weight of common subsequences of i characters in s so far and the first j characters of t; one for i = 0
    prefix = np.zeros((LENGTH, width + 1, len(of_t)), dtype=np.float32)
    prefix[0] = 1
    for letter in s:
        equal = np.multiply(t == letter, square, dtype=np.float32)
        for j, k in enumerate(reach):
            total[:k] += np.multiply(equal[j, :k], prefix[LENGTH - 1, j, :k], out=room[:k])
        for i in range(LENGTH - 1, 0, -1):  # from above, as each needs the shorter ones before this character
            run = np.zeros(len(of_t), dtype=np.float32)
            prefix[i] *= decay
            for j, k in enumerate(reach):
                run[:k] *= decay
                run[:k] += np.multiply(equal[j, :k], prefix[i - 1, j, :k], out=room[:k]) if i > 1 else equal[j, :k]
                prefix[i, j + 1, :k] += run[:k]
    out[of_s, np.array(longest_first)[of_t]] = total
    return out


def similarity(strings: list[str], landmarks: list[str], own: np.ndarray) -> np.ndarray:
    """Kernel values of marked words as shares of each landmark's own, at most 1; long words by their best window."""
    out = np.zeros((len(strings), len(landmarks)), dtype=np.float32)
    pieces, owner = [], []
    for n, s in enumerate(strings):
        s = START + s
        steps = range(0, max(1, len(s) - WORD_SPAN // 2), WORD_SPAN // 2) if len(s) > WORD_SPAN else (0,)
        for at in steps:
            pieces.append(s[at : at + WORD_SPAN])
            owner.append(n)
    order = np.argsort([len(p) for p in pieces], kind="stable")
    owners = np.array(owner)
    marked = [START + landmark for landmark in landmarks]
    for at in range(0, len(order), _CHUNK):  # words of like length together
        part = order[at : at + _CHUNK]
        np.maximum.at(out, owners[part], np.minimum(kernel([pieces[k] for k in part], marked) / own, 1.0))
    return out


@dataclass
class Model:
    landmarks: list[str]
    own: np.ndarray
    weights: np.ndarray  # on the pooled kernel values, the Nystroem map included
    bias: float
    slope: float
    offset: float

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        margin = pooled @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


class WordTable:
    """Similarities of words to the landmarks, remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.place, self.rows = model, {}, np.zeros((0, len(model.landmarks)), dtype=np.float32)

    def learn(self, sets: list[set[str]]) -> None:
        new = list({w for ws in sets for w in ws} - self.place.keys())
        if len(self.place) + len(new) > _CACHE_WORDS:
            self.place, self.rows = {}, self.rows[:0]
            new = list({w for ws in sets for w in ws})
        if new:
            start = len(self.rows)
            self.rows = np.concatenate([self.rows, similarity(new, self.model.landmarks, self.model.own)])
            self.place.update(zip(new, range(start, start + len(new))))

    def pooled(self, ws: set[str]) -> np.ndarray:
        """Largest power of the kernel, words near (as a logarithm) and their share, for each landmark; zero without words."""
        if not ws:
            return np.zeros(3 * len(self.model.landmarks), dtype=np.float32)
        near = self.rows[np.fromiter(map(self.place.__getitem__, ws), dtype=np.int64, count=len(ws))]
        count = np.maximum(near - NEAR, 0).sum(axis=0) / (1 - NEAR)
        return np.concatenate([near.max(axis=0) ** POWER, np.log1p(count), np.log1p(count * (100 / (len(ws) + SHARE_PRIOR)))])


def choose_landmarks(samples: list[tuple[int, set[str]]], most: int = LANDMARKS) -> list[str]:
    """Words and word beginnings that tell the labels apart best, none the beginning of another."""
    seen: dict[tuple[int, int], Counter] = {(label, least): Counter() for label in (0, 1) for least in (1, 2)}
    sizes = [0, 0]
    for label, ws in samples:
        sizes[label] += 1
        parts = Counter(w[:n] for w in ws for n in range(3, min(len(w), _LANDMARK_SPAN) + 1))
        for least in (1, 2):  # in how many texts at all, and in two words
            seen[label, least].update(p for p, n in parts.items() if n >= least)
    best: dict[str, float] = {}
    for least in (1, 2):
        for part, n in seen[1, least].items():
            if n >= 2:
                gain = n * (math.log((n + 0.5) / (sizes[1] + 1)) - math.log((seen[0, least][part] + 0.5) / (sizes[0] + 1)))
                best[part] = max(gain, best.get(part, 0.0))
    out: list[str] = []
    for _, _, part in sorted((-gain, -len(part), part) for part, gain in best.items() if gain > 0):
        if len(out) == most:
            break
        if not any(part.startswith(o) or o.startswith(part) for o in out):
            out.append(part)
    return out


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 400, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient descent; y is -1 or 1."""
    data = np.hstack([x, np.ones((len(x), 1))])
    step = 1.0 / (2 * (np.linalg.norm(data, 2) ** 2) / len(x) + penalty)
    w = ahead = np.zeros(data.shape[1])
    for n in range(rounds):
        slack = np.maximum(0.0, 1 - y * (data @ ahead))
        gradient = -2 * (data.T @ (slack * y)) / len(x) + penalty * np.append(ahead[:-1], 0)
        new = ahead - step * gradient
        ahead = new + n / (n + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _curve(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve (Platt's targets), by Newton steps."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    data, w = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -50, 50)))
        hessian = (data * (p * (1 - p))[:, None]).T @ data + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, data.T @ (p - target)), -5, 5)
    return float(w[0]), float(w[1])


def fit(samples: list[tuple[int, set[str]]]) -> Model:
    """A model from (label 0 or 1, words) pairs; with one label only or none, the share of ones for every text."""
    ones = sum(label for label, _ in samples)
    landmarks = choose_landmarks(samples) if 0 < ones < len(samples) else []
    if not landmarks:
        share = (ones + 1) / (len(samples) + 2) if samples else 0.0
        return Model([], np.zeros(0), np.zeros(0), 0.0, 0.0, math.log(share / (1 - share)) if share else -50.0)
    marked = [START + landmark for landmark in landmarks]
    gram = kernel(marked, marked).astype(np.float64)
    own = np.diag(gram).copy()
    gram = (gram / np.sqrt(own[:, None] * own[None, :])) ** POWER
    values, vectors = np.linalg.eigh(gram)
    root = np.kron(np.eye(3), vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T)  # the Nystroem map
    model = Model(landmarks, own.astype(np.float32), np.zeros(3 * len(landmarks)), 0.0, 1.0, 0.0)
    table, rows = WordTable(model), []
    for at in range(0, len(samples), 500):
        sets = [ws for _, ws in samples[at : at + 500]]
        table.learn(sets)
        rows += [table.pooled(ws) for ws in sets]
    pooled = np.array(rows, dtype=np.float64)
    positive = np.array([label == 1 for label, _ in samples])
    weights, model.bias = _machine(pooled @ root, np.where(positive, 1.0, -1.0))
    model.weights = root @ weights
    model.slope, model.offset = _curve(pooled @ model.weights + model.bias, positive)
    return model


def sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> list[tuple[int, set[str]]]:
    """Label and different words of at most ``labelled`` labelled rows of ``docs``, chosen by a hash of the id, one for each id."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").distinct()
    chosen = marked.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)  # bounded, so fit to broadcast
    text = F.min_by("text", F.struct(F.xxhash64("text"), "text"))  # of rows that repeat an id one teaches, so that ids bound rows
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [" ".join(sorted(word_set(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(said, pa.string())], names=["doc_id", "toxic", "words"])

    rows = map_batches(picked.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text"), run, "doc_id long, toxic int, words string").collect()
    return [(r["toxic"], set(r["words"].split())) for r in sorted(rows, key=lambda r: (r["doc_id"], r["words"]))]


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text), by its whole text.

    ``labels`` has doc_id and toxic (0 or 1; others teach nothing; a document with both counts as 1). Learns from rows that are
    not held out. Null and wordless texts get the score of a text that resembles no landmark. Repeated rows and null
    doc_ids give rows of their own; an empty table gives none. Other columns are ignored. A text of any length is read as a
    whole, as its set of words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = fit(sample(docs.where(~held_out), labels.where(~held_out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model)
        for batch in batches:
            sets = [word_set(t) for t in batch.column("text").to_pylist()]
            table.learn(sets)
            score = model.probability(np.array([table.pooled(ws) for ws in sets], dtype=np.float64).reshape(len(sets), -1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = map_batches(docs, run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
