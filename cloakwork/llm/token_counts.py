"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary names every piece that ends at each character. Dynamic
programming carries the best score and the number of pieces of the best path; no lattice and no pieces are kept.
Ties are resolved as unigram tokenizers do: a path is replaced only by a strictly better one, starts are taken from left to
right, so the longest piece wins, and an unknown character (the least score minus ten, where no one-character piece
fits) loses a tie. An unknown character counts as its UTF-8 bytes where the vocabulary falls back to bytes, and
else as one token for each run of them.

Public vocabularies of unigram tokenizers with their probabilities are rare, and tokenizers are never trained here. So the
probabilities may come from a vocabulary's order alone, by Zipf's law in Mandelbrot's form: the piece at place r has a share in proportion to
1 / (r + ``SHIFT``). That gives proper log-probabilities over the public pieces, and no other number of the file is read.

Scale: one scan, no shuffle. Where no piece has a word mark inside it, the best path passes every word start,
so words are counted apart and remembered in a bounded table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MARK = "▁"  # stands for a space in vocabularies
UNKNOWN_PENALTY = 10.0
#: Mandelbrot's constant for words of a text.
SHIFT = 2.7
_CACHE_WORDS = 400_000
_LONG = 64


class UnigramCounter:
    """Counts the pieces of the best segmentation under ``pieces`` (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool) -> None:
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        inner = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        lines = byte_fallback and not any("\n" in p for p, _ in pieces)
        words = rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if lines else rf"{MARK}*[^{MARK}]+|{MARK}+"
        # without byte fallback, runs of unknown characters count together across words, so the text stays whole
        self.cut = None if inner or not byte_fallback else re.compile(words)
        self.known: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path over the whole of ``text``."""
        n = len(text)
        score, count, unknown_end = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # ends settled so far

        def settle(end: int, matches: list[tuple[int, float]]) -> None:
            top, start, value = None, 0, 0
            single = False
            for length, own in sorted(matches, reverse=True):
                single = single or length == 1
                now = score[end - length] + own
                if top is None or now > top:
                    top, start, value = now, end - length, count[end - length] + 1
            flag = False
            if not single:
                now = score[end - 1] + self.unknown
                if top is None or now > top:
                    top, flag = now, True
                    if self.byte_fallback:
                        value = count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        value = count[end - 1] + (not unknown_end[end - 1])
            score[end], count[end], unknown_end[end] = top, value, flag

        at: list[tuple[int, float]] = []
        for last, piece in self.automaton.iter(text) if len(self.automaton) else ():
            while done < last:  # all ends before this one
                done += 1
                settle(done, at)
                at = []
            at.append(piece)
        while done < n:
            done += 1
            settle(done, at)
            at = []
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a document: a word mark goes before it and stands for every space. Null and empty: (0, 0)."""
        if not text:
            return 0, 0.0
        text = MARK + text.replace(" ", MARK)
        if self.cut is None:
            return self.best(text)
        tokens, total, known = 0, 0.0, self.known
        for word in self.cut.findall(text):
            got = known.get(word)
            if got is None:
                got = self.best(word)
                if len(word) <= _LONG:
                    if len(known) >= _CACHE_WORDS:
                        known.clear()
                    known[word] = got
            tokens += got[0]
            total += got[1]
        return tokens, total


def sentencepiece_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, log-probability) of the ordinary pieces of a model file, and whether it falls back to bytes.

    A file of unigrams has the log-probabilities; of any other kind only the order of the pieces is taken.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    ordinary = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = sum(math.exp(min(score, 1.0)) for _, score in ordinary)
    if not 0.5 < total < 1.5:  # no probabilities
        ordinary = by_order([piece for piece, _ in ordinary])
    return ordinary, any(model.is_byte(i) for i in ids)


def by_order(pieces: list[str], shift: float = SHIFT) -> list[tuple[str, float]]:
    """Log-probability of each piece of a vocabulary that goes from frequent to rare."""
    total = math.log(sum(1.0 / (r + shift) for r in range(1, len(pieces) + 1)))
    return [(p, -math.log(r + shift) - total) for r, p in enumerate(pieces, 1)]


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens and score of each row of ``docs`` (doc_id, text), whole texts.

    The vocabulary is read from ``vocabulary_path`` where the tasks run. Null and empty texts have no tokens and score
    0. Repeated rows and null doc_ids give rows of their own; an empty table gives none. Other columns are ignored. A text of any
    length is counted as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(*sentencepiece_pieces(vocabulary_path))
        for batch in batches:
            got = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, score double")
