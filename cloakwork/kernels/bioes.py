"""Decoding of token-class logits: a biased Viterbi search over BIOES tags, then spans."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np

from .text import Span

#: The classes that a detector may name.
CLASSES = ("account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret")


@dataclass(frozen=True)
class Biases:
    """What a calibration adds to six kinds of step."""

    background_stay: float = 0.0
    background_to_start: float = 0.0
    inside_to_continue: float = 0.0
    inside_to_end: float = 0.0
    end_to_background: float = 0.0
    end_to_start: float = 0.0


def parse_biases(text: str, point: str = "default") -> Biases:
    """Biases of an operating point; a missing point or bias is an error."""
    values = json.loads(text)["operating_points"][point]["biases"]
    return Biases(*(float(values[f"transition_bias_{f.name}"]) for f in fields(Biases)))


def parse_labels(text: str) -> list[str]:
    """Labels of a model's configuration in the order of its outputs; numbers left out are background."""
    named = {int(n): label for n, label in json.loads(text)["id2label"].items()}
    if not named or min(named) < 0:
        raise ValueError("the configuration names no labels")
    return [named.get(n, "O") for n in range(max(named) + 1)]


def parse_tag(label: str) -> tuple[str, str]:
    """(prefix, class) of a label; labels without a dash are background."""
    prefix, dash, kind = label.partition("-")
    return (prefix, kind) if dash and prefix in "BIES" else ("O", "")


def transition_matrix(tags: Sequence[tuple[str, str]], biases: Biases) -> np.ndarray:
    """Score of each step from tag to tag; minus infinity where BIOES forbids it."""
    n = len(tags)
    out = np.full((n, n), -np.inf)
    for i, (p, kind) in enumerate(tags):
        for j, (q, other) in enumerate(tags):
            if p in "BI":
                if q in "IE" and kind == other:
                    out[i, j] = biases.inside_to_continue if q == "I" else biases.inside_to_end
            elif q in "BS":
                out[i, j] = biases.background_to_start if p == "O" else biases.end_to_start
            elif q == "O":
                out[i, j] = biases.background_stay if p == "O" else biases.end_to_background
    return out


class Decoder:
    def __init__(self, labels: Sequence[str], biases: Biases = Biases()) -> None:
        self.tags = [parse_tag(x) for x in labels]
        self.steps = transition_matrix(self.tags, biases)
        self.begins = np.array([p not in "IE" for p, _ in self.tags])
        self.named = np.array([p != "O" for p, _ in self.tags])

    def path(self, logits: np.ndarray) -> list[int]:
        """Best tag of every token; any tag may be the last; ties go to the lower index."""
        return self.paths(np.asarray(logits, dtype=np.float64), [len(logits)]).tolist()

    def paths(self, data: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
        """The same of several texts of ``sizes`` tokens, whose logits follow each other; a step is taken in all texts that reach so far at once."""
        lengths, out = np.asarray(sizes, dtype=np.int64), np.zeros(len(data), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")[: np.count_nonzero(lengths)]
        if not len(order):
            return out
        starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        longest = int(lengths[0])
        reached = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()  # texts that have this token
        towards, back = np.ascontiguousarray(self.steps.T), np.zeros((len(data), len(self.tags)), dtype=np.int16)
        score, tag = np.where(self.begins, data[starts], -np.inf), np.zeros(len(order), dtype=np.int64)
        for n in range(1, longest):
            if (k := reached[n]) < len(score):
                tag[k : len(score)], score = score[k:].argmax(axis=1), score[:k]
            at = starts[:k] + n
            reach = score[:, None, :] + towards
            back[at] = reach.argmax(axis=2)
            score = reach.max(axis=2) + data[at]
        tag[: len(score)] = score.argmax(axis=1)
        for n in range(longest - 1, 0, -1):
            k = reached[n]
            at, now = starts[:k] + n, tag[:k]
            out[at] = now
            tag[:k] = back[at, now]
        out[starts] = tag
        return out

    def spans(self, logits: Sequence[Sequence[float]], offsets: Sequence[Sequence[int]]) -> list[Span]:
        """Spans of finished runs, each with its tokens' mean probability; what is begun and not ended is dropped."""
        data = np.asarray(logits, dtype=np.float64).reshape(-1, len(self.tags))
        return [(int(offsets[a][0]), int(offsets[b][1]), kind, mean) for a, b, kind, mean in self.runs([data])[0]]

    def runs(self, logits: Sequence[np.ndarray]) -> list[list[tuple[int, int, str, float]]]:
        """The same of several texts, by the places of their first and last tokens."""
        sizes = [len(x) for x in logits]
        data = np.concatenate([np.zeros((0, len(self.tags))), *logits])
        path, at, out = self.paths(data, sizes), 0, []
        busy = np.flatnonzero(self.named[path])
        cuts = np.searchsorted(busy, np.cumsum([0, *sizes])).tolist()
        for size, a, b in zip(sizes, cuts, cuts[1:]):
            found, first, last = [], None, None
            for n in busy[a:b].tolist():
                prefix, kind = self.tags[path[n]]
                if last is not None and n > last + 1:  # background in between
                    first = None
                if prefix in "BS":
                    first = n
                if prefix in "ES" and first is not None and self.tags[path[first]][1] == kind:
                    part = data[first : n + 1]
                    shares = np.exp(part - part.max(axis=1, keepdims=True))
                    shares = shares / shares.sum(axis=1, keepdims=True)
                    found.append((first - at, n - at, kind, float(np.mean(shares[np.arange(len(part)), path[first : n + 1]]))))
                if prefix in "ES":
                    first = None
                last = n
            out.append(found)
            at += size
        return out


def byte_offsets(text: str, offsets: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets, as tokenizers give them in Python, as byte offsets."""
    if text.isascii():
        return [(int(a), int(b)) for a, b in offsets]
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
    return [(int(at[a]), int(at[b])) for a, b in offsets]
