"""Span detectors. A detector maps a text to (start, end, class, score) spans in bytes."""

from __future__ import annotations

import hashlib
import os
import re
from collections import OrderedDict
from collections.abc import Callable, Sequence
from pathlib import Path
from functools import reduce
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.kernels import bioes, text
from cloakwork.kernels.text import Span


#: Fixed value: how many texts a worker remembers.
CAPACITY = 8192
#: Tokens, padding counted, of the texts that go to a model in one call; a longer text goes alone.
CALL_TOKENS = 8192
#: Tokens from which on the logits at hand are decoded, all their texts together.
DECODE_TOKENS = 1 << 17


class Detector(Protocol):
    def detect(self, text: str) -> list[Span]: ...


def detect_all(detector: Detector, texts: Sequence[str]) -> list[list[Span]]:
    """Spans of each text: by one call for all where the detector has ``detect_many``, else one by one."""
    many = getattr(detector, "detect_many", None)
    return many(texts) if many is not None else [detector.detect(t) for t in texts]


class DetectorUnavailable(RuntimeError):
    """No detector: nothing may be passed on as if it were clean."""


#: Rule patterns in the common subset of Java, Python and RE2, in the order that decides a value's class.
RULES: tuple[tuple[str, str], ...] = (
    ("private_email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
    ("account_number", r"[0-9]{13,16}"),
    ("private_url", r"https?://[A-Za-z0-9./?=_&%-]+"),
    ("private_phone", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
    ("secret", r"[0-9a-f]{40}"),
)


#: What stands in every text in which a rule of the class matches, and is found in less time.
HINTS = {"private_email": "@", "private_url": "://"} | dict.fromkeys(("account_number", "private_phone", "secret"), "[0-9]|[a-f]{40}")


class RuleDetector:
    """Regular expressions; of spans that several rules find at one place, the first rule's class counts.

    ``unbroken`` says that no match holds a blank, a line feed or a quote, which allows redaction in DataFrame functions; ``hints`` has for some classes a
    pattern that matches wherever their rules do and costs less.
    """

    def __init__(self, rules: Sequence[tuple[str, str]] = RULES, unbroken: bool | None = None, hints: dict[str, str] | None = None) -> None:
        own = tuple(rules) == RULES
        self.given, self.unbroken, self.hints = tuple(rules), own if unbroken is None else unbroken, (HINTS if own else {}) if hints is None else hints
        self.rules = [(kind, re.compile(pattern.encode())) for kind, pattern in rules]

    def might_match(self, said: Column) -> Column:
        """Whether some rule matches, as an expression."""
        by_hint: dict[str, list[str]] = {}
        for kind, pattern in self.given:
            by_hint.setdefault(self.hints.get(kind, ""), []).append(pattern)
        found = F.lit(False)
        for hint, patterns in by_hint.items():
            sure = reduce(lambda a, b: a | b, map(said.rlike, patterns))
            found = found | (sure if not hint else (said.contains(hint) if re.escape(hint) == hint else said.rlike(hint)) & sure)
        return found

    def detect(self, text: str) -> list[Span]:
        data = text.encode()
        return [(m.start(), m.end(), kind, 1.0) for kind, rule in self.rules for m in rule.finditer(data)]


class ScriptedDetector:
    """Finds given values, for tests and known names."""

    def __init__(self, values: Sequence[tuple[str, str]]) -> None:
        self.values = [(v.encode(), kind) for v, kind in values if v]

    def detect(self, text: str) -> list[Span]:
        data, out = text.encode(), []
        for value, kind in self.values:
            at = data.find(value)
            while at >= 0:
                out.append((at, at + len(value), kind, 1.0))
                at = data.find(value, at + len(value))
        return sorted(out)


class OnnxDetector:
    """A token-classification model, by paths or as bytes and JSON. It is tried on the driver and loaded once in each worker."""

    def __init__(self, model_path: str | bytes, tokenizer_path: str, labels: Sequence[str], biases: bioes.Biases = bioes.Biases()) -> None:
        self.model, self.words, self.decoder = model_path, tokenizer_path, bioes.Decoder(labels, biases)
        self.load()

    def load(self) -> None:
        try:
            import onnxruntime
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # for batches of texts
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
            self.session = onnxruntime.InferenceSession(self.model, options, providers=["CPUExecutionProvider"])
            self.tokenizer = Tokenizer.from_str(self.words) if self.words.lstrip().startswith("{") else Tokenizer.from_file(self.words)
        except Exception as error:
            raise DetectorUnavailable(f"the model cannot be loaded: {error}") from error
        given = {i.name: i.shape for i in self.session.get_inputs()}
        self.inputs = sorted((n for n in given if n in ("input_ids", "attention_mask")), key=lambda n: n != "input_ids")
        self.alone = any(isinstance(given[n][0], int) for n in self.inputs if given[n])  # a graph with a fixed number of texts a call

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("session", "tokenizer", "inputs", "alone")}  # sessions do not travel

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.load()

    @classmethod
    def from_folder(cls, folder: str, model: str = "onnx/model_q4f16.onnx", point: str = "default") -> OnnxDetector:
        """The detector of a downloaded model: its labels from ``config.json``, its biases from the calibration if it has one."""
        place = Path(folder)
        try:
            labels = bioes.parse_labels((place / "config.json").read_text())
            calibration = place / "viterbi_calibration.json"
            biases = bioes.parse_biases(calibration.read_text(), point) if calibration.exists() else bioes.Biases()
        except (OSError, ValueError, KeyError) as error:
            raise DetectorUnavailable(f"the model in {folder} is missing or incomplete: {error}") from error
        return cls(str(place / model), str(place / "tokenizer.json"), labels, biases)

    def detect(self, said: str) -> list[Span]:
        return self.detect_many([said])[0]

    def detect_many(self, texts: Sequence[str], room: int = CALL_TOKENS) -> list[list[Span]]:
        """Spans of each text, several texts a call: those of like length together, padded to the longest under a mask."""
        import numpy as np

        coded = self.tokenizer.encode_batch(list(texts), add_special_tokens=False)
        numbers = [c.ids for c in coded]
        out: list[list[Span]] = [[] for _ in texts]
        waiting: dict[int, np.ndarray] = {}

        def decode() -> None:
            for n, found in zip(waiting, self.decoder.runs(list(waiting.values()))):
                if found:
                    places = coded[n].offsets
                    ends = bioes.byte_offsets(texts[n], [(places[a][0], places[b][1]) for a, b, _, _ in found])
                    out[n] = text.trim(texts[n].encode(), [(*e, kind, score) for e, (_, _, kind, score) in zip(ends, found)])
            waiting.clear()

        for call in length_buckets([len(ids) for ids in numbers], 0 if self.alone else room, padded="attention_mask" in self.inputs):
            shape = len(call), max(len(numbers[n]) for n in call)
            ids, mask = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
            for row, n in enumerate(call):
                ids[row, : len(numbers[n])], mask[row, : len(numbers[n])] = numbers[n], 1
            given = {n: ids if n == "input_ids" else mask for n in self.inputs}
            logits = self.session.run(None, given)[0].reshape(*shape, -1)
            waiting |= {n: logits[row, : len(numbers[n])] for row, n in enumerate(call)}
            if sum(map(len, waiting.values())) >= DECODE_TOKENS:
                decode()
        decode()
        return out


def length_buckets(sizes: Sequence[int], room: int, padded: bool) -> list[list[int]]:
    """Places of the texts of ``sizes`` tokens by call, the shortest first; those without a token are left out.

    A call has at most ``room`` tokens with its padding, or one text. No more than half of a text's row is padding; a model without a mask gets none, and so
    only texts of the same size share a call.
    """
    calls: list[list[int]] = []
    for n in sorted((n for n, size in enumerate(sizes) if size), key=lambda n: (sizes[n], n)):
        least = sizes[calls[-1][0]] if calls else 0
        fits = calls and (len(calls[-1]) + 1) * sizes[n] <= room and (sizes[n] <= 2 * least if padded else sizes[n] == least)
        if fits:
            calls[-1].append(n)
        else:
            calls.append([n])
    return calls


class RecentDetector:
    """Another detector whose spans are remembered by the hash of the text, the latest used ``capacity`` of them.

    Every Python worker has a memory of its own, which is enough for repeated chunks that lie near each other and costs no
    shuffle; ``detect_distinct_chunks`` is the way that meets every repeat. Failures are not remembered.
    """

    def __init__(self, detector: Detector, capacity: int = CAPACITY) -> None:
        if capacity <= 0:
            raise ValueError("the capacity must be positive")
        self.detector, self.capacity, self.seen = detector, capacity, OrderedDict()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": OrderedDict()}  # memories do not travel

    def __len__(self) -> int:
        return len(self.seen)

    def purge(self) -> None:
        self.seen.clear()

    def detect(self, said: str) -> list[Span]:
        key = hashlib.sha256(said.encode()).digest()
        if key in self.seen:
            self.seen.move_to_end(key)
            return self.seen[key]
        return self._remember(key, self.detector.detect(said))

    def detect_many(self, texts: Sequence[str]) -> list[list[Span]]:
        """The same for several texts: those not remembered go to the detector together, each distinct one once."""
        keys = [hashlib.sha256(t.encode()).digest() for t in texts]
        known = {k: self.seen[k] for k in keys if k in self.seen}
        for k in known:
            self.seen.move_to_end(k)
        new = {k: t for k, t in zip(keys, texts) if k not in known}
        for k, found in zip(new, detect_all(self.detector, list(new.values()))):
            known[k] = self._remember(k, found)
        return [known[k] for k in keys]

    def _remember(self, key: bytes, found: list[Span]) -> list[Span]:
        self.seen[key] = found
        if len(self.seen) > self.capacity:
            self.seen.popitem(last=False)
        return found


_FACTORIES: dict[str, Callable[..., Detector]] = {"rules": RuleDetector, "scripted": ScriptedDetector, "onnx": OnnxDetector, "model": OnnxDetector.from_folder}


def get_detector(name: str, **options) -> Detector:
    """A detector by name; an unknown one, or one that cannot load, is an error, never an empty detector."""
    if name not in _FACTORIES:
        raise DetectorUnavailable(f"no detector is called {name!r}")
    return _FACTORIES[name](**options)
