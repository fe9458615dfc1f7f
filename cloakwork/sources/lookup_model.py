"""A token-classification model that looks words up: for names and terms that are known, and to try model detection without a download.

The model is a small ONNX graph: a table row for each token, and what the other words of the text add to it. Its tokenizer splits at white space. Both are
made here, as bytes and as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np

#: Fixed values of the ONNX format: element types, and the versions that are written.
FLOAT, INT64, IR_VERSION, OPSET = 1, 7, 8, 13


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _tensor_type(kind: int, dims: Sequence[str]) -> bytes:
    shape = b"".join(_field(1, _field(2, d)) for d in dims)
    return _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def _node(kind: str, inputs: Sequence[str], output: str, **numbers: int) -> bytes:
    named = b"".join(_field(5, _field(1, name) + _field(3, value) + _field(20, 2)) for name, value in numbers.items())
    return _field(1, b"".join(_field(1, n) for n in inputs) + _field(2, output) + _field(4, kind) + named)


def _constant(name: str, values: np.ndarray) -> bytes:
    kind, plain = (INT64, "<i8") if values.dtype.kind == "i" else (FLOAT, "<f4")
    return _field(5, b"".join(_field(1, d) for d in values.shape) + _field(2, kind) + _field(8, name) + _field(9, np.ascontiguousarray(values, dtype=plain).tobytes()))


def table_model(table: np.ndarray, context: np.ndarray | None = None) -> bytes:
    """The graph that gives ``table``'s row for each of its ``input_ids`` (texts x tokens).

    With ``context``, a second table, every token's logits also have the sum of that table's rows over all tokens of its text. The graph then has an ``attention_mask``,
    and what it masks counts for nothing.
    """
    inputs = _field(11, _field(1, "input_ids") + _tensor_type(INT64, ("texts", "tokens")))
    if context is None:
        body = _node("Gather", ["table", "input_ids"], "logits") + _constant("table", table)
    else:
        inputs += _field(11, _field(1, "attention_mask") + _tensor_type(INT64, ("texts", "tokens")))
        body = b"".join((
            _node("Gather", ["table", "input_ids"], "own"),
            _node("Gather", ["context", "input_ids"], "said"),
            _node("Cast", ["attention_mask"], "flags", to=FLOAT),
            _node("Unsqueeze", ["flags", "last"], "mask"),
            _node("Mul", ["said", "mask"], "heard"),
            _node("ReduceSum", ["heard", "middle"], "around", keepdims=1),
            _node("Add", ["own", "around"], "logits"),
            *(_constant(n, v) for n, v in (("table", table), ("context", context), ("last", np.array([2])), ("middle", np.array([1])))),
        ))
    outputs = _field(12, _field(1, "logits") + _tensor_type(FLOAT, ("texts", "tokens", "labels")))
    return _field(1, IR_VERSION) + _field(7, body + _field(2, "lookup") + inputs + outputs) + _field(8, _field(1, "") + _field(2, OPSET))


def lookup_model(words: Mapping[str, Sequence[float]], other: Sequence[float], context: Mapping[str, Sequence[float]] | None = None) -> tuple[bytes, str]:
    """(model, tokenizer) with the given logits for each word, and ``other`` for all that are not listed.

    ``context`` has what some words add to the logits of every word of their text, each time they stand there.
    """
    listed = list(dict.fromkeys([*words, *(context or ())]))
    vocabulary = {"[UNK]": 0, **{w: n for n, w in enumerate(listed, 1)}}
    tokenizer = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocabulary, "unk_token": "[UNK]"}}
    around = None if context is None else np.array([[0.0] * len(other), *(context.get(w, [0.0] * len(other)) for w in listed)])
    return table_model(np.array([other, *(words.get(w, other) for w in listed)], dtype=float), around), json.dumps(tokenizer)
