"""Guarded substitution of values by placeholders and back, on UTF-8 bytes. All offsets are byte offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence

Pair = tuple[str, str]
Span = tuple[int, int, str, float]  # start, end, class, score

#: What counts as an encoded blob, and from how many characters on (padding included).
BLOB = re.compile(rb'"([A-Za-z0-9+/_-]+={0,2})"')
BLOB_MIN = 40
SPAN_MIN = 3
PREFIX, HEX_DIGITS = "OG_", 6


def placeholder(kind: str, value: str, nonce: bytes, hex_digits: int = HEX_DIGITS) -> str:
    """Opaque stand-in for ``value``: the class is readable, the value only hashed."""
    return f"{PREFIX}{kind.upper()}_{hashlib.sha256(nonce + value.encode()).hexdigest()[:hex_digits]}"


def protected_ranges(data: bytes) -> list[tuple[int, int]]:
    """Half-open ranges of quoted blobs, in which nothing is replaced."""
    if b'"' not in data:
        return []
    return [m.span(1) for m in BLOB.finditer(data) if m.end(1) - m.start(1) >= BLOB_MIN]


def _replace(data: bytes, old: bytes, new: bytes, guard: bool) -> tuple[bytes, int]:
    if old not in data:
        return data, 0
    ranges = protected_ranges(data) if guard else []
    if not ranges:
        return data.replace(old, new), data.count(old)
    out, done, count, at, r = [], 0, 0, data.find(old), 0
    while at >= 0:
        while r < len(ranges) and ranges[r][1] <= at:
            r += 1
        if r < len(ranges) and ranges[r][0] <= at:
            at = data.find(old, at + len(old))
            continue
        out += [data[done:at], new]
        done, count = at + len(old), count + 1
        at = data.find(old, done)
    return b"".join([*out, data[done:]]), count


def substitute(text: str, pairs: Iterable[Pair], guard: bool = True) -> tuple[str, int]:
    """Every occurrence of each pair's first string becomes its second, the longest first (ties keep their order).

    Pairs apply one after the other to the text so far. With ``guard`` an occurrence that starts inside a quoted
    blob stays.
    """
    data, total = text.encode(), 0
    for old, new in sorted(((a.encode(), b.encode()) for a, b in pairs if a), key=lambda p: -len(p[0])):
        data, count = _replace(data, old, new, guard)
        total += count
    return data.decode(errors="replace"), total


def restore(text: str, pairs: Iterable[Pair], guard: bool = True) -> str:
    return substitute(text, [(b, a) for a, b in pairs], guard)[0]


def collect_pairs(text: str, spans: Iterable[Span], nonce: bytes, hex_digits: int = HEX_DIGITS) -> list[Pair]:
    """One pair for each distinct value, in the order of the spans; spans out of range or too short are dropped."""
    data, out = text.encode(), {}
    for start, end, kind, _ in spans:
        if start < 0 or end > len(data) or end - start < SPAN_MIN:
            continue
        value = data[start:end].decode(errors="replace")
        out.setdefault(value, placeholder(kind, value, nonce, hex_digits))
    return list(out.items())


def redact(text: str, spans: Iterable[Span], nonce: bytes, guard: bool = True, hex_digits: int = HEX_DIGITS) -> tuple[str, list[Pair]]:
    pairs = collect_pairs(text, spans, nonce, hex_digits)
    return substitute(text, pairs, guard)[0], pairs


def partial_suffix(buffer: str, placeholders: Sequence[str]) -> int:
    """Bytes at the end of ``buffer`` that begin, but do not finish, some placeholder: the longest such end."""
    data, best = buffer.encode(), 0
    for p in (p.encode() for p in placeholders):
        for n in range(min(len(p) - 1, len(data)), best, -1):
            if data.endswith(p[:n]):
                best = n
                break
    return best


def trim(text: bytes, spans: Iterable[Span]) -> list[Span]:
    """Spans without the blanks at their ends (space, tab, line feed, carriage return); empty ones go."""
    out = []
    for start, end, kind, score in spans:
        part = text[start:end]
        start += len(part) - len(part.lstrip(b" \t\n\r"))
        end -= len(part) - len(part.rstrip(b" \t\n\r"))
        if start < end:
            out.append((start, end, kind, score))
    return out
