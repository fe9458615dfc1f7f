"""Stable splitting of long texts, and merging of the spans found in the parts. All offsets are byte offsets."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from .text import Span

TARGET, OVERLAP = 4096, 512


class Chunk(NamedTuple):
    ord: int
    start: int
    text: str
    hard_left: bool
    hard_right: bool


def _rune_start(data: bytes, at: int, step: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def split(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[Chunk]:
    """Parts of at most ``target`` bytes that cover the text; growth at the end changes the last part only.

    A part ends after the last line feed in the second half of its room, else after the last space there, else hard, at a
    character's start. After a hard end the next part begins ``overlap`` bytes (a quarter of the target at most) earlier.
    """
    data, overlap = text.encode(), min(overlap, target // 4)
    out: list[Chunk] = []
    start, hard = 0, False
    while len(data) - start > target:
        middle, limit = start + target // 2, start + target
        cut = data.rfind(b"\n", middle, limit) + 1 or data.rfind(b" ", middle, limit) + 1
        soft = cut > 0
        if not soft:
            cut = _rune_start(data, limit, -1)
            if cut <= start:  # a target smaller than a character
                cut = _rune_start(data, start + 1, 1)
        out.append(Chunk(len(out), start, data[start:cut].decode(), hard, not soft))
        back = _rune_start(data, max(cut - overlap, start + 1), 1)
        start, hard = (cut, False) if soft else (min(back, cut), True)
    out.append(Chunk(len(out), start, data[start:].decode(), hard, False))
    return out


def merge(parts: Iterable[tuple[Chunk, Iterable[Span]]], nested: bool = False) -> list[Span]:
    """Spans of all parts in the text's own offsets.

    A span that touches a hard end is cut off there and left to the neighbour. Of spans sorted by start, and the
    longer first, one inside the last kept is dropped; an equal one of the same class leaves its score if higher.
    With ``nested`` only a span at the place of an earlier one is dropped.
    """
    found = []
    for chunk, spans in parts:
        size = len(chunk.text.encode())
        for n, (start, end, kind, score) in enumerate(spans):
            if not (chunk.hard_right and end == size) and not (chunk.hard_left and start == 0):
                found.append((chunk.start + start, -(chunk.start + end), chunk.ord, n, kind, score))
    out: list[Span] = []
    for start, minus, _, _, kind, score in sorted(found):
        end = -minus
        if out and (out[-1][:2] == (start, end) if nested else end <= out[-1][1]):
            if out[-1][:3] == (start, end, kind):
                out[-1] = (start, end, kind, max(score, out[-1][3]))
            continue
        out.append((start, end, kind, score))
    return out
