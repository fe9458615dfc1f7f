"""Restoring placeholders in a server-sent event stream, though one may be cut over several events.

The state of a stream is four values, so it fits a streaming state store. Neither a placeholder nor a guarded blob holds
a character outside of their alphabets, a blank or most signs and letters of other scripts, so text up to the last such one is settled once it is out: only what
follows is kept and restored again.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass

from .jsonwalk import ANTHROPIC, CHAT, RESPONSES, Node, parse, said
from .jsonwalk import Bad as BadJson
from .text import Pair, partial_suffix, restore

DATA = "data: "
BLANKS = (" ", "\n")
#: What guarded blobs and the quotes around them are made of.
BLOB_SIGNS = string.ascii_letters + string.digits + '+/_-="'


@dataclass
class State:
    raw: str = ""  # an unfinished line
    content: str = ""  # unsettled text of the block, placeholders and all
    sent: int = 0  # bytes of it, restored, that went out
    last: str = ""  # payload of the latest delta, to write the held rest with


@dataclass(frozen=True)
class Event:
    kind: str  # delta, stop, done, other
    text: str = ""
    place: tuple[int, int] | None = None  # of the text's literal in the payload


def _member(node: Node | None, *path: str | int) -> Node | None:
    for key in path:
        if node is None:
            return None
        if isinstance(key, int):
            node = node.items[key] if node.kind == "array" and len(node.items) > key else None
        else:
            node = next((v for k, v in node.items if k == key), None) if node.kind == "object" else None
    return node


def decode(kind: str, payload: str) -> Event | None:
    """What a data line means in the given family; None if it cannot be read."""
    try:
        root = parse(payload)
    except BadJson:
        return None
    if root.kind != "object":
        return None

    def value(*path: str | int) -> str | None:
        node = _member(root, *path)
        return said(payload[node.start : node.end]) if node is not None and node.kind == "string" else None

    def delta(*path: str | int) -> Event:
        node = _member(root, *path)
        return Event("delta", value(*path), (node.start, node.end)) if node is not None and node.kind == "string" else Event("other")

    named = value("type")
    if kind == ANTHROPIC:
        if named == "content_block_delta" and value("delta", "type") == "text_delta":
            return delta("delta", "text")
        return Event({"content_block_stop": "stop", "message_stop": "done"}.get(named, "other"))
    if kind == CHAT:
        return delta("choices", 0, "delta", "content")
    if kind == RESPONSES:
        if named == "response.output_text.delta":
            return delta("delta")
        return Event({"response.output_text.done": "stop", "response.completed": "done"}.get(named, "other"))
    return Event("other")


class Restorer:
    """Lines of one response in, restored lines out."""

    def __init__(self, kind: str, pairs: list[Pair], state: State | None = None, guard: bool = True) -> None:
        self.kind, self.pairs, self.state, self.guard = kind, pairs, state or State(), guard
        self.placeholders = [p for _, p in pairs if len(p.encode()) >= 2]
        self.settles = True
        self.unsettled = BLOB_SIGNS + "".join({c for _, p in pairs for c in p})

    def feed(self, data: str) -> list[str]:
        """Whole lines that ``data`` finishes, restored; the rest waits."""
        *lines, self.state.raw = (self.state.raw + data).split("\n")
        return [out for line in lines for out in self.line(line)]

    def close(self) -> list[str]:
        """The unfinished line, if any, and then the held rest."""
        rest, self.state.raw = self.state.raw, ""
        return [*(self.line(rest) if rest else []), *self.flush()]

    def line(self, line: str) -> list[str]:
        if not self.pairs or not line.startswith(DATA):
            return [line]
        end = "\r" if line.endswith("\r") else ""
        payload = line[len(DATA) : len(line) - len(end)]
        event = decode(self.kind, payload)
        if event is not None and event.kind == "delta":
            return [self._delta(payload, event) + end]
        held = self.flush() if event is not None and event.kind in ("stop", "done") else []
        return [*held, DATA + restore(payload, self.pairs, self.guard) + end]

    def _delta(self, payload: str, event: Event) -> str:
        state = self.state
        state.content += event.text
        state.last = payload
        whole = restore(state.content, self.pairs, self.guard)
        data = whole.encode()
        safe = len(data) - partial_suffix(whole, self.placeholders)
        fresh = data[state.sent : safe].decode(errors="replace") if safe > state.sent else ""
        state.sent = max(state.sent, safe)
        if self.settles:
            self._settle()
        return DATA + self._with(payload, event.place, fresh)

    def _settle(self) -> None:
        """Forgets the text up to the last character that is in no placeholder and no blob: it is out, as what is held back never reaches over one."""
        state = self.state
        cut = len(state.content.rstrip(self.unsettled))
        if cut:
            state.sent -= len(restore(state.content[:cut], self.pairs, self.guard).encode())
            state.content = state.content[cut:]

    @staticmethod
    def _with(payload: str, place: tuple[int, int], text: str) -> str:
        return payload[: place[0]] + json.dumps(text, ensure_ascii=False) + payload[place[1] :]

    def flush(self) -> list[str]:
        """The held rest as one more delta; the block's state is cleared."""
        state, out = self.state, []
        if state.content:
            rest = restore(state.content, self.pairs, self.guard).encode()[state.sent :]
            if rest:
                event = decode(self.kind, state.last)
                out = [DATA + self._with(state.last, event.place, rest.decode(errors="replace"))]
        state.content, state.sent, state.last = "", 0, ""
        return out
