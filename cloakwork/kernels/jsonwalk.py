"""User-written text in JSON chat requests: where it is, and putting changed text back.

A request is scanned once into a tree that remembers where each value lies in the source. Extraction lists
the JSON string literals that hold user text; reassembly splices new literals into the source, so everything else,
number literals and spacing included, stays byte for byte. Of equal keys of an object the last counts; the members that it
shadows are cut out of the source, as another parser might read them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

MAX_DEPTH = 1000
#: The request families and their paths.
ANTHROPIC, CHAT, RESPONSES, PASSTHROUGH = "anthropic", "openai_chat", "openai_responses", "passthrough"
ROUTES = (("/v1/messages", ANTHROPIC), ("/v1/chat/completions", CHAT), ("/v1/responses", RESPONSES), ("/backend-api/codex/responses", RESPONSES))

_SPACE = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_LONE = re.compile("[\ud800-\udfff]")
_OTHER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null", re.ASCII)


class Bad(ValueError):
    """A request that must not be forwarded."""


def said(literal: str) -> str:
    """The text of a JSON string literal; halves of surrogate pairs that stand alone become U+FFFD."""
    return _LONE.sub("\ufffd", json.loads(literal))


class Node(NamedTuple):
    kind: str  # object, array, string, other
    start: int
    end: int
    items: list  # of (key, Node) or Node


def parse(text: str, cuts: list[tuple[int, int]] | None = None) -> Node:
    """The tree of a JSON text, without recursion; anything but one JSON value is an error.

    Shadowed members are not in the tree; ``cuts`` gets their places, from their key to the next one.
    """
    at, stack, root = _SPACE.match(text).end(), [], None
    while True:
        if at < len(text) and text[at] in "{[":
            stack.append(("object" if text[at] == "{" else "array", at, [], None, []))
            at = _SPACE.match(text, at + 1).end()
            closing = "}" if stack[-1][0] == "object" else "]"
            if at < len(text) and text[at] != closing:
                at = _key(text, at, stack)
                continue
            node = None
        else:
            match = _STRING.match(text, at) or _OTHER.match(text, at)
            if not match:
                raise Bad("invalid JSON")
            node = Node("string" if text[at] == '"' else "other", at, match.end(), [])
            at = match.end()
        while True:
            if node is not None:
                if not stack:
                    root = node
                    break
                kind, start, items, key, _ = stack[-1]
                items.append((key, node) if kind == "object" else node)
                at = _SPACE.match(text, at).end()
                if at < len(text) and text[at] == ",":
                    at = _key(text, _SPACE.match(text, at + 1).end(), stack)
                    break
            kind, start, items, _, keys = stack.pop()
            if at >= len(text) or text[at] != ("}" if kind == "object" else "]"):
                raise Bad("invalid JSON")
            at += 1
            node = Node(kind, start, at, _last(items, keys, cuts) if kind == "object" else items)
        if root is not None:
            break
    if _SPACE.match(text, at).end() != len(text):
        raise Bad("more than one JSON value")
    return root


def _last(items: list[tuple[str, Node]], keys: list[int], cuts: list[tuple[int, int]] | None) -> list[tuple[str, Node]]:
    """The members that no later one of the same key shadows; ``keys`` has the places of the keys."""
    last = {key: n for n, (key, _) in enumerate(items)}
    if len(last) == len(items):
        return items
    if cuts is not None:
        cuts.extend((keys[n], keys[n + 1]) for n, (key, _) in enumerate(items) if last[key] != n)
    return [item for n, item in enumerate(items) if last[item[0]] == n]


def _key(text: str, at: int, stack: list) -> int:
    """In an object, reads the next key; returns where the value starts."""
    kind, start, items, _, keys = stack[-1]
    if kind == "array":
        return at
    match = _STRING.match(text, at)
    colon = _SPACE.match(text, match.end()).end() if match else -1
    if not match or text[colon : colon + 1] != ":":
        raise Bad("invalid JSON")
    keys.append(at)
    stack[-1] = (kind, start, items, said(match[0]), keys)
    return _SPACE.match(text, colon + 1).end()


class Field(NamedTuple):
    """One text: the literal's place in the source, and the places of literals inside it if it is itself JSON."""

    start: int
    end: int
    text: str
    inner: tuple[int, int] | None  # place inside the decoded literal, when the field is a string within encoded JSON


class Cut(NamedTuple):
    """A shadowed member: its place in the source, or in the JSON encoded in the literal that stands there."""

    start: int
    end: int
    inner: tuple[int, int] | None = None


def _get(node: Node, key: str) -> Node | None:
    return next((v for k, v in node.items if k == key), None) if node.kind == "object" else None


def strings(root: Node, depth: int = MAX_DEPTH) -> Iterator[Node]:
    """String values in document order, keys left out; deeper than ``depth`` is an error."""
    stack = [(root, 0)]
    while stack:
        node, level = stack.pop()
        if level > depth:
            raise Bad("JSON is nested too deeply")
        if node.kind == "string":
            yield node
        else:
            children = [v for _, v in node.items] if node.kind == "object" else node.items
            stack.extend((c, level + 1) for c in reversed(children))


def _refuse(constant: str) -> None:
    raise Bad(f"{constant} is no JSON")


def _values(pairs: list[tuple[str, object]]) -> list:
    last = {key: n for n, (key, _) in enumerate(pairs)}
    return [v for n, (k, v) in enumerate(pairs) if last[k] == n]


def string_values(body: str, depth: int = MAX_DEPTH) -> list[str]:
    """Non-empty string values of a JSON text in document order, as :func:`strings` finds them, where their places do not matter."""
    try:
        root = json.loads(body, object_pairs_hook=_values, parse_constant=_refuse)
    except RecursionError:
        return [text for n in strings(parse(body), depth) if (text := said(body[n.start : n.end]))]
    except Bad:
        raise
    except ValueError as error:
        raise Bad("invalid JSON") from error
    out, stack = [], [(root, 0)]
    while stack:
        value, level = stack.pop()
        if level > depth:
            raise Bad("JSON is nested too deeply")
        if type(value) is list:
            stack.extend((v, level + 1) for v in reversed(value))
        elif type(value) is str and value:
            out.append(value if value.isascii() else _LONE.sub("\ufffd", value))
    return out


class Extractor:
    """Ordered fields of one request body."""

    def __init__(self, body: str) -> None:
        self.body, self.fields, self.cuts = body, [], []
        places: list[tuple[int, int]] = []
        self.root = parse(body, places)
        self.cuts.extend(Cut(*place) for place in places)

    def value(self, node: Node) -> str:
        return said(self.body[node.start : node.end])

    def text(self, node: Node, inner: tuple[int, int] | None = None, text: str | None = None) -> None:
        self.fields.append(Field(node.start, node.end, self.value(node) if text is None else text, inner))

    def walk(self, node: Node) -> None:
        for s in strings(node):
            if self.value(s):
                self.text(s)

    def arguments(self, node: Node | None) -> None:
        """Bare JSON, or JSON encoded in a string; a string that is no JSON is one text."""
        if node is None:
            return
        if node.kind != "string":
            return self.walk(node)
        source = self.value(node)
        if not source:
            return
        places: list[tuple[int, int]] = []
        try:
            tree = parse(source, places)
        except Bad:
            return self.text(node)
        self.cuts.extend(Cut(node.start, node.end, place) for place in places)
        for s in strings(tree):
            text = said(source[s.start : s.end])
            if text:
                self.text(node, (s.start, s.end), text)

    def content(self, node: Node | None, kinds: tuple[str, ...], tools: dict | None = None) -> None:
        """A string, or blocks of which those of the given kinds hold a text. A null block is an empty one, a null text an empty text."""
        if node is None:
            return
        if node.kind == "string":
            return self.text(node)
        if node.kind != "array":
            return
        for block in node.items:
            block = self.object(block, "a content block")
            kind = _get(block, "type")
            name = self.value(kind) if kind is not None and kind.kind == "string" else None
            if name in kinds:
                text = _get(block, "text")
                if text is None or (text.kind != "string" and not self.null(text)):
                    raise Bad("a text block without text")
                self.text(text, text="" if self.null(text) else None)
            elif tools and name in tools:
                tools[name](block)

    def null(self, node: Node) -> bool:
        return node.kind == "other" and self.body[node.start : node.end] == "null"

    def object(self, node: Node, what: str) -> Node:
        """The node if it is an object; a null is an object without members."""
        if self.null(node):
            return Node("object", node.start, node.end, [])
        if node.kind != "object":
            raise Bad(f"{what} is not an object")
        return node

    def objects(self, node: Node | None, what: str) -> list[Node]:
        if node is None or self.null(node):
            return []
        if node.kind != "array":
            raise Bad(f"{what} is not a list")
        return [self.object(x, f"one of {what}") for x in node.items]

    def anthropic(self, root: Node) -> None:
        def use(block: Node) -> None:
            if (given := _get(block, "input")) is not None:
                self.walk(given)

        tools = {"tool_use": use, "tool_result": lambda block: self.content(_get(block, "content"), ("text",))}
        self.content(_get(root, "system"), ("text",))
        for message in self.objects(_get(root, "messages"), "messages"):
            self.content(_get(message, "content"), ("text",), tools)

    def openai_chat(self, root: Node) -> None:
        for message in self.objects(_get(root, "messages"), "messages"):
            self.content(_get(message, "content"), ("text",))
            for call in self.objects(_get(message, "tool_calls"), "tool_calls"):
                if (function := _get(call, "function")) is not None:
                    self.arguments(_get(self.object(function, "a function"), "arguments"))
            if (call := _get(message, "function_call")) is not None:
                self.arguments(_get(self.object(call, "function_call"), "arguments"))

    def openai_responses(self, root: Node) -> None:
        kinds = ("input_text", "output_text")
        self.content(_get(root, "instructions"), kinds)
        given = _get(root, "input")
        if given is None or given.kind != "array":
            return self.content(given, kinds)
        for item in given.items:
            item = self.object(item, "an input item")
            kind = _get(item, "type")
            name = self.value(kind) if kind is not None and kind.kind == "string" else None
            if name == "function_call":
                self.arguments(_get(item, "arguments"))
            elif name == "custom_tool_call":
                self.content(_get(item, "input"), kinds)
            elif name in ("function_call_output", "custom_tool_call_output"):
                self.content(_get(item, "output"), kinds)
            else:
                self.content(_get(item, "content"), kinds)


def extract_all(kind: str, body: str) -> tuple[list[Field], list[Cut]]:
    """Fields of a body of the given family, and its shadowed members; a passthrough has none. A malformed body is an error."""
    if kind == PASSTHROUGH:
        return [], []
    found = Extractor(body)
    root = found.object(found.root, "the body")
    {ANTHROPIC: found.anthropic, CHAT: found.openai_chat, RESPONSES: found.openai_responses}[kind](root)
    return found.fields, found.cuts


def extract(kind: str, body: str) -> list[Field]:
    return extract_all(kind, body)[0]


def _literal(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def reassemble(body: str, fields: list[Field], texts: list[str], cuts: list[Cut] = ()) -> str:
    """``body`` without the cuts and with every field's text replaced; fields whose text is unchanged keep their source."""
    whole: dict[tuple[int, int], str] = {(c.start, c.end): "" for c in cuts if c.inner is None}
    nested: dict[tuple[int, int], list[tuple[tuple[int, int], str]]] = {}
    for cut in cuts:
        if cut.inner is not None:
            nested.setdefault((cut.start, cut.end), []).append((cut.inner, ""))
    for field, text in zip(fields, texts, strict=True):
        if text == field.text:
            continue
        if field.inner is None:
            whole[field.start, field.end] = _literal(text)
        else:
            nested.setdefault((field.start, field.end), []).append((field.inner, _literal(text)))
    for place, changes in nested.items():
        whole[place] = _literal(_splice(said(body[place[0] : place[1]]), changes))
    return _splice(body, list(whole.items()))


def _splice(source: str, changes: list[tuple[tuple[int, int], str]]) -> str:
    """``source`` with the texts at their places; what lies inside an earlier place is gone with it."""
    out, done = [], 0
    for (start, end), text in sorted(changes):
        if start >= done:
            out += [source[done:start], text]
            done = end
    return "".join([*out, source[done:]])
