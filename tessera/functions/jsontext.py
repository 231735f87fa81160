"""JSON texts read with the place of every value: an exact scanner, diagnostics, comparison with tolerance."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

SPACE = re.compile(r"[ \t\r\n]*")
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
TEXT = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
WORDS = {"true": ("boolean", True), "false": ("boolean", False), "null": ("null", None)}
INT_MAX, UINT_MAX = (1 << 63) - 1, (1 << 64) - 1
#: Levels that values may nest.
DEPTH = 200


class Malformed(ValueError):
    """What is wrong with a text, and the byte where."""

    def __init__(self, text: str, at: int, message: str) -> None:
        self.offset = len(text[:at].encode())
        self.line = text.count("\n", 0, at) + 1
        super().__init__(f"{message} at byte {self.offset}, line {self.line}")
        self.message = message


@dataclass(slots=True)
class Node:
    """kind: null, boolean, string, int, unsigned (above the largest signed), float, array or object. ``at`` is a character."""

    kind: str
    at: int
    value: object


def parse(text: str) -> Node:
    """The tree of a text. Of a repeated key the last value stays, at the first one's place."""
    at = SPACE.match(text, 0).end()
    node, at = _value(text, at, 0)
    at = SPACE.match(text, at).end()
    if at != len(text):
        raise Malformed(text, at, "text after the value")
    return node


def _value(text: str, at: int, depth: int) -> tuple[Node, int]:
    c = text[at : at + 1]
    if depth > DEPTH:
        raise Malformed(text, at, "values nest too deep")
    if c == '"':
        if not (m := TEXT.match(text, at)):
            raise Malformed(text, at, "a string that doesn't end or escapes wrongly")
        return Node("string", at, json.loads(m[0])), m.end()
    if c in ("{", "["):
        return _many(text, at, depth, c == "{")
    for word, (kind, value) in WORDS.items():
        if text.startswith(word, at):
            return Node(kind, at, value), at + len(word)
    if not (m := NUMBER.match(text, at)):
        raise Malformed(text, at, "no value")
    if m[1] or m[2]:
        return Node("float", at, float(m[0])), m.end()
    n = int(m[0])
    if -INT_MAX - 1 <= n <= INT_MAX:
        return Node("int", at, n), m.end()
    return (Node("unsigned", at, n) if 0 < n <= UINT_MAX else Node("float", at, float(n))), m.end()


def _many(text: str, at: int, depth: int, keyed: bool) -> tuple[Node, int]:
    start, close = at, "}" if keyed else "]"
    fields: dict[str, Node] = {}
    items: list[Node] = []
    at = SPACE.match(text, at + 1).end()
    if text[at : at + 1] == close:
        return Node("object" if keyed else "array", start, fields if keyed else items), at + 1
    while True:
        name = ""
        if keyed:
            if not (m := TEXT.match(text, at)):
                raise Malformed(text, at, "no key")
            name = json.loads(m[0])
            at = SPACE.match(text, m.end()).end()
            if text[at : at + 1] != ":":
                raise Malformed(text, at, "no colon after a key")
            at = SPACE.match(text, at + 1).end()
        node, at = _value(text, at, depth + 1)
        if keyed:
            fields[name] = node
        else:
            items.append(node)
        at = SPACE.match(text, at).end()
        if text[at : at + 1] == close:
            return Node("object" if keyed else "array", start, fields if keyed else items), at + 1
        if text[at : at + 1] != ",":
            raise Malformed(text, at, f"neither a comma nor {close}")
        at = SPACE.match(text, at + 1).end()


_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_TOKENS = re.compile(rf'(?:[ \t\r\n{{}}\[\],:]++|{_STRING}|{NUMBER.pattern.replace("(", "(?:").replace("(?:?:", "(?:")}|true|false|null)*+')
_STANDS = re.compile(rf'({_STRING})([ \t\r\n]*:)?|{NUMBER.pattern.replace("(", "(?:").replace("(?:?:", "(?:")}')


def _stand_in(m: re.Match) -> str:
    text = m[0]
    if m[1]:
        return text if m[2] else '""'
    if "." in text or "e" in text or "E" in text:
        return "~"
    n = int(text)
    if -INT_MAX - 1 <= n <= INT_MAX:
        return "-" if n < 0 else "#"
    return "+" if 0 < n <= UINT_MAX else "~"


def skeleton(text: str) -> str | None:
    """A text with one stand-in, a sign that no token has, for all values of a kind: texts of one skeleton have the same paths and kinds, or none is JSON.

    None for a text that is no row of JSON tokens.
    """
    return _STANDS.sub(_stand_in, text) if _TOKENS.fullmatch(text) else None


def step(path: str, name: str) -> str:
    return f"{path}.{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else f"{path}[{json.dumps(name)}]"


def walk(node: Node, path: str = "$") -> Iterator[tuple[str, Node]]:
    """(path, node) of a tree from the root down; elements of a list share a path."""
    todo = [(path, node)]
    while todo:
        path, node = todo.pop()
        yield path, node
        if node.kind == "object":
            todo += [(step(path, k), n) for k, n in reversed(node.value.items())]
        elif node.kind == "array":
            todo += [(f"{path}[]", n) for n in reversed(node.value)]


def is_zero(node: Node | None) -> bool:
    """Whether a value is what an absent field reads as: null, false, 0, an empty text, list or object, or an object of zeros."""
    if node is None or node.kind == "null":
        return True
    if node.kind == "object":
        return all(is_zero(n) for n in node.value.values())
    return not node.value


def difference(a: Node | None, b: Node | None, path: str = "$") -> tuple[str, str] | None:
    """(path, reason) of the first difference; absent fields equal zeros, and numbers are equal by value: 1 is 1.0, 0 is -0."""
    if a is None or b is None:
        return None if is_zero(a) and is_zero(b) else (path, "only in one text")
    numbers = ("int", "unsigned", "float")
    if a.kind in numbers and b.kind in numbers:
        same = a.value == b.value if a.kind == b.kind or "float" not in (a.kind, b.kind) else float(a.value) == float(b.value)
        return None if same else (path, f"{a.value} is not {b.value}")
    if a.kind != b.kind:
        return None if is_zero(a) and is_zero(b) else (path, f"{a.kind} is not {b.kind}")
    if a.kind == "object":
        for name in [*a.value, *(k for k in b.value if k not in a.value)]:
            if found := difference(a.value.get(name), b.value.get(name), step(path, name)):
                return found
        return None
    if a.kind == "array":
        if len(a.value) != len(b.value):
            return path, f"{len(a.value)} elements are not {len(b.value)}"
        return next((d for k, (x, y) in enumerate(zip(a.value, b.value, strict=True)) if (d := difference(x, y, f"{path}[{k}]"))), None)
    return None if a.value == b.value else (path, "another value")
