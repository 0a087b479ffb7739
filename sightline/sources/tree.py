"""Symbol trees of source files: what an extractor returns, and its rows.

An extractor is a function from a source text to a list of ``Node``, which may hold children. The
rows are nested sets: ``ord`` numbers the symbols of a file in tree order, and the descendants of a
symbol are those from its ``ord`` to its ``subtree_end``. Ids are the file's path and the names from
the root; two symbols may share one (a type and its implementation), so ``ord`` tells rows apart.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import regex

SYMBOLS = (
    "file_path string, ord int, subtree_end int, parent_ord int, level int, id string, name string, name_path string, category string, label string, "
    "byte_start long, byte_end long, line_start long, line_end long, content_hash string, merkle_hash string, estimated_tokens long"
)

_WHITE = regex.compile(r"\p{White_Space}+")
_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}_]{1,4}|[^\p{Alphabetic}\p{N}_\p{White_Space}]")


@dataclass
class Node:
    """A declaration: its name, kind, range of bytes and 1-based lines, and what it holds.

    ``lines`` may be those of an inner part of the range (an exported declaration under decorators).
    """

    name: str
    category: str
    label: str
    start: int
    end: int
    lines: tuple[int, int]
    children: list[Node] = field(default_factory=list)
    content_hash: str | None = None  # given where there is no source to hash
    tokens: int | None = None


def content_hash(text: str) -> str:
    """As ``functions.content_hash``: of the text with each run of white space made one space."""
    return hashlib.sha256(_WHITE.sub(" ", text).strip(" ").encode("utf-8", "surrogatepass")).hexdigest()


def estimate_tokens(text: str) -> int:
    """As ``functions.estimate_tokens``."""
    return len(_TOKEN.findall(text))


class Positions:
    """Byte offsets and line numbers of the character offsets of a text."""

    def __init__(self, text: str):
        self.text = text
        self.ascii = text.isascii()
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self._bytes: list[int] | None = None

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        if self._bytes is None:
            total, self._bytes = 0, [0]
            for c in self.text:
                total += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
                self._bytes.append(total)
        return self._bytes[at]

    def line(self, at: int) -> int:
        """The 1-based line that holds the character at ``at``."""
        return bisect_right(self.breaks, at - 1) + 1

    def lines(self, start: int, end: int) -> tuple[int, int]:
        return self.line(start), self.line(end)

    def node(self, name: str, category: str, label: str, start: int, end: int, inner: tuple[int, int] | None = None) -> Node:
        """A node of characters [start, end), with the lines of ``inner`` if that is given."""
        return Node(name, category, label, self.byte(start), self.byte(end), self.lines(*(inner or (start, end))))


def total_lines(source: str) -> int:
    """Lines of a text; a line feed at the end begins no further line."""
    return source.count("\n") + (bool(source) and not source.endswith("\n"))


def rows(path: str, source: str | None, roots: list[Node]) -> Iterator[tuple]:
    """The rows of a file in the order of ``SYMBOLS``; without a source, hashes and tokens are the nodes' own."""
    raw = source.encode("utf-8", "surrogatepass") if source is not None else b""
    out: list[list] = []

    def walk(node: Node, parent: int | None, level: int, prefix: str) -> str:
        at = len(out)
        text = raw[node.start : node.end].decode("utf-8", "replace") if source is not None else ""
        own = node.content_hash if node.content_hash is not None else content_hash(text)
        tokens = node.tokens if node.tokens is not None else estimate_tokens(text)
        name_path = f"{prefix}/{node.name}" if prefix else node.name
        out.append([path, at, at, parent, level, f"{path}::{name_path}", node.name, name_path, node.category, node.label, node.start, node.end, *node.lines, own, own, tokens])
        if node.children:  # a leaf's roll-up is its own hash
            below = [walk(c, at, level + 1, name_path) for c in node.children]
            out[at][2] = len(out) - 1
            out[at][15] = hashlib.sha256("".join([own, *below]).encode()).hexdigest()
        return out[at][15]

    for root in roots:
        walk(root, None, 0, "")
    return map(tuple, out)
