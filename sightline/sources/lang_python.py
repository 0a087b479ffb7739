"""Symbols of Python sources, from the standard library's syntax tree.

Functions, classes with their bodies, type aliases, and assignments that are annotated or named in
capitals. Statements that hold blocks (if, for, while, with, try, match) are looked through, but for the
``else`` of loops; function bodies are not. Decorators belong to their definition's range.

A text that does not parse as a whole is parsed piece by piece, a piece being what begins at the start
of a line up to the next such place; pieces that do not parse give no symbols.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right

from .tree import Node

EXTENSIONS = ("py",)
_CAPITALS = re.compile(r"(?=[A-Z0-9_]*[A-Z])[A-Z0-9_]+", re.A)
_PIECE = re.compile(rb"^(?=[^\s#)\]}])(?!(?:else|elif|except|finally)\b)", re.M)
_LINE = re.compile(rb"\r\n|\r|\n")


class _Source:
    def __init__(self, raw: bytes):
        self.raw = raw
        self.starts = [0, *(m.end() for m in _LINE.finditer(raw))]
        self.feeds = [i for i, c in enumerate(raw) if c == 10]

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def node(self, name: str, category: str, label: str, start: int, end: int) -> Node:
        return Node(name, category, label, start, end, (bisect_right(self.feeds, start - 1) + 1, bisect_right(self.feeds, end - 1) + 1))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def symbols(self, body: list[ast.stmt]) -> list[Node]:
        out: list[Node] = []
        for s in body:
            match s:
                case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                    start, end = self.span(s)
                    if s.decorator_list:
                        start = self.raw.rindex(b"@", 0, self.span(s.decorator_list[0])[0])
                    kind = ("type", "class") if isinstance(s, ast.ClassDef) else ("function", "def")
                    node = self.node(s.name, *kind, start, end)
                    if isinstance(s, ast.ClassDef):
                        node.children = self.symbols(s.body)
                    out.append(node)
                case ast.TypeAlias():
                    start, end = self.span(s)
                    name = self.raw[self.span(s.name)[0] : self.span(s.value)[0]].rpartition(b"=")[0].strip()
                    out.append(self.node(name.decode(), "type", "type", start, end))
                case ast.AnnAssign(target=ast.Name(id=name), simple=1):
                    out.append(self.node(name, "variable", "var", *self.span(s)))
                case ast.Assign(targets=[ast.Name(id=name), *_]) if _CAPITALS.fullmatch(name):
                    out.append(self.node(name, "variable", "var", *self.span(s)))
                case ast.If():
                    out += self.symbols(s.body) + self.symbols(s.orelse)
                case ast.For() | ast.AsyncFor() | ast.While() | ast.With() | ast.AsyncWith():
                    out += self.symbols(s.body)
                case ast.Try() | ast.TryStar():
                    for block in (s.body, *(h.body for h in s.handlers), s.orelse, s.finalbody):
                        out += self.symbols(block)
                case ast.Match():
                    for c in s.cases:
                        out += self.symbols(c.body)
        return out


def _parsed(text: str) -> list[ast.stmt] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def extract(source: str) -> list[Node]:
    skip = 3 if source.startswith("﻿") else 0  # a byte order mark
    raw = source.encode("utf-8", "surrogatepass")
    body = _parsed(source.removeprefix("﻿"))
    if body is not None:
        nodes = _Source(raw[skip:]).symbols(body)
    else:
        cuts = [m.start() for m in _PIECE.finditer(raw, skip)]
        nodes = []
        for start, end in zip(cuts, [*cuts[1:], len(raw)][: len(cuts)], strict=True):
            piece = raw[start:end]
            body = _parsed(piece.decode("utf-8", "replace"))
            lines = raw.count(b"\n", 0, start)
            for n in _Source(piece).symbols(body or []):
                nodes.append(_moved(n, start - skip, lines))
    return [_moved(n, skip, 0) for n in nodes] if skip else nodes


def _moved(node: Node, by: int, lines: int) -> Node:
    return Node(node.name, node.category, node.label, node.start + by, node.end + by, (node.lines[0] + lines, node.lines[1] + lines), [_moved(c, by, lines) for c in node.children])
