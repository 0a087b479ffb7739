"""Symbols of Rust sources, by a scanner for items.

Functions with a body, structs, enums, traits, implementations, constants, statics, type aliases,
macros and modules. Implementations, traits and modules hold the functions with a body, constants, type
aliases and macros of their own braces; nothing deeper. Attributes and comments are outside an item's
range, visibility is inside. An implementation is named by the paths of its header: ``Foo``, ``Trait for
Foo``, with generics as they are written; types that are no paths (references, tuples, slices,
primitive ones) leave no word.
"""

from __future__ import annotations

import re

from .lexing import Token, over, pair, scan
from .tree import Node, Positions

EXTENSIONS = ("rs",)
_TOKENS = re.compile(
    r"""(?P<skip>//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)
    |(?P<text>b?r(?P<hashes>\#*)".*?"(?P=hashes)|[bc]?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))')
    |(?P<word>r\#\w+|'?[^\W\d]\w*|\d\w*)
    |(?P<mark>->|=>|::|\S)""",
    re.S | re.X,
)
_NESTED = re.compile(r"/\*|\*/")
#: Items by keyword, their category and label.
_ITEMS = {
    "fn": ("function", "fn"), "struct": ("type", "struct"), "enum": ("type", "enum"), "trait": ("type", "trait"), "impl": ("impl", "impl"), "const": ("variable", "const"),
    "static": ("variable", "static"), "type": ("type", "type"), "macro_rules": ("macro", "macro"), "mod": ("module", "mod"),
}
_INNER = ("fn", "const", "type", "macro_rules")
_QUALIFIERS = frozenset("default unsafe async extern const safe".split())
_PRIMITIVES = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())


def _without_nested_comments(source: str) -> str:
    """Block comments that hold others blanked, line feeds kept: the pattern above takes flat ones alone."""
    if source.count("/*") < 2:
        return source
    out, at = [], 0
    for m in _TOKENS.finditer(source):
        if m.start() < at or not source.startswith("/*", m.start()):
            continue
        depth, end = 0, len(source)
        for edge in _NESTED.finditer(source, m.start()):
            depth += 1 if edge[0] == "/*" else -1
            if not depth:
                end = edge.end()
                break
        out += [source[at : m.start()], re.sub(r"[^\n]", " ", source[m.start() : end])]
        at = end
    return "".join([*out, source[at:]])


class _Scanner:
    def __init__(self, source: str):
        self.source = source
        found = scan(_without_nested_comments(source), _TOKENS)
        self.tokens = pair([Token("text" if t.kind == "hashes" else t.kind, t.text, t.start, t.end, t.feed) for t in found])
        self.places = Positions(source)

    def text(self, i: int) -> str:
        return self.tokens[i].text if i < len(self.tokens) else ""

    def header_end(self, i: int, stop: int) -> int:
        """The index of the brace or semicolon that ends a header begun at i; ``stop`` if there is none."""
        angle = 0
        while i < stop:
            x = self.text(i)
            if x == "<":
                angle += 1
            elif x == ">":
                angle = max(0, angle - 1)
            elif x == ";" or (x == "{" and not angle):
                return i
            i = over(self.tokens, i)
        return stop

    def statement_end(self, i: int, stop: int) -> int:
        while i < stop and self.text(i) != ";":
            i = over(self.tokens, i)
        return i

    def items(self, i: int, stop: int, kinds: tuple[str, ...]) -> list[Node]:
        out: list[Node] = []
        while i < stop:
            if self.text(i) == "#":  # an attribute
                i += 1 + (self.text(i + 1) == "!")
                i = over(self.tokens, i) if i < stop and self.text(i) == "[" else i
                continue
            first = i
            if self.text(i) == "pub":
                i += 1
                i = over(self.tokens, i) if i < stop and self.text(i) == "(" else i
            while i < stop and self.text(i) in _QUALIFIERS and (self.text(i) != "const" or self.text(i + 1) in ("fn", "unsafe", "async", "extern", "impl")):
                i += 1
                if i < stop and self.tokens[i].kind == "text":  # the ABI of an extern
                    i += 1
            key = self.text(i)
            if key not in _ITEMS or self.tokens[i].kind != "word" or (key == "macro_rules" and self.text(i + 1) != "!"):
                # use, extern, union, macro calls and the like: up to their semicolon or braces
                i = self.skipped(i, stop) if i < stop else i
                continue
            node, i = self.item(key, first, i, stop)
            if node is not None and key in kinds:
                out.append(node)
        return out

    def skipped(self, i: int, stop: int) -> int:
        use = self.text(i) in ("use", "extern", "let")
        while i < stop:
            x, at = self.text(i), i
            i = over(self.tokens, i)
            if x == ";" or (x == "{" and not use) or (x == "}" and self.tokens[at].match < 0):
                break
        return i

    def item(self, key: str, first: int, at: int, stop: int) -> tuple[Node | None, int]:
        """The item whose keyword is at ``at``, and the index after it."""
        name = self.text(at + 1 + (key == "macro_rules") + (self.text(at + 1) == "mut"))
        body = -1
        if key in ("const", "static", "type"):
            end = self.statement_end(at, stop)
            good = key != "type" or any(self.text(k) == "=" for k in range(at, end))
        elif key == "macro_rules":
            group = at + 3
            end = self.tokens[group].match if group < stop and self.tokens[group].match >= 0 else group
            end += self.text(group) != "{" and self.text(end + 1) == ";"
            good = True
        else:
            end = self.header_end(at + 1, stop)
            good = self.text(end) == "{" or (key in ("struct", "mod") and self.text(end) == ";")
            if key == "impl":
                name = self.impl_name(at + 1, end)
                good = good and bool(name)
            if self.text(end) == "{":
                body, end = end, self.tokens[end].match
        end = min(end, stop - 1)
        if not good or end < at:
            return None, max(end + 1, at + 1)
        node = self.places.node(name, *_ITEMS[key], self.tokens[first].start, self.tokens[end].end)
        if body >= 0 and key in ("impl", "trait", "mod"):
            node.children = self.items(body + 1, end, _INNER)
        return node, end + 1

    def impl_name(self, i: int, end: int) -> str:
        """The paths of a header and the word between them."""
        if self.text(i) == "<":
            i = self.angles(i, end)
        words: list[str] = []
        while i < end and self.text(i) != "where":
            if self.text(i) == "for":
                words.append("for")
                i += 1
                continue
            start, i = i, self.type_end(i, end)
            if self.is_path(start, i):
                words.append(self.source[self.tokens[start].start : self.tokens[i - 1].end])
        return " ".join(words)

    def angles(self, i: int, end: int) -> int:
        depth = 0
        while i < end:
            depth += (self.text(i) == "<") - (self.text(i) == ">")
            i = over(self.tokens, i)
            if not depth:
                break
        return i

    def type_end(self, i: int, end: int) -> int:
        if self.text(i) == "!":
            return i + 1
        begin = i
        while i < end and (i == begin or self.text(i) not in ("for", "where")):
            i = self.angles(i, end) if self.text(i) == "<" else over(self.tokens, i)
        return i

    def is_path(self, i: int, end: int) -> bool:
        """A word, or words between double colons, generics at any part; nothing before or after."""
        if self.text(i) == "<":
            i = self.angles(i, end)
            return i < end and self.text(i) == "::"
        if self.text(i) == "::":
            i += 1
        while i < end and self.tokens[i].kind == "word" and self.text(i) not in ("dyn", "impl", "fn", "const"):
            alone = i + 1 == end
            if alone and self.text(i) in _PRIMITIVES and self.text(i - 1) != "::":
                return False
            i += 1
            if self.text(i) == "::" and self.text(i + 1) == "<":
                i += 1
            if i < end and self.text(i) == "<":
                i = self.angles(i, end)
            if i >= end:
                return True
            if self.text(i) != "::":
                return False
            i += 1
        return False


def extract(source: str) -> list[Node]:
    s = _Scanner(source)
    return s.items(0, len(s.tokens), tuple(_ITEMS))
