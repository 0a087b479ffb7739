"""Symbols of TypeScript sources, by a scanner for statements.

Functions with a body, classes and interfaces with their members, type aliases, enums, namespaces with
what they hold, variables bound to a function, and ``declare`` statements. ``export`` and what precedes a
declaration's keyword are looked through; exports of names are none. Decorators before an exported
declaration widen its bytes, not its lines. Where a statement has no semicolon, it ends at a line break
after which the text cannot go on.
"""

from __future__ import annotations

import re

from .lexing import Token, over, pair
from .tree import Node, Positions

EXTENSIONS = ("ts",)
_SKIP = re.compile(r"(?:\s|﻿|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_WORD = re.compile(r"[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*|\d[\w.]*")
_MARK = re.compile(r"=>|\.\.\.|\?\.(?!\d)|\?\?=?|[=!]==?|[<>*+\-&|^%/]=|\+\+|--|&&=?|\|\|=?|\S")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
#: A statement goes on over a line break before one of these, or after one of those.
_GOES_ON_BEFORE = frozenset("= => . ?. ?? , : ? + - * / % & | ^ && || == === != !== < > <= >= ( [ { ) ] += -= *= /= ??= &&= ||= instanceof in as satisfies extends implements is".split())
_GOES_ON_AFTER = frozenset("= => . ?. ?? , : ? + - * / % & | ^ && || == === != !== < ! ~ <= >= += -= *= /= ??= &&= ||= instanceof in as satisfies extends implements is keyof typeof new await".split())
_MODIFIERS = frozenset("public private protected static override readonly abstract accessor declare async get set".split())
_FN, _METHOD, _PROPERTY = ("function", "function"), ("function", "method"), ("variable", "property")
_DECLARE, _NAMESPACE = ("variable", "declare"), ("module", "namespace")


def _template_end(text: str, at: int) -> int:
    """The offset after the template literal whose back quote is at ``at``."""
    depth, i, n = [], at + 1, len(text)
    while i < n:
        c = text[i]
        inside = not depth or depth[-1] == "`"
        if c == "\\":
            i += 1
        elif c == "`":
            if inside and not depth:
                return i + 1
            if inside:
                depth.pop()
            else:
                depth.append("`")
        elif inside and text.startswith("${", i):
            depth.append("{")
            i += 1
        elif not inside and c == "{":
            depth.append("{")
        elif not inside and c == "}":
            depth.pop()
        elif not inside and c in "\"'" and (m := _STRING.match(text, i)):
            i = m.end() - 1
        i += 1
    return n


def tokens_of(text: str) -> list[Token]:
    out: list[Token] = []
    at, last = 0, 0
    while at < len(text):
        if m := _SKIP.match(text, at):
            at = m.end()
            continue
        c, before = text[at], out[-1] if out else None
        if c == "`":
            kind, end = "text", _template_end(text, at)
        elif c in "\"'":
            kind, end = "text", _STRING.match(text, at).end()
        elif c == "/" and (before is None or (before.kind == "mark" and before.text not in (")", "]", "}")) or before.text in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            kind, end = "text", m.end()
        elif m := _WORD.match(text, at):
            kind, end = "word", m.end()
        else:
            kind, end = "mark", _MARK.match(text, at).end()
        out.append(Token(kind, text[at:end], at, end, "\n" in text[last:at]))
        at = last = end
    return pair(out)


class _Scanner:
    def __init__(self, source: str):
        self.source, self.tokens, self.places = source, tokens_of(source), Positions(source)

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def named(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i].kind == "word"

    def node(self, name: str, kind: tuple[str, str], first: int, last: int, inner: tuple[int, int] | None = None) -> Node:
        """A node of the tokens first..last, with the lines of ``inner``."""
        span = lambda a, b: (self.tokens[a].start, self.tokens[b].end)
        return self.places.node(name, *kind, *span(first, last), inner=span(*inner) if inner else None)

    def angles(self, i: int, stop: int) -> int:
        """The index after the type parameters that begin at i."""
        depth = 0
        while i < stop:
            depth += (self.text(i) == "<") - (self.text(i) == ">")
            i = over(self.tokens, i)
            if depth <= 0:
                break
        return i

    def statement_end(self, i: int, stop: int, ends: str = ";") -> int:
        """The index of the last token of a statement that goes on at i; an own semicolon is part of it."""
        first = i
        while i < stop:
            if self.text(i) in ends or self.text(i) in (")", "]", "}"):
                return i if self.text(i) == ";" else i - 1
            t = self.tokens[i]
            if i > first and t.feed and self.text(i - 1) not in _GOES_ON_AFTER and t.text not in _GOES_ON_BEFORE:
                return i - 1
            i = over(self.tokens, i)
        return stop - 1

    def body(self, i: int, stop: int) -> int:
        """The index of the brace that opens a declaration's body, or -1 if its header ends without one."""
        first = i
        while i < stop:
            x = self.text(i)
            if x == "{" and self.text(i - 1) not in (":", "|", "&", "=", "=>", "?", "<", ",", "is", "extends") or x == "{" and self.text(i - 1) == "extends" and self.text(over(self.tokens, i)) not in ("{", "implements"):
                return i
            if x in (";", "}", ")", "]") or (i > first and self.tokens[i].feed and x not in _GOES_ON_BEFORE and self.text(i - 1) not in _GOES_ON_AFTER):
                return -1
            i = self.angles(i, stop) if x == "<" else over(self.tokens, i)
        return -1

    # --- statements

    def statements(self, i: int, stop: int) -> list[Node]:
        out: list[Node] = []
        while i < stop:
            first = i
            while i < stop and self.text(i).startswith("@"):  # decorators
                i += 1
                while i < stop and self.text(i) in (".", "("):
                    i = over(self.tokens, i) if self.text(i) == "(" else i + 2
            outer = None
            if self.text(i) == "export" and self.text(i + 1) not in (".", ":", "=>"):
                outer, decorated = first, i > first
                i += 1 + (self.text(i + 1) == "default")
                first = i
                while i < stop and self.text(i).startswith("@"):
                    i += 1
                    i = over(self.tokens, i) if self.text(i) == "(" else i
                found, i = self.declaration(first, i, stop, top=True, default=self.text(first - 1) == "default")
                if decorated:
                    for n in found[:1]:
                        if n.label in ("function", "class", "abstract class", "interface", "type", "enum"):
                            n.start = self.places.byte(self.tokens[outer].start)
                            n.end = max(n.end, self.places.byte(self.tokens[i - 1].end))
            else:
                found, i = self.declaration(first, i, stop, top=True)
            out += found
        return out

    def declaration(self, first: int, i: int, stop: int, top: bool, default: bool = False) -> tuple[list[Node], int]:
        """Symbols of the statement that begins at ``first`` (its keyword is at i), and the index after it."""
        x, y = self.text(i), self.text(i + 1)
        if x == "declare" and self.named(i + 1) and not self.tokens[i + 1].feed:
            return self.ambient(first, i + 1, stop)
        if x == "function" or (x == "async" and y == "function" and not self.tokens[i + 1].feed):
            at = i + 1 + (x == "async")
            at += self.text(at) == "*"
            return self.with_body(first, at, stop, _FN)
        if x == "class" or (x == "abstract" and y == "class"):
            at = i + 1 + (x == "abstract")
            if not self.named(at) or (self.text(at) in ("extends", "implements") and self.text(at + 1) != "{"):
                return [], self.skipped(i, stop)
            found, after = self.with_body(first, at, stop, ("type", "abstract class" if x == "abstract" else "class"), required=True)
            return found, after
        if x == "interface" and self.named(i + 1):
            return self.with_body(first, i + 1, stop, ("type", "interface"), required=True)
        if x == "type" and self.named(i + 1) and not default:
            end = self.statement_end(i + 2, stop)
            return [self.node(y, ("type", "type"), first, end)] if "=" in (self.text(i + 2), self.text(self.angles(i + 2, stop))) else [], end + 1
        if x == "enum" and self.named(i + 1) or (x == "const" and y == "enum"):
            at = i + 1 + (x == "const")
            return self.with_body(first, at, stop, ("type", "enum"), required=True)
        if x in ("namespace", "module") and i + 1 < stop and self.tokens[i + 1].kind in ("word", "text") and not self.tokens[i + 1].feed:
            name_end = i + 1
            while self.text(name_end + 1) == "." and self.named(name_end + 2):
                name_end += 2
            if self.text(name_end + 1) == "{":
                close = self.tokens[name_end + 1].match
                n = self.node(self.source[self.tokens[i + 1].start : self.tokens[name_end].end], _NAMESPACE, i, close)
                n.children = self.statements(name_end + 2, close)
                return [n], close + 1
            return [], self.skipped(i, stop)
        if x in ("const", "let", "var") and i + 1 < stop and (self.named(i + 1) or y in ("{", "[")) and not default:
            end = self.statement_end(i + 1, stop)
            return [self.node(name, _FN, first, end) for name, _, _, value in self.bindings(i + 1, end + 1) if value >= 0 and self.is_function(value, end + 1)], end + 1
        return [], self.skipped(i, stop)

    def skipped(self, i: int, stop: int) -> int:
        """The index after a statement that gives nothing; blocks of control flow end one as well."""
        if self.text(i) in ("if", "for", "while", "switch", "with", "try", "do", "else", "finally", "catch"):
            while i < stop and self.text(i) != "{":
                if self.text(i) == ";":
                    return i + 1
                i = over(self.tokens, i)
            return over(self.tokens, i) if i < stop else stop
        if self.text(i) == "{":
            return over(self.tokens, i)
        return max(self.statement_end(i, stop) + 1, i + 1)

    def with_body(self, first: int, name: int, stop: int, kind: tuple[str, str], required: bool = False) -> tuple[list[Node], int]:
        """A declaration named at ``name``: with a body a symbol, without one (an overload) none."""
        if not self.named(name):
            return [], self.skipped(name, stop) if not self.text(name) == "(" else self.after_body(name, stop)
        open_ = self.body(name + 1, stop)
        if open_ < 0:
            return [], max(self.statement_end(name + 1, stop) + 1, name + 1)
        close = self.tokens[open_].match
        n = self.node(self.text(name), kind, first, close)
        if kind[1] in ("class", "abstract class", "interface"):
            n.children = self.members(open_ + 1, close, kind[1] == "interface")
        return [n], close + 1

    def after_body(self, i: int, stop: int) -> int:
        open_ = self.body(i, stop)
        return self.tokens[open_].match + 1 if open_ >= 0 else max(self.statement_end(i, stop) + 1, i + 1)

    def bindings(self, i: int, stop: int) -> list[tuple[str, int, int, int]]:
        """(name, first, last, index of the value or -1) of the variables of a declaration."""
        out = []
        while i < stop and self.text(i) != ";":
            first = i
            i = over(self.tokens, i)
            name = self.source[self.tokens[first].start : self.tokens[i - 1].end]
            value = -1
            while i < stop and self.text(i) not in (",", ";"):
                if self.text(i) == "=" and value < 0:
                    value = i + 1
                # type arguments hold commas of their own
                i = self.angles(i, stop) if self.text(i) == "<" and (value < 0 or self.text(i - 1) in ("=", "async")) else over(self.tokens, i)
            out.append((name, first, i - 1, value))
            i += self.text(i) == ","
        return out

    def is_function(self, i: int, stop: int) -> bool:
        """An arrow function or a function expression, and nothing more, begins at i."""
        if self.text(i) == "async" and not self.tokens[i + 1].feed:
            i += 1
        if self.text(i) == "function":
            open_ = self.body(i + 1, stop)
            after = self.tokens[open_].match + 1 if open_ >= 0 else stop
            return self.text(i + 1) != "*" and (after >= stop or self.text(after) in (",", ";", ")", "}"))
        if self.text(i) == "<":
            i = self.angles(i, stop)
        if self.named(i) and self.text(i + 1) == "=>":
            return True
        if self.text(i) != "(":
            return False
        i = over(self.tokens, i)
        if self.text(i) == ":":  # a return type, up to its arrow
            i += 1
            while i < stop and self.text(i) not in ("=>", ",", ";", "="):
                if self.text(i) == "(" and self.text(over(self.tokens, i)) == "=>":
                    i = over(self.tokens, i) + 1
                    continue
                i = self.angles(i, stop) if self.text(i) == "<" else over(self.tokens, i)
        return self.text(i) == "=>"

    def ambient(self, first: int, i: int, stop: int) -> tuple[list[Node], int]:
        """One symbol for a ``declare`` statement; for variables one of each name, on the lines of its own."""
        x = self.text(i)
        if x in ("const", "let", "var") and self.text(i + 1) != "enum":
            end = self.statement_end(i + 1, stop)
            return [self.node(name, _DECLARE, first, end, inner=(a, b)) for name, a, b, _ in self.bindings(i + 1, end + 1)], end + 1
        at = i + 1 + (x in ("abstract", "async", "const"))
        at += self.text(at) == "*"
        if x in ("namespace", "module", "global") and (x == "global" or self.text(at) == "{"):
            name, last = "", at - 1
        else:
            last = at
            while self.text(last + 1) == "." and x in ("namespace", "module"):
                last += 2
            name = self.source[self.tokens[at].start : self.tokens[last].end] if at < stop else ""
        if x == "type":
            end = self.statement_end(at + 1, stop)
        else:
            open_ = self.body(last + 1, stop)
            end = self.tokens[open_].match if open_ >= 0 else max(self.statement_end(last + 1, stop), last)
            end = min(end, stop - 1)
        good = x in ("function", "class", "abstract", "interface", "enum", "const", "type", "namespace", "module", "async") and name
        return [self.node(name, _DECLARE, first, end)] if good else [], end + 1

    # --- members

    def members(self, i: int, stop: int, interface: bool) -> list[Node]:
        out: list[Node] = []
        while i < stop:
            if self.text(i) in (";", ","):
                i += 1
                continue
            decorators = i
            while i < stop and self.text(i).startswith("@"):
                i += 1
                while i < stop and self.text(i) in (".", "("):
                    i = over(self.tokens, i) if self.text(i) == "(" else i + 2
            if i >= stop:
                break
            if self.text(i) == "static" and self.text(i + 1) == "{":
                i = over(self.tokens, i + 1)
                continue
            first, seen = i, set()
            while self.text(i) in _MODIFIERS and self.text(i + 1) not in ("(", "<", ":", "?", "!", "=", ";", ",", "}") and i + 1 < stop and not (self.tokens[i + 1].feed and self.text(i) in ("get", "set", "static", "async", "declare")):
                seen.add(self.text(i))
                i += 1
            i += self.text(i) == "*"
            name = i
            if self.text(i) in ("(", "<") or (self.text(i) == "new" and self.text(i + 1) in ("(", "<")) and interface:  # call and construct signatures
                i = self.member_end(i, stop)[0] + 1
                continue
            if self.text(i) == "[":
                i = over(self.tokens, i)
                label = self.source[self.tokens[name].start : self.tokens[i - 1].end]
                inner = [self.text(k) for k in range(name + 1, i - 1)]
                if len(inner) > 1 and inner[1] in (":", "in"):  # an index signature or a mapped type
                    i = self.member_end(i, stop)[0] + 1
                    continue
            elif self.tokens[i].kind in ("word", "text"):
                label = self.text(i)
                i += 1
            else:
                i = over(self.tokens, i)
                continue
            while self.text(i) in ("?", "!") and not self.tokens[i].feed:
                i += 1
            if self.text(i) in ("(", "<"):
                end, has_body = self.member_end(i, stop)
                kind = _METHOD
                if has_body and not interface and seen & {"get", "set"}:
                    kind = ("function", "get" if "get" in seen else "set")
                out.append(self.node(label, kind, first, end))
            else:
                end = self.statement_end(i, stop, ";,") if i < stop and (not self.tokens[i].feed or self.text(i) in (":", "=")) else i - 1
                end = max(name, end - (self.text(end) == ";"))
                out.append(self.node(label, _PROPERTY, first if interface else decorators, end))
            i = end + 1
        return out

    def member_end(self, i: int, stop: int) -> tuple[int, bool]:
        """The last token of a method that goes on at i, and whether it has a body."""
        if self.text(i) == "<":
            i = self.angles(i, stop)
        if self.text(i) == "new":
            i += 1
        if self.text(i) == "(":
            i = over(self.tokens, i)
        if self.text(i) == "{":
            return self.tokens[i].match, True
        open_ = self.body(i, stop) if i < stop and self.text(i) == ":" else -1
        if open_ >= 0:
            return self.tokens[open_].match, True
        if i >= stop or (self.tokens[i].feed and self.text(i) != ":") or self.text(i) in (";", ","):
            return i - 1, False
        end = self.statement_end(i, stop, ";,")
        return max(i - 1, end - (self.text(end) == ";")), False


def extract(source: str) -> list[Node]:
    s = _Scanner(source)
    return s.statements(0, len(s.tokens))
