"""Tokens of brace languages: positions, and for each bracket the place of its partner."""

from __future__ import annotations

import re
from dataclasses import dataclass

_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Token:
    kind: str  # word, text (a literal) or mark
    text: str
    start: int
    end: int
    feed: bool  # a line break lies between this token and the one before
    match: int = -1  # of a bracket: the index of its partner


def pair(tokens: list[Token]) -> list[Token]:
    """Set ``match`` of all brackets; a bracket without a partner closes at the last token."""
    open_: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in "([{":
            open_.append(i)
        elif t.text in _PAIRS:
            # A closing bracket of another kind closes nothing, unless its partner lies further down.
            down = next((k for k in range(len(open_) - 1, -1, -1) if tokens[open_[k]].text == _PAIRS[t.text]), None)
            if down is not None:
                j = open_[down]
                tokens[j].match, t.match = i, j
                for k in open_[down + 1 :]:
                    tokens[k].match = i - 1 if i - 1 > k else k
                del open_[down:]
    for k in open_:
        tokens[k].match = len(tokens) - 1
    return tokens


def over(tokens: list[Token], i: int) -> int:
    """The index after token i, or after the group that it opens."""
    t = tokens[i]
    return max(t.match, i) + 1 if t.kind == "mark" and t.text in "([{" else i + 1


def scan(text: str, pattern: re.Pattern[str]) -> list[Token]:
    """Tokens by a pattern with groups ``skip``, ``text``, ``word`` and ``mark``; whatever else is passed over."""
    out: list[Token] = []
    last = 0
    for m in pattern.finditer(text):
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup or "mark", m[0], m.start(), m.end(), "\n" in text[last : m.start()]))
            last = m.end()
    return out
